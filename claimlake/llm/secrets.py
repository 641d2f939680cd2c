"""Secret scans: multipart credential linking, with DataFrame functions only.

Patterns find *parts* of credentials in every whole text.  Strong parts are
findings by themselves:

* ``assign``: a keyword assigned a value of 12 characters or more,
* ``access``: an access identifier of 18 characters or more,
* ``hex``: a run of 16 or more hexadecimal digits.

Weak parts (a short access identifier, a short assigned value or a bare
40-character token, an endpoint URL) are reported only if complementary parts
lie in the same scope, i.e. at most ``SCOPE`` code points apart in one text: a
weak identifier needs a secret, a weak secret needs an identifier, an endpoint
needs both.  They are found by an interval join: each part falls into the bins
of ``SCOPE`` code points that it covers, weak parts also into those within
reach, and parts of equal (row, bin) meet.  A part meets only what fits into
its reach, so no row or bin grows with the corpus.

Positions are code points, ends exclusive.  A text split at a pattern gives
the gaps between its matches; start and end are running sums over gaps and
matches.  The text itself is never shuffled, only its parts, which are written
once in the shared folder.

Defined cases: a null text is empty and has no spans; every input row gives
one output row, also null or repeated doc_ids; an empty table gives an empty
table; other columns are ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SCOPE = 200
MIN_VALUE, MIN_WEAK_VALUE = 12, 6
MIN_ACCESS, MIN_WEAK_ACCESS = 18, 12

# fixed values: the patterns and kinds of the findings
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that have 16 or more
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?:https?|s3|postgres|postgresql|mysql|redis|mongodb)://[^\s"'<>]+"""
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "weak_access", "weak_secret", "endpoint"]
PATTERNS = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "bare": (BARE, 0), "endpoint": (ENDPOINT, 0)}


def _matches(name: str, text: Column) -> Column:
    """array<struct<pattern, i, gap, len, value_len>> of one pattern's matches in ``text``."""
    pattern, group = PATTERNS[name]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("len"), values.alias("value_len"))
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(name).alias("pattern"), i.alias("i"), z["gap"].cast("long").alias("gap"), z["len"].cast("long").alias("len"), z["value_len"].cast("long").alias("value_len")))
    return F.filter(rows, lambda r: r["len"].isNotNull())


def _kind() -> Column:
    p, n, v = F.col("pattern"), F.col("len"), F.col("value_len")
    return (F.when((p == "assign") & (v >= MIN_VALUE), "assign").when((p == "assign") & (v >= MIN_WEAK_VALUE), "weak_secret")
            .when((p == "access") & (n >= MIN_ACCESS), "access").when((p == "access") & (n >= MIN_WEAK_ACCESS), "weak_access")
            .when(p == "hex", "hex").when(p == "bare", "weak_secret").when(p == "endpoint", "endpoint"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, kind, start, end of all parts; each row also has one line with a null kind.

    ``row`` numbers the input rows; it is written with the parts, so all later
    steps see the same numbers.
    """
    text = F.col("text")
    marker = F.array(F.struct(F.lit("").alias("pattern"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("value_len")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.select("row", "doc_id", F.explode(F.concat(marker, *[_matches(n, text) for n in PATTERNS])).alias("m")).select("row", "doc_id", "m.*")
    running = W.partitionBy("row", "pattern").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(running))
    placed = placed.select("row", "doc_id", _kind().alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end", (F.col("pattern") == "").alias("marker"))
    return placed.filter("marker or kind is not null").drop("marker")


def link(found: DataFrame) -> DataFrame:
    """The weak parts of ``found`` that complementary parts within SCOPE confirm."""
    spans = found.filter("kind is not null")
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE))).alias("bin")
    weak = spans.filter(~F.col("kind").isin(BASE_KINDS)).select("row", "doc_id", "kind", "start", "end", bins(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE))
    other = spans.select("row", F.col("kind").alias("o_kind"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), bins(F.col("start"), F.col("end")))
    near = (F.col("o_start") - F.col("end") <= SCOPE) & (F.col("start") - F.col("o_end") <= SCOPE)
    overlap = F.col("o_kind").isin(BASE_KINDS) & (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    apart = (F.col("o_start") >= F.col("end")) | (F.col("start") >= F.col("o_end"))
    pairs = weak.join(other, ["row", "bin"]).filter(near)
    seen = pairs.groupBy("row", "doc_id", "kind", "start", "end").agg(
        F.max(F.col("o_kind").isin("access", "weak_access") & apart).alias("identifier"),
        F.max(F.col("o_kind").isin("assign", "weak_secret") & apart).alias("secret"),
        F.max(overlap).alias("covered"))
    need = (F.when(F.col("kind") == "weak_access", F.col("secret")).when(F.col("kind") == "weak_secret", F.col("identifier"))
            .otherwise(F.col("identifier") & F.col("secret")))
    return seen.filter(need & ~F.col("covered")).select("row", "doc_id", "kind", "start", "end")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, kind, start, end: base spans, confirmed weak spans, a line with a null kind per row."""
    found = materialize(parts(docs, id_col, text_col), "secret-parts")
    base = found.filter(F.col("kind").isNull() | F.col("kind").isin(BASE_KINDS))
    return base.unionByName(link(found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every input row."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("o"), "end", "kind"))
    rows = findings(docs, id_col, text_col).groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE_KINDS], F.sort_array(F.collect_list(span)).alias("s"))
    say = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("s", lambda x: x["o"] <= len(BASE_KINDS))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(say(base), 256).alias("base_sha256"), say(F.col("s")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding in ``text_col`` replaced by ``mark``.

    Only rows in which some pattern matches are joined with their spans (and so
    shuffled); all others pass by.  Spans belong to (doc_id, text), so repeated
    rows and doc_ids are each redacted by their own text.
    """
    text = text_or_empty(text_col)
    hit = text.rlike("|".join(f"(?:{p})" for p, _ in PATTERNS.values()))
    key = F.xxhash64(F.col(id_col), text)
    some = docs.filter(hit).withColumn("__key", key)
    distinct = some.groupBy("__key").agg(F.first(text).alias("text"))
    spans = findings(distinct, "__key", "text").filter("kind is not null")
    before = F.coalesce(F.max("end").over(W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = (spans.withColumn("before", before).filter(F.col("end") > F.col("before"))
            .select("doc_id", F.struct(F.greatest("start", "before").alias("start"), "end", "before", (F.col("start") < F.col("before")).alias("goes_on")).alias("c"))
            .groupBy(F.col("doc_id").alias("__key")).agg(F.sort_array(F.collect_list("c")).alias("__cuts")))
    body = F.col(f"`{text_col}`")
    keep = F.transform("__cuts", lambda c: F.when(c["goes_on"], F.lit("")).otherwise(F.concat(F.substring(body, (c["before"] + 1).cast("int"), (c["start"] - c["before"]).cast("int")), F.lit(mark))))
    last = F.element_at(F.col("__cuts"), -1)["end"]
    clean = F.concat(F.array_join(keep, ""), F.substring(body, (last + 1).cast("int"), F.length(body)))
    columns = [F.when(F.col("__cuts").isNull(), body).otherwise(clean).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return some.join(cuts, "__key", "left").select(*columns).unionByName(docs.filter(~hit))
