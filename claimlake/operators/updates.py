"""Batches of administrator updates applied to the claim tables.

Every update row carries ``seq`` (arrival order) and ``ts`` (event time);
processing order is ``(ts, seq)``.  Each operator returns the per-row outcome
and the new table state.  The final value of a field is the one written by the
last accepted update of the claim, found with ``max_by`` — a partial aggregate,
so a claim that receives a large share of all updates is folded on the map side
instead of landing whole in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, ci, is_numeric_text, php_trim, text_or_empty
from ..sources.tables import CLAIM_COLUMNS
from .common import broadcast_if_small, checkpointed, is_small, leading_int, number_rows, restrict_to_keys
from .facets import CANONICAL_STATUSES, UNLISTED_ORDER

# Accepted document flags and medical recommendations.
DOCUMENT_FLAGS = ("0", "1", "YES", "NO", "yes", "no")
DOCUMENT_FLAGS_TRUE = ("1", "YES")
RECOMMENDATIONS = ("PENDING", "RECOMMENDED", "NOT_RECOMMENDED")


def _opt(df: DataFrame, name: str) -> Column:
    """An optional request field: the column if the feed has it, else NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _claim_id(df: DataFrame) -> Column:
    return leading_int("claim_id")


def whole_date(text: Column) -> Column:
    """A date, alone or with a time after it; a year, a month or other text is NULL."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:.*)?$"), text.try_cast("date"))


def _with_existence(upd: DataFrame, claims: DataFrame, batch_small: bool) -> DataFrame:
    ids = restrict_to_keys(claims.select(F.col("r_id").alias("_rid")), F.col("_rid"), upd, "_cid",
                           keys_small=batch_small).distinct()
    return upd.join(ids, upd["_cid"] == ids["_rid"], "left")


def _apply_last(claims: DataFrame, accepted: DataFrame, fields: dict[str, str],
                batch_small: bool | None = None) -> DataFrame:
    """New claim state: each claim with accepted updates takes the fields of its last one."""
    payload = F.struct(*[F.col(src).alias(dst) for dst, src in fields.items()], F.col("ts").alias("_ts"))
    last = (accepted.groupBy(F.col("_cid").alias("_lc"))
            .agg(F.max_by(payload, F.struct("ts", "seq")).alias("_last")))
    # one row per changed claim (never more than the batch has rows): broadcast when
    # proven small, so the claims table is not shuffled
    joined = claims.join(broadcast_if_small(last, known_small=batch_small), claims["r_id"] == last["_lc"], "left")
    hit = F.col("_lc").isNotNull()
    cols = []
    for c in CLAIM_COLUMNS:
        if c in fields:
            cols.append(F.when(hit, F.col("_last")[c]).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, F.col("_last")["_ts"].cast("timestamp_ntz")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


@dataclass
class UpdateBatch:
    """Per-row outcome (``seq``, ``claim_id``, ``outcome``) and the new claims table."""
    outcomes: DataFrame
    claims: DataFrame


def _finish(checked: DataFrame, claims: DataFrame, fields: dict[str, str], first_rules: Column) -> UpdateBatch:
    batch_small = is_small(checked)  # bounds every set derived from the batch below
    checked = _with_existence(checked, claims, batch_small)
    outcome = first_rules.when(F.col("_rid").isNull(), F.lit("not_found")).otherwise(F.lit("accepted"))
    checked = checked.withColumn("outcome", outcome)
    outcomes = checked.select("seq", F.col("_cid").alias("claim_id"), "outcome")
    accepted = checked.where(F.col("outcome") == "accepted")
    return UpdateBatch(outcomes, _apply_last(claims, accepted, fields, batch_small))


def apply_document_updates(updates: DataFrame, claims: DataFrame) -> UpdateBatch:
    """Receipt flag (exactly one of 0, 1, YES, NO, yes, no — so ``Yes`` fails), date, invoice.

    Alias keys: ``physical_document_received`` for the flag, ``physical_file_no``
    for the invoice.  Blank date or invoice clears the field.  Outcomes:
    ``invalid_input``, ``invalid_date`` (not a date-time), ``not_found``,
    ``accepted``.
    """
    raw = F.coalesce(_opt(updates, "is_document_received"), _opt(updates, "physical_document_received"))
    date_text = blank_to_null(_opt(updates, "document_received_date"))
    invoice = blank_to_null(F.coalesce(_opt(updates, "invoice_number"), _opt(updates, "physical_file_no")))
    u = updates.select(
        "seq", "ts", _claim_id(updates).alias("_cid"), raw.alias("_raw"),
        F.when(F.upper(raw).isin(list(DOCUMENT_FLAGS_TRUE)), F.lit(1)).otherwise(F.lit(0)).alias("_received"),
        date_text.alias("_date_text"), date_text.try_cast("timestamp_ntz").alias("_date"),
        invoice.alias("_invoice"))
    rules = (F.when((F.col("_cid") <= 0) | ~F.coalesce(F.col("_raw").isin(list(DOCUMENT_FLAGS)), F.lit(False)),
                    F.lit("invalid_input"))
             .when(F.col("_date_text").isNotNull() & F.col("_date").isNull(), F.lit("invalid_date")))
    return _finish(u, claims, {"is_document_received": "_received", "document_received_date": "_date",
                               "invoice_number": "_invoice"}, rules)


def apply_medical_updates(updates: DataFrame, claims: DataFrame) -> UpdateBatch:
    """Recommendation (upper-cased, one of three), remark and approval date.

    Alias key ``recommendation_date`` for the date.  Outcomes:
    ``missing_input``, ``invalid_recommendation``, ``invalid_date``,
    ``not_found``, ``accepted``.
    """
    rec = F.upper(text_or_empty(_opt(updates, "medical_recommendation")))
    date_text = blank_to_null(F.coalesce(_opt(updates, "doctor_approved_date"), _opt(updates, "recommendation_date")))
    u = updates.select(
        "seq", "ts", _claim_id(updates).alias("_cid"), rec.alias("_rec"),
        blank_to_null(_opt(updates, "medical_remark")).alias("_remark"),
        date_text.alias("_date_text"), whole_date(date_text).alias("_date"))
    rules = (F.when((F.col("_cid") <= 0) | (F.col("_rec") == ""), F.lit("missing_input"))
             .when(~F.col("_rec").isin(list(RECOMMENDATIONS)), F.lit("invalid_recommendation"))
             .when(F.col("_date_text").isNotNull() & F.col("_date").isNull(), F.lit("invalid_date")))
    return _finish(u, claims, {"medical_recommendation": "_rec", "medical_remark": "_remark",
                               "doctor_approved_date": "_date"}, rules)


def apply_payment_updates(updates: DataFrame, claims: DataFrame) -> UpdateBatch:
    """Approved amount (numeric, ≥ 0; 0 allowed) and two dates; status is not touched.

    Outcomes: ``invalid_input``, ``invalid_date``, ``not_found``, ``accepted``.
    """
    amount_text = _opt(updates, "approved_amount")
    amount = F.when(is_numeric_text(amount_text), php_trim(amount_text).cast("double"))
    pa_text = blank_to_null(_opt(updates, "payment_approved_date"))
    paid_text = blank_to_null(_opt(updates, "paid_date"))
    u = updates.select(
        "seq", "ts", _claim_id(updates).alias("_cid"), amount.alias("_amount"),
        pa_text.alias("_pa_text"), whole_date(pa_text).alias("_pa"),
        paid_text.alias("_paid_text"), whole_date(paid_text).alias("_paid"))
    bad_date = ((F.col("_pa_text").isNotNull() & F.col("_pa").isNull())
                | (F.col("_paid_text").isNotNull() & F.col("_paid").isNull()))
    rules = (F.when((F.col("_cid") <= 0) | F.col("_amount").isNull() | (F.col("_amount") < 0),
                    F.lit("invalid_input"))
             .when(bad_date, F.lit("invalid_date")))
    return _finish(u, claims, {"approved_amount": "_amount", "payment_approved_date": "_pa",
                               "paid_date": "_paid"}, rules)


# ---------------------------------------------------------------- status updates

def canonical_order(name: Column) -> Column:
    """Display order of a freshly inserted status: canonical only for the exact spelling."""
    expr = None
    for status, order in CANONICAL_STATUSES:
        cond = name == F.lit(status)
        expr = F.when(cond, F.lit(order)) if expr is None else expr.when(cond, F.lit(order))
    return expr.otherwise(F.lit(UNLISTED_ORDER))


# Candidates (unknown names and the late updates before them) that the driver goes through.
CANDIDATES_MAX = 100_000
# Slices of time of a batch: a claim's updates are spread over up to so many tasks.
TIME_SLICES = 64


def introduction_times(candidates: list, top_id: int) -> list[tuple]:
    """(id, ts, seq) of all introductions, one update at a time.

    A candidate with ``nid`` null introduces its ``key`` in any case; one with an
    id only if that id exists by then.
    """
    def place(c):
        return (c.ts is not None, c.ts), c.seq  # a missing time is before all others, as in Spark's order

    found, seen = [], set()
    for c in sorted(candidates, key=lambda c: (*place(c), c.k)):
        if c.key in seen:
            continue
        if c.nid is not None and not (c.nid <= top_id + len(found) and place(found[c.nid - top_id - 1]) < place(c)):
            continue
        seen.add(c.key)
        found.append(c)
    return [(top_id + n, c.ts, c.seq) for n, c in enumerate(found, 1)]


def previous_value(df: DataFrame, key: str, ts: str, seq: str, value: str, out: str, first: str) -> DataFrame:
    """``df`` with ``out``, the ``value`` of the row before in (ts, seq) order of the same ``key``, and ``first``.

    Rows are dealt once, by (key, slice of time); the slices hold about equal
    parts of all rows, so a key with very many rows is spread over as many
    tasks.  The last value of each (key, slice), one row each, is carried to the key's next
    slice.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    share = [i / TIME_SLICES for i in range(1, TIME_SLICES)]
    bounds = df.agg(F.percentile_approx(micros, share, 1000)).first()[0] or []
    bounds = sorted(set(bounds))
    if bounds:
        slices = F.array(*[F.lit(b).cast("long") for b in bounds])
        df = df.withColumn("_slice", F.size(F.filter(slices, lambda b: b < micros)))
    else:
        df = df.withColumn("_slice", F.lit(0))
    order = Window.partitionBy(key, "_slice").orderBy(ts, seq)
    rows = df.withColumn("_own", F.lag(F.struct(value)).over(order))
    ends = df.groupBy(key, "_slice").agg(F.max_by(F.struct(value), F.struct(ts, seq)).alias("_end"))
    carry = ends.select(F.col(key).alias("_carry_key"), F.col("_slice").alias("_carry_slice"),
                        F.lag("_end").over(Window.partitionBy(key).orderBy("_slice")).alias("_carried"))
    carry = carry.where(F.col("_carried").isNotNull())
    rows = rows.join(carry, F.col("_own").isNull() & (F.col(key) == F.col("_carry_key")) & (F.col("_slice") == F.col("_carry_slice")), "left")
    before = F.coalesce("_own", "_carried")
    return (rows.withColumn(out, before[value]).withColumn(first, before.isNull())
            .drop("_own", "_carried", "_carry_key", "_carry_slice", "_slice"))


class StatusBatch:
    """W7 with W8 (new statuses), G2 (old/new status per update) and W9 (log rows).

    Validation: claim id, (status id or name) and a non-blank remark are
    required (``missing_input``); the claim must exist (``not_found``); a status
    id must be in the status table or belong to a status introduced by an earlier
    update of the batch (else ``invalid_status``), as if the updates came one by
    one.  Any status may follow any other.

    A status name resolves case-insensitively to its stored spelling; an unknown
    name is inserted as typed (canonical order only for the exact canonical
    spelling, else 999).  The claim's own status, when unknown, is inserted with
    order 999 by its first accepted update.  Of several introductions of the
    same name the earliest by (ts, seq, new-before-old) wins.  Unlike the
    source, a name-only update logs the resolved id (not 0), and a NULL old
    status is inserted once (also over later batches), not once per update.

    An update with an id above the table's (a *late* one) is accepted when the
    introduction that got this id comes before it; accepting it may introduce
    its claim's old status.  Of each unknown name Spark finds the first update
    that introduces it in any case; only late updates before that can
    change anything.  These few candidates are gone through once, in order of (ts, seq).

    Later outputs are planned on first use.  The checked updates, the
    introductions and the accepted updates are checkpointed once and shared.
    """

    def __init__(self, updates: DataFrame, claims: DataFrame, statuses: DataFrame, history: DataFrame):
        self._claims_in, self._statuses_in, self._history_in = claims, statuses, history
        u = updates.select(
            "seq", "ts", leading_int("claim_id").alias("_cid"),
            leading_int("new_status_id").alias("_nid"),
            text_or_empty("new_status_name").alias("_nname"), text_or_empty("remarks").alias("_rem"),
            F.col("updated_by").cast("int").alias("updated_by"))
        self._small = is_small(u)  # bounds every set derived from the batch below
        cl = restrict_to_keys(claims.select(F.col("r_id").alias("_rid"), F.col("status").alias("_claim_status")),
                              F.col("_rid"), u, "_cid", keys_small=self._small)
        ids = broadcast_if_small(statuses.select(F.col("s_id").alias("_sid"), F.col("status_name").alias("_id_name")))
        missing = (F.col("_cid") <= 0) | ((F.col("_nid") <= 0) & (F.col("_nname") == "")) | (F.col("_rem") == "")
        self._checked = checkpointed(
            u.join(cl, u["_cid"] == cl["_rid"], "left")
            .join(ids, (F.col("_nid") > 0) & (F.col("_nid") == F.col("_sid")), "left")
            .join(self._by_name, (F.col("_nid") <= 0) & (ci(F.col("_nname")) == F.col("_tk")), "left").drop("_tk")
            .withColumn("_rejected", F.when(missing, F.lit("missing_input"))
                        .when(F.col("_rid").isNull(), F.lit("not_found"))))
        self._top_sid = statuses.agg(F.max("s_id")).first()[0] or 0
        self._validated, self._introduced = self._in_turn()
        #: seq, claim_id, outcome
        self.outcomes = self._validated.select("seq", F.col("_cid").alias("claim_id"), "outcome")

    def _in_turn(self) -> tuple[DataFrame, DataFrame | None]:
        """The updates with their outcomes, and the introductions if all had to be found for that."""
        decided = self._decide(None)
        late = self._checked.where(F.col("_rejected").isNull() & (F.col("_nid") > self._top_sid))
        if late.isEmpty():
            return decided, None
        # what introduces a name in any case: names typed, and old statuses of claims with an update that is valid by itself
        fixed = self._firsts(decided.where(F.col("outcome") == "accepted"))
        known = self._by_name.select(F.col("_tk").alias("_kk"))
        late = late.select("ts", "seq", "_nid", ci("_claim_status").alias("_key"))
        late = late.join(known, late["_key"].eqNullSafe(known["_kk"]), "left_anti")
        before = fixed.select(F.col("_nk").alias("_fk"), F.struct("ts", "seq").alias("_at"))
        late = (late.join(before, late["_key"].eqNullSafe(before["_fk"]), "left")
                .where(F.col("_at").isNull() | (F.struct("ts", "seq") < F.col("_at"))))
        null = F.lit(None).cast("int")
        candidates = (fixed.select("ts", "seq", "k", null.alias("nid"), F.col("_nk").alias("key"))
                      .unionByName(late.select("ts", "seq", F.lit(1).alias("k"), F.col("_nid").alias("nid"), F.col("_key").alias("key")))
                      .limit(CANDIDATES_MAX + 1).collect())
        if len(candidates) > CANDIDATES_MAX:
            return self._rounds(decided)
        since = introduction_times(candidates, self._top_sid)
        spark = self._checked.sparkSession
        kinds = dict(self._checked.dtypes)
        ids = spark.createDataFrame(since, f"_new_id int, ts {kinds['ts']}, seq {kinds['seq']}")
        ids = ids.select("_new_id", F.lit(None).cast("string").alias("_new_name"), F.struct("ts", "seq").alias("_since"))
        return self._decide(ids), None

    def _rounds(self, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For a list of candidates that the driver should not hold: introductions and acceptances in turn.

        More acceptances only make introductions earlier, and each depends on
        earlier rows only, so it ends with the result of one update at a time.
        """
        introduced, state = None, None
        while True:
            introduced = checkpointed(self._introductions(decided.where(F.col("outcome") == "accepted")))
            mark = F.xxhash64("s_id", "status_name", "ts", "seq").cast("decimal(38,0)")
            now = tuple(introduced.agg(F.count(F.lit(1)), F.sum(mark)).first())
            if now == state:
                return decided, introduced
            state = now
            decided = self._decide(introduced.select(
                F.col("s_id").alias("_new_id"), F.col("status_name").alias("_new_name"), F.struct("ts", "seq").alias("_since")))

    def _decide(self, since: DataFrame | None) -> DataFrame:
        """Outcomes, given when new ids came to be (None: an id above the table's fails)."""
        v = self._checked
        if since is not None:
            v = (v.join(broadcast_if_small(since), (F.col("_nid") == F.col("_new_id")) & (F.col("_since") < F.struct("ts", "seq")), "left")
                 .withColumn("_sid", F.coalesce("_sid", "_new_id"))
                 .withColumn("_id_name", F.coalesce("_id_name", "_new_name")).drop("_new_id", "_new_name", "_since"))
        return v.withColumn("outcome", F.coalesce(
            "_rejected", F.when((F.col("_nid") > 0) & F.col("_sid").isNull(), F.lit("invalid_status"))
            .otherwise(F.lit("accepted"))))

    @cached_property
    def _by_name(self) -> DataFrame:
        return broadcast_if_small(
            self._statuses_in.groupBy(ci("status_name").alias("_tk"))
            .agg(F.min_by("status_name", "s_id").alias("_table_name"), F.min("s_id").alias("_table_sid")))

    @cached_property
    def _accepted(self) -> DataFrame:
        return checkpointed(self._validated.where(F.col("outcome") == "accepted"))

    @cached_property
    def _new_rows(self) -> DataFrame:
        return self._introduced if self._introduced is not None else checkpointed(self._introductions(self._accepted))

    def _firsts(self, acc: DataFrame) -> DataFrame:
        """The first introduction of each unknown name by the accepted updates ``acc``."""
        from_new = (acc.where((F.col("_nid") <= 0) & F.col("_table_sid").isNull())
                    .select("ts", "seq", F.lit(0).alias("k"), F.col("_nname").alias("name"),
                            canonical_order(F.col("_nname")).alias("ord")))
        # the first accepted update of any claim with that status: one row a status before the join
        first_per_old = (acc.groupBy(ci("_claim_status").alias("_ok"))
                         .agg(F.min(F.struct("ts", "seq", "_claim_status")).alias("_f"))
                         .select("_ok", F.col("_f.ts").alias("ts"), F.col("_f.seq").alias("seq"),
                                 F.col("_f._claim_status").alias("name")))
        known = self._by_name.select(F.col("_tk").alias("_kk"))
        from_old = (first_per_old.join(known, first_per_old["_ok"].eqNullSafe(known["_kk"]), "left_anti")
                    .select("ts", "seq", F.lit(1).alias("k"), "name", F.lit(UNLISTED_ORDER).alias("ord")))
        return (from_new.unionByName(from_old)
                .groupBy(ci("name").alias("_nk"))
                .agg(F.min(F.struct("ts", "seq", "k", "name", "ord")).alias("_f"))
                .select("_nk", "_f.ts", "_f.seq", "_f.k", "_f.name", "_f.ord"))

    def _introductions(self, acc: DataFrame) -> DataFrame:
        """Introductions of unknown names by accepted updates, first per case-insensitive name."""
        numbered = number_rows(self._firsts(acc), ["ts", "seq", "k"], out="_n")
        return numbered.select("_nk", (F.lit(self._top_sid) + F.col("_n")).cast("int").alias("s_id"), "ts", "seq",
                               F.col("name").alias("status_name"), F.col("ord").cast("int").alias("status_order"))

    @property
    def new_statuses(self) -> DataFrame:
        """Rows added to the status table."""
        return self._new_rows.select("s_id", "status_name", "status_order")

    @property
    def statuses(self) -> DataFrame:
        """The whole new status table."""
        return self._statuses_in.select("s_id", "status_name", "status_order").unionByName(self.new_statuses)

    @cached_property
    def _fresh(self) -> DataFrame:
        return broadcast_if_small(
            self._new_rows.select(F.col("_nk").alias("_fk"), F.col("s_id").alias("_fresh_sid"),
                                  F.col("status_name").alias("_fresh_name")))

    @cached_property
    def _resolved(self) -> DataFrame:
        """Each accepted update with its new status name (stored spelling) and id."""
        by_id = broadcast_if_small(self._new_rows.select(F.col("s_id").alias("_late_id"), F.col("status_name").alias("_late_name")))
        res = (self._accepted.join(self._fresh, (F.col("_nid") <= 0) & F.col("_table_sid").isNull()
                                   & (ci(F.col("_nname")) == F.col("_fk")), "left")
               .join(by_id, (F.col("_nid") > self._top_sid) & (F.col("_nid") == F.col("_late_id")), "left"))
        return res.select(
            "seq", "ts", "_cid", "_rem", "updated_by", "_claim_status",
            F.when(F.col("_nid") > 0, F.coalesce("_id_name", "_late_name"))
            .when(F.col("_table_sid").isNotNull(), F.col("_table_name"))
            .otherwise(F.col("_fresh_name")).alias("new_status"),
            F.when(F.col("_nid") > 0, F.col("_nid")).when(F.col("_table_sid").isNotNull(), F.col("_table_sid"))
            .otherwise(F.col("_fresh_sid")).alias("new_status_id"))

    @cached_property
    def _replayed(self) -> DataFrame:
        """Old status = the previous accepted update's new status, the claim's own for the first."""
        rep = previous_value(self._resolved, "_cid", "ts", "seq", "new_status", "_prev_status", "_first")
        return rep.withColumn("old_status", F.when(F.col("_first"), F.col("_claim_status"))
                              .otherwise(F.col("_prev_status"))).drop("_first", "_prev_status")

    @property
    def replay(self) -> DataFrame:
        """Seq, claim_id, old_status, new_status."""
        return self._replayed.select("seq", F.col("_cid").alias("claim_id"), "old_status", "new_status")

    @cached_property
    def history(self) -> DataFrame:
        """New log rows; old status id looked up in the new table (a NULL name maps to the row made for it)."""
        old_known = self._by_name.select(F.col("_tk").alias("_ok"), F.col("_table_sid").alias("_old_table_sid"))
        old_fresh = self._fresh.select(F.col("_fk").alias("_of"), F.col("_fresh_sid").alias("_old_fresh_sid"))
        hist = (self._replayed.join(old_known, ci(F.col("old_status")).eqNullSafe(F.col("_ok")), "left")
                .join(old_fresh, ci(F.col("old_status")).eqNullSafe(F.col("_of")), "left"))
        hist = hist.withColumn("old_status_id", F.coalesce("_old_table_sid", "_old_fresh_sid"))
        base_log = self._history_in.agg(F.max("log_id")).first()[0] or 0
        logged = number_rows(hist.select("ts", "seq", "_rem", "_cid", "updated_by", "old_status_id",
                                         "new_status_id"), ["ts", "seq"], out="_ln")
        return logged.select(
            (F.lit(base_log) + F.col("_ln")).cast("long").alias("log_id"), F.col("_rem").alias("remarks"),
            F.col("ts").cast("timestamp_ntz").alias("updated_at"), F.col("_cid").alias("claim_requests_id"),
            "updated_by", F.col("old_status_id").cast("int").alias("old_status_id"),
            F.col("new_status_id").cast("int").alias("new_status_id"))

    @cached_property
    def claims(self) -> DataFrame:
        """The new claims table: last accepted status per claim, stamped with its event time."""
        return _apply_last(self._claims_in, self._resolved, {"status": "new_status"}, self._small)

    @cached_property
    def changes(self) -> DataFrame:
        """claim_id, status, updated_at of the claims this batch changed."""
        return (self._resolved.groupBy(F.col("_cid").alias("claim_id"))
                .agg(F.max_by(F.struct(F.col("new_status").alias("status"),
                                       F.col("ts").cast("timestamp_ntz").alias("updated_at")),
                              F.struct("ts", "seq")).alias("_c"))
                .select("claim_id", "_c.status", "_c.updated_at"))


def apply_status_updates(updates: DataFrame, claims: DataFrame, statuses: DataFrame,
                         history: DataFrame) -> StatusBatch:
    """W7–W9 and G2 for one batch of status updates (see :class:`StatusBatch`)."""
    return StatusBatch(updates, claims, statuses, history)
