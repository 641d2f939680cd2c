"""JSON request bodies → typed request rows.

A body that is not a JSON object or array is ``invalid_body`` (the server
rejects it); an array decodes to a container without the expected keys, so
all fields read as missing.  Alternative key names resolve first-non-null,
as ``$a ?? $b`` does.  All values are kept as text; the operators apply the
server's own conversions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def body_kind(body: Column) -> Column:
    """``object``, ``array`` or NULL (not JSON, or a JSON scalar)."""
    return (F.when(F.json_object_keys(body).isNotNull(), F.lit("object"))
            .when(F.json_array_length(body).isNotNull(), F.lit("array")))


def parse_requests(df: DataFrame, body_col: str, fields: list[str],
                   aliases: dict[str, list[str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Parse ``body_col`` into one text column per field (``outcome``: ok / invalid_body).

    ``aliases`` maps an output field to further key names tried in order when
    the main key is missing or null.
    """
    aliases = aliases or {}
    keys = list(dict.fromkeys([*fields, *[a for names in aliases.values() for a in names]]))
    schema = T.StructType([T.StructField(k, T.StringType(), True) for k in keys])
    kind = body_kind(F.col(body_col))
    parsed = F.from_json(F.col(body_col), schema, {"mode": "PERMISSIVE"})
    is_obj = kind == "object"
    cols = []
    for f in fields:
        candidates = [parsed[f]] + [parsed[a] for a in aliases.get(f, [])]
        cols.append(F.when(is_obj, F.coalesce(*candidates)).alias(f))
    outcome = F.when(kind.isNull(), F.lit("invalid_body")).otherwise(F.lit("ok"))
    return df.select(*(keep or []), outcome.alias("outcome"), *cols)


# ---------------------------------------------------------------- typed bodies

def _number_text(v: Column) -> Column:
    """A JSON number as the server prints it: whole values without a fraction, no trailing zeros."""
    d = F.try_variant_get(v, "$", "double")
    plain = F.regexp_replace(d.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return (F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("long").cast("string"))
            .when((F.abs(d) >= 1e-3) & (F.abs(d) < 1e7), d.cast("string"))
            .when(F.abs(d) < 1e15, plain).otherwise(d.cast("string")))


def body_text(v: Column) -> Column:
    """A JSON value as text, by its type: ``true`` is ``1``, ``false`` is empty, null and nested values are NULL."""
    kind = F.schema_of_variant(v)
    return (F.when(v.isNull() | F.is_variant_null(v) | kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(None).cast("string"))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("1")).otherwise(F.lit("")))
            .otherwise(_number_text(v)))


def read_bodies(df: DataFrame, body_col: str, fields: list[str],
                aliases: dict[str, list[str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Like :func:`parse_requests`, from one parse per body and with JSON types kept apart.

    The body becomes a VARIANT once and a map of VARIANT values once; every field is a
    lookup in that map, read by the type it has.  Of repeated keys the last counts
    (``spark.sql.variant.allowDuplicateKeys``).
    """
    aliases = aliases or {}
    parsed = df.withColumn("_body", F.try_parse_json(F.col(body_col)))
    parsed = parsed.withColumn("_map", F.try_variant_get("_body", "$", "map<string,variant>"))
    cols = []
    for f in fields:
        found = [body_text(F.try_element_at("_map", F.lit(k))) for k in [f, *aliases.get(f, [])]]
        cols.append(F.coalesce(*found).alias(f))
    container = F.col("_map").isNotNull() | F.schema_of_variant("_body").startswith("ARRAY")
    outcome = F.when(F.coalesce(container, F.lit(False)), F.lit("ok")).otherwise(F.lit("invalid_body"))
    return parsed.select(*(keep or []), outcome.alias("outcome"), *cols)


def body_outcomes(parsed: DataFrame, apply) -> DataFrame:
    """seq, claim_id, outcome of all bodies: ``apply`` (updates to outcomes) decides those that could be read."""
    rejected = parsed.where(F.col("outcome") == "invalid_body").select("seq", F.lit(None).cast("int").alias("claim_id"), "outcome")
    return apply(parsed.where(F.col("outcome") == "ok").drop("outcome")).unionByName(rejected)
