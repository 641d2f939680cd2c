"""String, number and date rules of the source application as Column expressions.

Everything here is a built-in Spark expression (JVM side, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped by the source application's trim functions.
PHP_TRIM_CHARS = " \t\n\r\x00\x0b"
JS_TRIM_CHARS = " \t\n\r\x0b\x0c\u00a0\ufeff"

# Shape of a numeric string accepted by the server (sign, digits
# with an optional fraction, optional exponent) and of a strict ISO date.
NUMERIC_PATTERN = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ci(c: Column | str) -> Column:
    """Comparison key of a case-insensitive, trailing-blank-insensitive collation."""
    return F.lower(F.rtrim(col(c)))


def php_trim(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(PHP_TRIM_CHARS))


def js_trim(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(JS_TRIM_CHARS))


def text_or_empty(c: Column | str) -> Column:
    """``trim($x ?? "")``: a missing value reads as the empty string."""
    return F.coalesce(php_trim(col(c)), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, or NULL when nothing is left (blank input clears a field)."""
    t = php_trim(col(c))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)



def is_numeric_text(c: Column | str) -> Column:
    """Server-side numeric test: surrounding whitespace allowed, no NaN/Inf/hex."""
    return F.coalesce(php_trim(col(c)).rlike(NUMERIC_PATTERN), F.lit(False))



def strict_date(c: Column | str) -> Column:
    """A ``YYYY-MM-DD`` text that names a real day, as DATE; otherwise NULL."""
    t = col(c)
    return F.when(t.rlike(DATE_SHAPE), F.try_to_date(t, "yyyy-MM-dd"))




def truthy_flag(value) -> bool:
    """Query-string boolean: 1, true, on, yes (any case) switch a filter on."""
    if isinstance(value, bool):
        return value
    if value is None:
        return False
    return str(value).strip().lower() in ("1", "true", "on", "yes")


def like_contains_pattern(term: str) -> str:
    """``%term%`` for a case-insensitive LIKE; user wildcards stay active.

    A backslash escapes only ``%``, ``_`` and itself; before any other
    character it is dropped, as the source database does.
    """
    fixed = re.sub(r"\\(.?)", lambda m: m[0] if m[1] and m[1] in "%_\\" else m[1], term, flags=re.DOTALL)
    return f"%{fixed}%".lower()


def money(c: Column | str) -> Column:
    """Money value rounded to cents; sums of it do not depend on row order.

    An amount beyond ``decimal(18,2)`` has no such value: NULL, which sums pass
    over while its row still counts.
    """
    return col(c).try_cast("decimal(18,2)")
