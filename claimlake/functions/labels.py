"""Display derivations of a claim row as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, php_trim

# Display texts of the source application.
UNKNOWN_EMPLOYEE = "Unknown Employee"
NOT_ASSIGNED = "Not Assigned"
NO_VALUE = "—"
SPECTACLES = "Spectacles"
DEFAULT_TYPE = "OPD"
MYSELF = "Myself"
CURRENCY_PREFIX = "LKR "


def employee_name(initials, surname, patient_name) -> Column:
    """Trimmed "initials surname", else the patient, else a fixed text."""
    joined = F.trim(F.concat_ws(" ", col(initials), col(surname)))
    return F.coalesce(F.when(joined != "", joined), col(patient_name), F.lit(UNKNOWN_EMPLOYEE))


def employee_name_plain(initials, surname) -> Column:
    """Dashboard form, NULL parts skipped, '' when there is no employee."""
    return F.concat_ws(" ", col(initials), col(surname))


def employee_name_strict(initials, surname) -> Column:
    """Verify form, NULL when any part is NULL."""
    return F.concat(col(initials), F.lit(" "), col(surname))


def full_name(initials, surname) -> Column:
    """Details form, NULL parts read as '', joined and trimmed."""
    return php_trim(F.concat(F.coalesce(col(initials), F.lit("")), F.lit(" "),
                             F.coalesce(col(surname), F.lit(""))))


def division_label(division_name) -> Column:
    """P5: blank or NULL division reads as a fixed text."""
    d = col(division_name)
    return F.coalesce(F.when(F.rtrim(d) != "", d), F.lit(NOT_ASSIGNED))


def payable_amount(approved_amount, amount_requested) -> Column:
    """Approved amount, else requested amount, else 0."""
    return F.coalesce(col(approved_amount), col(amount_requested), F.lit(0.0))


def recent_activity_ts(created_at, updated_at) -> Column:
    """P7 (recent lists): creation time, else last update."""
    return F.coalesce(col(created_at), col(updated_at))


def action_activity_ts(created_at, updated_at) -> Column:
    """P7 (action list): last update, else creation time."""
    return F.coalesce(col(updated_at), col(created_at))


def claim_type_label(claim_type) -> Column:
    """Specs in any case → Spectacles; NULL or '' → OPD; else upper case."""
    t = col(claim_type)
    return (F.when(F.lower(F.coalesce(t, F.lit(""))) == "specs", F.lit(SPECTACLES))
            .when(t.isNull() | (t == ""), F.lit(DEFAULT_TYPE))
            .otherwise(F.upper(t)))


def claim_type_capitalized(claim_type) -> Column:
    """First letter upper, the rest lower; a dash when blank."""
    t = col(claim_type)
    return (F.when(t.isNull() | (t == ""), F.lit(NO_VALUE))
            .otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 2147483647)))))


def amount_lkr(amount) -> Column:
    """P10: ``LKR 1,234.50``; NULL reads as 0.00."""
    cents = F.coalesce(col(amount), F.lit(0.0)).try_cast("decimal(18,2)")
    # beyond decimal(18,2) the number is shown in its own (double) precision
    return F.concat(F.lit(CURRENCY_PREFIX), F.coalesce(F.format_number(cents, 2), F.format_number(col(amount), 2)))


def display_date(opd_date, created_at) -> Column:
    """OPD date, else creation day, as YYYY-MM-DD; a dash when both are NULL."""
    d = F.coalesce(col(opd_date), F.to_date(col(created_at)))
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(NO_VALUE))


def claim_for_label(claim_for) -> Column:
    """P12: 'Self' or blank → Myself, any other value unchanged."""
    c = col(claim_for)
    return F.when(c.isNull() | (c == "") | (c == "Self"), F.lit(MYSELF)).otherwise(c)
