"""Seek paging: a page of a long list, newest first, without sorting the list.

The list is ordered by an activity time (missing ones last) and an id, both
descending.  To find the rows from an offset on, counts per day tell which
days hold them; only those days' rows are looked at further, by second, by
microsecond and then by range of ids, until few enough are left to be sorted.  Each step is one
aggregate; the driver gets one row per day of the list, per second of the
chosen days, per microsecond of the chosen seconds, or per 65,536 ids of the chosen microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lists up to this depth are one top-k; what seeking leaves is at most about so long.
SHALLOW = 5000
ID_RANGE = 1 << 16


def seek(rows: DataFrame, activity: Column, id_col: str, skipped: int, limit: int, weight: Column | None = None) -> tuple[DataFrame, int]:
    """The part of ``rows`` that holds the list's rows ``skipped`` to ``skipped + limit``, and what is left to skip in it.

    ``weight`` is the number of list rows that a row stands for.
    """
    if skipped + limit <= SHALLOW:
        return rows, skipped
    weight = F.lit(1) if weight is None else weight
    time = activity.cast("timestamp")
    ids = F.floor(F.col(id_col) / ID_RANGE)
    # each level splits the groups of the one before, in the list's order
    for level in ([F.to_date(activity)], [F.unix_seconds(time)], [F.unix_micros(time)], [F.unix_micros(time), ids]):
        names = [f"g{k}" for k in range(len(level))]
        counts = rows.groupBy(*[c.alias(n) for c, n in zip(level, names)]).agg(F.sum(weight).alias("n")).collect()
        counts = sorted(((tuple(r[n] for n in names), r.n) for r in counts), key=lambda c: [(v is not None, v) for v in c[0]], reverse=True)
        seen, chosen, before, held = 0, [], 0, 0
        for group, n in counts:
            if seen + n > skipped and seen < skipped + limit:
                before = before if chosen else seen
                chosen.append(group)
                held += n
            seen += n
        if not chosen:
            return rows.limit(0), 0     # the list ends before
        part = F.lit(False)
        for group in chosen:            # each holds a row of the page: not more than ``limit``
            same = F.lit(True)
            for c, value in zip(level, group):
                same = same & (c.isNull() if value is None else c == F.lit(value))
            part = part | same
        rows, skipped = rows.where(part), skipped - before
        if held <= SHALLOW:
            break
    return rows, skipped
