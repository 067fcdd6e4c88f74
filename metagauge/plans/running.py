"""Running totals over long ordered groups without one task per group.

A plain window sorts a whole group in one task, and one group may hold a third of all rows. Here every group is cut into
buckets that follow the order: rows are accumulated inside their bucket, buckets are accumulated among themselves, and
the two are added. Nested buckets repeat the step, so no task ever holds more than one innermost bucket or the list of
buckets one level up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def running_totals(
    rows: DataFrame,
    group: Sequence[str],
    buckets: Sequence[str],
    order: str,
    sums: dict[str, str],
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """``rows`` with running sums, and values of the preceding row, inside each ``group``.

    Rows are ordered by ``buckets``, columns from coarse to fine, and inside an innermost bucket by the column ``order``,
    which has no duplicates there. ``sums`` maps a numeric column to its running sum (the row itself included),
    ``previous`` maps a column to its value in the row before. These columns hold no NULL.

    ``rows`` are read once per bucket level and once more, all but one time for the named columns only: store rows that
    are expensive to derive first (:func:`metagauge.plans.lineage.stored`).
    """
    previous = previous or {}
    if not buckets:
        w = Window.partitionBy(*group).orderBy(order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(
            "*",
            *[F.sum(c).over(upto).alias(out) for c, out in sums.items()],
            *[F.lag(c).over(w).alias(out) for c, out in previous.items()],
        )

    depth = len(buckets)
    total = {c: f"__total{depth}_{c}" for c in sums}
    last = {c: f"__last{depth}_{c}" for c in previous}
    keys = [*group, *buckets]

    inside = running_totals(rows, keys, (), order, sums, previous)
    per_bucket = rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, order).alias(c) for c in previous],
    )
    accumulated = running_totals(per_bucket, group, buckets[:-1], buckets[-1], total, last)
    before = accumulated.select(
        *keys,
        *[(F.col(t) - F.col(c)).alias(t) for c, t in total.items()],
        *[F.col(v) for v in last.values()],
    )
    # The window leaves the rows partitioned and sorted by the keys; a merge join takes them as they are.
    return inside.join(before.hint("merge"), keys).select(
        *rows.columns,
        *[(F.col(out) + F.col(total[c])).alias(out) for c, out in sums.items()],
        *[F.coalesce(F.col(out), F.col(last[c])).alias(out) for c, out in previous.items()],
    )
