"""Joins whose probe side may hold a third of all rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may hold; a smaller table counts a key as hot from a thousandth of its rows on.
TASK_ROWS, LEAST_ROWS, HOT_SHARE = 1_000_000, 1000, 0.001
#: Largest dimension table, in rows, that is broadcast; above it the join shuffles.
BROADCAST_ROWS = 100_000


def hot_rows(total: int) -> int:
    """Rows of a key above which it is hot, among total rows. At most total / hot_rows(total) keys are: 1,000, or
    one a million rows of a larger table."""
    return min(TASK_ROWS, max(LEAST_ROWS, int(total * HOT_SHARE)))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with groups, one row a key, whose column `size` counts the rows of that key.

    Two branches: rows of hot keys meet the broadcast groups of these and never shuffle; all others, whose keys
    have hot_rows(total) rows at most, meet the other groups by a shuffle. Rows are read twice, so rows should be
    a table or cheap to make. A null key gets nulls, without a shuffle too.
    """
    others = [c for c in groups.columns if c != key]
    limit = hot_rows(total)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    many = rows.join(hot, key).select(*rows.columns, *others)
    few = rows.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti").join(cold, key, "left").select(*rows.columns, *others)
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in others])
    return many.unionByName(few).unionByName(none)
