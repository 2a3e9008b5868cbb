"""Partitions in step with the input, so that what a task holds doesn't grow with it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a partition.
ROWS = 500_000
#: Rows up to which Spark may broadcast the smaller side of a join.
SMALL = 500_000


def parts(like: DataFrame) -> int:
    """Partitions for as many rows as `like` (cheap to count) has; one for each core at least."""
    return max(-(-like.count() // ROWS), like.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """`df` (cheap to count) dealt evenly into partitions of `rows` rows, for work that costs far more than the rows' move.

    Files give a task for each of their row groups at most, which may be fewer than there are cores.
    """
    return df.repartition(max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism))


def sides(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on the left one's `key`, for a merge join in sized partitions unless the right one is measured to be small."""
    if right.count() <= SMALL:
        return left, right
    return left.repartition(parts(left), key), right.hint("merge")
