"""Dense positions inside groups of any size.

``row_number`` over a partition puts a whole group into one task, which a group holding
a third of all rows does not survive. Here the rows are range-partitioned on
(group, order), so a large group spreads over many tasks; each task numbers its own
run and a small table of run lengths supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.session import stored


def with_position(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    name: str = "position",
    start: int = 1,
) -> DataFrame:
    """Add the position of every row in its group, in ``order``, counted from ``start``.

    ``order`` must be a total order inside each group. Group columns must not be null.
    """
    keys = [*group, *order]
    # The positions are read twice below, so they must not change when an executor is
    # lost and a range boundary is sampled again: they are written first.
    placed = stored(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_at", 33).cast("int"))
    )
    runs = placed.groupBy(*group, "_task").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_len")
    )
    # At most one row per task and group: the number of tasks bounds this window.
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = runs.select(
        *group,
        "_task",
        (F.coalesce(F.sum("_len").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        placed.join(offsets, [*group, "_task"])
        .withColumn(name, F.col("_at") + F.col("_shift") + F.lit(start))
        .drop("_at", "_task", "_shift")
    )
