"""Stored tables of which only the touched partitions are written again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.session import durable

#: Partition column of tables that have no natural one, and how many values it takes.
BUCKET, BUCKETS = "bucket", 64


def read_stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, or no rows where nothing has been stored yet. ``schema`` holds the partition columns too."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_partitions(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Write ``rows`` in place of the partitions they belong to; all others stay as they are. Doing it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def rewrite(
    spark: SparkSession, path: str, schema, partitions: Sequence[str], touched: DataFrame, change: Callable[[DataFrame], DataFrame],
) -> None:
    """Apply ``change`` to the stored rows of the ``touched`` partitions and store what differs.

    ``touched`` names the partitions by their columns; only they are read. Of them only those in which some row became another one,
    or a new one came, are written again, so a second run with the same change leaves every file alone. ``change`` gives rows of the
    same schema, keeps them in their partitions, and removes none of a partition's rows without leaving one. The new rows
    are made durable before the old ones are replaced. Null partition values are not stored.
    """
    partitions = list(partitions)
    asked = touched.select(*partitions).distinct()
    stored = read_stored(spark, path, schema)
    old = stored.join(F.broadcast(asked), partitions, "left_semi") if partitions else stored
    new = durable(change(old).select(*stored.columns))
    # a row counts by its digest, so nested columns compare too
    counted = [
        df.select(*partitions, F.xxhash64(F.to_json(F.struct(*stored.columns), {"ignoreNullFields": "false"})).alias("_row"))
        .groupBy(*partitions, "_row").agg(F.count(F.lit(1)).alias("_n")) for df in (old, new)]
    same = [F.col(f"old.{c}") == F.col(f"new.{c}") for c in (*partitions, "_row", "_n")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    differs = counted[1].alias("new").join(counted[0].alias("old"), condition, "left_anti").select(*partitions).distinct()
    replace_partitions(new.join(durable(differs), partitions, "left_semi"), path, partitions)


def upsert_stored(
    spark: SparkSession, path: str, schema, incoming: DataFrame, keys: Sequence[str], at: Sequence[str], buckets: int = BUCKETS,
) -> None:
    """Last write per key wins, in a table that is stored by ``bucket`` of the key.

    ``schema`` is that of ``incoming`` without the bucket. Of the stored and the incoming rows of a key the one with the greatest
    ``at`` stays (nulls least), however often and in which order batches come; equal ones must be the same row. The same ``buckets``
    must be given every time.
    """
    keys = list(keys)
    stored_schema = spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0)).schema
    incoming = durable(incoming.withColumn(BUCKET, bucket_of(keys, buckets)))
    rest = [c for c in incoming.columns if c not in (*keys, BUCKET)]

    def newest(old: DataFrame) -> DataFrame:
        rows = old.unionByName(incoming)
        return rows.groupBy(*keys, BUCKET).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_r")).select(*keys, BUCKET, "_r.*")

    rewrite(spark, path, stored_schema, [BUCKET], incoming, newest)
