"""What the operators of this package share: inputs, Python column functions, intermediate tables."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.session import ensure_checkpoint_dir

#: Bytes of one Arrow batch handed to a Python worker. A batch holds one row at least, however long its text is.
BATCH_BYTES = 8 << 20

#: Words of lower-cased text as the contamination and license contracts cut them: every other byte separates.
KEPT_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
LOWER_WORDS = bytes(
    b if b in KEPT_BYTES else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))
#: A-Z to a-z, nothing else.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let batches end at ``BATCH_BYTES``, so that a worker's memory does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def batch_column(
    spark: SparkSession, start: Callable[[], Callable[[list], Iterable[pa.Array]]], schema: dict[str, pa.DataType],
) -> Callable[..., Column]:
    """A struct column worked out batch by batch in Python.

    ``start()`` runs once per task and gives a function from the batch's values (bytes or None) to one array
    per field of ``schema``. The column counts as non-deterministic so that a filter on it is not
    pushed below it, which would work it out twice.
    """
    bounded_batches(spark)
    ddl = ", ".join(f"`{name}` {_SQL_TYPES[kind]}" for name, kind in schema.items())
    names, kinds = list(schema), list(schema.values())

    @F.arrow_udf(f"struct<{ddl}>".replace("`", ""))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for batch in batches:
            columns = work(batch.to_pylist())
            yield pa.StructArray.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)],
                names=names)

    return run.asNondeterministic()


_SQL_TYPES = {
    pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean",
    pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>",
    pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>", pa.list_(pa.float64()): "array<double>",
}


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of bounded size; its class travels with it, as functions do."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(handle: Broadcast) -> object:
    """The value that ``share`` was given, on a worker."""
    return pickle.loads(handle.value)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"{wanted}_"
    return wanted


def as_bytes(column: str | Column) -> Column:
    """A text column as bytes: what is not valid UTF-8 reaches the worker too."""
    return (F.col(f"`{column}`") if isinstance(column, str) else column).cast("binary")


class Scratch:
    """Intermediate tables as Parquet in the shared folder that the session names.

    Each of them cuts the lineage: after an executor is lost only the step that reads the table is repeated.
    """

    def __init__(self, spark: SparkSession, label: str):
        ensure_checkpoint_dir(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        self.spark = spark
        self.folder = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
