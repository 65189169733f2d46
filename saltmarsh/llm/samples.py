"""Bounded, repeatable samples of labelled documents, and fitting on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import bounded_batches


def fold(doc_id: str | Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, "UTF-8")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, size: int, allowed: Column | None = None,
) -> DataFrame:
    """At most ``size`` labelled ids, by the order of a hash of the id, with their texts: order, text (bytes), label.

    Only ids and labels are ordered; the chosen ids, bounded by ``size``, are then broadcast to the texts. An id with several
    labels has the largest, an id with several rows the text that comes first by its bytes.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    chosen = (known.groupBy(F.col(doc_id).alias("sample_id")).agg(F.max(label).alias("label"))
              .withColumn("order", F.xxhash64("sample_id"))
              .orderBy("order", "sample_id").limit(size))
    return (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("sample_id"))
            .groupBy("order", "sample_id", F.col("label").cast("int").alias("label")).agg(F.min("text").alias("text"))
            .select("order", "text", "label"))


def fit(rows: DataFrame, start: Callable[[], tuple[Callable, Callable]], *order: str) -> object:
    """Fit a model on a bounded table in one task, the rows in ``order``; gives the model, which must be small.

    ``start()`` gives two functions: one takes an Arrow batch, the other ends the fitting and gives the model.
    """
    bounded_batches(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        take, end = start()
        for batch in batches:
            take(batch)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(end())], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary")
    found = [pickle.loads(bytes(r.model)) for r in one.collect()]
    return found[0] if found else None
