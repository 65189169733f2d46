"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in two bits at most differ in one bit at most in one of their two halves. So each half is indexed
under its 32 variants with one bit left out; halves that share a variant give a candidate pair, which is verified on all 64 bits.
A crowded variant gives no pairs. Its members are linked through their 65 whole signatures instead (the fingerprint, and
the fingerprint with one bit turned): two members share one exactly if they differ in two bits at most, and no
signature is shared by more than 65 fingerprints. Nothing is dropped, and the rows made grow with the number of fingerprints.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import LOWER, Scratch, as_bytes, batch_column, free_name
from saltmarsh.llm.components import components
from saltmarsh.operators.skew import split_join

#: A variant shared by more fingerprints is crowded.
CROWD = 16
#: Shingles whose bits are added up at once.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; the lower-casing touches A-Z alone."""
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)), strict=True)) \
        if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        part = hashes[start : start + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _worker(shingle: int):
    def start():
        return lambda values: [[fingerprint(v, shingle) for v in values]]

    return start


def _pairs(batches):
    """Verified pairs of the variants of at most ``CROWD`` members, and the members of crowded ones (b is null).

    The rows come sorted by variant. A group of any size passes through in pieces.
    """
    keys, prints, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def work(key, fp, crowded, last):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        size = np.repeat(sizes, sizes)
        full = size > CROWD
        if crowded is not None:
            full |= key == crowded
        left, right = [fp[full]], [None]
        keep = 0 if last or not len(key) else int(sizes[-1])
        if keep and full[-1]:
            crowded, keep = int(key[-1]), 0
        settled = len(key) - keep
        for step in range(1, CROWD):
            first = np.flatnonzero((key[:-step] == key[step:]) & ~full[:-step] if len(key) > step else [])
            first = first[first + step < settled]
            if not len(first):
                break
            a, b = fp[first].astype(np.uint64), fp[first + step].astype(np.uint64)
            differ = a ^ b
            low, high = differ & np.uint64(0xFFFFFFFF), differ >> np.uint64(32)
            upper = key[first] >> 37 == 1
            bit = key[first] >> 32 & 31
            own = np.where(upper, high, low)
            # each pair once: by the lower half if that is near enough, and equal halves by variant 0
            once = (~upper | (np.bitwise_count(low) > 1)) & ((own != 0) | (bit == 0))
            near = (np.bitwise_count(differ) <= 2) & once
            left.append(fp[first[near]])
            right.append(fp[first[near] + step])
        n = len(left[0])
        b = pa.array(np.concatenate([np.zeros(n, np.int64), *right[1:]]), pa.int64(),
                     mask=np.r_[np.ones(n, bool), np.zeros(sum(map(len, right[1:])), bool)])
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), b], names=["a", "b"])
        return out, key[settled:], fp[settled:], crowded

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column("fp").to_numpy(zero_copy_only=False)])
        out, keys, prints, crowded = work(keys, prints, crowded, False)
        yield out
    yield work(keys, prints, crowded, True)[0]


def near_pairs(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` exactly as all pairs at two or fewer differing bits do."""
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(
        "fp", F.expr("""
            (shiftrightunsigned(fp, cast(32 * (k div 32) as int)) & 4294967295 & ~shiftleft(1L, k % 32))
            | shiftleft(cast(k as bigint), 32)""").alias("key"))
    found = (variants.repartition("key").sortWithinPartitions("key")
             .mapInArrow(_pairs, "a bigint, b bigint"))
    return found


def _crowd_links(members: DataFrame) -> DataFrame:
    whole = members.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("k")).select(
        "fp", F.expr("if(k < 0, fp, fp ^ shiftleft(1L, k))").alias("signature"))
    hub = F.min("fp").over(Window.partitionBy("signature"))
    return whole.withColumn("hub", hub).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def simhash_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
) -> DataFrame:
    """Fingerprint every whole text and link fingerprints at two or fewer differing bits.

    Returns one row per row of ``docs``: ``doc_id``, ``fp`` (the 64 bits as a signed long) and ``component_id`` (the
    least id reachable, its own included).

    A null text counts as empty; texts without words have fingerprint zero and link like any other. Equal texts share a
    fingerprint, so copies and repeated rows meet in one aggregate and are never paired. Null ids take part in links but are no
    component id (null if no member has an id). An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    run = batch_column(spark, _worker(shingle), {"fp": pa.int64()})
    prints = scratch.write(
        docs.select(F.col(doc_id).alias("doc_id"), run(as_bytes(text)).alias("made")).select("doc_id", "made.fp"), "prints")
    nodes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    found = scratch.write(near_pairs(nodes), "pairs")
    crowd = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    links = found.where("b is not null").unionAll(_crowd_links(crowd))
    rooted = components(links, scratch)
    scratch.drop("pairs")
    members = rooted.unionAll(rooted.select(F.col("root").alias("node"), "root").distinct())
    linked = members.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "least_id")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # a component may hold a large share of all fingerprints, and a fingerprint of all documents: copies, texts without words
    linked = split_join(linked, least, ["root"]).select("fp", "component_id")
    labels = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return split_join(prints, labels, ["fp"]).select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The documents whose id is their component's, with the columns of ``docs``.

    Rows without an id stay. Of rows with equal id and text one stays.
    """
    found = simhash_components(docs, doc_id=doc_id, text=text, shingle=shingle)
    key = free_name(docs, "gone_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    twice = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(key))
    kept = docs.join(gone, F.col(doc_id) == F.col(key), "left_anti")
    repeated = kept.join(twice, F.col(doc_id) == F.col(key), "left_semi").dropDuplicates([doc_id, text])
    return kept.join(twice, F.col(doc_id) == F.col(key), "left_anti").unionAll(repeated)
