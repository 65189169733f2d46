"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre c and largest angle t between c and a member, no member a has a larger
inner product with a vector x than ``|a| |x| cos(max(0, angle(x, c) - t))``. So the candidates are sorted once per cluster by
``|x| cos(...)``, and every member walks that one list from its start, some thousand candidates at a time as one product of
matrices, until the bound proves that nothing behind can enter its result. Where vectors point everywhere the bound proves this
late or never, and the walk is the exact search that it has to be; no candidate is left out on a guess.

Vectors are dealt into blocks, and each block receives all anchors, sorted by cluster, in a stream: a task holds one
block of bounded size and the anchors of one cluster at a time. What a block finds for an anchor is at most the asked-for number, and
the blocks' findings merge by rank. Positives come first; their scores bound the second walk, for negatives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import Scratch, bounded_batches, share, shared

#: Vectors that a task holds at once, as components (64 MiB as 8-byte numbers).
BLOCK_COMPONENTS = 8 << 20
#: Vectors of a block at least, unless there are fewer.
LEAST_BLOCK = 4096
#: Anchors that walk together, and candidates in a step of their walk.
TOGETHER, STEP = 256, 2048
#: Anchors on which the centres are fitted, and rounds of the fit.
SAMPLE, ROUNDS = 4096, 8
#: Stands for a missing id: behind all others in ties.
NO_ID = (1 << 63) - 1
#: Inner products below this are exact as 8-byte floating-point numbers, also a hundredfold.
EXACT = float(1 << 46)


def fit_centres(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Directions of at most ``clusters`` groups of the sample (spherical k-means, started from evenly spaced rows)."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    centres = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)]
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centres)
    return centres


def angles(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1)
    return np.arccos(np.clip(vectors @ centre / np.maximum(norms, 1e-300), -1, 1))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every inner product, and every sum on the way to it, is exact as a floating-point number."""
    return not len(a) or not len(b) or bool(np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max() < EXACT)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond a long, the nearest long."""
    if small(a, b):
        return a @ b.T
    whole = [[[int(v) for v in row] for row in m] for m in (a, b)]
    return np.clip(np.array(whole[0], object) @ np.array(whole[1], object).T, -NO_ID, NO_ID)


class Best:
    """The first ``k`` candidates of each search, by score and then by id; ``least`` is the last one's score."""

    def __init__(self, searches: int, k: int, kind: type):
        self.k = k
        self.least = np.full(searches, -np.inf, kind)
        self.search = np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        worth = score >= self.least[search]
        if not worth.any():
            return
        search = np.concatenate([self.search, search[worth]])
        score = np.concatenate([self.score, score[worth]])
        ids = np.concatenate([self.id, ids[worth]])
        order = np.lexsort((ids, -score, search))
        search, score, ids = search[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, search[1:] != search[:-1]])
        place = np.arange(len(search)) - np.repeat(starts, np.diff(np.r_[starts, len(search)]))
        self.search, self.score, self.id = (x[place < self.k] for x in (search, score, ids))
        full = place == self.k - 1
        self.least[search[full]] = score[full]


class Block:
    """Candidates of one block and, for the cluster at hand, the order of their bounds."""

    def __init__(self, rows, ids, labels, vectors, centres: np.ndarray, widest: np.ndarray):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.centres, self.widest, self.cluster = centres, widest, -1

    def sort_for(self, cluster: int) -> None:
        if cluster == self.cluster:
            return
        # a little more than the angles say, for what rounding takes
        gap = np.maximum(0, angles(self.vectors, self.centres[cluster]) - self.widest[cluster] - 1e-6)
        bound = self.norms * np.cos(np.minimum(gap, np.pi))
        order = np.argsort(-bound, kind="stable")
        self.bound, self.cluster = bound[order] * (1 + np.sign(bound[order]) * 1e-9) + 1e-6, cluster
        self.rows, self.ids, self.labels = self.rows[order], self.ids[order], self.labels[order]
        self.vectors, self.norms = self.vectors[order], self.norms[order]

    def walk(self, vectors: np.ndarray, wanted, done) -> None:
        """Members go along the list step by step; ``wanted`` takes scores in, ``done`` tells who may stop below a bound."""
        norms = np.linalg.norm(vectors, axis=1)
        going = np.arange(len(vectors))
        for start in range(0, len(self.ids), STEP):
            going = going[~done(going, norms[going] * self.bound[start])]
            if not len(going):
                return
            wanted(going, slice(start, start + STEP), products(vectors[going], self.vectors[start : start + STEP]))


def first_positives(block: Block, rows, labels, vectors, k: int) -> Best:
    """The first ``k`` other vectors with the anchor's label."""
    best = Best(len(rows), k, float if small(vectors, block.vectors) else object)

    def wanted(going, at, scores):
        fits = (labels[going, None] == block.labels[at]) & (rows[going, None] != block.rows[at])
        fits &= scores >= best.least[going, None]
        who, which = np.nonzero(fits)
        best.add(going[who], scores[who, which], block.ids[at][which])

    block.walk(vectors, wanted, lambda going, bound: bound < best.least[going])
    return best


def first_negatives(block: Block, labels, vectors, positives: list[list[int]], most: int, k: int, low: int, high: int) -> Best:
    """For each anchor and each of its at most ``most`` positives' scores, the first ``k`` vectors of other labels between the shares."""
    n = len(positives)
    kind = float if small(vectors, block.vectors) else object
    best = Best(n * most, k, kind)
    share, has = np.zeros((n, most), kind), np.zeros((n, most), bool)
    for i, given in enumerate(positives):
        share[i, : len(given)], has[i, : len(given)] = given, True
    has &= (low * share <= high * share).astype(bool)

    def wanted(going, at, scores):
        scaled = 100 * scores
        other = labels[going, None] != block.labels[at]
        # one look for all positives; what passes is little
        other &= (scaled >= np.where(has, low * share, np.inf).min(1)[going, None]) & (scaled <= np.where(has, high * share, -np.inf).max(1)[going, None])
        who, which = np.nonzero(other)
        for j in range(most):
            p, of = share[going[who], j], scaled[who, which]
            fits = has[going[who], j] & (low * p <= of) & (of <= high * p)
            best.add(going[who[fits]] * most + j, scores[who[fits], which[fits]], block.ids[at][which[fits]])

    def done(going, bound):
        through = np.ones(len(going), bool)
        for j in range(most):
            through &= ~has[going, j] | (100 * bound < low * share[going, j]) | (bound < best.least[going * most + j])
        return through.astype(bool)

    block.walk(vectors, wanted, done)
    return best


def _long(scores: np.ndarray) -> pa.Array:
    return pa.array(scores.astype(np.int64))


def _search(index, width: int, find) -> Iterable:
    """The work of a task: rows come sorted by block, vectors before anchors, anchors by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, widest = shared(index)
        held, at, block, members, cluster = [], None, None, [], None

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal members
            if members:
                block.sort_for(cluster)
                yield find(block, pa.Table.from_batches(members).combine_chunks())
            members = []

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "is_anchor", "cluster")], 1).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                number, is_anchor, of = keys[start].tolist()
                if number != at:
                    yield from finish()
                    held, at, block = [], number, None
                part = batch.slice(start, end - start)
                if not is_anchor:
                    held.append((part.column("row").to_numpy(), part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("x"), width)))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(*[np.concatenate(c) for c in zip(*held, strict=True)], centres, widest)
                    held = []
                if of != cluster:
                    yield from finish()
                    cluster = of
                for k in range(0, part.num_rows, TOGETHER):
                    members.append(part.slice(k, TOGETHER))
                    if sum(m.num_rows for m in members) >= TOGETHER:
                        yield from finish()
        yield from finish()

    return run


def _numbered(spark: SparkSession, vectors: DataFrame, id: str, label: str, vector: str, anchor: Column, scale: int, scratch: Scratch) -> DataFrame:
    """The rows that take part, with whole components and a number of their own."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fit = F.col(f"`{label}`").isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(fit, F.lit(False))).select(
        F.coalesce(F.col(f"`{id}`").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"),
        F.transform(x, lambda v: _floor(v * scale)).alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor")).withColumn("row", F.monotonically_increasing_id())
    return scratch.write(rows, "rows")


def _floor(v: Column) -> Column:
    """The next whole number below, as a double: ``floor`` gives a long, which large numbers do not fit."""
    return F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, *, id: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, clusters: int = 64,
) -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.

    Components are multiplied by ``scale`` and floored, so scores are whole inner products; higher ones come first, ties by the smaller id. An
    anchor's positives are its first ``positives`` other rows of the same label. Negatives have another label and a score
    from ``low`` to ``high`` percent of the positive's; the first ``negatives`` are returned with ``rank`` from 1. The result is
    exact. ``clusters`` bounds the number of shared lists; their centres are fitted on at most ``SAMPLE`` anchors, chosen by
    a hash, and decide about speed alone.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A shorter vector counts as
    ending in zeros. A null id may be found and comes last in ties. Repeated rows are rows of their own: each anchor
    among them has its own results, and the others may be its positives. An anchor without positives, or whose positives leave no
    score between the shares (as a negative score does), gives no row. A score that no long holds counts as the nearest long. An empty table gives an empty table; columns besides the three named ones are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "hard-negatives")
    rows = _numbered(spark, vectors, id, label, vector, anchor, scale, scratch)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    anchors = rows.where("is_anchor")
    sample = anchors.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
    width = max(1, width)
    centres = fit_centres(matrix(sample, width), clusters) if len(sample) else np.zeros((1, width))
    found_centres = share(spark, centres)

    @F.arrow_udf("struct<cluster: int, angle: double>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared(found_centres)
        for batch in batches:
            x = matrix(batch, width)
            own = (x @ known.T).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            angle = np.zeros(len(x))
            for c in np.unique(own):
                angle[own == c] = angles(x[own == c], known[c])
            yield pa.StructArray.from_arrays([pa.array(own), pa.array(angle)], names=["cluster", "angle"])

    anchors = scratch.write(anchors.withColumn("at", place("x")).select("row", "id", "label", "x", "at.cluster", "at.angle"), "anchors")
    widest = np.zeros(len(centres))
    for c, angle in anchors.groupBy("cluster").agg(F.max("angle")).collect():
        widest[c] = angle
    index = share(spark, (centres, widest))

    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n * width // BLOCK_COMPONENTS), min(cores, -(-n // LEAST_BLOCK)))
    pairs = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    candidates = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("is_anchor"),
        F.lit(0).alias("cluster"), "row", "id", "label", "x")

    def against(asked: DataFrame, find, result: str) -> DataFrame:
        asked = asked.drop("angle").select(pairs, F.lit(True).alias("is_anchor"), "*")
        both = candidates.unionByName(asked, allowMissingColumns=True)
        dealt = both.repartitionByRange(blocks, "block").sortWithinPartitions("block", "is_anchor", "cluster")
        return dealt.mapInArrow(_search(index, width, find), result)

    def positives_of(block: Block, asked: pa.Table) -> pa.RecordBatch:
        own = asked["row"].to_numpy()
        best = first_positives(block, own, asked["label"].to_numpy(), matrix(asked["x"].combine_chunks(), width), positives)
        return pa.RecordBatch.from_arrays([pa.array(own[best.search]), pa.array(best.id), _long(best.score)], names=["row", "other", "score"])

    def negatives_of(block: Block, asked: pa.Table) -> pa.RecordBatch:
        own = asked["row"].to_numpy()
        best = first_negatives(block, asked["label"].to_numpy(), matrix(asked["x"].combine_chunks(), width),
                               asked["scores"].to_pylist(), positives, negatives, low, high)
        return pa.RecordBatch.from_arrays(
            [pa.array(own[best.search // positives]), pa.array((best.search % positives).astype(np.int32)), pa.array(best.id), _long(best.score)],
            names=["row", "nth", "other", "score"])

    def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = ranked(against(anchors, positives_of, "row bigint, other bigint, score bigint"), ["row"], positives)
    first = scratch.write(first.withColumn("nth", F.col("rank") - 1).select("row", "nth", "other", "score"), "positives")
    listed = first.groupBy("row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda p: p["score"]).alias("scores"))
    second = against(anchors.join(listed, "row"), negatives_of, "row bigint, nth int, other bigint, score bigint")
    second = ranked(second, ["row", "nth"], negatives)
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (
        second.select("row", "nth", "rank", F.col("other").alias("negative"), F.col("score").alias("negative_score"))
        .join(first.select("row", "nth", F.col("other").alias("positive"), F.col("score").alias("positive_score")), ["row", "nth"])
        .join(anchors.select("row", "id"), "row")
        .select(shown("id").alias("anchor_id"), shown("positive").alias("positive_id"), "rank",
                shown("negative").alias("negative_id"), "positive_score", "negative_score"))
