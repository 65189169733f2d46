"""Language identification by nearest centroids of TF-IDF vectors.

Byte trigrams of the lower-cased letters are hashed into ``SIZE`` places; values are damped counts times inverse
document frequencies over all training documents, normalised. Each language has several centroids, found by spherical
k-means on a bounded sample. A text gets the language of the centroid with the largest cosine; it counts as rejected if that
cosine is below what nearly all training texts of the language reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import Scratch, as_bytes, batch_column, bounded_batches, share, shared
from saltmarsh.llm.samples import fold
from saltmarsh.operators.skew import split_join

SIZE = 1 << 14
CENTROIDS = 4
ROUNDS = 8
#: Documents of one language that its centroids are fitted on, about (a share of all, drawn by a hash of the id).
SAMPLE = 1_200
#: Languages whose centroids are held at once, about; more are compared shard by shard.
LANGUAGES = 64
#: Languages whose sizes are broadcast at most.
BROADCAST_LANGUAGES = 100_000
#: Share of a language's sample that lies below its rejection bound.
REJECTED = 0.005
UNKNOWN = "und"

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))
_ASCII_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def has_letter(text: bytes | None) -> bool:
    """Whether a text has a letter of any script."""
    if not text:
        return False
    if len(text.translate(None, _ASCII_LETTERS)) < len(text):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "ignore")))


def gram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the trigrams that occur, and how often."""
    letters = b" " + b" ".join((text or b"").translate(_LETTERS).split()) + b" "
    data = np.frombuffer(letters, np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    place = code * np.uint32(2654435761) >> np.uint32(32 - SIZE.bit_length() + 1)
    counts = np.bincount(place, minlength=SIZE)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[found]
    length = np.sqrt((values * values).sum())
    return values / length if length > 0 else values


def cluster(vectors: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Normalised centroids by spherical k-means; the start is spread out from the mean, so the result is repeatable."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    nearest = vectors @ vectors[chosen[0]]
    for _ in range(min(k, len(vectors)) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen].copy()
    for _ in range(ROUNDS):
        label = (vectors @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (label == c).any():
                centroids[c] = vectors[label == c].sum(axis=0)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def _frequencies(batches):
    total, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found, _ = gram_counts(text)
            total[found] += 1
            n += 1
    places = np.append(np.flatnonzero(total), -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int32()), pa.array(np.append(total[places[:-1]], n), pa.int64())], names=["place", "n"])


def frequencies(rows: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows."""
    counts = rows.select("text").mapInArrow(_frequencies, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    seen = {r.place: r.n for r in counts.collect()}
    n = seen.pop(-1, 0)
    idf = np.full(SIZE, np.log1p(n) + 1, np.float32)
    for place, count in seen.items():
        idf[place] = np.log((1 + n) / (1 + count)) + 1
    return idf


def training_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows with a language outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    return (docs.where(F.col(lang).isNotNull() & F.coalesce(fold(doc_id, 4) != 2, F.lit(True)))
            .select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), as_bytes(text).alias("text")))


def drawn_rows(rows: DataFrame, languages: int, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` rows of each of the ``languages``, drawn by a hash; copies of a row count once."""
    parts = 1_000_000
    sizes = rows.groupBy("lang").agg(F.least(F.lit(parts), F.ceil(F.lit(parts * sample) / F.count("*"))).alias("share"))
    # the text takes part, so that rows without an id are drawn one by one
    shares = rows.join(F.broadcast(sizes), "lang") if languages <= BROADCAST_LANGUAGES else split_join(rows, sizes, ["lang"])
    return (shares.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < F.col("share"))
            .select("lang", "text").dropDuplicates())


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> list[dict]:
    """One model per shard of languages: inverse document frequencies (of all training rows), centroids with their languages, and
    rejection bounds. All languages are learned, however many there are; a shard holds about ``LANGUAGES`` of them."""
    rows = training_rows(docs, doc_id=doc_id, text=text, lang=lang)
    idf = frequencies(rows)
    languages = rows.select("lang").distinct().count()
    drawn = drawn_rows(rows, languages, sample)
    shards = max(1, -(-languages // LANGUAGES))
    if shards == 1:
        return [_fit(drawn, idf)]
    of = F.pmod(F.xxhash64("lang"), F.lit(shards))
    return [_fit(drawn.where(of == k), idf) for k in range(shards)]


def _fit(drawn: DataFrame, idf: np.ndarray) -> dict:
    spark = drawn.sparkSession
    weights = share(spark, idf)

    def fit_language(frame):
        import pandas as pd

        idf = shared(weights)
        vectors = np.zeros((len(frame), SIZE), np.float32)
        for i, value in enumerate(frame["text"]):
            found, counts = gram_counts(value)
            vectors[i, found] = _vector(found, counts, idf)
        centroids = cluster(vectors)
        bound = float(np.quantile((vectors @ centroids.T).max(axis=1), REJECTED))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "bound": bound,
                             "centroid": [c.astype("<f4").tobytes() for c in centroids]})

    fitted = drawn.groupBy("lang").applyInPandas(fit_language, "lang string, bound double, centroid binary").collect()
    fitted.sort(key=lambda r: (r.lang, bytes(r.centroid)))
    return {"idf": idf, "langs": [r.lang for r in fitted], "bounds": np.array([r.bound for r in fitted]),
            "centroids": np.array([np.frombuffer(bytes(r.centroid), "<f4") for r in fitted]).reshape(-1, SIZE)}


def _worker(handle):
    def start():
        model = shared(handle)
        idf, langs, bounds = model["idf"], model["langs"], model["bounds"]
        by_place = np.ascontiguousarray(model["centroids"].T)

        def work(values):
            names, scores, rejected = [], [], []
            for value in values:
                if not langs or not has_letter(value):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                found, counts = gram_counts(value)
                cosine = _vector(found, counts, idf) @ by_place[found]
                best = int(cosine.argmax())
                names.append(langs[best])
                scores.append(float(np.clip(cosine[best], 0, 1)))
                rejected.append(bool(cosine[best] < bounds[best]))
            return names, scores, rejected

        return work

    return start


def identify_languages(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (the cosine) and rejected.

    A null text and one without a letter of any script is ``und`` with score 0, as is every text if no row has a language. A row
    without an id is not held out. Of equal cosines the language first by name is taken. Repeated rows are predicted alike; an
    empty table gives an empty table. With more than ``LANGUAGES`` languages the texts are compared with one shard of centroids
    after another and written between, so a task never holds more than one shard.
    """
    spark = docs.sparkSession
    models = train(docs, doc_id=doc_id, text=text, lang=lang, sample=sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("text"))
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
    scratch = None
    for k, model in enumerate(models):
        run = batch_column(spark, _worker(share(spark, model)), kinds)
        made = rows.withColumn("made", run(F.col("text")))
        if k:
            # the same order as within a shard: larger cosine, then smaller name; a shard without a language for the text is last
            order = lambda c: F.struct((F.col(f"{c}.lang_pred") != UNKNOWN).alias("known"), F.col(f"{c}.score").alias("score"))
            tie = (order("made") == order("best")) & (F.col("made.lang_pred") < F.col("best.lang_pred"))
            made = made.withColumn("best", F.when((order("made") > order("best")) | tie, F.col("made")).otherwise(F.col("best"))).drop("made")
        else:
            made = made.withColumnRenamed("made", "best")
        if k < len(models) - 1:
            scratch = scratch or Scratch(spark, "language-id")
            made = scratch.write(made, f"shard{k}")
        rows = made
    return rows.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "best.*")
