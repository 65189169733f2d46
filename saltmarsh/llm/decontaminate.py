"""Benchmark decontamination: an FM-index per shard of training text, searched for all benchmark phrases.

A shard is the texts of one Arrow batch, about 8 MB or one longer text. Its sequence is the words that
occur in the phrases; a stretch of other words, which no phrase can cover, is one separator, and stretches too short for the
shortest phrase are left out, which loses no occurrence. Phrases are found by backward search through
wavelet-tree ranks, places come from sampled suffix positions, and overlapping places merge into removal spans.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import LOWER_WORDS, as_bytes, batch_column, free_name, share, shared
from saltmarsh.llm.fm_index import FMIndex

#: Bytes of benchmark text that are broadcast at once; a longer benchmark is searched for in several blocks.
BLOCK_BYTES = 16 << 20

FOUND = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()),
         "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}


@dataclass
class Phrases:
    """Distinct windows of the items. Symbol 0 ends a sequence, 1 separates, words follow."""

    symbols: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[str]
    first_item: np.ndarray
    item_of: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.lengths.min(initial=1 << 30))


def phrases_of(items: list[tuple[str, bytes | None]], window: int) -> Phrases:
    """Windows of ``window`` consecutive words; an item of fewer words is one window, one without words none."""
    symbols: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[int]] = {}
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    for name, text in items:
        ids = [symbols.setdefault(w, len(symbols) + 2) for w in (text or b"").translate(LOWER_WORDS).split()]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            windows.setdefault(tuple(ids[i : i + window]), set()).add(number[name])
    rows = np.zeros((len(windows), window), np.int64)
    lengths = np.zeros(len(windows), np.int64)
    for k, words in enumerate(windows):
        rows[k, window - len(words) :] = words
        lengths[k] = len(words)
    sizes = [len(s) for s in windows.values()]
    return Phrases(symbols, rows, lengths, names, np.r_[0, np.cumsum(sizes, dtype=np.int64)],
                   np.array([i for s in windows.values() for i in sorted(s)], np.int64))


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[list, list, list, list, list]:
    """Columns of ``FOUND`` for the texts of one shard; spans are word numbers, the end not included."""
    get = phrases.symbols.get
    parts, counts = [], []
    for text in texts:
        words = (text or b"").translate(LOWER_WORDS).split()
        counts.append(len(words))
        parts += [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), [0]]
    n = len(texts)
    flat = np.concatenate([np.array(p, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    first = np.cumsum(np.array(counts, np.int64) + 1) - np.array(counts, np.int64) - 1

    # stretches of phrase words, each followed by a separator
    inside = flat > 0
    edges = np.diff(np.r_[0, inside.astype(np.int8), 0])
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    hits, starts, ends = [0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    if not len(begin):
        return counts, hits, items, starts, ends
    sizes = end - begin + 1
    origin = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    sequence = np.where(origin < np.repeat(end, sizes), flat[np.minimum(origin, len(flat) - 1)], 1)
    index = FMIndex(sequence, len(phrases.symbols) + 2)
    phrase, place = index.locate(*index.search(phrases.rows, phrases.lengths))
    if not len(phrase):
        return counts, hits, items, starts, ends

    at = origin[place]
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, at, 1)
    np.subtract.at(change, at + phrases.lengths[phrase], 1)
    covered = np.cumsum(change[:-1]) > 0
    edges = np.diff(np.r_[0, covered.astype(np.int8), 0])
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        d = int(np.searchsorted(first, a, side="right")) - 1
        starts[d].append(a - int(first[d]))
        ends[d].append(b - int(first[d]))
        hits[d] += b - a
    doc = np.searchsorted(first, at, side="right") - 1
    pairs = np.unique(doc * len(phrases.lengths) + phrase)
    for key in pairs.tolist():
        d, p = divmod(key, len(phrases.lengths))
        items[d] += phrases.item_of[phrases.first_item[p] : phrases.first_item[p + 1]].tolist()
    items = [[phrases.items[i] for i in sorted(set(x))] for x in items]
    return counts, hits, items, starts, ends


def _worker(block):
    def start():
        phrases = shared(block)
        return lambda values: search_shard(values, phrases)

    return start


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> list:
    """The benchmark's phrases, broadcast in blocks of a bounded number of bytes."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"),
                             as_bytes(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    spark = benchmark.sparkSession
    return [share(spark, phrases_of(
        [(r.name, None if r.text is None else bytes(r.text))
         for r in items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k).select("name", "text").toLocalIterator()],
        window)) for k in range(n)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 13, name: str = "found",
) -> DataFrame:
    """Add a struct column ``name`` (replaced if there): n_words, n_hit, items, starts, ends, contaminated.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. A document word inside any occurrence of a
    benchmark window is hit; starts and ends are merged spans of hit words; items are the ids, as sorted strings, of the items
    with an occurring window. A document is contaminated if at least one word in twenty is hit.

    A null or empty text has no words and is not contaminated; an item without words has no window; a null item id
    counts as the empty string. Rows are worked on one by one, so repeated rows and ties change nothing. An empty
    benchmark hits nothing and an empty table gives an empty table.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_id, item_text, window)
    out = docs.drop(name)
    if len(blocks) == 1:
        out = out.withColumn(name, batch_column(spark, _worker(blocks[0]), FOUND)(as_bytes(text)))
    else:
        out = _search_in_blocks(out, blocks, text, name)
    hit, words = F.col(f"{name}.n_hit"), F.col(f"{name}.n_words")
    return out.withColumn(name, F.col(name).withField("contaminated", (hit > 0) & (20 * hit >= words)))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 13,
) -> DataFrame:
    """``docs`` without contaminated documents, with the same columns."""
    found = free_name(docs, "found")
    marked = find_contamination(
        docs, benchmark, text=text, item_id=item_id, item_text=item_text, window=window, name=found)
    return marked.where(~F.col(f"{found}.contaminated")).drop(found)


def _search_in_blocks(docs: DataFrame, blocks: list, text: str, name: str) -> DataFrame:
    """One pass over the texts per block; the spans of a text then meet by the text's digest."""
    spark, key = docs.sparkSession, free_name(docs, "text_key")
    docs = docs.withColumn(key, F.coalesce(F.sha2(as_bytes(text), 256), F.lit("")))
    passes = []
    for block in blocks:
        found = batch_column(spark, _worker(block), FOUND)(as_bytes(text))
        passes.append(docs.select(key, text).dropDuplicates([key]).select(key, found.alias("f")).select(key, "f.*"))
    every = passes[0]
    for more in passes[1:]:
        every = every.unionAll(more)
    words = F.array_distinct(F.flatten(F.transform(
        F.flatten("spans"), lambda s: F.sequence(s["starts"], s["ends"] - 1))))
    merged = (
        every.withColumn("spans", F.arrays_zip("starts", "ends"))
        .groupBy(key)
        .agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .withColumn("words", F.array_sort(words))
        .withColumn("next", F.transform("words", lambda w: w + 1))
        .withColumn("starts", F.array_except("words", "next"))
        .withColumn("ends", F.array_except("next", "words"))
        .select(key, F.struct("n_words", F.size("words").cast("long").alias("n_hit"), "items", "starts", "ends").alias(name)))
    return docs.join(merged, key).drop(key)


def cut_spans(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    plain = np.frombuffer(text.translate(LOWER_WORDS), np.uint8) != 0x20
    edges = np.diff(np.r_[0, plain.astype(np.int8), 0])
    word_begin, word_end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[at : word_begin[a]])
        at = word_end[b - 1]
    return b"".join([*out, text[at:]])
