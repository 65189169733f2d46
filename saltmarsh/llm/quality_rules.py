"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

The trees are grown on binned features in one task over a bounded sample and flattened into arrays of nodes; a batch of
documents walks all trees level by level with numpy. A feature with a constraint can only move the score one way:
splits against it are refused, and the bounds of a subtree's values keep the trees monotonic as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import as_bytes, batch_column, share, shared
from saltmarsh.llm.samples import fit, labelled_sample

#: Labelled documents that the trees are grown on at most.
SAMPLE = 12_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY = 40, 3, 0.3, 64, 20, 1.0
WINDOW = 8

#: Features and the way in which a larger value may move the score (0: both ways).
FEATURES = {
    "words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "same_word_share": -1,
    "upper_share": -1, "digit_share": 0, "punctuation_per_word": -1, "distinct_share": 0, "bare_token_share": -1,
    "exclamation_per_word": -1,
}

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_PLAIN = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PUNCTUATION = bytes(sorted(_PLAIN))
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _count(text: bytes, wanted: bytes) -> int:
    return len(text) - len(text.translate(None, wanted))


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(n - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        total += mixed[j : n - WINDOW + 1 + j] * _MULTIPLIERS[j]
    ordered = np.sort(total)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # equal sums may be chance: number the windows by their words, in three doublings
    width = 1
    while width < WINDOW:
        _, ids = np.unique(ids[:-width] * (n + 1) + ids[width:], return_inverse=True)
        width *= 2
    at = np.flatnonzero(np.bincount(ids)[ids] > 1)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.subtract.at(change, at + WINDOW, 1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """Counts (words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the values of ``FEATURES``."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _CONTINUED)) - _count(text, _SPACE)
    symbols = _count(text, _SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_window_words(words)
    per_word, per_char = max(1, n), max(1, chars)
    same = sum(map(bytes.__eq__, words, words[1:]))
    bare = sum(not w.translate(None, _PUNCTUATION) for w in words)
    values = [n, chars / per_word, symbols / per_char, dup_lines / max(1, len(lines)), repeated / per_word, same / per_word,
              _count(text, _UPPER) / per_char, _count(text, _DIGITS) / per_char, _count(text, _PUNCTUATION) / per_word,
              len(set(words)) / per_word, bare / per_word, text.count(b"!") / per_word]
    return [n, chars, symbols, dup_lines, repeated], values


@dataclass
class Trees:
    """All trees in flat arrays: node k sends a row to ``left[k]`` if its feature is at most the threshold, else to the next one.
    A leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        row = np.arange(len(rows))[:, None]
        for _ in range(DEPTH):
            inner = self.left[at] >= 0
            right = rows[row, self.feature[at]] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(axis=1), -40, 40)))


def grow(rows: np.ndarray, labels: np.ndarray, direction: np.ndarray, trees: int = TREES) -> Trees:
    """Boost trees for the logistic loss; leaves are Newton steps."""
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])] \
        if len(rows) else [np.zeros(0)] * rows.shape[1]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1) \
        if len(rows) else np.zeros((0, len(edges)), np.int64)
    share_of_one = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share_of_one / (1 - share_of_one))) if len(labels) else 0.0
    margin = np.full(len(rows), base)
    roots, feature, threshold, left, value = [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, 0), (threshold, 0.0), (left, -1), (value, 0.0)):
            column.append(empty)
        return len(feature) - 1

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + PENALTY), low, high))

    def split(k: int, members: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> None:
        total_g, total_h = g[members].sum(), h[members].sum()
        value[k] = RATE * leaf_value(total_g, total_h, low, high)
        margin[members] += value[k]
        best = (1e-6, None)
        for f, e in enumerate(edges) if depth < DEPTH and len(members) >= 2 * LEAST_ROWS else ():
            bins = binned[members, f]
            size = len(e) + 1
            gs = np.cumsum(np.bincount(bins, g[members], size))[:-1]
            hs = np.cumsum(np.bincount(bins, h[members], size))[:-1]
            ns = np.cumsum(np.bincount(bins, minlength=size))[:-1]
            a = np.clip(-gs / (hs + PENALTY), low, high)
            b = np.clip(-(total_g - gs) / (total_h - hs + PENALTY), low, high)
            gain = -(gs * a + (hs + PENALTY) * a * a / 2) - ((total_g - gs) * b + (total_h - hs + PENALTY) * b * b / 2)
            own = leaf_value(total_g, total_h, low, high)
            gain += total_g * own + (total_h + PENALTY) * own * own / 2
            legal = (ns >= LEAST_ROWS) & (len(members) - ns >= LEAST_ROWS) & ((b - a) * direction[f] >= 0)
            gain = np.where(legal, gain, -np.inf)
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), (f, i, float(a[i]), float(b[i])))
        if best[1] is None:
            return
        f, i, a, b = best[1]
        margin[members] -= value[k]
        middle = (a + b) / 2
        feature[k], threshold[k] = f, float(edges[f][i])
        lower, upper = node(), node()
        left[k] = lower
        goes_left = binned[members, f] <= i
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        for child, rows_of, (l, u) in zip((lower, upper), (members[goes_left], members[~goes_left]),
                                          bounds[int(direction[f])], strict=True):
            split(child, rows_of, g, h, depth + 1, l, u)

    for _ in range(trees if len(rows) else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(node())
        split(roots[-1], np.arange(len(rows)), p - labels, p * (1 - p), 0, -np.inf, np.inf)
    return Trees(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64),
                 np.array(value), base)


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = SAMPLE,
) -> Trees:
    """Trees grown on at most ``sample`` labelled documents. Without any there is no tree and every score is one half."""
    rows = labelled_sample(docs, labels, doc_id=doc_id, text=text, label=label, size=sample)
    run = batch_column(docs.sparkSession, _statistics_worker, {"values": pa.list_(pa.float64())})
    rows = rows.select("order", "label", run(as_bytes("text")).alias("made")).select("order", "label", "made.values")

    def start():
        xs, ys = [], []

        def take(batch):
            xs.extend(batch.column("values").to_pylist())
            ys.extend(batch.column("label").to_pylist())

        def end():
            x = np.array(xs, float).reshape(-1, len(FEATURES))
            trees = grow(x, (np.array(ys, float) > 0).astype(float), np.array(list(FEATURES.values())))
            return trees.__dict__

        return take, end

    found = fit(rows, start, "order")
    return Trees(**found) if found else grow(np.zeros((0, len(FEATURES))), np.zeros(0), np.array(list(FEATURES.values())))


def _statistics_worker():
    return lambda values: [[statistics(v)[1] for v in values]]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _worker(trees):
    def start():
        model = shared(trees)

        def work(values):
            found = [statistics(v) for v in values]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(_COUNTS))
            return [*counts.T, model.score(np.array([x for _, x in found]).reshape(-1, len(FEATURES)))]

        return work

    return start


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``base_failed`` if there are fewer than 20 words or more than 30 of 100 words stand in repeated windows; ``kept`` if the
    base holds and the trees score one half or more. A null or empty text has no words and fails. Repeated rows are judged alike; an
    empty table gives an empty table, and without labels the base alone decides.
    """
    spark = docs.sparkSession
    trees = share(spark, train(docs, labels, doc_id=doc_id, text=text))
    schema = dict.fromkeys(_COUNTS, pa.int64()) | {"score": pa.float64()}
    made = docs.select(F.col(doc_id).alias("doc_id"), batch_column(spark, _worker(trees), schema)(as_bytes(text)).alias("made"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (made.select("doc_id", "made.*").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5)))
