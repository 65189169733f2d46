"""Token counts by rank-synchronous merging of ragged symbol arrays.

The distinct new words of a batch lie in one flat array of symbols with an array of sequence numbers beside it. In each round
every sequence finds its lowest-ranked adjacent pair and merges all its places at once; sequences without a pair
leave the array. What survives is counted.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.bpe import SPACE, byte_alphabet
from saltmarsh.llm.common import as_bytes, batch_column, free_name, share, shared

#: Words that a task remembers; when there are more it starts afresh.
REMEMBERED_WORDS = 400_000
#: A word of more letters is merged on its own, so that the short ones do not wait for it.
LONG_WORD = 200
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


@dataclass
class Merges:
    """``first`` and ``last`` give the symbol of a byte inside a word and at its end; ``pairs`` is sorted."""

    first: np.ndarray
    last: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    special: list[str]
    size: int


def load_merges(path: str) -> Merges:
    """The merge table of a tokenizer file whose words end in a suffix."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    end = model["end_of_word_suffix"] or ""
    first, last = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for c, b in byte_alphabet().items():
        first[b], last[b] = vocab[c], vocab[c + end]
    size = 1 + max(vocab.values())
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    order = np.argsort(pairs)
    # a symbol is below the size, so that left * size + right names a pair
    return Merges(first, last, pairs[order], order, made[order], [t["content"] for t in spec["added_tokens"]], size)


class TokenCounter:
    """Counts the tokens of words."""

    def __init__(self, merges: Merges):
        self.m = merges

    def pair_index(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, or -1."""
        keys = left * self.m.size + right
        at = np.searchsorted(self.m.pairs, keys)
        at[at == len(self.m.pairs)] = 0
        return np.where(self.m.pairs[at] == keys, at, -1) if len(self.m.pairs) else np.full(len(keys), -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty word."""
        lengths = np.array([len(w) for w in words], np.int64)
        counts = lengths.copy()
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbols = self.m.first[data]
        symbols[ends] = self.m.last[data[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        far = np.iinfo(np.int64).max
        while len(symbols) > 1:
            inside = owner[:-1] == owner[1:]
            at = self.pair_index(symbols[:-1], symbols[1:])
            at[~inside] = -1
            rank = np.where(at >= 0, self.m.ranks[at], far)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            # the last symbol of a sequence begins no pair; a far rank stands there
            best = np.minimum.reduceat(np.append(rank, far), starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            best_here = np.repeat(best, sizes)
            merge = np.append(rank == best_here[:-1], False) & (best_here != far)
            # of overlapping places (a run of one symbol) every second one merges, from the left
            run_start = merge & ~np.r_[False, merge[:-1]]
            index = np.arange(len(merge))
            since = index - np.maximum.accumulate(np.where(run_start, index, 0))
            merge &= since % 2 == 0
            symbols[merge] = self.m.made[at[merge[:-1]]]
            gone = np.r_[False, merge[:-1]]
            np.subtract.at(counts, owner[gone], 1)
            keep = ~gone & (best_here != far)
            symbols, owner = symbols[keep], owner[keep]
        return counts


    def count_long(self, word: bytes) -> int:
        """Tokens of one long word: the same rounds, each over the places of its rank alone.

        A merge makes pairs of higher ranks only, so ranks are taken in order; places wait in a bucket per rank.
        """
        data = np.frombuffer(word, np.uint8)
        n = len(data)
        symbols = self.m.first[data]
        symbols[-1] = self.m.last[data[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def await_merge(places: np.ndarray) -> None:
            """Put pairs that begin at the places into the buckets of their ranks."""
            places = places[after[places] < n]
            at = self.pair_index(symbols[places], symbols[after[places]])
            places, rank = places[at >= 0], self.m.ranks[at[at >= 0]]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, part in zip(rank[starts].tolist() if len(rank) else [], np.split(places, starts[1:]), strict=False):
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(part)

        await_merge(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[alive[places] & (after[places] < n)]
            at = self.pair_index(symbols[places], symbols[after[places]])
            right = np.zeros(len(places), bool)
            right[at >= 0] = self.m.ranks[at[at >= 0]] == r
            places, at = places[right], at[right]
            if not len(places):
                continue
            # of overlapping places every second one merges, from the left
            joined = np.r_[False, after[places[:-1]] == places[1:]]
            index = np.arange(len(places))
            since = index - np.maximum.accumulate(np.where(~joined, index, 0))
            places, at = places[since % 2 == 0], at[since % 2 == 0]
            gone = after[places]
            symbols[places] = self.m.made[at]
            alive[gone] = False
            after[places] = after[gone]
            follows = after[places] < n
            before[after[places[follows]]] = places[follows]
            left = before[places]
            await_merge(np.unique(np.concatenate([left[left >= 0], places])))
        return int(alive.sum())


def _worker(merges):
    def start():
        tables = shared(merges)
        counter, special = TokenCounter(tables), tables.special
        words_of = regex.compile(WORD).findall
        cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))).split
        known: dict[str, int] = {}

        def work(values):
            nonlocal known
            texts = []
            for value in values:
                parts = cut((value or b"").decode("utf-8", "replace")) if special else [(value or b"").decode("utf-8", "replace")]
                words = []
                for part in parts:
                    # lower case letter by letter: a sigma at a word's end gets no form of its own
                    words += words_of(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
                texts.append((words, len(parts) - 1))
            if len(known) >= REMEMBERED_WORDS:
                known = {}
            new = list({w for words, _ in texts for w in words if w not in known})
            short = [w for w in new if len(w) <= LONG_WORD]
            fresh = dict(zip(short, counter.count([w.encode() for w in short]).tolist(), strict=True)) if short else {}
            fresh |= {w: counter.count_long(w.encode()) for w in new if len(w) > LONG_WORD}
            known |= fresh
            counts = [sum(map(known.__getitem__, words)) + extra for words, extra in texts]
            return [len(v or b"") for v in values], counts

        return work

    return start


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", limit: int = 2048) -> DataFrame:
    """Count bytes and tokens of every whole text; adds ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of a tokenizer file whose BPE model marks word ends, read on the driver; ``over_limit`` is
    true if there are more than ``limit`` tokens. Special strings inside a text count as one token.

    A null or empty text has no bytes and no tokens. Rows are worked on one by one: ties, repeated rows and null ids change
    nothing, and an empty table gives an empty table. Columns of ``docs`` that have one of the new names are replaced.
    """
    spark = docs.sparkSession
    merges = share(spark, load_merges(vocabulary))
    run = batch_column(spark, _worker(merges), {"n_bytes": pa.int64(), "n_tokens": pa.int64()})
    made = free_name(docs, "made")
    return docs.withColumn(made, run(as_bytes(text))).withColumns({
        "n_bytes": F.col(f"{made}.n_bytes"), "n_tokens": F.col(f"{made}.n_tokens"),
        "over_limit": F.col(f"{made}.n_tokens") > limit,
    }).drop(made)
