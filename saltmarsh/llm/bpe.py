"""Byte-level BPE by a tokenization automaton.

The automaton reads token sequences and accepts exactly the right ones. It starts as one state with a loop for each
byte. Each merge (u, v) -> w, in rank order, adds a gadget: the u-arcs are led to a state of their own that
lacks the v-arc, and a w-arc goes from where the u-arc came from to where the v-arc went. Two things keep the
table small. All arcs of a token lead to one state, so a state is split only when its tokens stop behaving
alike; and tokens that are allowed after the same states share a column. Both are split copy-on-write.

A word is encoded by following arcs from the start state until they spell it. Every prefix of a word has exactly one accepted
tokenization, so a place in the word is reached in one way only. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import as_bytes, batch_column, free_name, share, shared

#: White space as the tokenizer's pattern language has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Words that a task remembers; when there are more it starts afresh.
REMEMBERED_WORDS = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@dataclass
class Automaton:
    """``state[t]`` is where t-arcs lead (-1: t is never reached), ``column[t]`` its column in ``allowed`` (bits)."""

    labels: list[bytes]
    state: np.ndarray
    column: np.ndarray
    allowed: np.ndarray
    special: dict[str, int]


def load_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges in rank order, and special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}


def compile_automaton(vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> Automaton:
    """Build the automaton by one gadget per merge. The table depends on the vocabulary alone.

    The merges must come in an order in which both parts of a merge exist before it, as they do in trained
    vocabularies; then merging by rank and merging rule by rule give the same tokens.
    """
    alphabet = byte_alphabet()
    size = 1 + max([*vocab.values(), *special.values()])
    labels = [b""] * size
    for token, i in vocab.items():
        labels[i] = bytes(alphabet[c] for c in token)
    for text, i in special.items():
        labels[i] = text.encode()

    state, column = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    for token, i in vocab.items():
        if len(token) == 1:
            state[i] = column[i] = 0
    # the start state counts as a member of state 0, so that it is never narrowed
    in_state, in_column = Counter({0: 1 + int((state == 0).sum())}), Counter({0: int((column == 0).sum())})
    allowed = np.zeros((256, 32), np.uint8)
    allowed[0, 0] = 1
    states = columns = 1

    for left, right in merges:
        u, v, w = vocab[left], vocab[right], vocab[left + right]
        if state[u] < 0 or state[v] < 0:
            continue
        if not allowed[state[u], column[v] >> 3] >> (column[v] & 7) & 1:
            continue
        if states == len(allowed):
            allowed = np.vstack([allowed, np.zeros_like(allowed)])
        if columns == 8 * allowed.shape[1]:
            allowed = np.hstack([allowed, np.zeros_like(allowed)])
        # the bypass: w leads where v led before u lost its v-arc
        state[w] = state[v]
        in_state[int(state[v])] += 1
        if in_state[int(state[u])] > 1:
            allowed[states] = allowed[state[u]]
            in_state[int(state[u])] -= 1
            state[u], in_state[states], states = states, 1, states + 1
        if in_column[int(column[v])] > 1:
            bit = allowed[:states, column[v] >> 3] >> np.uint8(column[v] & 7) & 1
            allowed[:states, columns >> 3] |= bit << np.uint8(columns & 7)
            in_column[int(column[v])] -= 1
            column[v], in_column[columns], columns = columns, 1, columns + 1
        allowed[state[u], column[v] >> 3] &= np.uint8(255 ^ (1 << (column[v] & 7)))
        # w may follow whatever u may follow
        column[w] = column[u]
        in_column[int(column[u])] += 1
    return Automaton(labels, state, column, np.ascontiguousarray(allowed[:states, : (columns + 7) // 8]), special)


class Encoder:
    """Table-driven encoding of pre-split words."""

    def __init__(self, automaton: Automaton):
        self.labels = automaton.labels
        self.rows = [row.tobytes() for row in automaton.allowed]
        special = set(automaton.special.values())
        # every prefix of a token, with the token's arc where it is one: (token, state, byte of the row, bit)
        self.arcs: dict[bytes, tuple[int, int, int, int] | None] = {}
        state, column = automaton.state.tolist(), automaton.column.tolist()
        for t, label in enumerate(self.labels):
            if t in special or state[t] < 0:
                continue
            for end in range(1, len(label)):
                self.arcs.setdefault(label[:end], None)
            self.arcs[label] = (t, state[t], column[t] >> 3, 1 << (column[t] & 7))
        self.words: dict[str, bytes] = {}

    def tokens(self, word: bytes) -> list[int]:
        """The tokens of one word; the empty word has none.

        Takes the longest allowed arc and steps back where that leads nowhere. A place is left for good at most once, as
        the way to it is the only one, so the work stays in proportion to the word's length.
        """
        arcs, rows, n = self.arcs, self.rows, len(word)
        whole = arcs.get(word)
        if whole:
            return [whole[0]]
        if not n:
            return []
        path, dead = [], set()
        ways, places = [], []
        at, row = 0, rows[0]
        while True:
            # allowed arcs from here, the longest last
            found = []
            for end in range(at + 1, n + 1):
                arc = arcs.get(word[at:end], 0)
                if arc:
                    if row[arc[2]] & arc[3]:
                        found.append((end, arc))
                elif arc == 0:
                    break
            ways.append(found)
            places.append(at)
            while True:
                if not ways[-1]:
                    ways.pop()
                    dead.add(places.pop())
                    path.pop()
                    continue
                at, arc = ways[-1].pop()
                if at not in dead:
                    break
            path.append(arc[0])
            if at == n:
                return path
            row = rows[arc[1]]

    def encode_words(self, words: list[str]) -> bytes:
        """The tokens of words one after another, as little-endian unsigned 32-bit integers."""
        known = self.words
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED_WORDS:
                    known.clear()
                ids = np.array(self.tokens(word.encode()), "<u4").tobytes()
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a token sequence; bytes that are no UTF-8 become U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _worker(automaton, digests_only: bool):
    def start():
        tables = shared(automaton)
        encoder, special = Encoder(tables), tables.special
        split = regex.compile(SPLIT).findall
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split \
            if special else lambda text: [text]

        def encode(text: str) -> bytes:
            parts = []
            for part in cut(text) if special else [text]:
                if part in special:
                    parts.append(np.array([special[part]], "<u4").tobytes())
                else:
                    parts.append(encoder.encode_words(split(part)))
            return b"".join(parts)

        def work(values):
            counts, ids, decoded = [], [], []
            for value in values:
                packed = encode((value or b"").decode("utf-8", "replace"))
                numbers = np.frombuffer(packed, "<u4")
                text = encoder.decode(numbers)
                counts.append(len(numbers))
                if digests_only:
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    ids.append(numbers.astype(np.int32))
                    decoded.append(text)
            return counts, ids, decoded

        return work

    return start


def bpe_round_trip(
    docs: DataFrame, vocabulary: str, *, text: str = "text", digests_only: bool = False,
) -> DataFrame:
    """Encode and decode every whole text; adds columns ``n_tokens``, ``ids`` and ``decoded``.

    ``vocabulary`` is the path of a tokenizer file with a byte-level BPE model, read on the driver. With
    ``digests_only`` the last two hold SHA-256 digests (of the ids as little-endian unsigned 32-bit integers, and of
    the decoded text in UTF-8) instead of the array and the text.

    A null or empty text has no tokens and decodes to the empty text. The tokenizer's special strings inside a text
    become their special token, as the library does by default. Rows are worked on one by one: ties,
    repeated rows and null ids change nothing, and an empty table gives an empty table. Columns of ``docs`` that have one
    of the new names are replaced. A word's cost grows in proportion to its length.
    """
    spark = docs.sparkSession
    automaton = share(spark, compile_automaton(*load_vocabulary(vocabulary)))
    kind = pa.string() if digests_only else pa.list_(pa.int32())
    run = batch_column(spark, _worker(automaton, digests_only),
                       {"n_tokens": pa.int64(), "ids": kind, "decoded": pa.string()})
    made = free_name(docs, "made")
    out = docs.withColumn(made, run(as_bytes(text)))
    return out.withColumns({c: F.col(f"{made}.{c}") for c in ("n_tokens", "ids", "decoded")}).drop(made)
