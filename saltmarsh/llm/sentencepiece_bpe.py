"""SentencePiece-style BPE by a table of each prefix's last token.

The rule that is followed: a text starts as characters, and the neighbours whose joined text is a piece of the best score merge,
leftmost first, until none can. What follows from it: merges inside a token never depend on what lies outside, so

* a sequence of tokens is the encoding of its text exactly if every two neighbours are (pair compatibility), and
* the encoding of a prefix, less its last token, is the encoding of a shorter prefix.

So every prefix has one last token: among the pieces that end there (an automaton finds them all in one pass) the one that is
compatible with the last token of the prefix before it. The ids are read off that table from the end backwards. Characters
without a piece become byte pieces.

Two characters that stand beside each other in no piece are never joined, so a text may be cut there without changing a
token. Where no piece has a space mark behind another character, texts are cut before runs of space marks, and words that
come again are looked up.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import as_bytes, batch_column, free_name, share, shared

SPACE_MARK = "▁"

#: Words that a task remembers: those met since so many new ones, and before that. Longer words are not remembered.
REMEMBERED_WORDS = 150_000
REMEMBERED_LENGTH = 64

#: Pairs of tokens that a task remembers as compatible or not.
REMEMBERED_PAIRS = 1_000_000

#: Numbers of piece kinds and of fields in a model file (fixed values of the public file format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, WHITE_SPACE_AS_SUFFIX = 3, 35, 24
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
BPE_MODEL = 2


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one message of a model file."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            if key & 7 == 2:
                size, at = _number(data, at)
            else:
                size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says, and what follows from it for encoding."""

    pieces: list[str]
    kinds: list[int]
    ranks: dict[str, int]
    dummy_prefix: bool
    byte_ids: list[int]
    ids: dict[str, int] = field(default_factory=dict)
    #: id of a reachable piece -> ids of the two pieces it is merged from; none for single characters
    split: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: reachable pieces whose parts all merge at a better rank than what they make
    ordered: set[int] = field(default_factory=set)
    #: rank at which two pieces merge, by both ids
    pair_rank: dict[int, int] = field(default_factory=dict)
    #: characters that some piece of two or more characters holds
    inner: frozenset[str] = frozenset()
    cut_at_spaces: bool = False


def merge_all(text: str, ranks: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The merges of a short text, done as the rule has it, and the two parts that merged last."""
    parts, last = list(text), None
    while len(parts) > 1:
        best, where = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, where = rank, i
        if best is None:
            break
        last = (parts[where], parts[where + 1])
        parts[where : where + 2] = [last[0] + last[1]]
    return parts, last


def load_model(path: str) -> Model:
    """Read a BPE model file with byte pieces and without a character map, and work out its tables."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(data):
        if number == PIECES:
            piece = dict(_fields(value))
            pieces.append(piece[PIECE_TEXT].decode())
            scores.append(struct.unpack("<f", piece.get(PIECE_SCORE, b"\0\0\0\0"))[0])
            kinds.append(piece.get(PIECE_KIND, NORMAL))
        elif number == TRAINER:
            trainer = dict(_fields(value))
        elif number == NORMALIZER:
            normalizer = dict(_fields(value))
    if trainer.get(MODEL_TYPE) != BPE_MODEL or not trainer.get(BYTE_FALLBACK) or kinds.count(BYTE) != 256:
        raise ValueError(f"{path}: only BPE models with byte pieces are read")
    if normalizer.get(CHARACTER_MAP) or normalizer.get(REMOVE_EXTRA, 1) or not normalizer.get(ESCAPE, 1) \
            or trainer.get(WHITE_SPACE_AS_SUFFIX) or {USER_DEFINED, UNUSED} & set(kinds):
        raise ValueError(f"{path}: character maps, removed white space, suffixed spaces, own and unused pieces are not read")
    order = {score: i for i, score in enumerate(sorted({s for s, k in zip(scores, kinds, strict=True) if k == NORMAL}, reverse=True))}
    ranks = {p: order[s] for p, s, k in zip(pieces, scores, kinds, strict=True) if k == NORMAL}
    byte_ids = [pieces.index(f"<0x{b:02X}>") for b in range(256)]
    return finish(Model(pieces, kinds, ranks, bool(normalizer.get(DUMMY_PREFIX, 1)), byte_ids))


def finish(model: Model) -> Model:
    """The tables that follow from the pieces and their ranks."""
    ids = model.ids = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL}
    several = {r for r, n in zip(*np.unique(list(model.ranks.values()), return_counts=True), strict=True) if n > 1}
    for piece, i in sorted(ids.items(), key=lambda x: len(x[0])):
        parts, last = merge_all(piece, model.ranks)
        if len(parts) > 1:
            continue
        if last is None:
            model.ordered.add(i)
        elif last[0] in ids and last[1] in ids:
            left, right = model.split[i] = ids[last[0]], ids[last[1]]
            rank = model.ranks[piece]
            below = max((model.ranks[model.pieces[p]] for p in (left, right) if p in model.split), default=-1)
            if below < rank and rank not in several and {left, right} <= model.ordered:
                model.ordered.add(i)
        else:
            model.split[i] = (-1, -1)
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            left, right = ids.get(piece[:k]), ids.get(piece[k:])
            if left is not None and right is not None:
                model.pair_rank[left << 32 | right] = model.ranks[piece]
    model.inner = frozenset(chain.from_iterable(p for p in ids if len(p) > 1))
    model.cut_at_spaces = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in ids)
    return model


class Encoder:
    """The prefix table of a word, and ids recovered from it."""

    def __init__(self, model: Model):
        self.model = model
        self.find = ahocorasick.Automaton()
        #: ids of the pieces that are the encoding of their own text
        self.reachable = {p: i for p, i in model.ids.items() if i in model.split or len(p) == 1}
        #: for each of them, the tokens met before it: compatible or not
        self.before: dict[int, dict[int, bool]] = {i: {} for i in self.reachable.values()}
        self.remembered = 0
        for piece, i in self.reachable.items():
            self.find.add_word(piece, (i, len(piece), self.before[i]))
        if self.reachable:
            self.find.make_automaton()
        self.characters = {p for p in self.reachable if len(p) == 1}
        self.sizes = [len(p) for p in model.pieces]
        self.right = {i: self._spine(i, 1) for i in model.ordered}
        self.left = {i: self._spine(i, 0) for i in model.ordered}
        self.words: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+").findall if model.cut_at_spaces else lambda text: [text]

    def _spine(self, i: int, side: int) -> list[tuple[int, int | None]]:
        """The pieces on one edge of a piece from its character up, each with the rank at which the next takes it in."""
        out, above = [], None
        while True:
            out.append((i, above))
            if i not in self.model.split:
                return out[::-1]
            above = self.model.ranks[self.model.pieces[i]]
            i = self.model.split[i][side]

    def _text(self, token: int) -> str:
        return self.model.pieces[token] if token >= 0 else chr(-1 - token)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text of just these two tokens encodes as them. A character without a piece is -1 less its code point."""
        if self.remembered >= REMEMBERED_PAIRS:
            for seen in self.before.values():
                seen.clear()
            self.remembered = 0
        self.remembered += 1
        known = self.before[b][a] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        model = self.model
        if a < 0 and chr(-1 - a) not in model.inner or b < 0 and chr(-1 - b) not in model.inner:
            return True
        if a not in model.ordered or b not in model.ordered:
            return merge_all(self._text(a) + self._text(b), model.ranks)[0] == [self._text(a), self._text(b)]
        # both edges grow towards the tokens; they merge with each other if that comes before either grows
        left, right = self.right[a], self.left[b]
        i = j = 0
        while True:
            (x, grows_x), (y, grows_y) = left[i], right[j]
            rank = model.pair_rank.get(x << 32 | y)
            if rank is not None and (grows_x is None or rank < grows_x) and (grows_y is None or rank <= grows_y):
                return False
            if grows_x is None and grows_y is None:
                return True
            if grows_y is None or grows_x is not None and grows_x <= grows_y:
                i += 1
            else:
                j += 1

    def last_tokens(self, word: str) -> list[int]:
        """For each prefix of the word, its last token (negative: a character without a piece)."""
        last: list[int | None] = [None] * len(word)
        compatible = self.compatible
        if not self.characters.issuperset(word):
            # such a character is the last token of its prefix unless a longer piece turns out to hold it
            pending = [i for i, c in enumerate(word) if c not in self.characters][::-1]
        else:
            pending = []
        for end, (token, size, before) in self.find.iter(word) if self.reachable else ():
            while pending and pending[-1] < end:
                at = pending.pop()
                if last[at] is None:
                    last[at] = -1 - ord(word[at])
            if last[end] is None:
                if size > end:
                    last[end] = token
                else:
                    left = last[end - size]
                    known = before.get(left)
                    if known or known is None and compatible(left, token):
                        last[end] = token
        for at in pending:
            if last[at] is None:
                last[at] = -1 - ord(word[at])
        return last

    def ids_of(self, word: str) -> tuple[int, ...]:
        """The ids of one word, read off its prefix table backwards."""
        whole = self.reachable.get(word)
        if whole is not None:
            return (whole,)
        last, sizes = self.last_tokens(word), self.sizes
        out: list[int] = []
        at = len(word) - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= sizes[token]
            else:
                out.extend([self.model.byte_ids[b] for b in reversed(chr(-1 - token).encode())])
                at -= 1
        out.reverse()
        return tuple(out)

    def _new_word(self, word: str) -> tuple[int, ...]:
        ids = self.earlier.get(word)
        if ids is None:
            ids = self.ids_of(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.words) >= REMEMBERED_WORDS:
                self.words, self.earlier = {}, self.words
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; the empty text has none."""
        if not text:
            return []
        text = text.replace(" ", SPACE_MARK)
        if self.model.dummy_prefix:
            text = SPACE_MARK + text
        out: list[int] = []
        extend, known, new = out.extend, self.words.get, self._new_word
        for word in self.cut(text):
            ids = known(word)
            if ids is None:
                ids = new(word)
                known = self.words.get
            extend(ids)
        return out


class Decoder:
    """Text from ids: space marks are spaces, runs of byte pieces are UTF-8, the space that encoding put in front goes."""

    def __init__(self, model: Model):
        self.dummy_prefix = model.dummy_prefix
        self.plain = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(SPACE_MARK, " ")
                      for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.byte = {i: b for b, i in enumerate(model.byte_ids)}
        self.unknown = {i for i, k in enumerate(model.kinds) if k == UNKNOWN}

    def decode(self, ids: list[int]) -> str:
        byte, plain = self.byte, self.plain
        start, front = 0, ""
        # the first piece with a text loses one leading space; pieces without one leave the place as it is
        while self.dummy_prefix and start < len(ids):
            i = ids[start]
            if i in byte:
                break
            start += 1
            front = plain[i]
            if front:
                front = front if i in self.unknown else front.removeprefix(" ")
                break
        rest = ids[start:]
        if byte.keys().isdisjoint(rest):
            return front + "".join([plain[i] for i in rest])
        out, run = [front], bytearray()
        for i in rest:
            if i in byte:
                run.append(byte[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(plain[i])
        out.append(_utf8(bytes(run)))
        return "".join(out)


def _utf8(run: bytes) -> str:
    """Bytes as text, each byte that belongs to no character as one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _worker(model, digests_only: bool):
    def start():
        tables: Model = shared(model)
        encoder, decoder = Encoder(tables), Decoder(tables)
        written = [str(i) for i in range(len(tables.pieces))]

        def work(values):
            counts, ids, decoded = [], [], []
            for value in values:
                found = encoder.encode((value or b"").decode("utf-8", "replace"))
                text = decoder.decode(found)
                counts.append(len(found))
                if digests_only:
                    ids.append(hashlib.sha256(",".join([written[i] for i in found]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    ids.append(np.array(found, np.int32))
                    decoded.append(text)
            return counts, ids, decoded

        return work

    return start


def sentencepiece_round_trip(
    docs: DataFrame, model: str, *, text: str = "text", digests_only: bool = False,
) -> DataFrame:
    """Encode and decode every whole text; adds columns ``n_tokens``, ``ids`` and ``decoded``.

    ``model`` is the path of a BPE model file, read on the driver; its tables, whose size the vocabulary bounds, are broadcast.
    With ``digests_only`` the last two columns hold SHA-256 digests (of the decimal ids joined by commas, and of the decoded
    text in UTF-8) instead of the array and the text.

    A null or empty text has no ids and decodes to the empty text. Strings such as ``<s>`` inside a text are ordinary text.
    Bytes that are no UTF-8 are read as U+FFFD. Rows are worked on one by one: ties, repeated rows and null ids change
    nothing, and an empty table gives an empty table. Columns of ``docs`` that have one of the new names are replaced. A
    text's cost grows in proportion to its length, however long its words are.
    """
    tables = share(docs.sparkSession, load_model(model))
    kind = pa.string() if digests_only else pa.list_(pa.int32())
    run = batch_column(docs.sparkSession, _worker(tables, digests_only),
                       {"n_tokens": pa.int64(), "ids": kind, "decoded": pa.string()})
    made = free_name(docs, "made")
    out = docs.withColumn(made, run(as_bytes(text)))
    return out.withColumns({c: F.col(f"{made}.{c}") for c in ("n_tokens", "ids", "decoded")}).drop(made)
