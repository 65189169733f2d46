"""Alignment of two tokenizers by products of sparse incidence matrices.

Both tokenizers spell the same bytes. Incidence of tokens and bytes is held in compressed sparse rows, built by hand: a pointer for each row and
the columns one after another. The row product A·Bᵀ (Gustavson: a row of the result gathers the rows of Bᵀ that its own entries
name) gives the overlap links, with the bytes that two tokens share. A link at which both tokens are new starts a group, as there
both tokenizers have ended a token at one byte. The product of the group incidences (token ids x groups, groups x token ids) gives the
shared-group links. It runs on distinct ids of a group with their numbers, so a token that comes again in a group costs nothing,
and in blocks of bounded size.

How many documents hold a pair of ids linked is counted in Spark, and each document's links meet those counts there: by a broadcast
if the table of pairs is small when measured, else by a join in which pairs of many documents are dealt over several tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saltmarsh.llm.bpe import SPLIT, byte_alphabet
from saltmarsh.llm.common import Scratch, as_bytes, bounded_batches, free_name, share, shared
from saltmarsh.operators.skew import heavy_keys, split_join

#: Bytes of text whose incidence matrices are held at once, and entries of a product made at once.
SEGMENT, PRODUCT = 1 << 20, 1 << 21
#: Bytes of texts that are aligned together, whatever the size of a batch.
TOGETHER = 1 << 20
#: White space in a row that the whole-text pattern is spared.
LONG_RUN = 1000
#: Pairs of ids that are broadcast at most (about 40 bytes each).
BROADCAST_PAIRS = 1_000_000

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SPACE_MARK = "▁"


class ByteTokens:
    """Token ids of byte-level BPE without special tokens, and each id's bytes.

    Texts are encoded whole. The pattern that does so cannot take long runs of white space; a text with one is cut first, and
    encoded word by word.
    """

    def __init__(self, spec: str):
        alphabet = byte_alphabet()
        self.model, self.spelled = Tokenizer.from_str(spec).model, {b: c for c, b in alphabet.items()}
        content = json.loads(spec)["model"]
        vocab = content["vocab"]
        self.bytes = [b""] * (1 + max(vocab.values(), default=-1))
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token if c in alphabet)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in content["merges"]]
        ranked = [vocab[t] for t in dict.fromkeys([c for c in alphabet if c in vocab] + merged)]
        self.id_of = np.array(ranked, np.int64)
        self.whole = tiktoken.Encoding("whole", pat_str=SPLIT, mergeable_ranks={self.bytes[i]: r for r, i in enumerate(ranked)}, special_tokens={})
        self.long_run = re.compile(rf"\s{{{LONG_RUN}}}").search
        self.split = regex.compile(SPLIT).findall

    def encode(self, text: str) -> np.ndarray:
        if not self.long_run(text):
            return self.id_of[self.whole.encode_ordinary(text)]
        words = (word.encode().decode("latin-1").translate(self.spelled) for word in self.split(text))
        return np.array([t.id for word in words for t in self.model.tokenize(word)], np.int64)


class Pieces:
    """Token ids of a SentencePiece model, and each id's bytes."""

    def __init__(self, model: bytes):
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.int64)


def rows_of(pointers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the given rows of a sparse matrix, one row after another: the place in ``rows`` of each, and its own place."""
    sizes = pointers[rows + 1] - pointers[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    first = np.cumsum(sizes) - sizes
    return owner, np.arange(len(owner)) - np.repeat(first - pointers[rows], sizes)


def product(
    a_pointers: np.ndarray, a_columns: np.ndarray, b_pointers: np.ndarray, b_columns: np.ndarray, most: int = PRODUCT,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of A·B, block by block: the row of A, the entry of A, and the entry of B that meet, in the order of rows.

    A block holds at most ``most`` meetings, or those of one entry.
    """
    n_rows = len(a_pointers) - 1
    row = np.repeat(np.arange(n_rows), np.diff(a_pointers))
    upto = np.cumsum(b_pointers[a_columns + 1] - b_pointers[a_columns])
    start = 0
    while start < len(a_columns):
        done = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + most, "right")))
        owner, entry = rows_of(b_pointers, a_columns[start:end])
        yield row[start:end][owner], start + owner, entry
        start = end


def overlap_links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A·Bᵀ of the token-byte incidences: tokens of A and B that share bytes, and how many."""
    n_bytes = int(a_sizes.sum())
    a_pointers = np.concatenate([[0], np.cumsum(a_sizes)])
    transposed_pointers, transposed_columns = np.arange(n_bytes + 1), np.repeat(np.arange(len(b_sizes)), b_sizes)
    rows, columns, shared_bytes = [], [], []
    for row, _, entry in product(a_pointers, np.arange(n_bytes), transposed_pointers, transposed_columns, max(n_bytes, 1)):
        column = transposed_columns[entry]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (column[1:] != column[:-1])])
        rows.append(row[new])
        columns.append(column[new])
        shared_bytes.append(np.diff(np.r_[new, len(row)]))
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(shared_bytes)


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from the overlap links in their order."""
    new = np.r_[True, (a[1:] != a[:-1]) & (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return group[np.flatnonzero(np.r_[True, a[1:] != a[:-1]])], group[np.flatnonzero(np.r_[True, b[1:] != b[:-1]])]


def _distinct(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[starts], np.diff(np.r_[starts, len(keys)])
    return keys[starts], np.add.reduceat(weights[order], starts) if len(starts) else np.zeros(0, np.int64)


def shared_group_links(
    a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, group_doc: np.ndarray, a_size: int, b_size: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The product of the group incidences: (document, id of A, id of B) as one number, and the links of each."""
    a_keys, a_times = _distinct(a_group * a_size + a_ids)
    b_keys, b_times = _distinct(b_group * b_size + b_ids)
    groups = len(group_doc)
    b_pointers = np.searchsorted(b_keys, np.arange(groups + 1) * b_size)
    keys, links = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for _, x, y in product(np.arange(len(a_keys) + 1), a_keys // a_size, b_pointers, b_keys):
        pair = (group_doc[a_keys[x] // a_size] * a_size + a_keys[x] % a_size) * b_size + b_keys[y] % b_size
        found.append(_distinct(pair, a_times[x] * b_times[y]))
        if sum(len(k) for k, _ in found) > 2 * PRODUCT:
            found = [_distinct(*[np.concatenate(c) for c in zip(*found, strict=True)])]
    if found:
        keys, links = _distinct(*[np.concatenate(c) for c in zip(*found, strict=True)])
    return keys, links


class Aligner:
    """Both tokenizers over a batch of texts, and the links of all their documents."""

    def __init__(self, vocabulary: str, model: bytes):
        self.a, self.b = ByteTokens(vocabulary), Pieces(model)
        self.a_sizes = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b.bytes], np.int64)
        # each id with what follows it in the written groups: a comma, or the end of its half
        self.written = [f"{i}{end}".encode() for n, ends in ((len(self.a.bytes), ",|"), (len(self.b.bytes), ",;")) for i in range(n) for end in ends]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        spelled = " " + text
        a, b = self.a.encode(spelled), self.b.encode(text)
        spelled, a_bytes, b_bytes = spelled.encode(), self.a.bytes, self.b.bytes
        if b"".join([a_bytes[i] for i in a.tolist()]) != spelled or b"".join([b_bytes[i] for i in b.tolist()]) != spelled:
            return none
        return a, b

    def align(self, texts: list[str], overlaps: bool = False) -> dict[str, pa.Array | np.ndarray | list]:
        """Per text: numbers of tokens, groups and links, digest of the groups, linked pairs of ids, and overlap links if asked for."""
        both = [self.tokens(t) for t in texts]
        n = len(texts)
        a_ids, b_ids = (np.concatenate([x[k] for x in both]) if n else np.zeros(0, np.int64) for k in (0, 1))
        a_doc, b_doc = (np.repeat(np.arange(n), [len(x[k]) for x in both]) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        # segments end where both tokenizers end a token
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        links_a, links_b, links_bytes = [], [], []
        start_a = start_b = at = groups = 0
        keys, links = [], []
        while at < len(common):
            offset = int(common[at - 1]) if at else 0
            at = max(at + 1, int(np.searchsorted(common, offset + SEGMENT, "right")))
            end_a, end_b = (int(np.searchsorted(e, common[at - 1], "right")) for e in (a_ends, b_ends))
            of_a, of_b = slice(start_a, end_a), slice(start_b, end_b)
            x, y, size = overlap_links(self.a_sizes[a_ids[of_a]], self.b_sizes[b_ids[of_b]])
            own_a, own_b = groups_of(x, y)
            first_of_group = np.flatnonzero(np.r_[True, own_a[1:] != own_a[:-1]])
            found = shared_group_links(a_ids[of_a], own_a, b_ids[of_b], own_b, a_doc[of_a][first_of_group], len(self.a_sizes), len(self.b_sizes))
            keys.append(found[0])
            links.append(found[1])
            a_group[of_a], b_group[of_b] = own_a + groups, own_b + groups
            groups += len(first_of_group)
            if overlaps:
                links_a.append(x + start_a)
                links_b.append(y + start_b)
                links_bytes.append(size)
            start_a, start_b = end_a, end_b
        a_of, b_of = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        group_doc = a_doc[np.flatnonzero(np.r_[True, a_group[1:] != a_group[:-1]])] if len(a_ids) else np.zeros(0, np.int64)
        per_doc = lambda doc, weights=None: np.bincount(doc, weights, minlength=n).astype(np.int64)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, group_doc, a_of * b_of)
        pairs, times = _distinct(np.concatenate(keys), np.concatenate(links)) if keys else (np.zeros(0, np.int64),) * 2
        pair_size = len(self.a_sizes) * len(self.b_sizes)
        out = {
            "n_a": per_doc(a_doc), "n_b": per_doc(b_doc), "n_groups": per_doc(group_doc), "n_links": n_links,
            "groups_sha256": self._digests(n, a_ids, a_doc, a_group, a_of, b_ids, b_group, b_of),
            "pairs": _lists(per_doc(pairs // pair_size), {
                "a": (pairs % pair_size // len(self.b_sizes)).astype(np.int32), "b": (pairs % len(self.b_sizes)).astype(np.int32), "links": times}),
        }
        if overlaps:
            x, y, size = (np.concatenate(v).astype(np.int32) if v else np.zeros(0, np.int32) for v in (links_a, links_b, links_bytes))
            doc = a_doc[x]
            first_a, first_b = (np.cumsum(c) - c for c in (out["n_a"], out["n_b"]))
            out["overlaps"] = _lists(per_doc(doc), {
                "a_place": (x - first_a[doc]).astype(np.int32), "b_place": (y - first_b[doc]).astype(np.int32), "bytes": size})
        return out

    def _digests(self, n, a_ids, a_doc, a_group, a_of, b_ids, b_group, b_of) -> list[str]:
        """SHA-256 of each document's groups, written ``a1,a2|b1;a3|b2,b3``."""
        b_before, a_upto = np.cumsum(b_of) - b_of, np.cumsum(a_of)
        ends_a, ends_b = (np.r_[g[1:] != g[:-1], True].astype(np.int64) if len(g) else g for g in (a_group, b_group))
        text = np.empty(len(a_ids) + len(b_ids), np.int64)
        place_a = np.arange(len(a_ids)) + b_before[a_group]
        text[place_a] = 2 * a_ids + ends_a
        text[np.arange(len(b_ids)) + a_upto[b_group]] = 2 * (len(self.a_sizes) + b_ids) + ends_b
        starts = place_a[np.searchsorted(a_doc, np.arange(n))[np.bincount(a_doc, minlength=n) > 0]] if len(a_ids) else []
        bounds = [*[int(s) for s in starts], len(text)]
        has = np.bincount(a_doc, minlength=n) > 0
        out, k, written = [], 0, self.written
        for i in range(n):
            if not has[i]:
                out.append("")
                continue
            whole = b"".join([written[c] for c in text[bounds[k] : bounds[k + 1]].tolist()])
            out.append(hashlib.sha256(whole[:-1]).hexdigest())
            k += 1
        return out


def _lists(sizes: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields)))


def _bounded(batch: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in lists of ``TOGETHER`` bytes, or one longer text; one empty list for none."""
    texts, size = [], 0
    for value in batch:
        raw = value.as_py() or b""
        if texts and size + len(raw) > TOGETHER:
            yield texts
            texts, size = [], 0
        texts.append(raw.decode("utf-8", "replace"))
        size += len(raw)
    yield texts


def align_tokens(docs: DataFrame, vocabulary: str, model: str, *, text: str = "text", overlaps: bool = False) -> DataFrame:
    """Align the tokens of space + text by a byte-level BPE file (A) and of text by a SentencePiece model that puts a space in front (B).

    Adds ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and ``pairs``: the distinct pairs of ids that are linked, with the number of
    links. With ``overlaps`` also ``overlaps``: the tokens, by place, that share bytes, and how many. Both files are read on the driver and
    broadcast; their size does not grow with the data.

    Special strings are plain text. A text that is null or empty, or whose tokens do not spell space + text (it holds the space mark itself), has no
    tokens: zeros, an empty digest, empty lists. Texts of any length are worked on in segments. Rows are worked on one by one: ties,
    repeated rows and null ids change nothing, an empty table gives an empty table, and columns of ``docs`` that have one of the new
    names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    with open(model, "rb") as f:
        tables = share(spark, (spec, f.read()))
    names = [*COUNTS, "groups_sha256", "pairs", *(["overlaps"] if overlaps else [])]
    kind = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<a: int, b: int, links: bigint>>"
    if overlaps:
        kind += ", overlaps array<struct<a_place: int, b_place: int, bytes: int>>"

    @F.arrow_udf(f"struct<{kind}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = Aligner(*shared(tables))
        for batch in batches:
            parts = []
            for texts in _bounded(batch):
                out = aligner.align(texts, overlaps)
                parts.append(pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names))
            yield pa.concat_arrays(parts)

    made = free_name(docs, "made")
    out = docs.withColumn(made, run.asNondeterministic()(as_bytes(text)))
    return out.withColumns({c: F.col(f"{made}.{c}") for c in names}).drop(made)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """How many documents hold each pair of ids linked: ``a, b, documents``, and ``is_best`` where no pair of that ``a`` is held by more."""
    counted = aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("documents"))
    most = F.max("documents").over(Window.partitionBy("a"))
    return counted.withColumn("is_best", F.col("documents") == most)


def weigh_links(docs: DataFrame, vocabulary: str, model: str, *, text: str = "text") -> DataFrame:
    """``align_tokens`` without the text and the pairs, and for each document ``n_best`` (links whose pair is the most frequent of its id of A) and ``count_sum``
    (how many documents hold the pair, summed over the links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-alignment")
    number = free_name(docs, "row_number")
    aligned = align_tokens(docs, vocabulary, model, text=text).drop(text).withColumn(number, F.monotonically_increasing_id())
    aligned = scratch.write(aligned, "aligned")
    counts = scratch.write(count_pairs(aligned), "counts")
    links = aligned.select(F.col(number).alias("row"), F.inline("pairs"))
    if counts.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counts), ["a", "b"])
    else:
        heavy = heavy_keys(counts, ["a", "b"], rows_of=F.col("documents"))
        met = split_join(links, counts, ["a", "b"], heavy=heavy)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum"))
    best, total = free_name(docs, "best"), free_name(docs, "total")
    sums = sums.select(F.col("row").alias(number), F.col("n_best").alias(best), F.col("count_sum").alias(total))
    out = aligned.drop("pairs", "n_best", "count_sum").join(sums, number, "left")
    return out.withColumns({"n_best": F.coalesce(best, F.lit(0)), "count_sum": F.coalesce(total, F.lit(0))}).drop(number, best, total)
