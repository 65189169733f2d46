import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saltmarsh.llm import token_alignment
from saltmarsh.llm.bpe import byte_alphabet
from saltmarsh.llm.token_alignment import Aligner, align_tokens, overlap_links, product, weigh_links

from .helpers import AWKWARD, docs_with_clashes

VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [*AWKWARD, " " * 3000 + "a" + "\n" * 2500 + "b", "a ▁ b", "▁", "naïve café 漢字 \U0010ffff", "Under the MIT License.", "=-" * 300,
         "<s> </s> <unk> <0x41>", "tokenization tokenisation", "  two  spaces  "]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain(texts, libraries):
    """Token by token: groups by common ends, all pairs within a group, counts over documents."""
    a_lib, b_lib = libraries
    alphabet = byte_alphabet()
    docs, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            a_bytes = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = (np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes))
                i = j = 0
                for end in sorted(set(a_ends) & set(b_ends)):
                    p, q = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
                    groups.append((a[i:p], b[j:q]))
                    i, j = p, q
        pairs = Counter((x, y) for g, h in groups for x in g for y in h)
        docs.append((groups, pairs))
        held.update(pairs.keys())
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for groups, pairs in docs:
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in pairs.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def weighed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in weigh_links(docs, VOCABULARY, MODEL).collect()}
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for _, r in sorted(rows.items())]


@pytest.mark.parametrize("most", [1_000_000, 0], ids=["broadcast", "dealt"])
def test_equals_the_plain_alignment(spark, libraries, monkeypatch, most):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", most)
    if not most:
        monkeypatch.setattr(token_alignment, "TOGETHER", 2000)
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(150).collect()]
    texts = TEXTS + given + given[:20]
    assert weighed(spark, texts) == plain(texts, libraries)


def test_small_segments_and_products_change_nothing(libraries, monkeypatch):
    with open(VOCABULARY, encoding="utf-8") as f, open(MODEL, "rb") as g:
        aligner = Aligner(f.read(), g.read())
    texts = [t or "" for t in TEXTS]
    whole = aligner.align(texts, overlaps=True)
    monkeypatch.setattr(token_alignment, "SEGMENT", 7)
    monkeypatch.setattr(token_alignment, "PRODUCT", 3)
    monkeypatch.setattr(token_alignment, "LONG_RUN", 2)
    cut = Aligner.align(aligner, texts, overlaps=True)
    for name, column in whole.items():
        assert (column == cut[name]) if isinstance(column, list) else np.array_equal(np.array(column.tolist()), np.array(cut[name].tolist())) \
            if isinstance(column, np.ndarray) else column.equals(cut[name]), name
    # overlap links against the byte ranges
    a, b = aligner.tokens(texts[10])
    a_ends, b_ends = np.cumsum(aligner.a_sizes[a]), np.cumsum(aligner.b_sizes[b])
    wanted = [(i, j, int(min(a_ends[i], b_ends[j]) - max(a_ends[i] - aligner.a_sizes[a[i]], b_ends[j] - aligner.b_sizes[b[j]])))
              for i in range(len(a)) for j in range(len(b))]
    assert [(r["a_place"], r["b_place"], r["bytes"]) for r in whole["overlaps"][10].as_py()] == [w for w in wanted if w[2] > 0]


def test_products_of_sparse_rows():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 2, (rng.integers(1, 9), 6)), rng.integers(0, 2, (6, rng.integers(1, 9)))
        pointers = [np.concatenate([[0], np.cumsum(m.sum(1))]) for m in (a, b)]
        columns = [np.nonzero(m)[1] for m in (a, b)]
        found = np.zeros((len(a), b.shape[1]), int)
        for row, x, y in product(pointers[0], columns[0], pointers[1], columns[1], most=int(rng.integers(1, 9))):
            assert np.array_equal(row, np.searchsorted(pointers[0], x, "right") - 1)
            np.add.at(found, (row, columns[1][y]), 1)
        assert np.array_equal(found, a @ b)
    assert overlap_links(np.array([2, 3]), np.array([1, 4]))[2].tolist() == [1, 1, 3]


def test_a_group_of_a_whole_long_text_stays_bounded():
    """One group of many tokens: ids that come again are met once."""
    n = 40_000
    ids = np.arange(n) % 50
    keys, links = token_alignment.shared_group_links(ids, np.zeros(n, int), ids, np.zeros(n, int), np.zeros(1, int), 60, 60)
    assert len(keys) == 2500 and links.sum() == n * n


def aligner_of_nothing():
    with open(VOCABULARY, encoding="utf-8") as f, open(MODEL, "rb") as g:
        out = Aligner(f.read(), g.read()).align([], overlaps=True)
    return sum(len(column) for column in out.values())


def test_clashes_repeats_and_empty_tables(spark, libraries):
    docs = docs_with_clashes(spark, AWKWARD).withColumn("row", F.lit("own")).withColumn("pairs", F.lit(1)).withColumn("best", F.lit("own"))
    got = weigh_links(docs, VOCABULARY, MODEL)
    rows = got.collect()
    assert len(rows) == docs.count() and {(r.row, r.best) for r in rows} == {("own", "own")} and {r.made for r in rows} == {"mine", None}
    texts = [r.text for r in docs.collect()]
    key = lambda r: (r[0], r[6])
    assert sorted([(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows], key=key) == sorted(plain(texts, libraries), key=key)
    assert weigh_links(docs.limit(0), VOCABULARY, MODEL).count() == 0
    assert aligner_of_nothing() == 0
    assert align_tokens(docs, VOCABULARY, MODEL, overlaps=True).where(F.size("overlaps") > 0).count() > 0
