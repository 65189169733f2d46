import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from saltmarsh.llm import bpe
from saltmarsh.llm.bpe import bpe_round_trip, compile_automaton, load_vocabulary
from saltmarsh.llm.token_counts import count_tokens

from .helpers import AWKWARD, docs_with_clashes

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    letters = ["".join(rng.choice("abcdefghij klmnopqrstuvwxyzéüñ.,'") for _ in range(400)) for _ in range(20)]
    return AWKWARD + given + letters


def test_round_trip_equals_the_library(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    library = Tokenizer.from_file(BYTE_BPE)
    wanted = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    decoded = library.decode_batch(wanted, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe_round_trip(docs, BYTE_BPE).collect()}
    digests = {r.doc_id: r for r in bpe_round_trip(docs, BYTE_BPE, digests_only=True).collect()}
    for i, ids in enumerate(wanted):
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == decoded[i] == (texts[i] or "")
        assert digests[i].ids == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded == hashlib.sha256(decoded[i].encode()).hexdigest()


def test_automaton_accepts_exactly_the_right_token_sequences():
    vocab, merges, special = load_vocabulary(BYTE_BPE)
    merges = merges[:600]
    letters = [t for t in vocab if len(t) == 1]
    small = {t: i for i, t in enumerate(letters + [a + b for a, b in merges])}
    automaton = compile_automaton(small, merges, {})
    rank = {m: i for i, m in enumerate(merges)}
    names = list(small)

    def by_rank(symbols):
        symbols = list(symbols)
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
            if not pairs:
                return symbols
            _, i = min(pairs)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    rng = random.Random(1)
    for _ in range(4000):
        tokens = [rng.choice(names[-500:] + letters[:100]) for _ in range(rng.randint(1, 4))]
        at, accepted = 0, True
        for t in tokens:
            c = automaton.column[small[t]]
            accepted = accepted and bool(automaton.allowed[at, c >> 3] >> (c & 7) & 1)
            at = automaton.state[small[t]]
        assert accepted == (by_rank("".join(tokens)) == tokens)


def test_token_counts_equal_the_library(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    library = Tokenizer.from_file(WORD_BPE)
    wanted = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for r in count_tokens(docs, WORD_BPE).collect():
        assert r.n_tokens == wanted[r.doc_id] and r.n_bytes == len((r.text or "").encode())
        assert r.over_limit == (r.n_tokens > 2048)


@pytest.mark.parametrize("run", [lambda d: bpe_round_trip(d, BYTE_BPE), lambda d: count_tokens(d, WORD_BPE)])
def test_clashes_repeats_and_empty_tables(spark, run):
    docs = docs_with_clashes(spark, AWKWARD)
    got = run(docs)
    assert got.count() == docs.count() and got.schema["made"].dataType.simpleString() == "string"
    assert {r.made for r in got.collect()} == {"mine", None}
    assert run(docs.limit(0)).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    encoder = bpe.Encoder(compile_automaton(*load_vocabulary(BYTE_BPE)))
    words = [" alpha", " beta", "gamma", " alpha", "delta"] * 3
    whole = encoder.encode_words(words)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 2)
    encoder.words.clear()
    assert encoder.encode_words(words) == whole


def test_long_words_by_rank_buckets(monkeypatch):
    from saltmarsh.llm.token_counts import TokenCounter, load_merges

    counter = TokenCounter(load_merges(WORD_BPE))
    library = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(11)
    words = ["a" * n for n in (1, 2, 3, 7, 64, 1001)] + ["ab" * 300, "the" * 400, "ΑΒΓ".lower() * 100]
    words += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(1, 700))) for _ in range(60)]
    wanted = [len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]
    assert [counter.count_long(w.encode()) for w in words] == wanted
    assert counter.count([w.encode() for w in words]).tolist() == wanted


def test_very_long_words_take_time_in_proportion():
    import time

    from saltmarsh.llm.token_counts import TokenCounter, load_merges

    rng = random.Random(12)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000)).encode()
    counter, encoder = TokenCounter(load_merges(WORD_BPE)), bpe.Encoder(compile_automaton(*load_vocabulary(BYTE_BPE)))
    start = time.perf_counter()
    assert 0 < counter.count_long(word) < len(word)
    assert b"".join(encoder.labels[t] for t in encoder.tokens(word)) == word
    assert time.perf_counter() - start < 60
