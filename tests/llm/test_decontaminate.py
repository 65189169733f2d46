import random

import numpy as np
import pytest

from saltmarsh.llm import decontaminate
from saltmarsh.llm.decontaminate import cut_spans, drop_contaminated, find_contamination, phrases_of, search_shard
from saltmarsh.llm.fm_index import FMIndex, suffix_array

from .helpers import AWKWARD, contract_words, docs_with_clashes


def brute_force(text, items, window):
    words = contract_words(text)
    hit, found = set(), set()
    for name, item in items:
        own = contract_words(item)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            phrase = own[k : k + window]
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found.add(name)
    return len(words), hit, sorted(found)


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for n, size in ((0, 2), (1, 2), (300, 2), (300, 4), (500, 60)):
        text = rng.integers(1, size, n)
        ended = np.append(text, 0)
        assert suffix_array(ended).tolist() == sorted(range(n + 1), key=lambda i: ended[i:].tolist())
        index = FMIndex(text, size)
        for length in (1, 2, 3):
            phrases = rng.integers(1, size, (20, length))
            number, place = index.locate(*index.search(phrases, np.full(20, length)))
            for k, phrase in enumerate(phrases):
                wanted = [i for i in range(n - length + 1) if (text[i : i + length] == phrase).all()]
                assert sorted(place[number == k].tolist()) == wanted


def test_shards_equal_brute_force():
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "dé", "E"]
    for trial in range(40):
        window = rng.choice([2, 3, 5])
        items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 8)))) for i in range(rng.randint(0, 8))]
        items += [("n", None)] * (trial % 5 == 0)
        texts = [None, "", "!!"] + [rng.choice([" ", ", "]).join(
            rng.choice(vocabulary + ["zzz"]) for _ in range(rng.randint(0, 60))) for _ in range(12)]
        phrases = phrases_of([(n, None if t is None else t.encode()) for n, t in items], window)
        counts, hits, found, starts, ends = search_shard([None if t is None else t.encode() for t in texts], phrases)
        for k, text in enumerate(texts):
            words, hit, names = brute_force(text, items, window)
            spans = {x for a, b in zip(starts[k], ends[k], strict=True) for x in range(a, b)}
            assert (counts[k], hits[k], found[k], spans) == (words, len(hit), names, hit)


@pytest.mark.parametrize("block_bytes", [16 << 20, 1500])
def test_given_tables_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    got = find_contamination(docs, bench).collect()
    assert any(r.found.contaminated for r in got)
    for r in got:
        words, hit, names = brute_force(r.text, items, 13)
        assert (r.found.n_words, r.found.n_hit, r.found["items"]) == (words, len(hit), names)
        assert r.found.contaminated == (bool(hit) and 20 * len(hit) >= words)


def test_cutting_spans():
    assert cut_spans(b"a b, c d! e", [1, 3], [2, 5]) == b"a , c "
    assert cut_spans("é b".encode(), [0], [1]) == b" b" and cut_spans(b"x", [], []) == b"x"


def test_clashes_repeats_and_empty_tables(spark):
    docs = docs_with_clashes(spark, AWKWARD).withColumnRenamed("made", "found")
    bench = spark.createDataFrame([(1, "the end"), (1, None), (None, "word"), (3, "no id here at all but words")], "item_id bigint, text string")
    got = drop_contaminated(docs, bench)
    items = [("1", "the end"), ("1", None), ("", "word"), ("3", "no id here at all but words")]
    wanted = []
    for r in docs.collect():
        words, hit, _ = brute_force(r.text, items, 13)
        if not (hit and 20 * len(hit) >= words):
            wanted.append((r.doc_id, r.text))
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={d!r}, text={t!r})" for d, t in wanted)
    assert got.columns == docs.columns and drop_contaminated(docs.limit(0), bench).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == docs.count()
