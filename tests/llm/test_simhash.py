import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from saltmarsh.llm import simhash
from saltmarsh.llm.common import Scratch
from saltmarsh.llm.components import components
from saltmarsh.llm.simhash import fingerprint, keep_one_of_each, near_pairs, simhash_components

from .helpers import ASCII_LOWER, AWKWARD, docs_with_clashes, space_words


def by_contract(text):
    words = [w.translate(ASCII_LOWER) for w in space_words(text)]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    """Least key reachable over links of two bits at most."""
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.int64).view(np.uint64)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = find(k), find(keys[j])
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_fingerprint_by_contract():
    texts = AWKWARD + ["A b c", "a B c d", "é É è", "a b"]
    for text in texts:
        value = fingerprint(None if text is None else text.encode())
        assert value & (1 << 64) - 1 == by_contract(text), text
    assert fingerprint(None) == fingerprint(b" \t") == 0


def test_spark_hash_is_the_contract_hash(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("the end of")).alias("h")).first().h
    assert value & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"the end of", 42)


@pytest.mark.parametrize("crowd", [2, 16, 1000])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(crowd)
    prints = set()
    for center in rng.integers(-(2**62), 2**62, 6):
        for _ in range(60):
            value = int(center) & (1 << 64) - 1
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                value ^= 1 << int(b)
            prints.add(value)
    prints = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    found = near_pairs(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    members = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    links = found.where("b is not null").unionAll(simhash._crowd_links(members))
    got = {r.node: r.root for r in components(links, Scratch(spark, "test")).collect()}
    assert {p: got.get(p, p) for p in prints} == roots({p: p for p in prints})
    pairs = [(r.a, r.b) for r in found.where("b is not null").collect()]
    assert len(pairs) == len(set(pairs))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (3000, 2999), (2999, 3000)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    wanted = {i: 0 for i in range(1, 41)} | {k: 1000 for k in range(1001, 1200)} | {3000: 2999}
    assert got == wanted
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0


def test_documents(spark):
    base = [f"w{i}" for i in range(400)]
    texts = AWKWARD + [" ".join(base), " ".join(base + ["tail"]), " ".join(base), "other words here " * 30]
    docs = docs_with_clashes(spark, texts)
    rows = docs.select("doc_id", "text").collect()
    got = simhash_components(docs).collect()
    assert len(got) == len(rows)
    wanted = roots({i: fingerprint(None if t is None else t.encode()) for i, t in enumerate(texts)})
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == wanted[r.doc_id]
    kept = [r.doc_id for r in keep_one_of_each(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({v for v in wanted.values()}) and kept.count(None) == 1
    assert keep_one_of_each(docs).columns == docs.columns
    assert simhash_components(docs.limit(0)).count() == 0 and keep_one_of_each(docs.limit(0)).count() == 0
