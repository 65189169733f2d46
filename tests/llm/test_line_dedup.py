import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from saltmarsh.llm import line_dedup
from saltmarsh.llm.line_dedup import drop_repeated_lines, find_repeated_lines, within_one_edit

from .helpers import AWKWARD, docs_with_clashes


def words(line):
    return [w for w in re.split("[\x20\x09-\x0d]+", line.lower()) if w]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def text_key(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return value - 2**64 if value >= 2**63 else value


def brute_force(rows, least=5, exact_least=None):
    """Line numbers that go, by (id, text): as repeats (of lines of ``exact_least`` words), and as near repeats (of ``least``)."""
    places = sorted({(d is not None, d or 0, text_key(t), i, t, tuple(words(line)))
                     for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))})
    places = [(d if known else None, t, i, w) for known, d, _, i, t, w in places if len(w) >= (least if exact_least is None else exact_least)]
    first, exact, close = {}, {}, {}
    for d, t, i, w in places:
        if first.setdefault(w, (d, t, i)) != (d, t, i):
            exact.setdefault((d, t), set()).add(i)
    order = [w for w in first if len(w) >= least]
    for k, w in enumerate(order):
        if any(near(v, w) for v in order[:k]):
            d, t, i = first[w]
            close.setdefault((d, t), set()).add(i)
    return exact, close


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(d, "\n".join(" ".join(rng.choice("aBcd") for _ in range(rng.choice([0, 1, 4, 5, 5, 6, 6, 7, 8, 12])))
                         for _ in range(rng.randint(0, 8)))) for d in range(60)]
    long = [f"w{i}" for i in range(150)]
    for d in range(60, 72):
        line, k = list(long), rng.randrange(150)
        if d % 3 == 0:
            line[k] = f"other{d}"
        elif d % 3 == 1:
            del line[k]
        else:
            line.insert(k, "new")
        out.append((d, "  ".join(line)))
    return out + [(None, "a b c d e f"), (90, None), (91, ""), (3, out[3][1]), (92, "A\tb c d\x0be f"), (None, "a b c d e g")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force(spark, rows, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    exact, close = brute_force(rows)
    got = find_repeated_lines(docs).collect()
    assert len(got) == len(rows) and sum(map(len, close.values())) > 10

    def listed(d, exact, near):
        return str((d, exact, near))

    assert sorted(listed(r.doc_id, r.exact, r.near) for r in got) == sorted(
        listed(d, sorted(exact.get((d, t), ())), sorted(close.get((d, t), ()))) for d, t in rows)


def test_edit_distance_of_words(spark):
    pairs = [("a b c", "a b c"), ("a b c", "a x c"), ("a b c", "a c"), ("a b c", "a b c d"), ("a b c", "b c a"), ("a a", "a a a"),
             ("a b", "c d"), ("a", ""), ("", ""), ("a b c d", "a x b c")]
    df = spark.createDataFrame(pairs, "x string, y string")
    split = [F.array_remove(F.split(c, " "), "") for c in "xy"]
    for r in df.withColumn("near", within_one_edit(*split)).collect():
        assert r.near == near(r.x.split(), r.y.split()), r


def test_dropping_lines_keeps_the_rest(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text")).withColumn("gone", F.lit(1))
    exact, close = brute_force(rows)
    got = {(r.doc_id, r.text): r for r in drop_repeated_lines(docs).collect()}
    for d, t in rows:
        lost = exact.get((d, t), set()) | close.get((d, t), set())
        left = t if t is None or not lost else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
        assert ((d, left) in got) == (not lost or bool(words(left)))
        if (d, left) in got:
            assert got[d, left].n_chars == (None if left is None else len(left)) and got[d, left].gone == 1


def test_one_line_with_a_third_of_all_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"the very same line again\nan own line of document {i} {i * 7}") for i in range(300)], "doc_id bigint, text string")
    got = find_repeated_lines(docs).collect()
    assert sum(map(len, (r.exact for r in got))) == 299
    # documents' own lines differ in two words, so none is near another
    assert not any(r.near for r in got)


def test_clashes_repeats_and_empty_tables(spark):
    docs = docs_with_clashes(spark, AWKWARD)
    assert find_repeated_lines(docs).count() == docs.count()
    kept = drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert drop_repeated_lines(docs.limit(0)).count() == 0 and find_repeated_lines(docs.limit(0)).count() == 0


def test_short_lines_go_as_repeats_only(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    (exact, _), (_, close) = brute_force(rows, 1), brute_force(rows)
    assert sum(map(len, exact.values())) > sum(map(len, brute_force(rows)[0].values()))
    got = {(r.doc_id, r.key): (r.exact, r.near) for r in find_repeated_lines(docs, min_exact_words=1).join(
        docs.select(F.col("doc_id").alias("d"), F.col("text").alias("key")), F.expr("doc_id <=> d")).collect()}
    once = [(d, t) for d, t in rows if sum(d == other for other, _ in rows) == 1]
    assert len(once) > 60
    for d, t in once:
        assert got[d, t] == (sorted(exact.get((d, t), ())), sorted(close.get((d, t), ()))), d


def test_an_exact_copy_with_a_short_line_goes_whole(spark):
    text = "Short heading\none line of more than five words\n\nend"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "Short heading\nsomething else that nobody has written")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs, min_exact_words=1).collect()}
    assert got == {1: text, 3: "something else that nobody has written"}
