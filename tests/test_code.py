"""Files cut into rows, names followed by joins, and the innermost of nested intervals."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions.code_rows import javascript_rows, python_rows
from saltmarsh.operators.detect_calls import (
    JS_CALLEE, JS_MAYBE, PYTHON_CALLEE, PYTHON_MAYBE, call_sites, code_rows, constants, detect_javascript, detect_python, unread_files,
)
from saltmarsh.operators.intervals import innermost
from saltmarsh.operators.resolve import follow


def kinds(rows, *wanted):
    return [r for r in rows if r[0] in wanted]


def size_of(rows):
    return len(repr(rows))


def test_one_odd_file_does_not_stop_the_scan(files_df):
    deep = "x = " + "f(" * 150 + "1" + ")" * 150 + "\n"
    files = files_df(
        ("long.py", "import hashlib\nh = hashlib.md5(" + "+".join(['"a"'] * 500) + ")\n"),
        ("terms.py", "import hashlib\nh = hashlib.md5(" + "+".join(['"a"'] * 60_000) + ")\n"),
        ("deep.py", "x = " + "(" * 4000 + "1" + ")" * 4000 + "\n"), ("calls.py", "import hashlib\n" + deep + "hashlib.md5(x)\n"),
        ("null.py", "import hashlib\n\x00\n"), ("bom.py", "﻿import hashlib\nhashlib.md5(é)\n"), ("empty.py", ""),
        ("good.py", "import hashlib\nhashlib.md5(x)\n"))
    rows = code_rows(files, "python")
    unread = {r.path: r.reason for r in unread_files(rows).collect()}
    found = {r.path for r in detect_python(files).collect()}
    assert {"long.py", "calls.py", "bom.py", "good.py"} <= found
    assert {"deep.py", "null.py"} <= set(unread) and set(unread.values()) <= {"SyntaxError", "RecursionError", "MemoryError", "ValueError"}
    assert ("terms.py" in found) != ("terms.py" in unread)


@pytest.mark.parametrize("cut,unit", [
    (python_rows, "v{i} = hashlib.md5(v{i}, K)\n"), (javascript_rows, "const v{i} = crypto.createHash('md5').update(K{i});\n")])
def test_rows_grow_with_the_file(cut, unit):
    took, sizes = [], []
    for n in (3000, 12_000):
        text = "".join(unit.replace("{i}", str(i)) for i in range(n))
        start = time.perf_counter()
        sizes.append(size_of(cut(text, None, True)))
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] and sizes[1] < 5 * sizes[0]
    # one long constant used often, calls nested deep, and calls on one long line
    assert size_of(cut("K = '" + "x" * 40_000 + "'\n" + "f(K)\n" * 300, None, True)) < 300_000
    nested = [size_of(cut("g(" * n + ")" * n, None, True)) for n in (40, 80)]
    assert nested[1] < 5 * nested[0]
    assert size_of(cut("f(1);" * 5000, None, True)) < 5000 * 100 + 200_000


def test_odd_javascript():
    for odd in ("(", "}}}", "`${", "a===", "\"x", "/*", "f(", "=>", "x=>", "function(", "const a =", "a.b.c(", "'\\", "/x", "=>{", "\0", "class", "let", "= 1", "a ="):
        javascript_rows(odd, None, True)
    start = time.perf_counter()
    javascript_rows("(" * 20_000 + "[{" * 20_000, None, True)
    javascript_rows("class " * 20_000, None, True)
    assert time.perf_counter() - start < 20


def test_javascript_bindings():
    text = ("let k; k = 'one'; var a = 1, b = 'two';\nfunction f(d = 3) { x.y = 4; k += 'three'; }\n"
            "class C { e = 5; m(p = 6) { q = 7 } }\nconst g = (h = 8) => { i = 9 };\nj = z === 'w';\n")
    got = [(r[0], r[4], r[6][0][1][0]) for r in kinds(javascript_rows(text, None, True), "bind", "rebind")]
    assert [g for g in got if g[0] == "bind"] == [("bind", "a", "1"), ("bind", "b", "'two'"), ("bind", "g", "(h = 8) => { i = 9 }")]
    assert [g[1:] for g in got if g[0] == "rebind"] == [("k", "'one'"), ("k", "'three'"), ("q", "7"), ("i", "9"), ("j", "z === 'w'")]


def test_names_resolve_through_assignments_and_imports(files_df):
    js = ("let key; key = 'abcdefghabcdefgh';\nconst crypto = require('crypto');\nlet copy = key;\n"
          "\tcrypto.createCipheriv('aes-128-ecb', copy, iv);\n")
    got = call_sites(files_df(("a.js", js)), "javascript", JS_CALLEE).collect()
    assert [(r.arg1_value, r.arg1_size, r.snippet) for r in got] == [
        ("'abcdefghabcdefgh'", 16, "crypto.createCipheriv('aes-128-ecb', copy, iv);")]
    assert "aes-hardcoded-key" in {r.rule_id for r in detect_javascript(files_df(("a.js", js))).collect()}
    py = ("import os as random_bytes\nfrom hashlib import md5 as digest\nimport hashlib as digest2, hmac\nfrom hashlib import sha1 as digest2\n"
          "def outer():\n  def inner():\n    return digest(1)\n  x = digest2(2)\n  return x\ny = digest(3)\n")
    got = call_sites(files_df(("a.py", py)), "python", PYTHON_CALLEE).orderBy("line").collect()
    assert [(r.line, r.callee, r.function) for r in got] == [(7, "md5", "inner"), (8, "sha1", "outer"), (10, "md5", None)]


def test_files_of_one_name_keep_apart(files_df):
    files = files_df(("a.py", "K = 'one'\nimport AES\nAES.new(K)\n"), ("a.py", "K = 'three'\nAES.new(K)\n"))
    assert sorted(r.arg0_value for r in call_sites(files, "python", r"^AES\.new$").collect()) == ["'one'", "'three'"]


@pytest.mark.parametrize("steps", range(1, 9))
def test_chains_stop_after_the_steps(spark, steps):
    rng = random.Random(steps)
    names = [f"n{i}" for i in range(60)]
    table = {f: {n: (rng.choice(names), True) if rng.random() < 0.85 else ("'literal'", False) for n in rng.sample(names, 50)} for f in range(3)}
    rows = [(f, n, (v, v if is_name else None)) for f, t in table.items() for n, (v, is_name) in t.items()]
    df = spark.createDataFrame(rows, "file int, name string, value struct<text: string, name: string>")

    def walk(t, name):
        for _ in range(steps):
            if name not in t:
                break
            name, is_name = t[name]
            if not is_name:
                break
        return name

    got = {(r.file, r.name): r.value.text for r in follow(df, ["file"], steps).collect()}
    assert got == {(f, n): walk(t, n) for f, t in table.items() for n in t}


def test_last_binding_counts(files_df):
    rows = code_rows(files_df(("a.py", "A = 1\nA = B = 2\ndef f():\n  B: int = 3\n")), "python")
    assert {r.name: r.value.text for r in constants(rows).collect()} == {"A": "2", "B": "3"}


def test_innermost_interval(spark):
    rng = random.Random(7)
    spans, points = [], []

    def nest(group, lo, hi, depth):
        while hi - lo > 2 and rng.random() < 0.8:
            a = rng.randrange(lo, hi - 1)
            b = rng.randrange(a + 1, hi + 1)
            spans.append((group, a, b, None if rng.random() < 0.1 else f"{group}-{len(spans)}"))
            if depth:
                nest(group, a, b, depth - 1)
            lo = b
    for group, width in (("a", 40), ("b", 5000), ("c", 10**9), (None, 50)):
        for _ in range(3):
            before = len(spans)
            nest(group, 0, width, 6)
            if len(spans) > before:
                break
        points += [(group, rng.randrange(width)) for _ in range(300)]
    spans += [("a", 5, 5, "empty"), ("a", 9, 3, "reversed"), ("a", None, 3, "null"), ("a", 0, None, "null")]
    points = [(i, *p) for i, p in enumerate(points + [("none", 3), ("a", None)])]

    def plain(group, at):
        fit = [s for s in spans if group is not None and s[0] == group and None not in s[1:3] and at is not None and s[1] <= at < s[2]]
        return max(fit, key=lambda s: (s[1], -s[2], s[3] or ""))[3] if fit else None

    got = innermost(
        spark.createDataFrame(points, "id int, file string, place bigint"),
        spark.createDataFrame(spans, "file string, start bigint, end bigint, name string"), ["file"], id=["id"])
    assert {r.id: r.within for r in got.collect()} == {i: plain(g, at) for i, g, at in points}


def test_a_file_of_many_functions_spreads(spark, files_df):
    text = "import hashlib\n" + "".join(f"def f{i}():\n  def g{i}():\n    return 1\n  return hashlib.md5(g{i})\n" for i in range(10_000))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = code_rows(files_df(("big.py", text)), "python", PYTHON_CALLEE)
        calls = rows.where(F.col("kind") == "call").select("file", "seq", "place")
        spans = rows.where(F.col("kind") == "function").select("file", F.col("place").alias("start"), "end", "name")
        found = innermost(calls, spans, ["file"], id=["seq"])
        assert found.where(F.col("within").rlike("^f")).count() == 10_000
        by_task = list(Counter(r.task for r in found.select("within", F.spark_partition_id().alias("task")).collect()).values())
        assert len(by_task) > 1 and max(by_task) < 3 * sorted(by_task)[len(by_task) // 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_prefilters_pass_every_text_that_has_a_site():
    import re

    from test_detect import JAVASCRIPT_CASES, PYTHON_CASES

    for cases, cut, callee, maybe in ((PYTHON_CASES, python_rows, PYTHON_CALLEE, PYTHON_MAYBE),
                                      (JAVASCRIPT_CASES, javascript_rows, JS_CALLEE, JS_MAYBE)):
        for text in cases:
            if kinds(cut(text, re.compile(callee), True), "call", "compare"):
                assert re.search(maybe, text), text


def _joins(df):
    """Kinds of joins in the plan that ran."""
    df.collect()
    return set(re.findall(r"(\w+Join)\b", df._jdf.queryExecution().executedPlan().toString()))


def test_no_side_of_a_call_site_join_goes_through_the_driver(spark, files_df):
    """Names, bindings, functions and lines grow with the files, so none of them may be broadcast."""
    text = "import hashlib as h\nD = h.sha1\ndef f(k):\n    return hmac.new(k, b'', D)\n"
    found = call_sites(files_df(*[(f"a{n}.py", text) for n in range(20)]), "python")
    assert _joins(found) == {"SortMergeJoin"}
    assert {(r.callee, r.digest, r.function) for r in found.collect()} == {("hmac.new", "hashlib.sha1", "f")}


def test_names_of_a_file_that_does_not_parse(spark, files_df):
    """Imports and bindings that parse by themselves are read, in strings and comments there are none; calls are not."""
    text = ("\ufeffimport hashlib\ndef f(:\n    from a.b import (c as d,\n        e)\n    K = h(\n  1)\n# import x\ns = \'\'\'\nimport y\n\'\'\'\n"
            "J = (\n  import z\n")
    rows = python_rows(text, None, False)
    assert [(r[0], r[3], r[4], r[5]) for r in rows if r[0] == "alias"] == [
        ("alias", 1, "hashlib", "hashlib"), ("alias", 3, "d", "c"), ("alias", 3, "e", "e"), ("alias", 12, "z", "z")]
    assert sorted(text[1:][r[1]] for r in rows if r[0] in ("alias", "bind")) == list("Kcehsz")
    assert [(r[3], r[4], r[6][0][1][0]) for r in rows if r[0] == "bind"] == [(5, "K", "h( 1)"), (8, "s", "\'\'\'\nimport y\n\'\'\'")]
    assert [r[0] for r in rows if r[0] not in ("alias", "bind")] == ["error"]
    assert python_rows(text, re.compile("md5"), False) == rows[:1]
