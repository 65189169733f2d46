"""Path rules of an allow-list against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators.consolidate import apply_suppressions

RULES, ALGOS, PARTS = ["md5-hashing", "rsa-key", "7"], ["MD5", "RSA-1024", "7"], ["src", "lib", "a", "b"]


def plain(finding, rules, strict):
    path, line, rule, algo, mark, scan = finding
    rel = path.lower().split("/")
    for kind, r, place, at, sub, seq, s in sorted(rules, key=lambda x: x[5]):
        if s != scan:
            continue
        if kind == "fingerprint":
            if r == mark:
                return seq
            continue
        if kind == "rule":
            if r.lower() in (rule.lower(), algo.lower(), "*"):
                return seq
            continue
        steps = place.lower().split("/")
        at_place = rel[-len(steps):] == steps if strict else rel[-1] == steps[-1]
        wanted = str(at) if at is not None else sub
        if at_place and r.lower() in (rule.lower(), algo.lower(), "*") and (wanted is None or wanted in (str(line), mark, algo.lower())):
            return seq
    return None


@pytest.mark.parametrize("strict", [False, True])
def test_path_rules_equal_a_plain_search(spark, strict):
    rng = random.Random(4)
    path = lambda: "/".join([*(rng.choice(PARTS) for _ in range(rng.randint(0, 4))), rng.choice(["x.py", "Y.js", "z"])])
    found = [(path(), rng.randint(1, 4), rng.choice(RULES), rng.choice(ALGOS), f"{i:016x}" if i % 5 else f"{i:016d}", rng.choice("st")) for i in range(400)]
    found = list({(f[5], f[0], f[1], f[2]): f for f in found}.values())
    rules = []
    for seq in range(60):
        kind = rng.choice(["path"] * 8 + ["fingerprint", "rule"])
        some = rng.choice(found)
        at = rng.choice([None, None, some[1]])
        sub = rng.choice([None, some[4], some[3].lower()]) if at is None else None
        name = some[4] if kind == "fingerprint" else "gone-rule" if kind == "rule" else rng.choice([*RULES, "*", "md5"])
        rules.append((kind, name, path() if kind == "path" else None, at if kind == "path" else None, sub if kind == "path" else None, seq, rng.choice("st")))
    df = spark.createDataFrame(found, "path string, line int, rule_id string, algorithm string, fingerprint string, scan_id string").withColumn(
        "repo_id", F.lit("r")).withColumn("snippet", F.lit(""))
    listed = spark.createDataFrame(rules, "kind string, rule_id string, path string, line int, sub string, rule_seq int, scan_id string")
    got = {(r.scan_id, r.path, r.line, r.rule_id): r.suppressed for r in apply_suppressions(df, listed, strict).collect()}
    want = {(f[5], f[0], f[1], f[2]): plain(f, rules, strict) is not None for f in found}
    assert got == want and 10 < sum(want.values()) < len(want)
