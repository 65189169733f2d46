"""Joins on keys of which one holds a third of all rows."""

from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import consolidate, risk
from saltmarsh.operators import inventory as inv
from saltmarsh.operators.skew import PARTS, heavy_keys, split_join


@contextmanager
def shuffled(spark, partitions=16):
    """No broadcasts but those asked for, no merging of small partitions."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def spread(df):
    """Rows of the tasks that have some, the largest first."""
    return sorted(Counter(r.task for r in df.select("*", F.spark_partition_id().alias("task")).collect()).values(), reverse=True)


def even(df):
    tasks = spread(df)
    return len(tasks) > 8 and tasks[0] < 3 * tasks[len(tasks) // 2]


@pytest.fixture(scope="module")
def hot(spark):
    return spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"),
        "id", F.array("id").alias("more"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_split_join_is_a_join(spark, hot, how):
    few = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("k4999", 4), (None, 5), ("unknown", 6)], "key string, value int")
    with shuffled(spark):
        for many, side in ((hot, few), (hot.limit(0), few), (hot, few.limit(0)), (hot.unionAll(hot.limit(50)), few)):
            got, want = split_join(many, side, ["key"], how), many.join(side, ["key"], how)
            assert got.columns == (many.columns + (["value"] if how in ("inner", "left") else []))
            want = want.select(*got.columns)
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        if how in ("inner", "left"):
            assert even(split_join(hot.where("key = 'hot'"), few, ["key"], how))


def test_few_keys_are_heavy(spark, hot):
    heavy = heavy_keys(hot, ["key"]).collect()
    assert [r.key for r in heavy] == ["hot"] and PARTS // 3 <= heavy[0].pieces <= PARTS
    assert heavy_keys(hot.limit(0), ["key"]).count() == 0
    with pytest.raises(ValueError, match="only inner"):
        split_join(hot, hot, ["key"], "full")


def findings(spark, n=12_000):
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.when(hot, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 400)).alias("scan_id"), F.lit("r").alias("repo_id"),
        F.concat(F.lit("src/"), F.when(hot, "index.js").otherwise(F.concat(F.lit("f"), F.col("id") % 700, F.lit(".js")))).alias("path"),
        F.col("id").cast("int").alias("line"), F.when(hot, "sca-npm-md5").otherwise("md5-hashing").alias("rule_id"),
        F.lit("MD5").alias("algorithm"), F.when(F.col("id") % 6 == 0, "manifest").otherwise("javascript").alias("language"),
        F.lit("x").alias("snippet"), F.lit("Likely").alias("confidence"), F.concat(F.lit("f"), "id").alias("fingerprint"))


def test_correlation_and_allow_list_of_one_large_scan(spark):
    rows = findings(spark)
    with shuffled(spark):
        got = consolidate.correlate_dependencies(rows)
        assert got.count() == 12_000 and got.where("scan_id = 'big' AND confidence = 'Confirmed'").count() == 4000
        assert even(got)
        rules = spark.createDataFrame(
            [("rule", "sca-npm-md5", None, None, None, 1), ("path", "*", "index.js", None, None, 2)],
            "kind string, rule_id string, path string, line int, sub string, rule_seq int")
        got = consolidate.apply_suppressions(rows, rules)
        assert got.where("suppressed").count() == 4000 and even(got)


def test_importance_of_one_large_repository(spark, hot):
    rows = hot.withColumnRenamed("key", "repo_id")
    repos = spark.createDataFrame([("hot", "Critical"), ("k1", None)], "repo_id string, importance string")
    with shuffled(spark):
        got = risk.with_importance(rows.where("repo_id = 'hot'"), repos)
        assert even(got) and {r.importance for r in got.select("importance").distinct().collect()} == {"Critical"}
        assert risk.with_importance(rows, repos).count() == rows.count()


def test_a_diff_reads_the_places_once(spark, tmp_path):
    """Each place meets its scan once for both sides of a pair; a repeated scan stands beside every row of its predecessor."""
    schema = "scan_id string, name string, key_size int, mode string, bom_ref string, file string, line int, usage string, severity string, emit_seq int"
    rows = [(s, n, None, "ECB", f"crypto-asset/{n}", f, 1, None, "High", i) for i, (s, n, f) in enumerate(
        [("a", "aes", "x"), ("a", "aes", "x"), ("a", "aes", "y"), ("a", "des", "x"), ("b", "aes", "x"), ("b", "aes", "z"), ("b", "rsa", "x")])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "occ"))
    occ = spark.read.parquet(str(tmp_path / "occ"))
    components = inv.build_components(occ).localCheckpoint()
    scans = spark.createDataFrame([("a", None), ("b", "a"), ("b", "a"), (None, "a")], "scan_id string, previous_scan_id string")
    diff = inv.diff_inventories(components, occ, scans)
    got = Counter((r.scan_id, r["name"], r.status, r.changes, r.added_occurrences, r.removed_occurrences) for r in diff.collect())
    first = {("a", n, "added", "", None, None): 1 for n in ("aes", "des")}
    # the pair of b is there twice, so either side has two rows, and each place counts for both
    second = {("b", "aes", "changed", "occurrences", 2, 2): 4, ("b", "rsa", "added", "", None, None): 2, ("b", "des", "removed", "", None, None): 2}
    unnamed = {(None, n, "removed", "", None, None): 1 for n in ("aes", "des")}
    assert got == Counter(first | second | unnamed)
    assert str(diff._jdf.queryExecution().optimizedPlan()).count("Relation [") == 1
