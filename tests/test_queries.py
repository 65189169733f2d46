"""Registered queries against their SQL on the smallest tables, and reports on small inputs."""

import datetime
import math
import os
import shutil
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from saltmarsh.operators import inventory as inv
from saltmarsh.operators import quality
from saltmarsh.sources.tables import (
    read_batches_json, read_findings_json, rejected_batches, write_findings, write_report,
)
from saltmarsh.sources.tables import append_accuracy_log
from saltmarsh.streaming import ingest

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# every query with SQL; those of the training-data subpackage have tests of their own
WITH_SQL = sorted(n for n in entry_point.oracle_sql() if not n.startswith("op") and n != "pipeline")

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if hasattr(value, "isoformat") else value


@needs_data
@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    got = entry_point.queries()[name](spark, FOLDER)
    names = sorted(got.columns)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    want = [tuple(plain(row[found.index(c)]) for c in names) for row in cursor.fetchall()]
    rows = [tuple(plain(row[c]) for c in names) for row in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


@needs_data
def test_entry_returns_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_inventory_of_stored_labels(spark):
    rows = spark.createDataFrame(
        [("s", "RSA-1024", None, None, "CRITICAL", 1), ("s", "RSA-1024", None, None, "HIGH", 2),
         ("s", "AES", 256, "GCM", "INFORMATIONAL", 3), ("s", "AES", 256, "CBC", "LOW", 4)],
        "scan_id string, primitive string, key_size int, mode string, severity string, emit_seq int")
    rows = rows.withColumns({
        "suppressed": F.lit(False), "path": F.lit("a.py"), "line": F.col("emit_seq"),
        "finding_id": F.col("emit_seq").cast("string"), "usage": F.lit("hash"),
        "quantum_status": F.lit("x"), "recommendation": F.lit("y")})
    got = {(r["name"], r["mode"]): (r.bom_ref, r.occurrence_count, r.max_severity)
           for r in inv.build_components(inv.occurrences(rows)).collect()}
    assert got == {
        ("RSA-1024", None): ("crypto-asset/rsa-1024", 2, "CRITICAL"),
        ("AES", "GCM"): ("crypto-asset/aes", 1, "INFO"), ("AES", "CBC"): ("crypto-asset/aes", 1, "LOW")}


def test_accuracy_without_anything_to_find(spark):
    empty = spark.createDataFrame([], "path string, rule_id string")
    score = quality.accuracy(quality.match_expected(empty, empty)).first()
    assert (score.precision, score.recall, score.f1) == (1.0, 1.0, 1.0)


def test_findings_json_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"repoId": "r", "language": "python", "findings": [{"id": "f1", "file": "a.py", "line": 3, '
        '"primitive": "RSA", "keySize": 2048, "context": {"usageType": "signature", "imports": ["x"]}}]}')
    rows = read_findings_json(spark, str(tmp_path / "in"))
    assert rows.select("repoId", "id", "primitive", "keySize", "context.usageType").first() == (
        "r", "f1", "RSA", 2048, "signature")
    (tmp_path / "in" / "b.json").write_text('{"repoId": "r"}')
    (tmp_path / "in" / "c.json").write_text('{"repoId": "q", "findings": 7}')
    assert read_findings_json(spark, str(tmp_path / "in")).count() == 1
    rejected = rejected_batches(read_batches_json(spark, str(tmp_path / "in"))).collect()
    assert len(rejected) == 2 and {r.reason for r in rejected} == {"findings must be an array"}
    found = spark.createDataFrame(
        [("s1", "a.py", "High", "Safe", "python", False)],
        "scan_id string, path string, severity string, quantum_risk string, language string, suppressed boolean")
    write_report(found, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).filter("metric = 'active_findings'").first().n == 1
    write_findings(found, str(tmp_path / "stored"))
    write_findings(found, str(tmp_path / "stored"))
    assert spark.read.parquet(str(tmp_path / "stored")).count() == 2


def stream_of(spark, folder, schema, *batches):
    """Each batch as a file of its own, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/.new")
        (part,) = (f for f in os.listdir(f"{folder}/.new") if f.endswith(".parquet"))
        n = len([f for f in os.listdir(folder) if f.endswith(".parquet")])
        os.rename(f"{folder}/.new/{part}", f"{folder}/{n:03}.parquet")
        shutil.rmtree(f"{folder}/.new")
        time.sleep(0.05)
    return ingest.replay(spark, folder, schema, 1)


@pytest.mark.parametrize("idle_ms", [1, 86_400_000])
def test_metadata_is_latched(spark, tmp_path, idle_ms):
    schema = "scan_id string, repo_id string, language string, seq long"
    (tmp_path / "in").mkdir()
    stream = stream_of(spark, str(tmp_path / "in"), schema, [("s", "r2", "", 3)], [("s", "r1", "python", 1), ("x", None, None, None)],
                       [("s", "", None, 2)], [("t", "", "", 4), ("u", None, "js", 5), ("u", "r", "py", 5)])
    states = ingest.latch_metadata(stream, idle_ms=idle_ms, slack="0 seconds")
    ingest.store_lives(states, str(tmp_path / "out"), str(tmp_path / "log"), "scan_id").awaitTermination()
    lives = ingest.stored_states(spark, str(tmp_path / "out"), states.schema)
    assert lives.where("scan_id = 's'").count() == (1 if idle_ms > 1 else lives.where("scan_id = 's'").count())
    got = {r.scan_id: (r.repo_id, r.language) for r in ingest.merge_latched(lives).collect()}
    assert got["s"] == ("r2", "python") and got["t"] == (None, None) and got["u"][0] == "r" and set(got) == {"s", "t", "u"}


def test_batches_out_of_order_give_the_current_state(spark, tmp_path):
    schema = "scan_id string, status string, ts timestamp, event_id long"
    at = lambda n: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=n)
    rows = lambda *events: [(s, status, at(n), n) for s, status, n in events]
    (tmp_path / "in").mkdir()
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run(*batches):
        stream = stream_of(spark, str(tmp_path / "in"), schema, *batches)
        states = ingest.scan_status(stream, linger_ms=1, slack="0 seconds")
        ingest.store_lives(states, out, log, "scan_id").awaitTermination()
        return {r.scan_id: (r.status, r.events) for r in ingest.stored_states(spark, out, states.schema, ingest.merge_status).collect()}

    assert run(rows(("a", "FAILED", 3)), rows(("a", "PENDING", 1), ("b", "PENDING", 2)), rows(("b", "NONE", 0))) == {
        "a": ("FAILED", 2), "b": ("PENDING", 2)}
    # the stream goes on where it stopped, also for a scan whose state a timer has ended
    assert run(rows(("a", "RUNNING", 2)), rows(("b", "DONE", 9), ("c", None, 4))) == {"a": ("FAILED", 3), "b": ("DONE", 3), "c": (None, 1)}
    states = [os.path.join(d, f) for d, _, files in os.walk(f"{log}/state") for f in files]
    assert states


def test_a_batch_that_runs_twice_stores_once(spark, tmp_path):
    schema = "finding_id long, ts timestamp"
    for first in (30, 0, 20, 10):
        spark.range(first, first + 12).selectExpr("id AS finding_id", "timestamp_seconds(id * 7200) AS ts").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    out, log = str(tmp_path / "out"), tmp_path / "log"
    assert ingest.stored_findings(spark, out, schema).count() == 0
    ingest.ingest_findings(ingest.replay(spark, str(tmp_path / "in"), schema, 1), out, str(log), "finding_id").awaitTermination()
    rows = ingest.stored_findings(spark, out, schema, ingest.first_of("finding_id"))
    assert sorted(r.finding_id for r in rows.collect()) == list(range(42))
    stored = ingest.stored_findings(spark, out, schema).count()
    # the last batch was written, but its commit was lost
    os.remove(max((log / "commits").glob("[0-9]*"), key=lambda f: int(f.name)))
    for crc in (log / "commits").glob(".*.crc"):
        crc.unlink()
    ingest.ingest_findings(ingest.replay(spark, str(tmp_path / "in"), schema, 1), out, str(log), "finding_id").awaitTermination()
    assert ingest.stored_findings(spark, out, schema).count() == stored == 48


def test_rewrites_touch_what_changes_alone(spark, tmp_path):
    from saltmarsh.operators.fleet import resolve_stored
    from saltmarsh.sources.keyed import upsert_stored

    path = str(tmp_path / "t")
    schema = "scan_id string, finding_id string, status string, tags array<string>"
    rows = [(f"s{i % 4}", f"f{i}", "OPEN", ["x"] if i % 2 else None) for i in range(40)]
    spark.createDataFrame(rows, schema).write.partitionBy("scan_id").parquet(path)
    times = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = times()
    ids = spark.createDataFrame([("s1", "f1"), ("s1", "f1"), ("s2", "unknown"), ("s9", "f0")], "scan_id string, finding_id string")
    resolve_stored(spark, path, schema, ids)
    after = times()
    assert {f for f in before if before[f] == after.get(f)} == {f for f in before if "scan_id=s1" not in f}
    got = {r.finding_id: r.status for r in spark.read.schema(schema).parquet(path).collect()}
    assert got == {f"f{i}": "RESOLVED" if i == 1 else "OPEN" for i in range(40)}
    resolve_stored(spark, path, schema, ids)
    assert times() == after

    path = str(tmp_path / "u")
    schema = "k long, v string, at long"
    batches = [[(1, "a", 1), (2, "b", 5), (None, "n", 1)], [(1, "late", 0), (3, "c", 1)], [(2, "newer", 6), (None, "m", 2)], []]
    for order in (batches, batches[::-1], batches + batches[:1]):
        for batch in order:
            upsert_stored(spark, path, schema, spark.createDataFrame(batch, schema), ["k"], ["at"], buckets=4)
        got = {(r.k, r.v, r.at) for r in spark.read.schema(schema).parquet(path).collect()}
        assert got == {(1, "a", 1), (2, "newer", 6), (3, "c", 1), (None, "m", 2)}


def test_accuracy_history_grows(spark, tmp_path):
    row = spark.createDataFrame([(1, 0, 0, 1.0)], "tp long, fp long, fn long, f1 double")
    append_accuracy_log(row, str(tmp_path / "log"))
    append_accuracy_log(row, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_document_parts_hold_every_occurrence(spark, tmp_path):
    from saltmarsh.sources.tables import write_cbom

    rows = spark.range(25).select(
        F.lit("s").alias("scan_id"), F.lit("r").alias("repo_id"), F.lit("RSA").alias("primitive"),
        F.lit(2048).alias("key_size"), F.lit(None).cast("string").alias("mode"), F.lit("HIGH").alias("severity"),
        F.col("id").alias("emit_seq"), F.lit(False).alias("suppressed"), F.lit("a.py").alias("path"),
        F.col("id").cast("int").alias("line"), F.col("id").cast("string").alias("finding_id"),
        F.lit("x").alias("usage"), F.lit("y").alias("quantum_status"), F.lit("z").alias("recommendation"))
    occ = inv.occurrences(rows)
    scans = spark.createDataFrame([("s", "r", 1, "CBOM-v1")], "scan_id string, repo_id string, version int, version_label string")
    scans = scans.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    parts = inv.cbom_parts(scans, inv.build_components(occ), occ, chunk=10)
    write_cbom(parts, str(tmp_path / "cbom"))
    written = spark.read.json(str(tmp_path / "cbom"))
    assert {r.part: r["count"] for r in written.groupBy("part").count().collect()} == {
        "header": 1, "component": 1, "occurrences": 3}
    assert written.select(F.explode("occurrences.items").alias("i")).select("i.line").distinct().count() == 25


@needs_data
@pytest.mark.parametrize("name", ["x15_x18_call_sites_of_every_kind", "x16_x17_j01_names_of_every_kind"])
def test_every_kind_of_python_file_is_read(spark, name):
    kinds = {int(r.scan_id) % 24 for r in entry_point.queries()[name](spark, FOLDER).select("scan_id").distinct().collect()}
    # src/broken does not parse, so it gives nothing but a reason
    assert kinds == {0, 1, 2, 3, 16, 17}


def test_reports_are_stored_packed_and_whole(spark, tmp_path):
    rows = spark.range(5000).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("scan_id"), F.concat(F.lit("f"), "id").alias("finding_id"),
        F.when(F.col("id") % 2 == 0, "High").otherwise("Low").alias("severity"), F.lit("Safe").alias("quantum_risk"),
        F.lit("python").alias("language"), (F.col("id") % 5 == 0).alias("suppressed"),
        F.lit("line one\nline \"two\" é").alias("recommendation"), F.col("id").alias("emit_seq"))
    write_report(rows, str(tmp_path / "r"))
    stored = spark.read.schema(rows.drop("emit_seq").schema).json(str(tmp_path / "r" / "findings"))
    assert stored.exceptAll(rows.drop("emit_seq")).isEmpty() and stored.count() == 5000
    size = sum(f.stat().st_size for f in (tmp_path / "r" / "findings").glob("part-*"))
    plain_size = rows.drop("emit_seq").agg(F.sum(F.length(F.to_json(F.struct("*", )))).alias("n")).first().n
    assert size * 5 < plain_size
