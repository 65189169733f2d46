"""Streaming queries: the given tables replayed as streams, compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.plans.catalog import Tables, query
from saltmarsh.session import shared_folder
from saltmarsh.streaming import ingest

FILES, FILES_PER_TRIGGER = 12, 3
#: So short that the state of a scan ends between two micro-batches.
SHORT_MS = 1


def _work_dir(t: Tables) -> str:
    """A new folder under the shared folder."""
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _events(t: Tables, home: str) -> DataFrame:
    """The events as many files out of time order, replayed in several micro-batches."""
    t.events.repartition(FILES, F.xxhash64("event_id")).write.parquet(f"{home}/events")
    return ingest.replay(t.spark, f"{home}/events", t.events.schema, FILES_PER_TRIGGER)


STATUS_OF = {"signup": "PENDING", "view": "RUNNING", "click": "RUNNING", "purchase": "COMPLETED", "error": "FAILED"}


def _status():
    chain = None
    for event, status in STATUS_OF.items():
        own = F.col("event_type") == event
        chain = F.when(own, status) if chain is None else chain.when(own, status)
    return chain


_cases = " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in STATUS_OF.items())


@query("r01_ingest_findings", """
SELECT CAST(user_id AS VARCHAR) AS scan_id, count(*) AS findings FROM events GROUP BY user_id""")
def _(t: Tables):
    """Store every arriving row, then count what is stored."""
    home = _work_dir(t)
    stream = _events(t, home).select(
        F.col("user_id").cast("string").alias("scan_id"), F.col("event_id").alias("finding_id"), "ts")
    ingest.ingest_findings(stream, f"{home}/out", f"{home}/log").awaitTermination()
    rows = ingest.stored_findings(t.spark, f"{home}/out", stream.schema)
    return rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"))


@query("r01_ingest_without_repeats", """
SELECT CAST(user_id AS VARCHAR) AS scan_id, count(*) AS findings, max(CAST(ts AS TIMESTAMP)) AS newest FROM events GROUP BY user_id""")
def _(t: Tables):
    """Every row arrives twice, in different files out of order; one of each is kept and none is lost for being late."""
    home = _work_dir(t)
    twice = t.events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    twice.repartition(FILES, F.xxhash64("event_id", "copy")).drop("copy").write.parquet(f"{home}/events")
    stream = ingest.replay(t.spark, f"{home}/events", t.events.schema, FILES_PER_TRIGGER).select(
        F.col("user_id").cast("string").alias("scan_id"), F.col("event_id").alias("finding_id"),
        F.col("ts").cast("timestamp").alias("ts"))
    ingest.ingest_findings(stream, f"{home}/out", f"{home}/log", dedupe_on="finding_id").awaitTermination()
    rows = ingest.stored_findings(t.spark, f"{home}/out", stream.schema, ingest.first_of("finding_id"))
    return rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"), F.max("ts").cast("timestamp_ntz").alias("newest"))


@query("r01_latched_metadata", """
SELECT CAST(user_id AS VARCHAR) AS scan_id,
  arg_max(event_type, event_id) FILTER (event_type <> 'view') AS repo_id,
  arg_max(CASE WHEN event_id % 3 = 0 THEN 'python' ELSE 'js' END, event_id) FILTER (event_id % 2 = 0) AS language
FROM events GROUP BY user_id""")
def _(t: Tables):
    """Later batches may leave repo or language empty; the last known value stays in the scan's state, which ends between some batches."""
    home = _work_dir(t)
    stream = _events(t, home).select(
        F.col("user_id").cast("string").alias("scan_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("repo_id"),
        F.when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 3 == 0, "python").otherwise("js")).alias("language"))
    states = ingest.latch_metadata(stream, idle_ms=SHORT_MS, slack="0 seconds")
    ingest.store_lives(states, f"{home}/out", f"{home}/log", "scan_id").awaitTermination()
    return ingest.stored_states(t.spark, f"{home}/out", states.schema, ingest.merge_latched)


@query("r02_scan_status", f"""
SELECT CAST(user_id AS VARCHAR) AS scan_id, arg_max(CASE event_type {_cases} END, (ts, event_id)) AS status, max(ts) AS since,
  count(*) AS events FROM events GROUP BY user_id""")
def _(t: Tables):
    """Out of order over several triggers, the state of finished scans ending at once; the stream stops half way and goes on."""
    home = _work_dir(t)
    schema = t.events.schema
    half = t.events.where("event_id % 2 = 0"), t.events.where("event_id % 2 <> 0")
    for part in half:
        part.repartition(FILES // 2, F.xxhash64("event_id")).write.mode("append").parquet(f"{home}/arriving")
        rows = ingest.replay(t.spark, f"{home}/arriving", schema, FILES_PER_TRIGGER).select(
            F.col("user_id").cast("string").alias("scan_id"), _status().alias("status"), "ts", "event_id")
        states = ingest.scan_status(rows, linger_ms=SHORT_MS, slack="0 seconds")
        ingest.store_lives(states, f"{home}/out", f"{home}/log", "scan_id").awaitTermination()
    found = ingest.stored_states(t.spark, f"{home}/out", states.schema, ingest.merge_status)
    return found.withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("r03_fleet_counters", """
SELECT event_type, count(*) AS findings, count(*) FILTER (value > 20) AS critical,
  count(*) FILTER (user_id % 2 = 0) AS quantum FROM events GROUP BY event_type""")
def _(t: Tables):
    home = _work_dir(t)
    rows = _events(t, home).select(
        "event_type", F.when(F.col("value") > 20, "Critical").otherwise("Low").alias("severity"),
        (F.col("user_id") % 2 == 0).alias("quantum_vulnerable"))
    ingest.store_counters(rows, f"{home}/out", f"{home}/log", "event_type").awaitTermination()
    schema = "event_type string, findings bigint, critical bigint, quantum bigint"
    return ingest.stored_states(t.spark, f"{home}/out", schema)
