"""Structured Streaming forms of ingest, scan status and fleet counters.

Findings go to one table partitioned by micro-batch, which a batch that runs again replaces. Status and latched metadata are kept per
scan in the state store by ``applyInPandasWithState``; a timer ends the state of a scan some time after it has finished or fallen
silent, so the state holds the scans at work and no others. Counters are an aggregate in update mode, as large as there are groups.

What ends in the state store is not lost: a row that arrives after its scan's state has ended opens another *life* of that scan. Each life is a row
of its own in the stored result, told apart by ``opened``, and a read folds the lives of a scan. So late rows count, in whatever
order they come.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from saltmarsh.sources.keyed import read_stored, replace_partitions, upsert_stored

Step = Callable[[DataFrame], DataFrame]
BATCH = "batch"
#: How long the state of a finished scan, and of one that has fallen silent, is kept after its last row arrived.
LINGER_MS, IDLE_MS = 3_600_000, 86_400_000
#: How far the clock of a driver may fall behind that of the one before it.
CLOCK_SLACK = "10 minutes"


# --- findings (R01) -----------------------------------------------------------
def ingest_findings(stream: DataFrame, out: str, checkpoint: str, dedupe_on: str | None = None) -> StreamingQuery:
    """Store every arriving finding in one table, partitioned by micro-batch; a batch that runs again replaces its own rows.

    A finding sent twice is stored twice unless ``dedupe_on`` names a key: then a micro-batch stores a key once, and a
    read with ``first_of(dedupe_on)`` gives every key once, however late a row or its repeat arrives.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if dedupe_on is None else batch.dropDuplicates([dedupe_on])
        replace_partitions(rows.withColumn(BATCH, F.lit(batch_id).cast("bigint")), out, [BATCH])

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def stored_findings(spark: SparkSession, out: str, schema, merge: Step | None = None) -> DataFrame:
    """What all batches so far have stored; ``merge`` sees the column ``batch`` of each row."""
    kept = spark.createDataFrame([], schema).withColumn(BATCH, F.lit(0).cast("bigint")).schema
    rows = read_stored(spark, out, kept)
    return rows.drop(BATCH) if merge is None else merge(rows)


def first_of(key: str) -> Step:
    """Merge that keeps the row of each key's earliest batch."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (key, BATCH)]
        return rows.groupBy(key).agg(F.min_by(F.struct(*rest), BATCH).alias("r")).select(key, "r.*")

    return merge


# --- state per scan -------------------------------------------------------------
def keep_state(
    stream: DataFrame, key: str, fields: str, fold: Callable[[dict | None, pd.DataFrame], dict], finished: Callable[[dict], bool],
    linger_ms: int = LINGER_MS, idle_ms: int = IDLE_MS, slack: str = CLOCK_SLACK,
) -> DataFrame:
    """One row per scan and micro-batch that touched it: ``key``, ``fields``, ``opened`` and ``version``.

    ``fold(state, rows)`` gives the new state, a dict of ``fields``, from the old one (None at first) and the rows of one micro-batch. ``opened`` tells the
    lives of a scan apart, ``version`` counts the rows of a life. The state ends ``linger_ms`` after the scan was ``finished``, else
    after ``idle_ms`` without a row. The timers run on the time of arrival, which is the watermark here, so no row is discarded for
    what its own time says.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def step(group: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        life = json.loads(held.get[0]) if held.exists else {"opened": None, "version": 0, "state": None}
        arrived = 0
        for rows in parts:
            arrived = max(arrived, int(rows["_arrived"].to_numpy().max().astype("datetime64[ms]").astype("int64")))
            if life["opened"] is None:
                # an event is in one life only, so its number names the life
                life["opened"] = int(rows["_event"].to_numpy().min())
            life["state"] = fold(life["state"], rows)
            life["version"] += len(rows)
        held.update((json.dumps(life),))
        stay = linger_ms if finished(life["state"]) else idle_ms
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, arrived + stay))
        row = {key: group[0], **{n: life["state"][n] for n in names}, "opened": life["opened"], "version": life["version"]}
        yield pd.DataFrame([list(row.values())], columns=list(row), dtype=object)

    kept = f"{key} string, {fields}, opened bigint, version bigint"
    timed = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", slack)
    return timed.groupBy(key).applyInPandasWithState(step, kept, "life string", "update", GroupStateTimeout.EventTimeTimeout)


def store_lives(states: DataFrame, out: str, checkpoint: str, key: str) -> StreamingQuery:
    """Keep the newest row of each life in a stored table; a batch that runs again changes nothing."""
    schema = states.schema

    def write(batch: DataFrame, _: int) -> None:
        upsert_stored(batch.sparkSession, out, schema, batch, [key, "opened"], ["version"])

    return states.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(write).trigger(availableNow=True).start()


def _newer(old: list | None, new: list) -> bool:
    """Whether ``new`` comes after ``old`` in a sequence; an unknown place comes first."""
    rank = lambda x: [(v is not None, v or 0) for v in x]
    return old is None or rank(new) >= rank(old)


# --- latched metadata (R01) -----------------------------------------------------
LATCHED = "repo_id string, repo_seq bigint, language string, language_seq bigint"


def latch_metadata(stream: DataFrame, idle_ms: int = IDLE_MS, slack: str = CLOCK_SLACK) -> DataFrame:
    """Last non-empty repository and language of each scan, and where in the sequence they were said.

    ``stream`` holds ``scan_id, seq, repo_id, language``; ``seq`` numbers the batches of all scans.
    """
    def fold(state: dict | None, rows: pd.DataFrame) -> dict:
        state = dict(state or {"repo_id": None, "repo_seq": None, "language": None, "language_seq": None})
        for field, at in (("repo_id", "repo_seq"), ("language", "language_seq")):
            said = rows[rows[field].notna() & (rows[field].str.len() > 0)]
            if len(said):
                last = said.loc[said["_event"].idxmax()]
                if _newer([state[at]], [int(last["_event"])]):
                    state |= {field: last[field], at: int(last["_event"])}
        return state

    named = stream.select("scan_id", F.col("seq").cast("bigint").alias("_event"), "repo_id", "language").where("_event IS NOT NULL")
    return keep_state(named, "scan_id", LATCHED, fold, lambda _: False, idle_ms, idle_ms, slack)


def merge_latched(lives: DataFrame) -> DataFrame:
    return lives.groupBy("scan_id").agg(
        F.max_by("repo_id", "repo_seq").alias("repo_id"), F.max_by("language", "language_seq").alias("language"))


# --- status (R02) -----------------------------------------------------------------
STATUS = "status string, since_us bigint, event_id bigint"
FINISHED = ("COMPLETED", "FAILED")


def scan_status(events: DataFrame, linger_ms: int = LINGER_MS, idle_ms: int = IDLE_MS, slack: str = CLOCK_SLACK) -> DataFrame:
    """Status of every scan by its newest event (by time, then number), as a state per scan.

    ``events`` holds ``scan_id, status, ts, event_id``; an event without a number is not one.
    """
    def fold(state: dict | None, rows: pd.DataFrame) -> dict:
        state = state or {"status": None, "since_us": None, "event_id": None}
        # the newest row alone is looked at; arrays, as a frame that is sorted costs more than most scans have rows
        us, event = rows["_us"].to_numpy(), rows["_event"].to_numpy()
        unknown = pd.isna(us)
        if unknown.any():
            us = np.where(unknown, -np.inf, us.astype("float64"))
        last = np.lexsort((event, us))[-1]
        place = [None if unknown[last] else int(us[last]), int(event[last])]
        if _newer(None if state["event_id"] is None else [state["since_us"], state["event_id"]], place):
            status = rows["status"].iat[last]
            state = {"status": None if pd.isna(status) else status, "since_us": place[0], "event_id": place[1]}
        return state

    numbered = events.select(
        "scan_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"), F.col("event_id").cast("bigint").alias("_event"))
    return keep_state(numbered.where("_event IS NOT NULL"), "scan_id", STATUS, fold, lambda s: s["status"] in FINISHED, linger_ms, idle_ms, slack)


def merge_status(lives: DataFrame) -> DataFrame:
    """``scan_id, status, since, events`` over all lives."""
    newest = F.struct("since_us", "event_id")
    return lives.groupBy("scan_id").agg(
        F.max_by("status", newest).alias("status"), F.timestamp_micros(F.max("since_us")).alias("since"), F.sum("version").alias("events"))


# --- counters (R03) ---------------------------------------------------------------
COUNTERS = ("findings", "critical", "quantum")


def fleet_counters(findings: DataFrame, *by: str) -> DataFrame:
    """Counts of findings."""
    return findings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.count_if(F.col("quantum_vulnerable")).alias("quantum"))


def store_counters(findings: DataFrame, out: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Running counts in update mode; the state store holds one row per group. Counts only grow, so the greater row is the newer."""
    counted = fleet_counters(findings, *by)
    schema = counted.schema

    def write(batch: DataFrame, _: int) -> None:
        upsert_stored(batch.sparkSession, out, schema, batch, by, ["findings"])

    return counted.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(write).trigger(availableNow=True).start()


def stored_states(spark: SparkSession, out: str, schema, merge: Step | None = None) -> DataFrame:
    """What ``store_lives`` or ``store_counters`` keeps, folded by ``merge``."""
    kept = spark.createDataFrame([], schema).withColumn("bucket", F.lit(0)).schema
    rows = read_stored(spark, out, kept).drop("bucket")
    return rows if merge is None else merge(rows)


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder (or file pattern) as a stream; without a limit one micro-batch takes all files that are there."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
