"""Queries that write to files, read back and compare: trees, ignore files and report sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.operators import fleet
from saltmarsh.plans.catalog import Tables, query
from saltmarsh.plans.facts import finding_facts, with_ctes
from saltmarsh.session import shared_folder
from saltmarsh.sources import tables, tree
from saltmarsh.sources.corpus import read_corpus, read_ignore_rules
from saltmarsh.sources.keyed import upsert_stored


def _new_folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# names that a listing must not lose, and folders that must not be entered
_PLACES = {
    0: "concat('d', doc_id % 9, '/', doc_id, '/.env')", 1: "concat('pkg', doc_id % 9, '/m', doc_id, '/__init__.py')",
    2: "concat('_lib/_f', doc_id, '.py')", 3: "concat('.config/a b+c/f', doc_id, '.js')",
    4: "concat('app/node_modules/f', doc_id, '.js')", 5: "concat('src/deep/er/f', doc_id, '.py')",
    6: "concat('Dockerfile.', doc_id)", 7: "concat('notes/f', doc_id, '.txt')", 8: "concat('build/f', doc_id, '.py')",
    9: "concat('.hidden-requirements', doc_id, '.md')",
}
_PLACE = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _PLACES.items()) + " END"


def _tree(t: Tables) -> str:
    root = _new_folder(t, "tree")
    tree.write_files(t.wide("documents").selectExpr(f"{_PLACE} AS path", "coalesce(text, '') AS text"), root)
    return root


@query("s01_tree_read_whole", f"""
SELECT {_PLACE} AS path, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 10 NOT IN (4, 8)""")
def _(t: Tables) -> DataFrame:
    """Every document as a file of a tree with hidden names, read back; pruned folders are not entered."""
    return read_corpus(t.spark, _tree(t), "s", "r").select("path", F.sha2("text", 256).alias("digest"))


@query("s04_tree_by_extension", f"""
SELECT {_PLACE} AS path, strlen(coalesce(text, '')) AS n_bytes FROM documents WHERE doc_id % 10 IN (0, 1, 2, 5, 6, 9)""")
def _(t: Tables) -> DataFrame:
    """Only Python sources are asked for; configuration, Dockerfiles and manifests stay."""
    return read_corpus(t.spark, _tree(t), "s", "r", [".py"]).select(
        "path", F.octet_length("text").cast("long").alias("n_bytes"))


@query("s14_ignore_files_of_scans", """
WITH r AS (SELECT o_orderkey, concat('rule-', o_orderkey % 17) AS rule_id, concat('src/f', o_custkey, '.py') AS path,
                  o_orderkey % 40 + 1 AS line FROM orders)
SELECT concat('s', o_orderkey % 20) AS scan_id, rule_id, path, line FROM r""")
def _(t: Tables) -> DataFrame:
    """One ignore file per scan, half of them below the root and one more below those; the rules carry their scan."""
    root = _new_folder(t, "ignore")
    lines = t.orders.select(
        (F.col("o_orderkey") % 20).alias("scan"),
        F.concat(F.lit("rule-"), F.col("o_orderkey") % 17, F.lit("|src/f"), F.col("o_custkey"), F.lit(".py|"),
                 F.col("o_orderkey") % 40 + 1).alias("line"))
    # a fixture: twenty small files of rules
    files = lines.groupBy("scan").agg(F.concat(F.lit("# accepted\n\n"), F.array_join(F.collect_list("line"), "\n")).alias("text"))
    placed = files.select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("s"), F.col("scan"), F.when(F.col("scan") % 2 == 0, "/.ignored").otherwise("/top/.ignored")).alias("path"),
                     "text"),
            F.struct(F.concat(F.lit("s"), F.col("scan"), F.lit("/top/below/.ignored")).alias("path"), F.lit("wrong-rule").alias("text")),
        )).alias("f")).select("f.*")
    tree.write_files(placed, root)
    roots = lines.select(F.concat(F.lit("s"), "scan").alias("scan_id")).distinct().withColumn("root", F.concat(F.lit(f"{root}/"), "scan_id"))
    rules = read_ignore_rules(t.spark, roots, ".ignored")
    return rules.select("scan_id", "rule_id", "path", F.col("line").cast("long").alias("line"))


def _findings(t: Tables) -> DataFrame:
    return finding_facts(t).withColumn("scan_id", F.concat(F.lit("s"), F.pmod(F.col("scan_id").cast("long"), F.lit(16))))


@query("s10_findings_written_twice", """
SELECT concat('s', l_orderkey % 16) AS scan_id, count(*) * 2 AS stored, count(DISTINCT l_partkey % 5) AS rules
FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """Two writes append; the rows of a scan are read back from its folder."""
    out = _new_folder(t, "findings")
    rows = _findings(t).select("scan_id", "finding_id", "rule_id", "severity")
    for _ in range(2):
        tables.write_findings(rows, out)
    stored = t.spark.read.schema(rows.schema).parquet(out)
    return stored.groupBy("scan_id").agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("rule_id").alias("rules"))


def _numbered_findings(t: Tables) -> DataFrame:
    """Findings of sixteen scans, their ids made unique again."""
    found = finding_facts(t).select("scan_id", "finding_id", "severity", "status", "rule_id")
    return found.select(
        F.concat(F.lit("s"), F.pmod(F.col("scan_id").cast("long"), F.lit(16))).alias("scan_id"),
        F.concat_ws("-", "scan_id", "finding_id").alias("finding_id"), "severity", "status", "rule_id")


@query("s10_findings_replaced", """
SELECT concat('s', l_orderkey % 16) AS scan_id, count(*) AS stored FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """All scans are stored, then some of them again: these replace what they had stored."""
    out = _new_folder(t, "findings")
    rows = _numbered_findings(t)
    for part in (rows, rows.where("scan_id in ('s1', 's2', 's15')")):
        tables.replace_findings(part, out)
    return t.spark.read.schema(rows.schema).parquet(out).groupBy("scan_id").agg(F.count(F.lit(1)).alias("stored"))


@query("p45_resolve_stored", with_ctes(["facts"], """
SELECT concat('s', CAST(scan_id AS BIGINT) % 16) AS scan_id, concat(scan_id, '-', finding_id) AS finding_id,
  CASE WHEN severity = 'Low' AND CAST(scan_id AS BIGINT) % 16 < 4 THEN 'RESOLVED' ELSE status END AS status FROM facts f"""))
def _(t: Tables) -> DataFrame:
    """Findings of four scans are marked in the stored table, twice; the other scans are not touched."""
    out = _new_folder(t, "findings")
    rows = _numbered_findings(t)
    tables.replace_findings(rows, out)
    ids = rows.where("severity = 'Low' AND scan_id IN ('s0', 's1', 's2', 's3')").select("scan_id", "finding_id")
    for _ in range(2):
        fleet.resolve_stored(t.spark, out, rows.schema, ids)
    return t.spark.read.schema(rows.schema).parquet(out).select("scan_id", "finding_id", "status")


@query("j17_upsert_stored", """
SELECT o_custkey AS repo_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS scan_id, max(o_orderdate) AS updated_at
FROM orders GROUP BY o_custkey""")
def _(t: Tables) -> DataFrame:
    """Summaries arrive in three batches out of order, one of them twice; the stored table holds the last of each repository."""
    out = _new_folder(t, "summaries")
    rows = t.orders.select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("updated_at"))
    for k in (1, 0, 2, 0):
        upsert_stored(t.spark, out, rows.schema, rows.where(f"scan_id % 3 = {k}"), ["repo_id"], ["updated_at", "scan_id"], buckets=8)
    return t.spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


@query("s11_report_read_back", """
SELECT concat('s', l_orderkey % 16) AS scan_id, count(*) AS findings,
  count(*) FILTER (floor(l_quantity / 10) IN (4, 5)) AS critical, sum(floor(l_linenumber / 2)) AS lines
FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """A report as JSON lines, read back finding by finding."""
    out = _new_folder(t, "report")
    tables.write_report(_findings(t), out)
    stored = t.spark.read.schema("scan_id string, severity string, line int").json(f"{out}/findings")
    return stored.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.sum("line").cast("double").alias("lines"))


@query("s13_accuracy_history", """
WITH c AS (SELECT l_orderkey % 3 AS run, count(*) FILTER (l_returnflag = 'R') AS tp,
  count(*) FILTER (l_returnflag = 'A') AS fp, count(*) FILTER (l_returnflag = 'N') AS fn FROM lineitem GROUP BY 1)
SELECT tp, fp, fn FROM c""")
def _(t: Tables) -> DataFrame:
    """Three runs append one line each to the history."""
    out = _new_folder(t, "history")
    for run in range(3):
        tables.append_accuracy_log(t.lineitem.where(F.col("l_orderkey") % 3 == run).agg(
            *[F.count_if(F.col("l_returnflag") == flag).alias(name) for flag, name in (("R", "tp"), ("A", "fp"), ("N", "fn"))]), out)
    return t.spark.read.schema("tp bigint, fp bigint, fn bigint, timestamp timestamp").json(out).where(
        "timestamp is not null").drop("timestamp")
