"""Findings, rules and expectations in; reports and inventories out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import predicates as p
from saltmarsh.functions.severity import quantum_status, stored_key_size
from saltmarsh.operators.consolidate import summarize
from saltmarsh.schemas import SOURCE_FINDINGS
from saltmarsh.sources.keyed import replace_partitions


# --- in -----------------------------------------------------------------------
def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per finding of a batch. Batches whose findings are not an array are in ``rejected_batches``."""
    keep = [c for c in batches.columns if c != "findings"]
    return batches.select(*keep, F.posexplode("findings").alias("seq", "f")).select(*keep, "seq", "f.*")


def rejected_batches(batches: DataFrame) -> DataFrame:
    """Batches that ``explode_batches`` cannot take, each with the reason."""
    return batches.filter(F.col("findings").isNull()).drop("findings").withColumn(
        "reason", F.lit("findings must be an array"))


def read_findings_json(spark: SparkSession, path: str) -> DataFrame:
    """Scanner output, one JSON document per file."""
    return explode_batches(read_batches_json(spark, path))


def read_batches_json(spark: SparkSession, path: str) -> DataFrame:
    batches = spark.read.schema(SOURCE_FINDINGS).option("multiLine", "true").json(path)
    return batches.withColumn("source_file", F.col("_metadata.file_path"))


def to_finding_rows(found: DataFrame) -> DataFrame:
    """Scanner output as stored rows."""
    return found.select(
        "scan_id",
        F.col("path").alias("file_path"),
        F.nullif(F.col("line"), F.lit(0)).alias("line_number"),
        F.coalesce("algorithm", F.lit("UNKNOWN")).alias("algorithm"),
        F.coalesce("library", F.lit("Standard API")).alias("library"),
        F.col("category").alias("usage"),
        stored_key_size(F.col("key_size"), F.col("algorithm")).alias("key_size"),
        quantum_status(F.col("quantum_risk")).alias("quantum_status"),
        F.upper(F.coalesce("severity", F.lit("Informational"))).alias("severity"),
        F.coalesce("message", "snippet", F.lit("")).alias("description"),
        F.col("recommendation"),
        F.concat_ws(
            "|", F.coalesce("confidence", F.lit("Likely")),
            F.coalesce("detection_method", F.lit("ast"))).alias("confidence"),
        F.coalesce("suppressed", F.lit(False)).alias("suppressed"),
        F.nullif(F.col("suppression_reason"), F.lit("")).alias("suppression_reason"),
    )


def split_confidence(rows: DataFrame) -> DataFrame:
    """Unpack ``confidence|method``."""
    parts = F.split(F.coalesce("confidence", F.lit("Likely|ast")), r"\|")
    return rows.withColumn(
        "detection_method",
        F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.lit("ast")),
    ).withColumn("confidence", F.get(parts, F.lit(0)))


def parse_suppressions(lines: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """Allow-list lines → (kind, rule_id, path, line, sub, rule_seq) rows."""
    keep = [c for c in lines.columns if c not in (line, seq)]
    bare = p.strip(F.substring_index(p.strip(F.col(line)), " #", 1))
    rows = lines.filter(
        (p.strip(F.col(line)) != "") & ~p.strip(F.col(line)).startswith("#")
    ).withColumn("_line", bare)
    text = F.col("_line")
    bars = F.transform(F.split(text, r"\|"), p.strip)
    colons = F.transform(F.split(text, ":"), p.strip)
    third = F.get(bars, F.lit(2))
    at = third.try_cast("int")
    place = p.normalize_path(F.get(bars, F.lit(1)))

    def rule(kind: str, rule_id, path=None, at=None, sub=None) -> Column:
        as_string = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), as_string(rule_id).alias("rule_id"),
            as_string(path).alias("path"),
            (at if at is not None else F.lit(None)).cast("int").alias("line"),
            as_string(sub).alias("sub"),
        )

    # a rule whose third part is empty names nothing
    rows = rows.filter(~((F.size(bars) >= 3) & (third == "")))
    has_bar = text.contains("|")
    pinned = (F.size(colons) == 2) & F.get(colons, F.lit(1)).rlike(r"^\d+$")
    parsed = (
        F.when(has_bar & (F.size(bars) == 2) & (F.get(bars, F.lit(0)) == "FINGERPRINT"),
               F.array(rule("fingerprint", F.get(bars, F.lit(1)))))
        .when(has_bar & (F.size(bars) == 2), F.array(rule("path", F.get(bars, F.lit(0)), place)))
        .when(has_bar & at.isNotNull(), F.array(rule("path", F.get(bars, F.lit(0)), place, at)))
        .when(has_bar, F.array(rule("path", F.get(bars, F.lit(0)), place, None, third)))
        .when(text.contains(":") & pinned, F.array(rule(
            "path", "*", p.normalize_path(F.get(colons, F.lit(0))),
            F.get(colons, F.lit(1)).try_cast("int"))))
        .when(text.contains(":"), F.array(rule("fingerprint", text)))
        .when(text.rlike(r"[/\\.]"), F.array(rule("path", "*", p.normalize_path(text))))
        .otherwise(F.array(
            rule("rule", text), rule("fingerprint", text),
            rule("path", "*", p.normalize_path(text))))
    )
    return rows.select(
        *keep, F.col(seq).alias("_seq"), F.posexplode(parsed).alias("_n", "r")
    ).select(
        *keep, "r.*", F.struct(F.col("_seq").alias("seq"), F.col("_n").alias("n")).alias("rule_seq")
    )


def parse_truth(docs: DataFrame, text: str = "text") -> DataFrame:
    """{path: {expected_rule_ids, expected_min_count}} → (path, rule_id, min_count) rows.

    A path that expects nothing stays, with a null rule.
    """
    parsed = F.from_json(
        text, "map<string,struct<expected_rule_ids:array<string>,expected_min_count:int>>")
    return docs.select(F.explode(parsed).alias("path", "spec")).select(
        "path", F.explode_outer("spec.expected_rule_ids").alias("rule_id"),
        F.col("spec.expected_min_count").alias("min_count"),
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return parse_truth(spark.read.text(path, wholetext=True), "value")


# --- out ----------------------------------------------------------------------
def write_findings(rows: DataFrame, path: str) -> None:
    """Append stored finding rows, one folder per scan."""
    rows.write.partitionBy("scan_id").mode("append").parquet(path)


def replace_findings(rows: DataFrame, path: str) -> None:
    """Store the findings of scans in place of what these scans had stored before, so a scan that runs again stores once."""
    replace_partitions(rows, path, ["scan_id"])


def write_report(findings: DataFrame, path: str) -> None:
    """Findings and their summary as JSON lines in two folders, gzipped, as a line repeats all names and most texts of others."""
    findings.drop("emit_seq").write.mode("overwrite").json(f"{path}/findings", compression="gzip")
    summarize(findings, ("scan_id",)).write.mode("overwrite").json(f"{path}/summary", compression="gzip")


def write_cbom(parts: DataFrame, path: str) -> None:
    """Inventory documents as JSON lines (S12); see ``inventory.cbom_parts``.

    A document arrives in parts of bounded size, so no scan has to fit into one row.
    """
    parts.select("scan_id", F.to_json(
        F.struct("part", "header", "component", "occurrences"), {"ignoreNullFields": "true"}
    ).alias("value")).write.partitionBy("scan_id").mode("overwrite").text(path)


def append_accuracy_log(accuracy: DataFrame, path: str) -> None:
    """One more line in the accuracy history."""
    accuracy.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)
