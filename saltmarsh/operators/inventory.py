"""Inventories, their versions and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions.severity import bom_ref, sev_name, sev_rank, sev_weight
from saltmarsh.operators.ranking import with_position
from saltmarsh.operators.skew import heavy_counts, split_join

OCC_FIELDS = ["file", "line", "finding_id", "usage", "severity", "quantum_status", "recommendation"]


def _component_columns(simple: bool) -> list[Column]:
    name = F.coalesce(F.nullif(F.col("primitive"), F.lit("")), F.lit("UNKNOWN"))
    cols = [name.alias("name")]
    if not simple:
        cols += [
            F.nullif(F.col("key_size"), F.lit(0)).alias("key_size"),
            F.nullif(F.col("mode"), F.lit("")).alias("mode"),
        ]
    return cols


def occurrences(findings: DataFrame, simple: bool = False) -> DataFrame:
    """One row per place a component was found, keyed like its component.

    Occurrences stay rows: a component of a large scan can hold a third of all findings.
    """
    kept = findings.filter(~F.col("suppressed"))
    keys = _component_columns(simple)
    return kept.select(
        "scan_id", *keys, bom_ref(keys[0]).alias("bom_ref"), F.col("path").alias("file"), "line",
        F.col("finding_id"), "usage", F.coalesce("severity", F.lit("INFO")).alias("severity"),
        "quantum_status", "recommendation", "emit_seq",
    )


def build_components(occ: DataFrame, simple: bool = False) -> DataFrame:
    """Components with their count and worst severity.

    The first occurrence wins among equal weights; a component of weight 0 reads INFO.
    ``simple`` groups by the name alone.
    """
    keys = ["scan_id", "name"] if simple else ["scan_id", "name", "key_size", "mode"]
    weight = sev_weight(F.col("severity"))
    return occ.groupBy(*keys).agg(
        F.first("bom_ref").alias("bom_ref"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.max(weight).alias("max_weight"),
        F.min_by("severity", F.struct(-weight, F.col("emit_seq"))).alias("_worst"),
        F.min("emit_seq").alias("comp_seq"),
    ).withColumn(
        "max_severity", F.when(F.col("max_weight") > 0, F.col("_worst")).otherwise("INFO")
    ).drop("_worst")


def severity_counts(findings: DataFrame) -> DataFrame:
    """critical … info per scan; informational counts as info."""
    sev = F.lower(F.coalesce("severity", F.lit("INFO")))
    n = lambda *names: F.count_if(sev.isin(*names))
    return findings.filter(~F.col("suppressed")).groupBy("scan_id").agg(
        n("critical").alias("critical"), n("high").alias("high"), n("medium").alias("medium"),
        n("low").alias("low"), n("info", "informational").alias("info"))


def cbom_summary(components: DataFrame) -> DataFrame:
    """Assets and findings per inventory."""
    return components.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_assets"),
        F.sum("occurrence_count").alias("total_findings"))


def build_dependencies(findings: DataFrame) -> DataFrame:
    """Edges root → component and component → what it depends on, distinct."""
    root = F.concat(F.lit("urn:uuid:cbom-"), F.col("scan_id"))
    ref = bom_ref(F.coalesce(F.nullif(F.col("primitive"), F.lit("")), F.lit("UNKNOWN")))
    parts = findings.select("scan_id", root.alias("root"), ref.alias("own"), "depends_on").distinct()
    top = parts.select("scan_id", F.col("root").alias("ref"), F.col("own").alias("target"))
    below = parts.select(
        "scan_id", F.col("own").alias("ref"), F.explode("depends_on").alias("_name")
    ).select("scan_id", "ref", bom_ref(F.col("_name")).alias("target"))
    return top.union(below).distinct()


# --- asset view ---------------------------------------------------------------
def asset_view(findings: DataFrame) -> DataFrame:
    """Per algorithm label: uses, libraries, key sizes, worst severity, quantum flag.

    The collected sets are over closed vocabularies (uses, libraries, key sizes); the places
    themselves are ``asset_locations``.
    """
    name = F.coalesce(F.nullif(F.col("primitive"), F.lit("")), F.lit("Unknown Component"))
    vulnerable = F.lower(F.coalesce("quantum_status", F.lit(""))).contains("vulnerable")
    rank = F.when(
        F.upper("severity").isin("CRITICAL", "HIGH", "MEDIUM"), sev_rank(F.initcap("severity"))
    ).otherwise(1)
    size = F.when(
        F.coalesce("key_size", F.lit(0)) > 0, F.concat(F.col("key_size").cast("string"), F.lit("-bit")))
    named = F.filter("libraries", lambda x: x != "Standard API")
    return findings.groupBy("scan_id", name.alias("name")).agg(
        F.sort_array(F.collect_set(F.nullif(F.col("usage"), F.lit("")))).alias("uses"),
        F.sort_array(F.collect_set(F.nullif(F.col("library"), F.lit("")))).alias("libraries"),
        F.sort_array(F.collect_set(size)).alias("key_sizes"),
        F.count(F.lit(1)).alias("usages"),
        F.max(rank).alias("_rank"),
        F.min_by(F.when(vulnerable, "Vulnerable").otherwise("Quantum-Ready"), "emit_seq")
        .alias("quantum_risk"),
        F.min_by("recommendation", "emit_seq").alias("recommendation"),
    ).select(
        "scan_id", "name", F.concat_ws(", ", "uses").alias("operations"),
        F.when(F.size(named) > 0, F.concat_ws(", ", named)).otherwise(
            F.coalesce(F.get("libraries", F.lit(0)), F.lit("Standard Crypto API"))).alias("library"),
        F.when(F.size("key_sizes") > 0, F.concat_ws(", ", "key_sizes")).otherwise("N/A")
        .alias("key_size"),
        "usages", "quantum_risk", sev_name(F.col("_rank")).alias("severity"), "recommendation",
    )


def asset_locations(findings: DataFrame) -> DataFrame:
    return findings.select(
        "scan_id", F.coalesce(F.nullif(F.col("primitive"), F.lit("")), F.lit("Unknown Component")).alias("name"),
        F.concat("path", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?"))).alias("location"),
    )


def asset_metrics(assets: DataFrame) -> DataFrame:
    """Components, usages and risk counts per scan."""
    low = F.lower("name")
    return assets.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("components"), F.sum("usages").alias("total_usages"),
        F.count_if(F.col("quantum_risk") == "Vulnerable").alias("vulnerable"),
        F.count_if(F.col("quantum_risk") == "Quantum-Ready").alias("ready"),
        F.count_if(low.contains("unknown") | low.contains("potential")).alias("unknown"),
        F.count_if(F.col("severity").isin("Critical", "High")).alias("high_risk"))


# --- versions -----------------------------------------------------------------
def with_versions(scans: DataFrame) -> DataFrame:
    """Version 1, 2, … of a repository's inventories by time, then scan."""
    return with_position(scans, ["created_at", "scan_id"], ["repo_id"], "version").withColumn(
        "version_label", F.concat(F.lit("CBOM-v"), F.col("version").cast("string")))


def version_of(versions: DataFrame, repo_id: str, number: int | None = None) -> DataFrame:
    """The version list of a repository, or one entry of it."""
    own = versions.filter(F.col("repo_id") == repo_id)
    return own if number is None else own.filter(F.col("version") == number)


def with_previous(versions: DataFrame) -> DataFrame:
    """Each scan with the scan before it in the same repository.

    Versions are dense, so the predecessor is an equi-join on version - 1.
    """
    before = versions.select(
        "repo_id", (F.col("version") + 1).alias("version"),
        F.col("scan_id").alias("previous_scan_id"))
    return versions.join(before, ["repo_id", "version"], "left")


def provenance(scans: DataFrame) -> DataFrame:
    """Timestamp, scanner version and commit with their fallbacks."""
    first = lambda *names: F.coalesce(*[
        F.col(n) for n in names if n in scans.columns] or [F.lit(None)])
    stamp = first("scan_timestamp", "created_at", "received_at")
    return (
        scans.withColumn("timestamp", F.date_format(
            F.coalesce(stamp.cast("timestamp"), F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .withColumn("scanner_version", F.coalesce(
            first("scanner_version").cast("string"), F.lit(fv.DEFAULT_SCANNER_VERSION)))
        .withColumn("commit_hash", F.coalesce(
            first("commit_hash", "repo_commit_hash", "revision").cast("string"),
            F.lit("unavailable")))
    )


# --- differences --------------------------------------------------------------
def _reference(full_key: bool) -> Column:
    if not full_key:
        return F.col("bom_ref")
    return F.concat_ws(
        "-", "bom_ref", F.coalesce(F.col("key_size").cast("string"), F.lit("default")),
        F.coalesce("mode", F.lit("default")))


def _keyed(components: DataFrame, full_key: bool) -> DataFrame:
    """One component per identity; the last one wins when references collide."""
    picked = F.struct("name", "max_severity", "max_weight", "occurrence_count", "key_size", "mode")
    # dealt by the scan, so that they meet the scans where they are; what a scan's task holds is its components, not their places
    return components.repartition("scan_id").groupBy("scan_id", _reference(full_key).alias("ref")).agg(
        F.max_by(picked, "comp_seq").alias("c"), F.sum("occurrence_count").alias("places"))


def _occurrence_moves(occ: DataFrame, keyed: DataFrame, sided: DataFrame, full_key: bool) -> DataFrame:
    """Occurrences added and removed, counted from rows (U03, J09): pair, ref and a count for every place that moved.

    A place goes to the pair in which its scan is the later one and to that in which it is the earlier one, and one aggregate tells whether
    a pair has it on one side only.
    """
    place = F.concat_ws(
        ":", F.col("file"), F.col("line").cast("string"), F.coalesce("usage", F.lit("")))
    same = ["name", "key_size", "mode"]
    ref = _reference(full_key).alias("ref")
    placed = occ.select("scan_id", ref, *same, place.alias("place"))
    # only the occurrences of the component that represents its reference take part
    own = sided.select("scan_id", "ref", "pair", "is_now", *[F.col(f"c.{c}").alias(f"_{c}") for c in same])
    # a component with a large share of all places is dealt over tasks; how many it has, the components tell
    heavy = heavy_counts(keyed, ["scan_id", "ref"], "places")
    is_own = F.struct(*same).eqNullSafe(F.struct(*[f"_{c}" for c in same]))
    met = split_join(placed, own, ["scan_id", "ref"], heavy=heavy).where(is_own)
    n = F.lit(1)
    return met.groupBy("pair", "ref", "place").agg(
        F.sum(F.when(F.col("is_now"), n)).alias("n_now"), F.sum(F.when(~F.col("is_now"), n)).alias("n_then")).select(
        "pair", "ref", F.when(F.col("n_then").isNull(), F.col("n_now")).otherwise(0).alias("added"),
        F.when(F.col("n_now").isNull(), F.col("n_then")).otherwise(0).alias("removed"))


def diff_inventories(
    components: DataFrame, occ: DataFrame, scans: DataFrame, full_key: bool = False
) -> DataFrame:
    """Every component of every scan against the scan before it.

    status is added, removed, changed or unchanged; a first scan has everything added.
    ``scans`` carries scan_id and previous_scan_id. Components and places meet the scans once each, for both sides, and one aggregate
    over (pair, reference) puts the sides beside each other.
    """
    sides = scans.select("scan_id", F.col("scan_id").alias("pair"), F.lit(True).alias("is_now")).unionAll(
        scans.select("previous_scan_id", "scan_id", F.lit(False)))
    keyed = _keyed(components, full_key)
    sided = keyed.join(sides, "scan_id")
    moves = _occurrence_moves(occ, keyed, sided, full_key)
    c, no_count = F.col("c"), F.lit(None).cast("long")
    met = sided.select(
        "pair", "ref", F.when(F.col("is_now"), c).alias("now"), F.when(~F.col("is_now"), c).alias("then"),
        no_count.alias("added"), no_count.alias("removed")).unionByName(moves, allowMissingColumns=True)
    # a list holds as many entries as the scan has rows, which is one unless scans repeat; then every row of one side meets every row of the other
    both = met.groupBy("pair", "ref").agg(
        F.collect_list("now").alias("now"), F.collect_list("then").alias("then"),
        F.sum("added").alias("added_occurrences"), F.sum("removed").alias("removed_occurrences"),
    ).withColumn("now", F.explode_outer("now")).withColumn("then", F.explode_outer("then"))
    n, t = F.col("now"), F.col("then")
    severity = F.upper(n["max_severity"]) != F.upper(t["max_severity"])
    score = n["max_weight"] != t["max_weight"]
    properties = ~F.struct(n["name"], n["key_size"], n["mode"]).eqNullSafe(F.struct(t["name"], t["key_size"], t["mode"]))
    moved = (
        (F.col("added_occurrences") > 0) | (F.col("removed_occurrences") > 0)
        | (n["occurrence_count"] != t["occurrence_count"])
    )
    changed = F.array_compact(F.array(
        F.when(severity, "maxSeverity"), F.when(score, "maxVulnerabilityScore"),
        F.when(properties, "cryptoProperties"), F.when(moved, "occurrences")))
    paired = n.isNotNull() & t.isNotNull()
    return both.select(
        F.col("pair").alias("scan_id"), "ref", F.coalesce(n["name"], t["name"]).alias("name"),
        F.when(t.isNull(), "added").when(n.isNull(), "removed")
        .when(F.size(changed) > 0, "changed").otherwise("unchanged").alias("status"),
        F.when(paired, F.concat_ws(",", changed)).otherwise("").alias("changes"),
        F.when(paired, F.col("added_occurrences")).alias("added_occurrences"),
        F.when(paired, F.col("removed_occurrences")).alias("removed_occurrences"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("status") == v)
    return diff.groupBy("scan_id").agg(
        n("added").alias("added"), n("removed").alias("removed"), n("changed").alias("changed"),
        n("unchanged").alias("unchanged"),
    ).withColumn("identical", (F.col("added") + F.col("removed") + F.col("changed")) == 0)


def diff_versions(components: DataFrame, scans: DataFrame) -> DataFrame:
    """Version difference keyed by primitive, parameter set and mode, with changed fields."""
    key = F.lower(F.concat_ws(
        "|", "name", F.coalesce(F.col("key_size").cast("string"), F.lit("unspecified")),
        F.coalesce("mode", F.lit(""))))
    picked = F.struct("name", "max_severity", "max_weight", "occurrence_count", "key_size", "mode")
    keyed = components.groupBy("scan_id", key.alias("key")).agg(
        F.max_by(picked, "comp_seq").alias("c"))
    pairs = scans.filter(F.col("previous_scan_id").isNotNull()).select(
        "scan_id", "previous_scan_id", F.col("scan_id").alias("pair"))
    now = keyed.join(pairs.select("scan_id", "pair"), "scan_id").select(
        "pair", "key", F.col("c").alias("now"))
    then = keyed.join(
        pairs.select(F.col("previous_scan_id").alias("scan_id"), "pair"), "scan_id"
    ).select("pair", "key", F.col("c").alias("then"))
    both = now.join(then, ["pair", "key"], "full")
    n, t = F.col("now"), F.col("then")
    fields = F.array_compact(F.array(*[
        F.when(~n[f].eqNullSafe(t[f]), label) for f, label in (
            ("name", "name"), ("max_severity", "maxSeverity"),
            ("max_weight", "maxVulnerabilityScore"), ("occurrence_count", "occurrences"),
            ("name", "algorithmProperties.primitive"),
            ("key_size", "algorithmProperties.parameterSetIdentifier"),
            ("mode", "algorithmProperties.mode"))]))
    paired = n.isNotNull() & t.isNotNull()
    return both.select(
        F.col("pair").alias("scan_id"), "key",
        F.when(t.isNull(), "added").when(n.isNull(), "removed")
        .when(F.size(fields) > 0, "changed").otherwise("unchanged").alias("status"),
        F.when(paired, F.concat_ws(",", fields)).otherwise("").alias("changed_fields"),
    )


# --- document -----------------------------------------------------------------
def cbom_parts(
    scans: DataFrame, components: DataFrame, occ: DataFrame, chunk: int = 1000
) -> DataFrame:
    """The inventory document of every scan, in parts of bounded size.

    Part kinds: the header with metadata and summary, each component, and its occurrences in
    chunks of ``chunk``. Concatenating a scan's parts gives the whole document.
    """
    head = provenance(scans).join(cbom_summary(components), "scan_id", "left")
    serial = F.concat(F.lit("urn:uuid:cbom-"), F.col("scan_id"))
    header = head.select(
        "scan_id", F.lit("header").alias("part"),
        F.struct(
            F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"),
            serial.alias("serialNumber"), F.col("version").cast("int").alias("version"),
            F.col("version_label").alias("cbomVersion"), F.col("timestamp"),
            F.col("scanner_version").alias("scannerVersion"), F.col("commit_hash").alias("commitHash"),
            F.col("repo_id").alias("component"),
            F.coalesce("total_assets", F.lit(0)).cast("long").alias("totalCryptoAssets"),
            F.coalesce("total_findings", F.lit(0)).cast("long").alias("totalFindings"),
        ).alias("header"))
    body = components.select(
        "scan_id", F.lit("component").alias("part"),
        F.struct(
            F.lit("cryptographic-asset").alias("type"), F.col("name"),
            F.col("bom_ref").alias("bom-ref"), F.col("key_size").alias("keySize"), F.col("mode"),
            F.col("max_weight").alias("maxVulnerabilityScore"),
            F.col("max_severity").alias("maxSeverity"),
        ).alias("component"))
    placed = with_position(
        occ.select("scan_id", "bom_ref", *OCC_FIELDS, "emit_seq"), ["emit_seq"], ["scan_id", "bom_ref"], "_n", start=0
    ).withColumn("_chunk", F.floor(F.col("_n") / chunk))
    item = F.struct(F.col("_n").alias("seq"), *[F.col(f) for f in OCC_FIELDS])
    chunks = placed.groupBy("scan_id", "bom_ref", "_chunk").agg(
        F.sort_array(F.collect_list(item)).alias("items")
    ).select(
        "scan_id", F.lit("occurrences").alias("part"),
        F.struct(F.col("bom_ref").alias("bom-ref"), F.col("_chunk").alias("chunk"),
                 F.col("items")).alias("occurrences"))
    return header.unionByName(body, allowMissingColumns=True).unionByName(
        chunks, allowMissingColumns=True)
