"""Inventory, version and difference queries over the finding facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import inventory as inv
from saltmarsh.plans.catalog import Tables, query
from saltmarsh.plans.facts import finding_facts, scans, with_ctes
from saltmarsh.session import stored


def _occ(t: Tables):
    return inv.occurrences(finding_facts(t))


@query("a02_components", with_ctes(["components"], """
SELECT scan_id, name, key_size, mode, bom_ref, occurrence_count, max_weight, max_severity FROM components"""))
def _(t: Tables):
    return inv.build_components(_occ(t)).drop("comp_seq")


@query("a02_components_by_name", with_ctes(["live", "sev"], """
SELECT scan_id, primitive AS name,
  'crypto-asset/' || lower(primitive) AS bom_ref, count(*) AS occurrence_count, max(weight) AS max_weight,
  CASE WHEN max(weight) > 0 THEN first(severity ORDER BY weight DESC, seq) ELSE 'INFO' END AS max_severity
FROM live JOIN sev USING (severity) GROUP BY scan_id, primitive"""))
def _(t: Tables):
    occ = inv.occurrences(finding_facts(t), simple=True)
    return inv.build_components(occ, simple=True).drop("comp_seq")


@query("a02_occurrences", with_ctes(["live"], """
SELECT scan_id, primitive AS name, path AS file, line, finding_id, usage, severity, quantum_status FROM live"""))
def _(t: Tables):
    return _occ(t).select(
        "scan_id", "name", "file", "line", "finding_id", "usage", "severity", "quantum_status")


@query("a03_severity_counts", with_ctes(["live"], """
SELECT scan_id, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
  count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low,
  count(*) FILTER (severity = 'Informational') AS info FROM live GROUP BY scan_id"""))
def _(t: Tables):
    return inv.severity_counts(finding_facts(t))


@query("a04_cbom_summary", with_ctes(["components"], """
SELECT scan_id, count(*) AS total_assets, CAST(sum(occurrence_count) AS BIGINT) AS total_findings
FROM components GROUP BY scan_id"""))
def _(t: Tables):
    return inv.cbom_summary(inv.build_components(_occ(t)))


@query("a05_dependencies", with_ctes(["facts"], """
SELECT DISTINCT scan_id, 'urn:uuid:cbom-' || scan_id AS ref, 'crypto-asset/' || lower(primitive) AS target FROM facts
UNION SELECT DISTINCT scan_id, 'crypto-asset/' || lower(primitive),
  'crypto-asset/' || lower(replace(dep, ' ', '-'))
FROM (SELECT scan_id, primitive, unnest([library, usage]) AS dep FROM facts) WHERE dep IS NOT NULL"""))
def _(t: Tables):
    found = finding_facts(t).withColumn("depends_on", F.array_compact(F.array("library", "usage")))
    return inv.build_dependencies(found)


ASSETS = """
SELECT scan_id, primitive AS name, concat_ws(', ', string_agg(DISTINCT usage, ', ' ORDER BY usage)) AS operations,
  coalesce(string_agg(DISTINCT library, ', ' ORDER BY library) FILTER (library <> 'Standard API'), 'Standard API') AS library,
  coalesce(string_agg(DISTINCT CAST(key_size AS VARCHAR) || '-bit', ', ' ORDER BY CAST(key_size AS VARCHAR) || '-bit'), 'N/A') AS key_size,
  count(*) AS usages,
  CASE WHEN first(quantum_vulnerable ORDER BY seq) THEN 'Vulnerable' ELSE 'Quantum-Ready' END AS quantum_risk,
  CASE max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END)
    WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity,
  first(recommendation ORDER BY seq) AS recommendation
FROM live WHERE status <> 'RESOLVED' GROUP BY scan_id, primitive"""


def _active(t: Tables):
    return finding_facts(t).filter(~F.col("suppressed") & (F.col("status") != "RESOLVED"))


@query("a06_asset_view", with_ctes(["live"], ASSETS))
def _(t: Tables):
    return inv.asset_view(_active(t))


@query("a06_asset_locations", with_ctes(["live"], """
SELECT scan_id, primitive AS name, path || ':' || line AS location FROM live WHERE status <> 'RESOLVED'"""))
def _(t: Tables):
    return inv.asset_locations(_active(t))


@query("a07_asset_metrics", with_ctes(["live"], """
SELECT scan_id, count(*) AS components, CAST(sum(usages) AS BIGINT) AS total_usages,
  count(*) FILTER (quantum_risk = 'Vulnerable') AS vulnerable,
  count(*) FILTER (quantum_risk = 'Quantum-Ready') AS ready,
  CAST(0 AS BIGINT) AS unknown, count(*) FILTER (severity IN ('Critical', 'High')) AS high_risk
FROM assets GROUP BY scan_id""", assets=ASSETS))
def _(t: Tables):
    return inv.asset_metrics(inv.asset_view(_active(t)))


@query("w06_versions", with_ctes(["versions"], """
SELECT scan_id, repo_id, created_at, version, 'CBOM-v' || version AS version_label FROM versions"""))
def _(t: Tables):
    return inv.with_versions(scans(t))


@query("w07_version_lookup", with_ctes(["versions"], """
SELECT repo_id, scan_id, version FROM versions WHERE repo_id = '7'"""))
def _(t: Tables):
    return inv.version_of(inv.with_versions(scans(t)), "7").select("repo_id", "scan_id", "version")


@query("j10_previous_scan", with_ctes(["versions"], """
SELECT scan_id, repo_id, version, previous_scan_id FROM versions"""))
def _(t: Tables):
    return inv.with_previous(inv.with_versions(scans(t))).select(
        "scan_id", "repo_id", "version", "previous_scan_id")


@query("p46_provenance", """
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp,
  CASE WHEN o_orderstatus = 'F' THEN '9.1.0' ELSE '2.4.0' END AS scanner_version,
  CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'unavailable' END AS commit_hash FROM orders""")
def _(t: Tables):
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("scan_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "9.1.0").alias("scanner_version"),
        F.lit(None).cast("string").alias("commit_hash"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("revision"))
    return inv.provenance(rows).select("scan_id", "timestamp", "scanner_version", "commit_hash")


# --- differences --------------------------------------------------------------
DIFF = {
    "keyed": """SELECT * FROM components QUALIFY row_number() OVER (PARTITION BY scan_id, bom_ref ORDER BY comp_seq DESC) = 1""",
    "places": """SELECT f.scan_id, k.bom_ref, path || ':' || line || ':' || coalesce(usage, '') AS place, count(*) AS n
      FROM live f JOIN keyed k ON f.scan_id = k.scan_id AND f.primitive = k.name
        AND f.key_size IS NOT DISTINCT FROM k.key_size AND f.mode IS NOT DISTINCT FROM k.mode GROUP BY ALL""",
    "cur": "SELECT v.scan_id AS pair, k.* FROM versions v JOIN keyed k ON k.scan_id = v.scan_id",
    "prev": "SELECT v.scan_id AS pair, k.* FROM versions v JOIN keyed k ON k.scan_id = v.previous_scan_id",
    "pcur": "SELECT v.scan_id AS pair, p.* FROM versions v JOIN places p ON p.scan_id = v.scan_id",
    "pprev": "SELECT v.scan_id AS pair, p.* FROM versions v JOIN places p ON p.scan_id = v.previous_scan_id",
    "moves": """SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.bom_ref, b.bom_ref) AS bom_ref,
        CAST(sum(CASE WHEN b.n IS NULL THEN a.n ELSE 0 END) AS BIGINT) AS added,
        CAST(sum(CASE WHEN a.n IS NULL THEN b.n ELSE 0 END) AS BIGINT) AS removed
      FROM pcur a FULL JOIN pprev b ON a.pair = b.pair AND a.bom_ref = b.bom_ref AND a.place = b.place
      GROUP BY 1, 2""",
    "diff": """SELECT coalesce(c.pair, p.pair) AS scan_id, coalesce(c.bom_ref, p.bom_ref) AS ref,
        coalesce(c.name, p.name) AS name, c.pair IS NOT NULL AS now, p.pair IS NOT NULL AS then_,
        CASE WHEN c.pair IS NOT NULL AND p.pair IS NOT NULL THEN concat_ws(',',
          CASE WHEN c.max_severity <> p.max_severity THEN 'maxSeverity' END,
          CASE WHEN c.max_weight <> p.max_weight THEN 'maxVulnerabilityScore' END,
          CASE WHEN c.name <> p.name OR c.key_size IS DISTINCT FROM p.key_size OR c.mode IS DISTINCT FROM p.mode
            THEN 'cryptoProperties' END,
          CASE WHEN m.added > 0 OR m.removed > 0 OR c.occurrence_count <> p.occurrence_count
            THEN 'occurrences' END) ELSE '' END AS changes,
        CASE WHEN c.pair IS NOT NULL AND p.pair IS NOT NULL THEN m.added END AS added_occurrences,
        CASE WHEN c.pair IS NOT NULL AND p.pair IS NOT NULL THEN m.removed END AS removed_occurrences
      FROM cur c FULL JOIN prev p ON c.pair = p.pair AND c.bom_ref = p.bom_ref
      LEFT JOIN moves m ON m.pair = coalesce(c.pair, p.pair) AND m.bom_ref = coalesce(c.bom_ref, p.bom_ref)""",
    "statused": """SELECT scan_id, ref, name, CASE WHEN NOT then_ THEN 'added' WHEN NOT now THEN 'removed'
        WHEN changes <> '' THEN 'changed' ELSE 'unchanged' END AS status, changes, added_occurrences,
        removed_occurrences FROM diff""",
}


# a component for each reference, size and mode
_FULL = "bom_ref || '-' || coalesce(CAST(key_size AS VARCHAR), 'default') || '-' || coalesce(mode, 'default')"
FULL_DIFF = {
    "keyed": f"""SELECT scan_id, name, key_size, mode, max_severity, max_weight, occurrence_count, {_FULL} AS bom_ref
      FROM components""",
    **{k: v for k, v in DIFF.items() if k != "keyed"},
}


def _diff(t: Tables, full_key: bool = False):
    occ = _occ(t)
    components = stored(inv.build_components(occ))  # read as current and as previous
    return inv.diff_inventories(
        components, occ, inv.with_previous(inv.with_versions(scans(t))), full_key)


@query("j07_j09_u03_diff", with_ctes(["components", "versions"], "SELECT * FROM statused", **DIFF))
def _(t: Tables):
    return _diff(t)


@query("j07_j09_full_key_diff", with_ctes(["components", "versions"], "SELECT * FROM statused", **FULL_DIFF))
def _(t: Tables):
    """Sizes and modes of one primitive are components of their own; none stands for another."""
    return _diff(t, full_key=True)


@query("j07_diff_summary", with_ctes(["components", "versions"], """
SELECT scan_id, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
  count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged,
  count(*) FILTER (status <> 'unchanged') = 0 AS identical FROM statused GROUP BY scan_id""", **DIFF))
def _(t: Tables):
    return inv.diff_summary(_diff(t))


@query("j08_version_diff", with_ctes(["components", "versions"], """
SELECT coalesce(c.pair, p.pair) AS scan_id, coalesce(c.key, p.key) AS key,
  CASE WHEN p.pair IS NULL THEN 'added' WHEN c.pair IS NULL THEN 'removed'
    WHEN c.max_severity <> p.max_severity OR c.max_weight <> p.max_weight
      OR c.occurrence_count <> p.occurrence_count THEN 'changed' ELSE 'unchanged' END AS status,
  CASE WHEN c.pair IS NOT NULL AND p.pair IS NOT NULL THEN concat_ws(',',
    CASE WHEN c.max_severity <> p.max_severity THEN 'maxSeverity' END,
    CASE WHEN c.max_weight <> p.max_weight THEN 'maxVulnerabilityScore' END,
    CASE WHEN c.occurrence_count <> p.occurrence_count THEN 'occurrences' END) ELSE '' END AS changed_fields
FROM cur c FULL JOIN prev p ON c.pair = p.pair AND c.key = p.key""",
    keyed="""SELECT *, lower(name || '|' || coalesce(CAST(key_size AS VARCHAR), 'unspecified') || '|'
      || coalesce(mode, '')) AS key FROM components""",
    cur="""SELECT v.scan_id AS pair, k.* FROM versions v JOIN keyed k ON k.scan_id = v.scan_id
      WHERE v.previous_scan_id IS NOT NULL""",
    prev="SELECT v.scan_id AS pair, k.* FROM versions v JOIN keyed k ON k.scan_id = v.previous_scan_id"))
def _(t: Tables):
    return inv.diff_versions(
        stored(inv.build_components(_occ(t))), inv.with_previous(inv.with_versions(scans(t))))


@query("s12_cbom_contents", with_ctes(["components", "versions"], """
SELECT scan_id, 'component' AS part, name, bom_ref, key_size, mode, max_severity AS severity,
  CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line FROM components
UNION ALL SELECT f.scan_id, 'occurrence', NULL, c.bom_ref, NULL, NULL, coalesce(f.severity, 'INFO'), f.path, f.line
FROM live f JOIN components c ON f.scan_id = c.scan_id AND f.primitive = c.name
  AND f.key_size IS NOT DISTINCT FROM c.key_size AND f.mode IS NOT DISTINCT FROM c.mode"""))
def _(t: Tables):
    """What the parts hold, component by component and occurrence by occurrence."""
    occ = _occ(t)
    parts = stored(inv.cbom_parts(inv.with_versions(scans(t)), inv.build_components(occ), occ, chunk=2))
    own = parts.where("part = 'component'").select(
        "scan_id", "part", "component.name", F.col("component.bom-ref").alias("bom_ref"),
        F.col("component.keySize").alias("key_size"), "component.mode", F.col("component.maxSeverity").alias("severity"),
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    null = F.lit(None).cast("string")
    placed = parts.where("part = 'occurrences'").select(
        "scan_id", F.col("occurrences.bom-ref").alias("bom_ref"), F.explode("occurrences.items").alias("i")).select(
        "scan_id", F.lit("occurrence").alias("part"), null.alias("name"), "bom_ref", F.lit(None).cast("int").alias("key_size"),
        null.alias("mode"), "i.severity", "i.file", "i.line")
    return own.unionByName(placed)


@query("s12_cbom_parts", with_ctes(["components", "scans"], """
SELECT scan_id, 'header' AS part, count(*) AS rows, CAST(coalesce(any_value(n), 0) AS BIGINT) AS items FROM scans
  LEFT JOIN (SELECT scan_id, sum(occurrence_count) AS n FROM components GROUP BY scan_id) USING (scan_id) GROUP BY scan_id
UNION ALL SELECT scan_id, 'component', count(*), 0 FROM components GROUP BY scan_id
UNION ALL SELECT scan_id, 'occurrences', CAST(sum(ceil(n / 2.0)) AS BIGINT), CAST(sum(n) AS BIGINT)
  FROM (SELECT scan_id, bom_ref, sum(occurrence_count) AS n FROM components GROUP BY scan_id, bom_ref) GROUP BY scan_id"""))
def _(t: Tables):
    """Document parts per scan, with chunks of two occurrences to exercise the chunking."""
    occ = _occ(t)
    parts = inv.cbom_parts(
        inv.with_versions(scans(t)), inv.build_components(occ), occ, chunk=2)
    return parts.groupBy("scan_id", "part").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.coalesce(F.col("header.totalFindings"), F.size("occurrences.items").cast("long"), F.lit(0)))
        .alias("items"))
