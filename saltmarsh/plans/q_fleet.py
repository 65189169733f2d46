"""Fleet, access and accuracy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions.scoring import lookup
from saltmarsh.operators import fleet, quality
from saltmarsh.operators.consolidate import active
from saltmarsh.operators.inventory import asset_view
from saltmarsh.plans.catalog import Tables, query
from saltmarsh.plans.facts import finding_facts, repos, scans, with_ctes
from saltmarsh.sources.corpus import enforce_quota


def _counted(t: Tables):
    return fleet.with_counts(scans(t), fleet.scan_counts(active(finding_facts(t))))


@query("w03_latest_scans", with_ctes(["latest"], "SELECT repo_id, scan_id, created_at FROM latest"))
def _(t: Tables):
    return fleet.latest_scans(scans(t))


TOTALS = """
SELECT (SELECT count(*) FROM counted) AS scans, CAST(sum(findings) AS BIGINT) AS findings,
  CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium,
  CAST(sum(low) AS BIGINT) AS low, CAST(sum(quantum) AS BIGINT) AS quantum,
  first(greatest(0, 100 - critical * 5 - findings) ORDER BY created_at DESC, scan_id DESC) AS security_score FROM latest"""


@query("a15_fleet_totals", with_ctes(["latest"], TOTALS))
def _(t: Tables):
    return fleet.fleet_totals(_counted(t))


@query("a20_fleet_status", with_ctes(["latest"], """
SELECT critical, quantum, 'Critical Risk Detected' AS status_title, critical
  || ' critical cryptographic vulnerabilities require immediate remediation.' AS status_text FROM totals""",
  totals=TOTALS))
def _(t: Tables):
    return fleet.fleet_status(fleet.fleet_totals(_counted(t))).select(
        "critical", "quantum", "status_title", "status_text")


@query("a16_readiness", with_ctes(["latest"], """
SELECT assets, quantum, greatest(0, assets - quantum) / CAST(assets AS DOUBLE) * 100 AS readiness_pct
FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT scan_id, primitive FROM live
    WHERE status <> 'RESOLVED' AND scan_id IN (SELECT scan_id FROM latest))) AS assets,
  (SELECT CAST(sum(quantum) AS BIGINT) FROM latest) AS quantum)"""))
def _(t: Tables):
    latest = fleet.latest_scans(_counted(t))
    found = active(finding_facts(t)).join(latest.select("scan_id"), "scan_id", "left_semi")
    per_scan = asset_view(found).groupBy("scan_id").agg(F.count(F.lit(1)).alias("assets"))
    totals = latest.join(per_scan, "scan_id", "left").agg(
        F.sum("assets").alias("assets"), F.sum("quantum").alias("quantum"))
    return fleet.readiness(totals)


HEALTH = """
SELECT repo_id, scan_id, greatest(0, 100 - (critical * 20 + high * 10 + medium * 5
  + (findings - critical - high - medium) * 2 + CASE WHEN quantum > 0 THEN 15 ELSE 0 END)) AS score,
  CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 OR medium > 0 OR quantum > 0 THEN 'ATTENTION'
    ELSE 'HEALTHY' END AS risk FROM latest"""


def _health(t: Tables):
    return fleet.repo_health(fleet.latest_scans(_counted(t)))


@query("a17_repo_health", with_ctes(["latest"], HEALTH))
def _(t: Tables):
    return _health(t).select("repo_id", "scan_id", "score", "risk")


@query("a18_health_counts", with_ctes(["latest"], """
SELECT count(*) AS total, count(*) FILTER (risk = 'HEALTHY') AS healthy,
  count(*) FILTER (risk = 'ATTENTION') AS attention, count(*) FILTER (risk = 'CRITICAL') AS critical FROM health""",
  health=HEALTH))
def _(t: Tables):
    return fleet.health_counts(_health(t))


@query("a18_risk_metrics", with_ctes(["counted"], """
SELECT count(*) AS total, count(*) FILTER (critical > 0 OR high > 0) AS at_risk,
  count(*) FILTER (quantum > 0) AS quantum FROM counted"""))
def _(t: Tables):
    return fleet.risk_metrics(_counted(t))


@query("a19_risk_distribution", with_ctes(["counted"], """
SELECT CASE WHEN findings = 0 THEN 'No Risk' WHEN critical > 0 THEN 'Critical' WHEN high > 0 THEN 'High'
  WHEN medium > 0 THEN 'Medium' ELSE 'Low' END AS highest, count(*) AS scans FROM counted GROUP BY 1"""))
def _(t: Tables):
    return fleet.risk_distribution(fleet.highest_risk(_counted(t)))


@query("a21_profile_stats", """
SELECT count(DISTINCT o_custkey) AS repos, count(*) AS scans, max(o_orderdate) AS last_scan FROM orders""")
def _(t: Tables):
    return fleet.profile_stats(scans(t))


@query("t02_top_algorithms", with_ctes(["live"], """
SELECT algorithm, usages, CAST(usages AS DOUBLE) / max(usages) OVER () * 100 AS pct_of_max FROM (
  SELECT algorithm, count(*) AS usages FROM live WHERE status <> 'RESOLVED' GROUP BY algorithm
  ORDER BY usages DESC, algorithm LIMIT 5)"""))
def _(t: Tables):
    return fleet.top_algorithms(active(finding_facts(t)))


@query("t03_recent_scans", with_ctes(["counted"], """
SELECT scan_id, repo_id, findings, CASE WHEN critical > 0 THEN 'Critical' WHEN findings > 0 THEN 'Issues Found'
  ELSE 'Secure' END AS badge FROM counted ORDER BY created_at DESC, scan_id DESC LIMIT 5"""))
def _(t: Tables):
    return fleet.recent_scans(_counted(t)).select("scan_id", "repo_id", "findings", "badge")


@query("t04_activity", with_ctes(["counted"], """
SELECT 'scan_complete' AS type, repo_id, scan_id, created_at, findings FROM counted
ORDER BY created_at DESC, scan_id DESC LIMIT 5"""))
def _(t: Tables):
    return fleet.activity(_counted(t))


@query("w10_trend", with_ctes(["counted"], """
SELECT scan_id, created_at, findings FROM (SELECT * FROM counted ORDER BY created_at DESC, scan_id DESC LIMIT 14)
ORDER BY created_at, scan_id"""))
def _(t: Tables):
    return fleet.trend(_counted(t))


# --- access, search, updates --------------------------------------------------
@query("p42_visible_repos", with_ctes(["repos"], "SELECT repo_id, name, owner_id FROM repos WHERE owner_id = 'u3'"))
def _(t: Tables):
    return fleet.visible_repos(repos(t), "u3", "Developer").select("repo_id", "name", "owner_id")


@query("p42_access_grants", with_ctes(["repos"], """
SELECT user_id, repo_id FROM users JOIN repos ON owner_id = user_id WHERE role = 'Developer'
UNION ALL SELECT user_id, '*' FROM users WHERE role <> 'Developer'""", users="""
  SELECT 'u' || n_nationkey AS user_id,
    (['Admin', 'Developer', 'Auditor', 'Developer', 'Developer'])[n_nationkey % 5 + 1] AS role FROM nation"""))
def _(t: Tables):
    role = lookup({0: "Admin", 2: "Auditor"}, F.col("n_nationkey") % 5, "Developer")
    users = t.nation.select(
        F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("user_id"), role.alias("role"))
    return fleet.access_grants(repos(t), users)


@query("p44_search_repos", with_ctes(["latest", "repos"], """
SELECT repo_id, name, coalesce(risk, 'HEALTHY') AS risk FROM repos LEFT JOIN health USING (repo_id)
WHERE contains(lower(name), '#00000001') AND coalesce(risk, 'HEALTHY') = 'CRITICAL'""", health=HEALTH))
def _(t: Tables):
    named = repos(t).join(_health(t).select("repo_id", "risk"), "repo_id", "left")
    return fleet.search_repos(named, "#00000001", "CRITICAL").select("repo_id", "name", "risk")


@query("p45_resolve", with_ctes(["facts"], """
SELECT scan_id, finding_id, CASE WHEN severity = 'Low' THEN 'RESOLVED' ELSE status END AS status FROM facts f"""))
def _(t: Tables):
    found = finding_facts(t).select("scan_id", "finding_id", "status", "severity")
    ids = found.filter(F.col("severity") == "Low")
    return fleet.resolve(found, ids).select("scan_id", "finding_id", "status")


@query("j16_parents", with_ctes(["facts", "scans", "repos"], """
SELECT f.finding_id, s.scan_id, r.name, r.owner_id FROM facts f JOIN scans s ON f.scan_id = s.scan_id
JOIN repos r ON r.repo_id = s.repo_id"""))
def _(t: Tables):
    found = finding_facts(t).select("scan_id", "finding_id")
    return fleet.with_parents(found, scans(t).select("scan_id", "repo_id"), repos(t)).select(
        "finding_id", "scan_id", "name", "owner_id")


@query("j17_upsert_summaries", with_ctes(["counted"], """
SELECT repo_id, findings, critical, created_at AS updated_at FROM counted
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, findings DESC, critical DESC) = 1"""))
def _(t: Tables):
    rows = _counted(t).select("repo_id", "findings", "critical", F.col("created_at").alias("updated_at"))
    old = rows.filter(F.col("updated_at") < "1996-01-01")
    new = rows.filter(F.col("updated_at") >= "1996-01-01")
    tie = F.struct("updated_at", "findings", "critical")
    return fleet.upsert(
        old.withColumn("at", tie), new.withColumn("at", tie), "repo_id", "at").drop("at")


@query("s05_quota", """
WITH sizes AS (SELECT source, count(*) AS n, sum(octet_length(encode(text))) AS bytes FROM documents GROUP BY source)
SELECT doc_id, source AS repo_id FROM documents WHERE source IN (
  SELECT source FROM sizes WHERE n <= 55 AND bytes <= 200000)""")
def _(t: Tables):
    files = t.documents.select("doc_id", F.col("source").alias("repo_id"), "text")
    return enforce_quota(files, max_files=55, max_bytes=200_000).select("doc_id", "repo_id")


# --- accuracy: quality labels as expected rules, a size rule as the detector ---
def _outcomes(t: Tables):
    docs = t.documents
    actual = docs.filter(F.col("n_chars") > 600).select(
        F.col("doc_id").alias("path"), F.lit("good").alias("rule_id")).unionByName(
        docs.filter(F.col("text").contains("!")).select(
            F.col("doc_id").alias("path"), F.lit("toxic").alias("rule_id")))
    labels = t.labels
    expected = labels.select(
        F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, "good").alias("rule_id")
    ).unionByName(labels.select(
        F.col("doc_id").alias("path"), F.when(F.col("toxic") == 1, "toxic").alias("rule_id")))
    return actual, expected


OUTCOMES = {
    "actual": """SELECT doc_id AS path, 'good' AS rule_id FROM documents WHERE n_chars > 600
      UNION ALL SELECT doc_id, 'toxic' FROM documents WHERE contains(text, '!')""",
    "expected": """SELECT doc_id AS path, 'good' AS rule_id FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1""",
    "outcomes": """SELECT coalesce(a.path, e.path) AS path, coalesce(a.rule_id, e.rule_id) AS rule_id,
      CASE WHEN a.path IS NOT NULL AND e.path IS NOT NULL THEN 'tp' WHEN a.path IS NOT NULL THEN 'fp'
        ELSE 'fn' END AS outcome FROM actual a FULL JOIN expected e ON a.path = e.path AND a.rule_id = e.rule_id""",
    "tally": """SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp,
      count(*) FILTER (outcome = 'fn') AS fn FROM outcomes""",
    "rated": """SELECT tp, fp, fn, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall
      FROM tally""",
    "scored": "SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM rated",
}


@query("j06_match_expected",
       "WITH " + ", ".join(f"{k} AS ({v})" for k, v in OUTCOMES.items()) + " SELECT * FROM outcomes")
def _(t: Tables):
    return quality.match_expected(*_outcomes(t))


@query("a08_a10_accuracy_gate", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in OUTCOMES.items()) + """
SELECT *, f1 >= 0.9 AND precision >= 0.85 AND recall >= 0.9 AS passes FROM scored""")
def _(t: Tables):
    return quality.gate(quality.accuracy(quality.match_expected(*_outcomes(t))))


@query("a09_accuracy_by_layer", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in OUTCOMES.items()) + """
SELECT layer, tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 1.0 END, 4) AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 1.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 1.0 END AS recall
  FROM (SELECT coalesce(lang, 'none') AS layer, count(*) FILTER (outcome = 'tp') AS tp,
      count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn
    FROM outcomes LEFT JOIN documents ON doc_id = path GROUP BY 1))""")
def _(t: Tables):
    found = quality.match_expected(*_outcomes(t)).join(
        t.documents.select(F.col("doc_id").alias("path"), "lang"), "path", "left")
    return quality.accuracy_by_layer(found, F.coalesce("lang", F.lit("none")))


@query("u02_rule_sets", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in OUTCOMES.items()) + """
SELECT 'both' AS side, path, rule_id FROM (SELECT * FROM actual INTERSECT SELECT * FROM expected)
UNION ALL SELECT 'surplus', * FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)
UNION ALL SELECT 'missing', * FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)""")
def _(t: Tables):
    actual, expected = _outcomes(t)
    both, surplus, missing = quality.rule_sets(actual, expected.filter(F.col("rule_id").isNotNull()))
    tag = lambda df, v: df.select(F.lit(v).alias("side"), "path", "rule_id")
    return tag(both, "both").unionByName(tag(surplus, "surplus")).unionByName(tag(missing, "missing"))
