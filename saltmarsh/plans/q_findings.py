"""Consolidation queries over the finding facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import severity as sv
from saltmarsh.operators import consolidate as c
from saltmarsh.plans.catalog import Tables, query
from saltmarsh.plans.facts import finding_facts, with_ctes
from saltmarsh.session import stored
from saltmarsh.sources.tables import parse_suppressions, split_confidence, to_finding_rows

COLS = ["scan_id", "path", "line", "rule_id", "language", "algorithm", "severity", "confidence"]
SQL_COLS = ", ".join(COLS)
# what the merge of layers reads besides the key
MERGING = ["language", "category", "severity", "confidence", "generic"]


@query("w01_exact_dedup", with_ctes(["dedup"], f"SELECT {SQL_COLS} FROM dedup"))
def _(t: Tables):
    return c.first_emitted(finding_facts(t), "language", "algorithm", "severity", "confidence").select(*COLS)


@query("w02_drop_generic", with_ctes(["specific"], f"SELECT {SQL_COLS} FROM specific"))
def _(t: Tables):
    found = c.first_emitted(finding_facts(t), "language", "algorithm", "severity", "confidence", "generic")
    return c.drop_generic(found).select(*COLS)


@query("w04_w05_merge_layers", with_ctes(["merged"], f"SELECT {SQL_COLS} FROM merged"))
def merged(t: Tables):
    return c.merge_layers(c.drop_generic(c.first_emitted(finding_facts(t), *MERGING, "algorithm"))).select(*COLS)


SUMMARY_SQL = """
SELECT metric, item, count(*) AS n FROM (
  SELECT 'total_findings' AS metric, '' AS item FROM specific
  UNION ALL SELECT CASE WHEN suppressed THEN 'suppressed_findings' ELSE 'active_findings' END, ''
    FROM specific
  UNION ALL SELECT 'by_severity', severity FROM specific WHERE NOT suppressed
  UNION ALL SELECT 'by_quantum_risk', quantum_risk FROM specific WHERE NOT suppressed
  UNION ALL SELECT 'by_language', language FROM specific WHERE NOT suppressed)
GROUP BY metric, item"""


@query("a01_summary", with_ctes(["specific"], SUMMARY_SQL))
def summary(t: Tables):
    """Flagship: fold duplicates, drop catch-alls, then the report totals."""
    found = c.first_emitted(finding_facts(t), "generic", "suppressed", "severity", "quantum_risk", "language")
    return c.summarize(c.drop_generic(found))


@query("a01_u04_files_with_findings", with_ctes(["facts"], (
    "SELECT DISTINCT scan_id, path FROM facts WHERE NOT suppressed")))
def _(t: Tables):
    return c.files_with_findings(finding_facts(t))


@query("a11_ci_gate", with_ctes(["facts"], (
    "SELECT scan_id, bool_or(NOT suppressed AND severity IN ('Critical', 'High')) AS fails "
    "FROM facts GROUP BY scan_id")))
def _(t: Tables):
    return c.ci_gate(finding_facts(t))


@query("w11_t01_finding_ids", with_ctes(["merged"], (
    "SELECT scan_id, path, line, rule_id, severity, 'f' || CAST(row_number() OVER (PARTITION BY "
    "scan_id ORDER BY path, line, sev_rank DESC, rule_id) AS VARCHAR) AS id "
    "FROM merged JOIN sev USING (severity)")))
def _(t: Tables):
    found = c.merge_layers(c.drop_generic(c.first_emitted(finding_facts(t), *MERGING)))
    found = found.select("scan_id", "path", "line", "rule_id", "severity")
    return c.with_finding_ids(found).select("scan_id", "path", "line", "rule_id", "severity", "id")


@query("t01_report_order", with_ctes(["dedup", "sev"], (
    "SELECT scan_id, path, line, severity, rule_id FROM dedup JOIN sev USING (severity) "
    "ORDER BY scan_id, path, line, sev_rank DESC, rule_id")))
def _(t: Tables):
    return c.first_emitted(finding_facts(t), "severity").orderBy("scan_id", *c.report_order()).select(
        "scan_id", "path", "line", "severity", "rule_id")


@query("u01_union_layers", with_ctes(["facts"], (
    "SELECT language, count(*) AS n FROM facts GROUP BY language")))
def _(t: Tables):
    facts = finding_facts(t)
    layers = [facts.filter(F.col("language") == v) for v in ("python", "config", "infra", "manifest")]
    return c.union_layers(*layers).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("p43_active", with_ctes(["facts"], (
    "SELECT scan_id, count(*) AS n FROM facts WHERE NOT suppressed AND status <> 'RESOLVED' "
    "GROUP BY scan_id")))
def _(t: Tables):
    return c.active(finding_facts(t)).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


# A manifest finding declares its own label; a source finding is confirmed with it when both
# sit in one scan. Labels with parts: RSA-2048 holds RSA, SHA-1 and ML-KEM split on the dash.
CORRELATE_SQL = """
SELECT scan_id, path, line, rule_id, algorithm,
  CASE WHEN language = 'manifest' AND EXISTS (SELECT 1 FROM met m WHERE m.scan_id = f.scan_id
      AND m.name = upper(f.algorithm)) THEN 'Confirmed'
    WHEN language <> 'manifest' AND EXISTS (SELECT 1 FROM used u WHERE u.scan_id = f.scan_id
      AND u.label = upper(f.algorithm)) THEN 'Confirmed'
    ELSE confidence END AS confidence
FROM dedup f"""
CORRELATE_CTES = {
    "labels": "SELECT DISTINCT scan_id, upper(algorithm) AS label FROM dedup WHERE language <> 'manifest'",
    "names": """SELECT DISTINCT scan_id, name FROM (
        SELECT scan_id, label AS name FROM labels
        UNION ALL SELECT scan_id, unnest(string_split(label, '-')) FROM labels) WHERE length(name) >= 2""",
    "wants": "SELECT DISTINCT scan_id, upper(algorithm) AS name FROM dedup WHERE language = 'manifest'",
    "met": "SELECT DISTINCT scan_id, name FROM wants JOIN names USING (scan_id, name)",
    # the catalogue's algorithm names that can occur inside a longer name here
    "corroborated": """SELECT DISTINCT n.scan_id, n.name FROM names n JOIN met m ON n.scan_id = m.scan_id
        AND contains(n.name, m.name)""",
    "used": """SELECT DISTINCT l.scan_id, l.label FROM labels l JOIN corroborated k ON l.scan_id = k.scan_id
        AND (l.label = k.name OR list_contains(string_split(l.label, '-'), k.name))""",
}


@query("j04_correlate_dependencies", with_ctes(["dedup"], CORRELATE_SQL, **CORRELATE_CTES))
def _(t: Tables):
    found = stored(c.first_emitted(finding_facts(t), "language", "algorithm", "confidence"))  # read several times below
    return c.correlate_dependencies(found).select(
        "scan_id", "path", "line", "rule_id", "algorithm", "confidence")


# Allow-list lines read off the parts table: every form of rule occurs.
ALLOW = {
    0: "md5-hashing|src/p0",
    1: "aes-encryption|lib/P1|{n}",
    2: "config-plaintext-secret|./p2|des",
    3: "RSA-2048",
    4: "p2:{n}",
    5: "# note {n}",
    6: "*|nowhere/{n}",
    7: "aes-hardcoded-key|p1 # reason",
}


def allow_lines(t: Tables):
    n = F.col("p_partkey")
    text = None
    for k, line in ALLOW.items():
        value = F.replace(F.lit(line), F.lit("{n}"), (n % 4).cast("string"))
        text = F.when(n % 8 == k, value) if text is None else text.when(n % 8 == k, value)
    return t.part.select(n.alias("seq"), text.alias("line"))


@query("s14_parse_suppressions", """
WITH lines AS (SELECT p_partkey AS seq, p_partkey % 8 AS k, CAST(p_partkey % 4 AS INTEGER) AS n FROM part)
SELECT seq, 'path' AS kind,
  CASE k WHEN 0 THEN 'md5-hashing' WHEN 1 THEN 'aes-encryption' WHEN 2 THEN 'config-plaintext-secret'
    WHEN 7 THEN 'aes-hardcoded-key' ELSE '*' END AS rule_id,
  CASE k WHEN 0 THEN 'src/p0' WHEN 1 THEN 'lib/P1' WHEN 2 THEN 'p2' WHEN 4 THEN 'p2'
    WHEN 6 THEN 'nowhere/' || CAST(n AS VARCHAR) ELSE 'p1' END AS path,
  CASE WHEN k IN (1, 4) THEN n END AS line, CASE WHEN k = 2 THEN 'des' END AS sub
FROM lines WHERE k IN (0, 1, 2, 4, 6, 7)
UNION ALL SELECT seq, unnest(['rule', 'fingerprint', 'path']),
  unnest(['RSA-2048', 'RSA-2048', '*']), unnest([NULL, NULL, 'RSA-2048']), NULL, NULL
FROM lines WHERE k = 3""")
def _(t: Tables):
    rules = parse_suppressions(allow_lines(t))
    return rules.select(F.col("rule_seq.seq").alias("seq"), "kind", "rule_id", "path", "line", "sub")


@query("j05_apply_suppressions", with_ctes(["dedup"], """
SELECT scan_id, path, line, rule_id, algorithm, reason <> '' AS suppressed, reason AS suppression_reason FROM (
  SELECT *, CASE
    WHEN rule_id = 'md5-hashing' AND path = 'p0' THEN 'Suppressed by rule "md5-hashing" on p0'
    WHEN rule_id = 'aes-encryption' AND path = 'p1' AND line IN (SELECT n FROM sevenths WHERE k = 1)
      THEN 'Suppressed by rule "aes-encryption" on p1:' || line
    WHEN rule_id = 'config-plaintext-secret' AND path = 'p2' AND algorithm = 'DES'
      THEN 'Suppressed by rule "config-plaintext-secret" (des) on p2'
    WHEN algorithm = 'RSA-2048' THEN 'Suppressed by rule ID "' || rule_id || '"'
    WHEN path = 'p2' AND line IN (SELECT n FROM sevenths WHERE k = 4) THEN 'Suppressed by rule "' || rule_id || '" on p2:' || line
    WHEN rule_id = 'aes-hardcoded-key' AND path = 'p1' THEN 'Suppressed by rule "aes-hardcoded-key" on p1'
    ELSE '' END AS reason FROM dedup) r""", sevenths="SELECT DISTINCT p_partkey % 8 AS k, p_partkey % 4 AS n FROM part"))
def _(t: Tables):
    """Flags and reasons; the quotes of a reason are written as double quotes for the comparison."""
    found = stored(c.first_emitted(finding_facts(t), "algorithm", "snippet"))  # read several times below
    out = c.apply_suppressions(found, parse_suppressions(allow_lines(t)))
    return out.select("scan_id", "path", "line", "rule_id", "algorithm", "suppressed",
                      F.translate("suppression_reason", "'", '"').alias("suppression_reason"))


@query("s08_finding_rows", with_ctes(["facts"], """
SELECT finding_id, path AS file_path, nullif(line, 0) AS line_number, algorithm, library, usage,
  coalesce(key_size, CASE WHEN algorithm = 'RSA-2048' THEN 2048 WHEN algorithm = 'DES' THEN 56 END) AS key_size,
  quantum_status, upper(severity) AS severity, 'm ' || snippet AS description,
  confidence || '|' || 'ast' AS confidence, suppressed FROM facts"""))
def _(t: Tables):
    found = (
        finding_facts(t).withColumn("message", F.concat(F.lit("m "), F.col("snippet")))
        .withColumn("category", F.col("usage")).withColumn("detection_method", F.lit(None).cast("string"))
        .withColumn("suppression_reason", F.lit("")).withColumn("scan_id", F.col("finding_id"))
    )
    return to_finding_rows(found).select(
        F.col("scan_id").alias("finding_id"), "file_path", "line_number", "algorithm", "library",
        "usage", "key_size", "quantum_status", "severity", "description", "confidence", "suppressed")


@query("s09_split_confidence", with_ctes(["facts"], """
SELECT finding_id, CASE WHEN line = 0 THEN 'Likely' ELSE confidence END AS confidence,
  CASE WHEN line = 0 OR language = 'python' THEN 'ast' ELSE language END AS detection_method FROM facts"""))
def _(t: Tables):
    packed = finding_facts(t).select("finding_id", F.when(
        F.col("line") == 0, None).when(F.col("language") == "python", F.col("confidence")).otherwise(
        F.concat_ws("|", "confidence", "language")).alias("confidence"))
    return split_confidence(packed)


@query("p18_p19_p20_labels", with_ctes(["facts"], """
SELECT finding_id, sev_rank, weight AS sev_weight,
  CASE WHEN rule_id LIKE 'entropy-%' THEN 'entropy' WHEN language = 'python' THEN 'ast'
    WHEN language IN ('infra', 'manifest') THEN language WHEN rule_id LIKE 'config-%' THEN 'config'
    ELSE 'regex' END AS detection_method,
  CASE WHEN rule_id LIKE 'entropy-%' THEN 'entropy' WHEN language = 'python' THEN 'ast'
    WHEN language IN ('infra', 'manifest') THEN language ELSE 'config' END AS layer_token,
  substr(sha256(rule_id || ':' || algorithm || ':' || snippet), 1, 16) AS fingerprint,
  (['Low', 'Medium', 'High', 'Critical', 'Critical'])[sev_rank + 1] AS bumped
FROM facts JOIN sev USING (severity)""", sev="""SELECT * FROM (VALUES ('Informational', 0, 0),
  ('Low', 1, 25), ('Medium', 2, 50), ('High', 3, 75), ('Critical', 4, 100)) v(severity, sev_rank, weight)"""))
def _(t: Tables):
    sev, rule, lang = F.col("severity"), F.col("rule_id"), F.col("language")
    return finding_facts(t).select(
        "finding_id", sv.sev_rank(sev).alias("sev_rank"), sv.sev_weight(sev).alias("sev_weight"),
        sv.detection_method(lang, rule).alias("detection_method"),
        sv.layer_token(lang, rule).alias("layer_token"),
        sv.fingerprint(rule, F.col("algorithm"), F.col("snippet")).alias("fingerprint"),
        sv.bump_severity(sev).alias("bumped"))


@query("p21_p22_p24_p25_labels", with_ctes(["facts"], """
SELECT finding_id,
  CASE WHEN algorithm = 'RSA-2048' THEN 2048 WHEN algorithm = 'DES' THEN 56 END AS key_size,
  CASE WHEN language = 'python' AND rule_id LIKE '%aes%' THEN 'pycryptodome'
    WHEN language = 'python' THEN 'hashlib' ELSE 'Standard Crypto API' END AS library,
  quantum_status,
  'crypto-asset/' || lower(replace(algorithm, ' ', '-')) AS bom_ref FROM facts"""))
def _(t: Tables):
    return finding_facts(t).select(
        "finding_id", sv.infer_key_size(F.col("algorithm"), F.col("rule_id")).alias("key_size"),
        sv.infer_library(F.lit(None).cast("array<string>"), F.col("rule_id"), F.col("language")).alias("library"),
        sv.quantum_status(F.col("quantum_risk")).alias("quantum_status"),
        sv.bom_ref(F.col("algorithm")).alias("bom_ref"))
