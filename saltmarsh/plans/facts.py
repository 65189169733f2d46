"""Finding facts, scans and repositories read off the given order tables.

One scan per order, one repository per customer, one finding per line item. The same
mapping exists once more as SQL, for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.severity import quantum_status
from saltmarsh.plans.catalog import Tables

LANGUAGES = ["python", "config", "infra", "manifest"]
RULES = ["aes-hardcoded-key", "entropy-secret-high-confidence", "config-plaintext-secret",
         "md5-hashing", "aes-encryption"]
CATEGORIES = ["hardcoded-secret", "hardcoded-secret", "hardcoded-secret", "hash",
              "symmetric-cipher"]
ALGORITHMS = ["RSA", "AES", "MD5", "SHA-1", "DES", "ECDSA", "RSA-2048", "ML-KEM"]
KEY_SIZES = [None, 56, 128, 256, 2048]
MODES = [None, "ECB", "CBC"]
SEVERITIES = ["Informational", "Low", "Medium", "High", "Critical", "Critical"]
RISKS = ["Quantum-Broken", "Quantum-Weakened", "Classical Risk", "Safe"]
USAGES = ["signature", "encryption", "hash", "password-hashing", None, "key exchange"]
LIBRARIES = ["hashlib", "Standard API", "Node Builtin crypto"]
CONFIDENCES = ["Likely", "Possible"]
IMPORTANCE = {"AUTOMOBILE": "critical", "BUILDING": "Important", "FURNITURE": "STANDARD",
              "MACHINERY": "bogus"}


def _pick(values: list, index: Column, kind: str = "string") -> Column:
    return F.element_at(
        F.array(*[F.lit(v).cast(kind) for v in values]), (index + 1).cast("int"))


def finding_facts(t: Tables) -> DataFrame:
    li = t.wide("lineitem")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    part, supp, num = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    primitive = _pick(ALGORITHMS, part % 8)
    risk = _pick(RISKS, part % 4)
    rule = _pick(RULES, part % 5)
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("scan_id"),
        F.col("o_custkey").cast("string").alias("repo_id"),
        F.concat(F.lit("p"), (part % 3).cast("string")).alias("path"),
        F.floor(num / 2).cast("int").alias("line"),
        _pick(LANGUAGES, supp % 4).alias("language"),
        rule.alias("rule_id"),
        _pick(CATEGORIES, part % 5).alias("category"),
        primitive.alias("algorithm"), primitive.alias("primitive"),
        _pick(KEY_SIZES, supp % 5, "int").alias("key_size"),
        _pick(MODES, num % 3).alias("mode"),
        _pick(SEVERITIES, F.floor(F.col("l_quantity") / 10)).alias("severity"),
        risk.alias("quantum_risk"), quantum_status(risk).alias("quantum_status"),
        risk.isin("Quantum-Broken", "Quantum-Weakened").alias("quantum_vulnerable"),
        (part % 5 == 4).alias("generic"),
        _pick(CONFIDENCES, supp % 2).alias("confidence"),
        _pick(USAGES, supp % 6).alias("usage"),
        _pick(LIBRARIES, supp % 3).alias("library"),
        F.concat(F.lit("call_"), (part % 7).cast("string")).alias("snippet"),
        F.concat(F.lit("Replace "), primitive).alias("recommendation"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("finding_id"),
        (F.col("l_returnflag") == "R").alias("suppressed"),
        F.when(F.col("l_linestatus") == "F", "RESOLVED").otherwise("ACTIVE").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        .alias("emit_seq"),
    )


def scans(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("scan_id"),
        F.col("o_custkey").cast("string").alias("repo_id"),
        F.col("o_orderdate").alias("created_at"))


def repos(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    importance = None
    for segment, value in IMPORTANCE.items():
        hit = F.lit(value)
        importance = F.when(seg == segment, hit) if importance is None else importance.when(seg == segment, hit)
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("repo_id"), F.col("c_name").alias("name"),
        importance.alias("importance"),
        F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("owner_id"))


# --- the same mapping as SQL --------------------------------------------------
def _sql_list(values: list) -> str:
    return "[" + ", ".join(
        "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in values) + "]"


def sql_pick(values: list, index: str) -> str:
    return f"({_sql_list(values)})[CAST({index} AS INTEGER) + 1]"


CTE = {
    "facts": f"""
  SELECT CAST(l_orderkey AS VARCHAR) AS scan_id, CAST(o_custkey AS VARCHAR) AS repo_id,
    'p' || CAST(l_partkey % 3 AS VARCHAR) AS path,
    CAST(floor(l_linenumber / 2.0) AS INTEGER) AS line,
    {sql_pick(LANGUAGES, 'l_suppkey % 4')} AS language,
    {sql_pick(RULES, 'l_partkey % 5')} AS rule_id,
    {sql_pick(CATEGORIES, 'l_partkey % 5')} AS category,
    {sql_pick(ALGORITHMS, 'l_partkey % 8')} AS algorithm,
    {sql_pick(ALGORITHMS, 'l_partkey % 8')} AS primitive,
    CAST({sql_pick(KEY_SIZES, 'l_suppkey % 5')} AS INTEGER) AS key_size,
    {sql_pick(MODES, 'l_linenumber % 3')} AS mode,
    {sql_pick(SEVERITIES, 'floor(l_quantity / 10)')} AS severity,
    {sql_pick(RISKS, 'l_partkey % 4')} AS quantum_risk,
    CASE WHEN l_partkey % 4 < 2 THEN 'Quantum Vulnerable' ELSE 'Quantum Safe' END AS quantum_status,
    l_partkey % 4 < 2 AS quantum_vulnerable,
    l_partkey % 5 = 4 AS generic,
    {sql_pick(CONFIDENCES, 'l_suppkey % 2')} AS confidence,
    {sql_pick(USAGES, 'l_suppkey % 6')} AS usage,
    {sql_pick(LIBRARIES, 'l_suppkey % 3')} AS library,
    'call_' || CAST(l_partkey % 7 AS VARCHAR) AS snippet,
    'Replace ' || {sql_pick(ALGORITHMS, 'l_partkey % 8')} AS recommendation,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS finding_id,
    l_returnflag = 'R' AS suppressed,
    CASE WHEN l_linestatus = 'F' THEN 'RESOLVED' ELSE 'ACTIVE' END AS status,
    o_orderdate AS created_at,
    row_number() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)
      AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "sev": """
  SELECT * FROM (VALUES ('Informational', 0, 0), ('Low', 1, 25), ('Medium', 2, 50),
    ('High', 3, 75), ('Critical', 4, 100)) v(severity, sev_rank, weight)""",
    "scans": """
  SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, CAST(o_custkey AS VARCHAR) AS repo_id,
    o_orderdate AS created_at FROM orders""",
    "repos": """
  SELECT CAST(c_custkey AS VARCHAR) AS repo_id, c_name AS name,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Critical' WHEN 'BUILDING' THEN 'Important'
      ELSE 'Standard' END AS importance,
    'u' || CAST(c_nationkey AS VARCHAR) AS owner_id FROM customer""",
    "dedup": """
  SELECT * FROM facts
  QUALIFY row_number() OVER (PARTITION BY scan_id, path, line, rule_id ORDER BY seq) = 1""",
    "specific": """
  SELECT * FROM dedup
  QUALIFY NOT (generic AND bool_or(NOT generic) OVER (PARTITION BY scan_id, path, line))""",
    "layered": """
  SELECT *, CASE WHEN rule_id LIKE 'entropy-%' THEN 'entropy' WHEN language = 'python' THEN 'ast'
      WHEN language IN ('infra', 'manifest') THEN language ELSE 'config' END AS layer,
    category = 'hardcoded-secret' AS is_secret,
    CASE rule_id WHEN 'aes-hardcoded-key' THEN 110 WHEN 'entropy-secret-high-confidence' THEN 100
      WHEN 'config-plaintext-secret' THEN 40 ELSE 30 END AS quality
  FROM specific JOIN sev USING (severity)""",
    "site": """
  SELECT scan_id, path, line, count(DISTINCT layer) AS layers,
    count(DISTINCT layer) FILTER (is_secret) AS secret_layers,
    max(sev_rank) FILTER (is_secret) AS worst FROM layered GROUP BY ALL""",
    "merged": """
  SELECT l.* EXCLUDE (severity, sev_rank, confidence, weight),
    CASE WHEN is_secret AND layers >= 2 AND secret_layers >= 2 THEN
      (['Informational', 'Low', 'Medium', 'High', 'Critical'])[worst + 1]
      ELSE l.severity END AS severity,
    CASE WHEN layers >= 2 THEN 'Confirmed' ELSE confidence END AS confidence
  FROM layered l JOIN site USING (scan_id, path, line)
  QUALIFY NOT (is_secret AND layers >= 2 AND secret_layers >= 2) OR
    row_number() OVER (PARTITION BY scan_id, path, line, is_secret
      ORDER BY quality DESC, sev_rank DESC, rule_id DESC) = 1""",
    "live": "SELECT * FROM facts WHERE NOT suppressed",
    "counts": """
  SELECT scan_id, count(*) AS findings,
    count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
    count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low,
    count(*) FILTER (quantum_vulnerable) AS quantum FROM live WHERE status <> 'RESOLVED'
  GROUP BY scan_id""",
    "counted": """
  SELECT s.*, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical,
    coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
    coalesce(quantum, 0) AS quantum FROM scans s LEFT JOIN counts USING (scan_id)""",
    "latest": """
  SELECT * FROM counted
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) = 1""",
    "components": """
  SELECT scan_id, primitive AS name, key_size, mode,
    'crypto-asset/' || lower(regexp_replace(primitive, '[^a-zA-Z0-9]+', '-', 'g')) AS bom_ref,
    count(*) AS occurrence_count, max(weight) AS max_weight,
    CASE WHEN max(weight) > 0 THEN first(severity ORDER BY weight DESC, seq) ELSE 'INFO' END
      AS max_severity, min(seq) AS comp_seq
  FROM live JOIN sev USING (severity) GROUP BY scan_id, primitive, key_size, mode""",
    "versions": """
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, scan_id) AS version,
    lag(scan_id) OVER (PARTITION BY repo_id ORDER BY created_at, scan_id) AS previous_scan_id
  FROM scans""",
}
_NEEDS = {
    "dedup": ["facts"], "specific": ["facts", "dedup"], "layered": ["facts", "sev", "dedup", "specific"],
    "site": ["facts", "sev", "dedup", "specific", "layered"],
    "merged": ["facts", "sev", "dedup", "specific", "layered", "site"],
    "live": ["facts"], "counts": ["facts", "live"], "counted": ["facts", "live", "scans", "counts"],
    "latest": ["facts", "live", "scans", "counts", "counted"],
    "components": ["facts", "sev", "live"], "versions": ["scans"],
}


def with_ctes(names: list[str], body: str, /, **extra: str) -> str:
    """``body`` behind the named common tables, what they need, and any extra ones."""
    order: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
