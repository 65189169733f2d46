"""Scores, guidance, plans and what-if queries over the finding facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import scoring as s
from saltmarsh.operators import risk
from saltmarsh.plans.catalog import Tables, query
from saltmarsh.plans.facts import finding_facts, repos, with_ctes
from saltmarsh import fixed_values as fv
from saltmarsh import migration_text as mt


def q(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


# --- SQL building blocks ------------------------------------------------------
FAMILY = "CASE primitive WHEN 'ECDSA' THEN 'ECC' WHEN 'SHA-1' THEN 'SHA1' ELSE primitive END"
PURPOSE = """CASE usage WHEN 'signature' THEN 'digital_signature' WHEN 'encryption' THEN 'data_encryption'
  WHEN 'hash' THEN 'integrity_hashing' WHEN 'password-hashing' THEN 'password_hashing'
  WHEN 'key exchange' THEN 'key_exchange' ELSE 'unknown' END"""
# the stored-finding variant does not map blanks and dashes
PURPOSE_STORED = """CASE usage WHEN 'signature' THEN 'digital_signature'
  WHEN 'encryption' THEN 'data_encryption' WHEN 'hash' THEN 'integrity_hashing' ELSE 'unknown' END"""


def sql_quantum(p: str, k: str) -> str:
    return f"""CASE WHEN upper({p}) IN ('RSA', 'ECC', 'ECDSA', 'ECDH', 'DSA', 'DH') THEN 100
  WHEN upper({p}) = 'AES' THEN CASE WHEN coalesce({k}, 0) < 192 THEN 60 WHEN {k} < 256 THEN 40 ELSE 20 END
  WHEN upper({p}) = 'CHACHA20' THEN 20 WHEN upper({p}) = 'SHA-256' THEN 15
  WHEN upper({p}) IN ('DES', '3DES', 'RC4', 'MD5', 'SHA1', 'SHA-1') THEN 100 ELSE 50 END"""


def sql_key(p: str, k: str, model: str = "current") -> str:
    exact = f"WHEN {k} = 2048 THEN 20" if model == "current" else ""
    return f"""CASE WHEN coalesce({k}, 0) = 0 THEN 50
  WHEN upper({p}) = 'RSA' THEN CASE WHEN {k} < 2048 THEN 90 {exact} WHEN {k} < 3072 THEN 55
    WHEN {k} < 4096 THEN 35 ELSE 20 END
  WHEN upper({p}) IN ('ECDSA', 'ECC') THEN CASE WHEN {k} < 256 THEN 80 WHEN {k} < 384 THEN 45 ELSE 25 END
  WHEN upper({p}) = 'AES' THEN CASE WHEN {k} < 128 THEN 100 WHEN {k} < 192 THEN 50 WHEN {k} < 256 THEN 30
    ELSE 10 END
  WHEN upper({p}) = 'DES' THEN 100 ELSE 30 END"""


def sql_deprecation(p: str, m: str) -> str:
    return f"""greatest(CASE upper({p}) WHEN 'MD5' THEN 100 WHEN 'SHA1' THEN 90 WHEN 'SHA-1' THEN 90
  WHEN 'DES' THEN 100 ELSE 0 END, CASE WHEN upper({m}) = 'ECB' THEN 70 ELSE 0 END)"""


SQL_USAGE = """CASE purpose WHEN 'key_exchange' THEN 90 WHEN 'digital_signature' THEN 90
  WHEN 'password_hashing' THEN 85 WHEN 'data_encryption' THEN 80 WHEN 'integrity_hashing' THEN 55
  ELSE 50 END"""


def half_up(x: str) -> str:
    return f"CAST(floor(({x}) + CAST(0.5 AS DOUBLE)) AS INTEGER)"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def sql_score(p: str, k: str, m: str, factor: str = "CAST(1.0 AS DOUBLE)", lifetime: str = "10") -> tuple[str, str]:
    """(score before, score after business context) of the current model."""
    quantum = sql_quantum(p, k)
    window = f"greatest(0, {lifetime} + 3 - 7)"
    exposure = f"""CASE WHEN {window} <= 0 THEN 0 WHEN {window} >= 15 THEN 100
      ELSE {half_up(f"{d(window)} / 15 * 100")} END"""
    raw = (
        f"({quantum}) * {d(0.40)} + ({sql_key(p, k)}) * {d(0.20)} + ({sql_deprecation(p, m)}) * {d(0.15)}"
        f" + ({SQL_USAGE}) * {d(0.10)} + ({half_up(f'({exposure}) * ({d(quantum)} / 100)')}) * {d(0.15)}"
    )
    before = half_up(f"least({d(100)}, greatest({d(0)}, {raw}))")
    return before, half_up(f"least({d(100)}, greatest({d(0)}, ({before}) * {factor}))")


LABEL = ("CASE WHEN {x} >= 80 THEN 'critical' WHEN {x} >= 60 THEN 'high' WHEN {x} >= 40 THEN 'medium' "
         "WHEN {x} >= 20 THEN 'low' ELSE 'info' END")
FACTOR = ("CASE importance WHEN 'Critical' THEN CAST(1.25 AS DOUBLE) WHEN 'Important' THEN CAST(1.1 AS DOUBLE) "
          "ELSE CAST(1.0 AS DOUBLE) END")


def sql_guidance(column: int, family: str = "family", purpose: str = "purpose") -> str:
    cells = {(r[0], r[1]): r[column] for r in fv.GUIDANCE}
    exact = " ".join(f"WHEN {family} = {q(f)} AND {purpose} = {q(p)} THEN {q(v)}" for (f, p), v in cells.items())
    broad = " ".join(f"WHEN {family} = {q(f)} THEN {q(v)}" for (f, p), v in cells.items() if p == "unknown")
    fallback = q(fv.MANUAL_REVIEW) if column == 2 else "NULL"
    return f"CASE {exact} {broad} ELSE {fallback} END"


def sql_steps(items: list[str]) -> str:
    return q(" > ".join(items))


BASE = f"SELECT f.*, {FAMILY} AS family, {PURPOSE} AS purpose FROM facts f"
STORED = f"SELECT f.*, {FAMILY} AS family, {PURPOSE_STORED} AS purpose FROM facts f"


# --- queries ------------------------------------------------------------------
@query("p23_p32_family_purpose", with_ctes(["facts"], f"""
SELECT finding_id, {FAMILY} AS family, {PURPOSE} AS purpose,
  CASE WHEN usage IS NULL THEN 'unresolved' ELSE 'declared' END AS purpose_confidence FROM facts"""))
def _(t: Tables):
    found = s.detect_purpose(F.col("usage"))
    return finding_facts(t).select(
        "finding_id", s.normalize_family(F.col("primitive")).alias("family"),
        found["purpose"].alias("purpose"), found["confidence"].alias("purpose_confidence"))


def _keyword_sql() -> str:
    hits = ", ".join(
        "(" + " + ".join(f"CAST(contains(x, {q(w)}) AS INTEGER)" for w in words) + f") AS {purpose}"
        for purpose, words in fv.PURPOSE_KEYWORDS.items())
    best = "greatest(" + ", ".join(fv.PURPOSE_KEYWORDS) + ")"
    cases = " ".join(f"WHEN {p} = {best} THEN '{p}'" for p in fv.PURPOSE_KEYWORDS)
    return (f"WITH texts AS (SELECT doc_id, lower(text) AS x FROM documents), "
            f"hits AS (SELECT doc_id, {hits} FROM texts) "
            f"SELECT doc_id, CASE WHEN {best} = 0 THEN 'unknown' {cases} END AS purpose FROM hits")


@query("p32_purpose_from_context", _keyword_sql())
def _(t: Tables):
    """Keyword hits over whole document texts decide the purpose."""
    found = s.detect_purpose(F.lit(None).cast("string"), F.col("text"))
    return t.wide("documents").select("doc_id", found["purpose"].alias("purpose"))


@query("p28_subscores", with_ctes(["facts"], f"""
SELECT finding_id, {sql_quantum('primitive', 'key_size')} AS quantum,
  {sql_key('primitive', 'key_size')} AS key, {sql_key('primitive', 'key_size', 'classic')} AS key_classic,
  {sql_deprecation('primitive', 'mode')} AS deprecation, {SQL_USAGE} AS usage FROM base""", base=BASE))
def _(t: Tables):
    p, k = F.col("primitive"), F.col("key_size")
    return finding_facts(t).select(
        "finding_id", s.quantum_score(p, k).alias("quantum"), s.key_score(p, k).alias("key"),
        s.key_score(p, k, "classic").alias("key_classic"),
        s.deprecation_score(p, F.col("mode")).alias("deprecation"),
        s.usage_score(s.detect_purpose(F.col("usage"))["purpose"]).alias("usage"))


LIFETIME = "CAST(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_suppkey % 30 END AS INTEGER)"


@query("p29_p30_exposure", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LIFETIME} AS y FROM lineitem),
w AS (SELECT *, greatest(0, coalesce(y, 10) + 3 - 7) AS win FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(win AS INTEGER) AS exposure_window,
  CASE WHEN win <= 0 THEN 0 WHEN win >= 15 THEN 100 ELSE {half_up("CAST(win AS DOUBLE) / 15 * 100")} END AS exposure,
  {half_up("least(CAST(100 AS DOUBLE), CAST(win AS DOUBLE) * 10) * 60 / 100")} AS exposure_classic,
  CASE WHEN coalesce(y, 10) >= 7 THEN 'high' WHEN coalesce(y, 10) >= 5 THEN 'medium' ELSE 'low' END AS tier,
  CASE WHEN greatest(0, coalesce(y, 5) - 7) > 0
    THEN least(100, {half_up("80 + CAST(coalesce(y, 5) - 7 AS DOUBLE) / 15 * 20")}) ELSE 60 END AS harvest_high,
  least(100, {half_up("60 * (CAST(0.4 AS DOUBLE) + CAST(greatest(0, coalesce(y, 5) - 7) AS DOUBLE) / 20 * CAST(0.6 AS DOUBLE))")}) AS harvest_mid
FROM w""")
def _(t: Tables):
    years = F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_suppkey") % 30).cast("int")
    rows = t.wide("lineitem").withColumn("y", years)
    window = s.exposure_window(F.col("y"))
    purpose = F.lit("digital_signature")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", window.alias("exposure_window"),
        s.exposure_score(window).alias("exposure"),
        s.exposure_score_classic(F.lit(60), s.exposure_window(F.col("y"), "classic")).alias("exposure_classic"),
        s.harvest_tier(F.col("y")).alias("tier"),
        s.harvest_score(purpose, F.lit(100), F.col("y")).alias("harvest_high"),
        s.harvest_score(purpose, F.lit(60), F.col("y")).alias("harvest_mid"))


BEFORE, SCORE = sql_score("primitive", "key_size", "mode", FACTOR)
CLASSIC_RAW = (
    f"({sql_quantum('primitive', 'key_size')}) * {d(0.4)} + ({sql_key('primitive', 'key_size', 'classic')}) * {d(0.3)}"
    f" + ({sql_deprecation('primitive', 'mode')}) * {d(0.2)} + ({SQL_USAGE}) * {d(0.1)}")
CLASSIC = half_up(f"least({d(100)}, greatest({d(0)}, {CLASSIC_RAW}))")
CLASSIC_BONUS = half_up(f"{d(60)} * ({sql_quantum('primitive', 'key_size')}) / 100")
CLASSIC_BEFORE = half_up(f"({CLASSIC}) * {d(0.7)} + ({CLASSIC_BONUS}) * {d(0.3)}")


@query("p31_j11_risk_score", with_ctes(["facts", "repos"], f"""
SELECT finding_id, importance, {BEFORE} AS before, {SCORE} AS score, {LABEL.format(x='(' + SCORE + ')')} AS label,
  {CLASSIC_BEFORE} AS classic_before, {LABEL.format(x='(' + CLASSIC + ')')} AS classic_label
FROM (SELECT b.*, coalesce(importance, 'Standard') AS importance FROM base b LEFT JOIN repos USING (repo_id))""",
    base=BASE))
def _(t: Tables):
    facts = finding_facts(t).select("repo_id", "finding_id", "primitive", "key_size", "mode", "usage")
    rows = risk.with_importance(facts, repos(t))
    p, k, m = F.col("primitive"), F.col("key_size"), F.col("mode")
    use = s.detect_purpose(F.col("usage"))["purpose"]
    now = s.risk_score(p, k, m, use, F.col("importance"))
    classic = s.risk_score(p, k, m, use, model="classic")
    return rows.select(
        "finding_id", "importance", now["before"].alias("before"), now["score"].alias("score"),
        now["label"].alias("label"), classic["before"].alias("classic_before"),
        classic["label"].alias("classic_label"))


@query("p33_p34_guidance", with_ctes(["facts"], f"""
SELECT finding_id, family, purpose, {sql_guidance(2)} AS advice, {sql_guidance(3)} AS standard,
  family IN ('RSA', 'ECC', 'DH', 'DSA') AND purpose IN ('key_exchange', 'digital_signature', 'unknown') AS hybrid,
  family IN ('RSA', 'ECC', 'DH', 'DSA') AND purpose IN ('key_exchange', 'digital_signature') AS hybrid_classic
FROM base""", base=BASE))
def _(t: Tables):
    rows = finding_facts(t).withColumn("family", s.normalize_family(F.col("primitive"))).withColumn(
        "purpose", s.detect_purpose(F.col("usage"))["purpose"])
    fam, use = F.col("family"), F.col("purpose")
    advice = s.migration_guidance(fam, use)
    return rows.select(
        "finding_id", "family", "purpose", advice["advice"].alias("advice"),
        advice["standard"].alias("standard"), s.hybrid_flag(fam, use).alias("hybrid"),
        s.hybrid_flag(fam, use, "classic").alias("hybrid_classic"))


AGILITY = """CASE WHEN family = 'ECC' AND purpose = 'key_exchange' AND key_size = 256 THEN 100
  WHEN family = 'RSA' AND purpose = 'digital_signature' AND key_size = 2048 THEN 85
  WHEN family = 'AES' AND purpose = 'data_encryption' AND key_size = 256 THEN 85
  WHEN family = 'AES' AND purpose = 'data_encryption' AND key_size = 128 THEN 75
  WHEN family = 'DES' AND purpose = 'data_encryption' AND key_size = 56 AND mode = 'ECB' THEN 20
  WHEN family = 'MD5' AND purpose = 'password_hashing' THEN 25
  WHEN family NOT IN ('ECC', 'RSA', 'AES', 'DES', 'MD5') THEN 30 ELSE 50 END"""
_cells = ", ".join(f"'{r[0]}|{r[1]}'" for r in fv.GUIDANCE)
AGILITY_CLASSIC = f"""CAST(least(100, greatest(0,
  CASE family WHEN 'ECC' THEN 40 WHEN 'RSA' THEN 30 WHEN 'AES' THEN 45 WHEN 'DES' THEN 10 WHEN 'MD5' THEN 10
    WHEN 'SHA1' THEN 15 ELSE 20 END
  + CASE purpose WHEN 'key_exchange' THEN 30 WHEN 'data_encryption' THEN 30 WHEN 'integrity_hashing' THEN 25
    WHEN 'digital_signature' THEN 25 WHEN 'password_hashing' THEN 20 ELSE 15 END
  + CASE WHEN family || '|' || purpose IN ({_cells}) THEN 30
    WHEN family || '|unknown' IN ({_cells}) THEN 10 ELSE 0 END)) AS INTEGER)"""


@query("p35_agility", with_ctes(["facts"], f"""
SELECT finding_id, {AGILITY} AS agility, {AGILITY_CLASSIC} AS agility_classic FROM base""", base=BASE))
def _(t: Tables):
    fam = s.normalize_family(F.col("primitive"))
    use = s.detect_purpose(F.col("usage"))["purpose"]
    args = (fam, use, F.col("key_size"), F.col("mode"))
    return finding_facts(t).select(
        "finding_id", s.agility_score(*args).alias("agility"),
        s.agility_score(*args, "classic").alias("agility_classic"))


STATUS = """CASE WHEN family = 'ML-KEM' THEN 'already-pqc'
  WHEN family IN ('MD5', 'SHA1', 'DES') THEN 'classically-broken'
  WHEN family = 'AES' THEN CASE WHEN coalesce(key_size, 0) = 0 OR key_size >= 192 THEN 'quantum-resistant'
    ELSE 'quantum-weakened' END ELSE 'quantum-vulnerable' END"""
_table = mt.COMPONENT_STEPS


def _signed(use: str, default: list[str]) -> str:
    rows = " ".join(
        f"WHEN family = {q(f)} THEN {sql_steps(v)}" for (p, f), v in _table.items()
        if p == use and f != "DEFAULT")
    return f"CASE {rows} ELSE {sql_steps(default)} END"


STEPS_SQL = f"""CASE WHEN status = 'already-pqc' THEN {sql_steps(mt.STEPS_POST_QUANTUM)}
  WHEN status = 'classically-broken' THEN CASE purpose
    WHEN 'password_hashing' THEN {sql_steps(mt.STEPS_PASSWORD)}
    WHEN 'integrity_hashing' THEN {sql_steps(mt.STEPS_BROKEN_HASH)} ELSE {sql_steps(mt.STEPS_BROKEN_CIPHER)} END
  WHEN status = 'quantum-resistant' AND purpose = 'integrity_hashing' THEN {sql_steps(mt.STEPS_ADEQUATE_HASH)}
  WHEN status = 'quantum-resistant' THEN {sql_steps(mt.STEPS_SYMMETRIC)}
  WHEN status = 'quantum-weakened' THEN 'Key size ' || key_size || '-bit is below the post-quantum minimum for '
    || family || ' > ' || {sql_steps(mt.STEPS_SYMMETRIC)}
  WHEN purpose = 'key_exchange' THEN {_signed('key_exchange', _table[('key_exchange', 'DEFAULT')])}
  WHEN purpose = 'digital_signature' THEN {_signed('digital_signature', _table[('digital_signature', 'DEFAULT')])}
  WHEN purpose = 'password_hashing' THEN {sql_steps(mt.STEPS_PASSWORD)}
  WHEN purpose IN ('data_encryption', 'integrity_hashing') THEN {sql_steps(mt.STEPS_REVIEW)}
  ELSE {sql_steps(mt.STEPS_GENERIC)} END"""
SENTENCE = f"""CASE status
  WHEN 'already-pqc' THEN primitive || ' is already a post-quantum algorithm — no migration required.'
  WHEN 'classically-broken' THEN primitive
    || ' is classically broken and requires IMMEDIATE replacement independent of quantum risk.'
  WHEN 'quantum-resistant' THEN primitive
    || ' is quantum-resistant at the current key size — no PQC migration required; focus on key hygiene.'
  WHEN 'quantum-weakened' THEN primitive
    || ' is quantum-weakened (insufficient key size) — increase key size to meet post-quantum minimums.'
  ELSE primitive || ' is broken by Shor''s algorithm — migrate to ' || {sql_guidance(2)}
    || CASE WHEN family IN ('RSA', 'ECC', 'DH', 'DSA') AND purpose IN ('key_exchange', 'digital_signature')
      THEN ' using a hybrid classical+PQC transition' ELSE '' END || '.' END"""
SIMULATED = {"base": BASE, "sim": f"SELECT * EXCLUDE (status), {STATUS} AS status FROM base"}


def _components(t: Tables):
    return finding_facts(t).withColumn("purpose", s.detect_purpose(F.col("usage"))["purpose"])


@query("p36_p37_p38_simulation", with_ctes(["facts"], f"""
SELECT finding_id, status, {STEPS_SQL} AS steps, {SENTENCE} AS summary FROM sim""", **SIMULATED))
def _(t: Tables):
    return risk.simulate(_components(t)).select(
        "finding_id", "status", F.concat_ws(" > ", "steps").alias("steps"), "summary")


_count = "count(*) FILTER (status = '{k}')"
_words = " || ', ' || ".join(["x"])
COUNTS_SQL = f"""
SELECT scan_id, total, quantum_vulnerable, classically_broken, quantum_weakened, quantum_resistant,
  already_pqc, unknown, 'Batch migration simulation of ' || total || ' component(s): ' || concat_ws(', ',
    CASE WHEN quantum_vulnerable > 0 THEN quantum_vulnerable || ' quantum-vulnerable' END,
    CASE WHEN classically_broken > 0 THEN classically_broken || ' classically broken' END,
    CASE WHEN quantum_weakened > 0 THEN quantum_weakened || ' quantum-weakened' END,
    CASE WHEN quantum_resistant > 0 THEN quantum_resistant || ' quantum-resistant' END,
    CASE WHEN already_pqc > 0 THEN already_pqc || ' already PQC' END) || '.' AS summary
FROM (SELECT scan_id, count(*) AS total,
  {_count.format(k='quantum-vulnerable')} AS quantum_vulnerable,
  {_count.format(k='classically-broken')} AS classically_broken,
  {_count.format(k='quantum-weakened')} AS quantum_weakened,
  {_count.format(k='quantum-resistant')} AS quantum_resistant,
  {_count.format(k='already-pqc')} AS already_pqc, {_count.format(k='unknown')} AS unknown
  FROM sim GROUP BY scan_id)"""


@query("a13_migration_counts", with_ctes(["facts"], COUNTS_SQL, **SIMULATED))
def _(t: Tables):
    return risk.migration_counts(risk.simulate(_components(t)))


B0, S0 = sql_score("primitive", "key_size", "mode", FACTOR)
ENRICHED = {
    "base": BASE,
    "scored": f"""SELECT b.*, coalesce(importance, 'Standard') AS importance FROM base b
      LEFT JOIN repos USING (repo_id) WHERE NOT suppressed""",
}


@query("p47_enrich", with_ctes(["facts", "repos"], f"""
SELECT finding_id, family, purpose, {S0} AS score, {LABEL.format(x='(' + S0 + ')')} AS score_label,
  {sql_guidance(2)} AS advice, {AGILITY} AS agility,
  count(*) OVER (PARTITION BY scan_id) AS finding_count FROM scored""", **ENRICHED))
def _(t: Tables):
    out = risk.enrich(risk.with_importance(finding_facts(t), repos(t)))
    return out.join(risk.finding_counts(out), "scan_id").select(
        "finding_id", "family", "purpose", "score", "score_label", "advice", "agility",
        "finding_count")


# --- migration plan -----------------------------------------------------------
PLAN_STEPS_SQL = "CASE " + " ".join(
    f"WHEN purpose = {q(p)} AND family = {q(f)} THEN {sql_steps(v)}"
    for (p, f), v in mt.PLAN_STEPS.items() if f != "DEFAULT") + " " + " ".join(
    f"WHEN purpose = {q(p)} THEN {sql_steps(v)}" for (p, f), v in mt.PLAN_STEPS.items() if f == "DEFAULT"
) + f" ELSE {sql_steps(mt.PLAN_STEPS_DEFAULT)} END"
PLAN = {
    "stored": STORED,
    "rated": f"""SELECT s.*, coalesce(importance, 'Standard') AS importance FROM stored s
      LEFT JOIN repos USING (repo_id) WHERE NOT suppressed""",
    "valued": f"SELECT *, {S0} AS score, {AGILITY} AS agility FROM rated",
    "assessed": f"""SELECT *,
      CASE WHEN family IN ('MD5', 'SHA1', 'DES') THEN 'CRITICAL' WHEN family = 'ML-KEM' THEN 'NONE'
        WHEN family = 'AES' AND coalesce(key_size, 0) > 0 AND key_size < 192 THEN 'HIGH'
        WHEN family = 'AES' THEN 'NONE' WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH'
        ELSE 'MEDIUM' END AS priority,
      CASE WHEN family IN ('MD5', 'SHA1', 'DES') THEN 'immediate' WHEN family = 'ML-KEM' THEN 'long_term'
        WHEN family = 'AES' AND coalesce(key_size, 0) > 0 AND key_size < 192 THEN 'short_term'
        WHEN family = 'AES' THEN 'long_term' WHEN score >= 40 THEN 'short_term' ELSE 'long_term' END AS action_group,
      CASE WHEN family IN ('MD5', 'SHA1', 'DES') THEN 15 WHEN family = 'ML-KEM' THEN score
        WHEN family = 'AES' AND coalesce(key_size, 0) > 0 AND key_size < 192 THEN 15
        WHEN family = 'AES' THEN score ELSE greatest(15, score - 50) END AS risk_after,
      CASE WHEN family IN ('MD5', 'SHA1', 'DES') THEN NULL WHEN family = 'ML-KEM' THEN family
        WHEN family = 'AES' AND coalesce(key_size, 0) > 0 AND key_size < 192 THEN 'AES-192'
        WHEN family = 'AES' THEN family ELSE {sql_guidance(2)} END AS recommended,
      CASE WHEN family IN ('MD5', 'SHA1', 'DES') THEN 'Replace ' || primitive
          || ' immediately with a modern standard (e.g., SHA-256 or AES-GCM) > Audit all systems for compromise'
        WHEN family = 'ML-KEM' THEN 'Algorithm is already PQC. Monitor for implementation updates.'
        WHEN family = 'AES' AND coalesce(key_size, 0) > 0 AND key_size < 192
          THEN 'Upgrade key size to at least 192 bits to ensure quantum resistance.'
        WHEN family = 'AES' THEN 'Algorithm is symmetric/hash and quantum-resistant. No immediate PQC migration needed.'
        ELSE {PLAN_STEPS_SQL} END AS steps
      FROM valued""",
}


def _assessed(t: Tables):
    kept = finding_facts(t).filter(~F.col("suppressed"))
    return risk.assess(risk.with_importance(kept, repos(t)))


@query("a12_t05_plan_actions", with_ctes(["facts", "repos"], """
SELECT scan_id, finding_id, action_group, priority, recommended, steps, score AS risk_before, risk_after,
  CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 4 END AS action_rank
FROM assessed ORDER BY scan_id, action_group, action_rank""", **PLAN))
def _(t: Tables):
    return risk.plan_actions(_assessed(t)).orderBy("scan_id", "action_group", "action_rank").select(
        "scan_id", "finding_id", "action_group", "priority", "recommended",
        F.concat_ws(" > ", "steps").alias("steps"), "risk_before", "risk_after", "action_rank")


@query("a12_migration_plan", with_ctes(["facts", "repos"], f"""
SELECT scan_id, count(*) FILTER (action_group = 'immediate') AS immediate_actions,
  count(*) FILTER (action_group = 'short_term') AS short_term_actions,
  count(*) FILTER (action_group = 'long_term') AS long_term_actions,
  count(*) FILTER (family IN ('MD5', 'SHA1', 'DES')) AS blockers, count(*) AS affected_assets,
  max(score) AS overall_risk_before, max(risk_after) AS overall_risk_after,
  {half_up("CAST(sum(agility) AS DOUBLE) / count(*)")} AS average_agility
FROM assessed GROUP BY scan_id""", **PLAN))
def _(t: Tables):
    return risk.migration_plan(_assessed(t))


_after = {"ML-KEM (Kyber)": ("'ML-KEM'", "768"), "ML-DSA (Dilithium)": ("'ML-DSA'", "1312")}
_now = sql_score("primitive", "key_size", "mode")[1]
_kem = sql_score("'ML-KEM'", "768", "NULL")[1]
_dsa = sql_score("'ML-DSA'", "1312", "NULL")[1]
_aes = sql_score("'AES'", "256", "'GCM'")[1]
WHAT_IF = {
    "base": BASE,
    "pairs": f"""SELECT scan_id, family AS target, {_now} AS now_score,
      CASE WHEN starts_with({sql_guidance(2)}, 'ML-KEM') THEN {_kem}
        WHEN starts_with({sql_guidance(2)}, 'ML-DSA') THEN {_dsa}
        WHEN starts_with({sql_guidance(2)}, 'Keep AES-256') THEN {_aes} ELSE {_now} END AS then_score
      FROM base""",
    "per_scan": "SELECT scan_id, sum(now_score) AS total, count(*) AS n FROM pairs GROUP BY scan_id",
    "per_target": """SELECT scan_id, target, sum(now_score) AS now_score, sum(then_score) AS then_score
      FROM pairs GROUP BY scan_id, target""",
    "means": f"""SELECT scan_id, target, {half_up('CAST(total AS DOUBLE) / n')} AS current_score,
      {half_up('CAST(total - now_score + then_score AS DOUBLE) / n')} AS projected_score
      FROM per_target JOIN per_scan USING (scan_id)""",
}


@query("a14_what_if", with_ctes(["facts"], """
SELECT scan_id, target, current_score, projected_score,
  greatest(0, current_score - projected_score) AS score_drop FROM means""", **WHAT_IF))
def _(t: Tables):
    return risk.what_if(finding_facts(t))
