"""Scored findings, migration plans and what-if scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions import scoring as s
from saltmarsh.operators.skew import split_join


def with_importance(rows: DataFrame, repos: DataFrame, model: str = "current") -> DataFrame:
    """Business importance of the repository, Standard when it is not known.

    ``repos`` is keyed by repo_id. A repository with a large share of the rows is dealt over tasks.
    """
    return split_join(
        rows, repos.select("repo_id", F.col("importance").alias("_importance")), ["repo_id"], "left"
    ).withColumn(
        "importance", s.business_importance(F.col("_importance"), model)
    ).drop("_importance")


def enrich(findings: DataFrame, context: Column | None = None, base_family: bool = False) -> DataFrame:
    """Family, purpose, guidance and score of every finding that is not suppressed.

    Needs primitive, key_size, mode, usage and importance. With ``base_family`` a full label
    such as 'RSA-2048' is read as its family and bits; by default the label stands as given.
    """
    kept = findings.filter(~F.col("suppressed"))
    primitive, bits = F.col("primitive"), F.col("key_size")
    family = s.base_family(primitive) if base_family else s.normalize_family(primitive)
    if base_family:
        bits = F.coalesce(bits, s.label_bits(primitive))
        primitive = family
    purpose = s.detect_purpose(F.col("usage"), context)
    out = kept.withColumn("family", family).withColumn("_purpose", purpose)
    out = (
        out.withColumn("purpose", F.col("_purpose.purpose"))
        .withColumn("purpose_confidence", F.col("_purpose.confidence"))
        .withColumn("_score", s.risk_score(
            primitive, bits, F.col("mode"), F.col("purpose"), F.col("importance")))
        .withColumn("_advice", s.migration_guidance(F.col("family"), F.col("purpose")))
    )
    return (
        out.withColumn("score", F.col("_score.score"))
        .withColumn("score_before", F.col("_score.before"))
        .withColumn("score_label", F.col("_score.label"))
        .withColumn("advice", F.col("_advice.advice"))
        .withColumn("standard", F.col("_advice.standard"))
        .withColumn("hybrid", s.hybrid_flag(F.col("family"), F.col("purpose")))
        .withColumn("agility", s.agility_score(F.col("family"), F.col("purpose"), bits, F.col("mode")))
        .drop("_purpose", "_score", "_advice")
    )


def finding_counts(enriched: DataFrame) -> DataFrame:
    """Findings per scan in the enriched view, joined on by whoever needs them."""
    return enriched.groupBy("scan_id").agg(F.count(F.lit(1)).alias("finding_count"))


# --- migration plan -----------------------------------------------------------
PRIORITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "NONE": 4, "UNKNOWN": 5}


def assess(findings: DataFrame, purpose_mode: str = "detected") -> DataFrame:
    """Priority, action group, steps and risk before/after of every finding.

    ``purpose_mode="unknown"`` reports every purpose as unknown.
    """
    family = s.normalize_family(F.col("primitive"))
    purpose = (
        F.lit("unknown") if purpose_mode == "unknown"
        else s.detect_purpose(F.col("usage"), spaced=False)["purpose"]
    )
    rows = findings.withColumn("family", family).withColumn("purpose", purpose)
    rows = rows.withColumn("_score", s.risk_score(
        F.col("primitive"), F.col("key_size"), F.col("mode"), F.col("purpose"),
        F.col("importance"))["score"])
    fam, use, score = F.col("family"), F.col("purpose"), F.col("_score")
    bits = F.col("key_size")
    broken = fam.isin(fv.CLASSICALLY_BROKEN)
    pqc = fam.isin(fv.POST_QUANTUM_PRIMITIVES)
    least = s.lookup(fv.RESISTANT_MIN_BITS, fam)
    weak = least.isNotNull() & (least > 0) & (F.coalesce(bits, F.lit(0)) > 0) & (bits < least)
    unknown = fam == "UNKNOWN"
    advice = s.migration_guidance(fam, use)["advice"]

    def pick(broken_v, pqc_v, weak_v, fine_v, unknown_v, other_v) -> Column:
        return (
            F.when(broken, broken_v).when(pqc, pqc_v).when(weak, weak_v)
            .when(least.isNotNull(), fine_v).when(unknown, unknown_v).otherwise(other_v)
        )

    none = F.lit(None).cast("string")
    steps = pick(
        F.array(
            F.concat(F.lit("Replace "), F.col("primitive"), F.lit(
                " immediately with a modern standard (e.g., SHA-256 or AES-GCM)")),
            F.lit("Audit all systems for compromise")),
        F.array(F.lit("Algorithm is already PQC. Monitor for implementation updates.")),
        F.array(F.concat(F.lit("Upgrade key size to at least "), least.cast("string"),
                         F.lit(" bits to ensure quantum resistance."))),
        F.array(F.lit("Algorithm is symmetric/hash and quantum-resistant. No immediate PQC "
                      "migration needed.")),
        F.array().cast("array<string>"),
        s.plan_steps(fam, use),
    )
    blocker = F.when(broken, F.lit(
        "Classically broken primitive in use; bypass PQC planning and replace immediately.")).when(
        unknown & ~pqc & least.isNull(),
        F.concat(F.lit("Cannot determine primitive family for "), F.col("primitive")))
    return (
        rows.withColumn("priority", pick(
            "CRITICAL", "NONE", "HIGH", "NONE", "UNKNOWN",
            F.when(score >= 70, "CRITICAL").when(score >= 40, "HIGH").otherwise("MEDIUM")))
        .withColumn("action_group", pick(
            "immediate", "long_term", "short_term", "long_term", "blocker",
            F.when(score >= 40, "short_term").otherwise("long_term")))
        .withColumn("recommended", pick(
            none, fam, F.concat(fam, F.lit("-"), least.cast("string")), fam, none, advice))
        .withColumn("hybrid", pick(
            F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit(True),
            s.hybrid_flag(fam, use)))
        .withColumn("quantum_state", F.when(broken, "Classically Broken").when(
            pqc | least.isNotNull(), "Quantum Safe").otherwise("Quantum Vulnerable"))
        .withColumn("agility", s.agility_score(fam, use, bits, F.col("mode")))
        .withColumn("risk_before", score)
        .withColumn("risk_after", pick(
            F.lit(15), score, F.lit(15), score, F.lit(None).cast("int"),
            F.greatest(F.lit(15), score - 50)))
        .withColumn("steps", steps).withColumn("blocker", blocker)
        .withColumn("action_rank", s.lookup(PRIORITY_RANK, F.col("priority"), 9))
        .drop("_score")
    )


def plan_actions(assessed: DataFrame) -> DataFrame:
    """The actions of every plan as rows; sort by (scan_id, action_group, action_rank).

    A plan's actions stay rows rather than one nested list: a scan may hold a third of all
    findings, and a list of those would not fit one task.
    """
    return assessed.filter(F.col("action_group") != "blocker")


def migration_plan(assessed: DataFrame) -> DataFrame:
    """Totals of every plan."""
    group = lambda g: F.count_if(F.col("action_group") == g)
    return assessed.groupBy("scan_id").agg(
        group("immediate").alias("immediate_actions"),
        group("short_term").alias("short_term_actions"),
        group("long_term").alias("long_term_actions"),
        F.count("blocker").alias("blockers"),
        F.count(F.lit(1)).alias("affected_assets"),
        F.greatest(F.lit(0), F.max("risk_before")).alias("overall_risk_before"),
        F.greatest(F.lit(0), F.coalesce(F.max("risk_after"), F.lit(0))).alias("overall_risk_after"),
        s.js_round(F.sum("agility") / F.count(F.lit(1))).alias("average_agility"),
    )


# --- component simulation -----------------------------------------------------
def simulate(components: DataFrame) -> DataFrame:
    """Support status, steps, guidance and sentence of every component."""
    family = s.normalize_family(F.col("primitive"))
    rows = components.withColumn("family", family)
    fam, use = F.col("family"), F.col("purpose")
    status = s.support_status(fam, F.col("primitive"), F.col("key_size"))
    guidance = s.migration_guidance(fam, use)
    hybrid = s.hybrid_flag(fam, use, "classic")
    return (
        rows.withColumn("status", status)
        .withColumn("advice", guidance["advice"])
        .withColumn("hybrid", hybrid)
        .withColumn("agility", s.agility_score(fam, use, F.col("key_size"), F.col("mode"), "classic"))
        .withColumn("steps", s.migration_steps(fam, use, F.col("key_size")))
        .withColumn("summary", s.status_summary(
            F.col("status"), F.col("primitive"), F.col("advice"), F.col("hybrid")))
    )


STATUS_WORDS = {
    "quantum-vulnerable": "quantum-vulnerable", "classically-broken": "classically broken",
    "quantum-weakened": "quantum-weakened", "quantum-resistant": "quantum-resistant",
    "already-pqc": "already PQC", "unknown": "unknown",
}


def migration_counts(simulated: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Components per status and the sentence that says so."""
    counts = simulated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == k).alias(k.replace("-", "_")) for k in STATUS_WORDS],
    )
    parts = F.concat_ws(", ", *[
        F.when(F.col(k.replace("-", "_")) > 0,
               F.concat(F.col(k.replace("-", "_")).cast("string"), F.lit(" " + word)))
        for k, word in STATUS_WORDS.items()
    ])
    return counts.withColumn("summary", F.concat(
        F.lit("Batch migration simulation of "), F.col("total").cast("string"),
        F.lit(" component(s): "),
        F.when(parts == "", "no classifications").otherwise(parts), F.lit(".")))


# --- what-if ------------------------------------------------------------------
def what_if(findings: DataFrame) -> DataFrame:
    """Mean score of a scan now and with each of its families migrated.

    Every distinct (primitive, size, mode, usage) is scored once; scans hold counts of them. The projected mean for a
    target is the scan's total with the target's own share swapped, so all targets are answered by two aggregates.
    """
    tuples = ["primitive", "key_size", "mode", "usage"]
    counted = findings.groupBy("scan_id", *tuples).agg(F.count(F.lit(1)).alias("_n"))
    kinds = (
        findings.select(*tuples).distinct().withColumn("target", s.normalize_family(F.col("primitive")))
        .withColumn("purpose", s.detect_purpose(F.col("usage"))["purpose"])
    )
    use = F.col("purpose")
    after = s.after_migration(s.migration_guidance(F.col("target"), use)["advice"])
    kinds = kinds.withColumn("_after", after).withColumn("_now", s.risk_score(
        F.col("primitive"), F.col("key_size"), F.col("mode"), use)["score"])
    then = s.risk_score(F.col("_after.primitive"), F.col("_after.bits"), F.col("_after.mode"), use)
    kinds = kinds.withColumn(
        "_then", F.when(F.col("_after").isNotNull(), then["score"]).otherwise(F.col("_now")))
    same = [counted[c].eqNullSafe(kinds[c]) for c in tuples]
    rows = counted.join(kinds, same).select("scan_id", "target", "_n", "_now", "_then")
    per_target = rows.groupBy("scan_id", "target").agg(
        F.sum(F.col("_now") * F.col("_n")).alias("_now"), F.sum(F.col("_then") * F.col("_n")).alias("_then"),
        F.sum("_n").alias("_n"))
    per_scan = per_target.groupBy("scan_id").agg(
        F.sum("_now").alias("_total"), F.sum("_n").alias("_count"))
    mean = lambda x: s.js_round(x / F.col("_count"))
    return (
        per_target.join(per_scan, "scan_id")
        .withColumn("current_score", mean(F.col("_total")))
        .withColumn("projected_score", mean(F.col("_total") - F.col("_now") + F.col("_then")))
        .withColumn("score_drop", F.greatest(
            F.lit(0), F.col("current_score") - F.col("projected_score")))
        .select("scan_id", "target", "current_score", "projected_score", "score_drop")
    )
