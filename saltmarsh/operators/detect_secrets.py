"""Literal secrets by entropy and name (D21) and generic line rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions import predicates as p
from saltmarsh.functions.severity import redact_literal
from saltmarsh.functions.text import assignments, let, to_lines
from saltmarsh.schemas import explode_findings, finding


def secret_candidates(files: DataFrame) -> DataFrame:
    """Assignments whose value is a secret by entropy, by name, or both."""
    name, value = F.col("name"), F.col("value")
    kept = (
        assignments(files)
        .filter((F.length(value) > 0) & ~p.is_likely_fp(value, name))
        # entropy is worked out once, and only for values that a signal can still accept
        .withColumn("name_hit", p.is_secret_name(name))
        .filter(
            (F.length(value) >= fv.MIN_SECRET_LEN)
            | (F.col("name_hit") & (F.length(value) >= fv.MIN_NAME_HINT_LEN))
        )
        .withColumn("entropy", p.shannon_entropy(value))
        .withColumn("entropy_hit", p.is_high_entropy(value, F.col("entropy")))
    )
    return kept.filter(
        F.col("entropy_hit")
        | (F.col("name_hit") & (F.length(value) >= fv.MIN_NAME_HINT_LEN))
    )


def detect_entropy_secrets(files: DataFrame) -> DataFrame:
    both = F.col("entropy_hit") & F.col("name_hit")
    only_entropy = F.col("entropy_hit")
    rule = (
        F.when(both, "entropy-secret-high-confidence")
        .when(only_entropy, "entropy-secret-high-entropy-only")
        .otherwise("entropy-secret-name-hint-only")
    )
    rule_name = (
        F.when(both, "High-entropy secret (name + entropy confirmed)")
        .when(only_entropy, "High-entropy literal (entropy only)")
        .otherwise("Possible secret (name hint only)")
    )
    label, _, risk, advice = fv.HARDCODED_KEY
    message = F.format_string(
        "Identifier '%s' assigned a literal value that appears to be a secret "
        "(entropy=%.2f bits/char, len=%d).",
        F.col("name"), F.col("entropy"), F.length("value"),
    )
    found = finding(
        F.col("line"), F.col("language"), rule, rule_name, "hardcoded-secret", label,
        F.when(only_entropy, "High").otherwise("Medium"), risk, advice,
        redact_literal(F.col("name"), F.col("value")), message,
        confidence=F.when(both, "Likely").otherwise("Possible"),
        tags=("entropy", "hardcoded-secret"),
    )
    return explode_findings(secret_candidates(files), F.array(found), "entropy")


def detect_line_rules(files: DataFrame) -> DataFrame:
    """Lines × the seven generic rules, as one array per line instead of a join.

    Every pattern needs one of a few words, so a file without any of them is dropped by a plain
    substring search before its text is split or a pattern runs.
    """
    words = F.array(*[F.lit(w) for w in fv.LINE_RULE_WORDS])
    maybe = let(F.lower("text"), lambda low: F.exists(words, lambda w: F.contains(low, w)))
    lines = to_lines(files.filter(maybe))
    hits = F.array_compact(F.array(*[
        F.when(
            F.col("raw").rlike(pattern),
            F.struct(
                F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"),
                F.lit(category).alias("category"), F.lit(severity).alias("severity"),
                F.lit(quantum).alias("quantum"), F.lit(advice).alias("recommendation"),
            ),
        )
        for rule_id, name, category, severity, quantum, pattern, advice in fv.LINE_RULES
    ]))
    keep = [c for c in lines.columns if c != "raw"]
    return lines.select(
        *keep, F.trim("raw").alias("snippet"), F.explode(hits).alias("r")
    ).select(*keep, "snippet", "r.*")

