"""Column layouts shared by all detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "scan_id string, repo_id string, path string, text string"

FINDING_FIELDS = {
    "line": "int", "col": "int", "language": "string", "rule_id": "string",
    "rule_name": "string", "category": "string", "algorithm": "string", "severity": "string",
    "quantum_risk": "string", "message": "string", "recommendation": "string",
    "snippet": "string", "specificity": "int", "generic": "boolean", "confidence": "string",
    "tags": "array<string>",
}
FINDING_STRUCT = "struct<" + ",".join(f"{k}:{v}" for k, v in FINDING_FIELDS.items()) + ">"

# order in which detection layers emit, used when the first emitted finding is kept
LAYER_ORDER = {"manifest": 0, "infra": 1, "code": 2, "config": 2, "entropy": 3}

SOURCE_FINDINGS = """
repoId string, language string,
findings array<struct<
  id: string, file: string, line: int, primitive: string, keySize: int, mode: string,
  context: struct<functionName: string, surroundingCode: string,
                  imports: array<string>, usageType: string>>>
"""


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(
    line, language, rule_id, rule_name, category, algorithm, severity, quantum_risk,
    recommendation, snippet, message=None, specificity=1, generic=False, confidence="Likely",
    tags=(), col=0,
) -> Column:
    """One finding as a struct column; scalars become literals."""
    name = lit(rule_name)
    text = (
        F.concat(name, F.lit(" at line "), lit(line).cast("string"), F.lit("."))
        if message is None else lit(message)
    )
    tag_array = tags if isinstance(tags, Column) else F.array(*[lit(t) for t in tags])
    values = {
        "line": line, "col": col, "language": language, "rule_id": rule_id,
        "rule_name": name, "category": category, "algorithm": algorithm, "severity": severity,
        "quantum_risk": quantum_risk, "message": text, "recommendation": recommendation,
        "snippet": snippet, "specificity": specificity, "generic": generic,
        "confidence": confidence, "tags": tag_array,
    }
    return F.struct(*[
        lit(values[k]).cast(t).alias(k) for k, t in FINDING_FIELDS.items()
    ])


def some(*candidates: Column) -> Column:
    """Array of the findings that are not null."""
    return F.array_compact(F.array(*[c.cast(FINDING_STRUCT) for c in candidates]))


def explode_findings(df, found: Column, layer: str):
    """Findings as rows, keeping the file key and adding the emission order."""
    out = df.select("scan_id", "repo_id", "path", F.posexplode(found).alias("_n", "f"))
    return out.select(
        "scan_id", "repo_id", "path", "f.*",
        F.struct(
            F.lit(LAYER_ORDER[layer]).alias("layer"), F.col("f.line").alias("line"),
            F.col("_n").alias("n"), F.col("f.rule_id").alias("rule_id"),
        ).alias("emit_seq"),
    )
