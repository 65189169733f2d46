"""Detector accuracy against expected rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_expected(actual: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Distinct (path, rule) pairs as tp, fp or fn.

    A path that expects nothing (null rule) only matters for what was found on it.
    """
    found = actual.select(key, "rule_id").distinct().withColumn("_found", F.lit(True))
    wanted = (
        expected.filter(F.col("rule_id").isNotNull()).select(key, "rule_id").distinct()
        .withColumn("_wanted", F.lit(True))
    )
    both = found.join(wanted, [key, "rule_id"], "full")
    return both.select(
        key, "rule_id",
        F.when(F.col("_found") & F.col("_wanted"), "tp").when(F.col("_found"), "fp")
        .otherwise("fn").alias("outcome"))


def rule_sets(actual: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Intersection, surplus and shortfall of two (path, rule) sets."""
    a, e = actual.distinct(), expected.distinct()
    return a.intersect(e), a.exceptAll(e), e.exceptAll(a)


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty))


def _scores(counts: DataFrame, empty_f1: float) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = counts.withColumn("precision", _ratio(tp, tp + fp, 1.0)).withColumn(
        "recall", _ratio(tp, tp + fn, 1.0))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _ratio(2 * p * r, p + r, empty_f1))


def _counted(outcomes: DataFrame, *by) -> DataFrame:
    n = lambda v: F.count_if(F.col("outcome") == v)
    return outcomes.groupBy(*by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))


def accuracy(outcomes: DataFrame) -> DataFrame:
    """Overall precision, recall and F1."""
    return _scores(_counted(outcomes), 0.0)


def layer_of(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.when(low.contains("fixtures/sca"), "SCA (Manifest)")
        .when(low.contains("fixtures/infra"), "Config / Infra")
        .when(low.contains("fixtures/config"), "Regex / Config")
        .otherwise("AST (Python/JS)")
    )


def accuracy_by_layer(outcomes: DataFrame, layer: Column | None = None) -> DataFrame:
    """The same per detection layer, to four digits."""
    layer = layer_of(F.col("path")) if layer is None else layer
    rated = _scores(_counted(outcomes, layer.alias("layer")), 1.0)
    for name in ("precision", "recall", "f1"):
        rated = rated.withColumn(name, F.round(name, 4))
    return rated


def gate(scores: DataFrame, f1: float = 0.90, precision: float = 0.85, recall: float = 0.90) -> DataFrame:
    """Whether the accuracy clears its floors (A10)."""
    return scores.withColumn(
        "passes",
        (F.col("f1") >= f1) & (F.col("precision") >= precision) & (F.col("recall") >= recall))
