"""The whole scan as one lazy plan: files → reported findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.severity import (
    detection_method, fingerprint, infer_key_size, infer_library, sev_rank,
)
from saltmarsh.operators import consolidate as c
from saltmarsh.operators.detect_calls import detect_javascript, detect_python
from saltmarsh.operators.detect_config import detect_config, detect_infra
from saltmarsh.operators.detect_dependencies import detect_dependencies
from saltmarsh.operators.detect_secrets import detect_entropy_secrets
from saltmarsh.session import stored
from saltmarsh.sources.corpus import KINDS_OF_LAYER, layers_of, prune_paths


#: Columns besides the key that folding, merging and correlating read, and what a derived column is worked out from.
READ = ("language", "category", "severity", "confidence", "generic", "algorithm", "emit_seq")
READ_FOR = {"fingerprint": ["snippet"], "library": ["tags"]}


def raw_findings(files: DataFrame, profile: str = "pipeline") -> DataFrame:
    """Union of all layers. Each layer filters on the path before it touches the text.

    A corpus stored by ``store_corpus`` carries its ``kind`` as a partition column; then each
    layer reads only the folders of the kinds it looks at.
    """
    kept = prune_paths(files)

    def of(layer: str) -> DataFrame:
        own = kept.filter(F.col("kind").isin(KINDS_OF_LAYER[layer])) if "kind" in kept.columns else kept
        return own.drop("kind").filter(F.array_contains(layers_of(F.col("path"), profile), layer))

    return c.union_layers(
        detect_dependencies(of("manifest")),
        detect_infra(of("infra")),
        detect_python(of("python")),
        detect_javascript(of("javascript")),
        detect_config(of("config")),
        detect_entropy_secrets(of("entropy")),
    )


def scan_files(
    files: DataFrame, rules: DataFrame | None = None, profile: str = "pipeline",
    strict_paths: bool = False, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Detect, fold duplicates, merge layers, correlate, apply the allow-list.

    ``columns`` names those that the caller reads; without it all are given. What no step and no caller reads is not folded, shuffled or written.
    """
    found = raw_findings(files, profile)
    if columns is not None:
        read = {*c.KEY, *READ, *columns, *(x for name in columns for x in READ_FOR.get(name, [])), *(READ_FOR["fingerprint"] if rules is not None else [])}
        found = found.select(*[x for x in found.columns if x in read])
    # Findings are tiny next to the texts and are read several times below, so they are
    # written once: the corpus is then read once, whatever happens to an executor.
    found = stored(c.merge_layers(c.drop_generic(c.exact_dedup(found))))
    found = c.correlate_dependencies(found)
    if "snippet" in found.columns:
        found = found.withColumn(
            "fingerprint", fingerprint(F.col("rule_id"), F.col("algorithm"), F.col("snippet")))
    if rules is None:
        found = found.withColumn("suppressed", F.lit(False)).withColumn(
            "suppression_reason", F.lit(""))
    else:
        found = c.apply_suppressions(found, rules, strict_paths)
    if "tags" in found.columns:
        found = found.withColumn("library", infer_library(F.col("tags"), F.col("rule_id"), F.col("language")))
    found = (
        found.withColumn("sev_rank", sev_rank(F.col("severity")))
        .withColumn("key_size", infer_key_size(F.col("algorithm"), F.col("rule_id")))
        .withColumn("detection_method", detection_method(F.col("language"), F.col("rule_id")))
    )
    last = ["sev_rank", "key_size", "library", "detection_method"]
    return found.select(*columns) if columns is not None else found.select(*[x for x in found.columns if x not in last], *last)
