"""Severity, risk and label columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of a small fixed table for ``key``, inside the expression (no join)."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def sev_rank(severity: Column) -> Column:
    return lookup(fv.SEVERITY_RANK, severity, 0)


def sev_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in fv.SEVERITY_LADDER]), rank + 1)


def sev_weight(severity: Column) -> Column:
    return lookup(fv.SEVERITY_WEIGHT, F.upper(severity), 0)


def sev_label(score: Column) -> Column:
    return (
        F.when(score >= 80, "critical").when(score >= 60, "high")
        .when(score >= 40, "medium").when(score >= 20, "low").otherwise("info")
    )


def bump_severity(severity: Column) -> Column:
    known = F.array(*[F.lit(s) for s in fv.SEVERITY_LADDER])
    return F.when(
        F.array_contains(known, severity),
        sev_name(F.least(sev_rank(severity) + 1, F.lit(len(fv.SEVERITY_LADDER) - 1))),
    ).otherwise("High")


def quantum_status(risk: Column) -> Column:
    return F.when(risk.isin(fv.BROKEN, fv.WEAKENED), "Quantum Vulnerable").otherwise(
        "Quantum Safe"
    )


def fingerprint(rule_id: Column, algorithm: Column, snippet: Column) -> Column:
    raw = F.concat_ws(":", rule_id, algorithm, F.trim(snippet))
    return F.substring(F.sha2(raw, 256), 1, 16)


def _layer(language: Column, rule_id: Column) -> Column:
    entropy = rule_id.startswith("entropy-")
    return (
        F.when(language.isin("python", "javascript") & ~entropy, "ast")
        .when(entropy, "entropy")
        .when((language == "infra") | rule_id.contains("infra"), "infra")
        .when((language == "manifest") | rule_id.startswith("sca-"), "manifest")
    )


def layer_token(language: Column, rule_id: Column) -> Column:
    """Detection layer used for corroboration; everything else counts as config."""
    return F.coalesce(_layer(language, rule_id), F.lit("config"))


def detection_method(language: Column, rule_id: Column) -> Column:
    """Detection layer shown in reports; rules outside the config family are regex."""
    return F.coalesce(
        _layer(language, rule_id), F.when(rule_id.startswith("config-"), "config"), F.lit("regex")
    )


def infer_key_size(algorithm: Column, rule_id: Column) -> Column:
    label = F.upper(F.coalesce(algorithm, F.lit("")))
    size = F.when(F.lit(False), F.lit(0))
    for bits in (1024, 2048, 4096):
        size = size.when(label.contains(str(bits)) | rule_id.contains(str(bits)), bits)
    for bits in (256, 128, 192, 512):
        size = size.when(label.contains(str(bits)), bits)
    return (
        size.when(label.contains("DES") & ~label.contains("3DES"), 56)
        .when(label.contains("3DES"), 112)
        .when(label.contains("BLOWFISH") | label.contains("RC4"), 128)
    )


def stored_key_size(key_size: Column, algorithm: Column) -> Column:
    """Key size kept with a stored finding: the given one, else read from the label."""
    has = algorithm.contains
    return (
        F.when(F.coalesce(key_size, F.lit(0)) != 0, key_size)
        .when(has("1024"), 1024).when(has("2048"), 2048)
        .when(has("56") | (has("DES") & ~has("3DES")), 56)
        .when(has("256"), 256).when(has("128"), 128)
    )


def infer_library(tags: Column, rule_id: Column, language: Column) -> Column:
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    tag_text = F.concat_ws(" ", tags)
    named = F.filter(tags, lambda t: ~t.isin("sca", "npm", "pip", "maven"))
    return (
        F.when(F.array_contains(tags, "sca") & (F.size(named) > 0), F.get(named, F.lit(0)))
        .when(tag_text.contains("crypto-js") | rule_id.contains("cryptojs"), "crypto-js")
        .when(rule_id.contains("jsrsasign") | tag_text.contains("jsrsasign"), "jsrsasign")
        .when(F.array_contains(tags, "dockerfile"), "Dockerfile")
        .when(F.array_contains(tags, "nginx"), "nginx")
        .when(F.array_contains(tags, "apache"), "apache")
        .when(F.array_contains(tags, "terraform"), "terraform")
        .when(F.array_contains(tags, "k8s"), "kubernetes")
        .when((language == "python") & (tag_text.contains("pycryptodome") | rule_id.contains("aes")),
              "pycryptodome")
        .when(language == "python", "hashlib")
        .when(language.isin("javascript", "typescript"), "Node Builtin crypto")
        .otherwise("Standard Crypto API")
    )


def bom_ref(name: Column) -> Column:
    return F.concat(
        F.lit("crypto-asset/"), F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]+", "-"))
    )


def redact_literal(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit(" = <"), F.length(value).cast("string"), F.lit("-char literal>"))


def redact_stored(value: Column) -> Column:
    return F.when(value.isNotNull(), "[encrypted]")
