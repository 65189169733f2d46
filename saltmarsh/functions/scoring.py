"""Purpose, exposure, risk, guidance and readiness columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh import migration_text as mt
from saltmarsh.functions.severity import lookup, sev_label


def js_round(x: Column) -> Column:
    """Round half up, as floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5)).cast("int")


def normalize_family(primitive: Column) -> Column:
    name = F.regexp_replace(F.upper(F.coalesce(primitive, F.lit(""))), r"[\s_]", "-")
    return (
        F.when(name.isin("ECDSA", "ECDH", "EDDSA", "ECC", "EC"), "ECC")
        .when(name.isin("SHA256", "SHA-256"), "SHA-256")
        .when(name.isin("SHA1", "SHA-1"), "SHA1")
        .otherwise(name)
    )


def base_family(label: Column) -> Column:
    """Family of a full label: 'RSA-2048' -> RSA, 'AES-256-CBC' -> AES."""
    head = F.regexp_extract(F.upper(label), r"^(SHA-?\d+|3DES|ML-KEM|ML-DSA|SLH-DSA|[A-Z]+\d*)", 1)
    return normalize_family(head)


def label_bits(label: Column) -> Column:
    return F.regexp_extract(label, r"-(\d{2,5})(?:-|$)", 1).try_cast("int")


# --- purpose ------------------------------------------------------------------
def detect_purpose(usage: Column, context: Column | None = None, spaced: bool = True) -> Column:
    """(purpose, confidence, source): declared use, else most keyword hits, else unknown.

    ``spaced`` maps blanks, slashes and dashes of the declared use to underscores first; the
    stored-finding variant (``spaced=False``) only trims it.
    """
    named = F.lower(usage)
    named = F.regexp_replace(F.regexp_replace(named, r"[\s/]+", "_"), "-", "_") if spaced else F.trim(named)
    declared = lookup(fv.USAGE_TO_PURPOSE, named)

    def answer(purpose, confidence: str, source: str) -> Column:
        value = purpose if isinstance(purpose, Column) else F.lit(purpose)
        return F.struct(value.alias("purpose"), F.lit(confidence).alias("confidence"),
                        F.lit(source).alias("source"))

    result = F.when(declared.isNotNull(), answer(declared, "declared", "scanner usageType"))
    if context is not None:
        text = F.lower(context)
        hits = F.array(*[
            F.struct(
                sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"),
                F.lit(-i).alias("order"), F.lit(purpose).alias("purpose"),
            )
            for i, (purpose, words) in enumerate(fv.PURPOSE_KEYWORDS.items())
        ])
        best = F.array_max(hits)
        result = result.when(best["n"] > 0, answer(best["purpose"], "inferred", "context keyword match"))
    return result.otherwise(answer("unknown", "unresolved", "no signal available"))


def context_text(context: Column) -> Column:
    """Function name, surrounding code and imports as one searchable text."""
    return F.concat_ws(" ", context["functionName"], context["surroundingCode"], context["imports"])


# --- sub-scores ---------------------------------------------------------------
def quantum_score(primitive: Column, bits: Column) -> Column:
    name = F.upper(primitive)
    size = F.coalesce(bits, F.lit(0))
    return (
        F.when(F.coalesce(F.length(primitive), F.lit(0)) == 0, 50)
        .when(name.isin(fv.SHOR_FAMILIES), 100)
        .when(name == "AES", F.when(size < 192, 60).when(size < 256, 40).otherwise(20))
        .when(name == "CHACHA20", 20)
        .when(name.isin("DES", "3DES", "RC4"), 100)
        .when(name.isin(fv.STRONG_HASHES), 15)
        .when(name.isin("MD5", "SHA1", "SHA-1"), 100)
        .otherwise(50)
    )


def key_score(primitive: Column, bits: Column, model: str = "current") -> Column:
    name = F.upper(primitive)
    factoring = F.when(bits < 2048, 90)
    if model == "current":
        factoring = factoring.when(bits == 2048, 20)
    factoring = factoring.when(bits < 3072, 55).when(bits < 4096, 35).otherwise(20)
    return (
        F.when(F.coalesce(F.length(primitive), F.lit(0)) == 0, 50)
        .when(F.coalesce(bits, F.lit(0)) == 0, 50)
        .when(name.isin("RSA", "DSA", "DH"), factoring)
        .when(name.isin("ECC", "ECDSA", "ECDH", "EDDSA"),
              F.when(bits < 256, 80).when(bits < 384, 45).otherwise(25))
        .when(name == "AES",
              F.when(bits < 128, 100).when(bits < 192, 50).when(bits < 256, 30).otherwise(10))
        .when(name.isin("DES", "3DES", "RC4", "RC2"), 100)
        .otherwise(30)
    )


def deprecation_score(primitive: Column, mode: Column) -> Column:
    own = lookup(fv.DEPRECATION, F.upper(primitive), 0)
    by_mode = lookup(fv.DEPRECATION, F.upper(mode), 0)
    return F.when(F.coalesce(F.length(primitive), F.lit(0)) == 0, 50).otherwise(
        F.greatest(own, by_mode))


def usage_score(purpose: Column) -> Column:
    return lookup(fv.USAGE_CRITICALITY, purpose, fv.USAGE_CRITICALITY["unknown"])


# --- exposure -----------------------------------------------------------------
def exposure_window(lifetime: Column, model: str = "current") -> Column:
    """Years the data outlives the threat horizon; null means the default lifetime."""
    fallback = 0 if model == "current" else fv.DEFAULT_LIFETIME_YEARS
    years = F.when(lifetime.isNull(), fv.DEFAULT_LIFETIME_YEARS).when(lifetime < 0, fallback).otherwise(lifetime)
    return F.greatest(F.lit(0), years + fv.MIGRATION_YEARS - fv.THREAT_HORIZON_YEARS)


def exposure_score(window: Column) -> Column:
    return F.when(window <= 0, 0).when(window >= 15, 100).otherwise(
        js_round(window.cast("double") / 15 * 100))


def exposure_score_classic(base: Column, window: Column) -> Column:
    scaled = F.least(F.lit(100.0), F.greatest(F.lit(0), window).cast("double") * 10)
    return F.when(base <= 0, 0).otherwise(js_round(scaled * base / 100))


def harvest_tier(lifetime: Column) -> Column:
    """Harvest-now-decrypt-later tier of data with this lifetime in years."""
    years = F.coalesce(lifetime, F.lit(fv.DEFAULT_LIFETIME_YEARS))
    return (
        F.when(years >= fv.THREAT_HORIZON_YEARS, "high")
        .when(years >= fv.THREAT_HORIZON_YEARS - 2, "medium").otherwise("low")
    )


def harvest_score(purpose: Column, quantum: Column, lifetime: Column | None = None) -> Column:
    by_purpose = lookup(fv.PURPOSE_LIFETIME_YEARS, purpose, fv.PURPOSE_LIFETIME_YEARS["unknown"])
    years = by_purpose if lifetime is None else F.coalesce(lifetime, by_purpose)
    window = F.greatest(F.lit(0), years - fv.THREAT_HORIZON_YEARS).cast("double")
    return (
        F.when((quantum >= 80) & (window > 0),
               F.least(F.lit(100), js_round(F.lit(80.0) + window / 15 * 20)))
        .when(quantum >= 80, 60)
        .when(quantum >= 40,
              F.least(F.lit(100), js_round(quantum * (F.lit(0.4) + window / 20 * 0.6))))
        .otherwise(js_round(quantum * F.lit(0.5)))
    )


# --- the score ----------------------------------------------------------------
def business_importance(value: Column, model: str = "current") -> Column:
    """Known importance by name whatever its case; Standard otherwise."""
    names = fv.MULTIPLIERS_CURRENT if model == "current" else fv.MULTIPLIERS_CLASSIC
    found = lookup({k.lower(): k for k in names}, F.lower(F.trim(value)))
    return F.coalesce(found, F.lit("Standard"))


def _clamped(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def risk_score(
    primitive: Column, bits: Column, mode: Column, purpose: Column,
    importance: Column | None = None, lifetime: Column | None = None, model: str = "current",
    multipliers: dict | None = None,
) -> Column:
    """Struct of sub-scores, the score before and after business context, and its label."""
    importance = F.lit("Standard") if importance is None else importance
    lifetime = F.lit(None).cast("int") if lifetime is None else lifetime
    quantum = quantum_score(primitive, bits)
    key = key_score(primitive, bits, model)
    deprecation = deprecation_score(primitive, mode)
    usage = usage_score(purpose)
    window = exposure_window(lifetime, model)
    if model == "current":
        w = fv.WEIGHTS_CURRENT
        exposure = js_round(exposure_score(window) * (quantum.cast("double") / 100))
        raw = (
            quantum * F.lit(w["quantum"]) + key * F.lit(w["key"])
            + deprecation * F.lit(w["deprecation"]) + usage * F.lit(w["usage"])
            + exposure * F.lit(w["exposure"])
        )
        before = js_round(_clamped(raw))
        factor = lookup(
            multipliers or fv.MULTIPLIERS_CURRENT, business_importance(importance), 1.0)
        score = js_round(_clamped(before * factor))
        labelled = score
    elif model == "classic":
        w = fv.WEIGHTS_CLASSIC
        exposure = exposure_score_classic(quantum, window)
        raw = (
            quantum * F.lit(w["quantum"]) + key * F.lit(w["key"])
            + deprecation * F.lit(w["deprecation"]) + usage * F.lit(w["usage"])
        )
        labelled = js_round(_clamped(raw))
        before = js_round(_clamped(labelled * F.lit(0.7) + exposure * F.lit(0.3)))
        factor = lookup(multipliers or fv.MULTIPLIERS_CLASSIC, importance, 1.0)
        score = js_round(F.least(F.lit(100.0), before * factor))
    else:
        raise ValueError(f"unknown model {model!r}")
    return F.struct(
        quantum.alias("quantum"), key.alias("key"), deprecation.alias("deprecation"),
        usage.alias("usage"), exposure.alias("exposure"), window.alias("window"),
        before.alias("before"), score.alias("score"), factor.alias("multiplier"),
        sev_label(labelled).alias("label"),
    )


# --- guidance -----------------------------------------------------------------
def migration_guidance(family: Column, purpose: Column) -> Column:
    """(advice, standard, rationale) for family and purpose, else for the family alone.

    The 16 authored cells are one map inside the expression, so no join is planned.
    """
    cells = F.create_map(*[
        x for fam, pur, advice, standard, why in fv.GUIDANCE
        for x in (F.lit(f"{fam}|{pur}"), F.struct(
            F.lit(advice).alias("advice"), F.lit(standard).alias("standard"),
            F.lit(why).alias("rationale")))
    ])
    families = sorted({row[0] for row in fv.GUIDANCE})
    none = F.lit(None).cast("string")
    unknown_family = F.struct(
        F.lit(fv.MANUAL_REVIEW).alias("advice"), none.alias("standard"),
        F.concat(F.lit('No migration guidance authored yet for primitive family "'), family,
                 F.lit('". Do not guess — flag for manual crypto review.')).alias("rationale"))
    unmapped = F.struct(
        F.lit(fv.MANUAL_REVIEW).alias("advice"), none.alias("standard"),
        F.concat(F.lit('Purpose "'), purpose, F.lit('" not mapped for '), family,
                 F.lit(". Confirm real usage before recommending a migration target."))
        .alias("rationale"))
    cell = lambda p: F.try_element_at(cells, F.concat(family, F.lit("|"), p))
    return F.when(~family.isin(families), unknown_family).otherwise(
        F.coalesce(cell(purpose), cell(F.lit("unknown")), unmapped))


def has_guidance(family: Column, purpose: Column) -> Column:
    return F.concat(family, F.lit("|"), purpose).isin([f"{r[0]}|{r[1]}" for r in fv.GUIDANCE])


def hybrid_flag(family: Column, purpose: Column, model: str = "current") -> Column:
    purposes = ["key_exchange", "digital_signature"] + (["unknown"] if model == "current" else [])
    return family.isin(fv.HYBRID_FAMILIES) & purpose.isin(purposes)


def agility_score(
    family: Column, purpose: Column, bits: Column, mode: Column, model: str = "current"
) -> Column:
    """Readiness for migration: a table of cases, or (classic) base + purpose + bonus."""
    if model == "current":
        case = lambda f, p, b: (family == f) & (purpose == p) & (bits == b)
        return (
            F.when(case("ECC", "key_exchange", 256), 100)
            .when(case("RSA", "digital_signature", 2048), 85)
            .when(case("AES", "data_encryption", 256), 85)
            .when(case("AES", "data_encryption", 128), 75)
            .when(case("DES", "data_encryption", 56) & (mode == "ECB"), 20)
            .when((family == "MD5") & (purpose == "password_hashing"), 25)
            .when(~family.isin("ECC", "RSA", "AES", "DES", "MD5"), 30)
            .otherwise(50)
        )
    bonus = (
        F.when(has_guidance(family, purpose), 30)
        .when(has_guidance(family, F.lit("unknown")), 10).otherwise(0)
    )
    total = lookup(fv.AGILITY_BASE, family, 20) + lookup(fv.AGILITY_PURPOSE, purpose, 15) + bonus
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


# --- support status, steps, sentences -----------------------------------------
def support_status(family: Column, primitive: Column, bits: Column) -> Column:
    name, raw = F.upper(family), F.upper(F.coalesce(primitive, F.lit("")))
    least = lookup(fv.RESISTANT_MIN_BITS, name)
    size = F.coalesce(bits, F.lit(0))
    return (
        F.when(name.isin(fv.POST_QUANTUM_PRIMITIVES) | raw.isin(fv.POST_QUANTUM_PRIMITIVES),
               "already-pqc")
        .when(name.isin(fv.CLASSICALLY_BROKEN) | raw.isin(fv.CLASSICALLY_BROKEN),
              "classically-broken")
        .when(least.isNotNull(),
              F.when((size == 0) | (size >= least), "quantum-resistant").otherwise("quantum-weakened"))
        .when((F.coalesce(F.length(family), F.lit(0)) == 0) | (family == "UNKNOWN"), "unknown")
        .otherwise("quantum-vulnerable")
    )


def _strings(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _step_map(table: dict) -> Column:
    return F.create_map(*[
        x for (purpose, family), steps in table.items()
        for x in (F.lit(f"{purpose}|{family}"), _strings(steps))
    ])


def migration_steps(family: Column, purpose: Column, bits: Column) -> Column:
    """Ordered steps for one component."""
    name, use = F.upper(family), F.lower(purpose)
    table = _step_map(mt.COMPONENT_STEPS)
    least = lookup(fv.RESISTANT_MIN_BITS, name)
    size = F.coalesce(bits, F.lit(0))
    at = lambda fam: F.try_element_at(table, F.concat(use, F.lit("|"), fam))
    return (
        F.when(name.isin(fv.POST_QUANTUM_PRIMITIVES), _strings(mt.STEPS_POST_QUANTUM))
        .when(name.isin(fv.CLASSICALLY_BROKEN),
              F.when(use == "password_hashing", _strings(mt.STEPS_PASSWORD))
              .when(use == "integrity_hashing", _strings(mt.STEPS_BROKEN_HASH))
              .otherwise(_strings(mt.STEPS_BROKEN_CIPHER)))
        .when(least.isNotNull() & ((size == 0) | (size >= least)),
              F.when(use == "integrity_hashing", _strings(mt.STEPS_ADEQUATE_HASH))
              .otherwise(_strings(mt.STEPS_SYMMETRIC)))
        .when(least.isNotNull(), F.concat(
            F.array(F.concat(
                F.lit("Key size "), bits.cast("string"),
                F.lit("-bit is below the post-quantum minimum for "), family)),
            _strings(mt.STEPS_SYMMETRIC)))
        .when(use.isin("key_exchange", "digital_signature"),
              F.coalesce(at(name), at(F.lit("DEFAULT"))))
        .when(use == "password_hashing", _strings(mt.STEPS_PASSWORD))
        .when(use.isin("data_encryption", "integrity_hashing"), _strings(mt.STEPS_REVIEW))
        .otherwise(_strings(mt.STEPS_GENERIC))
    )


def plan_steps(family: Column, purpose: Column) -> Column:
    """Ordered steps for a vulnerable primitive inside a whole-scan plan."""
    table = _step_map(mt.PLAN_STEPS)
    at = lambda fam: F.try_element_at(table, F.concat(purpose, F.lit("|"), fam))
    return F.coalesce(at(family), at(F.lit("DEFAULT")), _strings(mt.PLAN_STEPS_DEFAULT))


def status_summary(status: Column, algorithm: Column, advice: Column, hybrid: Column) -> Column:
    say = lambda tail: F.concat(algorithm, F.lit(tail))
    return (
        F.when(status == "already-pqc", say(
            " is already a post-quantum algorithm — no migration required."))
        .when(status == "classically-broken", say(
            " is classically broken and requires IMMEDIATE replacement independent of quantum "
            "risk."))
        .when(status == "quantum-resistant", say(
            " is quantum-resistant at the current key size — no PQC migration required; focus on "
            "key hygiene."))
        .when(status == "quantum-weakened", say(
            " is quantum-weakened (insufficient key size) — increase key size to meet "
            "post-quantum minimums."))
        .when(status == "quantum-vulnerable", F.concat(
            algorithm, F.lit(" is broken by Shor's algorithm — migrate to "), advice,
            F.when(hybrid, " using a hybrid classical+PQC transition").otherwise(""), F.lit(".")))
        .when(status == "unknown", say(
            " is an unrecognized primitive — flag for manual cryptographic review before planning "
            "any migration."))
    )


def after_migration(advice: Column) -> Column:
    """(primitive, bits, mode) once the advice has been followed, or null."""
    chain = None
    for prefix, primitive, bits, mode in fv.AFTER_MIGRATION:
        value = F.struct(
            F.lit(primitive).alias("primitive"), F.lit(bits).cast("int").alias("bits"),
            F.lit(mode).cast("string").alias("mode"))
        hit = advice.startswith(prefix)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain
