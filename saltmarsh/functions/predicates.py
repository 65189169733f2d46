"""Value and name predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv



def strip(col: Column) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def strip_chars(col: Column, chars: str) -> Column:
    return F.btrim(col, F.lit(chars))


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def is_secret_name(name: Column) -> Column:
    """A camel- or snake-case word of the name is a hint, or a compound hint is inside it."""
    words = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    single = words.rlike("(?:^|[^a-z0-9])" + _any_of(fv.SINGLE_SECRET_HINTS) + "(?:[^a-z0-9]|$)")
    compound = F.lower(name).rlike(_any_of(fv.COMPOUND_SECRET_HINTS))
    return F.coalesce(single | compound, F.lit(False))


def shannon_entropy(value: Column) -> Column:
    """Bits per character: the code points are sorted once, as numbers, and the runs of equal ones measured."""
    def once(v: Column, build) -> Column:
        return F.get(F.transform(F.array(v), build), F.lit(0))

    def of_sorted(codes: Column) -> Column:
        n = F.size(codes)
        ends = F.array_compact(F.transform(codes, lambda c, i: F.when(~c.eqNullSafe(F.get(codes, i + 1)), i + 1)))
        return once(ends, lambda at: F.aggregate(
            F.sort_array(F.transform(at, lambda end, k: end - F.coalesce(F.get(at, k - 1), F.lit(0)))), F.lit(0.0),
            lambda acc, count: acc - (count / n) * F.log2(count / n)))

    codes = F.sort_array(F.transform(F.split(value, ""), F.ascii))
    return F.when(F.length(value) > 0, once(codes, of_sorted)).otherwise(F.lit(0.0))


def is_placeholder(value: Column, kind: str = "entropy") -> Column:
    words, shape = fv.PLACEHOLDERS, fv.PLACEHOLDER_SHAPE
    if kind == "config":
        words, shape = words + fv.PLACEHOLDERS_CONFIG_EXTRA, fv.PLACEHOLDER_SHAPE_CONFIG
    bare = strip_chars(strip(value), "\"'")
    return F.lower(bare).isin(words) | bare.rlike(shape)


def is_likely_fp(value: Column, name: Column) -> Column:
    """Values that look like versions, links, paths, prose or plain identifiers."""
    words = F.size(F.filter(F.split(value, "[^A-Za-z0-9]+"), lambda w: w != ""))
    return (
        is_placeholder(value)
        | value.rlike(fv.VERSION_SHAPE)
        | (value.rlike(fv.URL_SHAPE) & ~value.rlike(fv.URL_WITH_LOGIN_SHAPE))
        | value.rlike(fv.PATH_SHAPE)
        | (value.contains(" ") & (words >= 3))
        | (value.rlike(fv.UUID_SHAPE) & ~is_secret_name(name))
    )


def is_high_entropy(value: Column, entropy: Column) -> Column:
    return (F.length(value) >= fv.MIN_SECRET_LEN) & (entropy >= fv.ENTROPY_THRESHOLD)


def is_secret_value(name: Column, value: Column, entropy: Column) -> Column:
    return is_high_entropy(value, entropy) | (
        is_secret_name(name) & (F.length(value) >= fv.MIN_NAME_HINT_LEN)
    )


def _norm(value: Column) -> Column:
    return strip_chars(F.lower(strip(value)), "\"'")


def _first_token(norm: Column) -> Column:
    return F.get(F.split(norm, r"[/_\-\s]", 2), F.lit(0))


def is_known_algorithm(value: Column) -> Column:
    names = fv.NON_CRYPTO_ALGORITHMS + fv.STRONG_ALGORITHMS + fv.OTHER_ALGORITHM_NAMES
    norm = _norm(value)
    known = norm.isin(names) | _first_token(norm).isin(names)
    return F.coalesce((F.length(value) > 0) & known, F.lit(False))


def classify_algorithm(value: Column) -> Column:
    """Weak-algorithm profile of a configured value, or null when it is fine or not crypto."""
    norm = _norm(value)
    first = _first_token(norm)

    def profile(label, rule_name, category, severity, advice):
        return F.struct(
            F.lit(label).alias("algorithm"), F.lit(rule_name).alias("rule_name"),
            F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            F.lit(advice).alias("recommendation"),
        )

    fine = fv.NON_CRYPTO_ALGORITHMS + fv.STRONG_ALGORITHMS
    skip = (F.length(value) == 0) | norm.isin(fine) | first.isin(fine)
    nothing = F.lit(None).cast(
        "struct<algorithm:string,rule_name:string,category:string,severity:string,"
        "recommendation:string>"
    )
    chain = F.when(skip, nothing)
    for label, rule_name, category, severity, advice, whole, head in fv.WEAK_CONFIG_ALGORITHMS:
        chain = chain.when(
            norm.isin(whole) | first.isin(head),
            profile(label, rule_name, category, severity, advice),
        )
    ecb = F.array_contains(F.split(norm, "-"), "ecb") | F.array_contains(F.split(norm, "_"), "ecb")
    return chain.when(ecb, profile(*fv.ECB_CONFIG)).otherwise(nothing)


def tls_disabled_labels(line: Column) -> Column:
    """Labels of every disabled-certificate-check pattern the line contains."""
    return F.array_compact(
        F.array(*[F.when(line.rlike(p), F.lit(label)) for p, label in fv.TLS_DISABLED])
    )


def directive(line: Column, patterns: list[str]) -> Column:
    """Value of the first directive form that the line uses, else null."""
    return F.coalesce(
        *[F.when(line.rlike(p), strip(F.regexp_extract(line, p, 1))) for p in patterns]
    )


def weak_tokens(value: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(value, F.lit(pattern), F.lit(0))))


def version_parts(version: Column) -> Column:
    """Leading numeric parts: '^9.0.1-rc' -> [9, 0, 1]."""
    bare = F.regexp_replace(strip(version), r"^[^\d]*", "")
    lead = F.regexp_extract(bare, r"^\d+[^.\-+]*(?:[.\-+]\d+[^.\-+]*)*+", 0)
    digits = F.transform(
        F.split(lead, r"[.\-+]"), lambda p: F.regexp_extract(p, r"^\d+", 0).try_cast("bigint")
    )
    return F.filter(digits, lambda d: d.isNotNull())


def version_below(version: Column, minimum: Column) -> Column:
    a, b = version_parts(version), version_parts(minimum)

    def padded(x: Column, y: Column) -> Column:
        missing = F.greatest(F.size(y) - F.size(x), F.lit(0))
        return F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), missing))

    return F.coalesce(
        (F.size(a) > 0) & (F.size(b) > 0) & (padded(a, b) < padded(b, a)), F.lit(False)
    )


def is_base64_secret(value: Column) -> Column:
    raw = F.try_to_binary(value, F.lit("base64"))
    text = strip(F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[^\\x00-\\x7f]", ""))
    return F.coalesce(F.length(text) >= 4, F.lit(False))


def is_terraform_literal(value: Column) -> Column:
    reference = value.rlike(r"^(?:var|local|data)\.") | (
        value.startswith("${") & value.rlike(r"(?:var|data|local)\.")
    )
    return ~reference & (F.length(value) >= 6)


def normalize_path(path: Column, root: str | None = None) -> Column:
    clean = F.replace(strip(path), F.lit("\\"), F.lit("/"))
    if root:
        clean = F.regexp_replace(clean, "(?i)^" + re.escape(root.rstrip("/")) + "/?", "")
    return F.regexp_replace(clean, r"^(?:\./)*+/*+", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.*[^.].*?(\.[^.]*)$", 1))


def clamp_line(line: Column, total: Column) -> Column:
    return F.greatest(F.lit(1), F.least(line, total))
