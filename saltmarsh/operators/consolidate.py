"""From raw findings to the reported set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions import predicates as p
from saltmarsh.functions.severity import fingerprint, layer_token, lookup, sev_name, sev_rank
from saltmarsh.operators.ranking import with_position
from saltmarsh.operators.resolve import look_up
from saltmarsh.operators.skew import heavy_counts, sized_join, split_join
from saltmarsh.session import stored

SITE = ["scan_id", "path", "line"]
KEY = [*SITE, "rule_id"]
LAYER_BIT = {"ast": 1, "entropy": 2, "infra": 4, "manifest": 8, "config": 16}


def union_layers(*layers: DataFrame) -> DataFrame:
    """All layers' findings as one table."""
    return reduce(lambda a, b: a.unionByName(b), layers)


def exact_dedup(findings: DataFrame) -> DataFrame:
    """Keep the first emitted finding per (scan, path, line, rule).

    An aggregate, not a window: repeats of one key fold together before the shuffle, so a
    key that holds a third of all rows costs one row per map task.
    """
    rest = [c for c in findings.columns if c not in KEY]
    return (
        findings.groupBy(*KEY)
        .agg(F.min_by(F.struct(*rest), "emit_seq").alias("_first"))
        .select(*KEY, "_first.*")
    )


def first_emitted(findings: DataFrame, *wanted: str) -> DataFrame:
    """``exact_dedup`` of the key and the ``wanted`` columns alone, so that nothing else is shuffled, spilled or written."""
    return exact_dedup(findings.select(*KEY, *wanted, "emit_seq")).drop("emit_seq")


def _site():
    # After exact_dedup a site holds each rule once, so the rule catalogue bounds it.
    return Window.partitionBy(*SITE)


def drop_generic(findings: DataFrame) -> DataFrame:
    """Drop catch-all findings where a specific one shares the site."""
    return (
        findings.withColumn("_specific", F.max(~F.col("generic")).over(_site()))
        .filter(~(F.col("generic") & F.col("_specific")))
        .drop("_specific")
    )


def is_secret_finding() -> Column:
    return F.col("category").isin("hardcoded-secret", "secret") | (
        F.col("rule_id") == "aes-hardcoded-key"
    )


def merge_layers(findings: DataFrame) -> DataFrame:
    """One row for a secret that several layers report; confirm corroborated sites."""
    secret = is_secret_finding()
    bit = lookup(LAYER_BIT, layer_token(F.col("language"), F.col("rule_id")))
    quality = F.struct(
        lookup(fv.RULE_QUALITY, F.col("rule_id"), fv.RULE_QUALITY_DEFAULT).alias("q"),
        sev_rank(F.col("severity")).alias("s"), F.col("rule_id").alias("r"),
    )
    marked = (
        findings.withColumn("_secret", secret).withColumn("_bit", bit)
        .withColumn("_quality", F.when(secret, quality))
    )
    site = _site()
    marked = (
        marked.withColumn("_layers", F.bit_count(F.bit_or("_bit").over(site)))
        .withColumn(
            "_secret_layers",
            F.coalesce(F.bit_count(F.bit_or(F.when(F.col("_secret"), F.col("_bit"))).over(site)),
                       F.lit(0)))
        .withColumn("_best", F.max("_quality").over(site))
        .withColumn("_worst", F.max(F.when(F.col("_secret"), sev_rank(F.col("severity")))).over(site))
    )
    merged = F.col("_secret") & (F.col("_layers") >= 2) & (F.col("_secret_layers") >= 2)
    helpers = ["_secret", "_bit", "_quality", "_layers", "_secret_layers", "_best", "_worst"]
    return (
        marked.filter(~merged | (F.col("_quality") == F.col("_best")))
        .withColumn("severity", F.when(merged, sev_name(F.col("_worst"))).otherwise(F.col("severity")))
        .withColumn(
            "confidence",
            F.when(F.col("_layers") >= 2, "Confirmed").otherwise(F.col("confidence")))
        .drop(*helpers)
    )


# --- manifest ↔ source (J04) --------------------------------------------------
def _label_parts(label: Column, separators: str) -> Column:
    return F.filter(F.split(label, separators), lambda x: x != "")


def _among(rows: DataFrame, table: DataFrame, group: list[str], name: str) -> DataFrame:
    """The rows whose ``name`` the ``table`` has in their group."""
    held = table.select(*group, name, F.lit(True).alias("_is"))
    return look_up(rows, F.col(name), held, group, name, "_is", "_among").where("_among").drop("_among")


def correlate_dependencies(findings: DataFrame) -> DataFrame:
    """Confirm manifest findings whose algorithm the source uses, and those source findings.

    Works on the distinct (scan, algorithm label) pairs. Which catalogue algorithms a label
    holds is an expression over the fixed catalogue, so names meet by equality. What a scan's task holds is the scan's distinct rules
    and labels, sorted and spilled, and not its findings.
    """
    declared = {}
    for ecosystem, library, _, algorithms, *_ in fv.LIBRARIES:
        declared[f"sca-{ecosystem}-{library}"] = [
            a.upper() for a in algorithms if a.upper() not in fv.UNSPECIFIC_LIBRARY_ALGORITHMS
        ]
    catalogue = sorted({a for names in declared.values() for a in names})
    by_rule = F.create_map(*[
        x for rule, names in declared.items()
        for x in (F.lit(rule), F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    ])
    manifest = F.col("language") == "manifest"
    label = F.upper(F.trim("algorithm"))
    own = F.filter(F.array(label), lambda a: ~a.isin(fv.UNSPECIFIC_LIBRARY_ALGORITHMS))
    wanted = F.coalesce(F.try_element_at(by_rule, F.col("rule_id")), own)

    # decided once per distinct (scan, side, rule, algorithm); these are counted once, and a scan's lie together from there on
    key = ["scan_id", "rule_id", "algorithm", "_manifest"]
    marked = findings.withColumn("_manifest", manifest)
    counted = stored(marked.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")))
    asked = counted.select(*key, label.alias("label")).repartition("scan_id")
    source = asked.where(~F.col("_manifest") & (F.length("algorithm") > 0)).select("scan_id", "label").distinct()
    # every label and its parts count as names the source uses
    parts = F.filter(
        _label_parts(F.col("label"), r"[/\-,\s]+"),
        lambda x: (F.length(x) >= 2) & ~x.isin(fv.LABEL_NOISE_WORDS),
    )
    names = source.select(
        "scan_id", F.explode(F.array_distinct(F.concat(F.array("label"), parts))).alias("name")
    ).distinct()
    words = names.select(
        "scan_id", "name",
        F.explode(F.array_distinct(F.concat(F.array("name"), _label_parts(F.col("name"), r"\s+"))))
        .alias("algorithm_name"),
    )
    wants = asked.where("_manifest").select(
        "scan_id", "rule_id", "algorithm", F.explode(F.array_distinct(wanted)).alias("algorithm_name"))
    met = _among(wants, words.select("scan_id", "algorithm_name").distinct(), ["scan_id"], "algorithm_name")
    met_rules = met.select("scan_id", "rule_id", "algorithm").distinct()
    met_names = met.select("scan_id", "algorithm_name").distinct()

    # names that contain a met algorithm are corroborated with it
    holds = F.filter(
        F.array(*[F.lit(a) for a in catalogue]), lambda a: F.contains(F.col("name"), a)
    )
    spread = _among(names.select(
        "scan_id", "name",
        F.explode(F.array_distinct(F.concat(F.array("name"), holds))).alias("algorithm_name"),
    ), met_names, ["scan_id"], "algorithm_name")
    corroborated = spread.select("scan_id", "name").union(met_names).distinct()
    labels = _among(source.select(
        "scan_id", "label",
        F.explode(F.array_distinct(F.concat(
            F.array("label"), _label_parts(F.col("label"), r"[/\-\s]+")))).alias("name"),
    ), corroborated, ["scan_id"], "name").select("scan_id", "label").distinct()

    confirmed = _among(asked.where("_manifest"), met_rules, ["scan_id", "rule_id"], "algorithm").unionByName(
        _among(asked.where("NOT _manifest"), labels, ["scan_id"], "label"))
    heavy = heavy_counts(counted, key, "_rows")
    out = split_join(marked, confirmed.select(*key, F.lit(True).alias("_confirmed")), key, "left", heavy=heavy)
    return out.withColumn(
        "confidence", F.when(F.col("_confirmed"), "Confirmed").otherwise(F.col("confidence"))
    ).select(*findings.columns)


# --- allow-list (J05) ---------------------------------------------------------
_SEP = "\u0001"


def _rule_names() -> Column:
    """What a rule may call this finding's rule."""
    return F.array_distinct(F.array(F.lower("rule_id"), F.lower("algorithm"), F.lit("*")))


def _place_keys() -> Column:
    """Exact keys of the path rules that could name this finding at one place, of the shapes that rules there have."""
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(
        F.when(F.col("_any_named"), F.array(F.lower("rule_id"), F.lower("algorithm"))).otherwise(none),
        F.when(F.col("_any_star"), F.array(F.lit("*"))).otherwise(none)))
    subs = F.array_distinct(F.concat(
        F.when(F.col("_any_whole"), F.array(F.lit(""))).otherwise(none),
        F.when(F.col("_any_line"), F.array(F.col("line").cast("string"))).otherwise(none),
        F.when(F.col("_any_other"), F.array(F.col("fingerprint"), F.lower("algorithm"))).otherwise(none)))
    return F.flatten(F.transform(names, lambda r: F.transform(
        subs, lambda s: F.concat_ws(_SEP, F.lit("P"), r, F.col("_place"), s))))


def _ruled_places(keyed: DataFrame, scope: list[str]) -> DataFrame:
    """The places that some path rule names, and what shapes its rules have there."""
    k = F.split("_key", _SEP)
    rule, sub = F.get(k, F.lit(1)), F.coalesce(F.get(k, F.lit(3)), F.lit(""))
    return keyed.where(F.get(k, F.lit(0)) == "P").groupBy(*scope, F.get(k, F.lit(2)).alias("_place")).agg(
        F.bool_or(rule != "*").alias("_any_named"), F.bool_or(rule == "*").alias("_any_star"), F.bool_or(sub == "").alias("_any_whole"),
        F.bool_or(sub.rlike(r"^\d+$")).alias("_any_line"), F.bool_or(sub != "").alias("_any_other"))


def _at_places(findings: DataFrame, places: DataFrame, scope: list[str], strict: bool) -> DataFrame:
    """Findings at places that rules name, a row for each place.

    By base name a finding has one place. A strict rule names the last components of a path: then a finding meets, under its base
    name, the numbers of components that rules with that base name have, and only those of its endings are looked up. So what
    shuffles is about the findings, however deep their paths are.
    """
    rel = F.lower(p.normalize_path(F.col("path")))
    rows = findings.select(*KEY, "algorithm", "fingerprint", p.basename(rel).alias("_base"), F.split(rel, "/").alias("_steps"))
    if not strict:
        rows = rows.withColumn("_place", F.col("_base"))
    else:
        lengths = places.groupBy(*scope, p.basename(F.col("_place")).alias("_base")).agg(
            F.collect_set(F.size(F.split("_place", "/"))).alias("_lengths"))
        fitting = F.filter("_lengths", lambda n: n <= F.size("_steps"))
        rows = split_join(rows, lengths, [*scope, "_base"]).withColumn("_place", F.explode(F.transform(
            fitting, lambda n: F.array_join(F.slice("_steps", F.size("_steps") - n + 1, n), "/")))).drop("_lengths")
    return sized_join(rows.drop("_base", "_steps"), places, [*scope, "_place"])


def _rule_key(strict: bool) -> Column:
    sep = _SEP
    rel = F.lower(p.normalize_path(F.col("path")))
    place = rel if strict else p.basename(rel)
    sub = F.coalesce(F.col("line").cast("string"), F.col("sub"), F.lit(""))
    return (
        F.when(F.col("kind") == "fingerprint", F.concat_ws(sep, F.lit("F"), F.col("rule_id")))
        .when(F.col("kind") == "rule", F.concat_ws(sep, F.lit("R"), F.lower("rule_id")))
        .when(place != "", F.concat_ws(sep, F.lit("P"), F.lower("rule_id"), place, sub))
    )


def apply_suppressions(
    findings: DataFrame, rules: DataFrame, strict_paths: bool = False
) -> DataFrame:
    """Flag findings that the allow-list names; nothing is removed.

    Both sides meet on exact keys. A rule path matches any file with the same base name
    (``strict_paths`` asks for the whole trailing path). Rules may carry a scan_id; then they
    apply to that scan only. No size of the rule table is assumed: rules are written down first, a table that
    turns out small goes to the findings, and else keys that a large share of the findings has are dealt over tasks.
    """
    scoped = "scan_id" in rules.columns
    on = ["scan_id", "_key"] if scoped else ["_key"]
    keyed = stored(
        rules.withColumn("_key", _rule_key(strict_paths)).filter(F.col("_key").isNotNull())
        .groupBy(*on)
        .agg(F.min_by(
            F.struct(F.col("kind").alias("kind"), F.col("rule_id").alias("rule"),
                     F.col("path").alias("place"), F.col("line").alias("at"),
                     F.col("sub").alias("sub")), "rule_seq").alias("_rule"),
             F.min("rule_seq").alias("_seq"))
    )
    printed = "fingerprint" in findings.columns
    own_print = fingerprint(F.col("rule_id"), F.col("algorithm"), F.col("snippet")) if not printed else F.col("fingerprint")
    with_print = findings if printed else findings.withColumn("fingerprint", own_print)
    # rules by name: every distinct (rule, algorithm) is looked up once, however many findings have it
    scope = ["scan_id"] if scoped else []
    pair = [*scope, "rule_id", "algorithm"]
    asked = with_print.select(*pair).distinct().withColumn(
        "_key", F.explode(F.transform(_rule_names(), lambda r: F.concat_ws(_SEP, F.lit("R"), r))))
    named = stored(
        sized_join(asked, keyed, on)
        .groupBy(*pair).agg(F.min_by("_rule", "_seq").alias("_named"), F.min("_seq").alias("_named_seq"))
    )
    # rules by path: only findings at a place that some rule names are spread over their keys
    places = _at_places(with_print, stored(_ruled_places(keyed, scope)), scope, strict_paths)
    by_place = places.select(*KEY, F.explode(_place_keys()).alias("_key"))
    by_print = with_print.select(*KEY, F.concat_ws(_SEP, F.lit("F"), F.col("fingerprint")).alias("_key"))
    hits = (
        sized_join(by_place.unionByName(by_print), keyed, on)
        .groupBy(*KEY).agg(F.min_by("_rule", "_seq").alias("_own"), F.min("_seq").alias("_own_seq"))
    )
    rel = p.normalize_path(F.col("path"))
    r = F.col("_rule")
    by_rule = F.concat(F.lit("Suppressed by rule '"), F.col("rule_id"), F.lit("'"))
    reason = (
        F.when(r["kind"] == "fingerprint",
               F.concat(F.lit("Suppressed by fingerprint '"), F.col("fingerprint"), F.lit("'")))
        .when(r["kind"] == "rule",
              F.concat(F.lit("Suppressed by rule ID '"), F.col("rule_id"), F.lit("'")))
        .when(r["at"].isNotNull(), F.concat(
            by_rule, F.lit(" on "), rel, F.lit(":"), F.col("line").cast("string")))
        .when(r["sub"].isNotNull(), F.concat(by_rule, F.lit(" ("), r["sub"], F.lit(") on "), rel))
        .when(r["rule"] == "*", F.concat(F.lit("Suppressed by path rule '"), r["place"], F.lit("'")))
        .otherwise(F.concat(by_rule, F.lit(" on "), rel))
    )
    keep = [c for c in findings.columns if c not in ("suppressed", "suppression_reason")]
    # few rules and algorithms, and one of them may be named by a large share of all findings
    of = F.to_json(F.struct(*pair), {"ignoreNullFields": "false"}).alias("_pair")
    flagged = sized_join(
        findings.select(*keep, of).join(hits, KEY, "left"), named.select(of, "_named", "_named_seq"), ["_pair"], "left")
    return (
        # a digest worked out here goes through no shuffle
        flagged.withColumn("fingerprint", own_print)
        .withColumn("_rule", F.when(
            F.col("_own").isNull() | (F.col("_named_seq") < F.col("_own_seq")), F.col("_named")).otherwise(F.col("_own")))
        .withColumn("suppressed", r.isNotNull())
        .withColumn("suppression_reason", F.when(r.isNotNull(), reason).otherwise(""))
        .drop("_rule", "_own", "_own_seq", "_named", "_named_seq", "_pair")
    )


# --- order, ids, summaries ----------------------------------------------------
def report_order() -> list[Column]:
    """path, line, worst severity first, rule."""
    return [F.col("path"), F.col("line"), sev_rank(F.col("severity")).desc(), F.col("rule_id")]


def with_finding_ids(findings: DataFrame) -> DataFrame:
    """f1, f2, … per scan in report order."""
    ranked = with_position(
        findings.withColumn("_down", -sev_rank(F.col("severity"))),
        ["path", "line", "_down", "rule_id"], ["scan_id"], "_n",
    )
    return ranked.withColumn("id", F.concat(F.lit("f"), F.col("_n").cast("string"))).drop("_n", "_down")


def active(findings: DataFrame) -> DataFrame:
    """Neither suppressed nor resolved."""
    keep = ~F.col("suppressed")
    if "status" in findings.columns:
        keep = keep & (F.col("status") != "RESOLVED")
    return findings.filter(keep)


def summarize(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals and counts by severity, quantum risk and language, in long form."""
    live = ~F.col("suppressed")
    named = lambda metric, item: F.struct(metric.alias("metric"), item.alias("item"))
    facts = F.array(
        named(F.lit("total_findings"), F.lit("")),
        named(F.when(live, "active_findings").otherwise("suppressed_findings"), F.lit("")),
        named(F.when(live, "by_severity"), F.col("severity")),
        named(F.when(live, "by_quantum_risk"), F.col("quantum_risk")),
        named(F.when(live, "by_language"), F.col("language")),
    )
    return (
        findings.select(*by, F.explode(facts).alias("m"))
        .filter(F.col("m.metric").isNotNull())
        .groupBy(*by, F.col("m.metric").alias("metric"), F.col("m.item").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def files_with_findings(findings: DataFrame) -> DataFrame:
    """Distinct files that hold an active finding."""
    return findings.filter(~F.col("suppressed")).select("scan_id", "path").distinct()


def ci_gate(findings: DataFrame) -> DataFrame:
    """True per scan when an active finding is Critical or High."""
    bad = ~F.col("suppressed") & F.col("severity").isin("Critical", "High")
    return findings.groupBy("scan_id").agg(F.max(bad).alias("fails"))
