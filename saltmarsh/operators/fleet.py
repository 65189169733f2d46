"""Fleet views over many repositories and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.sources.keyed import rewrite


def latest_scans(scans: DataFrame) -> DataFrame:
    """The newest scan of every repository; the larger scan id breaks ties."""
    rest = [c for c in scans.columns if c != "repo_id"]
    return scans.groupBy("repo_id").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "scan_id")).alias("s")
    ).select("repo_id", "s.*")


def scan_counts(findings: DataFrame) -> DataFrame:
    """Findings, severities and quantum exposure per scan."""
    sev = F.lower("severity")
    n = lambda v: F.count_if(sev == v)
    return findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("findings"), n("critical").alias("critical"),
        n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"),
        F.count_if(F.col("quantum_vulnerable")).alias("quantum"))


COUNTS = ["findings", "critical", "high", "medium", "low", "quantum"]


def with_counts(scans: DataFrame, counts: DataFrame) -> DataFrame:
    """Scans with their counts; a scan without findings has zeros."""
    return scans.join(counts, "scan_id", "left").fillna(0, COUNTS)


def fleet_totals(counted: DataFrame) -> DataFrame:
    """Totals over the latest scan of each repository, and the newest scan's score.

    ``counted`` is every scan with its counts.
    """
    newest = F.struct("created_at", "scan_id")
    per_repo = counted.groupBy("repo_id").agg(
        F.max_by(F.struct(*COUNTS, "created_at", "scan_id"), newest).alias("s"),
        F.count(F.lit(1)).alias("_scans")).select("s.*", "_scans")
    return per_repo.agg(
        F.sum("_scans").alias("scans"), *[F.sum(c).alias(c) for c in COUNTS],
        F.max_by(
            F.greatest(F.lit(0), 100 - F.col("critical") * 5 - F.col("findings")), newest
        ).alias("security_score"))


def readiness(totals: DataFrame) -> DataFrame:
    """Share of assets without quantum exposure, both from latest scans."""
    ready = F.greatest(F.lit(0), F.col("assets") - F.col("quantum"))
    return totals.withColumn(
        "readiness_pct",
        F.when(F.col("assets") > 0, ready / F.col("assets") * 100).otherwise(F.lit(100.0)))


def repo_health(counted: DataFrame) -> DataFrame:
    """Score and standing of a repository from its latest scan."""
    other = F.col("findings") - F.col("critical") - F.col("high") - F.col("medium")
    loss = (
        F.col("critical") * 20 + F.col("high") * 10 + F.col("medium") * 5 + other * 2
        + F.when(F.col("quantum") > 0, 15).otherwise(0)
    )
    risky = (F.col("high") > 0) | (F.col("medium") > 0) | (F.col("quantum") > 0)
    return counted.withColumn("score", F.greatest(F.lit(0), 100 - loss)).withColumn(
        "risk",
        F.when(F.col("critical") > 0, "CRITICAL").when(risky, "ATTENTION").otherwise("HEALTHY"))


def health_counts(health: DataFrame) -> DataFrame:
    """Repositories per standing."""
    n = lambda v: F.count_if(F.col("risk") == v)
    return health.agg(
        F.count(F.lit(1)).alias("total"), n("HEALTHY").alias("healthy"),
        n("ATTENTION").alias("attention"), n("CRITICAL").alias("critical"))


def risk_metrics(counted: DataFrame) -> DataFrame:
    """Scans at risk and scans with quantum exposure."""
    return counted.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("critical") > 0) | (F.col("high") > 0)).alias("at_risk"),
        F.count_if(F.col("quantum") > 0).alias("quantum"))


def highest_risk(counted: DataFrame) -> DataFrame:
    """Worst label of every scan."""
    return counted.withColumn(
        "highest",
        F.when(F.col("findings") == 0, "No Risk").when(F.col("critical") > 0, "Critical")
        .when(F.col("high") > 0, "High").when(F.col("medium") > 0, "Medium").otherwise("Low"))


def risk_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("highest").agg(F.count(F.lit(1)).alias("scans"))


def fleet_status(totals: DataFrame) -> DataFrame:
    """Banner of the fleet."""
    critical, quantum = F.col("critical"), F.col("quantum")
    return totals.withColumn(
        "status_title",
        F.when(critical > 0, "Critical Risk Detected").when(quantum > 0, "Quantum Risk Warning")
        .otherwise("System Secure"),
    ).withColumn(
        "status_text",
        F.when(critical > 0, F.concat(critical.cast("string"), F.lit(
            " critical cryptographic vulnerabilities require immediate remediation.")))
        .when(quantum > 0, "Post-quantum vulnerable algorithms detected. Plan migration.")
        .otherwise("No critical cryptographic vulnerabilities detected across active "
                   "repositories."))


def profile_stats(scans: DataFrame) -> DataFrame:
    """Distinct repositories, scans and the last scan date."""
    return scans.agg(
        F.countDistinct("repo_id").alias("repos"), F.count(F.lit(1)).alias("scans"),
        F.max("created_at").alias("last_scan"))


# --- top-k reports ------------------------------------------------------------
def top_algorithms(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k most used algorithms with their share of the largest."""
    top = findings.groupBy("algorithm").agg(F.count(F.lit(1)).alias("usages")).orderBy(
        F.desc("usages"), "algorithm").limit(k)
    peak = F.max("usages").over(Window.partitionBy(F.lit(0)))  # over the k rows alone
    return top.select("algorithm", "usages", (F.col("usages") / peak * 100).alias("pct_of_max"))


def _newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("scan_id")]


def recent_scans(counted: DataFrame, k: int = 5) -> DataFrame:
    """The k newest scans with a badge."""
    return counted.orderBy(*_newest_first()).limit(k).withColumn(
        "badge",
        F.when(F.col("critical") > 0, "Critical").when(F.col("findings") > 0, "Issues Found")
        .otherwise("Secure"))


def activity(counted: DataFrame, k: int = 5) -> DataFrame:
    """The k newest scan events."""
    return counted.select(
        F.lit("scan_complete").alias("type"), "repo_id", "scan_id", "created_at", "findings"
    ).orderBy(*_newest_first()).limit(k)


def trend(counted: DataFrame, k: int = 14) -> DataFrame:
    """Findings of the last k scans, oldest first."""
    return counted.orderBy(*_newest_first()).limit(k).select(
        "scan_id", "created_at", "findings").orderBy("created_at", "scan_id")


# --- access, search, updates --------------------------------------------------
def visible_repos(repos: DataFrame, user_id: str, role: str) -> DataFrame:
    """Repositories a user may see: elevated roles all of them, others their own."""
    return repos.filter(can_access(F.lit(role), F.lit(user_id), F.col("owner_id")))


def access_grants(repos: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, repo_id) grants of many users at once; ``*`` stands for every repository.

    An elevated user gets one row, not one per repository.
    """
    elevated = F.col("role").isin(fv.ELEVATED_ROLES)
    everything = users.filter(elevated).select("user_id", F.lit("*").alias("repo_id"))
    own = users.filter(~elevated).join(
        repos.select("repo_id", F.col("owner_id").alias("user_id")), "user_id")
    return everything.unionByName(own.select("user_id", "repo_id"))


def can_access(role: Column, user_id: Column, owner_id: Column) -> Column:
    return role.isin(fv.ELEVATED_ROLES) | (user_id == owner_id)


def search_repos(repos: DataFrame, query: str = "", risk: str = "ALL") -> DataFrame:
    """Name contains the query, and the standing is the asked one."""
    hit = F.lower("name").contains(query.lower())
    return repos.filter(hit if risk == "ALL" else hit & (F.coalesce("risk", F.lit("HEALTHY")) == risk))


def resolve(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """Findings with the named (scan_id, finding_id) pairs marked RESOLVED."""
    marked = ids.select("scan_id", "finding_id").distinct().withColumn("_done", F.lit(True))
    return findings.join(marked, ["scan_id", "finding_id"], "left").withColumn(
        "status", F.when(F.col("_done"), "RESOLVED").otherwise(F.col("status"))).drop("_done")


def resolve_stored(spark: SparkSession, path: str, schema, ids: DataFrame) -> None:
    """Mark findings of a stored table, partitioned by scan, RESOLVED (P45); scans without a change keep their files."""
    rewrite(spark, path, schema, ["scan_id"], ids, lambda found: resolve(found, ids))


def with_parents(findings: DataFrame, scans: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings with their scan and repository; orphans disappear."""
    return findings.join(scans, "scan_id").join(repos, "repo_id")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, at: str = "updated_at") -> DataFrame:
    """Last write per key wins."""
    rows = existing.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")
