"""Files in, by layer and within limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions import predicates as p
from saltmarsh.functions.text import to_lines
from saltmarsh.operators.skew import merge_join
from saltmarsh.sources import tree
from saltmarsh.sources.tables import parse_suppressions


def read_corpus(
    spark: SparkSession, root: str, scan_id: str, repo_id: str, exts: list[str] | None = None,
    pruned: list[str] | None = None,
) -> DataFrame:
    """Every file under ``root`` as one row, hidden names included; malformed bytes become replacement marks.

    Folders named in ``pruned`` (by default those that are never scanned) are not entered. With ``exts``
    plain source files of other extensions are left out before any byte is read; configuration, manifests,
    Dockerfiles and environment files stay in regardless.
    """
    files = tree.tree_of(spark, root, fv.PRUNED_DIRS if pruned is None else pruned)
    if exts is not None:
        files = files.filter(wanted_by_extension(F.col("path"), exts))
    return tree.read_files(files).select(
        F.lit(scan_id).alias("scan_id"), F.lit(repo_id).alias("repo_id"), "path", "text")


def wanted_by_extension(path: Column, exts: list[str]) -> Column:
    """Whether a file is looked at when only source files with ``exts`` are asked for."""
    name = p.basename(path)
    low = F.lower(name)
    return (
        (name == "Dockerfile") | name.startswith("Dockerfile.") | name.startswith(".env")
        | low.contains("package") | low.contains("requirements") | low.contains("pom")
        | low.isin("nginx.conf", "httpd.conf", "apache2.conf")
        | p.extension(path).isin(".yml", ".yaml", ".json", ".ini", ".conf", ".env", ".tf", ".xml")
        | p.extension(path).isin(list(exts)))


def read_ignore_rules(
    spark: SparkSession, roots: DataFrame, name: str, pruned: list[str] | None = None,
) -> DataFrame:
    """Allow-list rules of every scan: the file ``name`` in the root, else the first one below it.

    ``roots`` has the columns scan_id and root. "First" is the file with the fewest folders above it, then by path.
    A scan without such a file has no rules.
    """
    listed = tree.list_files(roots.select("root").distinct(), [] if pruned is None else pruned).filter(
        p.basename(F.col("path")) == name)
    chosen = listed.groupBy("root").agg(
        F.min(F.struct(F.size(F.split("path", "/")).alias("depth"), "path", "raw")).alias("at")).select("root", "at.path", "at.raw")
    # the scans meet the files, not the lines: these may be very many, and Spark would take them for few and broadcast them
    texts = merge_join(tree.read_files(chosen), roots.select("scan_id", "root"), ["root"])
    return parse_suppressions(to_lines(texts).select("scan_id", F.col("line").alias("seq"), F.col("raw").alias("line")))


def prune_paths(files: DataFrame, dirs: list[str] | None = None) -> DataFrame:
    """Drop files under directories that are never scanned."""
    dirs = fv.PRUNED_DIRS if dirs is None else dirs
    folders = F.split("path", "/")
    return files.filter(
        ~F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))),
                  lambda d: d.isin(dirs))
    )


def layers_of(path: Column, profile: str = "pipeline") -> Column:
    """Detection layers that look at a file, in the order they emit."""
    name = p.basename(path)
    low = F.lower(name)
    ext = p.extension(path)
    web = low.isin("nginx.conf", "httpd.conf", "apache2.conf")
    infra = ext.isin(".tf", ".conf", ".yaml", ".yml") | web
    js = ext.isin(".js", ".mjs", ".cjs", ".jsx")
    if profile == "pipeline":
        manifest = low.isin("package.json", "requirements.txt", "pom.xml") | (
            low.startswith("requirements") & low.endswith(".txt"))
        config = (
            ext.isin(".yml", ".yaml", ".json", ".ini", ".conf", ".env")
            | name.startswith(".env") | (name == "Dockerfile") | name.startswith("Dockerfile."))
    elif profile == "cli":
        manifest = low.contains("package") | low.contains("requirements") | low.contains("pom")
        config = (
            ext.isin(".yml", ".yaml", ".json", ".ini", ".conf", ".env", ".tf", ".xml")
            | low.startswith(".env") | low.contains("dockerfile"))
    else:
        raise ValueError(f"unknown profile {profile!r}")
    config = config & (ext != ".py") & ~js
    return F.array_compact(F.array(
        F.when(manifest, "manifest"), F.when(infra, "infra"), F.when(ext == ".py", "python"),
        F.when(js, "javascript"), F.when(config, "config"),
        F.when((ext == ".py") | js | config, "entropy"),
    ))


KINDS_OF_LAYER = {
    "manifest": ["manifest", "structured", "plain"],
    "infra": ["structured", "terraform", "plain"],
    "python": ["python"], "javascript": ["javascript"],
    "config": ["structured", "terraform", "plain", "manifest"],
    "entropy": ["python", "javascript", "structured", "terraform", "plain", "manifest"],
}


def file_class(path: Column) -> Column:
    """Coarse kind of a file, the partition column of a stored corpus."""
    ext = p.extension(path)
    return (
        F.when(ext == ".py", "python")
        .when(ext.isin(".js", ".mjs", ".cjs", ".jsx"), "javascript")
        .when(ext == ".tf", "terraform")
        .when(ext.isin(".json", ".xml", ".txt"), "manifest")
        .when(ext.isin(".yml", ".yaml"), "structured")
        .otherwise("plain")
    )


def store_corpus(files: DataFrame, path: str) -> None:
    """Write a corpus once, one folder per kind, dropping files no layer looks at."""
    kept = prune_paths(files).filter(
        (F.size(layers_of(F.col("path"), "pipeline")) > 0)
        | (F.size(layers_of(F.col("path"), "cli")) > 0))
    kept.withColumn("kind", file_class(F.col("path"))).write.partitionBy("kind").mode(
        "append").parquet(path)


def route_layers(
    files: DataFrame, profile: str = "pipeline", exts: list[str] | None = None
) -> DataFrame:
    """One row per (file, layer); a file no layer wants disappears.

    ``exts`` limits which plain source files are considered; configuration files, manifests,
    Dockerfiles and environment files stay in regardless.
    """
    path = F.col("path")
    routed = files
    if exts is not None:
        routed = files.filter(wanted_by_extension(path, exts))
    return routed.withColumn("layer", F.explode(layers_of(path, profile)))


def reject_unsafe_paths(files: DataFrame) -> DataFrame:
    """Keep files whose path stays inside the repository root."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    # the walk leaves the root when the running depth drops below zero
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, part: F.struct(
            (acc["d"] + _step(part)).alias("d"),
            F.least(acc["low"], acc["d"] + _step(part)).alias("low"),
        ),
    )
    return files.filter(~path.startswith("/") & (depth["low"] >= 0) & ~path.rlike("^[A-Za-z]:"))


def _step(part: Column) -> Column:
    return F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)


def quota_report(
    files: DataFrame, max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Per repository: files, bytes, whether it is accepted, and why not (S05). A limit that is not given does not hold."""
    reason = F.concat_ws(", ", *[
        F.when(F.col(name) > limit, F.concat(F.col(name).cast("string"), F.lit(f" {name}, at most {limit}")))
        for name, limit in (("files", max_files), ("bytes", max_bytes)) if limit is not None], F.lit(None).cast("string"))
    return (
        files.groupBy("repo_id")
        .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
        .withColumn("reason", F.nullif(reason, F.lit("")))
        .withColumn("accepted", F.col("reason").isNull())
    )


def enforce_quota(
    files: DataFrame, max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Files of the repositories that stay within the given limits; ``quota_report`` names the others."""
    over = quota_report(files, max_files, max_bytes).filter(~F.col("accepted")).select("repo_id")
    return files.join(over, "repo_id", "left_anti")
