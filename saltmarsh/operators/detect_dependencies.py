"""Dependency manifests against the library catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions import predicates as p
from saltmarsh.functions.severity import bump_severity
from saltmarsh.functions.text import LINE_BREAK, is_code, let
from saltmarsh.schemas import explode_findings, finding

LIBRARY_SCHEMA = (
    "ecosystem string, library string, purpose string, algorithms array<string>, "
    "severity string, quantum_risk string, note string, min_safe string, advice string"
)
DEPENDENCY = "array<struct<library:string,version:string,line:int,snippet:string>>"


def library_dim(spark: SparkSession) -> DataFrame:
    """The catalogue: 23 fixed rows, so a broadcast of it never grows with the data."""
    return spark.createDataFrame([tuple(r) for r in fv.LIBRARIES], LIBRARY_SCHEMA)


def ecosystem_of(path: Column) -> Column:
    name = F.lower(p.basename(path))
    return (
        F.when(name.contains("package") & name.endswith(".json"), "npm")
        .when(name.contains("requirements") & name.endswith(".txt"), "pip")
        .when(name.contains("pom") & name.endswith(".xml"), "maven")
    )


def _names(ecosystem: str) -> list[str]:
    return [row[1] for row in fv.LIBRARIES if row[0] == ecosystem]


def locate_line(lines: Column, target: Column) -> Column:
    """First line that mentions the name, else 1 (X14), inside the row of the file."""
    hit = F.array_position(
        F.transform(lines, lambda raw: F.contains(F.lower(raw), F.lower(target))), True
    )
    return F.greatest(hit, F.lit(1)).cast("int")


def _dependency(library: Column, version: Column, line: Column, snippet: Column) -> Column:
    return F.struct(
        library.alias("library"), version.alias("version"), line.alias("line"),
        p.strip(snippet).alias("snippet"),
    )


def npm_dependencies(text: Column) -> Column:
    """dependencies, then devDependencies; the latter's version wins for a shared name."""
    parsed = F.from_json(
        text, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    empty = F.array().cast("array<struct<key:string,value:string>>")
    entries = let(parsed, lambda x: F.concat(
        F.coalesce(F.map_entries(x["dependencies"]), empty),
        F.coalesce(F.map_entries(x["devDependencies"]), empty)))

    def build(all_entries: Column, lines: Column) -> Column:
        names = F.array_distinct(F.transform(all_entries, lambda e: e["key"]))
        known = F.filter(names, lambda n: F.lower(n).isin(_names("npm")))

        def one(name: Column) -> Column:
            last = F.element_at(F.filter(all_entries, lambda e: e["key"] == name), -1)
            return let(locate_line(lines, name), lambda line: _dependency(
                F.lower(name), last["value"], line, F.get(lines, line - 1)))

        return F.transform(known, one)

    return let(F.split(text, LINE_BREAK), lambda lines: let(
        entries, lambda all_entries: build(all_entries, lines)))


def pip_dependencies(text: Column) -> Column:
    pattern = r"^([A-Za-z0-9_\-.]+?)\s*([=><!~].*)?$"

    def build(raw: Column, i: Column) -> Column:
        line = p.strip(F.substring_index(p.strip(raw), " #", 1))
        name = F.regexp_replace(F.lower(F.regexp_extract(line, pattern, 1)), "[-_]", "")
        ok = is_code(raw, "pip") & line.rlike(pattern) & name.isin(_names("pip"))
        return F.when(
            ok, _dependency(name, p.strip(F.regexp_extract(line, pattern, 2)), i + 1, raw)
        )

    return F.array_compact(F.transform(F.split(text, LINE_BREAK), build))


#: What is read of a dependency element: its own children, not those of its exclusions.
DIRECT_CHILDREN = "groupId array<string>, artifactId array<string>, version array<string>"


def maven_dependencies(text: Column) -> Column:
    """Every dependency element of a well-formed document; its fields are its direct children, in any order.

    Comments hold no elements, CDATA sections are text, and a document that is not well-formed gives nothing.
    """
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?s)<!\[CDATA\[\s*([^<&]*?)\s*\]\]>", "$1")
    bare = F.regexp_replace(bare, r"(?s)<!\[CDATA\[.*?\]\]>", "")
    whole = F.from_xml(p.strip(text), "broken string", {"columnNameOfCorruptRecord": "broken"})["broken"].isNull()
    blocks = F.when(whole, F.regexp_extract_all(
        bare, F.lit(r"(?s)<dependency(?:\s[^>]*)?>(.*?)</dependency\s*>"), F.lit(1))).otherwise(F.array().cast("array<string>"))

    def field(children: Column, tag: str) -> Column:
        # the first element of that name right below the dependency; one that holds elements has no text
        first = F.coalesce(F.get(children[tag], F.lit(0)), F.lit(""))
        return F.when(first.contains("<"), "").otherwise(p.strip(first))

    def build(children: Column, lines: Column) -> Column:
        group, artifact = F.lower(field(children, "groupId")), F.lower(field(children, "artifactId"))
        library = F.when(artifact.isin(_names("maven")), artifact).when(
            group.contains("bouncycastle") | artifact.contains("bouncycastle"), "bouncycastle")
        target = F.when(artifact == "", "dependency").otherwise(artifact)
        return F.when(library.isNotNull(), let(locate_line(lines, target), lambda line: _dependency(
            library, field(children, "version"), line, F.get(lines, line - 1))))

    blocks = F.transform(blocks, lambda block: F.from_xml(
        F.concat(F.lit("<dependency>"), block, F.lit("</dependency>")), DIRECT_CHILDREN))
    return let(F.split(text, LINE_BREAK), lambda lines: F.array_compact(
        F.transform(blocks, lambda block: build(block, lines))))


def extract_dependencies(files: DataFrame) -> DataFrame:
    """(…, ecosystem, library, version, line, snippet) for catalogued libraries."""
    text, eco = F.col("text"), F.col("ecosystem")
    found = (
        F.when(eco == "npm", npm_dependencies(text).cast(DEPENDENCY))
        .when(eco == "pip", pip_dependencies(text).cast(DEPENDENCY))
        .otherwise(maven_dependencies(text).cast(DEPENDENCY))
    )
    keep = [c for c in files.columns if c != "text"]
    manifests = files.withColumn("ecosystem", ecosystem_of(F.col("path"))).filter(eco.isNotNull())
    return manifests.select(*keep, "ecosystem", F.explode(found).alias("d")).select(
        *keep, "ecosystem", "d.*"
    )


def detect_dependencies(files: DataFrame) -> DataFrame:
    dim = F.broadcast(library_dim(files.sparkSession))
    deps = extract_dependencies(files).join(dim, ["ecosystem", "library"])
    old = (
        F.col("min_safe").isNotNull() & (F.length("version") > 0)
        & p.version_below(F.col("version"), F.col("min_safe"))
    )
    eco, lib = F.col("ecosystem"), F.col("library")
    found = finding(
        F.col("line"), "manifest", F.concat(F.lit("sca-"), eco, F.lit("-"), lib),
        F.concat(F.lit("SCA: "), lib, F.lit(" ("), eco, F.lit(")")), F.col("purpose"),
        F.get("algorithms", F.lit(0)),
        F.when(old, bump_severity(F.col("severity"))).otherwise(F.col("severity")),
        F.col("quantum_risk"),
        F.when(old, F.concat(
            F.lit("Declared version "), F.col("version"), F.lit(" is below minimum safe version "),
            F.col("min_safe"), F.lit(". "), F.col("advice"),
        )).otherwise(F.col("advice")),
        F.col("snippet"),
        F.concat(
            F.lit("Declared dependency '"), lib, F.lit("' ("), eco, F.lit(") identified."),
            F.coalesce(F.concat(F.lit(" "), F.col("note")), F.lit("")),
        ),
        specificity=2, tags=F.array(F.lit("sca"), eco, lib),
    )
    return explode_findings(deps, F.array(found), "manifest")
