"""What is shuffled and stored: steps that meet on one key are dealt once, and tables kept for later readers are packed."""

import re

from pyspark.sql import functions as F

from saltmarsh.operators import inventory as inv
from saltmarsh.operators.consolidate import apply_suppressions, correlate_dependencies
from saltmarsh.operators.detect_calls import call_sites
from saltmarsh.operators.integrity import batch_manifest, proof_holds
from saltmarsh.operators.resolve import look_up
from saltmarsh.plans.scan import scan_files
from saltmarsh.session import shared_folder, stored
from saltmarsh.sources.tables import parse_suppressions


def exchanges(df):
    """Arguments of the shuffles in the plan that ran; one that is used again counts once."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(?<!ReusedExchange)(?: |\n)Exchange (\w+\([^)]*\))", re.sub(r"ReusedExchange .*", "", final))


def test_rows_of_a_file_are_dealt_by_the_file_alone(files_df):
    text = "import hashlib as h\nD = E\nE = h.sha1\ndef f(k):\n    def g():\n        pass\n    return hmac.new(k, b'', D)\n"
    found = call_sites(files_df(*[(f"a{n}.py", text) for n in range(20)]), "python")
    dealt = exchanges(found)
    assert dealt and all(re.fullmatch(r"hashpartitioning\(file#\d+L?, \d+\)", x) for x in dealt), dealt
    assert {(r.path, r.callee, r.digest, r.function) for r in found.collect()} == {(f"a{n}.py", "hmac.new", "hashlib.sha1", "f") for n in range(20)}


def test_look_up_like_a_left_join(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (1, None)], "g int, n string")
    table = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (None, "a", "z"), (1, None, "w"), (3, "b", "v")], "g int, m string, v string")
    got = look_up(rows, F.col("n"), table, ["g"], "m", "v", "into")
    assert got.columns == ["g", "n", "into"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "a", "x"), (1, "a", "x"), (1, "b", None), (2, "a", "y"), (None, "a", None), (1, None, None)], key=repr)
    assert look_up(rows.limit(0), F.col("n"), table, ["g"], "m", "v", "into").count() == 0
    assert look_up(rows, F.col("n"), table.limit(0), ["g"], "m", "v", "into").where("into IS NULL").count() == 6


def test_a_small_stored_allow_list_goes_to_the_findings(spark):
    """Findings are shuffled once, for the join with what was found for them, and not once for every kind of key."""
    found = spark.createDataFrame(
        [("s", f"src/p{i % 7}.py", i, "md5-hashing", "MD5", f"call_{i}") for i in range(200)],
        "scan_id string, path string, line int, rule_id string, algorithm string, snippet string")
    lines = spark.createDataFrame([(1, "md5-hashing|src/p1.py"), (2, "md5-hashing|p2.py|9"), (3, "*|nowhere/p3")], "seq long, line string")
    out = apply_suppressions(stored(found), parse_suppressions(lines))
    assert sorted(r.line for r in out.where("suppressed").collect()) == sorted({9, *range(1, 200, 7)})
    assert not [x for x in exchanges(out) if "_key" in x or "_place" in x or "_piece" in x]


def test_labels_of_a_scan_are_dealt_by_the_scan_alone(spark):
    rows = [("s1", "a.py", 1, "md5-hashing", "python", "MD5"), ("s1", "pom", 1, "sca-npm-md5", "manifest", "MD5"), ("s1", "b.py", 2, "x", "python", "RSA-2048"),
            ("s2", "pom", 1, "sca-npm-node-rsa", "manifest", "RSA"), ("s2", "c.py", 1, "y", "python", "RSA-2048"), ("s3", "pom", 1, "sca-npm-md5", "manifest", "MD5"),
            (None, "d.py", 1, "md5-hashing", "python", "MD5"), (None, "pom", 1, "sca-npm-md5", "manifest", "MD5")]
    found = spark.createDataFrame([(*r, "Likely") for r in rows], "scan_id string, path string, line int, rule_id string, language string, algorithm string, confidence string")
    out = correlate_dependencies(found)
    assert {(r.scan_id, r.path) for r in out.where("confidence = 'Confirmed'").collect()} == {("s1", "a.py"), ("s1", "pom"), ("s2", "pom"), ("s2", "c.py")}
    assert out.count() == len(rows)
    dealt = exchanges(out)
    assert not [x for x in dealt if "name#" in x or "label#" in x], dealt


def test_a_manifest_shuffles_no_proofs(spark):
    scans = spark.createDataFrame([(i % 3, f"s{i:02}", f"{i:064x}", "o", "") for i in range(40)], "batch int, scan_id string, merkle_root string, org_id string, scanner_version string")
    out = batch_manifest(scans, ["batch"])
    rows = out.collect()
    assert len(rows) == 40 and {(r.batch, r.scan_id, r.merkle_root) for r in rows} == {(i % 3, f"s{i:02}", f"{i:064x}") for i in range(40)}
    leaf = F.sha2(F.concat(F.lit('{"merkleRoot":"'), "merkle_root", F.lit('","orgId":"o","scanId":"'), "scan_id", F.lit('","scannerVersion":"'), "scanner_version", F.lit('"}')), 256)
    checked = out.select(proof_holds(leaf, F.col("proof"), F.col("root")).alias("ok"), (F.col("batch_id") == F.concat(F.lit("batch:"), "root")).alias("named"))
    assert all(r.ok and r.named for r in checked.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not [x for x in exchanges(batch_manifest(scans, ["batch"])) if "pos#" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_places_are_shuffled_to_their_pairs_alone(spark):
    rows = spark.createDataFrame(
        [(f"s{i % 2}", "RSA", 2048, None, "HIGH", i, f"p{i // 4}") for i in range(8)] + [("s0", "MD5", None, None, "LOW", 9, "p0"), ("s1", "RSA", 1024, None, "LOW", 10, "q")],
        "scan_id string, primitive string, key_size int, mode string, severity string, emit_seq int, path string").withColumns({
            "suppressed": F.lit(False), "line": F.lit(1), "finding_id": F.col("emit_seq").cast("string"), "usage": F.lit("hash"),
            "quantum_status": F.lit("x"), "recommendation": F.lit("y")})
    scans = spark.createDataFrame([("s0", None), ("s1", "s0")], "scan_id string, previous_scan_id string")
    occ = inv.occurrences(rows)
    out = inv.diff_inventories(stored(inv.build_components(occ)), occ, scans)
    # the size of 1024 came last, so it stands for RSA in s1; its one place is new, and the one place of two occurrences each is gone
    got = {(r.scan_id, r["name"]): (r.status, r.added_occurrences, r.removed_occurrences) for r in out.collect()}
    assert got == {("s0", "RSA"): ("added", None, None), ("s0", "MD5"): ("added", None, None), ("s1", "MD5"): ("removed", None, None),
                   ("s1", "RSA"): ("changed", 1, 4)}
    dealt = exchanges(out)
    assert not [x for x in dealt if "place#" in x and "scan_id#" in x], dealt


def test_stored_tables_come_back_as_they_were(spark, tmp_path):
    rows = spark.range(5000).select("id", F.lit("the same text in every row").alias("text"), F.struct(F.col("id").alias("a b"), F.array("id").alias("c")).alias("s"))
    kept = stored(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert sorted(kept.collect()) == sorted(rows.collect())
    # files of columns: what is kept is packed, and a reader is told its size
    assert int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 5000 * len("the same text in every row")
    assert stored(rows.where("id < 0")).count() == 0
    assert stored(rows.withColumn("none", F.lit(None))).where("none IS NULL").count() == 5000


def test_versions_are_numbered_from_packed_columns(spark):
    from saltmarsh.operators.ranking import with_position

    out = with_position(spark.range(100).select((F.col("id") % 3).alias("g"), "id"), ["id"], ["g"], "n")
    assert {(r.g, r.id, r.n) for r in out.collect()} == {(i % 3, i, i // 3 + 1) for i in range(100)}
    assert "parquet" in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_scan_keeps_only_the_columns_that_are_read(files_df):
    import os

    files = files_df(("a.py", "import hashlib\nh = hashlib.md5(b)\n"), ("requirements.txt", "rsa==4.0\n"))
    folder = shared_folder(files.sparkSession).removeprefix("file:")
    before = set(os.listdir(folder))
    some = scan_files(files, columns=["path", "rule_id", "severity"])
    assert some.columns == ["path", "rule_id", "severity"]
    kept = [files.sparkSession.read.parquet(f"file:{folder}/{x}").columns for x in set(os.listdir(folder)) - before if x.startswith("stored-")]
    findings = [x for x in kept if "confidence" in x]
    assert findings and not {"snippet", "recommendation", "message", "tags", "rule_name"} & set(findings[0])
    whole = scan_files(files)
    assert sorted(some.collect()) == sorted(whole.select("path", "rule_id", "severity").collect())
    assert {"fingerprint", "library", "recommendation", "snippet"} <= set(whole.columns)
    printed = {r.path: r.fingerprint for r in scan_files(files, columns=["path", "fingerprint", "library"]).collect()}
    assert printed == {r.path: r.fingerprint for r in whole.collect()}
