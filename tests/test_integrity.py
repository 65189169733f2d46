"""Merkle trees against a plain reference implementation written for these tests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import integrity as it
from saltmarsh.operators.ranking import with_position


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive_root(hashes):
    while len(hashes) > 1:
        pairs = [(hashes[i], hashes[min(i + 1, len(hashes) - 1)]) for i in range(0, len(hashes), 2)]
        hashes = [sha(min(p) + max(p)) for p in pairs]
    return hashes[0]


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(f"g{n}", i, sha(f"{n}/{i}")) for n in (1, 2, 3, 4, 5, 8, 9, 33, 70) for i in range(n)]
    return spark.createDataFrame(rows, "g string, pos long, hash string"), rows


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_roots_of_all_sizes(leaves, bits):
    df, rows = leaves
    got = {r.g: (r.root, r.leaf_count) for r in it.merkle_root(df.repartition(7), ["g"], bits).collect()}
    for g in got:
        own = [h for group, _, h in rows if group == g]
        assert got[g] == (naive_root(own), len(own))


@pytest.mark.parametrize("bits", [2, 10])
def test_proofs_hold_and_tampering_fails(leaves, bits):
    df, rows = leaves
    proofs = it.merkle_proofs(df, ["g"], bits).cache()
    assert proofs.count() == len(rows)
    assert it.verify_proofs(proofs).filter("not valid").count() == 0
    wrong = proofs.withColumn("hash", F.sha2("hash", 256))
    assert it.verify_proofs(wrong).filter("valid").count() == 0
    swapped = proofs.withColumn("root", F.sha2("root", 256))
    assert it.verify_proofs(swapped).filter("valid").count() == 0
    cut = proofs.filter("size(proof) > 0").withColumn("proof", F.slice("proof", 1, F.size("proof") - 1))
    assert it.verify_proofs(cut).filter("valid and g <> 'g2' and g <> 'g3'").count() == 0


def test_nodes_are_the_same_for_every_block_size(leaves):
    df, _ = leaves
    small = {tuple(r) for r in it.merkle_nodes(df, ["g"], 2).collect()}
    assert small == {tuple(r) for r in it.merkle_nodes(df, ["g"], 10).collect()}


def test_empty_tree_is_an_error(leaves):
    with pytest.raises(ValueError):
        it.merkle_root(leaves[0].filter("false"), ["g"])


def test_batch_root_ignores_input_order_and_root_spelling(spark):
    scans = [(f"s{i}", sha(str(i)), "org", "1.0") for i in range(11)]
    schema = "scan_id string, merkle_root string, org_id string, scanner_version string"
    a = it.batch_root(spark.createDataFrame(scans, schema)).first().root
    shouted = [(s, "0x" + r.upper(), o, v) for s, r, o, v in reversed(scans)]
    assert a == it.batch_root(spark.createDataFrame(shouted, schema)).first().root
    leaf = lambda s: sha('{"merkleRoot":"%s","orgId":"org","scanId":"%s","scannerVersion":"1.0"}' % (s[1], s[0]))
    assert a == naive_root([leaf(s) for s in sorted(scans)])


def test_bad_root_is_refused(spark):
    good = [("s0", sha("0")), ("s2", sha("2"))]
    schema = "scan_id string, merkle_root string"
    df = spark.createDataFrame(good + [("s1", "abc"), ("s3", None)], schema)
    assert it.batch_root(df).first().root == it.batch_root(spark.createDataFrame(good, schema)).first().root
    assert {r.scan_id: r.reason for r in it.rejected_scans(df).collect()} == {
        "s1": "no valid root for scan s1", "s3": "no valid root for scan s3"}


def test_positions_survive_one_hot_group(spark):
    rows = [("hot", i) for i in range(5000)] + [(f"g{i}", 1) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(8)
    got = with_position(df, ["v"], ["g"], "n", start=0).filter("g = 'hot'").collect()
    assert sorted((r.v, r.n) for r in got) == [(i, i) for i in range(5000)]
    tasks = df.repartitionByRange(4, "g", "v").withColumn("t", F.spark_partition_id()).filter("g = 'hot'")
    assert tasks.select("t").distinct().count() > 1


def test_chain_finds_deleted_reordered_and_edited_entries(spark):
    from saltmarsh.functions.canonical import content_hash

    fields = ["action", "id", "previous_hash"]
    entries, previous = [], None
    for i in range(6):
        row = spark.createDataFrame([(i, f"a{i}", previous)], "id int, action string, previous_hash string")
        entry = row.select(content_hash(row, fields)).first()[0]
        entries.append((i, f"a{i}", previous, entry))
        previous = entry
    schema = "id int, action string, previous_hash string, entry_hash string"

    def state(rows):
        out = it.verify_chain(spark.createDataFrame(rows, schema), fields, ["id"]).orderBy("id").collect()
        return [(r.hash_ok, r.link_ok) for r in out]

    assert state(entries) == [(True, True)] * 6
    assert state(entries[:2] + entries[3:])[2] == (True, False)
    edited = [e if e[0] != 4 else (4, "other", e[2], e[3]) for e in entries]
    assert state(edited)[4] == (False, True)


def test_components_of_loose_content(spark):
    df = spark.createDataFrame(
        [("a", "[]"), ("b", '[{"x":1},2]'), ("c", '{"components":[{"y":1}]}'), ("d", "plain words"),
         ("e", '{"k":1}')], "id string, text string")
    got = {}
    for r in it.as_components(df).collect():
        got.setdefault(r.id, []).append(r.component)
    assert got == {"a": ['{"empty":true}'], "b": ['{"x":1}', "2"], "c": ['{"y":1}'],
                   "d": ['{"content":"plain words"}'], "e": ['{"k":1}']}


def test_blocks_meet_the_path_of_their_top_before_they_are_taken_apart(leaves):
    """What is joined is a row for each block; its leaves and their paths come after."""
    df, _ = leaves
    plan = it.merkle_proofs(df, ["g"], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate explode") < plan.index("Join")


def test_an_audit_takes_given_proofs_and_makes_those_that_are_missing(spark):
    entries = spark.createDataFrame([(b, f"s{n}", f"{n:064x}") for b in (0, 1) for n in range(5)], "batch int, scan_id string, merkle_root string")
    roots = it.batch_root(entries, ["batch"])
    anchors = roots.select("batch", F.col("root").alias("recorded_root"))
    proofs = it.batch_manifest(entries.withColumns({"org_id": F.lit("o"), "scanner_version": F.lit("v")}), ["batch"]).select("batch", "scan_id", "proof")
    given = entries.join(proofs.withColumn("proof", F.when(F.col("scan_id") == "s0", F.slice("proof", 1, 1)).when(
        F.col("batch") == 0, F.lit(None)).otherwise(F.col("proof"))), ["batch", "scan_id"])
    # the proofs of batch 1 are those of other leaves, as organisation and version count
    found = {r.batch: (r.scans, r.scans_passed, r.root_matches, r.overall_pass) for r in it.audit_batch(given, anchors).collect()}
    assert found == {0: (5, 4, True, False), 1: (5, 0, True, False)}
    assert [(r.scans_passed, r.overall_pass) for r in it.audit_batch(entries, anchors).collect()] == [(5, True)] * 2
