"""Merkle commitments, proofs, anchors and audit chains."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions.canonical import (
    canonical_json, clean_root, content_hash, is_hex_digest,
)
from saltmarsh.operators.ranking import with_position
from saltmarsh.operators.skew import split_join
from saltmarsh.session import durable, stored
from saltmarsh.sources.keyed import read_stored

# Leaves folded in one task step: 2**10 digests are 64 KB, and a tree of 2**30 leaves needs
# three shuffles instead of thirty.
BLOCK_BITS = 10
STEP = "struct<sibling:string,position:string>"


def hash_pair(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.least(a, b), F.greatest(a, b)), 256)


def leaf_hashes(
    df: DataFrame, columns: list[str], order: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """(group, pos, hash) of every row; pos counts from 0 in ``order``."""
    hashed = df.select(*group, *[c for c in order if c not in group],
                       content_hash(df, columns).alias("hash"))
    return with_position(hashed, list(order), list(group), "pos", start=0).select(
        *group, "pos", "hash")


def _folded(level: Column) -> Column:
    """The level above: neighbours hashed in pairs, a last odd one with itself."""
    last = F.floor((F.size(level) - 1) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: hash_pair(
            F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.get(level, i * 2))),
    )


def _blocks(nodes: DataFrame, group: list[str], sizes: DataFrame, bits: int, carry: Sequence[str] = ()) -> DataFrame:
    """Aligned runs of 2**bits nodes with all levels inside each run.

    ``size`` is the number of nodes of the whole tree on this stage; a run stops folding when
    the tree is down to one node. ``carry`` are columns of the nodes that go along, as ``carried`` in the order of the nodes.
    """
    node = F.struct("pos", "hash", *([F.struct(*carry).alias("own")] if carry else []))
    runs = nodes.groupBy(*group, F.shiftright("pos", bits).alias("block")).agg(F.collect_list(node).alias("_run"))
    # positions differ; what goes along may be of a kind that has no order
    plain = not re.search("map<|variant|calendar", " ".join(kind for name, kind in nodes.dtypes if name in carry))
    runs = runs.withColumn("_run", F.sort_array("_run") if plain else F.array_sort(
        "_run", lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1)))
    runs = split_join(runs, sizes, group)
    start = F.struct(
        F.array(F.transform("_run", lambda x: x["hash"])).alias("levels"),
        F.col("size").cast("long").alias("left"))

    def up(acc: Column, _: Column) -> Column:
        grown = F.struct(
            F.concat(acc["levels"], F.array(_folded(F.element_at(acc["levels"], -1)))).alias("levels"),
            F.ceil(acc["left"] / 2).cast("long").alias("left"))
        return F.when(acc["left"] > 1, grown).otherwise(acc)

    levels = F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, up)["levels"]
    carried = [F.transform("_run", lambda x: x["own"]).alias("carried")] if carry else []
    return runs.select(*group, "block", "size", levels.alias("levels"), *carried)


ONE_TREE = "_tree"


def _trees(leaves: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group columns of the trees; without any, all leaves form one tree."""
    return (leaves, list(group)) if group else (leaves.withColumn(ONE_TREE, F.lit(0)), [ONE_TREE])


def _stages(leaves: DataFrame, group: list[str], bits: int, carry: Sequence[str] = ()) -> list[DataFrame]:
    """One table of blocks per ``bits`` levels, bottom first, which carries the columns ``carry`` of the leaves."""
    sizes = leaves.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.max("size")).first()[0]
    if largest is None:
        raise ValueError("a Merkle tree needs at least one row")
    stages, nodes = [], leaves.select(*group, "pos", "hash", *carry)
    while True:
        blocks = _blocks(nodes, group, sizes, bits, () if stages else carry)
        more = largest > 1 << bits
        if more:
            blocks = stored(blocks)
        stages.append(blocks)
        if not more:
            return stages
        nodes = blocks.select(
            *group, F.col("block").alias("pos"),
            F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"))
        sizes = sizes.withColumn("size", F.ceil(F.col("size") / (1 << bits)).cast("long"))
        largest = -(-largest // (1 << bits))


def merkle_root(
    leaves: DataFrame, group: Sequence[str] = (), bits: int = BLOCK_BITS
) -> DataFrame:
    """Root of every group's tree over its leaves in position order.

    Work is keyed by (group, block), so one group with most of the leaves still spreads.
    """
    leaves, group = _trees(leaves, group)
    top = _stages(leaves, group, bits)[-1]
    sizes = leaves.groupBy(*group).agg(F.count(F.lit(1)).alias("leaf_count"))
    root = top.select(*group, F.get(F.element_at("levels", -1), F.lit(0)).alias("root"))
    return root.join(sizes, group).drop(ONE_TREE)


def merkle_nodes(
    leaves: DataFrame, group: Sequence[str] = (), bits: int = BLOCK_BITS
) -> DataFrame:
    """(group, level, pos, hash) of every node of every tree."""
    leaves, group = _trees(leaves, group)
    out = None
    stages = _stages(leaves, group, bits)
    for number, blocks in enumerate(stages):
        rows = blocks.select(
            *group, "block", "size", F.posexplode("levels").alias("lv", "nodes")
        ).select(*group, "block", "size", "lv", F.posexplode("nodes").alias("i", "hash"))
        part = rows.select(
            *group, (F.col("lv") + number * bits).alias("level"),
            (F.col("block") * F.floor(F.lit(2.0 ** bits) / F.pow(F.lit(2.0), F.col("lv"))).cast("long")
             + F.col("i")).alias("pos"),
            "hash", "lv", "size")
        if number < len(stages) - 1:
            # the top of a stage is the first level of the next one, unless the tree ends here
            part = part.filter((F.col("lv") < bits) | (F.col("size") <= 1 << bits))
        if number > 0:
            # a tree that has ended only passes through
            part = part.filter(F.col("size") > 1)
        part = part.drop("lv", "size")
        out = part if out is None else out.unionByName(part)
    return out.drop(ONE_TREE)


def merkle_proofs(
    leaves: DataFrame, group: Sequence[str] = (), bits: int = BLOCK_BITS, carry: Sequence[str] = ()
) -> DataFrame:
    """(group, pos, hash, root, proof) for every leaf (I04, J15), and the columns ``carry`` of the leaf.

    A proof is the path inside the leaf's block followed by the path of that block's top. A block meets its top's path before it is
    taken apart, so what shuffles is about two digests for a leaf and not its path. What else is known of a leaf goes along with its
    digest in ``carry``, as a join with the proofs would shuffle these.
    """
    leaves, group = _trees(leaves, group)
    stages = _stages(leaves, group, bits, carry)
    above = None
    for blocks in reversed(stages):
        levels = F.col("levels")
        root = F.get(F.element_at(levels, -1), F.lit(0))

        def step(i: Column, lv: Column) -> Column:
            index = F.floor(i / F.pow(F.lit(2.0), lv)).cast("int")
            level = F.get(levels, lv)
            odd = index % 2 == 1
            other = F.when(odd, F.get(level, index - 1)).otherwise(
                F.coalesce(F.get(level, index + 1), F.get(level, index)))
            return F.struct(
                other.alias("sibling"), F.when(odd, "left").otherwise("right").alias("position"))

        depth = F.size(levels) - 1
        path = lambda i: F.when(
            depth > 0, F.transform(F.sequence(F.lit(0), depth - 1), lambda lv: step(i, lv))
        ).otherwise(F.array().cast(f"array<{STEP}>"))
        own = list(carry) if blocks is stages[0] else []
        beside = ["carried"] if own else []
        entries = F.transform(
            F.get(levels, F.lit(0)),
            lambda h, i: F.struct(i.alias("i"), h.alias("hash"), path(i).alias("proof"), *[F.get("carried", i).alias("own") for _ in beside]))
        if above is None:
            placed = blocks.select(*group, "block", "levels", *beside, root.alias("root"), F.array().cast(f"array<{STEP}>").alias("_tail"))
        else:
            tail = above.select(*group, F.col("pos").alias("block"), "root", F.col("proof").alias("_tail"))
            placed = blocks.select(*group, "block", "levels", *beside).join(tail, [*group, "block"])
        above = placed.select(*group, "block", "root", "_tail", F.explode(entries).alias("e")).select(
            *group, (F.shiftleft("block", bits) + F.col("e.i")).alias("pos"), F.col("e.hash").alias("hash"), "root",
            F.concat("e.proof", "_tail").alias("proof"), *[F.col("e.own")[c].alias(c) for c in own])
    return above.drop(ONE_TREE)


def proof_end(leaf: Column, proof: Column) -> Column:
    """The root that the proof leads to from leaf; null if either is malformed."""
    well_formed = (
        is_hex_digest(leaf) & proof.isNotNull()
        & F.forall(proof, lambda s: is_hex_digest(s["sibling"])
                   & F.coalesce(s["position"].isin("left", "right"), F.lit(False)))
    )
    return F.when(well_formed, F.aggregate(proof, leaf, lambda h, s: hash_pair(h, s["sibling"])))


def proof_holds(leaf: Column, proof: Column, root: Column) -> Column:
    """True when the proof leads from leaf to root; malformed input is false."""
    return F.coalesce(is_hex_digest(root) & (proof_end(leaf, proof) == root), F.lit(False))


def verify_proofs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("valid", proof_holds(F.col("hash"), F.col("proof"), F.col("root")))


# --- batches of scans ---------------------------------------------------------
def scan_leaf(root: Column, scan_id: Column, org: Column, version: Column) -> Column:
    """Digest of one scan's batch entry; org and version are left out when empty."""
    quoted = lambda v: F.to_json(F.struct(v.alias("v")))
    value = lambda v: F.regexp_replace(quoted(v), r'^\{"v":|\}$', "")
    pairs = F.concat_ws(
        ",",
        F.concat(F.lit('"merkleRoot":'), value(clean_root(root))),
        F.when(F.length(org) > 0, F.concat(F.lit('"orgId":'), value(org))),
        F.concat(F.lit('"scanId":'), value(scan_id)),
        F.when(F.length(version) > 0, F.concat(F.lit('"scannerVersion":'), value(version))),
    )
    return F.sha2(F.concat(F.lit("{"), pairs, F.lit("}")), 256)


def _batch_leaves(scans: DataFrame, batch: Sequence[str]) -> DataFrame:
    rows = scans.withColumn("merkle_root", clean_root(F.col("merkle_root"))).filter(is_hex_digest(F.col("merkle_root")))
    for name in ("org_id", "scanner_version"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    ranked = with_position(rows, ["scan_id", "merkle_root"], list(batch), "pos", start=0)  # T06
    return ranked.withColumn("hash", scan_leaf(
        F.col("merkle_root"), F.col("scan_id"), F.col("org_id"), F.col("scanner_version")))


def rejected_scans(scans: DataFrame) -> DataFrame:
    """Scans without a valid root, which no batch takes, each with the reason."""
    valid = F.coalesce(is_hex_digest(clean_root(F.col("merkle_root"))), F.lit(False))
    return scans.filter(~valid).withColumn("reason", F.concat(F.lit("no valid root for scan "), F.col("scan_id")))


def batch_root(scans: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Root over scans ordered by scan id, then root."""
    return merkle_root(_batch_leaves(scans, batch), batch)


def batch_manifest(scans: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Batch entries with defaults, proofs and the batch id."""
    filled = scans
    for name, default in (("org_id", fv.DEFAULT_ORG),
                          ("scanner_version", fv.DEFAULT_BATCH_SCANNER_VERSION)):
        given = F.col(name) if name in scans.columns else F.lit(None).cast("string")
        filled = filled.withColumn(name, F.coalesce(F.nullif(given, F.lit("")), F.lit(default)))
    leaves = _batch_leaves(filled, batch)
    own = [c for c in leaves.columns if c not in (*batch, "pos", "hash")]
    proofs = merkle_proofs(leaves, batch, carry=own)
    rest = [c for c in leaves.columns if c not in (*batch, "pos")]
    return proofs.select(*batch, "pos", *rest, "root", "proof").withColumn(
        "batch_id", F.concat(F.lit("batch:"), F.col("root")))


def audit_batch(
    entries: DataFrame, anchors: DataFrame, batch: Sequence[str] = ("batch",),
    expected: DataFrame | None = None,
) -> DataFrame:
    """Recomputed root against the recorded one, and every proof against it.

    ``entries``: batch, scan_id, merkle_root, org_id, scanner_version and optional proof.
    ``anchors``: batch and recorded_root. ``expected``: batch and expected_root.
    """
    batch = list(batch)
    leaves = stored(_batch_leaves(entries, batch))
    # where a proof leads is known before anything shuffles: its end goes on, not its path
    own = merkle_proofs(leaves, batch).select(
        *batch, "pos", F.col("root").alias("recomputed_root"), proof_end(F.col("hash"), F.col("proof")).alias("_end"))
    if "proof" in entries.columns:
        given = leaves.select(*batch, "pos", F.col("proof").isNotNull().alias("_given"), proof_end(F.col("hash"), F.col("proof")).alias("_given_end"))
        own = own.join(given, [*batch, "pos"]).withColumn("_end", F.when(F.col("_given"), F.col("_given_end")).otherwise(F.col("_end")))
    rows = split_join(own.select(*batch, "pos", "recomputed_root", "_end"), anchors, batch, "left")
    recorded = clean_root(F.col("recorded_root"))
    result = rows.withColumn("_valid", F.coalesce(is_hex_digest(recorded) & (F.col("_end") == recorded), F.lit(False))).groupBy(*batch).agg(
        F.first("recomputed_root").alias("recomputed_root"),
        F.first(recorded).alias("recorded_root"),
        F.count(F.lit(1)).alias("scans"),
        F.count_if("_valid").alias("scans_passed"))
    result = result.withColumn("exists", F.col("recorded_root").isNotNull()).withColumn(
        "root_matches",
        F.coalesce(F.col("recomputed_root") == F.col("recorded_root"), F.lit(False)))
    passed = F.col("exists") & F.col("root_matches") & (F.col("scans") == F.col("scans_passed"))
    if expected is not None:
        result = result.join(expected, batch, "left").withColumn(
            "expected_matches", clean_root(F.col("expected_root")) == F.col("recorded_root"))
        passed = passed & F.coalesce("expected_matches", F.lit(True))
    return result.withColumn("overall_pass", passed)


# --- inventories --------------------------------------------------------------
def integrity_manifest(
    documents: DataFrame, components: DataFrame, columns: list[str], order: Sequence[str]
) -> DataFrame:
    """Content hash, root, mode and component count of every inventory.

    ``documents`` has scan_id and content_hash. An inventory without components commits to
    its content hash.
    """
    roots = merkle_root(leaf_hashes(components, columns, order, ["scan_id"]), ["scan_id"])
    joined = documents.join(roots, "scan_id", "left")
    return joined.select(
        "scan_id", "content_hash", F.coalesce("root", "content_hash").alias("merkle_root"),
        F.when(F.col("root").isNotNull(), "component-merkle").otherwise("full-cbom-hash").alias("mode"),
        F.coalesce("leaf_count", F.lit(0)).alias("component_count"))


def component_proofs(components: DataFrame, columns: list[str], order: Sequence[str]) -> DataFrame:
    """The proof of every component of every inventory: scan_id, pos, hash, proof."""
    return merkle_proofs(leaf_hashes(components, columns, order, ["scan_id"]), ["scan_id"]).drop("root")


def verify_manifest(recomputed: DataFrame, stored: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """Recomputed manifests against stored ones, by content, by root and, if given, by stored proofs.

    The proofs of an inventory hold if there is one per component and each leads to the stored root.
    """
    held = stored.select(
        "scan_id", F.col("content_hash").alias("_hash"), F.col("merkle_root").alias("_root"))
    out = recomputed.join(held, "scan_id").withColumn(
        "content_valid", F.col("content_hash") == F.col("_hash")
    ).withColumn("root_valid", F.col("merkle_root") == F.col("_root"))
    valid = F.col("content_valid") & F.col("root_valid")
    if proofs is not None:
        checked = proofs.join(held.select("scan_id", "_root"), "scan_id").groupBy("scan_id").agg(
            F.countDistinct("pos").alias("_proofs"),
            F.bool_and(proof_holds(F.col("hash"), F.col("proof"), F.col("_root"))).alias("_hold"))
        out = out.join(checked, "scan_id", "left").withColumn(
            "proofs_valid", F.coalesce("_hold", F.lit(True)) & (F.coalesce("_proofs", F.lit(0)) == F.col("component_count")))
        out, valid = out.drop("_proofs", "_hold"), valid & F.col("proofs_valid")
    return out.withColumn("valid", valid).drop("_hash", "_root")


def content_matches(manifests: DataFrame, expected: DataFrame) -> DataFrame:
    """An expected hash may be the content hash or the component root."""
    want = clean_root(F.coalesce("expected_hash", F.lit("")))
    return manifests.join(expected, "scan_id").withColumn(
        "valid", (want == F.col("content_hash")) | (want == F.col("merkle_root")))


def as_components(documents: DataFrame, text: str = "text") -> DataFrame:
    """Component rows of loosely shaped content, as JSON text.

    A non-empty array, or a non-empty ``components`` array, gives its elements; an empty array
    one ``{"empty":true}``; other JSON stays whole; text that is no JSON becomes one row.
    """
    body = F.trim(F.col(text))
    parsed = F.try_parse_json(F.col(text))
    elements = F.from_json(body, "array<string>")
    inner = F.from_json(F.get_json_object(body, "$.components"), "array<string>")
    content = F.array(F.to_json(F.struct(F.col(text).alias("content"))))
    parts = (
        F.when(parsed.isNull(), content)
        .when(body.startswith("["), F.when(F.size(elements) > 0, elements).otherwise(
            F.array(F.lit('{"empty":true}'))))
        .when(body.startswith("{"), F.when(F.size(inner) > 0, inner).otherwise(F.array(body)))
        .otherwise(F.array(F.to_json(F.struct(F.regexp_replace(body, '^"|"$', "").alias("content")))))
    )
    keep = [c for c in documents.columns if c != text]
    return documents.select(*keep, F.posexplode(parts).alias("pos", "component"))


# --- anchors ------------------------------------------------------------------
def anchor_status(roots: DataFrame, anchors: DataFrame) -> DataFrame:
    """verified, mismatch or missing for every recomputed root."""
    held = anchors.select("scan_id", clean_root(F.col("merkle_root")).alias("_held"))
    joined = roots.join(held, "scan_id", "left")
    return joined.withColumn(
        "status",
        F.when(F.col("_held").isNull(), "missing")
        .when(F.col("_held") == clean_root(F.col("root")), "verified").otherwise("mismatch"),
    ).drop("_held")


def new_anchors(
    candidates: DataFrame, existing: DataFrame, writers: DataFrame | None = None
) -> DataFrame:
    """Anchors that may be written: allowed writer, new scan id, non-empty root.

    The first candidate by ``seq`` wins when a batch repeats a scan id.
    """
    ok = candidates.filter(
        (F.length(F.trim("scan_id")) > 0)
        & ~F.coalesce(clean_root(F.col("merkle_root")), F.lit("")).rlike("^0*$"))
    if writers is not None:
        ok = ok.join(writers.select(F.col("writer").alias("anchored_by")).distinct(),
                     "anchored_by", "left_semi")
    fresh = ok.join(existing.select("scan_id"), "scan_id", "left_anti")
    rest = [c for c in fresh.columns if c != "scan_id"]
    return fresh.groupBy("scan_id").agg(F.min_by(F.struct(*rest), "seq").alias("a")).select(
        "scan_id", "a.*")


# --- audit log ----------------------------------------------------------------
SENSITIVE = ["password", "token", "accessToken"]


def request_hash(df: DataFrame, body: list[str]) -> Column:
    """Digest of a request body without its sensitive fields."""
    return content_hash(df, [c for c in body if c not in SENSITIVE])


def auditable(requests: DataFrame) -> DataFrame:
    """Requests that belong in the log: no reads, health checks or server errors."""
    return requests.filter(
        (F.col("method") != "GET") & (F.col("path") != "/health") & (F.col("status_code") < 500))


def verify_chain(
    log: DataFrame, columns: list[str], order: Sequence[str] = ("created_at", "id"),
    chain: Sequence[str] = (),
) -> DataFrame:
    """Each entry: does it hash to its own value, and does it name the entry before it.

    The predecessor is found by position, so one long chain spreads over many tasks.
    """
    chain = list(chain)
    hashed = log.withColumn("_hash", content_hash(log, columns))
    placed = durable(with_position(hashed, list(order), chain, "pos", start=0))
    before = placed.select(
        *chain, (F.col("pos") + 1).alias("pos"), F.col("entry_hash").alias("_before"))
    joined = placed.join(before, [*chain, "pos"], "left")
    return joined.withColumn("hash_ok", F.col("_hash") == F.col("entry_hash")).withColumn(
        "link_ok", F.col("previous_hash").eqNullSafe(F.col("_before"))
    ).drop("_hash", "_before")


def chain_heads(log: DataFrame, order: Sequence[str] = ("created_at", "id"), chain: Sequence[str] = ()) -> DataFrame:
    """The last entry hash of each chain of a log."""
    return log.groupBy(*chain).agg(F.max_by("entry_hash", F.struct(*order)).alias("entry_hash"))


def append_entries(
    heads: DataFrame, entries: DataFrame, columns: list[str], order: Sequence[str] = ("created_at", "id"), chain: Sequence[str] = (),
) -> DataFrame:
    """``entries`` with ``previous_hash`` and ``entry_hash``, each chain going on from its head.

    ``columns`` are those that an entry's hash covers, ``previous_hash`` among them; ``heads`` is what ``chain_heads`` gives for the log so
    far (no rows for an empty one). Entries of a chain are taken in ``order``, which tells all of them apart. A chain is followed
    entry by entry, as every hash needs the one before; chains run beside one another, and a task holds one batch of rows and one hash,
    however long its chains are. With no ``chain`` all entries are one chain and one task's work.

    Null chain values form a chain of their own. No entries give no rows.
    """
    chain = list(chain)
    spark = entries.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    kept = [c for c in entries.columns if c not in ("previous_hash", "entry_hash")]
    before, after = ([c for c in columns if c < "previous_hash"], [c for c in columns if c > "previous_hash"])

    def inner(names: list[str]) -> Column:
        text = canonical_json(entries, names)
        return F.substring(text, 2, F.length(text) - 2) if names else F.lit("")

    # the canonical text of an entry around its previous hash
    head = F.concat(F.lit("{"), inner(before), F.lit("," if before else ""), F.lit('"previous_hash":'))
    tail = F.concat(F.lit("," if after else ""), inner(after), F.lit("}"))
    key = F.to_json(F.struct(*[F.col(c) for c in chain]), {"ignoreNullFields": "false"}) if chain else F.lit("")
    new = entries.select(key.alias("_chain"), F.lit(True).alias("_new"), F.lit(None).cast("string").alias("_hash"), head.alias("_head"), tail.alias("_tail"), *kept)
    asked = new.select("_chain").distinct()
    old = heads.select(key.alias("_chain"), F.lit(False).alias("_new"), F.col("entry_hash").alias("_hash")).join(asked, "_chain", "left_semi")
    rows = old.unionByName(new, allowMissingColumns=True)
    dealt = (rows.repartition("_chain") if chain else rows.coalesce(1)).sortWithinPartitions("_chain", "_new", *order)
    given = entries.select(*kept).schema

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last = None
        for batch in batches:
            hashes: list[tuple[str | None, str]] = []
            places = []
            for i, (name, is_new, known, left, right) in enumerate(zip(
                    *[batch.column(c).to_pylist() for c in ("_chain", "_new", "_hash", "_head", "_tail")], strict=True)):
                if name != at:
                    at, last = name, None
                if not is_new:
                    last = known
                    continue
                said = "null" if last is None else f'"{last}"'
                digest = hashlib.sha256(f"{left}{said}{right}".encode()).hexdigest()
                hashes.append((last, digest))
                places.append(i)
                last = digest
            own = batch.take(pa.array(places, pa.int64())).select(kept)
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array([h[0] for h in hashes], pa.string()), pa.array([h[1] for h in hashes], pa.string())],
                names=[*kept, "previous_hash", "entry_hash"])

    return dealt.mapInArrow(follow, given.add("previous_hash", "string").add("entry_hash", "string"))


def append_audit_log(
    spark: SparkSession, path: str, entries: DataFrame, columns: list[str], order: Sequence[str] = ("created_at", "id"),
    chain: Sequence[str] = (), id: str = "id",
) -> None:
    """Append ``entries`` to the log stored at ``path``. Entries whose ``id`` the log holds already are left out, so a repeated call adds nothing."""
    kept = [c for c in entries.columns if c not in ("previous_hash", "entry_hash")]
    schema = entries.select(*kept).schema.add("previous_hash", "string").add("entry_hash", "string")
    log = read_stored(spark, path, schema)
    fresh = entries.select(*kept).join(log.select(id), id, "left_anti").select(*kept)
    new = append_entries(chain_heads(log, order, chain), fresh, columns, order, chain)
    # written from a durable copy: a task that runs again must not meet a log that has grown
    durable(new).write.mode("append").parquet(path)
