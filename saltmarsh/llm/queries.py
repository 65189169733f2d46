"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.bpe import bpe_round_trip
from saltmarsh.llm.common import table
from saltmarsh.llm.decontaminate import find_contamination
from saltmarsh.llm.hard_negatives import mine_hard_negatives
from saltmarsh.llm.language_id import identify_languages
from saltmarsh.llm.license_scan import PHRASES, TEMPLATES, need, scan_licenses
from saltmarsh.llm.line_dedup import find_repeated_lines
from saltmarsh.llm.quality_model import classify
from saltmarsh.llm.quality_rules import judge
from saltmarsh.llm.sentencepiece_bpe import sentencepiece_round_trip
from saltmarsh.llm.simhash import simhash_components
from saltmarsh.llm.token_alignment import weigh_links
from saltmarsh.llm.token_counts import count_tokens
from saltmarsh.llm.warc import captured_payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeated_lines(table(spark, sf_dir, "documents"), min_exact_words=1)
    return found.select(
        "doc_id", "n_lines", F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"),
        F.array_join(F.array_sort(F.concat("exact", "near")), ",").alias("removed_lines"))


SQL["op1_line_dedup"] = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS line_no,
             list_filter(regexp_split_to_array(lower(a[i]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM s)),
e AS (SELECT doc_id, line_no, doc_id * 1000000 + line_no AS place, w, array_to_string(w, ' ') AS t FROM l WHERE len(w) >= 1),
d AS (SELECT t, any_value(w) AS w, min(place) AS place FROM e GROUP BY t),
k AS (SELECT place, md5(i || ':' || array_to_string(list_concat(w[1:i], w[i + 2:]), ' ')) AS k
      FROM (SELECT place, w, unnest(range(0, len(w))) AS i FROM d WHERE len(w) >= 5)
      UNION ALL
      SELECT place, md5(i || ':' || t) FROM (SELECT place, t, unnest(range(0, len(w) + 1)) AS i FROM d WHERE len(w) >= 5)),
g AS (SELECT k, min(place) AS hub FROM k GROUP BY k),
near AS (SELECT DISTINCT place FROM k JOIN g USING (k) WHERE place > hub),
m AS (SELECT e.doc_id, e.line_no, e.place <> d.place AS exact, e.place = d.place AND near.place IS NOT NULL AS near
      FROM e JOIN d USING (t) LEFT JOIN near ON near.place = e.place),
r AS (SELECT doc_id, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
             string_agg(line_no, ',' ORDER BY line_no) FILTER (exact OR near) AS removed_lines
      FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(removed_lines, '') AS removed_lines
FROM documents LEFT JOIN r USING (doc_id)
"""


@query
def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured_payloads(table(spark, sf_dir, "pages"))


SQL["op2_warc_transactions"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "matches.label", "passages.label")))
    best = F.greatest(F.lit(0.0), F.array_max("matches.containment"), F.array_max("passages.containment"), F.when(F.size("places") > 0, F.lit(1.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.place").alias("first_word"), F.array_max("places.place").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), best.alias("score"))


_WORDS_SQL = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_PHRASES_SQL = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in PHRASES.items())
_TEMPLATES_SQL = ", ".join(
    f"({i}, '{label}', {sorted(set(words.split()))}, {need(len(set(words.split())))})"
    for i, (label, words) in enumerate(TEMPLATES))
SQL["op3_license_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, {_WORDS_SQL.format("text")} AS w FROM d),
p AS (SELECT * FROM (VALUES {_PHRASES_SQL}) AS p(phrase, label, n)),
t AS (SELECT * FROM (VALUES {_TEMPLATES_SQL}) AS t(template, label, words, need)),
b AS (SELECT doc_id, i - 1 AS place, label
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), p
      WHERE array_to_string(w[i : i + n - 1], ' ') = phrase),
bs AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
              string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
l AS (SELECT doc_id, list_distinct({_WORDS_SQL.format("line")}) AS w
      FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(w, words)) / len(words) AS score
      FROM l, t WHERE len(w) >= need AND len(list_intersect(w, words)) >= need),
ms AS (SELECT doc_id, max(score) AS score FROM m GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM b) GROUP BY doc_id)
SELECT doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(ms.score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN ms USING (doc_id) LEFT JOIN a USING (doc_id)
"""


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), window=13, name="found")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"), "found.contaminated")


_ITEM_WORDS = _WORDS_SQL.format("coalesce(text, '')")
SQL["op6_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
      FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
f AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM f JOIN p USING (n, phrase)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at_word FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048).drop("text")


@query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), digests_only=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


@query
def op11_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), digests_only=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weigh_links(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same,
             CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
      FROM v AS a, v WHERE a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, other_id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
