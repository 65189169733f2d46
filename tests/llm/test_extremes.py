"""Every query and stage over small tables that hold nulls everywhere, very long texts, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saltmarsh.llm import queries

from .helpers import AWKWARD

LONG_LINE = " ".join(f"w{i % 9973}" for i in range(40_000))
LONG_WORD = "abcdefghij" * 20_000
CLASHING = ("made", "label", "words", "key", "place", "line", "number", "text_key", "found", "ids", "fp", "score", "hub", "a", "b")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("extremes"))
    texts = [*AWKWARD, LONG_LINE, LONG_LINE.replace("w7 ", "seven ", 1), LONG_WORD, LONG_WORD + "\n" + LONG_LINE, "same text of a few words here"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[0], (None, "text without an id but with words", "de", "src", None), (None, None, None, None, None), (500, texts[-1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2 if i % 5 else None, 0) for i in range(len(texts))] + [(None, 1, 1), (2, 1, 0), (2, 0, 0)],
                          "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "the end the end"), (2, None), (None, "w1 w2 w3"), (1, "the end the end"), (3, "!!")],
                          "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, None if i % 4 == 0 else f"http://h/{i}", t) for i, t in enumerate(texts)] + [(None, None, None), (3, "x", texts[3])],
                          "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).write.parquet(f"{root}/pages.parquet")
    return root


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return root


#: op13 gives several rows or none for a row; test_hard_negatives holds it against odd and empty tables.
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op13_hard_negatives"}))
def test_queries_give_a_row_for_every_row(spark, folder, nothing, name):
    table = "pages" if name.startswith("op2") else "documents"
    run = queries.QUERIES[name]
    rows = run(spark, folder).collect()
    given = spark.read.parquet(f"{folder}/{table}.parquet").select(f"{table[:-1] if table == 'pages' else 'doc'}_id").collect()
    assert sorted(str(r[0]) for r in given) == sorted(str(r[0]) for r in rows)
    empty = run(spark, nothing)
    assert empty.count() == 0 and empty.columns == run(spark, folder).columns


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_anything(spark, folder, nothing, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    assert 0 < out.count() <= docs.count()
    if number < len(corpus_pipeline.STAGES) - 1:
        assert out.dtypes == docs.dtypes
        assert {r[c] for r in out.collect() for c in CLASHING} == {f"own {c}" for c in CLASHING}
    assert stage(spark, spark.read.parquet(f"{nothing}/documents.parquet"), nothing).count() == 0
    # a table of nulls
    nulls = docs.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert stage(spark, nulls, folder).count() in (0, 1, 2)
