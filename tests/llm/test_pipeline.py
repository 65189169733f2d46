import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from saltmarsh.llm import queries
from saltmarsh.llm.quality_model import score, train
from saltmarsh.llm.simhash import fingerprint

from .test_decontaminate import brute_force as contaminated_words
from .test_line_dedup import brute_force as repeated, words
from .test_simhash import roots

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    weights = train(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect() if score(weights, r.text.encode()) >= 0.5}
    exact, near = repeated(list(rows.items()), exact_least=1)
    after = {}
    for d, text in rows.items():
        lost = exact.get((d, text), set()) | near.get((d, text), set())
        left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost) if lost else text
        if not lost or words(left):
            after[d] = left
    root = roots({d: fingerprint(t.encode()) for d, t in after.items()})
    after = {d: t for d, t in after.items() if root[d] == d}
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    kept = {}
    for d, text in after.items():
        n, hit, _ = contaminated_words(text, items, 13)
        if not (hit and 20 * len(hit) >= n):
            kept[d] = text
    assert 0 < len(kept) < len(rows)

    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == kept and len(got) == len(kept)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_chars == len(r.text)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "near_dedup", "decontamination", "bpe_encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
