import textwrap

from saltmarsh.llm import queries
from saltmarsh.llm.license_scan import PHRASES, TEMPLATES, need, scan_licenses

from .helpers import AWKWARD, contract_words, docs_with_clashes

TEXTS = AWKWARD + [
    "Released\nunder the MIT License.", "under the mit license under THE mit\tlicense", "Apache License, Version 2.0", "apache license version 2x",
    "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc", "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License,\nversion 3.", "gnu gnu gnu general public license version",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files",
    "Permission is hereby granted to any person", "under the mit licenseé", "éunder the mit license",
]


def brute_force(text):
    words = contract_words(text)
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.encode().split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    matches = set()
    for b, line in enumerate((text or "").split("\n")):
        block = set(contract_words(line))
        for t, (label, template) in enumerate(TEMPLATES):
            wanted = set(template.encode().split())
            if len(block & wanted) >= need(len(wanted)):
                matches.add((label, t, b, len(block & wanted) / len(wanted)))
    return len(words), sorted(places), sorted(matches)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        words, places, matches = brute_force(text)
        assert got[i].n_words == words, text
        assert sorted(map(tuple, got[i].places)) == places, text
        assert sorted(map(tuple, got[i].matches)) == matches, text
    assert any(m.label == "gpl-3" for r in got.values() for m in r.matches)


def test_lower_thresholds_lose_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for threshold in (0.3, 0.6):
        found = {(r.doc_id, m.template, m.block) for r in scan_licenses(docs, threshold=threshold).collect() for m in r.matches}
        wanted = {(i, t, b) for i, text in enumerate(TEXTS) for b, line in enumerate((text or "").split("\n"))
                  for t, (_, template) in enumerate(TEMPLATES)
                  if len(set(contract_words(line)) & set(template.encode().split())) >= need(len(set(template.split())), threshold)}
        assert found == wanted


def test_clashes_repeats_and_empty_tables(spark):
    docs = docs_with_clashes(spark, TEXTS).withColumnRenamed("made", "blocks").withColumnRenamed("n_tokens", "matches")
    assert scan_licenses(docs).count() == docs.count()
    assert scan_licenses(docs.limit(0)).count() == 0


def wrapped(text, width):
    return "\n".join(f" * {line}" for line in textwrap.wrap(text, width))


def window_matches(text):
    words, half = contract_words(text), max(len(t.split()) for _, t in TEMPLATES)
    if "\n" not in (text or ""):
        return []
    out = set()
    for k in range(max(1, -(-len(words) // half) - 1)):
        window = set(words[k * half : (k + 2) * half])
        for t, (label, template) in enumerate(TEMPLATES):
            wanted = set(template.encode().split())
            if len(window & wanted) >= need(len(wanted)):
                out.add((label, t, k, len(window & wanted) / len(wanted)))
    return sorted(out)


def test_wrapped_notices_are_found(spark, tmp_path):
    before = " ".join(f"word{i}" for i in range(50))
    texts = [wrapped(f"{before[:cut]} {template} {before}", width)
             for _, template in TEMPLATES for width in (20, 72) for cut in (0, 90, 170)]
    labels = [label for label, _ in TEMPLATES for _ in range(6)]
    # no window reaches from one end of these to the other
    apart = ["gnu general\n" + " ".join(f"x{i}" for i in range(90)) + "\npublic license version 2"]
    docs = spark.createDataFrame(list(enumerate(texts + apart + TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i, text in enumerate(texts + apart + TEXTS):
        assert sorted(map(tuple, got[i].passages)) == window_matches(text), text
        if i < len(texts):
            assert (labels[i], 1.0) in {(p.label, p.containment) for p in got[i].passages}, text
    assert not got[len(texts)].passages
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.QUERIES["op3_license_scan"](spark, str(tmp_path)).collect()}
    for i, label in enumerate(labels):
        assert label in rows[i].labels.split(",") and rows[i].score == 1.0


def test_rows_of_one_id_or_none_keep_their_own_labels(spark):
    rows = [(2, "plain words"), (2, "licensed under the apache license version 2 0"), (None, "released under the mit license"),
            (None, "nothing"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, sorted({m.label for m in r.matches}), [p.label for p in r.places]) for r in scan_licenses(docs).collect())
    assert got == [("2", 2, [], []), ("2", 8, ["apache-2"], ["apache-2"]), ("None", 0, [], []), ("None", 1, [], []), ("None", 5, ["mit"], ["mit"])]
