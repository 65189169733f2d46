"""License scans by an exact set-similarity join, with DataFrame functions only.

Every line of a text is a block of distinct words, every template a set of words. A block matches a template if it contains at
least a share ``THRESHOLD`` of the template's words. Words are ordered by how many blocks of the whole corpus have them, rarest
first. With ``need`` words to share, a match shows

* among the first ``len - need + 1`` words of the template and of the block (prefix filter),
* in a block of ``need`` words at least (length filter),
* at places after which enough words are left on either side (positional filter).

Candidates are verified by the size of the intersection.

Notices are wrapped in real files, so texts of several lines are also cut into windows without regard to lines: twice as many words
as the longest template has, a new one after each half. A run of words no longer than that template lies whole in one of them.
Windows match as blocks do.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import Scratch

# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words and notices of well-known licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided "
                     "that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Least share of a template's words that a block contains.
THRESHOLD = 0.9

#: What separates words, the end of a line left out.
_NO_WORD = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def need(size: int, threshold: float = THRESHOLD) -> int:
    """Words of a template of ``size`` words that a matching block contains."""
    return max(1, math.ceil(threshold * size - 1e-9))


def _base(text: Column, phrases: dict[str, str]) -> Column:
    """Places of the phrases: array of (place, label)."""
    words = F.split(F.translate(F.trim(F.regexp_replace(text, "[ \\n]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                "abcdefghijklmnopqrstuvwxyz"), " ")

    def places_of(w: Column, phrase: list[str], label: str) -> Column:
        # word by word: a slice would cost the whole array at every place
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: reduce(
            and_, [F.get(w, i + k) == word for k, word in enumerate(phrase)]))
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))

    def places(w: Column) -> Column:
        return F.concat(*[places_of(w, phrase.split(" "), label) for phrase, label in phrases.items()])

    found = F.transform(F.array(words), places)[0]
    any_phrase = "(?i)(?:^|[ \\n])(?:" + "|".join(p.replace(" ", "[ \\n]+") for p in phrases) + ")(?:[ \\n]|$)"
    return F.when(text.rlike(any_phrase), found).otherwise(F.array().cast("array<struct<place:bigint,label:string>>"))


def _windows(text: Column, vocabulary: Column, half: int) -> Column:
    """The words of ``vocabulary`` in each window of 2 * ``half`` words, for texts of several lines."""
    # cut by a pattern: a slice would cost the whole array for every window
    chunks = F.regexp_extract_all(F.regexp_replace(F.lower(text), "[ \\n]+", " "), F.lit(f"(?:[^ ]++ ?+){{1,{half}}}+"), F.lit(0))
    hits = F.transform(chunks, lambda chunk: F.array_intersect(F.split(chunk, " "), vocabulary))

    def joined(halves: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(halves) - 2, F.lit(0))),
                           lambda i: F.array_union(F.coalesce(F.get(halves, i), F.array().cast("array<string>")),
                                                   F.coalesce(F.get(halves, i + 1), F.array().cast("array<string>"))))

    return F.when(text.contains("\n"), F.transform(F.array(hits), joined)[0]).otherwise(
        F.array().cast("array<array<string>>"))


def scan_licenses(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, places (struct array: place, label), matches (struct array: label,
    template, block, containment) and passages (the same with a window's number in place of a block's), sorted.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; base phrases lower-case A-Z, blocks lower-case all letters. A null or empty text
    has no words, places, matches or passages; a text of one line has no passages. Rows of one id or none are told apart by a hash of their text; repeated rows
    have equal results. Ties keep all matches. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license-scan")
    sets = [sorted(set(t.split(" "))) for _, t in templates]
    least = min(need(len(s), threshold) for s in sets)
    vocabulary = F.array(*map(F.lit, sorted({w for s in sets for w in s})))
    half = max(len(t.split(" ")) for _, t in templates)

    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _NO_WORD, " ")
    blocks = F.transform(F.split("plain", "\n"), lambda line: F.array_intersect(F.split(F.lower(line), " "), vocabulary))
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
                        F.explode(F.array(plain)).alias("plain"))
            .select("doc_id", "text_key", F.size(F.array_remove(F.split("plain", "[ \\n]+"), "")).cast("long").alias("n_words"),
                    _base(F.col("plain"), phrases).alias("places"), blocks.alias("blocks"),
                    _windows(F.col("plain"), vocabulary, half).alias("windows")))
    scanned = scratch.write(rows, "scanned")

    # the global order: words by the number of blocks that have them; as many rows as the templates have words
    counts = scanned.select(F.explode("blocks").alias("b")).select(F.explode("b").alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}
    order = sorted({w for s in sets for w in s}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for t, words in enumerate(sets):
        ordered, k = sorted(words, key=rank.get), need(len(words), threshold)
        index += [(w, t, templates[t][0], i, len(words), k, ordered) for i, w in enumerate(ordered[: len(words) - k + 1])]
    prefixes = spark.createDataFrame(
        index, "word string, template int, label string, t_place int, t_size int, need int, t_words array<string>")

    rank_of = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])
    def numbered(parts: str, windowed: bool) -> Column:
        return F.filter(F.transform(parts, lambda hits, i: F.struct(
            F.lit(windowed).alias("windowed"), i.alias("block"), hits.alias("hits"))), lambda part: F.size(part["hits"]) >= least)

    parts = F.explode(F.concat(numbered("blocks", False), numbered("windows", True)))
    members = (scanned.select("doc_id", "text_key", parts.alias("part")).select("doc_id", "text_key", "part.*")
               .select("doc_id", "text_key", "windowed", "block", F.transform(F.array_sort(F.transform(
                   "hits", lambda w: F.struct(rank_of[w].alias("rank"), w.alias("word")))), lambda x: x["word"]).alias("hits")))
    left_b, left_t = F.size("hits") - F.col("b_place"), F.col("t_size") - F.col("t_place")
    candidates = (members.select("doc_id", "text_key", "windowed", "block", "hits", F.posexplode("hits").alias("b_place", "word"))
                  .join(F.broadcast(prefixes), "word")
                  .where((F.size("hits") >= F.col("need")) & (F.least(left_b, left_t) >= F.col("need")))
                  .select("doc_id", "text_key", "windowed", "block", "hits", "template", "label", "t_size", "need", "t_words").distinct())
    shared = F.size(F.array_intersect("hits", "t_words"))

    def found(windowed: bool, place: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("windowed") == windowed, F.struct(
            "label", "template", F.col("block").alias(place), (shared / F.col("t_size")).alias("containment")))))

    matches = (candidates.where(shared >= F.col("need"))
               .groupBy("doc_id", "text_key").agg(found(False, "block").alias("matches"), found(True, "window").alias("passages"))
               .select(F.col("doc_id").alias("in_doc"), F.col("text_key").alias("in_text"), "matches", "passages"))

    def none(place: str) -> Column:
        return F.array().cast(f"array<struct<label:string,template:int,{place}:int,containment:double>>")

    own = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("text_key") == F.col("in_text"))
    return (scanned.join(matches, own, "left")
            .select("doc_id", "n_words", "places", F.coalesce("matches", none("block")).alias("matches"),
                    F.coalesce("passages", none("window")).alias("passages")))
