"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is a sequence of words. A line goes if an earlier one equals it, or if the earliest line equal to it has an
earlier one within one word edit (a word replaced, put in or left out).

* Equal lines meet under a 128-bit hash; the earliest place of each distinct line is kept.
* Two lines within one edit share the first or the last half of the shorter one. Only distinct lines that share a
  half with another go on, which loses no pair.
* Each of those emits its deletion variants as hashed keys: (i, words before i, words after i) for every word i, and
  (i, words before i, words from i) for every gap. Two lines share a key exactly if they are within one edit, and so are
  all lines of a key. A key therefore keeps its earliest line alone: no pairs within a group are made.
* The remaining pairs (line, earliest of a shared key) are verified on their words.

The texts do not shuffle: what shuffles is hashes and places. The words of prefixes and suffixes are
hashed in blocks, so the work on a line of n words stays close to n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import Scratch, free_name

#: Lines of fewer words are left alone, unless a caller asks for their repeats (``min_exact_words``).
MIN_WORDS = 5
#: Words chained together in prefix hashes at least.
LEAST_BLOCK = 8
#: A side of a join is broadcast if its measured rows are estimated at no more bytes than this; else both sides shuffle.
BROADCAST_BYTES = 16 << 20

_WORD_GAPS = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; an alias used inside a lambda would be worked out per element."""
    return F.transform(F.array(value), body)[0]


def line_words(line: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.array_remove(F.split(F.lower(line), _WORD_GAPS), "")


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _halves(words: Column) -> Column:
    """Hashes of the first and last h words, for the h that a line within one edit may ask for."""
    def at(h: Column) -> Column:
        return F.array(F.xxhash64(F.lit(0), h, F.slice(words, F.lit(1), h)),
                       F.xxhash64(F.lit(1), h, F.slice(words, F.size(words) - h + 1, h)))

    n = F.size(words)
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array_distinct(F.concat(at(half), at(less)))


def _prefix_hashes(hashes: Column) -> Column:
    """Chained hash of the first i elements of an array of word hashes, for i from 0 to its size.

    Worked out in blocks of about the root of the size, first the hash at each block's start and then those inside, as
    appending to an array costs its length. Single elements are read only: a slice costs the whole array.
    """
    n = F.size(hashes)
    block = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(n)).cast("int"))

    def last(known: Column) -> Column:
        return known[F.size(known) - 1]

    def at_starts(size: Column, count: Column) -> Column:
        def chained(head: Column, start: Column) -> Column:
            return F.aggregate(F.sequence(start, start + size - 1), head, lambda value, j: F.xxhash64(value, hashes[j]))

        return F.aggregate(
            F.sequence(F.lit(0), count), F.array(F.lit(0).cast("bigint")),
            lambda known, k: F.when(k == 0, known).otherwise(F.concat(known, F.array(chained(last(known), (k - 1) * size)))))

    def inside(head: Column, start: Column, end: Column) -> Column:
        return F.aggregate(
            F.sequence(start, end), F.array(head),
            lambda known, j: F.when(j == end, known).otherwise(F.concat(known, F.array(F.xxhash64(last(known), hashes[j])))))

    def with_blocks(size: Column) -> Column:
        return F.flatten(F.transform(
            at_starts(size, F.floor(n / size).cast("int")),
            lambda head, k: inside(head, k * size, F.least((k + 1) * size - 1, n))))

    return _let(block, with_blocks)


def deletion_keys(words: Column) -> Column:
    """Keys of the line with each word left out, and of the line itself at each gap."""
    def keys(front: Column, back: Column) -> Column:
        n = F.size(front) - 1
        left_out = F.transform(F.sequence(F.lit(0), n - 1),
                               lambda i: F.xxhash64(i, n - 1 - i, front[i], back[n - 1 - i]))
        gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(i, n - i, front[i], back[n - i]))
        return F.concat(left_out, gaps)

    # reversed once too: as an expression it would be worked out for every element that is read
    return _let(F.transform(words, lambda word: F.xxhash64(word)), lambda w: _let(F.reverse(w), lambda r: _let(
        _prefix_hashes(w), lambda front: _let(_prefix_hashes(r), lambda back: keys(front, back)))))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word sequences differ by one replaced, added or missing word at most."""
    def agree(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        differs = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(differs == 0, n).otherwise(F.least(differs.cast("int") - 1, n))

    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (
        agree(a, b) + agree(F.reverse(a), F.reverse(b)) >= longer - 1)


def repeated_lines(
    docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
    min_exact_words: int | None = None,
) -> DataFrame:
    """Per document with a line that is looked at: the numbers of its lines that go.

    Lines of ``min_words`` words or more are compared for equality and for one edit, those of ``min_exact_words`` (as ``min_words``
    if not given, 1 at least) up to that for equality alone.

    Columns doc_id, text_key (a hash of the text, which tells rows of one id apart), exact and near (sorted arrays of line numbers
    from 0). Places are ordered by (doc_id, text_key, line number), a null id first. Repeated rows share their places, so that
    neither removes the other.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"),
                       F.posexplode(_lines(F.col(text))).alias("line_no", "line"))
    least = min_words if min_exact_words is None else min(max(min_exact_words, 1), min_words)
    words = (rows.select("doc_id", "text_key", "line_no", F.explode(F.array(line_words(F.col("line")))).alias("words"))
             .where(F.size("words") >= least))
    # a line without halves meets no other
    halves_of = _halves(F.col("words"))
    if least < min_words:
        halves_of = F.when(F.size("words") >= min_words, halves_of).otherwise(F.array().cast("array<bigint>"))
    lines = scratch.write(
        words.select("doc_id", "text_key", "line_no", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"),
                     halves_of.alias("halves")), "lines")
    place = F.struct("doc_id", "text_key", "line_no")
    distinct = scratch.write(
        lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.first("halves").alias("halves")), "distinct")

    halves = distinct.select("h1", "h2", "place", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    wanted = scratch.write(
        halves.join(shared, "half", "left_semi").select("h1", "h2", "place").distinct()
        .groupBy(F.col("place.doc_id").alias("in_doc"), F.col("place.text_key").alias("in_text"))
        .agg(F.collect_list("place.line_no").alias("numbers")), "wanted")
    few = wanted.agg(F.count("*"), F.sum(F.size("numbers"))).first()
    side = F.broadcast(wanted) if 48 * few[0] + 4 * (few[1] or 0) <= BROADCAST_BYTES else wanted
    taken = (docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
             .join(side, F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("text_key") == F.col("in_text")))
             .select("doc_id", "text_key", "numbers", F.explode(F.array(_lines(F.col("text")))).alias("all_lines"))
             .select("doc_id", "text_key", F.explode(F.transform("numbers", lambda i: F.struct(
                 i.alias("line_no"), F.col("all_lines")[i].alias("line")))).alias("l"))
             .select("doc_id", "text_key", "l.line_no", F.explode(F.array(line_words(F.col("l.line")))).alias("words"))
             .where(F.size("words") >= min_words))
    # numbered in the order of places: a number is all that the join below carries
    at = ["doc_id", "text_key", "line_no"]
    texts = scratch.write(
        taken.dropDuplicates(at).repartitionByRange(*at).sortWithinPartitions(*at)
        .withColumn("number", F.monotonically_increasing_id()), "texts")

    # written once, as both sides of the join below read them
    keys = scratch.write(texts.select("number", F.explode(deletion_keys(F.col("words"))).alias("key")), "keys")
    earliest = keys.groupBy("key").agg(F.min("number").alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = keys.join(earliest.select("key", "hub"), "key").where("number > hub").select("number", "hub").distinct()
    near = scratch.write(
        pairs.join(texts.withColumnRenamed("words", "mine"), "number")
        .join(texts.select(F.col("number").alias("hub"), F.col("words").alias("theirs")), "hub")
        .where(within_one_edit(F.col("mine"), F.col("theirs"))).select(*at).distinct(), "near")

    # of each distinct line only the earliest place can stay
    marks = (lines.select("doc_id", "text_key", "line_no", F.lit(0).alias("mark"))
             .unionAll(distinct.select("place.*", F.lit(1).alias("mark")))
             .unionAll(near.select(*at, F.lit(2).alias("mark"))))

    def numbers(mark: int) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("mark") == mark, F.col("line_no"))))

    return (marks.groupBy("doc_id", "text_key")
            .agg(numbers(0).alias("all"), numbers(1).alias("first"), numbers(2).alias("near"))
            .select("doc_id", "text_key", F.array_except("all", "first").alias("exact"), "near"))


def find_repeated_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
    min_exact_words: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, exact and near (the line numbers that go).

    A null text has no lines, an empty one has one line without words. Lines of fewer than ``min_words`` words are never
    removed, or with ``min_exact_words`` only as repeats. Ties: of equal places (repeated rows) all stay. An empty table gives
    an empty table.
    """
    found = repeated_lines(docs, Scratch(docs.sparkSession, "line-dedup"), doc_id=doc_id, text=text, min_words=min_words,
                           min_exact_words=min_exact_words)
    none = F.array().cast("array<int>")
    rows = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), F.when(F.col(text).isNull(), 0).otherwise(
        F.size(F.split(text, "\n"))).cast("long").alias("n_lines"))
    return (rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
            .select(F.col("id").alias("doc_id"), "n_lines", F.coalesce("exact", none).alias("exact"),
                    F.coalesce("near", none).alias("near")))


def drop_repeated_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars",
    min_words: int = MIN_WORDS, min_exact_words: int | None = None,
) -> DataFrame:
    """``docs`` without the lines that go, with the same columns; ``length`` (if there) is brought up to date.

    A document that loses a line and has no word left goes; all others stay. With ``min_exact_words=1`` no exact copy of an
    earlier document (another id, a text with words) stays, however short its lines are.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    found = repeated_lines(docs, scratch, doc_id=doc_id, text=text, min_words=min_words, min_exact_words=min_exact_words)
    key, own, gone = free_name(docs, "in_doc"), free_name(docs, "in_text"), free_name(docs, "gone")
    losing = scratch.write(found.select(F.col("doc_id").alias(key), F.col("text_key").alias(own), F.concat("exact", "near").alias(gone))
                           .where(F.size(gone) > 0), "losing")
    few = losing.agg(F.count("*"), F.sum(F.size(gone))).first()
    side = F.broadcast(losing) if 48 * few[0] + 4 * (few[1] or 0) <= BROADCAST_BYTES else losing
    kept = _let(_lines(F.col(text)), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: lines[i]), "\n"))
    loses = F.col(gone).isNotNull()
    out = docs.join(side, F.col(doc_id).eqNullSafe(F.col(key)) & (text_key(text) == F.col(own)), "left")
    out = out.withColumn(text, F.when(loses, kept).otherwise(F.col(text))).where(~loses | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(loses, F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
