"""Joins and groupings on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one part in so many of all rows. So there are fewer heavy keys than this, whatever the
#: data, and the list of them may be broadcast. A heavy key is dealt into pieces of at most that share.
PARTS = 512


def _free(taken: list[str], wanted: str) -> str:
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def heavy_keys(rows: DataFrame, keys: list[str], pieces: str = "pieces", *, rows_of: Column | None = None, parts: int = PARTS) -> DataFrame:
    """The heavy keys of ``rows`` with the number of pieces that each is to be dealt into; fewer than ``parts`` rows.

    ``rows_of`` says how many rows one row of ``rows`` stands for, where the counts are there already. A null key joins nothing and is
    never heavy.
    """
    counted = rows.where(functools.reduce(operator.and_, [F.col(f"`{k}`").isNotNull() for k in keys]))
    counted = counted.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        (F.count(F.lit(1)) if rows_of is None else F.sum(rows_of)).alias("_rows"))
    total = counted.agg(F.sum("_rows").alias("_all"))
    share = F.col("_all") / parts
    # one row beside every count: the total, not a side that grows
    return counted.join(F.broadcast(total), F.col("_rows") * parts > F.col("_all")).select(
        *[F.col(f"`{k}`") for k in keys], F.ceil(F.col("_rows") / F.greatest(share, F.lit(1.0))).cast("int").alias(pieces))


def heavy_counts(counts: DataFrame, keys: list[str], rows: str, pieces: str = "pieces", *, parts: int = PARTS) -> DataFrame:
    """``heavy_keys`` of a table that has each key once, with its number of ``rows``: nothing but the total is gathered."""
    total = counts.where(functools.reduce(operator.and_, [F.col(f"`{k}`").isNotNull() for k in keys])).agg(F.sum(rows).alias("_all"))
    share = F.col("_all") / parts
    heavy = counts.where(functools.reduce(operator.and_, [F.col(f"`{k}`").isNotNull() for k in keys])).join(
        F.broadcast(total), F.col(rows) * parts > F.col("_all"))
    return heavy.select(*[F.col(f"`{k}`") for k in keys], F.ceil(F.col(rows) / F.greatest(share, F.lit(1.0))).cast("int").alias(pieces))


def sized_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``split_join`` with a ``few`` that was written by ``stored``, or is columns of such a table: so its size is known, and where Spark would
    broadcast a table of that size, it is, and no row of ``many`` moves. ``how`` as for ``split_join``."""
    conf = few.sparkSession._jsparkSession.sessionState().conf()
    size = int(str(few._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > conf.autoBroadcastJoinThreshold():
        return split_join(many, few, keys, how)
    rest = [c for c in few.columns if c not in keys] if how in ("inner", "left") else []
    return many.join(F.broadcast(few), keys, how).select(*[F.col(f"`{c}`") for c in [*many.columns, *rest]])


def merge_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` where either side may grow with the input: both shuffle, and neither is gathered on the driver.

    Spark estimates a side behind an ``explode`` or an array column far too small and would broadcast it through the driver. A partition
    that a key makes large is split by adaptive execution.
    """
    return left.join(right.hint("merge"), on, how)


def split_join(
    many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", *, heavy: DataFrame | None = None, parts: int = PARTS,
) -> DataFrame:
    """``many.join(few, keys, how)`` for ``how`` of inner, left, left_semi and left_anti, with no task that holds a heavy key alone.

    Rows of ``many`` that have a heavy key are dealt over its pieces by a hash of all their columns, and the rows of ``few`` with that key stand in
    every piece. All other keys join as they always do. Columns of ``few`` besides the keys must have names of their own. ``heavy`` is
    what ``heavy_keys`` gave for ``many``; without it the keys of ``many`` are counted first.

    Null keys join nothing, as in any equi-join; a left or anti join keeps their rows. Empty sides and repeated rows give what
    ``join`` gives. The place of a row follows from its columns, so that a task that runs again deals it alike; rows that are equal in
    every column stay together.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: only inner, left, left_semi and left_anti joins are dealt")
    taken = [*many.columns, *few.columns]
    piece, pieces = _free(taken, "_piece"), _free(taken, "_pieces")
    heavy = (heavy_keys(many, keys, pieces, parts=parts) if heavy is None else heavy).select(
        *[F.col(f"`{k}`") for k in keys], F.col(heavy.columns[-1] if heavy is not None else pieces).alias(pieces))
    few_heavy = few.join(F.broadcast(heavy), keys, "left")
    # a row's place must not change if its task runs again, so it comes from what the row holds
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns if not _is_map(many, c)]), F.col(pieces))
    dealt = many.join(F.broadcast(heavy), keys, "left").withColumn(
        piece, F.when(F.col(pieces).isNotNull(), place.cast("int")).otherwise(F.lit(0))).drop(pieces)
    repeated = few_heavy.withColumn(
        piece, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(pieces), F.lit(1)) - 1))).drop(pieces)
    joined = dealt.join(repeated, [*keys, piece], how).drop(piece)
    rest = [c for c in few.columns if c not in keys] if how in ("inner", "left") else []
    return joined.select(*[F.col(f"`{c}`") for c in [*many.columns, *rest]])


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()
