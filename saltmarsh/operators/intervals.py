"""Places in nested intervals: an equi-join on blocks instead of a range join.

An interval is cut into aligned blocks of 1, 8, 64, ... places, at most fourteen of a size, and a place names the one block of
each size it lies in. So interval and place meet on equal (size, block). Of the intervals that cover one block whole only the innermost can
be a place's answer, so each block holds one, and a place meets at most ``SIZES`` rows however deep the nesting is.
The keys are (group, size, block): one group with very many intervals, such as one huge file, is dealt over all tasks.

What holds for a place changes only where an interval starts or ends, so a place takes what the last bound before it says. At a start that is
the interval itself, at an end nothing if no interval is open there; only the other ends are looked up by their blocks. A group's places are
dealt by runs of ``1 << RUN_BITS`` places, and the start of a run counts as a bound.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.operators.resolve import look_up

#: Sizes of blocks; together they reach over 8**14 places.
SIZES = 14
#: Places of a run; a group is dealt by its runs.
RUN_BITS = 12

# blocks of a size that lie inside the interval, but not in a block of the next size that does
_PIECES = f"""flatten(transform(sequence(0, least({SIZES - 1}, CAST(log2(_to - _from) / 3 AS INT) + 1)), s -> transform(
  filter(
    concat(
      transform(sequence(0, 6), j -> shiftright(_from + shiftleft(1L, 3 * s) - 1, 3 * s) + j),
      transform(sequence(0, 6), j -> shiftright(_to, 3 * s) - 1 - j)),
    b -> b >= shiftright(_from + shiftleft(1L, 3 * s) - 1, 3 * s) AND b < shiftright(_to, 3 * s)
      AND NOT (shiftright(b, 3) >= shiftright(_from + shiftleft(1L, 3 * s + 3) - 1, 3 * s + 3)
               AND shiftright(b, 3) < shiftright(_to, 3 * s + 3))),
  b -> shiftleft(b, 4) + s)))"""


def innermost(
    places: DataFrame, intervals: DataFrame, group: list[str], *, at: str = "place", start: str = "start", end: str = "end",
    payload: str = "name", id: list[str], into: str = "within",
) -> DataFrame:
    """``places`` with ``into``: the ``payload`` of the innermost interval ``[start, end)`` of the place's group, null if there is none.

    Intervals of a group nest or lie apart; where some cross, the one that starts last counts. ``id`` are columns that tell the
    places apart. Places and bounds are whole numbers from 0 to 8**13; an interval that is empty or has a null bound or group contains
    nothing. Several intervals with equal bounds: the greatest payload. Empty tables on either side are fine.
    """
    ranked = F.struct(F.col("_from"), -F.col("_to"), F.col("_payload"))
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in group])
    own = (
        intervals.select(
            *group, F.col(start).cast("bigint").alias("_from"), F.col(end).cast("bigint").alias("_to"), F.col(payload).alias("_payload"))
        .where(known & (F.col("_from") >= 0) & (F.col("_to") > F.col("_from"))))
    blocks = (
        own.select(*group, F.explode(F.array_distinct(F.expr(_PIECES))).alias("_b"), ranked.alias("_inner"))
        .groupBy(*group, "_b").agg(F.max("_inner").alias("_inner")))
    run = F.shiftright("_at", RUN_BITS)
    placed = places.withColumns({"_at": F.col(at).cast("bigint"), "_asks": F.lit(True)})
    # a run's first place says what holds before the first bound in it; nothing does before the first run
    first_places = placed.where(known & (F.col("_at") >= 1 << RUN_BITS)).select(*group, F.shiftleft(run, RUN_BITS).alias("_at")).distinct()
    of_interval = F.array(
        F.struct(F.col("_from").alias("at"), F.lit(1).alias("step"), ranked.alias("own")),
        F.struct(F.col("_to").alias("at"), F.lit(-1).alias("step"), F.lit(None).alias("own")))
    turns = own.select(*group, F.explode(of_interval).alias("_t")).select(
        *group, F.col("_t.at").alias("_at"), F.col("_t.step").alias("_step"), F.col("_t.own").alias("_own"))
    turns = turns.unionByName(first_places.withColumn("_step", F.lit(0)), allowMissingColumns=True).groupBy(*group, "_at").agg(
        F.sum("_step").alias("_step"), F.max("_own").alias("_own"))
    so_far = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("_open", F.sum("_step").over(so_far))
    sizes = F.expr(f"transform(sequence(0, {SIZES - 1}), s -> shiftleft(shiftright(_at, 3 * s), 4) + s)")
    asked = F.when(F.col("_own").isNull() & (F.col("_open") > 0), sizes).otherwise(F.array(F.lit(None).cast("bigint")))
    met = look_up(turns.select(*group, "_at", "_own", F.explode(asked).alias("_b")), F.col("_b"), blocks, group, "_b", "_inner", "_inner")
    said = met.groupBy(*group, "_at").agg(F.max(F.coalesce("_own", "_inner")).alias("_inner")).select(
        *group, "_at", F.struct(F.col("_inner._payload").alias("payload")).alias("_said"), F.lit(False).alias("_asks"))
    above = Window.partitionBy(*group, run).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.unionByName(said, allowMissingColumns=True)
        .withColumn(into, F.when(known & F.col("_at").isNotNull(), F.last("_said", ignorenulls=True).over(above)["payload"]))
        .where("_asks").drop("_at", "_said", "_asks"))
