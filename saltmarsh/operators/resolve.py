"""What names stand for: bindings and imports as rows, chains by doubling the steps of a table looked up in itself."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names followed from one binding to the next.
STEPS = 6


def look_up(rows: DataFrame, wanted: Column, table: DataFrame, group: list[str], name: str, value: str, into: str) -> DataFrame:
    """``rows`` with ``into``: the ``value`` that ``table`` has for the row's group and its ``wanted`` name, null if there is none.

    A left join as one sort: the table's rows lie on top of the rows that ask, and each of these takes what stands above it. Sides that
    lie together by the group already, as the rows of a file do, are not shuffled again, which a join on the group and a name would ask for.
    Neither side is gathered anywhere. ``table`` holds one row for each name of a group. A null group or name finds nothing.
    """
    asking = rows.withColumns({"_name": wanted, "_asks": F.lit(True)})
    held = table.select(*group, F.col(name).alias("_name"), F.col(value).alias("_held"), F.lit(False).alias("_asks"))
    above = Window.partitionBy(*group, "_name").orderBy("_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in [*group, "_name"]])
    return (
        asking.unionByName(held, allowMissingColumns=True)
        .withColumn(into, F.when(known, F.first("_held", ignorenulls=True).over(above)))
        .where("_asks").drop("_name", "_held", "_asks"))


def last_bindings(rows: DataFrame, group: list[str], order: Column, value: Column) -> DataFrame:
    """The last value of each name of a group: ``group, name, value``. Folds before it shuffles."""
    return rows.groupBy(*group, "name").agg(F.max_by(value, order).alias("value"))


def follow(bindings: DataFrame, group: list[str], steps: int = STEPS) -> DataFrame:
    """Where each name leads after at most ``steps`` steps: ``group, name, value``.

    ``bindings`` holds one ``value`` for each name of a group, a struct whose field ``name`` says which name it is, if it is one. A chain
    ends early at a value that is no name, or a name without a binding. Names that go round in a circle stop after ``steps`` too. The
    tables for 1, 2, 4, ... steps are looked up in one another, so ``steps`` costs sorts in proportion to its logarithm.
    A null group or name leads nowhere.
    """
    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        return look_up(first, F.col("value.name"), second, group, "name", "value", "_further").select(
            *group, "name", F.coalesce("_further", "value").alias("value"))

    power, walked = bindings.select(*group, "name", "value"), None
    while steps:
        if steps & 1:
            walked = power if walked is None else then(walked, power)
        steps >>= 1
        if steps:
            power = then(power, power)
    return walked


def through_imports(names: DataFrame, imports: DataFrame, group: list[str], column: str) -> DataFrame:
    """``names`` with the first part of the dotted name in ``column`` replaced by what the last import of that name gave.

    ``imports`` holds one ``target`` for each ``local`` name of a group.
    """
    head = F.substring_index(column, ".", 1)
    found = look_up(names, head, imports, group, "local", "target", "_target")
    rest = F.substring(F.col(column), F.length(head) + 1, F.length(column))
    renamed = F.when(F.col("_target").isNotNull(), F.concat("_target", rest)).otherwise(F.col(column))
    return found.withColumn(column, renamed).drop("_target")
