"""Places and running values along a whole table's order, without moving the table into one task.

Rows are dealt out by ranges of the order and written once; sums over the parts, a
row each, say where a part begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.operators.graph import settled


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with ``_part``, the range of the order they fall into. Ranges are even if the order has no long ties."""
    return settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def running(placed: DataFrame, order: list[Column | str], sums: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None, least: dict[str, Column] | None = None, backward: bool = False) -> DataFrame:
    """``placed`` (from ``in_order``) with running sums, maxima and minima, each row's own value included.

    ``backward``: ``order`` is the reverse of the one in which rows were placed.
    """
    kinds = {n: (F.sum, c) for n, c in (sums or {}).items()} | {n: (F.max, c) for n, c in (greatest or {}).items()} | {n: (F.min, c) for n, c in (least or {}).items()}
    parts = placed.groupBy("_part").agg(*[f(c).alias(f"_w_{n}") for n, (f, c) in kinds.items()])
    earlier = Window.orderBy(F.desc("_part") if backward else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    before = parts.select("_part", *[f(f"_w_{n}").over(earlier).alias(f"_b_{n}") for n, (f, _) in kinds.items()])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.withColumns({n: f(c).over(within) for n, (f, c) in kinds.items()}).join(F.broadcast(before), "_part")
    both = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + b, F.max: F.greatest, F.min: F.least}
    return joined.withColumns({n: both[f](F.col(f"_b_{n}"), F.col(n)) for n, (f, _) in kinds.items()}).drop(*[f"_b_{n}" for n in kinds])


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Adds aggregates of the whole table to each row."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))  # one row


def placed_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``_r``, the row's place from 1 in a total order, and ``_m``, the number of rows; ``_part`` stays."""
    ranked = running(in_order(df, *order), list(order), sums={"_r": F.lit(1)})
    return with_totals(ranked, _m=F.count("*"))


def tied_ranks(df: DataFrame, value: str) -> DataFrame:
    """Adds ``_rank`` (from 1, ties averaged), ``_m`` (rows) and ``_levels`` (distinct values), from the counts of distinct values. Null values come first."""
    counts = df.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranked = running(in_order(counts, "_value"), ["_value"], sums={"_upto": F.col("_n")})
    ranked = ranked.select("_value", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("_rank"))
    whole = F.broadcast(counts.agg(F.sum("_n").alias("_m"), F.count("*").alias("_levels")))
    return df.join(ranked, F.col(value).eqNullSafe(F.col("_value"))).drop("_value").crossJoin(whole)
