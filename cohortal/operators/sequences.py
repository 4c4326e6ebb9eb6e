"""Lists and tables of rows: parts, orders and chunks of lists, labels by first appearance, long and wide forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators.order import placed_rows
from cohortal.operators.text import shared_words


def sub_arrays(items: Column) -> Column:
    """All contiguous parts of a list, by first place and then by length; of an empty list none."""
    n = F.size(items)
    from_ = lambda a: F.transform(F.sequence(F.lit(1), n - a + 1), lambda size: F.slice(items, a, size))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), from_))).otherwise(F.array())


def chunks(items: Column, n: int) -> Column:
    """The list in pieces of n; what is left over at the end is dropped."""
    whole = F.floor(F.size(items) / n).cast("int")
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda k: F.slice(items, k * n + 1, n))).otherwise(F.array())


def without_places(items: Column, places: list[int]) -> Column:
    """The list without what stands at these places, from 0."""
    return F.filter(items, lambda _, k: ~k.isin(places))


def permutations(items: Column, n: int) -> Column:
    """All ordered choices of n of a list's different values; there are as many as such choices."""
    values = F.array_distinct(items)
    longer = lambda chosen: F.transform(F.filter(values, lambda x: ~F.array_contains(chosen, x)), lambda x: F.concat(chosen, F.array(x)))
    return reduce(lambda out, _: F.flatten(F.transform(out, longer)), range(n - 1), F.transform(values, lambda x: F.array(x)))


def renamed_by_first(df: DataFrame, label: str, position: str) -> DataFrame:
    """Adds ``number``: labels from 0 in the order in which they first appear. Null is a label as well."""
    first = df.groupBy(label).agg(F.min(position).alias("_first"))
    numbers = placed_rows(first, "_first").select(F.col(label).alias("_label"), (F.col("_r") - 1).cast("long").alias("number"))
    return df.join(numbers, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def located(df: DataFrame, position: str, text: str, words: str, exact: str) -> DataFrame:
    """One row, ``position``: the first row whose text holds ``exact``, else the last of those that share most words with ``words``."""
    score = shared_words(F.col(text), F.lit(words))
    holds = F.when(F.contains(F.col(text), F.lit(exact)), F.col(position))
    return df.agg(F.coalesce(F.min(holds), F.max(F.struct(score.alias("s"), F.col(position).alias("p")))["p"]).alias("position"))


def long_form(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """``ids``, variable, value: a row a value column, as doubles."""
    return wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(ids, values, "variable", "value")


def cross_table(df: DataFrame, row: str, column: str, labels: list) -> DataFrame:
    """A row a value of ``row``, a column of counts for each of the labels."""
    counted = df.groupBy(row).pivot(column, labels).agg(F.count(F.lit(1)))
    return counted.na.fill(0, [str(x) for x in labels])


def named_with_places(groups: DataFrame, places: DataFrame) -> DataFrame:
    """gid, name, members: nested members (lists of lists) laid flat and distinct, names headed by their compartments in brackets.

    ``groups``: gid, name, members; ``places``: gid, place. A group without a place keeps its name.
    """
    at = places.where("place IS NOT NULL").groupBy("gid").agg(F.array_join(F.sort_array(F.collect_set("place")), ",").alias("_at"))
    flat = F.sort_array(F.array_distinct(F.flatten("members")))
    head = F.when(F.col("_at").isNotNull(), F.concat(F.lit("["), F.col("_at"), F.lit("] "), F.col("name"))).otherwise(F.col("name"))
    return groups.join(at, "gid", "left").select("gid", head.alias("name"), flat.alias("members"))
