"""Model formulas and design columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Columns of a wide design at most.
MOST_COLUMNS = 1000


@dataclass(frozen=True)
class Formula:
    """The right-hand side of ``y ~ C(a):C(b) + C(a) + x``: categories, interactions (pairs) and linear terms."""

    categories: tuple[str, ...]
    interactions: tuple[tuple[str, ...], ...]
    linear: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> Formula:
        cats, pairs, linear = [], [], []
        for term in map(str.strip, text.split("~")[-1].split("+")):
            names = [re.sub(r"^C\((.*)\)$", r"\1", x.strip()) for x in term.split(":")]
            if len(names) > 1:
                pairs.append(tuple(names))
            elif term.startswith("C("):
                cats.append(names[0])
            elif term:
                linear.append(names[0])
        return cls(tuple(cats), tuple(pairs), tuple(linear))


def one_hot(df: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, 1 for each row's label: the design in long form."""
    return df.select(key, F.col(label).alias("label"), F.lit(1).alias("one")).where("label IS NOT NULL").distinct()


def one_hot_wide(df: DataFrame, key: str, label: str) -> DataFrame:
    """One 0/1 column for each label, in order of labels; more labels than MOST_COLUMNS raise, as a wide table cannot hold them."""
    labels = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(MOST_COLUMNS + 1).collect()]
    if len(labels) > MOST_COLUMNS:
        raise ValueError(f"{label} has more than {MOST_COLUMNS} labels; use the long form, one_hot")
    return df.groupBy(key).agg(*[F.max((F.col(label) == x).cast("int")).alias(str(x)) for x in labels])


def interaction(df: DataFrame, key: str, parts: tuple[str, ...]) -> DataFrame:
    """The design of joined labels."""
    return one_hot(df.withColumn("_label", F.concat_ws("-", *parts)), key, "_label")


def design(df: DataFrame, key: str, formula: Formula) -> DataFrame:
    """All terms of a formula in long form: key, label, weight."""
    out = None
    parts = [one_hot(df, key, c).withColumnRenamed("one", "weight") for c in formula.categories]
    parts += [interaction(df, key, p).withColumnRenamed("one", "weight") for p in formula.interactions]
    parts += [df.select(key, F.lit(x).alias("label"), F.col(x).cast("double").alias("weight")) for x in formula.linear]
    for p in parts:
        p = p.withColumn("weight", F.col("weight").cast("double"))
        out = p if out is None else out.unionByName(p)
    return out


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def numbered_keys(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Adds ``paired``: the key with the place of its value, largest first, from 0."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), *order)) - 1
    return df.withColumn("paired", F.concat_ws(".", F.col(key).cast("string"), n.cast("string")))


def inverted(df: DataFrame, key: str, value: str) -> DataFrame:
    """value with the sorted list of its keys."""
    return df.groupBy(value).agg(F.sort_array(F.collect_set(key)).alias("keys"))
