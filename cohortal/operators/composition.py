"""Composition of features over labels, and how specific a feature is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def absolute(df: DataFrame, feature: str, label: str, value: str) -> DataFrame:
    return df.groupBy(feature, label).agg(F.sum(value).alias("amount"))


def fractions(amounts: DataFrame, feature: str) -> DataFrame:
    """Adds ``fraction`` of the feature's total."""
    return amounts.withColumn("fraction", F.col("amount") / F.sum("amount").over(Window.partitionBy(feature)))


def specificity(amounts: DataFrame, feature: str) -> DataFrame:
    """feature, n, beta (one less the share of the mean in the maximum), tau, gini, gini_unbiased, tsi (share of the maximum)."""
    ranked = amounts.withColumn("_k", F.row_number().over(Window.partitionBy(feature).orderBy("amount")))
    g = ranked.groupBy(feature).agg(F.count("*").alias("n"), F.sum("amount").alias("s"), F.max("amount").alias("m"), F.sum(F.col("_k") * F.col("amount")).alias("w"))
    gini = 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    tau = (F.col("n") - F.col("s") / F.col("m")) / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))
    return g.select(feature, "n", (1 - F.col("s") / F.col("n") / F.col("m")).alias("beta"), tau.alias("tau"), gini.alias("gini"), (gini * F.col("n") / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))).alias("gini_unbiased"), (F.col("m") / F.col("s")).alias("tsi"))


def cumulative_sets(amounts: DataFrame, feature: str, label: str) -> DataFrame:
    """feature, k, cumulative fraction and the dotted name of the k largest labels."""
    w = Window.partitionBy(feature).orderBy(F.desc("amount"), label)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = fractions(amounts, feature).withColumn("k", F.row_number().over(w)).withColumn("cumulative", F.sum("fraction").over(upto))
    return x.select(feature, "k", "cumulative", F.array_join(F.sort_array(F.collect_list(F.col(label).cast("string")).over(upto)), ".").alias("labels"))


def level_sets(cumulative: DataFrame, feature: str, levels: list[float]) -> DataFrame:
    """feature, level, labels: the smallest set of labels that holds a level's share."""
    wanted = cumulative.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.col("cumulative") >= F.col("level") - 1e-10)
    return wanted.groupBy(feature, "level").agg(F.min_by("labels", "k").alias("labels"))


def feature_classes(amounts: DataFrame, feature: str, detection: float = 1.0, gap: float = 2.0) -> DataFrame:
    """feature, class: 0 nowhere detected, 1 one label stands out, 2 a group does, 3 mixed, 4 everywhere detected.

    Standing out is a gap of ``gap`` in log2 between neighbours of the falling order.
    """
    w = Window.partitionBy(feature).orderBy(F.desc("amount"))
    x = amounts.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("amount").over(w))
    jump = F.log2((F.col("amount") + 1) / (F.coalesce("_next", F.lit(0.0)) + 1)) >= gap
    g = x.groupBy(feature).agg(F.max("amount").alias("top"), F.min("amount").alias("low"), F.min(F.when(jump & F.col("_next").isNotNull(), F.col("_k"))).alias("first"))
    kind = F.when(F.col("top") < detection, 0).when(F.col("first") == 1, 1).when(F.col("first") > 1, 2).when(F.col("low") < detection, 3).otherwise(4)
    return g.select(feature, kind.alias("class"))
