"""Tests that compare groups of samples feature by feature: conditional aggregates, no loop over features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.functions.numeric import average_rank, f_upper_tail, normal_upper_tail, t_two_sided


def _two(label: str, a: str, b: str, value: str) -> tuple[Column, Column]:
    return F.when(F.col(label) == a, F.col(value)), F.when(F.col(label) == b, F.col(value))


def sided(p: Column, statistic: Column, alternative: str) -> Column:
    """The p-value of an alternative (two-sided, greater, less) from the two-sided one and the sign of its statistic."""
    if alternative == "two-sided":
        return p
    toward = statistic > 0 if alternative == "greater" else statistic < 0
    return F.when(toward, p / 2).otherwise(1 - p / 2)


def welch(df: DataFrame, feature: str, label: str, a: str, b: str, value: str = "value", alternative: str = "two-sided") -> DataFrame:
    """feature, n_a, n_b, difference, t, df, p (of ``alternative``, about ``a``) of Welch's test. Features with fewer than two values on a side, or none that vary, have null t and p."""
    x, y = _two(label, a, b, value)
    g = df.groupBy(feature).agg(F.count(x).alias("n_a"), F.count(y).alias("n_b"), F.avg(x).alias("m_a"), F.avg(y).alias("m_b"), F.var_samp(x).alias("v_a"), F.var_samp(y).alias("v_b"))
    ea, eb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    g = g.withColumn("difference", F.col("m_a") - F.col("m_b")).withColumn("_e", F.nullif(ea + eb, F.lit(0.0)))
    g = g.withColumn("t", F.col("difference") / F.sqrt("_e")).withColumn("df", F.col("_e") * F.col("_e") / (ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1)))
    return g.withColumn("p", sided(t_two_sided(F.col("t"), F.col("df")), F.col("t"), alternative)).select(feature, "n_a", "n_b", "difference", "t", "df", "p")


def paired_t(df: DataFrame, feature: str, pair: str, label: str, a: str, b: str, value: str = "value") -> DataFrame:
    """feature, n, t, p of the paired test over pairs that have both labels."""
    x, y = _two(label, a, b, value)
    d = df.groupBy(feature, pair).agg((F.avg(x) - F.avg(y)).alias("d")).where("d IS NOT NULL")
    g = d.groupBy(feature).agg(F.count("*").alias("n"), (F.avg("d") / F.nullif(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))
    return g.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 1.0))


def mann_whitney(df: DataFrame, feature: str, label: str, a: str, b: str, value: str = "value", alternative: str = "two-sided") -> DataFrame:
    """feature, n_a, n_b, u (of a), p: normal approximation with tie correction and continuity, of ``alternative`` about ``a``."""
    both = df.where(F.col(label).isin(a, b) & F.col(value).isNotNull())
    ties = F.count("*").over(Window.partitionBy(feature, value))
    ranked = both.withColumn("_rank", average_rank(value, feature)).withColumn("_tie", ties * ties - 1.0)
    g = ranked.groupBy(feature).agg(
        F.count(F.when(F.col(label) == a, 1)).alias("n_a"), F.count(F.when(F.col(label) == b, 1)).alias("n_b"),
        F.sum(F.when(F.col(label) == a, F.col("_rank"))).alias("_r"), F.sum("_tie").alias("_ties"),
    )
    n = F.col("n_a") + F.col("n_b")
    g = g.withColumn("u", F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    mean, sd = F.col("n_a") * F.col("n_b") / 2, F.sqrt(F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    away = F.col("u") - mean if alternative == "greater" else mean - F.col("u") if alternative == "less" else F.abs(F.col("u") - mean)
    two = alternative == "two-sided"
    z = (F.greatest(F.lit(0.0), away - 0.5) if two else away - 0.5) / F.nullif(sd, F.lit(0.0))
    return g.withColumn("p", F.least(F.lit(1.0), (2 if two else 1) * normal_upper_tail(z))).select(feature, "n_a", "n_b", "u", "p")


def fold_change(df: DataFrame, feature: str, label: str, a: str, b: str, value: str = "value") -> DataFrame:
    """feature, mean_difference, median_difference, log2_ratio (of means) and pooled-variance t."""
    x, y = _two(label, a, b, value)
    g = df.groupBy(feature).agg(
        (F.avg(x) - F.avg(y)).alias("mean_difference"), (F.median(x) - F.median(y)).alias("median_difference"), F.log2(F.avg(x) / F.avg(y)).alias("log2_ratio"),
        F.count(x).alias("_n"), F.count(y).alias("_m"), F.var_samp(x).alias("_v"), F.var_samp(y).alias("_w"),
    )
    pooled = ((F.col("_n") - 1) * F.col("_v") + (F.col("_m") - 1) * F.col("_w")) / (F.col("_n") + F.col("_m") - 2)
    return g.withColumn("t", F.col("mean_difference") / F.sqrt(pooled * (1 / F.col("_n") + 1 / F.col("_m")))).drop("_n", "_m", "_v", "_w")


def differences(df: DataFrame, feature: str, label: str, a: str, b: str, value: str = "value") -> DataFrame:
    """feature, a, b, left, right, dist: both labels' means, their differences either way and its square; null where one is missing."""
    x, y = _two(label, a, b, value)
    g = df.groupBy(feature).agg(F.avg(x).alias("a"), F.avg(y).alias("b")).withColumn("left", F.col("a") - F.col("b"))
    return g.withColumn("right", -F.col("left")).withColumn("dist", F.col("left") * F.col("left"))


def one_way_anova(df: DataFrame, feature: str, label: str, value: str = "value") -> DataFrame:
    """feature, f, d1, d2, p over all labels, from sums and sums of squares of groups."""
    groups = df.groupBy(feature, label).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n, grand = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    g = groups.groupBy(feature).agg(F.count("*").alias("k"), n.alias("n"), grand.alias("m"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_s"))
    g = g.withColumn("d1", F.col("k") - 1.0).withColumn("d2", (F.col("n") - F.col("k")).cast("double"))
    g = g.withColumn("f", (F.col("_s") - F.col("n") * F.col("m") * F.col("m")) / F.col("d1") / F.nullif(F.col("within") / F.col("d2"), F.lit(0.0)))
    return g.withColumn("p", f_upper_tail(F.col("f"), F.col("d1"), F.col("d2"))).select(feature, "f", "d1", "d2", "p")


def regression_assessment(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """slope, intercept, tss, rss, ess, f, p of a straight line in each group."""
    g = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("tss"), F.regr_r2(y, x).alias("_r2"), F.regr_count(y, x).alias("_n"))
    g = g.withColumn("ess", F.col("tss") * F.col("_r2")).withColumn("rss", F.col("tss") - F.col("ess"))
    g = g.withColumn("f", F.col("ess") / F.nullif(F.col("rss") / (F.col("_n") - 2), F.lit(0.0)))
    return g.withColumn("p", f_upper_tail(F.col("f"), F.lit(1.0), F.col("_n") - 2.0)).drop("_r2", "_n")


def kendall(df: DataFrame, feature: str, sample: str, x: str, y: str) -> DataFrame:
    """feature, tau: Kendall's tau-b over pairs of a feature's samples. Pairs are of samples, whose number is small."""
    pairs = df.select(feature, F.col(sample).alias("_s"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    other = pairs.select(F.col(feature), *[F.col(c).alias(f"{c}2") for c in ("_s", "_x", "_y")])
    sx, sy = F.signum(F.col("_x") - F.col("_x2")), F.signum(F.col("_y") - F.col("_y2"))
    g = pairs.join(other, feature).where("_s < _s2").groupBy(feature).agg(F.sum(sx * sy).alias("s"), F.sum(sx * sx).alias("nx"), F.sum(sy * sy).alias("ny"))
    return g.select(feature, (F.col("s") / F.nullif(F.sqrt(F.col("nx") * F.col("ny")), F.lit(0.0))).alias("tau"))


def gram_solution(long: DataFrame, design: DataFrame, feature: str, sample: str, value: str, terms: list[str]) -> DataFrame:
    """Least squares of each feature on the design's columns: feature, term, beta.

    The terms-by-terms Gram matrix is one aggregate; its pseudo-inverse is made on
    the driver (its size is that of the formula, not of the data) and goes back into
    the plan as literals, so that features are solved where they are.
    """
    products = [F.sum(F.col(a) * F.col(b)) for a in terms for b in terms]
    gram = np.array(list(design.agg(*products).first()), float).reshape(len(terms), -1)
    inverse = np.linalg.pinv(gram)
    sums = long.join(design, sample).groupBy(feature).agg(*[F.sum(F.col(value) * F.col(t)).alias(f"_x{i}") for i, t in enumerate(terms)])
    betas = [F.struct(F.lit(t).alias("term"), sum((F.lit(float(inverse[i, j])) * F.col(f"_x{j}") for j in range(len(terms))), F.lit(0.0)).alias("beta")) for i, t in enumerate(terms)]
    return sums.select(feature, F.inline(F.array(*betas)))


def group_means(df: DataFrame, label: str, feature: str, value: str) -> DataFrame:
    return df.groupBy(label, feature).agg(F.avg(value).alias("mean"))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Derived rates of a confusion table; null where a denominator is 0."""
    over = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    n = tp + fp + fn + tn
    tpr, tnr, ppv, npv = over(tp, tp + fn), over(tn, tn + fp), over(tp, tp + fp), over(tn, tn + fn)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "tpr": tpr, "tnr": tnr, "ppv": ppv, "npv": npv, "fnr": 1 - tpr, "fpr": 1 - tnr, "fdr": 1 - ppv, "fomr": 1 - npv,
        "accuracy": over(tp + tn, n), "balanced_accuracy": (tpr + tnr) / 2, "prevalence": over(tp + fn, n), "f1": over(2 * tp, 2 * tp + fp + fn),
        "informedness": tpr + tnr - 1, "markedness": ppv + npv - 1, "lr_plus": tpr / F.nullif(1 - tnr, F.lit(0.0)), "lr_minus": (1 - tpr) / F.nullif(tnr, F.lit(0.0)),
        "mcc": (tp * tn - fp * fn) / F.nullif(root, F.lit(0.0)), "fowlkes_mallows": F.sqrt(ppv * tpr), "odds_ratio": over(tp * tn, fp * fn),
    }

