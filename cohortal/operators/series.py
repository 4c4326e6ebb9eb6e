"""Operators on series (series_id, pos, value): positions count from 0 without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_average(df: DataFrame, tau: int, by: str = "series_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Adds ``rolling``: mean over a centred window of half-width floor(tau / 2), in which the last sample never takes part."""
    w = tau // 2
    n = F.count("*").over(Window.partitionBy(by))
    frame = Window.partitionBy(by).orderBy(pos).rowsBetween(-w, w - 1)
    return df.withColumn("_v", F.when(F.col(pos) < n - 1, F.col(value))).withColumn("rolling", F.avg("_v").over(frame)).drop("_v")


def lagged(df: DataFrame, n: int = 1, by: str = "series_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Adds ``total``, ``change`` and ``contrast`` of each value and the one n places on."""
    ahead = F.lead(value, n).over(Window.partitionBy(by).orderBy(pos))
    x = df.withColumn("_a", ahead)
    return x.withColumns({"total": F.col("_a") + F.col(value), "change": F.col("_a") - F.col(value), "contrast": (F.col("_a") - F.col(value)) / F.nullif(F.col("_a") + F.col(value), F.lit(0.0))}).drop("_a")


def lag_contrasts(df: DataFrame, by: str = "series_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """series, pos, contrast: contrasts of each value with every later one, summed and divided by the length of the series. A series is one row's list."""
    one = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("_s"))
    later = lambda x, k: F.filter("_s", lambda _, m: m > k)
    total = lambda x, k: F.aggregate(later(x, k), F.lit(0.0), lambda s, y: s + (y["v"] - x["v"]) / F.nullif(y["v"] + x["v"], F.lit(0.0)))
    held = F.transform("_s", lambda x, k: F.struct(x["p"].alias("p"), (total(x, k) / F.size("_s")).alias("c")))
    return one.select(by, F.explode(held).alias("_c")).select(by, F.col("_c.p").alias(pos), F.col("_c.c").alias("contrast"))


def autocorrelation(df: DataFrame, by: str = "series_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """series, lag, r: circular autocorrelation of the mean-free series, 1 at lag 0, for the first half of the lags."""
    n = F.count("*").over(Window.partitionBy(by))
    x = df.select(by, F.col(pos).alias("p"), (F.col(value) - F.avg(value).over(Window.partitionBy(by))).alias("v"), n.alias("n"))
    lags = x.select(by, "p", "v", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 2))).alias("lag"))
    other = x.select(F.col(by), F.col("p").alias("q"), F.col("v").alias("w"))
    g = lags.withColumn("q", ((F.col("p") + F.col("lag")) % F.col("n")).cast("long")).join(other, [by, "q"]).groupBy(by, "lag").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return g.select(by, "lag", (F.col("s") / F.nullif(F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(by)), F.lit(0.0))).alias("r"))


def errors(df: DataFrame, model: str, evidence: str, uncertainty: float = 0.05) -> DataFrame:
    """mse, cosine and z2 (with the fitted scale of the model) of two columns."""
    m, e = F.col(model), F.col(evidence)
    g = df.agg(F.avg((m - e) * (m - e)).alias("mse"), (F.sum(m * e) / F.sqrt(F.sum(m * m) * F.sum(e * e))).alias("cosine"), F.sum(m * e).alias("_me"), F.sum(m * m).alias("_mm"), F.sum(e * e).alias("_ee"), F.count("*").alias("_n"))
    return g.select("mse", "cosine", ((F.col("_ee") - F.col("_me") * F.col("_me") / F.col("_mm")) / (uncertainty * uncertainty) / F.col("_n")).alias("z2"))
