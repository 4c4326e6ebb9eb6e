"""p-values, q-values and their corrections over long tables; ranks of a whole table are made in parts (see ``order``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.functions.numeric import average_rank, normal_upper_tail, ordinal_rank
from cohortal.operators.graph import settled
from cohortal.operators.order import in_order, placed_rows, running, tied_ranks, with_totals


def q_values(df: DataFrame, p: str = "p", position: str = "pos", pi0: float = 1.0, *by: str) -> DataFrame:
    """Adds ``q``: p over the larger of p and its ordinal rank's share. No step-up. With ``by``, in each group alone."""
    if by:
        share = ordinal_rank(p, position, *by) / F.count("*").over(Window.partitionBy(*by))
        return df.withColumn("q", pi0 * F.col(p) / F.greatest(F.col(p), share))
    q = pi0 * F.col(p) / F.greatest(F.col(p), F.col("_r") / F.col("_m"))
    return placed_rows(df, p, position).withColumn("q", q).drop("_r", "_m", "_part")


def q_values_midrank(df: DataFrame, p: str = "p", position: str = "pos") -> DataFrame:
    """Adds ``q`` with half a rank taken off."""
    q = F.col(p) / F.greatest(F.col(p), (F.col("_r") - 0.5) / F.col("_m"))
    return placed_rows(df, p, position).withColumn("q", q).drop("_r", "_m", "_part")


def q_values_distinct(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds ``q`` with tied p-values counted as one level."""
    q = F.col(p) / F.greatest(F.col(p), (F.col("_rank") - 0.5) / F.col("_levels"))
    return tied_ranks(df, p).withColumn("q", q).drop("_rank", "_m", "_levels")


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m, by the asymptotic series at m + 8."""
    up = m + 8.0
    series = F.ln(up) + 0.57721566490153286 + 1 / (2 * up) - 1 / (12 * up * up) + 1 / (120 * up * up * up * up)
    return series - sum((1 / (m + k) for k in range(2, 9)), 1 / (m + 1.0))


METHODS = ("bonferroni", "sidak", "holm", "holm-sidak", "hochberg", "fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky", "hommel")


def adjusted(df: DataFrame, method: str, p: str = "p", position: str = "pos", alpha: float = 0.05) -> DataFrame:
    """Adds ``adjusted`` by one of METHODS (hochberg is simes-hochberg). ``alpha`` is that of the two-stage methods' first stage."""
    if method == "hommel":
        return hommel(df, p, position)
    if method in ("fdr_tsbh", "fdr_tsbky"):
        factor = 1 + alpha if method == "fdr_tsbky" else 1.0
        first = settled(adjusted(df, "fdr_bh", p, position))
        both = with_totals(first, _n=F.count("*"), _found=F.count(F.when(F.col("adjusted") <= alpha / factor, 1)))
        left = F.when(F.col("_found") == F.col("_n"), 1.0).otherwise(1 - F.col("_found") / F.col("_n"))
        return both.withColumn("adjusted", F.least(F.lit(1.0), F.col("adjusted") * left * factor)).drop("_n", "_found")
    base = placed_rows(df, p, position)
    remaining = F.col("_m") - F.col("_r") + 1
    step: dict[str, Column] = {
        "bonferroni": F.col(p) * F.col("_m"),
        "sidak": 1 - F.pow(1 - F.col(p), F.col("_m")),
        "holm": F.col(p) * remaining,
        "holm-sidak": 1 - F.pow(1 - F.col(p), remaining),
        "hochberg": F.col(p) * remaining,
        "fdr_bh": F.col(p) * F.col("_m") / F.col("_r"),
        "fdr_by": F.col(p) * F.col("_m") / F.col("_r") * _harmonic(F.col("_m")),
    }
    if method.startswith("holm"):
        base = running(base, [p, position], greatest={"_step": step[method]})
    elif method in ("hochberg", "fdr_bh", "fdr_by"):
        base = running(base, [F.desc(p), F.desc(position)], least={"_step": step[method]}, backward=True)
    else:
        base = base.withColumn("_step", step[method])
    return base.withColumn("adjusted", F.least(F.lit(1.0), F.col("_step"))).drop("_m", "_r", "_step", "_part")


#: Corners of the lower hull of ordered p-values that ``hommel`` sends to each task, at most.
HULL = 1_000_000


def _hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the points' lower convex hull, by x."""
    kept: list[int] = []
    for k in np.argsort(x, kind="stable"):
        while len(kept) > 1 and (y[kept[-1]] - y[kept[-2]]) * (x[k] - x[kept[-2]]) >= (y[k] - y[kept[-2]]) * (x[kept[-1]] - x[kept[-2]]):
            kept.pop()
        kept.append(k)
    return x[kept], y[kept]


def hommel(df: DataFrame, p: str = "p", position: str = "pos") -> DataFrame:
    """Adds ``adjusted`` by Hommel's method; null where p is null.

    The adjusted value is the largest, over numbers m of hypotheses, of the smaller of m p and q(m), m times the
    least of p(n - m + k) / k. That least ratio is the slope of a tangent to the lower hull of the ordered p-values,
    and falls as m grows: one running pass over ratios and p-values finds where m p is the smaller. Raises
    if the hull has more than HULL corners.
    """
    known = settled(placed_rows(df.where(F.col(p).isNotNull()), p, position).drop("_part"))

    def corners(batches):
        x, y = np.empty(0), np.empty(0)
        for b in batches:
            x, y = _hull(np.concatenate([x, b["x"]]), np.concatenate([y, b["y"]]))
        yield pd.DataFrame({"x": x, "y": y})

    parts = known.select(F.col("_r").cast("double").alias("x"), F.col(p).cast("double").alias("y")).mapInPandas(corners, "x double, y double").limit(HULL + 1).toPandas()
    if len(parts) > HULL:
        raise ValueError(f"the hull of the p-values has more than {HULL} corners")
    hx, hy = _hull(parts["x"].to_numpy(), parts["y"].to_numpy())
    slope = np.diff(hy) / np.diff(hx)
    meets = np.where(slope > 0, hx[:-1] - hy[:-1] / np.where(slope > 0, slope, 1.0), -np.inf)

    def ratios(batches):
        for b in batches:
            start = b["n"].to_numpy() - b["m"].to_numpy()
            at = np.searchsorted(meets, start, side="right")
            ratio = hy[at] / (hx[at] - start)
            yield pd.DataFrame({"_value": ratio, "_q": ratio * b["m"]})

    tangents = known.select(F.col("_r").cast("double").alias("m"), F.col("_m").cast("double").alias("n")).mapInPandas(ratios, "_value double, _q double")
    both = known.withColumns({"_value": F.col(p).cast("double"), "_kind": F.lit(0)}).unionByName(tangents.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = ["_value", "_kind"]
    passed = running(in_order(both, *order), order, sums={"_below": F.col("_kind")}, greatest={"_most": F.col("_q")})
    value = F.greatest((F.col("_m") - F.coalesce("_below", F.lit(0))) * F.col(p), F.coalesce("_most", F.lit(0.0)))
    out = passed.where("_kind = 0").withColumn("adjusted", F.least(F.lit(1.0), value)).select(*df.columns, "adjusted")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def normal_p_values(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``p``, the upper normal tail by the column's own mean and population deviation, and ``r``, the fractional average rank."""
    both = with_totals(tied_ranks(df, value), _mean=F.avg(value), _deviation=F.stddev_pop(value))
    z = (F.col(value) - F.col("_mean")) / F.nullif(F.col("_deviation"), F.lit(0.0))
    return both.withColumn("p", normal_upper_tail(z)).withColumn("r", F.col("_rank") / F.col("_m")).drop("_rank", "_m", "_levels", "_mean", "_deviation")


def fractional_rank(df: DataFrame, value: str, position: str) -> DataFrame:
    """Adds ``fraction``: place in order, counted from one half, over the number of rows."""
    return placed_rows(df, value, position).withColumn("fraction", (F.col("_r") - 0.5) / F.col("_m")).drop("_r", "_m", "_part")


def value_at_percentile(df: DataFrame, value: str, position: str, percentile: float) -> DataFrame:
    """One row: the value whose fractional rank is the percentile's, else the mean of the two nearest."""
    ranked = with_totals(fractional_rank(df, value, position), _low=F.min("fraction"), _high=F.max("fraction"))
    target = F.least(F.greatest(F.lit(percentile / 100.0), F.col("_low")), F.col("_high"))
    apart = ranked.withColumn("_apart", F.round(F.abs(F.col("fraction") - target), 12))
    nearest = apart.orderBy("_apart", "fraction").limit(2)
    exact = F.max(F.when(F.col("_apart") == 0, F.col(value)))
    return nearest.agg(F.coalesce(exact, F.avg(value)).alias("value"))


def rank_distinct_share(df: DataFrame, value: str) -> DataFrame:
    """Adds ``share``: average rank less one half, over the number of distinct values."""
    return tied_ranks(df, value).withColumn("share", (F.col("_rank") - 0.5) / F.col("_levels")).drop("_rank", "_m", "_levels")


def equalised(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds ``equalised``: fractional average rank, which flattens the distribution of values; with ``by``, in each group alone."""
    if by:
        return df.withColumn("equalised", average_rank(value, *by) / F.count("*").over(Window.partitionBy(*by)))
    return tied_ranks(df, value).withColumn("equalised", F.col("_rank") / F.col("_m")).drop("_rank", "_m", "_levels")


def z_scores(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds ``z`` within groups, by the population deviation; null where that is 0."""
    w = Window.partitionBy(*by)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def moments(df: DataFrame, value: str, highest: int, *by: str) -> DataFrame:
    """Mean, population deviation and standardized moments from the third up to ``highest`` of each group."""
    z = z_scores(df, value, *by)
    rest = [F.avg(F.pow("z", k)).alias(f"moment_{k}") for k in range(3, highest + 1)]
    return z.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), *rest)


def rank_derivative_p(df: DataFrame, value: str, position: str, normal: bool = False) -> DataFrame:
    """Adds ``slope``, the mean step of values, in order of position, among a row and its neighbours in rank, and ``p`` of its size.

    The first in rank looks two places up, the last one place down. ``p`` is
    exponential about the mean slope, or with ``normal`` the upper tail of a normal
    distribution with the slopes' mean and population deviation.
    """
    placed = placed_rows(df, value, position)
    own = F.struct(F.col(position).alias("at"), F.col(value).alias("v"))
    # A row's window: its neighbours are the rows one place on either side, or two up for the first.
    sent = F.when(F.col("_r") == 3, F.array(F.lit(-1), F.lit(0), F.lit(1), F.lit(-2))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    around = placed.select(F.explode(F.transform(sent, lambda k: F.col("_r") + k)).alias("_r"), own.alias("_o"), F.col("_r").alias("_from"))
    around = around.where("NOT (_r = 1 AND _from = 2)").groupBy("_r").agg(F.array_sort(F.collect_list("_o")).alias("_s"))  # three rows at most
    x = placed.drop("_part", "_m").join(around, "_r")
    x = x.withColumn("slope", F.abs(F.element_at("_s", -1)["v"] - F.col("_s")[0]["v"]) / F.nullif((F.size("_s") - 1).cast("double"), F.lit(0.0))).drop("_s", "_r")
    both = with_totals(x, _mean=F.avg("slope"), _deviation=F.stddev_pop("slope"))
    p = normal_upper_tail((F.col("slope") - F.col("_mean")) / F.nullif(F.col("_deviation"), F.lit(0.0))) if normal else F.exp(-F.col("slope") / F.col("_mean"))
    return both.withColumn("p", p).drop("_mean", "_deviation")


def leverage_p(df: DataFrame, feature: str, leverage: str) -> DataFrame:
    """Adds ``p`` of log leverages, an upper normal tail, and ``rank_p``, the cumulative share of leverage from the largest down."""
    x = with_totals(df.withColumn("_log", F.ln(leverage)), _mean=F.avg("_log"), _deviation=F.stddev_pop("_log"), _sum=F.sum(leverage))
    x = x.withColumn("p", normal_upper_tail((F.col("_log") - F.col("_mean")) / F.nullif(F.col("_deviation"), F.lit(0.0)))).drop("_log", "_mean", "_deviation")
    down = [F.desc(leverage), F.col(feature)]
    x = running(in_order(x, *down), down, sums={"rank_p": F.col(leverage)})
    return x.withColumn("rank_p", F.col("rank_p") / F.col("_sum")).drop("_sum", "_part")
