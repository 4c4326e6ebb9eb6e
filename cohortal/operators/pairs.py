"""Distances, correlations and overlaps of pairs, and fields over matrices in long form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortal.functions.numeric import average_rank
from cohortal.operators import tiles
from cohortal.operators.graph import settled
from cohortal.operators.order import in_order, placed_rows, running, with_totals

#: Points of a cell at least, on average; pairs are made from two cells at a time (see ``tiles``).
BLOCK = 256


def pair_distances(points: DataFrame, key: str = "id", vector: str = "vec") -> DataFrame:
    """i, j, d (Euclidean) for i < j of all points, made tile by tile; d is null where a vector is null or lengths differ."""
    return tiles.all_pairs(points, key, vector, BLOCK)


#: Distinct distances whose ranks are sent to every task at most.
RANKS = 4_000_000


def equalised_pairs(points: DataFrame, places: int = 6) -> DataFrame:
    """i, j, equalised: fractional average rank of the distance, rounded to decimals, of each pair of points (item, vec).

    Ranks come from counts of distinct distances; pairs are made a second time to be given theirs.
    """
    up = F.col("cell").asc_nulls_last()
    counts = settled(tiles.cell_counts(points, *tiles.decimals(places)).select("cell", "n"))
    ranked = with_totals(running(in_order(counts, up), [up], sums={"_upto": F.col("n")}), _m=F.sum("n"))
    ranks = settled(ranked.select("cell", ((F.col("_upto") - (F.col("n") - 1) / 2.0) / F.col("_m")).alias("equalised")))
    ranks = F.broadcast(ranks) if ranks.count() <= RANKS else ranks
    return tiles.rounded_pairs(points, places, cells=True).join(ranks, F.col("d").eqNullSafe(F.col("cell"))).select("i", "j", "equalised")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair and its reverse, made in one pass."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    ends = F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return pairs.select(F.explode(ends).alias("_e"), *rest).select(*[F.col(f"_e.{c}").alias(c) if c in ("i", "j") else F.col(c) for c in pairs.columns])


def correlations(df: DataFrame, feature: str, sample: str, value: str, ranked: bool = False) -> DataFrame:
    """i, j, r of each pair of features over shared samples; ``ranked``: of ranks within a feature."""
    long = df.select(F.col(feature).alias("f"), F.col(sample).alias("s"), F.col(value).alias("v"))
    if ranked:
        long = long.withColumn("v", average_rank("v", "f"))
    a, b = long.select(F.col("f").alias("i"), "s", F.col("v").alias("x")), long.select(F.col("f").alias("j"), "s", F.col("v").alias("y"))
    return a.join(b, "s").where("i < j").groupBy("i", "j").agg(F.corr("x", "y").alias("r"))


def correlation_distance(pairs: DataFrame) -> DataFrame:
    """i, j, d: root of 1 - r, to four decimals."""
    return pairs.select("i", "j", F.round(F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r"))), 4).alias("d"))


def cosines(df: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """i, j, cosine of each pair of features."""
    long = df.select(F.col(feature).alias("f"), F.col(sample).alias("s"), F.col(value).alias("v"))
    a, b = long.select(F.col("f").alias("i"), "s", F.col("v").alias("x")), long.select(F.col("f").alias("j"), "s", F.col("v").alias("y"))
    g = a.join(b, "s").where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return g.select("i", "j", (F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("cosine"))


def cross_power(df: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """i, j, power: products of two features' spectra summed over frequencies, which are their inner product times the number of samples."""
    n = df.agg(F.count_distinct(sample).alias("_n"))
    side = lambda k: df.select(sample, F.col(feature).alias(k), F.col(value).alias("_" + k))
    sums = side("i").join(side("j"), sample).groupBy("i", "j").agg(F.sum(F.col("_i") * F.col("_j")).alias("_s"))
    return sums.crossJoin(F.broadcast(n)).select("i", "j", (F.col("_s") * F.col("_n")).alias("power"))  # one row


def resonances(power: DataFrame, value: str = "power") -> DataFrame:
    """Adds ``resonance``: values over the mean size of the first row's percentiles 1 and 99, brought between -1 and 1 by the logistic curve of base 2."""
    first = power.agg(F.min("i").alias("i"))
    edge = power.join(F.broadcast(first), "i").agg(((F.abs(F.percentile(value, 0.01)) + F.abs(F.percentile(value, 0.99))) / 2).alias("_f"))  # one row
    return power.crossJoin(F.broadcast(edge)).withColumn("resonance", F.tanh(F.col(value) / F.nullif(F.col("_f"), F.lit(0.0)) * (math.log(2) / 2))).drop("_f")


def mean_field(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Adds ``field``: twice the product of row and column mean over their sum."""
    r, c = F.avg(value).over(Window.partitionBy(row)), F.avg(value).over(Window.partitionBy(column))
    return df.withColumn("_r", r).withColumn("_c", c).withColumn("field", 2 * F.col("_r") * F.col("_c") / (F.col("_r") + F.col("_c"))).drop("_r", "_c")


def std_field(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Adds ``field`` of population deviations in the same way."""
    r, c = F.stddev_pop(value).over(Window.partitionBy(row)), F.stddev_pop(value).over(Window.partitionBy(column))
    return df.withColumn("_r", r).withColumn("_c", c).withColumn("field", 2 * F.col("_r") * F.col("_c") / (F.col("_r") + F.col("_c"))).drop("_r", "_c")


def double_centered(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Adds ``centered``: value less row and column mean plus the mean of all."""
    w = lambda *k: F.avg(value).over(Window.partitionBy(*k))
    return df.withColumn("centered", F.col(value) - w(row) - w(column) + w())


def block_removed(df: DataFrame, feature: str, block: str, value: str) -> DataFrame:
    """Adds ``cleaned``: value less its block's mean plus its feature's."""
    return df.withColumn("cleaned", F.col(value) - F.avg(value).over(Window.partitionBy(feature, block)) + F.avg(value).over(Window.partitionBy(feature)))


def group_mean_of_others(df: DataFrame, feature: str, group: str, value: str) -> DataFrame:
    """Adds ``others``: the mean of the other members of a feature's group; null for single members."""
    w = Window.partitionBy(feature, group)
    return df.withColumn("others", (F.sum(value).over(w) - F.col(value)) / F.nullif((F.count(value).over(w) - 1).cast("double"), F.lit(0.0)))


def imputed(df: DataFrame, feature: str, group: str, value: str) -> DataFrame:
    """Nulls and NaN replaced by the mean of the feature's group, else of the feature."""
    known = F.nanvl(F.col(value), F.lit(None).cast("double"))
    x = df.withColumn(value, known)
    return x.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(feature, group)), F.avg(value).over(Window.partitionBy(feature))))


def jaccard(membership: DataFrame, key: str, member: str) -> DataFrame:
    """i, j, shared, jaccard of groups that share a member."""
    m = membership.select(F.col(key).alias("g"), F.col(member).alias("m")).distinct()
    size = m.groupBy("g").agg(F.count("*").alias("n"))
    shared = m.alias("a").join(m.alias("b"), "m").where("a.g < b.g").groupBy(F.col("a.g").alias("i"), F.col("b.g").alias("j")).agg(F.count("*").alias("shared"))
    out = shared.join(size.withColumnsRenamed({"g": "i", "n": "_ni"}), "i").join(size.withColumnsRenamed({"g": "j", "n": "_nj"}), "j")
    return out.select("i", "j", "shared", (F.col("shared") / (F.col("_ni") + F.col("_nj") - F.col("shared"))).alias("jaccard"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, shared, jaccard of the groups of two groupings (gid, member) that share a member."""
    x, y = left.distinct().select(F.col("gid").alias("a"), "member"), right.distinct().select(F.col("gid").alias("b"), "member")
    shared = x.join(y, "member").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = shared.join(x.groupBy("a").agg(F.count("*").alias("na")), "a").join(y.groupBy("b").agg(F.count("*").alias("nb")), "b")
    return sizes.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def row_order(df: DataFrame, row: str, value: str) -> DataFrame:
    """row, mean, place (from 0): the rows of a matrix in long form in order of their means, ties by row."""
    means = df.groupBy(row).agg(F.avg(value).alias("mean"))
    return placed_rows(means, "mean", row).select(row, "mean", (F.col("_r") - 1).alias("place"))


def _density(counts: DataFrame, width: float, dimensions: int, constant: float) -> DataFrame:
    shell = constant * math.pi * (F.pow((F.col("bin") + 1) * width, dimensions) - F.pow(F.col("bin") * width, dimensions))
    return counts.withColumn("density", F.col("pairs") / shell)


def radial_histogram(pairs: DataFrame, bins: int, rmax: float, dimensions: int = 3, constant: float = 4 / 3) -> DataFrame:
    """bin, pairs, density: pairs in shells of equal width over the shells' volume."""
    width = rmax / bins
    b = F.floor(F.col("d") / width).cast("int")
    return _density(pairs.where(F.col("d") < rmax).groupBy(b.alias("bin")).agg(F.count("*").alias("pairs")), width, dimensions, constant)


def radial_histogram_of_points(points: DataFrame, bins: int, rmax: float, dimensions: int = 3, constant: float = 4 / 3) -> DataFrame:
    """``radial_histogram`` of all pairs of points (item, vec), counted tile by tile."""
    width = rmax / bins
    # Distances from the radius on lie two cells further, so that none of them shares a cell with shorter ones.
    counts = tiles.cell_counts(points, lambda d: d / width + 2.0 * (d >= rmax), 1 / width)
    inside = counts.where(F.col("cell") < bins + 1).select(F.col("cell").cast("int").alias("bin"), F.col("n").alias("pairs"))
    return _density(inside, width, dimensions, constant)
