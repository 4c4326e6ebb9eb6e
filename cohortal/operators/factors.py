"""Partial least squares of features on a formula's terms, and how features and samples lie to the terms.

The regression works in the products of samples (LIMIT of them at most), so that no
task holds a matrix of features; a feature's weights are one sum over its samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators.algebra import LIMIT, gram
from cohortal.operators.graph import settled
from cohortal.operators.order import with_totals
from cohortal.operators.significance import normal_p_values, value_at_percentile


def _scaled(long: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """Values of each feature less their mean over their deviation (n - 1; 1 where that is 0). Null values count as the mean."""
    known = long.where(F.col(value).isNotNull()).select(feature, sample, F.col(value).cast("double").alias("_v"))
    scale = known.groupBy(feature).agg(F.avg("_v").alias("_mean"), F.stddev_samp("_v").alias("_sd"))
    deviation = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return known.join(scale, feature).select(feature, sample, ((F.col("_v") - F.col("_mean")) / deviation).alias("_x"))


def partial_least_squares(long: DataFrame, design: DataFrame, feature: str = "feature", sample: str = "sample", value: str = "value", components: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights of features (feature, x, y, ...), of terms (term, ...) and scores of samples (sample, ...), one column a component.

    ``design``: sample, term, x, one row an entry; absent entries are 0. Both sides are
    centred and scaled. Components are the directions of largest covariance, taken one after
    the other; what the scores explain is taken off both sides. A component's largest feature weight is positive. Components
    beyond what the tables hold are 0. Every feature is taken to be measured in the same samples.
    """
    names = [f"c{k}" for k in range(components)]
    cells = settled(_scaled(long, feature, sample, value))
    samples, k = gram(cells, feature, sample, "_x")
    rows = design.groupBy("sample", "term").agg(F.sum(F.col("x").cast("double")).alias("x")).limit(LIMIT * LIMIT + 1).collect()
    terms = sorted({r["term"] for r in rows})
    if len(terms) > LIMIT or len(rows) > LIMIT * LIMIT:
        raise ValueError(f"more than {LIMIT} terms or samples")
    at, y = {s: n for n, s in enumerate(samples)}, np.zeros((len(samples), len(terms)))
    for r in rows:
        if r["sample"] in at:
            y[at[r["sample"]], terms.index(r["term"])] = r["x"]
    sd = y.std(0, ddof=1) if len(samples) > 1 else np.ones(len(terms))
    y = (y - y.mean(0)) / np.where(sd > 0, sd, 1.0) if len(samples) else y
    left, by_sample, by_term, scores = np.eye(len(samples)), np.zeros((len(samples), components)), np.zeros((len(terms), components)), np.zeros((len(samples), components))
    for c in range(components):
        strength, vectors = np.linalg.eigh(y.T @ k @ y) if len(terms) else (np.zeros(1), None)
        if not len(samples) or strength[-1] <= 1e-10:
            break
        u = y @ vectors[:, -1]
        length = np.sqrt(u @ k @ u)
        t = k @ u / length
        by_sample[:, c], by_term[:, c], scores[:, c] = left @ u / length, y.T @ t / (t @ t), t
        off = np.eye(len(samples)) - np.outer(t, t) / (t @ t)
        k, y, left = off @ k @ off, off @ y, left @ off
    spark = long.sparkSession
    kind = long.schema[sample].dataType.simpleString()
    table = lambda name, kind, keys, m: spark.createDataFrame([(key, *map(float, row)) for key, row in zip(keys, m)], ", ".join([f"{name} {kind}", *[f"{n} double" for n in names]]))
    weights = settled(cells.join(F.broadcast(table(sample, kind, samples, by_sample)), sample).groupBy(feature).agg(*[F.sum(F.col("_x") * F.col(n)).alias(n) for n in names]))  # LIMIT rows are sent
    sign = weights.agg(*[F.max_by(F.signum(n), F.abs(n)).alias(n) for n in names]).first()
    turn = [-1.0 if sign[n] is not None and sign[n] < 0 else 1.0 for n in names]
    turned = weights.withColumns({n: F.col(n) * s for n, s in zip(names, turn)})
    return turned, table("term", "string", terms, by_term * turn), table(sample, kind, samples, scores * turn)


def owners(points: DataFrame, centroids: list[tuple[str, list[float]]], by: str = "distance") -> DataFrame:
    """Adds ``owner``: the nearest centroid, by ``distance`` or ``angle``; of equally near ones the first. ``points``: columns c0, c1, ..."""
    axes = [f"c{k}" for k in range(len(centroids[0][1]))]

    def apart(c: list[float]):
        if by == "angle":
            dot, size = sum(F.col(a) * x for a, x in zip(axes, c)), F.sqrt(sum(F.col(a) * F.col(a) for a in axes))
            return 1 - dot / F.nullif(size * float(np.linalg.norm(c)), F.lit(0.0))
        return sum((F.col(a) - x) * (F.col(a) - x) for a, x in zip(axes, c))

    far = F.lit(float("inf"))
    nearest = F.array_min(F.array(*[F.struct(F.coalesce(apart(c), far).alias("d"), F.lit(n).alias("n"), F.lit(name).alias("name")) for n, (name, c) in enumerate(centroids)]))
    return points.withColumn("owner", nearest["name"])


def alignment(weights: DataFrame, terms: DataFrame, scores: DataFrame, feature: str = "feature", cutoff: float = 99.8, by: str = "distance", axes: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How features and samples lie to terms in a plane of two components: features, projections, samples.

    Features: c0, c1, owner, and p and fractional rank of the radius (``corr_p``, ``corr_r``) and of the size along each
    axis (``corr0_*``, ``corr1_*``), all over the largest size along an axis; ``alpha`` is 0.51 outside the radius at percentile ``cutoff``, else 0.01.
    Projections: feature, term, r (the size of the projection on the term's direction, or on the
    difference of two terms in ``axes``), p, rho. Samples: c0, c1, owner, alpha 0.2.
    """
    centroids = [(r["term"], [r["c0"], r["c1"]]) for r in terms.orderBy("term").limit(LIMIT + 1).collect()]
    if len(centroids) > LIMIT:
        raise ValueError(f"more than {LIMIT} terms")
    at = dict(centroids)
    directions = centroids + [(f"{a}-{b}", [x - y for x, y in zip(at[a], at[b])]) for a, b in axes]
    unit = with_totals(owners(weights.select(feature, "c0", "c1"), centroids, by), _x=F.max(F.abs("c0")), _y=F.max(F.abs("c1")))
    one, two = F.col("c0") / F.nullif(F.col("_x"), F.lit(0.0)), F.col("c1") / F.nullif(F.col("_y"), F.lit(0.0))
    out = settled(unit.withColumns({"_u0": F.coalesce(F.abs(one), F.lit(0.0)), "_u1": F.coalesce(F.abs(two), F.lit(0.0))}).withColumn("_r0", F.sqrt(F.col("_u0") * F.col("_u0") + F.col("_u1") * F.col("_u1"))))
    ahead = value_at_percentile(out, "_r0", feature, cutoff).withColumnRenamed("value", "_edge")
    found = out
    for name, value in (("corr", "_r0"), ("corr0", "_u0"), ("corr1", "_u1")):
        found = normal_p_values(found, value).withColumnsRenamed({"p": f"{name}_p", "r": f"{name}_r"})
    alpha = F.when(F.col("_r0") > F.col("_edge"), 0.51).otherwise(0.01)
    features = found.crossJoin(F.broadcast(ahead)).withColumn("alpha", alpha)  # one row
    features = features.select(feature, "c0", "c1", "owner", "corr_p", "corr_r", "corr0_p", "corr0_r", "corr1_p", "corr1_r", "alpha")

    size = out.agg(F.max("_x"), F.max("_y")).first()
    lengths = [s if s else 1.0 for s in size]
    projections = None
    for name, c in directions:
        along = np.array(c) / lengths
        norm = float(np.linalg.norm(along)) or 1.0
        r = F.abs(F.col("c0") / lengths[0] * float(along[0]) + F.col("c1") / lengths[1] * float(along[1])) / norm
        one_term = normal_p_values(out.select(feature, F.lit(name).alias("term"), r.alias("size")), "size").withColumnsRenamed({"r": "rho", "size": "r"})
        projections = one_term if projections is None else projections.unionByName(one_term)
    samples = owners(scores, centroids, by).withColumn("alpha", F.lit(0.2))
    return features, projections, samples
