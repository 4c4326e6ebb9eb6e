"""Tests of features and groups by a model formula: sums of products per feature, solved in batches of features."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.functions.numeric import f_upper_tail
from cohortal.operators.encoding import Formula
from cohortal.operators.enrichment import enrichment
from cohortal.operators.graph import settled
from cohortal.operators.significance import q_values

#: Columns of a formula's design at most; a feature's sums of products are the square of that.
MOST_TERMS = 100


def _blocks(journal: DataFrame, formula: Formula) -> tuple[DataFrame, list[tuple[str, frozenset[str], list[Column]]]]:
    """The journal's rows that know every term, and each term's name, parts and design columns. The intercept is the first term."""
    used = sorted({*formula.categories, *formula.linear, *(p for x in formula.interactions for p in x)})
    rows = journal.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in used], F.lit(True)))
    blocks: list[tuple[str, frozenset[str], list[Column]]] = [("", frozenset(), [F.lit(1.0)])]
    for parts in [*((c,) for c in formula.categories), *formula.interactions]:
        label = F.to_json(F.array(*[F.col(c).cast("string") for c in parts]))
        labels = sorted(r[0] for r in rows.select(label).distinct().limit(MOST_TERMS + 1).collect())
        blocks.append((":".join(parts), frozenset(parts), [(label == x).cast("double") for x in labels]))
    scale = rows.agg(*[f(F.col(c).cast("double")) for c in formula.linear for f in (F.avg, F.stddev_pop)]).first() if formula.linear else ()
    for c, mean, sd in zip(formula.linear, scale[::2], scale[1::2]):
        blocks.append((c, frozenset([c]), [(F.col(c).cast("double") - (mean or 0.0)) / (sd or 1.0)]))
    width = sum(len(b[2]) for b in blocks)
    if width > MOST_TERMS:
        raise ValueError(f"the formula's design has {width} columns, more than {MOST_TERMS}")
    return rows, blocks


def _explained(g: np.ndarray, columns: list[int]) -> tuple[float, int]:
    """Sum of squares that columns of a design explain, and their rank; the last row of ``g`` holds the products with the values."""
    scale = np.sqrt(np.where(np.diag(g)[columns] > 0, np.diag(g)[columns], 1.0))
    values, vectors = np.linalg.eigh(g[np.ix_(columns, columns)] / np.outer(scale, scale))
    kept = values > 1e-10 * max(1.0, values.max(initial=0.0))
    along = vectors[:, kept].T @ (g[-1, columns] / scale)
    return float((along**2 / values[kept]).sum()), int(kept.sum())


def analytes_by_formula(long: DataFrame, journal: DataFrame, formula: Formula, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """feature, term, n, f, d1, d2, p, q: type II analysis of variance of every feature by every term of a formula.

    Samples are those of the journal (a row each) that know every term; a null
    value leaves its sample out for that feature alone. f is null where nothing is
    left over, d1 or d2 is 0 or no sum of squares remains. q is over all features of a term.
    """
    rows, blocks = _blocks(journal, formula)
    columns = [c for b in blocks for c in b[2]]
    design = rows.select(F.col(sample).alias("_s"), F.array(*columns).alias("_x"))
    known = long.where(F.col(value).isNotNull()).select(F.col(feature).alias("feature"), F.col(sample).alias("_s"), F.col(value).cast("double").alias("_y"))
    at = F.transform(F.concat("_x", F.array("_y")), lambda x, k: F.struct(k.alias("k"), x.alias("x")))
    cells = known.join(design, "_s").select("feature", F.filter(at, lambda c: c["x"] != 0).alias("c"))
    cells = cells.withColumn("a", F.explode("c")).withColumn("b", F.explode("c")).where("a.k <= b.k")
    sums = cells.groupBy("feature", F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("s"))
    products = sums.groupBy("feature").agg(F.collect_list(F.struct("i", "j", "s")).alias("g"))  # (MOST_TERMS + 1)^2 at most

    ends = np.cumsum([0, *(len(b[2]) for b in blocks)])
    spans = [list(range(a, b)) for a, b in zip(ends, ends[1:])]
    models = []
    for k, (name, parts, _) in enumerate(blocks[1:], 1):
        others = [c for m, (_, p, _) in enumerate(blocks) if m != k and not parts < p for c in spans[m]]
        models.append((name, others, sorted(others + spans[k])))
    width = len(columns)

    def solve(cells: pd.Series) -> pd.Series:
        out = []
        for row in cells:
            g = np.zeros((width + 1, width + 1))
            for c in row:
                g[c["i"], c["j"]] = g[c["j"], c["i"]] = c["s"]
            whole, rank = _explained(g, list(range(width)))
            n, left, found = int(round(g[0, 0])), g[-1, -1] - whole, []
            for name, without, with_ in models:
                (s0, r0), (s1, r1) = _explained(g, without), _explained(g, with_)
                d1, d2 = r1 - r0, n - rank
                ok = d1 > 0 and d2 > 0 and left > 1e-12 * g[-1, -1]
                found.append({"term": name, "n": n, "f": max(0.0, s1 - s0) / d1 / (left / d2) if ok else None, "d1": float(d1), "d2": float(d2)})
            out.append(found)
        return pd.Series(out)

    solved = F.pandas_udf(solve, "array<struct<term:string,n:long,f:double,d1:double,d2:double>>")
    tested = products.select("feature", F.inline(solved("g"))).withColumn("p", f_upper_tail(F.col("f"), F.col("d1"), F.col("d2")))
    tested = settled(tested)
    ranked = [q_values(tested.where((F.col("term") == name) & F.col("p").isNotNull()), "p", "feature") for name, _, _ in models]
    unknown = tested.where("p IS NULL").withColumn("q", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, ranked, unknown)


def group_components(long: DataFrame, membership: DataFrame, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """gid, sample, value: the first principal component over samples of each group's members (``membership``: gid, member).

    Covariances are over the members that have both samples; the component's largest
    entry is positive. A group with one member that has values is described by those.
    """
    known = long.where(F.col(value).isNotNull()).select(F.col(feature).alias("member"), F.struct(F.col(sample).alias("s"), F.col(value).cast("double").alias("v")).alias("e"))
    vectors = known.groupBy("member").agg(F.sort_array(F.collect_list("e")).alias("e"))  # a sample each
    rows = membership.distinct().join(vectors, "member")
    two = rows.withColumn("a", F.explode("e")).withColumn("b", F.explode("e")).where("a.s <= b.s")
    cov = two.groupBy("gid", F.col("a.s").alias("i"), F.col("b.s").alias("j")).agg(F.covar_samp("a.v", "b.v").alias("c"), F.avg("a.v").alias("m"))
    size = rows.groupBy("gid").agg(F.count("*").alias("members"))
    kind = long.schema[sample].dataType.simpleString()

    def component(pdf: pd.DataFrame) -> pd.DataFrame:
        names, gid = np.unique(pdf["i"]), pdf["gid"].iloc[0]
        if pdf["members"].iloc[0] < 2:
            own = pdf[pdf["i"] == pdf["j"]]
            return pd.DataFrame({"gid": gid, "sample": own["i"], "value": own["m"]})
        c = np.zeros((len(names), len(names)))
        i, j = np.searchsorted(names, pdf["i"]), np.searchsorted(names, pdf["j"])
        c[i, j] = c[j, i] = pdf["c"].fillna(0.0)
        first = np.linalg.eigh(c)[1][:, -1]
        return pd.DataFrame({"gid": gid, "sample": names, "value": first * np.sign(first[np.abs(first).argmax()])})

    id_kind = membership.schema["gid"].dataType.simpleString()
    return cov.join(size, "gid").groupBy("gid").applyInPandas(component, f"gid {id_kind}, sample {kind}, value double")  # samples squared


def groups_by_formula(long: DataFrame, membership: DataFrame, journal: DataFrame, formula: Formula, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """gid, term, n, f, d1, d2, p, q: ``analytes_by_formula`` of each group's first component."""
    scores = group_components(long, membership, feature, sample, value).withColumnRenamed("sample", sample)
    return analytes_by_formula(scores, journal, formula, "gid", sample, "value").withColumnRenamed("feature", "gid")


def group_factor_enrichment(long: DataFrame, membership: DataFrame, journal: DataFrame, formula: Formula, term: str, tolerance: float = 0.05) -> DataFrame:
    """gid, f, p (of the group's component by a term), n, hits, enrichment_p (Fisher's, of members that the term marks below ``tolerance``)."""
    marked = settled(analytes_by_formula(long, journal, formula).where(F.col("term") == term).select(F.col("feature").alias("member"), (F.coalesce("p", F.lit(1.0)) < tolerance).alias("hit")))
    factors = groups_by_formula(long, membership, journal, formula).where(F.col("term") == term).select("gid", "f", "p")
    counted = enrichment(membership, marked).select("gid", "n", "hits", F.col("p").alias("enrichment_p"))
    return factors.join(counted, "gid")
