"""Formulas, linkages and order-dependent clusters against plain versions of themselves."""

import itertools

import numpy as np
import pytest
from common import DATA
from pyspark.sql import functions as F

from cohortal.functions import numeric as N
from cohortal.operators import clustering as K
from cohortal.operators import formula as M
from cohortal.operators import graph as A
from cohortal.operators.encoding import Formula
from cohortal.plans import models


def residual(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ b) ** 2).sum()), int(np.linalg.matrix_rank(x))


def hot(labels):
    return np.array([[float(x == k) for k in sorted(set(labels))] for x in labels])


def anova(y, terms):
    """term: (f, d1, d2); ``terms``: name, parts, columns."""
    one = np.ones((len(y), 1))
    rss, rank = residual(np.hstack([one, *[c for _, _, c in terms]]), y)
    out = {}
    for name, parts, columns in terms:
        rest = [c for n, p, c in terms if n != name and not set(parts) < set(p)]
        (r0, k0), (r1, k1) = residual(np.hstack([one, *rest]), y), residual(np.hstack([one, *rest, columns]), y)
        out[name] = ((r0 - r1) / (k1 - k0) / (rss / (len(y) - rank)) if k1 > k0 else None, k1 - k0, len(y) - rank)
    return out


def test_formula_with_interaction_and_missing_values(spark):
    rng = np.random.default_rng(3)
    samples = [(s, "ab"[s % 2], "xyz"[s % 3], float(rng.normal(50, 3))) for s in range(36)] + [(99, None, "x", 1.0)]
    journal = spark.createDataFrame(samples, "sample long, a string, b string, w double")
    rows = [(f"f{k}", s, float(rng.normal(1000, 5) + k * (a == "a") * (b == "x")) if (s + k) % 11 else None) for k in range(5) for s, a, b, _ in samples]
    rows += [("flat", s, 7.0) for s, *_ in samples] + [("single", 1, 2.0)]
    long = spark.createDataFrame(rows, "feature string, sample long, value double")
    out = {(r.feature, r.term): r for r in M.analytes_by_formula(long, journal, Formula.parse("value ~ C(a) + C(b) + C(a):C(b) + w")).collect()}
    assert len(out) == 7 * 4
    for k in range(5):
        known = [(x, y) for x in samples for f, s, y in rows if f == f"f{k}" and s == x[0] and y is not None and x[1]]
        a, b, w = ([x[i] for x, _ in known] for i in (1, 2, 3))
        terms = [("a", "a", hot(a)), ("b", "b", hot(b)), ("a:b", "ab", hot([p + q for p, q in zip(a, b)])), ("w", "w", np.array(w)[:, None])]
        for name, (f, d1, d2) in anova(np.array([y for _, y in known]), terms).items():
            r = out[f"f{k}", name]
            assert (r.n, r.d1, r.d2) == (len(known), d1, d2) and np.isclose(r.f, f, rtol=1e-5) and 0 <= r.p <= r.q <= 1
    assert all(out[f, t].p is None and out[f, t].q is None for f in ("flat", "single") for t in ("a", "b", "a:b", "w"))
    empty = M.analytes_by_formula(long.limit(0), journal, Formula.parse("y ~ C(a)"))
    assert empty.columns == ["feature", "term", "n", "f", "d1", "d2", "p", "q"] and empty.isEmpty()


def test_groups_are_tested_by_their_first_component(spark):
    long, groups, journal = (f(spark, DATA) for f in (models.scaled, models.brand_groups, models.nation_journal))
    pdf = long.toPandas().pivot(index="feature", columns="sample", values="value")
    note = journal.toPandas().set_index("sample").loc[pdf.columns]
    found = {(r.gid, r.term): r for r in M.groups_by_formula(long, groups, journal, models.FORMULA).collect()}
    members = groups.toPandas().groupby("gid")["member"].apply(list)
    assert len(found) == 2 * len(members)
    for gid, names in members.items():
        x = pdf.loc[[n for n in names if n in pdf.index]].to_numpy()
        y = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0] if len(x) > 1 else x[0]
        for term, (f, d1, d2) in anova(y, [("region", "region", hot(list(note["region"]))), ("customers", "customers", note[["customers"]].to_numpy())]).items():
            r = found[gid, term]
            assert (r.d1, r.d2) == (d1, d2) and np.isclose(r.f, f, rtol=1e-5), (gid, term, r.f, f)
    both = {r.gid: r for r in models.group_factor_enrichment(spark, DATA).collect()}
    assert set(both) == set(members.index) and all(np.isclose(both[g].f, found[g, "customers"].f, atol=1e-5) for g in both)


def plain_linkage(x, method):
    groups, out = [[k] for k in range(len(x))], []
    apart = lambda p, q: np.sqrt(((x[p][:, None] - x[q][None]) ** 2).sum(-1))
    far = {
        "min": lambda p, q: apart(p, q).min(), "max": lambda p, q: apart(p, q).max(), "mean": lambda p, q: apart(p, q).mean(),
        "ward": lambda p, q: np.sqrt(2 * len(p) * len(q) / (len(p) + len(q)) * ((x[p].mean(0) - x[q].mean(0)) ** 2).sum()),
    }[method]
    while len(groups) > 1:
        h, a, b = min((far(p, q), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(groups), 2))
        out.append((sorted(groups[a] + groups[b]), h))
        groups[a] += groups.pop(b)
    return out


@pytest.mark.parametrize("method", K.LINKAGES)
def test_linkages(spark, method):
    x = np.random.default_rng(5).normal(size=(30, 3))
    pairs = spark.createDataFrame([(i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(30) for j in range(i + 1, 30)], "i long, j long, d double")
    ours = K.stepwise_linkage(pairs, method).orderBy("step").collect()
    for r, (members, height) in zip(ours, plain_linkage(x, method), strict=True):
        assert r.members == members and np.isclose(r.height, height)
    with pytest.raises(ValueError):
        K.stepwise_linkage(pairs, "nearest")


@pytest.mark.parametrize("shared", [1, 2, 3])
def test_connectedness_and_border_points(spark, shared):
    x = np.random.default_rng(7).uniform(size=(80, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(80) for j in range(i + 1, 80)], "i long, j long, d double")
    items = spark.createDataFrame([(i,) for i in range(80)], "item long")
    clusters = []
    for row in d:
        ids = set(np.flatnonzero(row <= 0.12).tolist())
        home = next((c for c in clusters if len(c & ids) >= shared), None)
        if home is not None:
            home |= ids
        elif len(ids) >= shared:
            clusters.append(ids)
    ours = {}
    for r in K.connectedness(pairs, items, 0.12, shared).collect():
        ours.setdefault(r.cluster, set()).add(r.item)
    assert [ours[k] for k in sorted(ours)] == clusters

    least, label = shared + 2, np.full(80, -1)
    core, k = (d <= 0.12).sum(1) >= least, 0
    for start in range(80):  # each cluster is grown from its least core
        if core[start] and label[start] < 0:
            todo = [start]
            while todo:
                at = todo.pop()
                if label[at] < 0:
                    label[at] = k
                    todo += np.flatnonzero(d[at] <= 0.12).tolist() if core[at] else []
            k += 1
    assert {r.item: r.cluster for r in K.dbscan_with_border(pairs, items, 0.12, least).collect()} == dict(enumerate(label.tolist()))


def test_small_functions(spark):
    x = spark.createDataFrame([(None,), (0,), (1,), (2,), (10,), (92,), (93,)], "n long")
    assert [r[0] for r in x.select(N.fibonacci(F.col("n"))).collect()] == [None, None, 1, 1, 55, 7540113804746346429, None]
    assert abs(x.select(N.overlap_excess(F.lit(2.0), F.lit(8.0), 3)).first()[0] - 2.45) < 1e-12
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), (None, "a")], "parent string, child string")
    assert sorted(map(tuple, A.adjacency(edges, ("descendants",)).collect())) == [("a", "b", 1), ("b", "c", 1)]
    assert A.adjacency(edges).count() == 4
