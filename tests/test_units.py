"""Numbers against closed forms, files against their text, streams against tables."""

import math
import random

import numpy as np
import pytest
from common import DATA
from pyspark.sql import functions as F

from cohortal.functions import numeric as N
from cohortal.operators import algebra as A
from cohortal.operators import clustering as K
from cohortal.operators import encoding as E
from cohortal.operators import graph as G
from cohortal.operators import pairs as P
from cohortal.operators import quality as Q
from cohortal.operators import series as S
from cohortal.sources import files
from cohortal.streaming import windows

D5 = [[0, 9, 3, 6, 11], [9, 0, 7, 5, 10], [3, 7, 0, 9, 2], [6, 5, 9, 0, 8], [11, 10, 2, 8, 0]]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("x", [-4.2, -1.0, -0.1, 0.0, 0.3, 1.5, 3.0, 6.0])
def test_erf(spark, x):
    assert abs(value(spark, N.erf(F.lit(x))) - math.erf(x)) < 1e-13


@pytest.mark.parametrize("x", [0.1, 0.5, 1.0, 2.5, 17.0, 400.0])
def test_log_gamma(spark, x):
    assert abs(value(spark, N.log_gamma(F.lit(x))) - math.lgamma(x)) < 1e-9 * max(1, abs(math.lgamma(x)))


def test_tails(spark):
    assert abs(value(spark, N.t_two_sided(F.lit(2.2281388519649385), F.lit(10.0))) - 0.05) < 1e-9
    assert abs(value(spark, N.f_upper_tail(F.lit(4.102821015), F.lit(2.0), F.lit(10.0))) - 0.05) < 1e-8
    assert abs(value(spark, N.normal_upper_tail(F.lit(1.959963984540054))) - 0.025) < 1e-12
    for z in (-30.0, -7.5, -2.0, 1.9, 2.0, 7.5, 30.0):
        assert math.isclose(value(spark, N.normal_upper_tail(F.lit(z))), 0.5 * math.erfc(z / math.sqrt(2)), rel_tol=1e-11)


@pytest.mark.parametrize("df", [1.0, 5.0, 1e3, 1e4, 1e5, 1e6, 1e7])
@pytest.mark.parametrize("t", [0.001, 0.7, 2.0, 3.0, 9.0])
def test_t_tails_at_any_size(spark, df, t):
    # The density in the angle whose tangent is t over the root of df, by the trapezoid rule where it is not negligible.
    begin = math.atan(t / math.sqrt(df))
    ends = np.linspace(begin, min(math.pi / 2, begin + 40 / math.sqrt(df)) if df > 1000 else math.pi / 2, 2_000_001)
    area = np.trapezoid(np.exp((df - 1) * np.log(np.maximum(np.cos(ends), 1e-300))) if df > 1 else np.ones_like(ends), ends)
    want = 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    assert math.isclose(value(spark, N.t_two_sided(F.lit(t), F.lit(df))), want, rel_tol=1e-6)


def test_fisher(spark):
    def brute(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        p = lambda x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
        return sum(p(x) for x in range(max(0, r + k - n), min(r, k) + 1) if p(x) <= p(a) * (1 + 1e-7))

    def upper(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        return sum(math.comb(k, x) * math.comb(n - k, r - x) for x in range(a, min(r, k) + 1)) / math.comb(n, r)

    for t in ((8, 2, 1, 5), (0, 5, 3, 2), (10, 10, 10, 10), (0, 0, 3, 4), (50, 50, 10, 200), (3, 97, 30, 70), (40, 0, 0, 60), (7, 0, 0, 0), (5, 95, 10, 890), (900, 100, 100, 900)):
        assert math.isclose(value(spark, N.fisher_two_sided(*map(F.lit, t))), brute(*t), rel_tol=1e-8, abs_tol=1e-60)
        assert math.isclose(value(spark, N.hypergeometric_tail(*map(F.lit, t))), upper(*t), rel_tol=1e-8, abs_tol=1e-12)


def distances(spark):
    return spark.createDataFrame([(i, j, float(D5[i][j])) for i in range(5) for j in range(i + 1, 5)], "i long, j long, d double"), spark.range(5).withColumnRenamed("id", "item")


@pytest.mark.parametrize("cutoff,want", [(0, "01234"), (2, "01323"), (3, "20212"), (5, "10101"), (6, "00000")])
def test_components_by_cutoff(spark, cutoff, want):
    pairs, items = distances(spark)
    assert "".join(str(r.cluster) for r in K.connectivity(pairs, items, cutoff).orderBy("item").collect()) == want


def test_large_graphs_take_rounds(spark, monkeypatch):
    rng = random.Random(9)
    links = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(50))) for _ in range(45)]
    df, items = spark.createDataFrame(links, "i long, j long, d double").where("i < j"), spark.range(60).withColumnRenamed("id", "item")
    small = sorted(G.components(df, items).collect()), sorted(r.d for r in K.spanning_tree(df, items).collect())
    monkeypatch.setattr(G, "SMALL_GRAPH", -1)
    assert (sorted(G.components(df, items).collect()), sorted(r.d for r in K.spanning_tree(df, items).collect())) == small


def test_hierarchy(spark):
    pairs, items = distances(spark)
    rows = K.hierarchy_levels(K.spanning_tree(pairs, items), 5).orderBy("level").collect()
    assert [(r.cutoff, round(r.mean_size, 3)) for r in rows] == [(2, 1.25), (3, 1.667), (5, 2.5), (6, 5.0)]
    assert K.clustering_bounds(pairs).first() == (2.0, 9.0)


def test_auc_of_a_histogram(spark):
    bins = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip([33, 6, 6, 11, 2], [3, 2, 2, 11, 33]))], "bin int, n_in long, n_out long")
    r = Q.histogram_auc(bins).first()
    assert round(r.auc, 6) == 0.893171 and round(r.se, 6) == 0.03199


def test_rolling(spark):
    v = [1.9, 1.8, 2.1, 1.1, 8.0, 1.2, 2.2, 3.5, 2.0, 2.0, 3.1, 2.1, 2.9]
    rows = S.rolling_average(spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "series_id string, pos long, value double"), 4).orderBy("pos").collect()
    for i, r in enumerate(rows):
        part = [v[k] for k in range(max(0, i - 2), min(len(v) - 1, i + 2))]
        assert abs(r.rolling - sum(part) / len(part)) < 1e-12


def test_closure_of_random_graphs(spark):
    rng = random.Random(1)
    edges = {(f"n{a}", f"n{b}") for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.2}
    want, todo = set(edges), list(edges)
    while todo:
        a, b = todo.pop()
        for c, d in edges:
            if c == b and (a, d) not in want:
                want.add((a, d))
                todo.append((a, d))
    df = spark.createDataFrame(sorted(edges), "parent string, child string")
    assert {(r.ancestor, r.descendant) for r in G.closure(df).collect()} == want
    table = {r.id: r for r in G.lineage_table(df).collect()}
    assert all(set(r.ancestors) == {a for a, d in want if d == i} and r.level == len(r.ancestors) for i, r in table.items())


def test_formula():
    f = E.Formula.parse("S ~ C(industry) : C(block) + C(industry) + age")
    assert (f.categories, f.interactions, f.linear) == (("industry",), (("industry", "block"),), ("age",))


def test_algebra(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    y = A.coordinates_from_distances(d, 3)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), d)
    m = np.array([[4, 1, -2, 2], [1, 2, 0, 1], [-2, 0, 3, -2], [2, 1, -2, -1]], float)
    t, q = A.householder(m)
    assert np.allclose(np.linalg.eigvalsh(m), np.linalg.eigvalsh(t)) and np.allclose(q @ t @ q.T, m) and np.allclose(np.tril(t, -2), 0)
    r = A.rotation_matrix([1, 2, 3], 0.7)
    assert np.allclose(r @ r.T, np.eye(3)) and A.rigid_superposition(x, x @ r.T + 1)[2] < 1e-9
    assert np.allclose(np.cov(A.whitened(x).T), np.eye(3)) and np.allclose(A.pseudo_inverse(x), np.linalg.pinv(x))
    long = spark.createDataFrame([(i, f"c{j}", float(x[i, j])) for i in range(40) for j in range(3)], "r long, c string, v double")
    scores, loadings, share = A.principal_components(long, "r", "c", "v", 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(share, s**2 / (s**2).sum()) and np.allclose(np.abs(loadings), np.abs(vt.T))
    assert np.isclose(scores.agg(F.sum(F.col("score") ** 2)).first()[0], (s**2).sum())


def test_grouped_models(spark):
    df = spark.createDataFrame([("a", i, math.sin(i / 5)) for i in range(300)], "series_id string, pos long, value double")
    out = A.reservoir_forecast(df, "series_id", "pos", "value", 200).join(df, ["series_id", "pos"]).where("pos > 220")
    assert out.agg(F.avg(F.abs(F.col("forecast") - F.col("value")))).first()[0] < 0.05
    top = A.spectra(df).where("k < 150").orderBy(F.desc("power")).first()
    assert top.k in (9, 10)
    field = spark.createDataFrame([(1, x, y, float(x == 4 and y == 4)) for x in range(9) for y in range(9)], "image int, x int, y int, v double")
    smooth = A.gaussian_field(field, "image", 1.0)
    assert abs(smooth.agg(F.sum("v")).first()[0] - 1) < 1e-9 and smooth.orderBy(F.desc("v")).first()[1:3] == (4, 4)
    curve = A.bezier(spark.createDataFrame([("c", 0, 0.0, 0.0), ("c", 1, 1.0, 2.0), ("c", 2, 2.0, 0.0)], "curve string, pos long, x double, y double"), 4)
    assert [(round(r.x, 9), round(r.y, 9)) for r in curve.orderBy("t").collect()] == [(0.0, 0.0), (0.5, 0.75), (1.0, 1.0), (1.5, 0.75), (2.0, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "g.gmt").write_text("# note\ng1\tfirst\ta\tb\ta\n\ng2\t\tc\n")
    groups = files.read_gmt(spark, str(tmp_path / "g.gmt"))
    assert sorted((r.gid, r.description, r.members) for r in groups.collect()) == [("g1", "first", ["a", "b"]), ("g2", "", ["c"])]
    files.write_gmt(groups, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["g1\tfirst\ta\tb", "g2\t\tc"]
    (tmp_path / "p.xyz").write_text("2\ncomment line of five words\nAr 0.5 1 -2\nAr 1e1 0 0\nbad 1\n")
    assert sorted((r.symbol, r.x, r.y, r.z) for r in files.read_xyz(spark, str(tmp_path / "p.xyz")).collect()) == [("Ar", 0.5, 1.0, -2.0), ("Ar", 10.0, 0.0, 0.0)]
    (tmp_path / "e.txt").write_text("X1\tX2\nX2\tY3\n")
    assert files.read_edges(spark, str(tmp_path / "e.txt"), "X").collect() == [("X1", "X2")]
    (tmp_path / "c.txt").write_text("id\tsym\nE1\tA\nE2\tA\nE3\tB\n")
    conv = files.read_conversions(spark, str(tmp_path / "c.txt"))
    assert {r.symbol: (r.id, r.dropped) for r in files.unique_synonyms(conv).collect()} == {"A": ("E1", 1), "B": ("E3", 0)}
    assert {r.symbol: r.ids for r in files.synonyms(conv).collect()} == {"A": ["E1", "E2"], "B": ["E3"]}
    (tmp_path / "m.tsv").write_text("\ts1\ts2\nf1\t1.5\tnan\nf2\t\t3\n")
    got = sorted((r.feature, r.sample, r.value) for r in files.read_matrix(spark, str(tmp_path / "m.tsv")).where("value IS NOT NULL").collect())
    assert got == [("f1", "s1", 1.5), ("f2", "s2", 3.0)]
    j = spark.createDataFrame([("s1", "Age [y]", "34_years"), ("s2", "Age [y]", "ND"), ("s1", "label A", "True"), ("s1", "other", "x")], "sample string, key string, sval string")
    assert sorted((r.key, r.sample, r.nval) for r in files.pruned_journal(j).collect() if r.nval is not None) == [("Age [y]", "s1", 34.0), ("label A", "s1", 1.0)]
    assert value(spark, files.compartments(F.lit("a [x] b [y z]"))) == ["x", "y z"]


def test_seeded_kmeans(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(3, 0.1, (20, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vec array<double>")
    got = {r.item: r.cluster for r in K.seeded_kmeans(df, [[0.5, 0.5], [2.0, 2.0], [99.0, 99.0]]).collect()}
    assert all(got[i] == (i >= 20) for i in range(40))


def test_synonym_of_distances(spark):
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, vec array<double>")
    assert P.pair_distances(pts).collect() == [(1, 2, 5.0)]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = windows.windowed(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    shown = lambda df: sorted((r.series_id, str(r.start), r.n, round(r.value, 4)) for r in df.collect())
    assert shown(spark.table("w")) == shown(windows.windowed(events))
    assert windows.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_complete_linkage(spark):
    pairs, items = distances(spark)
    rows = K.complete_linkage(pairs).orderBy("step").collect()
    assert [(r.members, r.height) for r in rows] == [([2, 4], 2.0), ([1, 3], 5.0), ([0, 1, 3], 9.0), ([0, 1, 2, 3, 4], 11.0)]
    assert K.shared_neighbour_hierarchy(pairs, items)[-1][1] == 1


def test_density_seeds_and_search(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.05, (50, 2)), rng.normal(1, 0.05, (50, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vec array<double>")
    seeds = np.array(K.density_seeds(df, 3))
    assert len(seeds) == 2 and np.allclose(seeds.mean(1), [0, 1], atol=0.1)
    assert abs(K.golden_search(lambda v: (v - 0.3) ** 2, 0, 1) - 0.3) < 1e-5


def test_inventory(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("ENSG1\tp1\tone [cell]\nENSG2\tp1\tone [cell]\nX3\tp1\tone\nENSG1\tp2\ttwo\n")
    g = files.read_inventory(spark, str(tmp_path / "i.tsv"), 0, 1, 2, "ENSG")
    assert {r.gid: r.members for r in g.collect()} == {"p1": ["ENSG1", "ENSG2"], "p2": ["ENSG1"]}
    names = spark.createDataFrame([("ENSG1", "A")], "member string, name string")
    assert {r.gid: r.members for r in files.remapped(g, names).collect()} == {"p1": ["A", "ENSG2"], "p2": ["A"]}


def test_nothing_stops_silently(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(4)], "k long, label string")
    assert len(E.one_hot_wide(df, "k", "label").columns) == 5
    monkeypatch.setattr(E, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError, match="more than 3 labels"):
        E.one_hot_wide(df, "k", "label")
    points = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "item long, vec array<double>")
    with pytest.raises(ValueError, match="still changes"):
        K.seeded_kmeans(points, [[0.0], [1.0]], rounds=1)


def test_window_means_do_not_depend_on_order(spark):
    rows = [("a", 1e8), ("a", 0.01), ("a", -1e8), ("b", 1e300), ("b", 1e300), ("c", None), ("d", float("nan")), ("d", 1.0)]
    events = spark.createDataFrame(rows, "event_type string, value double").withColumn("ts", F.lit("2024-01-01 01:00:00"))
    got = {r.series_id: (r.n, r.value) for r in windows.windowed(events.coalesce(1)).collect()}
    assert got["a"] == (3, 0.01 / 3) and got["b"] == (2, 1e300) and got["c"] == (1, None)
    assert got["d"][0] == 2 and got["d"][1] != got["d"][1]
