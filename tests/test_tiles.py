"""What is worked out of all pairs tile by tile is that of brute force, and what it moves grows with the points, not the pairs."""

import itertools
import math

import numpy as np
import pytest

from cohortal import catalog
from cohortal.operators import clustering as K
from cohortal.operators import pairs as P
from cohortal.operators import quality as Q
from cohortal.operators import tiles as T


def embeddings(spark, path, n, coarse):
    rng = np.random.default_rng(n)
    x = np.zeros((n, 64))
    if coarse:  # few distinct distances
        x[np.arange(n)[:, None], rng.random((n, 64)).argsort(1)[:, :8]] = 0.5
    else:
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(k, v.tolist(), int(b)) for k, (v, b) in enumerate(zip(x, rng.integers(0, 10, n)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/{coarse}/{n}/embeddings.parquet")


@pytest.fixture(scope="module")
def sizes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("points")
    for n, coarse in itertools.product((1500, 6000), (False, True)):
        embeddings(spark, path, n, coarse)
    return path


#: Run over coarse tables, as a row a distance is moved, of which there are few there, or one a near pair or core, of which there are hardly any.
COARSE = {"segment_auc", "auc_distances", "auc_trapezoid", "label_distance_test", "rank_histogram", "uncursed", "connectedness", "dbscan", "dbscan_border"}
GROWING = [
    "segment_auc",
    "auc_distances",
    "average_linkage",
    "complete_linkage",
    "auc_trapezoid",
    "connectedness",
    "dbscan",
    "dbscan_border",
    "dunn",
    "happiness",
    "knn_probability",
    "label_distance_test",
    "nn_graph",
    "pair_distance",
    "rank_histogram",
    "rdf_hist",
    "clustering_bounds",
    "compactness",
    "components",
    "hierarchy_levels",
    "immersiveness",
    "linkage_levels",
    "single_linkage",
    "uncursed",
]


@pytest.mark.parametrize("name", GROWING)
def test_shuffles_grow_with_points(spark, sizes, name):
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    moved = []
    for n in (1500, 6000):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = shuffled()
        catalog.queries()[name](spark, f"{sizes}/{name in COARSE}/{n}").write.format("noop").mode("overwrite").save()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved.append(shuffled() - before)
    assert moved[1] < 6 * moved[0], moved


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "PAIRS", 64)


def table(spark, x, labels=None):
    labels = [0] * len(x) if labels is None else labels
    return spark.createDataFrame([(k, v, b) for k, (v, b) in enumerate(zip(x, labels))], "item long, vec array<double>, label long")


def distances(x):
    return {(i, j): math.dist(x[i], x[j]) if x[i] and x[j] else None for i, j in itertools.combinations(range(len(x)), 2)}


def test_auc_of_many_pairs(spark):
    bins = spark.createDataFrame([(0, 3_000_000_000, 2_000_000_000), (1, 1_000_000_000, 4_000_000_000)], "bin int, n_in long, n_out long")
    r = Q.histogram_auc(bins).first()
    assert math.isclose(r.auc, (3 * 4 + 0.5 * (3 * 2 + 1 * 4)) / (4 * 6)) and 0 < r.se < 1e-4


@pytest.mark.parametrize("dense", [8, 1 << 22])
def test_counts_of_distances_far_apart(dense, monkeypatch):
    made = T._Counts()
    monkeypatch.setattr(T, "DENSE", dense)
    rng = np.random.default_rng(2)
    every = [(np.array([0, 0, 268_000_000 + k % 3, 5 + k, 1 << 50]), rng.integers(0, 3, 5)) for k in range(20)] + [(rng.integers(268_000_000, 268_000_020, 50), rng.integers(0, 3, 50))]
    got = {}
    for batch in [b for cell, kind in every for b in made.add(cell, kind)] + list(made.rows()):
        for cell, *n in zip(*(c.to_pylist() for c in batch.columns)):
            got[cell] = [x + y for x, y in zip(got.get(cell, [0, 0, 0]), n)]
    want = {}
    for cell, kind in ((c, k) for block in every for c, k in zip(*(x.tolist() for x in block))):
        n = want.setdefault(cell, [0, 0, 0])
        n[2] += 1
        if kind < 2:
            n[kind] += 1
    assert got == want


@pytest.mark.parametrize("bins", [3, 20])
def test_filled_bins_with_ties(spark, small_tiles, bins):
    rng = np.random.default_rng(3)
    x = [v.tolist() for v in rng.integers(0, 2, (40, 3)).astype(float)] + [None, [0.1, 0.2, 0.3]]
    labels = [*rng.integers(0, 3, 41).tolist(), None]
    far = distances(x)
    order = sorted(far, key=lambda p: (far[p] is None, far[p] or 0.0, p))
    want = {}
    for r, (i, j) in enumerate(order):
        n = want.setdefault(r * bins // len(order), [0, 0])
        if None not in (labels[i], labels[j]):
            n[labels[i] != labels[j]] += 1
    got = {r.bin: [r.n_in, r.n_out] for r in Q.filled_histogram(table(spark, x, labels), bins).collect()}
    assert got == want


@pytest.mark.parametrize("method", K.LINKAGES)
def test_linkage_of_points(spark, method):
    x = [v.tolist() for v in np.random.default_rng(6).integers(0, 4, (30, 2)).astype(float)] + [[9.0, 9.5]]  # with ties
    points = table(spark, x)
    pairs = spark.createDataFrame([(i, j, d) for (i, j), d in distances(x).items()], "i long, j long, d double")
    one, other = (sorted(df.collect()) for df in (K.linkage_of_points(points, method), K.stepwise_linkage(pairs, method)))
    assert one == other and len(one) == 30 and one[-1].members == list(range(31))
    d = np.full((31, 31), np.inf)
    for (i, j), far in distances(x).items():
        d[i, j] = d[j, i] = far
    groups, n = {k: [k] for k in range(31)}, np.ones(31)
    for r in one if method in ("min", "max") else ():
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        groups[a] = sorted(groups[a] + groups.pop(b))
        assert (r.members, r.height) == (groups[a], d[a, b])
        d[a] = d[:, a] = (np.minimum if method == "min" else np.maximum)(d[a], d[b])
        d[b] = d[:, b] = d[a, a] = np.inf


def test_nearest_and_bounds(spark, small_tiles):
    rng = np.random.default_rng(4)
    x = [v.tolist() for v in rng.integers(0, 3, (30, 9)).astype(float)] + [None]
    far = distances(x)
    both = far | {(j, i): d for (i, j), d in far.items()}
    want = set()
    for i in range(31):
        mine = sorted((math.inf if both[i, j] is None else both[i, j]) for j in range(31) if j != i)
        want |= {(i, j) for j in range(31) if j != i and (math.inf if both[i, j] is None else both[i, j]) <= mine[4]}
    points = table(spark, x)
    assert {(r.i, r.j) for r in K.nearest_of_points(points, 5).collect()} == want
    known = {p: d for p, d in both.items() if d is not None}
    r = K.clustering_bounds_of_points(points).first()
    assert r.nearest == min(known.values()) and r.full == min(max(d for (i, _), d in known.items() if i == k) for k in range(30))


def test_ranked_bins_with_ties(spark, small_tiles):
    rng = np.random.default_rng(7)
    x = [v.tolist() for v in rng.integers(0, 2, (50, 9)).astype(float)]
    labels = rng.integers(0, 3, 50).tolist()
    points = table(spark, x, labels)
    both = P.both_ways(P.pair_distances(points, "item", "vec"))
    one, other = ({r["item"]: (r["auc"], r["se"]) for r in df.collect()} for df in (Q.immersiveness_of_points(points), Q.immersiveness(both, points.select("item", "label"))))
    assert one.keys() == other.keys() and all(math.isclose(a, b, rel_tol=1e-12) for k in one for a, b in zip(one[k], other[k]))


def test_spanning_tree_with_copies(spark, small_tiles):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 10)) * 100 + 300, 3)
    x = [v.tolist() for v in np.concatenate([x, x[:10], x[:5] + 4e-6])]  # copies, and points hardly apart
    heights, joined = [], {k: {k} for k in range(len(x))}
    for (i, j), d in sorted(distances(x).items(), key=lambda p: p[1]):
        if joined[i] is not joined[j]:
            joined[i] |= joined[j]
            heights.append(d)
            for k in joined[j]:
                joined[k] = joined[i]
    got = sorted(r.d for r in K.spanning_tree_of_points(table(spark, x)).collect())
    assert np.allclose(got, heights, rtol=0, atol=6e-7) and len(got) == len(x) - 1


def test_curve_is_followed_once_a_cell(spark):
    plan = catalog.queries()["hilbert_parts"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "aggregate(" not in plan.split("Join")[0]
