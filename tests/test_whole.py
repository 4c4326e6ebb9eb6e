"""Queries take whole tables: their rows are those of the SQL without its cut, or of brute force."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from common import DATA

from cohortal import catalog
from cohortal.operators import pairs as P


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def same_rows(spark, duck, name, *cuts):
    sql = catalog.oracle_sql()[name]
    for a, b in cuts:
        sql = sql.replace(a, b)
    df = catalog.queries()[name](spark, DATA)
    shown = lambda x: round(float(x), 4) if isinstance(x, (int, float)) else x
    columns = sorted(df.columns)
    ours = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(map(shown, r)) for r in duck.sql(sql).select(*columns).fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for x, y in zip(ours, theirs):
        assert all(a == b or abs(a - b) <= 2e-4 * max(1, abs(a)) for a, b in zip(x, y)), (x, y)


OF_POINTS = ["pair_distance", "clustering_bounds", "components", "dbscan", "nn_graph", "knn_probability", "compactness", "dunn", "auc_distances", "happiness", "rdf_hist", "centroid_owner", "uncursed"]


@pytest.mark.parametrize("name", OF_POINTS)
def test_all_embeddings(spark, duck, name):
    same_rows(spark, duck, name, (" WHERE vec_id < 400", ""))


def test_linkages_of_all_embeddings(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    # Prim's tree has the same merge heights as any other least tree.
    near, heights = d[0].copy(), []
    near[0] = np.nan
    for _ in range(len(x) - 1):
        k = int(np.nanargmin(near))
        heights.append(near[k])
        near = np.where(np.isnan(near), np.nan, np.minimum(near, d[k]))
        near[k] = np.nan
    run = lambda name: catalog.queries()[name](spark, DATA).collect()
    single = np.repeat(*zip(*sorted((r.height, r.merges) for r in run("single_linkage"))))
    assert np.allclose(single, np.sort(heights), atol=2e-6)
    assert max(r.level for r in run("hierarchy_levels")) == len(set(single)) and min(r.clusters for r in run("hierarchy_levels")) == 1
    assert sum(r["items"] for r in run("linkage_levels")) == len(x)
    groups, want = {k: [i] for k, i in enumerate(ids)}, []
    for _ in range(len(x) - 1):
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        groups[a] += groups.pop(b)
        want.append((sorted(groups[a]), d[a, b]))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[b] = d[:, b] = d[a, a] = np.inf
    got = sorted(run("complete_linkage"), key=lambda r: r.step)
    assert [r.members for r in got] == [m for m, _ in want] and np.allclose([r.height for r in got], [h for _, h in want])


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    rng = np.random.default_rng(8)
    x = [v.tolist() for v in rng.normal(size=(60, 3))] + [None, [1.0, None, 2.0], [1.0, 2.0], [4.0, 6.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(None, x[0])], "id long, vec array<double>")
    got = {(r.i, r.j): r.d for r in P.pair_distances(df).collect()}
    assert len(got) == 64 * 63 // 2 and all(i < j for i, j in got)
    assert all(math.isclose(got[i, j], math.dist(x[i], x[j]), rel_tol=1e-12) for i in range(60) for j in range(i + 1, 60))
    assert got[62, 63] == 5.0 and all(d is None for (i, j), d in got.items() if j >= 60 and (i, j) != (62, 63))
    assert P.pair_distances(df.where("id < 0")).count() == 0


def test_all_lines(spark, duck):
    same_rows(spark, duck, "soft_threshold", (" WHERE l_orderkey <= 2000", ""))


def test_all_sizes(spark, duck):
    same_rows(spark, duck, "group_class", (" WHERE p_size <= 12", ""))


def test_all_names(spark, duck):
    same_rows(spark, duck, "bagscore_parts", (" WHERE p_partkey <= 40", ""), (" WHERE p_partkey > 40 AND p_partkey <= 200", ""))


@pytest.mark.parametrize("name,most", [("synonym_groups", 60), ("jaccard_groups", 300)])
def test_all_customers(spark, duck, name, most):
    same_rows(spark, duck, name, (f" WHERE c_custkey <= {most}", ""))
