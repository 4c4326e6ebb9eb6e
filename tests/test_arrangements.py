"""Images, curves, lists, Hommel's method and partial least squares against plain versions of themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.functions import numeric as N
from cohortal.operators import factors as X
from cohortal.operators import fields as I
from cohortal.operators import sequences as L
from cohortal.operators import significance as G
from cohortal.sources import files


def plain_hommel(p):
    order = np.argsort(p, kind="stable")
    s, n = np.sort(p), len(p)
    q = {m: min(m * s[n - m + k - 1] / k for k in range(1, m + 1)) for m in range(1, n + 1)}
    out = np.empty(n)
    out[order] = [min(1.0, max(min(m * x, q[m]) for m in q)) for x in s]
    return out


def test_hommel(spark):
    rng = np.random.default_rng(1)
    for p in (rng.random(60), np.r_[rng.random(30) * 1e-3, rng.random(30)], np.r_[np.zeros(3), np.full(5, 0.02), 0.5, 1.0, 1.0], np.array([0.3])):
        rows = [(k, float(x)) for k, x in enumerate(p)] + [(999, None)]
        out = {r.pos: r.adjusted for r in G.adjusted(spark.createDataFrame(rows, "pos long, p double"), "hommel").collect()}
        assert out.pop(999) is None
        assert [out[k] for k in range(len(p))] == pytest.approx(plain_hommel(p), abs=1e-12)
    assert G.hommel(spark.createDataFrame([], "pos long, p double")).count() == 0


def nipals(x, y):
    scale = lambda m: (m - m.mean(0)) / np.where(m.std(0, ddof=1) > 0, m.std(0, ddof=1), 1)
    x, y, out = scale(x), scale(y), []
    for _ in range(2):
        u = y[:, 0]
        for _ in range(5000):
            w = x.T @ u
            w /= np.linalg.norm(w)
            t = x @ w
            c = y.T @ t / (t @ t)
            u = y @ c / (c @ c)
        sign = np.sign(w[np.abs(w).argmax()])
        out.append((w * sign, c * sign, t * sign))
        x, y = x - np.outer(t, x.T @ t / (t @ t)), y - np.outer(t, c)
    return [np.array(v).T for v in zip(*out)]


def test_partial_least_squares(spark):
    rng = np.random.default_rng(5)
    kind = np.arange(14) % 3
    x, y = rng.normal(size=(14, 9)) + np.outer(kind, rng.normal(size=9)), np.eye(3)[kind]
    x[:, 8] = 4.0
    long = spark.createDataFrame([(f"f{f}", s, float(x[s, f])) for s in range(14) for f in range(9)], "feature string, sample long, value double")
    design = spark.createDataFrame([(s, f"t{k}", 1.0) for s, k in enumerate(kind)], "sample long, term string, x double")
    w, c, t = nipals(x, y)
    for got, key, want in zip(X.partial_least_squares(long, design), ("feature", "term", "sample"), (w, c, t)):
        assert np.array([r[1:] for r in got.orderBy(key).collect()]) == pytest.approx(want, abs=1e-6)


def test_texture(spark):
    v = np.random.default_rng(2).random((7, 9))
    a = 2 * (np.exp((v.ravel().argsort().argsort() + 1).reshape(v.shape) / (v.size + 0.5)) - 1)
    want = np.zeros(v.shape)
    for i, j in np.ndindex(v.shape):
        for di in range(-2, 2):
            for dj in range(-2, 2):
                y, x = i - di, j - dj
                if (di or dj) and 0 <= y < 7 and 0 <= x < 9:
                    p, q = (a[(y - di) % 7, (x - dj) % 9] - a[y, x]) ** 2 / a.var(), (di * di + dj * dj) / 4
                    want[i, j] += 2 * np.sqrt(p * q) / (p + q)
    cells = spark.createDataFrame([("a", i, j, float(v[i, j])) for i, j in np.ndindex(v.shape)], "image string, i long, j long, value double")
    for r in I.texture(cells, reach=2).collect():
        assert r.texture == pytest.approx(want[r.i, r.j])


def test_curve_is_a_walk_and_goes_back(spark):
    at = spark.range(256).select("id", N.hilbert_point(16, F.col("id")).alias("at"))
    rows = at.select("id", "at", N.hilbert_place(16, F.col("at.x"), F.col("at.y")).alias("back")).orderBy("id").collect()
    assert all(r.id == r.back for r in rows)
    assert all(abs(a["at"]["x"] - b["at"]["x"]) + abs(a["at"]["y"] - b["at"]["y"]) == 1 for a, b in zip(rows, rows[1:]))


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["d"],)], "x array<string>")
    out = [tuple(r) for r in df.select(L.sub_arrays(F.col("x")), L.chunks(F.col("x"), 2), L.permutations(F.col("x"), 2), L.without_places(F.col("x"), [0])).collect()]
    assert out[0][0] == [["a"], ["a", "b"], ["a", "b", "c"], ["b"], ["b", "c"], ["c"]]
    assert out[0][1] == [["a", "b"]] and len(out[0][2]) == 6 and out[0][3] == ["b", "c"]
    assert out[1] == ([], [], [], []) and out[2] == ([["d"]], [], [], [])


def test_names_with_places_and_levels(spark, tmp_path):
    groups = spark.createDataFrame([("g", "one", [["b", "a"], ["a"]]), ("h", "two", [["c"]])], "gid string, name string, members array<array<string>>")
    places = spark.createDataFrame([("g", "y"), ("g", "x"), ("h", None)], "gid string, place string")
    assert {tuple(map(str, r)) for r in L.named_with_places(groups, places).collect()} == {("g", "[x,y] one", "['a', 'b']"), ("h", "two", "['c']")}
    files.write_levels(spark.createDataFrame([(1, "a"), (2, "b")], "level int, x string"), str(tmp_path / "levels"), "level")
    assert [tuple(r) for r in files.read_levels(spark, str(tmp_path / "levels"), "level", [2]).select("x", "level").collect()] == [("b", 2)]
