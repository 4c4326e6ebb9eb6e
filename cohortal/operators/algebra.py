"""Bounded dense algebra: Gram matrices by aggregation, small solves on the driver.

Only matrices whose size is that of a design, a set of samples or a set of
dimensions come to the driver; LIMIT bounds them and larger ones are refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2000


def gram(df: DataFrame, row: str, column: str, value: str) -> tuple[list, np.ndarray]:
    """Names of columns and their inner products over rows. Zeros may be left out of the long form."""
    a, b = df.select(row, F.col(column).alias("i"), F.col(value).alias("x")), df.select(row, F.col(column).alias("j"), F.col(value).alias("y"))
    names = [r[0] for r in df.select(column).distinct().orderBy(column).limit(LIMIT + 1).collect()]
    if len(names) > LIMIT:
        raise ValueError(f"more than {LIMIT} columns: reduce them first")
    place = {n: k for k, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in a.join(b, row).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect():  # LIMIT squared at most
        out[place[r["i"]], place[r["j"]]] = out[place[r["j"]], place[r["i"]]] = r["s"]
    return names, out


def fixed_sign(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1, 1)


def principal_components(df: DataFrame, row: str, column: str, value: str, k: int = 2) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores of rows (row, pc, score), loadings of columns and explained shares.

    Columns are centred; the covariance is one aggregate and rows are projected where they are.
    """
    spark = df.sparkSession
    means = df.groupBy(column).agg(F.avg(value).alias("_m"))
    centred = df.join(means, column).select(row, column, (F.col(value) - F.col("_m")).alias("_x"))
    names, products = gram(centred, row, column, "_x")
    weight, vectors = np.linalg.eigh(products)
    order = np.argsort(-weight)[:k]
    loadings = fixed_sign(vectors[:, order])
    share = weight[order] / max(weight.sum(), 1e-300)
    table = spark.createDataFrame([(n, int(c), float(loadings[i, c])) for i, n in enumerate(names) for c in range(len(order))], f"{column} {df.schema[column].dataType.simpleString()}, pc int, w double")
    scores = centred.join(F.broadcast(table), column).groupBy(row, "pc").agg(F.sum(F.col("_x") * F.col("w")).alias("score"))  # LIMIT times k rows at most
    return scores, loadings, share


def pseudo_inverse(a: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Through the singular values above ``tolerance`` times the largest."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    keep = s > tolerance * s.max(initial=0)
    return (vt[keep].T / s[keep]) @ u[:, keep].T


def coordinates_from_distances(d: np.ndarray, dimensions: int = 2, squared: bool = False) -> np.ndarray:
    """Points (a row each) with these distances, up to rotation: the Gram matrix about the last point, decomposed."""
    d2 = d if squared else d**2
    g = 0.5 * (d2[-1][:, None] + d2[-1][None, :] - d2)
    weight, vectors = np.linalg.eigh(g)
    order = np.argsort(-weight)[:dimensions]
    return fixed_sign(vectors[:, order]) * np.sqrt(np.maximum(weight[order], 0))


def rigid_superposition(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, shift and remaining deviation that bring p onto q."""
    cp, cq = p.mean(0), q.mean(0)
    u, _, vt = np.linalg.svd((p - cp).T @ (q - cq))
    turn = np.diag([1.0] * (p.shape[1] - 1) + [np.sign(np.linalg.det(u @ vt))])
    rotation = u @ turn @ vt
    moved = (p - cp) @ rotation + cq
    return rotation, cq - cp @ rotation, float(np.sqrt(((moved - q) ** 2).sum(1).mean()))


def shape_alignment(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """p with the mean and the principal axes of q; pairs of points are not needed."""
    (wp, vp), (wq, vq) = (np.linalg.eigh(np.cov(x.T)) for x in (p, q))
    scale = np.sqrt(np.maximum(wq, 0) / np.maximum(wp, 1e-300))
    return (p - p.mean(0)) @ fixed_sign(vp) * scale @ fixed_sign(vq).T + q.mean(0)


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tridiagonal form of a symmetric matrix and the orthogonal matrix that gives it."""
    t, q = a.astype(float).copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        x = t[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        n = np.linalg.norm(v)
        if n > 1e-15:
            h = np.eye(len(a))
            h[k + 1 :, k + 1 :] -= 2 * np.outer(v, v) / (n * n)
            t, q = h @ t @ h, q @ h
    return t, q


def whitened(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and covariance 1."""
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    return u * np.sqrt(len(x) - 1) * (s > 1e-12)


def low_rank_imputed(x: np.ndarray, share: float = 0.9) -> np.ndarray:
    """Missing values from the leading singular terms that hold ``share`` of the weight, once filled with column means."""
    gaps = np.isnan(x)
    filled = np.where(gaps, np.nanmean(x, 0), x)
    u, s, vt = np.linalg.svd(filled, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s) / s.sum(), share)) + 1
    return np.where(gaps, (u[:, :k] * s[:k]) @ vt[:k], x)


def rotation_matrix(axis: np.ndarray, angle: float) -> np.ndarray:
    """Rotation about an axis, by the quaternion's entries."""
    x, y, z = np.asarray(axis, float) / np.linalg.norm(axis) * np.sin(angle / 2)
    w = np.cos(angle / 2)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def bezier(points: DataFrame, segments: int = 100) -> DataFrame:
    """curve, t, x, y on the Bezier curve of control points (curve, pos, x, y), by Bernstein weights."""
    from pyspark.sql import Window

    from cohortal.functions.numeric import log_choose

    n = F.count("*").over(Window.partitionBy("curve")) - 1
    at = points.withColumn("_n", n).withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda k: k / segments)))
    power = lambda b, e: F.when(e == 0, 1.0).otherwise(F.pow(b, e))
    w = F.exp(log_choose(F.col("_n"), F.col("pos"))) * power(F.col("t"), F.col("pos")) * power(1 - F.col("t"), F.col("_n") - F.col("pos"))
    return at.withColumn("_w", w).groupBy("curve", "t").agg(F.sum(F.col("_w") * F.col("x")).alias("x"), F.sum(F.col("_w") * F.col("y")).alias("y"))


def spectra(df: DataFrame, by: str = "series_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """by, k, re, im, power of each series' Fourier transform, a series in one task (series are bounded)."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, k long, re double, im double, power double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.fft(pdf.sort_values(pos)[value].to_numpy(float))
        return pd.DataFrame({by: pdf[by].iloc[0], "k": range(len(f)), "re": f.real, "im": f.imag, "power": np.abs(f) ** 2})

    return df.groupBy(by).applyInPandas(run, schema)


def gaussian_field(df: DataFrame, image: str, width: float) -> DataFrame:
    """image, x, y, v: each image smoothed by a Gaussian in Fourier space; an image is one task."""
    schema = f"{image} {df.schema[image].dataType.simpleString()}, x int, y int, v double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="x", columns="y", values="v").fillna(0.0).to_numpy()
        fx, fy = np.fft.fftfreq(grid.shape[0])[:, None], np.fft.fftfreq(grid.shape[1])[None, :]
        smooth = np.fft.ifft2(np.fft.fft2(grid) * np.exp(-2 * (np.pi * width) ** 2 * (fx**2 + fy**2))).real
        x, y = np.indices(smooth.shape)
        return pd.DataFrame({image: pdf[image].iloc[0], "x": x.ravel() + pdf["x"].min(), "y": y.ravel() + pdf["y"].min(), "v": smooth.ravel()})

    return df.groupBy(image).applyInPandas(run, schema)


def reservoir_forecast(df: DataFrame, by: str, pos: str, value: str, train: int, size: int = 100, leak: float = 0.3, ridge: float = 1e-8, seed: int = 11111) -> DataFrame:
    """by, pos, forecast: an echo-state network trained on the first ``train`` values of each series predicts the next from each."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {pos} long, forecast double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        v = pdf[value].to_numpy(float)
        scale = np.abs(v).max() or 1.0
        rng = np.random.default_rng(seed)
        w_in, w = rng.uniform(-0.5, 0.5, (size, 2)), rng.uniform(-0.5, 0.5, (size, size))
        w *= 1.25 / np.abs(np.linalg.eigvals(w)).max()
        state, states = np.zeros(size), []
        for u in v / scale:
            state = (1 - leak) * state + leak * np.tanh(w_in @ [1, u] + w @ state)
            states.append(np.concatenate([[1, u], state]))
        x = np.array(states)
        a, b = x[: train - 1], v[1:train]
        out = np.linalg.solve(a.T @ a + ridge * np.eye(x.shape[1]), a.T @ b)
        return pd.DataFrame({by: pdf[by].iloc[0], pos: pdf[pos].to_numpy()[1:], "forecast": (x @ out)[:-1]})

    return df.groupBy(by).applyInPandas(run, schema)
