"""Matching of short texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_words(a: Column, b: Column) -> Column:
    """Number of distinct lower-case words that two texts share."""
    return F.size(F.array_intersect(F.split(F.lower(a), " "), F.split(F.lower(b), " ")))


def best_match(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Each left text's right text with most shared words (ties to the first by order); texts meet only through a shared word."""
    word = lambda c: F.explode(F.array_distinct(F.split(F.lower(F.col(c)), " ")))
    x, y = left.select(a, word(a).alias("_w")).distinct(), right.select(b, word(b).alias("_w")).distinct()
    scored = x.join(y, "_w").groupBy(a, b).agg(F.count("*").alias("score"))
    return scored.groupBy(a).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(b).alias("b"))).alias("m")).select(a, F.col("m.b").alias(b), (-F.col("m.s")).alias("score"))


@F.pandas_udf(T.DoubleType())
def global_alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    """Global alignment score: 2 for a match, -2 for each gap; null for a null text."""

    def one(s: str | None, t: str | None) -> float | None:
        if s is None or t is None:
            return None
        row = [-2.0 * j for j in range(len(t) + 1)]
        for i, x in enumerate(s, 1):
            last, row[0] = row[0], -2.0 * i
            for j, y in enumerate(t, 1):
                last, row[j] = row[j], max(last + 2.0 * (x == y), row[j] - 2, row[j - 1] - 2)
        return row[-1]

    return pd.Series([one(s, t) for s, t in zip(a, b)])


def removed(text: Column, parts: list[str]) -> Column:
    """The text with each part taken out, one after another."""
    for p in parts:
        text = F.replace(text, F.lit(p), F.lit(""))
    return text


@F.pandas_udf(T.DoubleType())
def diagonal_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best diagonal of the matrix of equal letters, damped by relative distance; the shorter text is repeated to the longer's length.

    A diagonal counts as the square of its sum plus the sums beside it. Null for null or empty texts.
    """

    def one(s: str | None, t: str | None) -> float | None:
        if not s or not t:
            return None
        short, long = sorted((s, t), key=len)
        size, pad = len(long), (short * len(short))[: len(long)]
        i, j = np.meshgrid(np.arange(len(pad)), np.arange(size), indexing="ij")
        same = np.array(list(pad))[:, None] == np.array(list(long))[None, :]
        w = np.where(same, np.log2(3.0), 0.0) / (np.log2(((i + 0.5) / len(pad) - (j + 0.5) / size) ** 2 + 1) + 1)
        sums = np.bincount((j - i)[j >= i], w[j >= i], size)
        beside = np.append(sums[1:], 0.0) + np.append(0.0, sums[:-1])
        return float((sums**2 + beside).max() / 3 / (len(s) + len(t)) * len(short))

    return pd.Series([one(s, t) for s, t in zip(a, b)])
