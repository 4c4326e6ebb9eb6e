"""Enrichment of groups in marked members, flat and along a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.functions.numeric import fisher_two_sided, hypergeometric_tail
from cohortal.operators.graph import closure
from cohortal.operators.significance import q_values


def group_counts(membership: DataFrame, marked: DataFrame) -> DataFrame:
    """gid, n, hits, fraction. ``membership``: gid, member; ``marked``: member, hit (boolean). Members without a mark don't count."""
    return membership.distinct().join(marked, "member").groupBy("gid").agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits")).withColumn("fraction", F.col("hits") / F.col("n"))


def enrichment(membership: DataFrame, marked: DataFrame, test: str = "fisher") -> DataFrame:
    """gid, n, hits, fraction, odds_ratio, p, q. ``test``: fisher (two-sided) or hypergeometric (upper tail)."""
    whole = marked.agg(F.count("*").alias("_all"), F.count(F.when(F.col("hit"), 1)).alias("_hits"))
    g = group_counts(membership, marked).crossJoin(F.broadcast(whole))  # one row
    a, b = F.col("hits"), F.col("n") - F.col("hits")
    c, d = F.col("_hits") - F.col("hits"), F.col("_all") - F.col("_hits") - (F.col("n") - F.col("hits"))
    p = (fisher_two_sided if test == "fisher" else hypergeometric_tail)(a, b, c, d)
    odds = (a * d) / F.nullif((b * c).cast("double"), F.lit(0.0))
    return q_values(g.withColumn("odds_ratio", odds).withColumn("p", p), "p", "gid").drop("_all", "_hits")


def masked_membership(membership: DataFrame, edges: DataFrame, significant: DataFrame | None = None) -> DataFrame:
    """Members of each group that none of its descendants (only significant ones, if given) holds.

    Ancestors are transitive, so working from the deepest level up and taking out used members is this one anti join.
    """
    below = closure(edges)
    if significant is not None:
        below = below.join(significant.select(F.col("gid").alias("descendant")), "descendant", "left_semi")
    used = below.join(membership, F.col("descendant") == F.col("gid")).select(F.col("ancestor").alias("gid"), "member").distinct()
    return membership.distinct().join(used, ["gid", "member"], "left_anti")


def hierarchical_enrichment(membership: DataFrame, edges: DataFrame, marked: DataFrame, test: str = "fisher") -> DataFrame:
    """``enrichment`` of what masking leaves of each group; groups with nothing left have p and q of 1."""
    tested = enrichment(masked_membership(membership, edges), marked, test)
    out = membership.select("gid").distinct().join(tested, "gid", "left")
    return out.select("gid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "hits")], *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("p", "q")])


def with_synonyms(membership: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Members and, beside them, their synonyms. ``synonyms``: member, synonym."""
    return membership.unionByName(membership.join(synonyms, "member").select("gid", F.col("synonym").alias("member"))).distinct()
