"""Lineage of directed graphs and components of undirected ones, as rounds of joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the folder of spark.checkpoint.dir (a temporary one only where none is set)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="cohortal-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = os.path.join(base, f"cohortal-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame) -> DataFrame:
    """ancestor, descendant, depth (shortest) over edges (parent, child). Rounds of a frontier join; cycles end when nothing is new."""
    known = settled(edges.where("parent IS NOT NULL AND child IS NOT NULL AND parent <> child").select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct().withColumn("depth", F.lit(1)))
    step = known.select(F.col("ancestor").alias("parent"), F.col("descendant").alias("child"))
    frontier = known
    while not frontier.isEmpty():
        reached = frontier.join(step, F.col("descendant") == F.col("parent")).where("ancestor <> child").select("ancestor", F.col("child").alias("descendant"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = settled(reached.join(known, ["ancestor", "descendant"], "left_anti"))
        known = known.unionByName(frontier)
    return known


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("id")).unionByName(edges.select(F.col("child").alias("id"))).where("id IS NOT NULL").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    return nodes(edges).join(edges.select(F.col("child").alias("id")), "id", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes without a child."""
    return nodes(edges).join(edges.select(F.col("parent").alias("id")), "id", "left_anti")


def levels(edges: DataFrame) -> DataFrame:
    """id, level: the number of distinct ancestors."""
    above = closure(edges).groupBy(F.col("descendant").alias("id")).agg(F.count("*").alias("level"))
    return nodes(edges).join(above, "id", "left").select("id", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, ascendants, descendants, links of each node."""
    pairs = edges.distinct()
    both = pairs.select(F.col("parent").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")).unionByName(pairs.select(F.col("child").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")))
    return both.groupBy("id").agg(F.sum("up").alias("ascendants"), F.sum("down").alias("descendants"), F.count("*").alias("links"))


def adjacency(edges: DataFrame, kinds: tuple[str, ...] = ("ascendants", "descendants")) -> DataFrame:
    """i, j, links: the adjacency matrix in long form, from each node to its ascendants, its descendants or both."""
    one = {"descendants": edges.select(F.col("parent").alias("i"), F.col("child").alias("j")), "ascendants": edges.select(F.col("child").alias("i"), F.col("parent").alias("j"))}
    out = reduce(DataFrame.unionByName, [one[k].distinct() for k in kinds])
    return out.where("i IS NOT NULL AND j IS NOT NULL").groupBy("i", "j").agg(F.count("*").alias("links"))


def edges_of(matrix: DataFrame, value: str = "links") -> DataFrame:
    """parent, child: the edges of an adjacency matrix in long form (i, j), without loops."""
    return matrix.where((F.col(value) == 1) & (F.col("i") != F.col("j"))).select(F.col("i").alias("parent"), F.col("j").alias("child")).distinct()


def located(edges: DataFrame, found: DataFrame) -> DataFrame:
    """id, place (from 1): the nodes of ``found`` (id) in the order of a walk from the root down, children by name. ``edges`` are a tree."""
    from cohortal.operators.order import placed_rows

    above = closure(edges).groupBy(F.col("descendant").alias("id")).agg(F.sort_array(F.collect_list(F.struct("depth", "ancestor")), asc=False).alias("_up"))
    paths = nodes(edges).join(found.select("id").distinct(), "id", "left_semi").join(above, "id", "left")
    path = F.concat(F.coalesce(F.col("_up.ancestor"), F.array().cast("array<string>")), F.array("id"))
    return placed_rows(paths.select("id", path.alias("_path")), "_path").select("id", F.col("_r").cast("long").alias("place"))


def comembership_distance(membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distances of members by the groups they share: (i, j, d) of i < j that share a group not of all members, and one row, ``d``, of all other pairs.

    With c one more than the number of shared groups, d is the size of 1 / c less the mean
    of 1 / c of members with themselves. Groups of all members are counted, not paired; a smaller group gives all its pairs.
    """
    m = membership.where("gid IS NOT NULL AND member IS NOT NULL").distinct()
    n = m.agg(F.count_distinct("member").alias("_n"))
    size = m.groupBy("gid").agg(F.count("*").alias("_size")).crossJoin(F.broadcast(n))  # one row
    whole = size.agg(F.count(F.when(F.col("_size") == F.col("_n"), 1)).alias("_whole"))
    own = m.groupBy("member").agg((1 / (1.0 + F.count("*"))).alias("_c")).agg(F.avg("_c").alias("_mean"))
    base = F.broadcast(whole.crossJoin(own))  # one row
    part = m.join(size.where("_size < _n").select("gid"), "gid", "left_semi")
    shared = part.withColumnRenamed("member", "i").join(part.withColumnRenamed("member", "j"), "gid").where("i < j").groupBy("i", "j").agg(F.count("*").alias("_s"))
    d = lambda s: F.abs(1 / (1.0 + F.col("_whole") + s) - F.col("_mean")).alias("d")
    return shared.crossJoin(base).select("i", "j", d(F.col("_s"))), whole.crossJoin(own).select(d(F.lit(0)))


def lineage_table(edges: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """id, level, ancestors, descendants, parents as sorted arrays: one row a node."""
    c = closure(edges)
    up = c.groupBy(F.col("descendant").alias("id")).agg(F.sort_array(F.collect_set("ancestor")).alias("ancestors"))
    down = c.groupBy(F.col("ancestor").alias("id")).agg(F.sort_array(F.collect_set("descendant")).alias("descendants"))
    parents = edges.groupBy(F.col("child").alias("id")).agg(F.sort_array(F.collect_set("parent")).alias("parents"))
    none = F.array().cast("array<string>")
    out = nodes(edges).join(up, "id", "left").join(down, "id", "left").join(parents, "id", "left")
    out = out.select("id", *[F.coalesce(F.col(c_).cast("array<string>"), none).alias(c_) for c_ in ("ancestors", "descendants", "parents")])
    out = out.withColumn("level", F.size("ancestors"))
    return out.join(descriptions, "id", "left") if descriptions is not None else out


def containment_edges(groups: DataFrame) -> DataFrame:
    """parent, child over (gid, member): each group under the smallest groups that hold all its members.

    Groups meet only where they share a member. Of groups with equal members the least name is the parent.
    """
    m = groups.distinct()
    size = m.groupBy("gid").agg(F.count("*").alias("n"))
    shared = m.alias("a").join(m.alias("b"), "member").where("a.gid <> b.gid").groupBy(F.col("a.gid").alias("child"), F.col("b.gid").alias("parent")).agg(F.count("*").alias("shared"))
    held = shared.join(size.select(F.col("gid").alias("child"), F.col("n").alias("nc")), "child").join(size.select(F.col("gid").alias("parent"), F.col("n").alias("np")), "parent")
    held = held.where("shared = nc AND (np > nc OR (np = nc AND parent < child))").select("parent", "child")
    # An edge that a third group between both implies is left out.
    implied = held.alias("x").join(held.alias("y"), F.col("x.child") == F.col("y.parent")).select(F.col("x.parent").alias("parent"), F.col("y.child").alias("child"))
    return held.join(implied, ["parent", "child"], "left_anti")


#: Edges that one task joins at most, well under 200 MB; larger graphs take rounds of all tasks.
SMALL_GRAPH = 500_000


class Forest:
    """Disjoint sets named by their least member."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def join(self, u, v) -> bool:
        """Whether the two were apart."""
        a, b = sorted((self.find(u), self.find(v)))
        self.parent[b] = a
        return a != b


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for edges in batches:
        for u, v in zip(edges["u"].tolist(), edges["v"].tolist()):
            forest.join(u, v)
    nodes = list(forest.parent)
    yield pd.DataFrame({"item": nodes, "component": [forest.find(x) for x in nodes]})


def _spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for edges in batches:
        yield edges[[forest.join(u, v) for u, v in zip(edges["i"].tolist(), edges["j"].tolist())]]


def small_spanning_tree(pairs: DataFrame) -> DataFrame:
    """i, j, d of a minimum spanning forest of at most SMALL_GRAPH pairs, in one task, shortest first."""
    return settled(pairs.select("i", "j", "d").coalesce(1).sortWithinPartitions("d", "i", "j").mapInPandas(_spanning, pairs.select("i", "j", "d").schema))


def components(links: DataFrame, items: DataFrame) -> DataFrame:
    """item, component (least item reachable) over undirected links (i, j); ``items``: item.

    A graph of at most SMALL_GRAPH edges is joined in one task, a larger one by
    alternating stars; both give the same rows.
    """
    edges = settled(links.where("i <> j").select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).distinct())
    if edges.count() <= SMALL_GRAPH:
        kind = edges.schema["u"].dataType.simpleString()
        found = edges.coalesce(1).mapInPandas(_joined, f"item {kind}, component {kind}")
        return items.join(found, "item", "left").select("item", F.coalesce("component", "item").alias("component"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = settled(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return items.join(edges.withColumnsRenamed({"u": "item", "v": "component"}), "item", "left").select("item", F.coalesce("component", "item").alias("component"))
