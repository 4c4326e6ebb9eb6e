"""Readers and writers of group, edge, coordinate and synonym files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_gmt(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """gid, description, members (distinct, in order) from lines of tab-separated id, description and members."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.length(F.trim("value")) > 0))
    members = F.array_distinct(F.filter(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), lambda x: x != ""))
    return lines.select(parts[0].alias("gid"), F.get(parts, F.lit(1)).alias("description"), members.alias("members"))


def membership(groups: DataFrame) -> DataFrame:
    return groups.select("gid", F.explode("members").alias("member"))


def gmt_lines(groups: DataFrame) -> DataFrame:
    """One text line a group."""
    return groups.select(F.concat_ws("\t", "gid", F.coalesce("description", F.lit("")), F.array_join(F.transform("members", lambda x: x.cast("string")), "\t")).alias("value"))


def write_gmt(groups: DataFrame, path: str) -> None:
    gmt_lines(groups).write.text(path)


def cluster_lines(labels: DataFrame) -> DataFrame:
    """Group lines of a clustering (item, cluster): CLU-k, a description and the sorted items."""
    g = labels.groupBy("cluster").agg(F.sort_array(F.collect_list("item")).alias("members"))
    return g.select(F.concat(F.lit("CLU-"), F.col("cluster").cast("string")).alias("gid"), F.lit("DESCRIPTION").alias("description"), "members")


def read_edges(spark: SparkSession, path: str, containing: str | None = None) -> DataFrame:
    """parent, child from a tab-separated file; ``containing``: only edges whose ends both contain it."""
    e = spark.read.csv(path, sep="\t", schema="parent string, child string").where("child IS NOT NULL")
    return e.where(F.contains("parent", F.lit(containing)) & F.contains("child", F.lit(containing))) if containing else e


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """symbol, x, y, z of lines with exactly four words."""
    w = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return spark.read.text(path).where(F.size(w) == 4).select(w[0].alias("symbol"), *[w[k].try_cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])


def read_conversions(spark: SparkSession, path: str) -> DataFrame:
    """id, symbol of a two-column file with a header line."""
    return spark.read.csv(path, sep="\t", header=True, schema="id string, symbol string")


def synonyms(conversions: DataFrame) -> DataFrame:
    """symbol with its sorted ids."""
    return conversions.groupBy("symbol").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def unique_synonyms(conversions: DataFrame) -> DataFrame:
    """symbol with its first id by order, and how many others there are."""
    return conversions.groupBy("symbol").agg(F.min("id").alias("id"), (F.count_distinct("id") - 1).alias("dropped"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """feature, sample, value of a tab-separated matrix whose first column names the features; NaN as null."""
    wide = spark.read.csv(path, sep="\t", header=True)
    key, *samples = wide.columns
    long = wide.unpivot([key], samples, "sample", "value").withColumnRenamed(key, "feature")
    return long.withColumn("value", F.nanvl(F.col("value").try_cast("double"), F.lit(None).cast("double")))


def pruned_journal(journal: DataFrame) -> DataFrame:
    """key, sample, sval, nval of the rows named as labels or with a unit in brackets; ND is missing, truth is 1 or 0, units behind _ go."""
    j = journal.where(F.contains(F.lower("key"), F.lit("label")) | F.contains("key", F.lit("[")))
    s = F.when(F.upper("sval") == "ND", None).when(F.lower("sval") == "true", "1").when(F.lower("sval") == "false", "0").otherwise(F.col("sval"))
    j = j.withColumn("sval", s)
    return j.withColumn("nval", F.expr("try_cast(split(sval, '_')[0] AS double)"))


def compartments(text: Column | str) -> Column:
    """All parts of a text in square brackets."""
    return F.regexp_extract_all(text, F.lit(r"\[(.*?)\]"), F.lit(1))


def node_gmt_lines(edges: DataFrame, groups: DataFrame, levels: DataFrame) -> DataFrame:
    """line: a node, then parents, description, level and metric with colons between, then its members, with tabs between.

    ``groups``: id, description, metric, members; ``levels``: id, level. What is null is left empty.
    """
    parents = edges.groupBy(F.col("child").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("parent")), ":").alias("_up"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    middle = F.concat(text("_up"), F.lit(":"), text("description"), F.lit(":"), text("level"), F.lit(":"), text("metric"))
    return levels.join(groups, "id", "left").join(parents, "id", "left").select(F.concat_ws("\t", F.col("id"), middle, F.array_join("members", "\t")).alias("line"))


def linkage_lines(levels: DataFrame, metrics: DataFrame) -> DataFrame:
    """line: each node (id, level) with its metric (id, metric) or, without one, its level."""
    value = F.coalesce(F.col("metric").cast("double"), F.col("level").cast("double"))
    return levels.join(metrics, "id", "left").select(F.format_string('["cluster":%s, "metric":%.6f]', F.col("id"), value).alias("line"))


def write_levels(table: DataFrame, path: str, level: str) -> None:
    """One folder a level."""
    table.write.partitionBy(level).parquet(path)


def read_levels(spark: SparkSession, path: str, level: str, of: list | None = None) -> DataFrame:
    """All levels, or those asked for, which alone are read."""
    df = spark.read.parquet(path)
    return df if of is None else df.where(F.col(level).isin(of))


def node_json(nodes: DataFrame) -> DataFrame:
    """One JSON line a node."""
    return nodes.select(F.to_json(F.struct(*nodes.columns)).alias("value"))


def read_inventory(spark: SparkSession, path: str, member: int = 0, group: int = 1, description: int | None = None, starts_with: str = "", only: DataFrame | None = None) -> DataFrame:
    """gid, description, members from a file of one tab-separated member and group a line.

    ``starts_with``: members begin so; ``only``: gid, the groups that are kept.
    """
    w = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(w, F.lit(group)).alias("gid"), F.get(w, F.lit(member)).alias("member"), (F.get(w, F.lit(description)) if description is not None else F.lit("")).alias("description"))
    rows = rows.where(F.col("gid").isNotNull() & F.col("member").startswith(starts_with))
    rows = rows.join(only, "gid", "left_semi") if only is not None else rows
    return rows.groupBy("gid").agg(F.min("description").alias("description"), F.sort_array(F.collect_set("member")).alias("members"))


def remapped(groups: DataFrame, mapping: DataFrame) -> DataFrame:
    """Groups with members renamed by ``mapping`` (member, name); members without a name stay."""
    long = groups.select("gid", "description", F.explode("members").alias("member")).join(mapping, "member", "left")
    return long.groupBy("gid").agg(F.min("description").alias("description"), F.sort_array(F.collect_set(F.coalesce("name", "member"))).alias("members"))
