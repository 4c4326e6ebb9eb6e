"""The test tables as the library's canonical inputs (see the plans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def revenue_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row a line: brand, part, nation, flag, quantity, revenue."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    x = line.join(read(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))


def analytes(spark: SparkSession, d: str) -> DataFrame:
    """feature (brand), sample (nation), value (net revenue)."""
    x = revenue_rows(spark, d)
    return x.groupBy(F.col("p_brand").alias("feature"), F.col("c_nationkey").alias("sample")).agg(F.round(F.sum("revenue"), 2).alias("value"))


def journal(spark: SparkSession, d: str) -> DataFrame:
    """sample (nation), region."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("sample"), "n_regionkey")
    return n.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("sample", F.col("r_name").alias("region"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """feature, sample, value, region."""
    return analytes(spark, d).join(journal(spark, d), "sample")


def group_edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, child: ALL over part types over types with brands."""
    p = read(spark, d, "part").select("p_type", "p_brand").distinct()
    top = p.select(F.lit("ALL").alias("parent"), F.col("p_type").alias("child"))
    return top.unionByName(p.select(F.col("p_type").alias("parent"), F.concat_ws("|", "p_type", "p_brand").alias("child"))).distinct()


def membership(spark: SparkSession, d: str) -> DataFrame:
    """gid, member (part key) of those groups."""
    p = read(spark, d, "part")
    one = lambda g: p.select(g.alias("gid"), F.col("p_partkey").alias("member"))
    return one(F.lit("ALL")).unionByName(one(F.col("p_type"))).unionByName(one(F.concat_ws("|", "p_type", "p_brand")))


def marked_parts(spark: SparkSession, d: str) -> DataFrame:
    """member, hit: parts of which more than 40 % of the lines were returned."""
    line = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("member")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("r"))
    return line.select("member", (F.col("r") > 0.4).alias("hit"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """item, vec, label of all embeddings."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """series_id (event type), pos (day from 0), value (mean)."""
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    from pyspark.sql import Window

    return e.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("day")) - 1).cast("long").alias("pos"), F.round("value", 9).alias("value"))
