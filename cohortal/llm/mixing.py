"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Each document draws the exponential key -ln(u) / w, with u a hash of its id and w
its quality weight; small keys come first. A source takes whole epochs of all its
documents and then the first of them by key, up to its token budget.

No source is ever sorted in one task: rows fall into slices of their key, sums
over slices find the slice in which the budget ends, and only that slice of each
source is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.shared import WORD, table, unit_hash, written

#: Slices of the key range in a source; the row-wise order is over one slice in so many.
KEY_SLICES = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Token targets of sources.

    ``sizes``: source (may be null), source_size. Sources in order of code points,
    null last, weigh ``weights``, repeating. They share ``share`` times all sizes
    by weight; a target stops at ``most`` times its source's size and the excess is
    shared anew by weight. Sharing anew until none is above ends where sources are
    filled in order of the level ``most * size / weight``, so one ordered sum finds it.
    Returns source, source_size, weight, target. No source: no rows; only empty
    sources: targets of 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    up_to = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    level = (F.sum("source_size").over(everywhere) * share - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    )
    filled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull(), "source", "level"))).over(everywhere)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(final["level"] * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, boundary: str = "cut", carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words a mix takes of each document.

    ``docs``: doc_id, text, source and any other columns, which are not read.
    ``quality``: doc_id and quality_weight, once for each id (default 1; an id that
    is missing, and a weight that is null or not positive, count as 1). Size is the number of words, 0 for null or empty texts.
    ``boundary``: of the one document in which a source's budget ends, ``cut`` takes
    just the words that are missing; ``nearest`` takes all or nothing, whichever
    comes nearer to the target.
    ``carry``: columns that come along unchanged, with names that no returned column has.
    Returns doc_id, source, size, source_size, target, epochs (whole copies), those
    columns and taken (words, repeats counted). Null ids and sources are values like others;
    repeated rows are rows of their own; ties of keys are ordered by id, size and
    text hash; an empty table gives no rows.
    """
    slim = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
        *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)],
    )
    carried = [f"carried_{k}" for k in range(len(carry))]
    weight = F.lit(1.0)
    if quality is not None:
        slim = slim.join(quality.select("doc_id", "quality_weight"), "doc_id", "left")
        weight = F.when(F.col("quality_weight") > 0, F.col("quality_weight")).otherwise(1.0)
    key = -F.log(unit_hash(F.lit(seed), F.col("doc_id"), F.col("text_hash"))) / weight
    slim = slim.withColumn("key", key).withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * KEY_SLICES).cast("int"))
    slim = written(slim.select("doc_id", "source", "size", "text_hash", "key", "slice", *carried))
    slices = slim.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = F.sum("words").over(Window.partitionBy("p.source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    # Each slice is taken whole, or not at all, or is the one in which the budget ends.
    slices = slices.alias("s").join(plan.alias("p"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        F.col("p.source").alias("in_source"), F.col("slice").alias("in_slice"), "source_size", "target", "epochs",
        (F.col("rest") - F.coalesce(before, F.lit(0))).alias("left"), "words",
    )
    rows = slim.join(slices, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("slice") == F.col("in_slice")))
    whole = rows.where((F.col("left") <= 0) | (F.col("words") <= F.col("left"))).withColumn("part", F.when(F.col("left") > 0, F.col("size")).otherwise(0))
    order = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = F.least("size", F.greatest("missing", F.lit(0)))
    if boundary == "nearest":
        taken = F.when((F.col("missing") > 0) & (F.col("missing") * 2 >= F.col("size")), F.col("size")).otherwise(0)
    last = rows.where((F.col("left") > 0) & (F.col("words") > F.col("left"))).withColumn("missing", missing).withColumn("part", taken)
    out = [*(F.col(c) for c in ("doc_id", "source", "size", "source_size", "target")), F.col("epochs").cast("int").alias("epochs"), *[F.col(k).alias(c) for k, c in zip(carried, carry)]]
    took = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return whole.select(*out, took).unionByName(last.select(*out, took))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights of labelled documents: 2 if labelled good, 0.5 if labelled bad; a null label counts as none."""
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    return judged.select("doc_id", F.when(F.col("good") > 0, 2.0).otherwise(0.5).alias("quality_weight"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 3, 1, 2 (see the operator ``mix``)."""
    mixed = mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")
