"""How good a clustering is, and how far two labelings agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.functions.numeric import average_rank, normal_upper_tail
from cohortal.operators import tiles
from cohortal.operators.graph import settled
from cohortal.operators.order import in_order, placed_rows, running, with_totals


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """tp, fp, fn, tn over ordered pairs of rows, from the contingency table alone; tn also counts each row with itself."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    square = lambda d, *k: d.groupBy(*k).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("t"))
    nij, ai, bj = square(cells, a, b), square(cells, a), square(cells, b)
    both = nij.select(F.col("s").alias("ss"), F.col("t").alias("t")).crossJoin(ai.select(F.col("s").alias("sa"))).crossJoin(bj.select(F.col("s").alias("sb")))  # single rows
    both = both.select((F.col("ss") - F.col("t")).alias("tp"), (F.col("sa") - F.col("ss")).alias("fp"), (F.col("sb") - F.col("ss")).alias("fn"), "t")
    return both.select("tp", "fp", "fn", (F.col("t") * F.col("t") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """mutual_information (natural log), rand, adjusted_rand of two labelings."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    cells = cells.withColumns({"ra": F.sum("n").over(Window.partitionBy(a)), "rb": F.sum("n").over(Window.partitionBy(b)), "t": F.sum("n").over(Window.partitionBy())})
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    once = cells.withColumn("fa", F.row_number().over(Window.partitionBy(a).orderBy(b))).withColumn("fb", F.row_number().over(Window.partitionBy(b).orderBy(a)))
    g = once.agg(
        F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ra") * F.col("rb")))).alias("mutual_information"),
        F.sum(pairs("n")).alias("s"), F.sum(F.when(F.col("fa") == 1, pairs("ra"))).alias("sa"), F.sum(F.when(F.col("fb") == 1, pairs("rb"))).alias("sb"), F.first("t").alias("t"),
    )
    all_pairs = F.col("t") * (F.col("t") - 1) / 2
    expected = F.col("sa") * F.col("sb") / all_pairs
    rand = (all_pairs + 2 * F.col("s") - F.col("sa") - F.col("sb")) / all_pairs
    return g.select("mutual_information", rand.alias("rand"), ((F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("adjusted_rand"))


def compactness(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """c1, c2, mean distance of pairs between (or, c1 = c2, within) clusters. ``labels``: item, label."""
    named = pairs.join(labels.select(F.col("item").alias("i"), F.col("label").alias("a")), "i").join(labels.select(F.col("item").alias("j"), F.col("label").alias("b")), "j")
    return named.groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).agg(F.avg("d").alias("mean"), F.count("*").alias("pairs"))


def compactness_of_points(points: DataFrame, label: str = "label") -> DataFrame:
    """``compactness`` of all pairs of points (item, vec, label), summed tile by tile."""
    sums = tiles.tag_sums(points, label).groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2"))
    return sums.agg((F.sum("total") / F.nullif(F.sum("known"), F.lit(0))).alias("mean"), F.sum("n").alias("pairs"))


def separation(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """c1, c2, gap: mean distance between two clusters less the mean of their inner means."""
    m = compactness(pairs, labels)
    inner = m.where("c1 = c2").select("c1", F.col("mean").alias("inner"))
    out = m.where("c1 <> c2").join(inner, "c1").join(inner.withColumnsRenamed({"c1": "c2", "inner": "inner2"}), "c2")
    return out.select("c1", "c2", (F.col("mean") - (F.col("inner") + F.col("inner2")) / 2).alias("gap"))


def dunn_index(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """dunn: least distance between clusters over the largest within one."""
    named = pairs.join(labels.select(F.col("item").alias("i"), F.col("label").alias("a")), "i").join(labels.select(F.col("item").alias("j"), F.col("label").alias("b")), "j")
    return named.agg((F.min(F.when(F.col("a") != F.col("b"), F.col("d"))) / F.max(F.when(F.col("a") == F.col("b"), F.col("d")))).alias("dunn"))


def dunn_index_of_points(points: DataFrame, label: str = "label") -> DataFrame:
    """``dunn_index`` of all pairs of points (item, vec, label), from the extremes of tiles."""
    return tiles.tag_extremes(points, label).select((F.col("apart") / F.col("within")).alias("dunn"))


def histogram_auc(bins: DataFrame, *by: str) -> DataFrame:
    """auc, se (Hanley and McNeil) from bin, n_in, n_out, bins in order; with ``by``, of each histogram."""
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    down = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    x = bins.withColumn("above", F.coalesce(F.sum("n_out").over(up), F.lit(0))).withColumn("below", F.coalesce(F.sum("n_in").over(down), F.lit(0)))
    a, n, b, m = (F.col(c).cast("double") for c in ("above", "n_out", "below", "n_in"))  # products of three counts pass the range of longs
    g = x.groupBy(*by).agg(
        F.sum(m * a + 0.5 * m * n).alias("w"), F.sum(m).alias("ni"), F.sum(n).alias("no"),
        F.sum(m * (a * a + a * n + n * n / 3)).alias("q2"), F.sum(n * (b * b + b * m + m * m / 3)).alias("q1"),
    )
    auc, q1, q2 = F.col("w") / (F.col("ni") * F.col("no")), F.col("q1") / (F.col("no") * F.col("ni") * F.col("ni")), F.col("q2") / (F.col("ni") * F.col("no") * F.col("no"))
    se = F.sqrt((auc * (1 - auc) + (F.col("ni") - 1) * (q1 - auc * auc) + (F.col("no") - 1) * (q2 - auc * auc)) / (F.col("ni") * F.col("no")))
    return g.select(*by, auc.alias("auc"), se.alias("se"))


def curve_auc(bins: DataFrame) -> DataFrame:
    """auc by trapezoids under the shares reached bin by bin, from the first bin on. ``bins``: bin, n_in, n_out, a few rows."""
    w, to = Window.partitionBy(), Window.orderBy("bin")
    x = bins.select("bin", (F.sum("n_in").over(to) / F.sum("n_in").over(w)).alias("tpr"), (F.sum("n_out").over(to) / F.sum("n_out").over(w)).alias("fpr"))
    step = (F.col("fpr") - F.lag("fpr").over(to)) * (F.col("tpr") + F.lag("tpr").over(to)) / 2
    return x.select(step.alias("area")).agg(F.sum("area").alias("auc"))


def label_distance_test(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``distance_test`` of the distances of a table of pairs. ``labels``: item, label."""
    return distance_test(label_counts(pairs, labels))


def label_counts(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """d, n_in, n_out, n: pairs of one label, of different labels, and all, by distance."""
    side = lambda k: labels.select(F.col("item").alias(k), F.col("label").alias("l" + k))
    same = F.col("li") == F.col("lj")
    return pairs.join(side("i"), "i").join(side("j"), "j").groupBy("d").agg(F.count(F.when(same, 1)).alias("n_in"), F.count(F.when(~same, 1)).alias("n_out"), F.count("*").alias("n"))


def distance_test(counts: DataFrame) -> DataFrame:
    """metric, u, p: Mann-Whitney's test of distances within labels (each pair once) against those between labels (both ways).

    The metric is 1 less the root of u over both numbers of distances. Ranks come from the counts of distinct distances (see ``label_counts``).
    """
    up = F.col("d").asc_nulls_last()
    upto = running(in_order(counts.withColumn("n_out", 2 * F.col("n_out")), up), [up], sums={"below": F.col("n_out")})
    real = lambda c: F.col(c).cast("double")
    t = real("n_in") + real("n_out")
    g = upto.agg(F.sum(real("n_in") * (real("below") - real("n_out") / 2)).alias("u"), F.sum(real("n_in")).alias("k"), F.sum(real("n_out")).alias("m"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("k") + F.col("m")
    # u counts how often a distance between labels lies below one within.
    sd = F.sqrt(F.col("k") * F.col("m") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), F.abs(F.col("u") - F.col("k") * F.col("m") / 2) - 0.5) / F.nullif(sd, F.lit(0.0))
    p = F.least(F.lit(1.0), 2 * normal_upper_tail(z))
    return g.select((1 - F.sqrt("u") / F.col("k") / F.col("m")).alias("metric"), "u", p.alias("p"))


def distance_histogram(pairs: DataFrame, labels: DataFrame, bins: int) -> DataFrame:
    """bin, n_in, n_out: pairs within and between clusters by rank of their distance, in equally filled bins."""
    named = pairs.join(labels.select(F.col("item").alias("i"), F.col("label").alias("a")), "i").join(labels.select(F.col("item").alias("j"), F.col("label").alias("b")), "j")
    binned = placed_rows(named, "d", "i", "j").withColumn("bin", F.floor((F.col("_r") - 1) * bins / F.col("_m")).cast("int"))
    return binned.groupBy("bin").agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("n_in"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_out"))


def filled_histogram(points: DataFrame, bins: int, label: str = "label") -> DataFrame:
    """``distance_histogram`` of all pairs of points (item, vec, label), which are counted, not listed.

    Counts by the first digits of distances say which cells of equal digits hold an edge between two bins; only
    these cells, fewer than bins, are looked at by distance and first point, and where an edge lies among pairs
    of one distance and first point, those by their second.
    """
    part = lambda a, n: F.floor((a - 1) * bins / n)
    up = F.col("cell").asc_nulls_last()
    placed = running(in_order(tiles.digit_counts(points, label), up), [up], sums={"_upto": F.col("n")})
    total = placed.agg(F.sum("n")).first()[0]
    if total is None:
        return placed.select(F.lit(0).alias("bin"), "n_in", "n_out")
    low, high = part(F.col("_upto") - F.col("n") + 1, F.lit(total)), part(F.col("_upto"), F.lit(total))
    placed = settled(placed.select("cell", "n_in", "n_out", "n", "_upto", low.alias("bin"), high.alias("_high")))
    done = placed.where("bin = _high").select("bin", "n_in", "n_out")
    held = placed.where("bin <> _high").orderBy("_upto").collect()  # fewer than bins
    if held:
        cells, before = [r["cell"] for r in held], 0
        base = {}
        for r in held:
            base[r["cell"]] = r["_upto"] - r["n"] - before
            before += r["n"]
        shift = F.coalesce(*[F.when(F.col("cell").eqNullSafe(F.lit(c)), F.lit(b)) for c, b in base.items()])
        groups = tiles.digit_pairs(points, label, cells).groupBy("cell", "d", "i").agg(*[F.sum(c).alias(c) for c in ("n_in", "n_out", "n")])
        order = [F.col("d").asc_nulls_last(), F.col("i").asc()]
        ranked = running(in_order(groups, *order), order, sums={"_upto": F.col("n")}).withColumn("_upto", F.col("_upto") + shift)
        first = F.col("_upto") - F.col("n") + 1
        ranked = settled(ranked.select("cell", "d", "i", "n_in", "n_out", first.alias("_first"), part(first, F.lit(total)).alias("bin"), part(F.col("_upto"), F.lit(total)).alias("_high")))
        done = done.unionByName(ranked.where("bin = _high").select("bin", "n_in", "n_out"))
        split = ranked.where("bin <> _high").select(F.col("d").alias("_d"), F.col("i").alias("_i"), "_first")
        firsts = [r["_i"] for r in split.select("_i").distinct().collect()]  # fewer than bins
        if firsts:
            single = tiles.digit_pairs(points, label, cells, firsts)
            mine = single.join(split, F.col("d").eqNullSafe(F.col("_d")) & (F.col("i") == F.col("_i")))
            place = F.col("_first") - 1 + F.row_number().over(Window.partitionBy("d", "i").orderBy("j"))  # as many rows as points
            done = done.unionByName(mine.select(part(place, F.lit(total)).alias("bin"), "n_in", "n_out"))
    return done.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def _filled(items: Column, fraction: float) -> Column:
    """How many ranks a bin takes, from the number of items."""
    return F.bround(items * fraction) + 1


def rank_histogram(pairs: DataFrame, labels: DataFrame, fraction: float = 0.1) -> DataFrame:
    """``ranked_counts`` of the distances of a table of pairs. ``labels``: item, label."""
    return ranked_counts(label_counts(pairs, labels), labels, fraction)


def ranked_counts(counts: DataFrame, labels: DataFrame, fraction: float = 0.1) -> DataFrame:
    """bin, n_in, n_out: pairs within and between labels by average rank of their distance, ``fraction`` of the number of items and one to a bin, the first bin from rank 0."""
    up = F.col("d").asc_nulls_last()
    upto = running(in_order(counts, up), [up], sums={"_upto": F.col("n")})
    rank = F.col("_upto") - (F.col("n") - 1) / 2.0
    size = labels.agg(_filled(F.count("*"), fraction).alias("_l"))
    binned = upto.crossJoin(F.broadcast(size)).select(F.floor(rank / F.col("_l")).cast("long").alias("bin"), "n_in", "n_out")  # one row
    none = labels.agg(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n_in"), F.lit(0).cast("long").alias("n_out"))
    return binned.unionByName(none).groupBy("bin").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def immersiveness(neighbours: DataFrame, labels: DataFrame, fraction: float = 0.1) -> DataFrame:
    """item, auc, se: how well small distance from an item tells its own label, itself included. ``neighbours``: i, j, d, both ways."""
    itself = labels.select(F.col("item").alias("i"), F.col("item").alias("j"), F.lit(0.0).alias("d"))
    side = lambda k: labels.select(F.col("item").alias(k), F.col("label").alias("l" + k))
    named = neighbours.select("i", "j", "d").unionByName(itself).join(side("i"), "i").join(side("j"), "j")
    size = labels.agg(_filled(F.count("*"), fraction).alias("_l"))
    binned = named.withColumn("_rank", average_rank("d", "i")).crossJoin(F.broadcast(size)).withColumn("bin", F.floor(F.col("_rank") / F.col("_l")))  # one row
    bins = binned.groupBy(F.col("i").alias("item"), "bin").agg(F.count(F.when(F.col("li") == F.col("lj"), 1)).alias("n_in"), F.count(F.when(F.col("li") != F.col("lj"), 1)).alias("n_out"))
    return histogram_auc(bins, "item")


def immersiveness_of_points(points: DataFrame, label: str = "label", fraction: float = 0.1) -> DataFrame:
    """``immersiveness`` by distances, rounded to 6 decimals, of all pairs of points (item, vec, label)."""
    size = points.agg(_filled(F.count("*"), fraction)).first()[0]
    return histogram_auc(tiles.ranked_bins(points, label, float(size)), "item")


def segments(points: DataFrame, radius: float = 0.0, turn: float = 0.0, centers: int = 4, merged: bool = False) -> DataFrame:
    """item, label: points (item, x, y), turned about the origin, by rounded angle and by whether they lie outside a radius.

    With ``merged`` all points inside the radius are one segment.
    """
    x, y = F.col("x") * math.cos(turn) - F.col("y") * math.sin(turn), F.col("x") * math.sin(turn) + F.col("y") * math.cos(turn)
    angle = F.bround(F.atan2(x, y) / math.pi / 2 * centers)
    part = F.when(F.abs(angle) < math.sqrt(centers), angle).otherwise(F.abs(angle)).cast("long")
    out = F.when(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) > radius, 1).otherwise(0)
    both = with_totals(points.select("item", part.alias("_p"), out.alias("_o")), _least=F.min("_p"), _parts=F.count_distinct("_p"))
    label = (F.col("_p") - F.col("_least") + 1) * F.col("_o") if merged else F.col("_p") - F.col("_least") + F.col("_o") * F.col("_parts")
    return both.select("item", label.alias("label"))


def happiness(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """item, happiness: the share of neighbours (i, j) with the item's own label."""
    named = neighbours.join(labels.select(F.col("item").alias("i"), F.col("label").alias("a")), "i").join(labels.select(F.col("item").alias("j"), F.col("label").alias("b")), "j")
    return named.groupBy(F.col("i").alias("item")).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("happiness"))


def label_share(labels: DataFrame) -> DataFrame:
    """item, happiness without neighbours: the share of all items with the item's label."""
    return labels.select("item", (F.count("*").over(Window.partitionBy("label")) / F.count("*").over(Window.partitionBy())).alias("happiness"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """Overlap counts of two labelings."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))
