"""Images in long form (image, i, j, value): grids, equalisation, blurring and texture, each a join on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.functions.numeric import average_rank


def sized(cells: DataFrame, image: str = "image") -> DataFrame:
    """Adds ``_n`` and ``_m``, the rows and columns of each image; places count from 0."""
    shape = cells.groupBy(image).agg((F.max("i") + 1).alias("_n"), (F.max("j") + 1).alias("_m"))
    return cells.join(shape, image)


def centred_grid(cells: DataFrame, image: str = "image", height: float | None = None, width: float | None = None) -> DataFrame:
    """Adds ``y`` and ``x``: places from the middle of the image, over its height and width or the lengths given."""
    middle = lambda at, n: F.col(at) - F.floor(F.col(n) / 2)
    y = middle("i", "_n") / (F.col("_n") if height is None else F.lit(height))
    return sized(cells, image).withColumns({"y": y, "x": middle("j", "_m") / (F.col("_m") if width is None else F.lit(width))}).drop("_n", "_m")


def accentuated(cells: DataFrame, image: str = "image", value: str = "value", raised: bool = True) -> DataFrame:
    """Adds ``accent``: average rank over half more than the largest rank, spread by 2 (exp - 1) if ``raised``."""
    ranked = cells.withColumn("_rank", average_rank(value, image))
    share = F.col("_rank") / (F.max("_rank").over(Window.partitionBy(image)) + 0.5)
    return ranked.withColumn("accent", 2 * (F.exp(share) - 1) if raised else share).drop("_rank")


def _offsets(reach: int, last: bool) -> Column:
    """All (di, dj) but (0, 0) from -reach up to reach, which is left out unless ``last``."""
    side = range(-reach, reach + last)
    return F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in side for b in side if a or b]))


def neighbour_blurred(cells: DataFrame, image: str = "image", value: str = "value", reach: int = 1) -> DataFrame:
    """Adds ``blurred``: every cell gives each neighbour an equal share of the mean of itself and its nearest-valued neighbour.

    Neighbours lie up to ``reach`` rows and columns away within the image; of
    equally near ones the first by row and column counts. A cell without neighbours keeps its value.
    """
    own = cells.select(image, F.col("i").alias("_ci"), F.col("j").alias("_cj"), F.col(value).alias("_c"))
    sent = own.select("*", _offsets(reach, True).alias("_o")).withColumns({"i": F.col("_ci") + F.col("_o.di"), "j": F.col("_cj") + F.col("_o.dj")})
    met = cells.select(image, "i", "j", F.col(value).alias("_v")).join(sent, [image, "i", "j"])
    near = F.min_by("_v", F.struct(F.pow(F.col("_v") - F.col("_c"), 2), "i", "j"))
    given = met.groupBy(image, "_ci", "_cj").agg(F.collect_list(F.struct("i", "j")).alias("_at"), (0.5 * (near + F.first("_c"))).alias("_mean"))  # (2 reach + 1)^2 at most
    shares = given.select(image, (F.col("_mean") / F.size("_at")).alias("_share"), F.explode("_at").alias("_a"))
    received = shares.groupBy(image, F.col("_a.i").alias("i"), F.col("_a.j").alias("j")).agg(F.sum("_share").alias("_sum"))
    return cells.join(received, [image, "i", "j"], "left").withColumn("blurred", F.col(value) + F.coalesce("_sum", F.lit(0.0))).drop("_sum")


def texture(cells: DataFrame, image: str = "image", value: str = "value", reach: int = 3, raised: bool = True) -> DataFrame:
    """image, i, j, texture: how like the squared differences of accentuated values are to the squared lengths of shifts.

    For each shift from -reach up to reach - 1 a cell is held against the one that the shift,
    going round the image's borders, puts upon it. With a (the squared difference over the
    variance) and b (the squared length over reach squared), the shift adds 2 sqrt(ab) / (a + b) to
    the cell that lies the shift away, if that is in the image. Every cell of the image must be there.
    """
    accent = sized(accentuated(cells, image, value, raised), image).withColumn("_variance", F.var_pop("accent").over(Window.partitionBy(image)))
    own = accent.select(image, "_n", "_m", "i", "j", "accent", "_variance", _offsets(reach, False).alias("_o"))
    shifted = own.withColumns({"_si": F.pmod(F.col("i") - F.col("_o.di"), F.col("_n")), "_sj": F.pmod(F.col("j") - F.col("_o.dj"), F.col("_m"))})
    other = accent.select(image, F.col("i").alias("_si"), F.col("j").alias("_sj"), F.col("accent").alias("_other"))
    a = F.pow(F.col("_other") - F.col("accent"), 2) / F.nullif(F.col("_variance"), F.lit(0.0))
    b = (F.col("_o.di") * F.col("_o.di") + F.col("_o.dj") * F.col("_o.dj")) / float(reach * reach)
    added = shifted.join(other, [image, "_si", "_sj"]).select(image, "_n", "_m", (F.col("i") + F.col("_o.di")).alias("i"), (F.col("j") + F.col("_o.dj")).alias("j"), (2 * F.sqrt(a * b) / (a + b)).alias("_x"))
    inside = added.where("i >= 0 AND i < _n AND j >= 0 AND j < _m")
    return inside.groupBy(image, "i", "j").agg(F.sum("_x").alias("texture"))
