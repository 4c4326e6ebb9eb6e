"""Sharding along a Hilbert curve over several metadata dimensions (DataFrame functions only).

Dimensions are quantised to equally filled cells, each group of equal texts gets the
index of its cell on the curve, groups are ordered by that index, and the order is
cut into runs of near equal size. Groups near each other on the curve are alike in
every dimension, so a reader prunes files by the ranges of any of them.

The order is never made in one task: sums over curve cells, then over slices of a
cell, then over groups of a slice, then over slices of a group by id, then rows in
such a slice give each row its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from cohortal.llm.shared import table, text_crc32, written
from cohortal.operators.order import in_order, running

#: Bits for each dimension on the curve; slices of a cell by text hash, and of a group by id.
BITS = 5
TEXT_SLICES = 4096
ID_SLICES = 64


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(next state, digit) of the n-dimensional Hilbert curve for each state and corner of a cell.

    A state is the corner at which the curve enters and the axis along which it
    leaves; entry (state * 2**n + corner) follows from Gray codes.
    """
    full = (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & full

    def ones(x: int) -> int:
        return 0 if not x & 1 else 1 + ones(x >> 1)

    follow, digit = [], []
    for state in range(n << n):
        enter, axis = state // n, state % n
        for corner in range(1 << n):
            gray = turn(corner ^ enter, n - (axis + 1) % n)
            w = gray
            for s in range(1, n):
                w ^= gray >> s
            first = 0 if w == 0 else ((w - 1) // 2 * 2) ^ ((w - 1) // 2)
            along = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
            follow.append((enter ^ turn(first, axis + 1)) * n + (axis + along + 1) % n)
            digit.append(w)
    return follow, digit


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of a point whose coordinates are integers of ``bits`` bits."""
    n = len(cells)
    follow, digit = curve_tables(n)
    follow_at, digit_at = F.array(*map(F.lit, follow)), F.array(*map(F.lit, digit))

    def step(at: Column, level: Column) -> Column:
        corner = F.lit(0)
        for k, cell in enumerate(cells):
            corner = corner + F.getbit(cell.cast("long"), level).cast("int") * (1 << k)
        entry = at["state"] * (1 << n) + corner + 1
        return F.struct(F.element_at(follow_at, entry).alias("state"), (at["index"] * (1 << n) + F.element_at(digit_at, entry)).alias("index"))

    levels = F.array(*map(F.lit, range(bits - 1, -1, -1)))
    return F.aggregate(levels, F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index")), step, lambda at: at["index"])


def category_cells(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Each value of a column, null included, with the cell of its middle row when rows are ordered by value. Values may be many."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows"))
    total = F.broadcast(counts.agg(F.sum("rows").alias("total")))  # one row
    ranked = running(in_order(counts, column), [column], sums={"upto": F.col("rows")}).crossJoin(total)
    return ranked.select(F.col(column).alias(f"{column}_value"), F.floor((F.col("upto") - F.col("rows") / 2) * (1 << bits) / F.col("total")).cast("int").alias(f"{column}_cell"))


def _earlier(column: str, within: WindowSpec) -> Column:
    """Sum of a column over the rows before a row."""
    return F.coalesce(F.sum(column).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shard(docs: DataFrame, n_shards: int = 8, categories: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """Shards of near equal bytes along the curve over ``categories`` and text size.

    ``docs``: doc_id, text and the category columns; other columns are not read.
    A row's size is its text's UTF-8 bytes (null: none) plus 1. Returns doc_id,
    size, text_crc32 (null text: crc of nothing, 0), hilbert, shard, slot (gapless
    from 0, in order of the curve). Rows of equal texts (null counts as empty) are
    a group: it lies where its least categories are, and in one shard. A shard
    differs from an equal share by less than its largest group at either end. Only
    a group larger than an equal share is cut, so that sizes stay near equal. Order
    in a cell: slices of text hash, then text hash; in a group: slices of id, then
    id; rows equal in all of these are interchangeable, so repeated rows get slots
    of their own. Null categories are values like others; an empty table gives no
    rows.
    """
    text = F.coalesce("text", F.lit(""))
    slim = written(
        docs.select(
            "doc_id",
            *[F.col(c).alias(f"dim_{k}") for k, c in enumerate(categories)],
            (F.octet_length(text) + 1).cast("long").alias("size"),
            text_crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
        )
    )
    dims = [f"dim_{k}" for k in range(len(categories))]
    own = ("text_key", "text_crc32", "size")
    # A group's part: its rows of one slice of ids.
    parts = slim.groupBy(*own, F.pmod(F.xxhash64("doc_id"), F.lit(ID_SLICES)).cast("int").alias("part")).agg(F.count("*").alias("rows"), F.min(F.struct(*dims)).alias("dims"))
    parts = written(parts)
    groups = parts.groupBy(*own).agg(F.sum("rows").alias("rows"), F.min("dims").alias("dims")).select(*own, "rows", (F.col("rows") * F.col("size")).alias("bytes"), "dims.*")
    cuts = groups.agg(F.percentile_approx("size", [k / (1 << bits) for k in range(1, 1 << bits)], 10_000).alias("cuts")).first()["cuts"] or []
    cells = [F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("size"))), F.lit(0)) if cuts else F.lit(0)]
    for c in dims:
        groups = groups.join(category_cells(slim, c, bits), F.col(c).eqNullSafe(F.col(f"{c}_value"))).drop(f"{c}_value")
        cells.append(F.col(f"{c}_cell"))
    groups = written(groups.select(*own, "rows", "bytes", hilbert_index(cells, bits).alias("hilbert"), F.pmod(F.xxhash64("text_key", "text_crc32"), F.lit(TEXT_SLICES)).cast("int").alias("slice")))

    slices = groups.groupBy("hilbert", "slice").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    curve = slices.groupBy("hilbert").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    along = Window.orderBy("hilbert")  # a row a cell of the curve
    curve = curve.select("hilbert", _earlier("bytes", along).alias("bytes_0"), _earlier("rows", along).alias("rows_0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("hilbert").orderBy("slice")
    slices = slices.select("hilbert", "slice", _earlier("bytes", within).alias("bytes_1"), _earlier("rows", within).alias("rows_1")).join(curve, "hilbert")
    inside = Window.partitionBy("hilbert", "slice").orderBy("text_key", "text_crc32", "size")
    groups = groups.withColumns({"bytes_2": _earlier("bytes", inside), "rows_2": _earlier("rows", inside)}).join(slices, ["hilbert", "slice"])
    begin = F.col("bytes_0") + F.col("bytes_1") + F.col("bytes_2")
    groups = groups.select(*own, "hilbert", begin.alias("begin"), "bytes", "total", (F.col("rows_0") + F.col("rows_1") + F.col("rows_2")).alias("first"))

    of_group = Window.partitionBy(*own).orderBy("part")
    parts = parts.withColumn("rows_3", _earlier("rows", of_group)).drop("rows", "dims").join(groups, list(own))
    order = Window.partitionBy(*own, "part").orderBy(F.col("doc_id").asc_nulls_first())
    rows = slim.select("doc_id", *own, F.pmod(F.xxhash64("doc_id"), F.lit(ID_SLICES)).cast("int").alias("part")).withColumn("rows_4", F.row_number().over(order) - 1)
    rows = rows.join(parts, [*own, "part"])
    nth = F.col("rows_3") + F.col("rows_4")
    share = F.col("total") / n_shards
    middle = F.when(F.col("bytes") > share, F.col("begin") + (nth + 0.5) * F.col("size")).otherwise(F.col("begin") + F.col("bytes") / 2)
    placed = written(
        rows.select(
            "doc_id", "size", "text_crc32", "hilbert",
            F.least(F.floor(middle / share), F.lit(n_shards - 1)).cast("int").alias("shard"),
            (F.col("first") + nth).alias("place"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "hilbert", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, files_per_shard: int = 8, **options) -> DataFrame:
    """Write the whole documents under ``path``, a folder for each shard, rows in order of slot. Returns what ``shard`` does.

    Each shard is cut into ``files_per_shard`` runs of slots, so that no task writes a
    whole shard. Nulls, empty and long texts, ties, repeated rows and an empty table
    are treated as by ``shard``; columns named shard or slot give way to the shard's,
    all others are handed on.
    """
    placed = written(shard(docs, n_shards, **options))
    again = Window.partitionBy("doc_id", "text_crc32").orderBy("slot")
    keyed = placed.withColumn("copy", F.row_number().over(again)).withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "text_crc32", "copy", "size", "hilbert")})
    most = placed.agg(F.max("slot")).first()[0] or 0
    texts = docs.withColumn("_crc", text_crc32(F.coalesce("text", F.lit(""))))
    texts = texts.drop("shard", "slot").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_crc").orderBy(F.xxhash64("text"))))
    joined = texts.join(keyed, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_crc") == F.col("_text_crc32")) & (F.col("_n") == F.col("_copy")))
    run = F.floor(F.col("slot") * files_per_shard / (most + 1)).cast("int")
    joined = joined.drop("_crc", "_n", "_doc_id", "_text_crc32", "_copy", "_size", "_hilbert").withColumn("_run", run)
    joined.repartition(n_shards * files_per_shard, "shard", "_run").sortWithinPartitions("shard", "slot").drop("_run").write.partitionBy("shard").parquet(path)
    return placed


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes along the curve."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
