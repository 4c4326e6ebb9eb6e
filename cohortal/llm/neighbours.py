"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index is cut into
segments of vectors drawn by hash. Each segment is stored with its inverted files,
one for each pivot: which of its vectors have the pivot among their nearest, and at
which place. A query reads only the files of its own nearest pivots and adds up how
far each vector's places are from its own (Spearman's footrule, absent pivots
counting as last); the best of each segment are measured on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.shared import table, written

#: Vectors from which pivots are chosen (a bounded sample); pivots, nearest pivots in whose files a vector is
#: posted, files that a query reads, and share of a segment that is measured.
SAMPLE, PIVOTS, POSTED, READ, MEASURED = 2048, 256, 128, 64, 0.1
#: Rows of a segment and places in an order, as stored.
ROW, PLACE = np.dtype("<u2"), np.dtype("u1")
#: Vectors of a segment on average, and bytes of queries sent to all segments at once.
SEGMENT, QUERY_BYTES = 8192, 8 << 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Of a sample the first vector, then always the one farthest from those chosen: a crowd of like vectors gives few pivots."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """For each vector its ``near`` nearest pivots, nearest first; ties to the smaller number."""
    far = (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :near].astype(np.int16)


def inverted_files(orders: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the rows that have it in their order, ascending, and its place there."""
    n, near = orders.shape
    by_pivot = np.argsort(orders.ravel(), kind="stable")
    ends = np.searchsorted(orders.ravel()[by_pivot], np.arange(n_pivots + 1))
    return [((by_pivot[a:b] // near).astype(np.int32), (by_pivot[a:b] % near).astype(np.int16)) for a, b in zip(ends, ends[1:])]


def footrule(files: list[tuple[np.ndarray, np.ndarray]], pivots: np.ndarray, n: int, near: int) -> np.ndarray:
    """Footrule between a query's first pivots, nearest first, and the orders of ``n`` rows, from the files of those pivots alone."""
    total = np.full(n, int(sum(near - place for place in range(len(pivots)))), np.int32)
    for place, pivot in enumerate(pivots):
        rows, places = files[pivot]
        total[rows] += np.abs(places - place) - (near - place)
    return total


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _component(vectors: DataFrame) -> str:
    """How a vector's components are stored: as they are."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


_INDEX = "ids array<array<bigint>>, vectors binary, rows array<binary>, places array<binary>"


def build_index(vectors: DataFrame, pivots: np.ndarray, posted: int, segment: int = SEGMENT) -> DataFrame:
    """Write a row for each segment of ``vectors`` (ids, embedding): its ids and vectors, and for each pivot the rows posted and their places."""
    segments = max(1, round(vectors.count() / segment))
    size, component = pivots.shape[1], _component(vectors)
    if posted > 256:
        raise ValueError("a vector is posted in the files of 256 pivots at most")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("first")
        x = _matrix(rows["embedding"].combine_chunks(), size)
        if len(x) > 1 << 16:
            raise ValueError("a segment has too many vectors for its row numbers")
        files = inverted_files(nearest_pivots(x, pivots, posted), len(pivots))
        ids = pa.array([rows["ids"].to_pylist()], pa.list_(pa.list_(pa.int64())))
        lists = [pa.array([[f[k].astype(kind).tobytes() for f in files]], pa.list_(pa.binary())) for k, kind in enumerate((ROW, PLACE))]
        return pa.Table.from_arrays([ids, pa.array([x.astype(component).tobytes()], pa.binary()), *lists], ["ids", "vectors", "rows", "places"])

    dealt = vectors.select("ids", F.col("ids")[0].alias("first"), "embedding", F.pmod(F.xxhash64("embedding"), F.lit(segments)).alias("segment"))
    return written(dealt.groupBy("segment").applyInArrow(run, _INDEX))


_HITS = "query_id bigint, vec_id bigint, score double"


def _measured(queries: tuple[np.ndarray, np.ndarray, np.ndarray], component: str, posted: int, k: int, share: float):
    """Of each segment and query the ``k`` nearest rows among the best ``share`` by footrule."""
    asked, points, orders = queries
    size = points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, rows, places in zip(*batch.columns):
                ids = ids.as_py()
                x = np.frombuffer(vectors.as_buffer(), component).reshape(-1, size).astype(np.float64)
                files = [(np.frombuffer(a.as_buffer(), ROW), np.frombuffer(b.as_buffer(), PLACE).astype(np.int16)) for a, b in zip(rows.values, places.values)]
                take = max(k + 1, int(np.ceil(len(x) * share)))
                out: list[list] = [[], [], []]
                for q, point, order in zip(asked.tolist(), points, orders):
                    chosen = np.argsort(footrule(files, order, len(x), posted), kind="stable")[:take]
                    far = np.sqrt(((x[chosen] - point) ** 2).sum(1))
                    best = np.argsort(far, kind="stable")[: k + 1]
                    # Vectors at the same distance as the last one taken stay: their ids decide.
                    best = np.flatnonzero(far <= far[best[-1]])
                    found = sorted((far[i], v) for i in best for v in ids[chosen[i]] if v != q)[:k]
                    out[0] += [q] * len(found)
                    out[1] += [v for _, v in found]
                    out[2] += [d for d, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _search(ready: DataFrame, size: int, k: int, n_pivots: int, posted: int, read: int, measured: float) -> list[DataFrame]:
    """The parts of the result for the vectors with ``size`` components."""
    # Copies of a vector are as near as it is: the k + 1 least ids of each decide, and it is posted once.
    copies = ready.select("vec_id", "embedding").distinct().withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = written(copies.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    sample = distinct.select("embedding").orderBy(F.xxhash64("embedding", F.lit(11)), "embedding").limit(max(SAMPLE, n_pivots)).collect()  # of bounded size
    pivots = spread_pivots(np.array([r[0] for r in sample], np.float64), n_pivots)
    posted = min(posted, len(pivots))
    index = build_index(distinct, pivots, posted)
    asking = ready.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    block, parts = [], []

    def flush() -> None:
        ids, points = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
        run = _measured((ids, points, nearest_pivots(points, pivots, min(read, posted))), _component(ready), posted, k, measured)
        hits = index.mapInArrow(run, _HITS).withColumn("rank", rank).where(F.col("rank") <= k)
        parts.append(written(hits.select("query_id", "rank", "vec_id", "score")))
        block.clear()

    for row in asking.toLocalIterator():  # the stated queries against all rows, in blocks
        block.append(row)
        if len(block) * size * 8 >= QUERY_BYTES:
            flush()
    if block:
        flush()
    return parts


def search(vectors: DataFrame, queries: Column, k: int = 10, n_pivots: int = PIVOTS, posted: int = POSTED, read: int = READ, measured: float = MEASURED) -> DataFrame:
    """The ``k`` nearest of all rows found for each query row.

    ``vectors``: vec_id, embedding; other columns are not read. ``queries``: which
    rows ask. A row takes part if its id is not null and its vector is ``usable``;
    vectors with other numbers of components are other spaces, each searched by an
    index of its own. Rows with a query's id are the query's own; of several such
    query rows one, the least by value, asks; rows equal in id and vector count
    once. Returns query_id, rank (from 1), vec_id, score (Euclidean distance in
    double precision on the original vectors), ties to the smaller vec_id. Fewer
    than ``k`` candidates: all of them; no query or empty table: no rows.
    """
    spark = vectors.sparkSession
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = [r[0] for r in ready.where("asks").select(F.size("embedding")).distinct().collect()]  # a row a number of components
    parts = [p for size in sorted(sizes) for p in _search(ready.where(F.size("embedding") == size), size, k, n_pivots, posted, read, measured)]
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if not parts else parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def op10_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every embedding whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
