"""What the operators of this subpackage share: tables, the shared folder, word patterns, hashes."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what lies between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark deletes the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    if root not in sys.path:
        sys.path.insert(0, root)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in tests on one machine, a temporary folder
    is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cohortal-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cohortal-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None, *by: str) -> DataFrame:
    """The same rows, cut off from their lineage: written as Parquet to the shared folder and read back.

    What was shuffled for them is deleted at once. Spark would keep it until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    out = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (out.partitionBy(*by) if by else out).parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(folder)


def whole_texts(texts: pa.Array) -> pa.Array:
    """Texts as a large-string array of their own, null as empty. Arrow's splitting functions misread slices of another array."""
    return pc.fill_null(texts.take(pa.array(range(len(texts)), pa.int64())).cast(pa.large_string()), "")


def blocks(batch: pa.RecordBatch, at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text in column ``at``, a text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy())
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def unit_hash(*cols: Column | str) -> Column:
    """A number in (0, 1) drawn by hash from columns; the same on each run."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of a text's UTF-8 bytes."""
    return F.crc32(text.cast("binary"))
