"""The corpus pipeline: from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.mixing import label_weights, mix
from cohortal.llm.near_duplicates import near_duplicates
from cohortal.llm.packing import pack
from cohortal.llm.quality import kept_documents
from cohortal.llm.secrets import redact
from cohortal.llm.shared import shared_folder, ship, table, written
from cohortal.llm.tokens import vocabulary_path


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for more columns, of which no column of the documents has any."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _known(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a hash of their text: rows with the same id and hash are the same document."""
    return docs.withColumn(name, F.coalesce(F.xxhash64("text"), F.lit(0)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the quality rules keep.

    Null, empty and very short texts are rejected; whole texts are read, however
    long; null languages and sources are groups like others; equal rows are judged
    alike and all kept or none; an empty table gives no rows; other columns,
    whatever their names, are handed on.
    """
    ship(spark)
    return kept_documents(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the least id (null ids last, then the least hash of its text).

    Null, empty and wordless texts have no duplicates and stay; rows equal in id and
    text are one document, of which one row stays; an empty table gives no rows;
    other columns, whatever their names, are handed on.
    """
    ship(spark)
    hash_, id_, known = _fresh(docs, "text_hash", "first_id", "known_hash")
    rows = _known(docs, hash_)
    found = near_duplicates(rows, carry=(hash_,)).select("doc_id", hash_, "component")
    # Without shingles a document stands alone; of others the first of each component stays.
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", hash_)).alias("m")).select("m.doc_id", f"m.{hash_}")
    first = first.unionByName(found.where("component IS NULL").select("doc_id", hash_)).distinct().select(F.col("doc_id").alias(id_), F.col(hash_).alias(known))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(known)), "left_semi")
    return kept.dropDuplicates(["doc_id", hash_]).select(docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced.

    Null and empty texts stay as they are; whole texts are read, however long; all
    rows stay, equal ones are changed alike; an empty table gives no rows; other
    columns, whatever their names, are handed on.
    """
    ship(spark)
    return redact(docs).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stands in it as often as it is taken, whole each time.

    Documents without words, so also null and empty texts, add nothing to a mix and
    are left out; the null source is a source of its own; documents of equal weight
    are told apart by a draw from their id and text, so that reruns agree; rows
    equal in id, text and source share their copies, the first ones taking what is
    over; an empty table gives no rows; other columns, whatever their names, are
    handed on.
    """
    ship(spark)
    hash_, copies, n_rows, times, copy = _fresh(docs, "text_hash", "copies", "n_rows", "times", "copy")
    t_id, t_hash, t_source = _fresh(docs, "t_id", "t_hash", "t_source")
    rows = _known(docs, hash_)
    taken = mix(rows, label_weights(table(spark, sf_dir, "labels")), boundary="nearest", carry=(hash_,))
    whole = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    shared = taken.groupBy(F.col("doc_id").alias(t_id), F.col(hash_).alias(t_hash), F.col("source").alias(t_source)).agg(F.sum(whole).alias(copies), F.count("*").alias(n_rows)).where(F.col(copies) > 0)
    same = [F.col("doc_id").eqNullSafe(F.col(t_id)), F.col(hash_) == F.col(t_hash), F.col("source").eqNullSafe(F.col(t_source))]
    joined = rows.join(shared, reduce(and_, same))
    nth = F.row_number().over(Window.partitionBy(t_id, t_hash, t_source).orderBy(F.lit(1)))
    share = F.floor(F.col(copies) / F.col(n_rows)) + (nth <= F.col(copies) % F.col(n_rows)).cast("long")
    out = joined.withColumn(times, share).where(F.col(times) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Null and empty texts are their end id; very long texts are cut into pieces;
    equal rows and null ids are documents of their own; an empty table gives no
    rows; other columns are not read.
    """
    ship(spark)
    return pack(docs, vocabulary_path("byte_bpe_50k.json"))


#: Name and function of each stage, in order.
STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_removal),
    ("secret_scans", secret_redaction),
    ("source_mixing", source_mixing),
    ("best_fit_packing", sequence_packing),
]

#: SQL cannot state these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{base}/{i}")
    return docs
