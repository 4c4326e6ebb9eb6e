"""Quality rules whose cutoffs come from the documents: quantile sketches per language and source.

Features of whole texts are summed up in mergeable quantile sketches, one for each
(lang, source): counts of values in buckets whose bounds grow by a fixed factor, so
that a quantile is off by ACCURACY of itself at most and sketches merge by adding
counts, with the same result in any order. A group too small to judge itself takes
the merged sketch of its language, and a small language that of all documents. A feature's cutoff is an
outer fence, the upper quartile plus a multiple of the spread between quartiles;
documents are joined with their group's cutoffs and filtered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.shared import table, written

# Fixed characters: those between words, and those that count as symbols.
_BETWEEN = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Feature: (spreads above the upper quartile, least spread). The least spread keeps a group
#: in which nearly all documents have the same value from failing the few that differ a little.
FENCES = {
    "symbols_per_word": (4.0, 0.05),
    "marks_per_word": (5.0, 0.1),
    "upper_share": (5.0, 0.05),
    "dup_line_share": (4.0, 0.05),
    "repeat_share": (4.0, 0.04),
}
#: Documents from which on a group is judged by its own sketch.
LEAST_GROUP = 100
#: Largest relative error of a quantile.
ACCURACY = 0.005


def text_features(text: str | None) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks of a whole text; 0 for null."""
    if not text:
        return (0,) * 8
    words = text.encode().split()  # bytes split at exactly the six characters
    chars = len(text) - sum(map(text.count, _BETWEEN))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BETWEEN)]
    repeated = 0
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(grams)) < len(grams):
        seen: set = set()
        again = {g for g in grams if g in seen or seen.add(g)}
        end = 0
        for i, g in enumerate(grams):
            if g in again:
                repeated += i + 5 - max(i, end)
                end = i + 5
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, text.count("!") + text.count("?")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the counts of ``text_features`` and their shares, for each row of ``docs``.

    Columns in ``carry`` come along unchanged.
    """
    names = ["doc_id", "lang", "source", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t.as_py()) for t in batch.column(0)]
            counts = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts], [*names, *COUNTS])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    counted = docs.select(F.col("text").alias("_text"), *names).mapInArrow(run, f"{kept}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.withColumns(
        {
            "symbols_per_word": per("n_symbols", "n_words"),
            "marks_per_word": per("n_marks", "n_words"),
            "upper_share": per("n_upper", "word_chars"),
            "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"),
        }
    )


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, feature, bucket (null: the value 0), n: the sketch of each feature in each group. ``rows``: what ``features`` returns."""
    growth = math.log((1 + ACCURACY) / (1 - ACCURACY))
    bucket = lambda c: F.when(F.col(c) > 0, F.ceil(F.ln(c) / growth).cast("int"))
    long = rows.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), bucket(c).alias("bucket")) for c in FENCES])))
    return long.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """``by``, n and, for each feature, low and high (its quartiles) of merged sketches."""
    merged = sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*by, "feature")
    upto = F.sum("n").over(within.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = merged.withColumns({"upto": upto, "whole": F.sum("n").over(within)})
    growth = (1 + ACCURACY) / (1 - ACCURACY)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(growth), F.col("bucket")) / (1 + growth))
    at = lambda c, q: F.min(F.when((F.col("feature") == c) & (F.col("upto") > q * (F.col("whole") - 1)), value))
    return ranked.groupBy(*by).agg(F.max("whole").alias("n"), *[F.struct(at(c, 0.25).alias("low"), at(c, 0.75).alias("high")).alias(c) for c in FENCES])


def cutoffs(rows: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """lang, source and a cutoff for each feature, from merged sketches. ``rows``: what ``features`` returns.

    Values are counted where rows are, so a group that holds a third of all rows
    costs no task more than others; a sketch has a few thousand buckets at most.
    """
    sketch = written(sketches(rows))
    names = list(FENCES)
    own = quartiles(sketch, "lang", "source")
    by_lang = quartiles(sketch, "lang").select(F.col("lang").alias("lang_key"), F.struct("n", *names).alias("wide"))
    overall = quartiles(sketch).select(F.struct("n", *names).alias("all"))  # one row
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_key"))).crossJoin(F.broadcast(overall))
    best = lambda c: F.when(F.col("n") >= least_group, F.col(c)).when(F.col("wide.n") >= least_group, F.col(f"wide.{c}")).otherwise(F.col(f"all.{c}"))
    fence = lambda c, k, least: best(c)["high"] + k * F.greatest(best(c)["high"] - best(c)["low"], F.lit(least))
    return joined.select(F.col("lang").alias("cut_lang"), F.col("source").alias("cut_source"), *[fence(c, k, x).alias(f"{c}_most") for c, (k, x) in FENCES.items()])


def judge(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Counts and verdict for each document.

    ``docs``: doc_id, text, lang, source; other columns are not read. Returns the
    counts, base_failed (fewer than 10 words, or over a fifth of the words in
    repeated 5-word windows), reasons (features over their cutoffs) and kept
    (neither base_failed nor a reason). Null and empty texts have no words and
    fail; null languages and sources are groups like others; repeated rows are
    judged alike and each kept in the result; an empty table gives no rows.
    """
    rows = written(features(docs))
    return _judged(rows, cutoffs(rows, least_group))


def _judged(rows: DataFrame, cut: DataFrame) -> DataFrame:
    joined = rows.join(cut, F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    reasons = F.array_compact(F.array(*[F.when(F.col(c) > F.col(f"{c}_most"), F.lit(c)) for c in FENCES]))
    out = joined.withColumn("base_failed", failed).withColumn("reasons", reasons)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("cut_lang", "cut_source")


def kept_documents(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps.

    Texts are read twice, once for the sketches and once for the verdicts, and
    never shuffled. Nulls, empty and long texts, repeated rows and empty tables are
    treated as by ``judge``; other columns, whatever their names, are handed on.
    """
    cut = written(cutoffs(written(features(docs)), least_group))  # its size is known now, so that texts need no shuffle
    again = docs.select("doc_id", "lang", "source", "text", *[F.col(c).alias(f"_in_{c}") for c in docs.columns])
    kept = _judged(features(again, tuple(f"_in_{c}" for c in docs.columns)), cut).where("kept")
    return kept.select([F.col(f"_in_{c}").alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS[:5], "base_failed", "kept", "reasons")
