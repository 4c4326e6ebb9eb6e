"""Scoring of documents by prediction by partial matching over bytes.

A trie of byte contexts of at most ORDER bytes is counted over the training
documents. A byte is coded in its longest known context; a byte new to it costs an
escape (method C: the share of distinct bytes) and is coded in the next shorter
context, from which the bytes seen in the longer ones are excluded. Workers hold
the trie as arrays: the code length of a byte seen in its full context is one hash
lookup, and only contexts that meet a new byte are worked out. Memory for the trie
is a parameter (TRIE_NODES); beyond it workers hold the code lengths of the most
frequent leaves, and all others are worked out once each from the counts of all
orders and joined, with the same scores. ``adaptive_digits`` codes one text with a
trie that grows as it reads.

A second, word-level score counts training words over the whole corpus. Frequent
words, a number of bounded size, go to the workers; counts of all others are joined.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.shared import blocks, table, whole_texts, written

#: Words that are sent to workers at most; the counts of others are joined.
FREQUENT_WORDS = 1 << 20
#: Bytes of context, and leaves of the trie (contexts with a next byte) that workers hold at most; others are joined.
ORDER, TRIE_NODES = 4, 6_000_000
#: Bytes of text counted and scored at a time.
COUNT_BYTES, SCORE_BYTES = 6_000_000, 2_000_000
#: Folds by crc32 of the id as text; this one is held out.
FOLDS, HELD_OUT = 5, 1
END = -1  # the gram under which documents are counted


def _code_lengths(levels: list[np.ndarray]) -> np.ndarray:
    """Code lengths, in decimal digits, of all 256 bytes (columns) in some contexts (rows), from the counts of each order, the highest first."""
    shape = levels[0].shape
    cost, escaped, done = np.zeros(shape), np.zeros((shape[0], 1)), np.zeros(shape, bool)
    for counts in levels:
        level = np.where(done, 0, counts)
        seen = level > 0
        q = seen.sum(1, keepdims=True)
        total = np.maximum(level.sum(1, keepdims=True) + q, 1)
        cost = np.where(seen, escaped + np.log10(total) - np.log10(np.maximum(level, 1)), cost)
        done |= seen
        escaped = escaped + np.where((q > 0) & ~done.all(1, keepdims=True), np.log10(total) - np.log10(np.maximum(q, 1)), 0)
    left = np.maximum(256 - done.sum(1, keepdims=True), 1)
    return np.where(done, cost, escaped + np.log10(left))


class Held:
    """An open-addressing table of the code lengths (``digits``) of distinct grams."""

    def __init__(self, keys: np.ndarray, digits: np.ndarray):
        self.bits = max(10, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.digits = np.zeros(1 << self.bits)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for a slot the last stays
            in_ = self.keys[slots] == keys
            self.digits[slots[in_]] = digits[in_]
            keys, digits, slots = keys[~in_], digits[~in_], (slots[~in_] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code length of each gram, 0 for those that are not held, and where those are."""
        out = np.zeros(len(grams))
        rest, slots = np.arange(len(grams)), self._slots(grams)
        new = []
        while len(rest):
            held = self.keys[slots]
            hit, miss = held == grams[rest], held < 0
            out[rest[hit]] = self.digits[slots[hit]]
            new.append(rest[miss])
            on = ~(hit | miss)
            rest, slots = rest[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out, np.concatenate(new) if new else rest


class Trie(Held):
    """A trained trie as arrays. ``grams``: distinct numbers of ORDER + 1 bytes, first byte highest; ``counts``: how often."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER, -1, -1):
            keys, at = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(keys))
            contexts, begin = np.unique(keys >> 8, return_index=True)
            self.levels.append((contexts, np.append(begin, len(keys)), (keys & 255).astype(np.int16), n))
        # In the table: bytes seen in their full context.
        contexts, begin, symbols, n = self.levels[0]
        width = np.diff(begin)
        total = np.add.reduceat(n, begin[:-1]) + width if len(n) else n
        super().__init__(np.repeat(contexts, width) << 8 | symbols, np.log10(np.repeat(total, width)) - np.log10(n))

    def _dense(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Counts of all 256 bytes in each of some contexts."""
        contexts, begin, symbols, n = self.levels[level]
        out = np.zeros((len(keys), 256))
        at = np.minimum(np.searchsorted(contexts, keys), max(0, len(contexts) - 1))
        have = np.flatnonzero(contexts[at] == keys) if len(contexts) else np.zeros(0, int)
        width = begin[at[have] + 1] - begin[at[have]] if len(have) else np.zeros(0, int)
        spots = np.repeat(begin[at[have]] - np.cumsum(width) + width, width) + np.arange(width.sum())
        out[np.repeat(have, width), symbols[spots]] = n[spots]
        return out

    def _rows(self, contexts: np.ndarray) -> np.ndarray:
        """Code lengths, in decimal digits, of all 256 bytes in each of some full contexts."""
        return _code_lengths([self._dense(i, contexts & ((1 << 8 * (ORDER - i)) - 1)) for i in range(ORDER + 1)])

    def digits_of(self, grams: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each number behind its other bytes."""
        out, new = self.find(grams)
        contexts, at = np.unique(grams[new] >> 8, return_inverse=True)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(0, len(contexts) + 512, 512))
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            rows, some = self._rows(contexts[i * 512 : (i + 1) * 512]), order[a:b]
            out[new[some]] = rows[at[some] - i * 512, grams[new[some]] & 255]
        return out


def adaptive_digits(text: str | None, order: int = ORDER) -> float:
    """Code length of a text in decimal digits, by a trie that starts empty and learns each byte after coding it."""
    data = (text or "").encode()
    trie: dict[bytes, Counter] = defaultdict(Counter)
    total = 0.0
    for i, byte in enumerate(data):
        excluded: set[int] = set()
        for k in range(min(order, i), -1, -1):
            seen = {b: c for b, c in trie[data[i - k : i]].items() if b not in excluded}
            if seen:
                n = sum(seen.values()) + len(seen)
                if byte in seen:
                    total -= math.log10(seen[byte] / n)
                    break
                excluded |= seen.keys()
                if len(excluded) < 256:
                    total -= math.log10(len(seen) / n)
        else:
            total += math.log10(256 - len(excluded))
        for k in range(min(order, i) + 1):
            trie[data[i - k : i]][byte] += 1
    return total


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of all texts with the ORDER bytes before it (zeros before a text) as a number; where each text's begin, and the end."""
    lens = pc.binary_length(texts).to_numpy()
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join(pad + t.encode() for t in texts.to_pylist()), np.uint8)
    gram = np.zeros(max(0, len(data) - ORDER), np.int64)
    for k in range(ORDER + 1):
        gram <<= 8
        gram |= data[k : k + len(gram)]
    starts = np.concatenate([[0], np.cumsum(lens)])
    at = np.arange(starts[-1]) + np.repeat(np.arange(len(lens)) * ORDER, lens)
    return gram[at], starts


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, lower-cased in ASCII, and where each text's words begin (with the end of all)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return words.filter(pa.array(real)), starts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (word), of contexts with a next byte (gram) and of documents (gram END) of the training rows."""
    names = ["word", "gram", "n"]
    for batch in (block for whole in batches for block in blocks(whole, 0, COUNT_BYTES)):
        texts = whole_texts(batch.column(0))
        counted = _words(texts)[0].value_counts()
        yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), pa.nulls(len(counted), pa.int64()), counted.field(1)], names)
        counted = pa.array(_grams(texts)[0]).value_counts()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(counted), pa.string()), *counted.flatten()], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([END]), pa.array([len(texts)])], names)


def train(texts: DataFrame) -> DataFrame:
    """Training counts of a one-column table of texts: word, gram (one of both is null), n."""
    rows = texts.mapInArrow(_counted, "word string, gram bigint, n bigint")
    return written(rows.groupBy("word", "gram").agg(F.sum("n").alias("n")))


def held_out(doc_id: Column) -> Column:
    """Whether an id's fold is held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _least_count(counts: DataFrame, most: int) -> int:
    """The least n such that at most ``most`` rows have n or more."""
    up_to = F.sum("rows").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_count = counts.groupBy("n").agg(F.count("*").alias("rows")).withColumn("up_to", up_to)
    return by_count.where(F.col("up_to") <= most).agg(F.min("n")).first()[0] or 1 << 62


def _seen_lengths(grams: DataFrame) -> DataFrame:
    """gram, n, digits: the code length of every byte seen in its full context, from the counts (gram, n) of all leaves."""
    context = F.shiftright("gram", 8)
    total = grams.groupBy(context.alias("context")).agg((F.sum("n") + F.count("*")).alias("total"))
    return grams.withColumn("context", context).join(total, "context").select("gram", "n", (F.log10("total") - F.log10("n")).alias("digits"))


def _new_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code lengths of bytes new to their full contexts: of rows context, bytes, and for each order its bytes (s) and their counts (n)."""
    for whole in batches:
        for batch in (whole.slice(a, 512) for a in range(0, len(whole), 512)):
            levels = []
            for k in range(ORDER, -1, -1):
                counts = np.zeros((len(batch), 256))
                for r, level in enumerate(batch.column(f"level{k}")):
                    if level.is_valid:
                        counts[r, level.values.field("s").to_numpy()] = level.values.field("n").to_numpy()
                levels.append(counts)
            rows = _code_lengths(levels)
            wanted = batch.column("bytes").to_pylist()
            at, byte = np.repeat(np.arange(len(batch)), [len(w) for w in wanted]), np.array([b for w in wanted for b in w], int)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("context").to_numpy()[at] << 8 | byte), pa.array(rows[at, byte])], ["gram", "digits"])


def _lengths(wanted: DataFrame, grams: DataFrame, seen: DataFrame) -> DataFrame:
    """gram, digits of each distinct gram in ``wanted``: joined if seen in training, else worked out from the counts of its contexts of all orders."""
    found = written(wanted.join(seen.select("gram", "digits"), "gram", "left"))
    new = found.where("digits IS NULL").groupBy(F.shiftright("gram", 8).alias("context")).agg(F.collect_set(F.col("gram").bitwiseAND(255).cast("int")).alias("bytes"))
    counts = grams.select("gram", "n")
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            counts = written(counts.groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n")))
        pair = F.struct(F.col("gram").bitwiseAND(255).cast("int").alias("s"), "n")
        level = counts.groupBy(F.shiftright("gram", 8).alias(f"key{k}")).agg(F.collect_list(pair).alias(f"level{k}"))
        # At most 257 rows have a byte of context or none.
        new = new.withColumn(f"key{k}", F.col("context").bitwiseAND((1 << 8 * k) - 1)).join(F.broadcast(level) if k < 2 else level, f"key{k}", "left").drop(f"key{k}")
    return found.where("digits IS NOT NULL").unionByName(new.mapInArrow(_new_lengths, "gram bigint, digits double"))


_tables: dict[str, Held] = {}


def _held(name: str, whole: bool, grams: np.ndarray, values: np.ndarray) -> Held:
    """The worker's table: a trie from the counts of the ``whole`` training, or code lengths of a part; the last one used is kept."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = (Trie if whole else Held)(grams, values)
    return _tables[name]


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Scores of every document by what ``train`` counted.

    ``docs``: doc_id and text; other columns are not read. Returns doc_id,
    n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (word-level log10 probability) and score (log10
    probability of the text's bytes). Null and empty texts are one end token and
    score 0; ids may be null or repeated, each row is scored alone; without any
    training row every byte costs log10(256) and known counts are 0.
    """
    spark = docs.sparkSession
    words = training.where(F.col("word").isNotNull()).select("word", "n")
    leaves = training.where(F.col("gram") >= 0).select("gram", "n")
    documents, n_leaves = training.agg(F.coalesce(F.sum(F.when(F.col("gram") == END, F.col("n"))), F.lit(0)), F.count(F.when(F.col("gram") >= 0, 1))).first()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = int(sums[0]) + documents, int(sums[1]) + (documents > 0)
    whole = tokens + 0.5 * (distinct + 1)

    least_word, trie_fits = _least_count(words, FREQUENT_WORDS), n_leaves <= TRIE_NODES
    frequent = words.where(F.col("n") >= least_word).toArrow()
    seen = None if trie_fits else written(_seen_lengths(leaves))
    grams = (leaves if trie_fits else seen.where(F.col("n") >= _least_count(leaves, TRIE_NODES)).select("gram", "digits")).toArrow()
    sent = spark.sparkContext.broadcast((frequent["word"].combine_chunks(), np.log10((frequent["n"].to_numpy() + 0.5) / whole), grams.column(0).to_numpy(), grams.column(1).to_numpy()))
    name = uuid.uuid4().hex
    end = math.log10((documents + 0.5) / whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = sent.value[:2]
        held = _held(name, trie_fits, *sent.value[2:])
        for batch in (block for whole in batches for block in blocks(whole, 1, SCORE_BYTES)):
            texts = whole_texts(batch.column(1))
            gram, begin = _grams(texts)
            lengths, unheld = (held.digits_of(gram), np.zeros(0, int)) if trie_fits else held.find(gram)
            unheld = np.sort(unheld)
            unheld_grams = pa.ListArray.from_arrays(pa.array(np.searchsorted(unheld, begin), pa.int32()), pa.array(gram[unheld]))
            digits = np.concatenate([[0.0], np.cumsum(lengths)])
            spent = digits[begin[1:]] - digits[begin[:-1]]
            tokens_, starts = _words(texts)
            coded = tokens_.dictionary_encode()
            found = pc.index_in(coded.dictionary.cast(known.type), known)
            spot = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, int)
            value = np.where(spot >= 0, logs[spot], 0.0) if len(logs) else np.zeros(len(spot))
            n = np.diff(starts)
            base = [float(value[a:b].sum()) for a, b in zip(starts, starts[1:])]
            have = np.concatenate([[0], np.cumsum(spot >= 0)])
            rest = np.flatnonzero(spot < 0)
            cuts = np.searchsorted(rest, starts)
            others = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), tokens_.take(pa.array(rest)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n + 1), pa.array(have[starts[1:]] - have[starts[:-1]]), pa.array(base, pa.float64()), others, pa.array(-spent), unheld_grams],
                ["doc_id", "n_tokens", "n_frequent", "base", "others", "score", "unheld"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_frequent bigint, base double, others array<string>, score double, unheld array<bigint>")
    part = written(part.withColumn("row", F.monotonically_increasing_id()))
    counts = words.where(F.col("n") < least_word)
    others = part.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times")).join(counts, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(whole))
    others = others.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_more"))
    joined = part.drop("others", "unheld").join(others, "row", "left")
    if not trie_fits:
        unheld = part.select("row", F.explode("unheld").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("times"))
        spent = unheld.join(_lengths(unheld.select("gram").distinct(), leaves, seen), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("digits")).alias("spent"))
        joined = joined.join(spent, "row", "left").withColumn("score", F.col("score") - F.coalesce("spent", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_more", F.lit(0)) + F.lit(int(documents > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end)).alias("base_score"), "score",
    )


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by what the folds that aren't held out teach."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs.where(~held_out(F.col("doc_id"))).select("text")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
