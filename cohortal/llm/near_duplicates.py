"""Near-duplicate documents: MinHash bands find candidates, odd sketches rank them, full sets confirm.

Texts with the same set of shingles are one class from the start. MinHash samples
of a class are banded, and folded into an odd sketch: a bitmap in which each
sample flips one bit, so that the population count of the XOR of two sketches
estimates how many samples differ. Most buckets hold one class; a first pass with
short ids leaves them out. In a bucket, members that sketches call alike
are joined to a forest, never emitted as all pairs, and each edge is confirmed on
full sets. If all hold, the forest connects what can be linked. Where an edge does
not hold and its ends are still apart, the bucket's members come together once
more with their full sets, and those outside its largest component are held
against all others, exactly; only links leave the task. Buckets with the same
members come together once, and a lone pair that failed not at all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.shared import blocks, table, whole_texts, written

SHINGLE = 5
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair at the threshold shares no band with probability (1 - 0.75**4)**32, about 5 in a million.
BANDS, ROWS = 32, 4
#: Bits of a sketch; at the threshold two sketches differ in about 50 bits, 7 more or less: ALIKE is five times that above.
SKETCH_BITS, ALIKE = 256, 86
#: Members that differ from a bucket's leader in at most so many bits are taken with it at once.
STRONG = 40
#: The first bands' edges are tested first; they form nearly all components.
FIRST_BANDS = 8
#: Edges that one task joins at most, about 150 MB; larger graphs are joined by rounds of all tasks.
SMALL_GRAPH = 500_000
#: Bytes of text whose sets are made at a time.
BLOCK_BYTES = 4_000_000
#: Bits of the filter of classes whose sets are read again.
FILTER_BITS = 1 << 26

_RNG = np.random.default_rng(20240601)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_SCALE = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; none for null or wordless texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole_texts(texts)))
    words = lists.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = words.filter(pa.array(real)).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy()] if len(coded) else hashes
    n = max(0, len(h) - SHINGLE + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        grams += _mix(h[k : k + n] * _PLACE[k])
    grams = _mix(grams)
    out = []
    for a, b in zip(starts, starts[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            few = np.uint64(b - a)
            for k in range(b - a):
                few = few + _mix(h[a + k : a + k + 1] * _PLACE[k])
            out.append(_mix(few))
        else:
            out.append(h[:0])
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """A class's name: a 128-bit digest of its set, so that even among 10**12 classes no two are likely to share one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row for each set; sets must not be empty."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat((flat ^ _FLIP[i]) * _SCALE[i], begin)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as rows of 64-bit words."""
    bit = (_mix(samples + _FLIP) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.add.at(flips, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(flips & 1, axis=1).view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each band; its lowest bits are the band's number."""
    grouped = samples.reshape(len(samples), BANDS, ROWS)
    key = np.zeros(grouped.shape[:2], np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(31) + grouped[:, :, k])
    return (key - key % np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ one).sum(1).astype(np.int64)


def bucket_forest(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect all members which chains of alike sketches connect.

    A leader takes what is strongly like it; then each member outside the largest
    tree is compared with all others. Near copies of one text cost one comparison
    each, whatever the bucket's size.
    """
    m = len(sketches)
    tree = np.full(m, -1)
    edges = []
    for i in range(m):
        if tree[i] < 0:
            rest = np.flatnonzero(tree < 0)
            near = rest[_apart(sketches[i], sketches[rest]) <= STRONG]
            tree[near] = i
            edges += [(i, int(j)) for j in near if j != i]
    largest = np.bincount(tree).argmax()
    for i in np.flatnonzero(tree != largest):
        others = np.flatnonzero(tree != tree[i])
        apart = _apart(sketches[i], sketches[others])
        alike = others[np.argsort(apart, kind="stable")][: (apart <= ALIKE).sum()]
        for j in alike:
            if tree[i] != tree[j]:
                edges.append((int(i), int(j)))
                tree[tree == tree[j]] = tree[i]
    return edges


def bucket_links(sets: list[np.ndarray], components: np.ndarray) -> list[tuple[int, int]]:
    """Links on full sets between members of different components, one for each member outside the largest and each other component."""
    names, at, size = np.unique(components, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    lens = np.array([len(s) for s in sets])
    begin = np.cumsum(lens) - lens
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mine, links = np.zeros(len(values), np.int32), []
    for i in np.flatnonzero(at != size.argmax()):
        own = ids[begin[i] : begin[i] + lens[i]]
        mine[own] = 1
        both = np.add.reduceat(mine[ids], begin)
        mine[own] = 0
        linked = np.flatnonzero((100 * both >= PERCENT * (lens + lens[i] - both)) & (at != at[i]))
        links += [(int(i), int(linked[k])) for k in np.unique(at[linked], return_index=True)[1]]
    return links


def profile(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, key (null for an empty set), sketch, bands and the ``carry`` columns for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1, BLOCK_BYTES):
                sets = shingle_sets(batch.column(1))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, marks, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    samples = signatures([sets[i] for i in full])
                    for i, mark, band in zip(full, odd_sketches(samples), band_keys(samples)):
                        keys[i], marks[i], bands[i] = set_key(sets[i]), mark.tobytes(), band
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *columns], ["doc_id", *carry, "n_shingles", "key", "sketch", "bands"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    return docs.select("doc_id", "text", *carry).mapInArrow(run, f"{kinds}, n_shingles bigint, key binary, sketch binary, bands array<bigint>")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables that hold whole buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != bucket[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = len(bucket) - int((bucket[::-1] != bucket[-1]).argmax()) if bucket[0] != bucket[-1] else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _ranges(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])


def _edges(bucket: np.ndarray, key: pa.ChunkedArray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """Pairs of rows as edges between their keys, the lesser first."""
    i, j = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    x, y = (key.take(pa.array(at)).combine_chunks() for at in (i, j))
    ordered = pc.less(x, y)
    return pa.RecordBatch.from_arrays([pa.array(bucket[i]), pc.if_else(ordered, x, y), pc.if_else(ordered, y, x)], ["bucket", "a", "b"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, id to the rows of buckets with two members or more."""
    for rows in _buckets(batches):
        starts, ends = _ranges(rows["bucket"].to_numpy())
        yield from rows.filter(pa.array(np.repeat(ends - starts > 1, ends - starts))).to_batches()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, key, sketch to the edges of each bucket's forest."""
    for rows in _buckets(batches):
        bucket = rows["bucket"].to_numpy()
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(bucket), -1)
        starts, ends = _ranges(bucket)
        a = starts[ends - starts == 2]
        a = a[np.bitwise_count(sketch[a] ^ sketch[np.minimum(a + 1, len(bucket) - 1)]).sum(1) <= ALIKE]
        pairs = list(zip(a.tolist(), (a + 1).tolist()))
        for k in np.flatnonzero(ends - starts > 2):
            pairs += [(int(starts[k]) + i, int(starts[k]) + j) for i, j in bucket_forest(sketch[starts[k] : ends[k]])]
        yield _edges(bucket, rows["key"], pairs)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, key, component, shingles to the links between components of each bucket."""
    for rows in _buckets(batches):
        bucket = rows["bucket"].to_numpy()
        component = rows["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
        pairs = []
        for a, b in zip(*_ranges(bucket)):
            pairs += [(int(a) + i, int(a) + j) for i, j in bucket_links(sets[a:b], component[a:b])]
        yield _edges(bucket, rows["key"], pairs)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph, in one task, to node and least node."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "component"])


def components(links: DataFrame, small: int | None = None) -> DataFrame:
    """node, component (its least node) of the graph with edges (a, b).

    A graph of at most ``small`` edges (SMALL_GRAPH) is joined in one task; a larger one by
    alternating large and small stars. Both give the same rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= (SMALL_GRAPH if small is None else small):
        kind = edges.schema["u"].dataType.simpleString()
        return written(edges.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = written(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, shingles of the wanted classes. Texts are read again; a filter of fixed size spares most others the way."""
    spark = docs.sparkSession
    bit = F.crc32("key") % FILTER_BITS
    words = wanted.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).toArrow()
    filter_ = np.zeros(FILTER_BITS // 64, np.int64)
    filter_[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(filter_.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        done: set[bytes] = set()
        for whole in batches:
            for batch in blocks(whole, 0, BLOCK_BYTES):
                keys, sets = [], []
                for s in shingle_sets(batch.column(0)):
                    if len(s):
                        key = set_key(s)
                        at = zlib.crc32(key) % FILTER_BITS
                        if int(have[at // 64]) >> (at % 64) & 1 and key not in done:
                            done.add(key)
                            keys.append(key)
                            sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    found = docs.select("text").mapInArrow(run, "key binary, shingles binary").join(wanted, "key", "left_semi")
    return written(found.groupBy("key").agg(F.first("shingles").alias("shingles")))


def _looked_at(members: DataFrame) -> DataFrame:
    """bucket, key of the buckets to look at again. Two members alone are the edge that failed; buckets with the same members, told by 128 bits, count once."""
    members = written(members.distinct())
    alike = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    return members.join(alike.where("n > 2").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")), "bucket", "left_semi")


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = (), small_graph: int | None = None) -> DataFrame:
    """The near-duplicate component of every document.

    ``docs``: doc_id and text; other columns are not read, but those in ``carry`` come along. Words are lower-cased in
    ASCII; the set of a text is its distinct 5-word shingles, or all its words as
    one if there are fewer. Returns doc_id, those columns, n_shingles, component
    (its name in this run; null without shingles), component_id (the least doc_id
    linked with it by a chain of links) and kept (whether it is that
    document). Null, empty and wordless texts have no shingles and stand alone.
    Repeated rows are copies: linked, and kept alike if their id is the least.
    Null ids are linked but name no component unless no other id is in it. An
    empty table gives no rows.
    """
    rows = written(profile(docs, carry))
    classes = written(rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    n = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    schema = "bucket bigint, a binary, b binary"
    # Most buckets hold one class, so the first pass deals out short ids; classes that share an id are only held against each other in vain.
    id_ = F.xxhash64("key").alias("id")
    met = dealt(classes.select(F.explode("bands").alias("bucket"), id_)).mapInArrow(_met, "bucket bigint, id bigint")
    members = written(met.join(classes.select(id_, "key", "sketch"), "id").select("bucket", "key", "sketch"))
    candidates = written(dealt(members).mapInArrow(_forests, schema))
    wanted = candidates.select(F.col("a").alias("key")).unionByName(candidates.select(F.col("b").alias("key"))).distinct()
    sets = _sets(docs, wanted)

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("two")), "b")
        return written(both.select("a", "b", "one", "two").mapInArrow(_confirmed, "a binary, b binary, linked boolean"))

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        for end in ("a", "b"):
            pairs = pairs.join(label.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
        return pairs.where("_a <> _b").drop("_a", "_b")

    number = F.pmod(F.col("bucket"), F.lit(BANDS))
    tested = confirm(candidates.where(number < FIRST_BANDS).select("a", "b").distinct())
    label = components(tested.where("linked"), small_graph)
    more = confirm(apart(candidates.where(number >= FIRST_BANDS).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), label))
    tested = written(tested.unionByName(more))
    label = components(tested.where("linked"), small_graph)
    # Where an edge failed and its ends are still apart, full sets decide between all components of the bucket.
    failed = tested.where(~F.col("linked")).select("a", "b")
    again = apart(candidates.join(failed, ["a", "b"], "left_semi"), label).select("bucket").distinct()
    held = written(_looked_at(members.select("bucket", "key").join(again, "bucket", "left_semi").join(sets.select("key"), "key", "left_semi")))
    held = held.join(label.select(F.col("node").alias("key"), "component"), "key", "left").join(sets, "key").select("bucket", "key", F.coalesce("component", "key").alias("component"), "shingles")
    more = written(dealt(held).mapInArrow(_links, schema).select("a", "b").distinct())
    if not more.isEmpty():
        label = components(tested.where("linked").select("a", "b").unionByName(more), small_graph)

    named = rows.select("doc_id", *carry, "n_shingles", "key").join(label.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key"))
    # Written, so that the join deals out both sides itself and a large component's rows can be split.
    least = written(named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = named.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", *carry, "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("component")
