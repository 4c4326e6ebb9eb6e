"""Content-addressed store of token ids.

A rolling hash over ids cuts each document's id stream into chunks at places that
depend on the ids alone, so equal passages give equal chunks. A chunk is known by
the digest of its bytes and stored once, with its owner: the first document, in
order of id, that holds it. Documents keep recipes, lists of digests.

Layout under a store's path, all Parquet:

``documents``  one row a document, in ascending order of id over the files:
    doc_id, row (unique), part (file), local_start (ids before it in its part),
    n_tokens, lens (ids in each chunk), flags (0 owned, 1 owned and used elsewhere,
    2 owned by another), digests (16 bytes a chunk), root (Merkle root of the
    digests), body (owned chunks, joined and compressed; ids little-endian, of
    the store's width)
``manifest``   one row a part: part, start (ids before it), n_tokens, n_documents,
    width, root (Merkle root of its documents' roots)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.shared import shared_folder, table, written
from cohortal.llm.tokens import encoder, vocabulary_path

#: The rolling hash sees WINDOW ids; a chunk has LEAST to MOST ids, about LEAST + 2**BITS on average.
WINDOW, BITS, LEAST, MOST = 8, 8, 64, 2048
DIGEST = 16
OWNED, LENT, FOREIGN = 0, 1, 2


def mixed(ids: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each id, by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_NUMBERS = mixed(np.arange(1 << 16))


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """At each id, the sum over the last WINDOW ids of their number shifted by their distance."""
    h = _NUMBERS[ids] if not len(ids) or ids.max() < len(_NUMBERS) else mixed(ids)
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    return h


def chunk_lengths(ids: np.ndarray) -> list[int]:
    """Lengths of the chunks of one document's ids; none for no ids."""
    marks = np.flatnonzero(rolling_hash(ids) >> np.uint64(64 - BITS) == 0) + 1
    lens, last = [], 0
    for cut in [*marks.tolist(), len(ids)]:
        while cut - last > MOST:
            lens.append(MOST)
            last += MOST
        if cut - last >= LEAST or (cut == len(ids) and cut > last):
            lens.append(cut - last)
            last = cut
    return lens


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over digests; an odd one moves up; no leaves: the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def encode(docs: DataFrame, vocabulary: str, keeps_space: bool, end_id: int | None, width: int) -> DataFrame:
    """doc_id, n_tokens, lens, digests, body (all chunks) for each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (squeeze, _) = encoder(vocabulary, keeps_space), _codec()
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for ids in enc.encode(batch.column(1)):
                ids = np.concatenate([ids, end])
                if len(ids) and int(ids.max()) >> 8 * width:
                    raise ValueError(f"id {ids.max()} is wider than the {width} bytes that the store keeps")
                data, lens = ids.astype(f"<u{width}").tobytes(), chunk_lengths(ids)
                ends = np.cumsum([0, *lens]) * width
                for out, x in zip(rows, (len(ids), lens, b"".join(digest(data[a:b]) for a, b in zip(ends, ends[1:])), squeeze.compress(data))):
                    out.append(x)
            n, lens, digests, body = rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lens, pa.list_(pa.int32())), pa.array(digests, pa.binary()), pa.array(body, pa.binary())], ["doc_id", "n_tokens", "lens", "digests", "body"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, lens array<int>, digests binary, body binary")


def _owned_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each document behind its marks, to documents without the chunks that others own."""
    squeeze, loose = _codec()
    part, start, marks = TaskContext.get().partitionId(), 0, ([], [])
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("doc_id", "row", "local_start", "n_tokens", "lens", "flags", "digests", "root", "body")}
        for r in batch.to_pylist():
            if r["body"] is None:
                marks = (r["foreign"], r["lent"])
                continue
            flags = [OWNED] * len(r["lens"])
            for i in marks[0]:
                flags[i] = FOREIGN
            for i in marks[1]:
                flags[i] = LENT
            body = r["body"]
            if marks[0]:
                data = loose.decompress(body)
                width = len(data) // r["n_tokens"]
                ends = np.cumsum([0, *r["lens"]]) * width
                body = squeeze.compress(b"".join(data[a:b] for a, b, f in zip(ends, ends[1:], flags) if f != FOREIGN))
            root = merkle_root([r["digests"][i : i + DIGEST] for i in range(0, len(r["digests"]), DIGEST)])
            for c, x in (("doc_id", r["doc_id"]), ("row", r["row"]), ("local_start", start), ("n_tokens", r["n_tokens"]), ("lens", r["lens"]), ("flags", bytes(flags)), ("digests", r["digests"]), ("root", root), ("body", body)):
                out[c].append(x)
            start += r["n_tokens"]
            marks = ([], [])
        kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array(x, k) for x, k in zip(out.values(), kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(columns[0]), pa.int32())], [*out, "part"])


def _part_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle_root(x) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.binary())], ["part", "n_tokens", "n_documents", "root"])


def part_roots(stored: DataFrame) -> DataFrame:
    """part, n_tokens, n_documents and the Merkle root of the documents' roots, in order. A part holds the documents of one task; of each only the root is gathered."""
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"), F.sort_array(F.collect_list(F.struct("local_start", "row", "root"))).alias("r"))
    return parts.select("part", "n_tokens", "n_documents", F.col("r.root").alias("roots")).mapInArrow(_part_root, "part int, n_tokens bigint, n_documents bigint, root binary")


def write_store(docs: DataFrame, path: str, vocabulary: str, keeps_space: bool = False, end_id: int | None = 2, width: int = 2) -> None:
    """Encode whole texts and write the store.

    ``docs``: doc_id and text; other columns are not read. Null and empty texts
    hold the end id alone, or nothing without one. Null ids come first; repeated
    ids are documents of their own, in any order among them; an empty table gives a
    store without documents. ``width``: bytes of an id, 2 or 4.
    """
    spark = docs.sparkSession
    staged = written(encode(docs, vocabulary, keeps_space, end_id, width).withColumn("row", F.monotonically_increasing_id()))
    count = (F.length("digests") / DIGEST).cast("int")
    places = staged.where(count > 0).select("doc_id", "row", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"), "digests")
    places = places.select("doc_id", "row", "i", F.substring(F.col("digests"), F.col("i") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))
    first = F.struct("doc_id", "row", "i")
    often = places.groupBy("digest").agg(F.min(first).alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = places.join(often, "digest")
    owner = (F.col("owner.row") == F.col("row")) & (F.col("owner.i") == F.col("i"))
    marks = shared.groupBy("doc_id", "row").agg(F.collect_list(F.when(~owner, F.col("i"))).alias("foreign"), F.collect_list(F.when(owner, F.col("i"))).alias("lent"))
    ordered = staged.unionByName(marks, allowMissingColumns=True).repartitionByRange(F.col("doc_id").asc_nulls_first(), "row")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row", F.col("body").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    final = ordered.mapInArrow(_owned_only, f"doc_id {kind}, row bigint, local_start bigint, n_tokens bigint, lens array<int>, flags binary, digests binary, root binary, body binary, part int")
    final.write.option("compression", "none").parquet(f"{path}/documents")
    stored = spark.read.parquet(f"{path}/documents")

    parts = part_roots(stored)
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    parts.withColumns({"start": before, "width": F.lit(width)}).coalesce(1).write.parquet(f"{path}/manifest")


def _chunks(flags: bytes, lens: list[int], data: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """Places and bytes of the chunks that a body holds."""
    at = 0
    for i, (flag, n) in enumerate(zip(flags, lens)):
        if flag != FOREIGN:
            yield i, data[at : at + n * width]
            at += n * width


def _lent_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, loose = _codec()
    for batch in batches:
        keys, chunks = [], []
        for flags, lens, digests, body, width in zip(*(c.to_pylist() for c in batch.columns)):
            for i, chunk in _chunks(flags, lens, loose.decompress(body), width):
                if flags[i] == LENT:
                    keys.append(digests[i * DIGEST : (i + 1) * DIGEST])
                    chunks.append(chunk)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of whole documents from owned and borrowed chunks; a chunk or root that doesn't match its digest raises."""
    import zlib

    _, loose = _codec()
    for batch in batches:
        crc, ids = [], []
        for r in batch.to_pylist():
            width, digests = r["width"], r["digests"]
            have = dict(_chunks(r["flags"], r["lens"], loose.decompress(r["body"]), width))
            have |= {b["i"]: b["chunk"] for b in r["borrowed"] or ()}
            leaves = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
            for i, leaf in enumerate(leaves):
                if digest(have[i]) != leaf:
                    raise ValueError(f"document {r['doc_id']}: chunk {i} does not match its digest")
            if merkle_root(leaves) != r["root"]:
                raise ValueError(f"document {r['doc_id']}: the recipe does not match its root")
            wide = np.frombuffer(b"".join(have[i] for i in range(len(leaves))), f"<u{width}").astype("<u4").tobytes()
            crc.append(zlib.crc32(wide))
            ids.append(wide)
        names = ["doc_id", "start", "n_tokens"]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], [*names, "ids_crc32", "ids"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Each document of a store, verified: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit).

    The manifest's counts and roots are held against the documents first; a part or
    document that is missing, added or moved raises, as does a chunk or recipe
    that does not match its digest.
    """
    manifest, documents = spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/documents")
    whole = manifest.select("part", F.struct("n_tokens", "n_documents", "root").alias("m")).join(part_roots(documents).select("part", F.struct("n_tokens", "n_documents", "root").alias("d")), "part", "full")
    off = whole.where(~F.col("m").eqNullSafe(F.col("d"))).select("part").limit(1).collect()
    if off:
        raise ValueError(f"part {off[0]['part']} of the store does not match its manifest")
    manifest = manifest.select("part", F.col("start").alias("part_start"), "width")
    stored = documents.join(manifest, "part").withColumn("start", F.col("part_start") + F.col("local_start"))
    stored = stored.drop("part", "part_start", "local_start")
    foreign, lent = F.instr(F.hex("flags"), "02") > 0, F.instr(F.hex("flags"), "01") > 0
    chunks = stored.where(lent).select("flags", "lens", "digests", "body", "width").mapInArrow(_lent_chunks, "digest binary, chunk binary")
    wants = stored.where(foreign).select("row", F.posexplode("lens").alias("i", "n"), "flags", "digests")
    wants = wants.where(F.substring(F.col("flags"), F.col("i") + 1, F.lit(1)) == F.lit(bytes([FOREIGN])))
    wants = wants.select("row", "i", F.substring(F.col("digests"), F.col("i") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))
    # A document borrows no more than its own chunks.
    borrowed = wants.join(chunks, "digest").groupBy("row").agg(F.collect_list(F.struct("i", "chunk")).alias("borrowed"))
    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    nothing = F.lit(None).cast("array<struct<i:int,chunk:binary>>").alias("borrowed")
    alone = stored.where(~foreign).select("*", nothing).mapInArrow(_rebuilt, schema)
    return alone.unionByName(stored.where(foreign).join(borrowed, "row", "left").mapInArrow(_rebuilt, schema))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a store and read back from it."""
    path = shared_folder(spark)
    write_store(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
