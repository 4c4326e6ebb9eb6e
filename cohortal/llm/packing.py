"""Packing token pieces into sequences by a grouping genetic algorithm on islands.

An individual is a partition of a block's pieces into sequences. Crossover takes
whole well-filled sequences of one parent into the other, dissolves those that
then hold a piece twice, and puts displaced pieces back by best fit. A block of a
few thousand pieces is bred on several islands, tasks of their own with their own
random numbers; after an epoch each island receives the elite of the island before
it. Well-filled sequences of a finished round are settled; the others' pieces meet
those of other blocks in the next round, starting from the sequences they have.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.shared import table, written
from cohortal.llm.tokens import crc32_ids, encoder, vocabulary_path

CAPACITY = 2048
#: Pieces of a block, islands that breed it, epochs with a migration between, rounds of blocks.
BLOCK, ISLANDS, EPOCHS, ROUNDS = 4096, 2, 2, 2
POPULATION, GENERATIONS = 4, 6
#: A sequence with at most this share of its capacity free is settled after a round.
SETTLED = 0.002


class Shelf:
    """Open sequences by free room; finds the fullest one into which a piece fits."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, group: list[int], room: int) -> None:
        if not self.by_room[room]:
            self.mask |= 1 << room
        self.by_room[room].append(group)

    def take(self, size: int) -> tuple[list[int], int]:
        """The fullest sequence with room for ``size``, or a new one; taken from the shelf."""
        fits = self.mask >> size
        if not fits:
            return [], self.capacity
        room = size + (fits & -fits).bit_length() - 1
        group = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        return group, room

    def groups(self) -> list[list[int]]:
        return [g for groups in self.by_room for g in groups]


def best_fit(sizes: list[int], pieces: list[int], groups: list[list[int]], capacity: int) -> list[list[int]]:
    """Put pieces, in the order given, into the fullest of the groups that has room, or new ones."""
    shelf = Shelf(capacity)
    for g in groups:
        shelf.put(g, capacity - sum(sizes[i] for i in g))
    for i in pieces:
        group, room = shelf.take(sizes[i])
        shelf.put([*group, i], room - sizes[i])
    return shelf.groups()


def fitness(sizes: list[int], groups: list[list[int]], capacity: int) -> tuple[int, float]:
    """To be maximal: few groups, then uneven filling (the mean square of fill)."""
    return -len(groups), sum((sum(sizes[i] for i in g) / capacity) ** 2 for g in groups) / max(1, len(groups))


def crossover(sizes: list[int], into: list[list[int]], source: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """A child of ``into`` with a random half of the well-filled groups of ``source``."""
    filled = sorted(source, key=lambda g: -sum(sizes[i] for i in g))
    given = [g for g in filled[: max(1, len(filled) // 2)] if rng.random() < 0.5]
    held = {i for g in given for i in g}
    keep, displaced = [], []
    for g in into:
        if held.isdisjoint(g):
            keep.append(g)
        else:
            displaced += [i for i in g if i not in held]
    return best_fit(sizes, sorted(displaced, key=lambda i: -sizes[i]), keep + given, capacity)


def mutated(sizes: list[int], groups: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """The groups with the emptiest and some others dissolved and their pieces put back by best fit."""
    order = sorted(groups, key=lambda g: sum(sizes[i] for i in g))
    n = max(2, len(order) // 20)
    gone = order[:n] + rng.sample(order[n:], min(n, len(order) - n)) if len(order) > n else order
    ids = {id(g) for g in gone}
    loose = sorted((i for g in gone for i in g), key=lambda i: -sizes[i] * (1 + 0.1 * rng.random()))
    return best_fit(sizes, loose, [g for g in groups if id(g) not in ids], capacity)


def evolve(sizes: list[int], seeds: list[list[list[int]]], capacity: int, rng: random.Random, population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best individual found; it is never worse than a seed.

    The population is filled with individuals built by best fit in jittered order
    of size. At least one generation is bred; breeding ends early where no smaller
    number of groups can exist.
    """
    least = -(-sum(sizes) // capacity)
    rank = lambda groups: fitness(sizes, groups, capacity)
    pool = list(seeds)
    while len(pool) < population:
        jitter = 0.15 * rng.random() if pool else 0.0
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + jitter * rng.random()))
        pool.append(best_fit(sizes, order, [], capacity))
    pool.sort(key=rank, reverse=True)
    for _ in range(generations):
        parents = rng.sample(pool, min(len(pool), 3))
        children = [crossover(sizes, a, b, capacity, rng) for a, b in zip(parents, parents[1:])]
        children.append(mutated(sizes, pool[0], capacity, rng))
        pool = sorted(pool + children, key=rank, reverse=True)[:population]
        if len(pool[0]) <= least:
            break
    return pool[0]


def piece_table(docs: DataFrame, vocabulary: str, keeps_space: bool, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each row's ids; the first piece takes what is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, keeps_space)
        for batch in batches:
            at, rows = [], []
            for k, ids in enumerate(enc.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    cut = ids[start : start + capacity] if piece else ids[:first]
                    at.append(k)
                    rows.append((piece, start, len(cut), crc32_ids(cut)))
            piece, start, length, crc = zip(*rows) if rows else ((),) * 4
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _epoch(capacity: int, epoch: int):
    """A block's island: the individuals that reached it (by origin) seed its population; its elite comes out."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        pieces = rows.drop_duplicates("pid")[["pid", "length"]].sort_values("pid")
        sizes = pieces["length"].tolist()
        place = {p: i for i, p in enumerate(pieces["pid"].tolist())}
        seeds = []
        for _, one in rows[rows["bin"] >= 0].groupby("origin"):
            groups: dict[int, list[int]] = {}
            for p, b in zip(one["pid"].tolist(), one["bin"].tolist()):
                groups.setdefault(b, []).append(place[p])
            seeds.append(list(groups.values()))
        best = evolve(sizes, seeds, capacity, random.Random(f"{block}/{island}/{epoch}"))
        bins = np.empty(len(sizes), np.int64)
        for b, g in enumerate(best):
            bins[g] = b
        few, even = fitness(sizes, best, capacity)
        return pd.DataFrame({"block": block, "island": island, "origin": island, "pid": pieces["pid"].to_numpy(), "length": pieces["length"].to_numpy(), "bin": bins, "n_bins": -few, "evenness": even})

    return run


_SCHEMA = "block bigint, island int, origin int, pid bigint, length bigint, bin bigint, n_bins bigint, evenness double"


def breed(rows: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """block, pid, length, bin: the best individual of each block. ``rows``: block, pid, length, bin (-1: none yet)."""
    start = rows.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn("origin", F.lit(-1))
    for epoch in range(epochs):
        bred = written(start.groupBy("block", "island").applyInPandas(_epoch(capacity, epoch), _SCHEMA))
        # Each island keeps its elite and gets that of the island before it.
        start = bred.withColumn("island", F.explode(F.array(F.col("island"), (F.col("island") + 1) % islands))).drop("n_bins", "evenness").distinct() if islands > 1 else bred.drop("n_bins", "evenness")
    best = bred.groupBy("block", "island").agg(F.first("n_bins").alias("n"), F.first("evenness").alias("e")).groupBy("block").agg(F.min(F.struct("n", -F.col("e"), "island"))["island"].alias("island"))
    return bred.join(best, ["block", "island"]).select("block", "pid", "length", "bin")


def pack(docs: DataFrame, vocabulary: str, keeps_space: bool = True, end_id: int = 0, capacity: int = CAPACITY, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """Every document's pieces with their place in sequences of at most ``capacity`` tokens.

    ``docs``: doc_id and text; other columns are not read. Null and empty texts
    are their end id. Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (gapless from 0). Null and repeated ids are documents of their own; an
    empty table gives no rows. Reruns over the same files agree.
    """
    pieces = written(piece_table(docs, vocabulary, keeps_space, end_id, capacity).withColumn("pid", F.monotonically_increasing_id()))
    # Numbers of sequences: a full piece has its own; others the round, block and group.
    numbered = lambda r: F.lit((r + 1) << 58) + F.col("block") * (1 << 24) + F.col("bin")
    settled = [pieces.where(F.col("length") == capacity).select("pid", F.col("pid").alias("sequence_id"))]
    open_rows = pieces.where(F.col("length") < capacity).select("pid", "length", F.col("pid").alias("group"), F.lit(False).alias("seeded"))
    for r in range(rounds):
        n = open_rows.count()
        if not n:
            break
        blocks = -(-n // block)
        rows = open_rows.select(F.pmod(F.xxhash64("group", F.lit(r)), F.lit(blocks)).alias("block"), "pid", "length", F.when(F.col("seeded"), F.col("group")).otherwise(-1).alias("bin"))
        bred = written(breed(rows, capacity).withColumn("sequence_id", numbered(r)))
        fill = bred.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        done = bred.join(fill, "sequence_id").withColumn("settled", F.col("fill") >= capacity * (1 - SETTLED))
        if r == rounds - 1 or blocks == 1:
            settled.append(bred.select("pid", "sequence_id"))
            break
        settled.append(done.where("settled").select("pid", "sequence_id"))
        open_rows = done.where(~F.col("settled")).select("pid", "length", F.col("sequence_id").alias("group"), F.lit(True).alias("seeded"))
    places = settled[0]
    for more in settled[1:]:
        places = places.unionByName(more)
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return pieces.join(places, "pid").withColumn("offset", before).drop("pid")


def op4_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    packed = pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
