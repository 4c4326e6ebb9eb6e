"""All pairs of points, worked out beside the points: what a query needs of the pairs leaves a task, not the pairs.

Points are dealt into cells by a hash of their key and packed, and a task gets the points of two
cells, a tile. Each point goes to as many tiles as there are cells; their number depends on the
cluster, and on the points only where a cell would hold more than SIDE. Squared distances come
from matrix products. Where the rounding error of these could change a result, the sum over
dimensions in order decides, so that results are those of that sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators.graph import Forest

#: Points of a cell at most, on average.
SIDE = 65_536
#: Cells of a table of few points hold so many on average.
BLOCK = 256
#: Pairs of a block within a tile, which bounds what a worker holds beside the points.
PAIRS = 1 << 21
#: Tiles for each core of the cluster at least, so that none waits long for the last.
TILES = 3
#: Vectors of so few dimensions are summed directly.
SHORT = 8
#: Products are used where the error of squares is less, so that none overflows.
LARGE = 1e280
#: The cell of distances that are not finite.
BEYOND = 1 << 62
#: Counts of a block are held densely up to so many values.
DENSE = 1 << 22


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors padded with zeros, and their lengths (-1: a null vector or one with a null)."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    values = column.flatten()
    if len(column) and not column.null_count and not values.null_count and (length == length[0]).all():
        return values.to_numpy().reshape(len(column), length[0]), length
    rows = column.to_pylist()
    length = np.array([-1 if v is None or None in v else len(v) for v in rows], np.int32)
    x = np.zeros((len(rows), max(0, length.max(initial=0))))
    for r, v in enumerate(rows):
        if length[r] > 0:
            x[r, : length[r]] = v
    return x, length


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cell of a batch, vectors as bytes of 4 or, where that would lose digits, 8 for a number."""
    for batch in batches:
        if not len(batch):
            continue
        cell, (x, length) = batch.column("p").to_numpy(), _vectors(batch.column("v"))
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        bounds = pa.array(np.append(starts, len(order)), pa.int32())
        parts = [x[at] for at in np.split(order, starts[1:])]
        with np.errstate(over="ignore"):
            small = [y.astype(np.float32) for y in parts]
        single = [bool((s == y).all()) for s, y in zip(small, parts)]
        held = [(s if one else y.astype(float)).tobytes() for s, y, one in zip(small, parts, single)]
        lists = [pa.ListArray.from_arrays(bounds, batch.column(c).take(pa.array(order))) for c in ("k", "t")]
        lengths = [length[at].tobytes() for at in np.split(order, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(cell[order][starts], pa.int32()), *lists, pa.array(lengths, pa.binary()), pa.array(single), pa.array(held, pa.binary())], ["p", "keys", "tags", "lengths", "single", "vectors"])


class Side:
    """Points of a cell: keys, tags, vectors padded with zeros (x), lengths (-1: not known)."""

    def __init__(self, rows: list[dict], kinds: tuple[pa.DataType, pa.DataType]):
        chunks = lambda c, kind: pa.chunked_array([r[c].values for r in rows], kind).combine_chunks() if rows else pa.array([], kind)
        self.keys, self.tags = chunks("keys", kinds[0]), chunks("tags", kinds[1])
        self.length = np.concatenate([np.frombuffer(r["lengths"], np.int32) for r in rows] or [np.zeros(0, np.int32)])
        parts = []
        for r in rows:
            flat = np.frombuffer(r["vectors"], np.float32 if r["single"] else float)
            n = len(r["keys"])
            parts.append(flat.reshape(n, len(flat) // n))
        self.x = np.zeros((len(self.length), max((p.shape[1] for p in parts), default=0)))
        at = 0
        for p in parts:
            self.x[at : at + len(p), : p.shape[1]] = p
            at += len(p)

    def sorted(self, code: np.ndarray) -> np.ndarray:
        order = np.argsort(code, kind="stable")
        self.keys, self.tags, self.length, self.x = self.keys.take(pa.array(order)), self.tags.take(pa.array(order)), self.length[order], self.x[order]
        return code[order]


def _codes(first: pa.Array, second: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in the order of all distinct ones, -1 for null."""
    both = pa.chunked_array([first, second])
    code = np.full(len(both), -1)
    known = pc.is_valid(both).to_numpy()
    values = both.drop_null()
    code[known] = np.unique(values.to_numpy(), return_inverse=True)[1]
    return code[: len(first)], code[len(first) :]


class Tile:
    """Points a and b, each pair of one of either; ``same``: b is a, and a pair is one whose first key is less."""

    def __init__(self, a: Side, b: Side | None):
        self.same = b is None
        b = a if b is None else b
        self.a, self.b = a, b
        self.i, self.j = _codes(a.keys, b.keys)
        if self.same:
            self.i = self.j = a.sorted(self.i)
        self.s, self.t = _codes(a.tags, b.tags)
        width = max(a.x.shape[1], b.x.shape[1])
        a.x, b.x = (np.pad(z, ((0, 0), (0, width - z.shape[1]))) if z.shape[1] < width else z for z in (a.x, b.x))
        lengths = np.concatenate([a.length, b.length])
        self.even = len(lengths) == 0 or (lengths[0] >= 0 and bool((lengths == lengths[0]).all()))
        with np.errstate(over="ignore", invalid="ignore"):
            self.nx, self.ny = (np.einsum("ij,ij->i", z, z) for z in (a.x, b.x))

    def turned(self) -> Tile:
        """The tile with its sides exchanged."""
        out = object.__new__(Tile)
        out.same, out.even = self.same, self.even
        out.a, out.b, out.i, out.j, out.s, out.t, out.nx, out.ny = self.b, self.a, self.j, self.i, self.t, self.s, self.ny, self.nx
        return out

    def known(self, r: slice | np.ndarray, c: slice) -> np.ndarray | None:
        """Whether the distance of each pair is known; None: of all."""
        return None if self.even else (self.a.length[r][:, None] == self.b.length[c]) & (self.a.length[r] >= 0)[:, None]

    def squares(self, r: slice | np.ndarray, c: slice, exact: bool = False) -> tuple[np.ndarray, float]:
        """Squared distances of a block, and by how much they may be off."""
        x, y, nx, ny = self.a.x[r], self.b.x[c], self.nx[r], self.ny[c]
        width = x.shape[1]
        error = 4 * (width + 4) * 2.3e-16 * (nx.max(initial=0) + ny.max(initial=0))
        with np.errstate(over="ignore", invalid="ignore"):
            if exact or width <= SHORT or not error < LARGE:
                square = np.zeros((len(x), len(y)))
                for k in range(width):
                    step = x[:, k, None] - y[None, :, k]
                    step *= step
                    square += step
                return square, 0.0
            square = x @ (-2.0 * y).T
            square += nx[:, None]
            square += ny
            return np.maximum(square, 0.0, out=square), error

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Distances of pairs (places in a, places in b), summed over dimensions in order."""
        out = np.empty(len(r))
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(r), 1 << 12):
                step = self.a.x[r[at : at + (1 << 12)]] - self.b.x[c[at : at + (1 << 12)]]
                step *= step
                total = np.zeros(len(step))
                for k in range(step.shape[1]):
                    total += step[:, k]
                out[at : at + len(step)] = np.sqrt(total)
        return out

    def blocks(self, pairs: bool = True, known: bool = True) -> Iterator[tuple[slice, slice, np.ndarray, float, np.ndarray | None]]:
        """Rows, columns, squares, error and the mask of pairs that count (None: all). Without ``pairs`` every two points of different keys are a pair.

        ``known``: pairs whose distance is not known do not count.
        """
        columns = min(len(self.b.x), 4096)
        rows = max(1, PAIRS // max(1, columns))
        for r in range(0, len(self.a.x), rows):
            for c in range(0, len(self.b.x), columns):
                at, to = slice(r, min(r + rows, len(self.a.x))), slice(c, min(c + columns, len(self.b.x)))
                if self.same and pairs and to.stop <= at.start:
                    continue
                mask = (np.less if pairs else np.not_equal)(self.i[at, None], self.j[to]) if self.same else None
                sure = self.known(at, to) if known else None
                mask = sure if mask is None else mask if sure is None else mask & sure
                yield at, to, *self.squares(at, to), mask

    def distances(self) -> Iterator[tuple[slice, slice, np.ndarray, float, np.ndarray | None]]:
        """As ``blocks``, with distances and by how much they may be off; short ones are exact."""
        for at, to, square, error, mask in self.blocks():
            off = 0.0
            if error:
                least = 1e9 * error
                r, c = np.nonzero(square < least)
                off = 2 * error / np.sqrt(least)
            d = np.sqrt(square, out=square)
            if error and len(r):
                d[r, c] = self.exact(r + at.start, c + to.start)
            yield at, to, d, off, mask

    def named(self, r: np.ndarray, c: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Keys of pairs, the lesser first."""
        first, second = self.a.keys.take(pa.array(r)), self.b.keys.take(pa.array(c))
        back = pa.array(self.i[r] > self.j[c])
        return pc.if_else(back, second, first), pc.if_else(back, first, second)


def _tiles(run: Callable[[Tile], Iterator[pa.RecordBatch]], names: list[str], strips: bool) -> Callable:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list, list]] = {}
        kinds = None
        for batch in batches:
            kinds = tuple(batch.schema.field(c).type.value_type for c in ("keys", "tags"))
            for n, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "p", "q", "lengths", "single", "vectors")))):
                tile, p, q, lengths, single, vectors = row
                held = {"keys": batch.column("keys")[n], "tags": batch.column("tags")[n], "lengths": lengths, "single": single, "vectors": vectors}
                sides = found.setdefault(tile, ([], []))
                if strips:
                    sides[1].append(held)
                    if p == q:
                        sides[0].append(held)
                else:
                    sides[p > q].append(held)
        for tile in sorted(found):
            a, b = found.pop(tile)
            if a and (b or not strips and _diagonal(tile)):
                for batch in run(Tile(Side(a, kinds), Side(b, kinds) if b else None)):
                    yield pa.RecordBatch.from_arrays(list(batch), names)

    return over


def _diagonal(tile: int) -> bool:
    return tile < 0


def cells_of(points: int, parallelism: int, few: int) -> int:
    """How many cells the points are dealt into."""
    cells = 1
    while cells * (cells + 1) // 2 < TILES * parallelism:
        cells += 1
    return max(1, min(cells, -(-points // few)), -(-points // SIDE))


def tiled(points: DataFrame, run: Callable[[Tile], Iterator[pa.RecordBatch]], schema: str, key: str = "item", vector: str = "vec", tag: str | None = None, strips: bool = False, few: int | None = None, whole: bool = False) -> DataFrame:
    """What ``run`` makes of each tile, as rows of ``schema``, whose columns it returns in order. Points without a key are left out.

    ``few`` points make a cell at least, on average. ``strips``: instead, each point is once on the first side of a tile, and all points are on its second. ``whole``: one tile has all points.
    """
    spark = points.sparkSession
    x = points.where(F.col(key).isNotNull())
    cores = spark.sparkContext.defaultParallelism
    n = 0 if whole else x.count()
    cells = max(1, min(cores, -(-n // (few or BLOCK)))) if strips else cells_of(n, cores, few or BLOCK)
    x = x.select(F.pmod(F.xxhash64(key), F.lit(cells)).cast("int").alias("p"), F.col(key).alias("k"), (F.lit(None).cast("long") if tag is None else F.col(tag)).alias("t"), F.col(vector).cast("array<double>").alias("v"))
    kind, mark = (x.schema[c].dataType.simpleString() for c in "kt")
    packed = x.mapInArrow(_packed, f"p int, keys array<{kind}>, tags array<{mark}>, lengths binary, single boolean, vectors binary")
    sent = packed.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    if strips:
        tile, tasks = F.col("q"), cells
    else:  # the tiles of two cells first, then those of one, which take half the time
        low, high, tasks = F.least("p", "q"), F.greatest("p", "q"), cells * (cells + 1) // 2
        tile = F.when(F.col("p") == F.col("q"), F.col("p") - cells).otherwise((high * (high - 1) / 2).cast("int") + low)
    sent = sent.withColumn("tile", tile).repartitionById(tasks, F.pmod("tile", F.lit(tasks)))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return sent.mapInArrow(_tiles(run, names, strips), schema)


def key_kind(points: DataFrame, key: str = "item") -> str:
    return points.schema[key].dataType.simpleString()


def _batch(*columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, [f"c{n}" for n in range(len(arrays))])


def _near(tile: Tile, cutoff: float, strict: bool, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and b and distances of pairs within a cutoff; unless ``exact``, distances are so only near the cutoff."""
    for at, to, square, error, mask in tile.blocks():
        slack = error + 1e-12 * cutoff * cutoff
        hit = square <= cutoff * cutoff + slack
        if mask is not None:
            hit &= mask
        r, c = np.nonzero(hit)
        d = np.sqrt(square[r, c])
        r, c = r + at.start, c + to.start
        again = slice(None) if exact else np.flatnonzero(d * d >= cutoff * cutoff - 2 * slack)
        d[again] = tile.exact(r[again], c[again])
        keep = d < cutoff if strict else d <= cutoff
        yield r[keep], c[keep], d[keep]


def near_pairs(points: DataFrame, cutoff: float) -> DataFrame:
    """i, j, d of pairs i < j within a cutoff."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        for r, c, d in _near(tile, cutoff, False, True):
            yield _batch(*tile.named(r, c), d)

    kind = key_kind(points)
    return tiled(points, run, f"i {kind}, j {kind}, d double")


def near_counts(points: DataFrame, cutoff: float, strict: bool = False) -> DataFrame:
    """item, n: how many other points lie within (``strict``: below) a cutoff, of those with any."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(len(tile.i), np.int64), np.zeros(len(tile.j), np.int64)
        for r, c, _ in _near(tile, cutoff, strict, False):
            a += np.bincount(r, minlength=len(a))
            b += np.bincount(c, minlength=len(b))
        for side, n in (((tile.a, a + b),) if tile.same else ((tile.a, a), (tile.b, b))):
            yield _batch(side.keys.filter(pa.array(n > 0)), n[n > 0])

    parts = tiled(points, run, f"item {key_kind(points)}, n long")
    return parts.groupBy("item").agg(F.sum("n").alias("n"))


def near_forest(points: DataFrame, cutoff: float) -> DataFrame:
    """i, j: pairs within a cutoff that join the same components as all such pairs: a forest of each tile, fewer pairs than its points."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        # Components of the points of both sides by place; b follows a.
        shift = 0 if tile.same else len(tile.i)
        root = np.arange(shift + len(tile.j))
        for r, c, _ in _near(tile, cutoff, False, False):
            u, v = root[r], root[c + shift]
            apart = np.flatnonzero(u != v)
            _, first = np.unique(np.minimum(u, v)[apart] * len(root) + np.maximum(u, v)[apart], return_index=True)
            first = apart[first]
            forest = Forest()
            kept = first[[forest.join(*uv) for uv in zip(u[first].tolist(), v[first].tolist())]] if len(first) else first
            if len(kept):
                to = np.arange(len(root))
                for x in list(forest.parent):
                    to[x] = forest.find(x)
                root = to[root]
                yield _batch(*tile.named(r[kept], c[kept]))

    kind = key_kind(points)
    return tiled(points, run, f"i {kind}, j {kind}")


def least_near_tag(points: DataFrame, cutoff: float, tag: str) -> DataFrame:
    """item, least: the least tag of other points within a cutoff, of points that have one there."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        top = np.iinfo(np.int64).max
        tags = [pc.fill_null(side.tags, top).to_numpy() for side in (tile.a, tile.b)]
        a, b = np.full(len(tile.i), top), np.full(len(tile.j), top)
        for r, c, _ in _near(tile, cutoff, False, False):
            np.minimum.at(a, r, tags[1][c])
            np.minimum.at(b, c, tags[0][r])
        for side, least in (((tile.a, np.minimum(a, b)),) if tile.same else ((tile.a, a), (tile.b, b))):
            yield _batch(side.keys.filter(pa.array(least < top)), least[least < top])

    parts = tiled(points, run, f"item {key_kind(points)}, least long", tag=tag)
    return parts.groupBy("item").agg(F.min("least").alias("least"))


def nearest_candidates(points: DataFrame, k: int) -> DataFrame:
    """i, j, d both ways: from each tile the pairs of a point that are no farther than its k-th nearest there; those over all points are among them.

    d is null where it is not known; such pairs count as farthest.
    """

    def one_way(tile: Tile) -> Iterator[pa.RecordBatch]:
        columns = slice(0, len(tile.j))
        rows = max(1, PAIRS // max(1, len(tile.j)))
        groups = max(64, 4 * k)
        for at in range(0, len(tile.i), rows):
            r = slice(at, min(at + rows, len(tile.i)))
            square, error = tile.squares(r, columns)
            other = tile.i[r, None] != tile.j if tile.same else None
            known = tile.known(r, columns)
            usable = known if other is None else other if known is None else other & known
            if not error:
                square[np.isnan(square)] = np.inf
            if usable is not None:
                square[~usable] = np.inf
            if square.shape[1] <= k:
                bound = np.full(len(square), np.inf)
            else:
                width = square.shape[1] // groups
                some = square if width < 2 else square[:, : groups * width].reshape(len(square), groups, width).min(2)
                bound = np.partition(some, k - 1, axis=1)[:, k - 1]
            hit = square <= (bound + 2 * error)[:, None]
            if usable is not None:
                hit &= usable
            i, j = np.nonzero(hit)
            d = tile.exact(i + at, j)
            order = np.lexsort((d, i))
            i, j, d = i[order], j[order], d[order]
            n = np.bincount(i, minlength=len(square))
            last = np.cumsum(n) - n + np.minimum(n, k) - 1
            farthest = np.where(n >= k, d[np.maximum(last, 0)], np.inf) if len(d) else np.full(len(n), np.inf)
            keep = ~(d > farthest[i])
            yield _batch(tile.a.keys.take(pa.array(i[keep] + at)), tile.b.keys.take(pa.array(j[keep])), d[keep])
            if known is not None:
                i, j = np.nonzero((~known if other is None else other & ~known) & (n < k)[:, None])
                yield _batch(tile.a.keys.take(pa.array(i + at)), tile.b.keys.take(pa.array(j)), pa.nulls(len(i), pa.float64()))

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        yield from one_way(tile)
        if not tile.same:
            yield from one_way(tile.turned())

    kind = key_kind(points)
    return tiled(points, run, f"i {kind}, j {kind}, d double")


def _settled_cells(tile: Tile, place: Callable[[np.ndarray], np.ndarray], steep: float) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Rows, columns, distances, the cell each distance falls into and the mask of a block. ``place`` is a number whose floor is the cell; ``steep``: its slope at most, or 0 for a number that moves by less than 1e-3 when distances are off by a billionth of themselves."""
    for at, to, d, off, mask in tile.distances():
        y = place(d)
        cell = np.floor(y)
        if off:
            y -= cell
            near = steep * off if steep else 1e-3
            r, c = np.nonzero((y < near) | (y > 1 - near))
            if len(r):
                d[r, c] = tile.exact(r + at.start, c + to.start)
                cell[r, c] = np.floor(place(d[r, c]))
        yield at, to, d, cell, mask


def _kinds(tile: Tile, at: slice, to: slice) -> np.ndarray:
    """0: of one tag, 1: of different tags, 2: a tag is not known."""
    kind = (tile.s[at, None] != tile.t[to]).astype(np.int8)
    if (tile.s[at] < 0).any() or (tile.t[to] < 0).any():
        kind[(tile.s[at] < 0)[:, None] | (tile.t[to] < 0)] = 2
    return kind


class _Counts:
    """Sums of counts by (cell, kind): dense among the DENSE cells about which most lie, others given out block by block."""

    def __init__(self):
        self.least, self.total = 0, np.zeros((0, 3), np.int64)

    def rows(self) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(self.total.any(1))
        if len(at):
            t = self.total[at]
            yield _batch(at + self.least, t[:, 0], t[:, 1], t.sum(1))

    def add(self, cell: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(cell):
            return
        low, high = int(cell.min()), int(cell.max())
        least, most = (min(low, self.least), max(high + 1, self.least + len(self.total))) if len(self.total) else (low, high + 1)
        if most - least > DENSE:
            about = lambda middle: (cell >= middle - DENSE // 2) & (cell < middle + DENSE // 2)
            inside = about(self.least + len(self.total) // 2) if len(self.total) else np.zeros(len(cell), bool)
            if 2 * inside.sum() < len(cell):
                yield from self.rows()
                self.total = np.zeros((0, 3), np.int64)
                inside = about(int(np.partition(cell, len(cell) // 2)[len(cell) // 2]))
            yield _sorted_counts(cell[~inside], kind[~inside])
            cell, kind = cell[inside], kind[inside]
            low, high = int(cell.min()), int(cell.max())
            least, most = (min(low, self.least), max(high + 1, self.least + len(self.total))) if len(self.total) else (low, high + 1)
        if (least, most - least) != (self.least, len(self.total)):
            wider = np.zeros((most - least, 3), np.int64)
            if len(self.total):
                wider[self.least - least : self.least - least + len(self.total)] = self.total
            self.least, self.total = least, wider
        kinds = int(kind.max()) + 1
        n = np.bincount((cell - low) * kinds + kind, minlength=kinds * (high + 1 - low)).reshape(-1, kinds)
        self.total[low - least : low - least + len(n), :kinds] += n


def _sorted_counts(cell: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Counts by cell of any values."""
    order = np.argsort(cell, kind="stable")
    cell, kind = cell[order], kind[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else order
    counts = [np.add.reduceat((kind == k).astype(np.int64), first) if len(cell) else np.zeros(0, np.int64) for k in range(3)]
    return _batch(cell[first], *counts[:2], sum(counts))


def _unknown(tile: Tile) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Rows, columns and mask of pairs whose distance is not known."""
    if not tile.even:
        for at, to, _, _, mask in tile.blocks(known=False):
            sure = ~tile.known(at, to)
            yield at, to, sure if mask is None else sure & mask


def cell_counts(points: DataFrame, place: Callable[[np.ndarray], np.ndarray], steep: float, tag: str | None = None) -> DataFrame:
    """cell, n_in, n_out, n: pairs of one tag, of different tags, and all, by the cell of their distance (see ``_settled_cells``; null: not known)."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for at, to, d, cell, mask in _settled_cells(tile, place, steep):
            kind = _kinds(tile, at, to)
            cell, kind = (cell.ravel(), kind.ravel()) if mask is None else (cell[mask], kind[mask])
            finite = np.isfinite(cell)
            if not finite.all():
                odd = np.bincount(kind[~finite], minlength=3)
                yield _batch(np.array([BEYOND]), odd[:1], odd[1:2], np.array([odd.sum()]))
                cell, kind = cell[finite], kind[finite]
            yield from held.add(cell.astype(np.int64), kind)
        yield from held.rows()
        for at, to, mask in _unknown(tile):
            n = np.bincount(_kinds(tile, at, to)[mask], minlength=3)
            yield _batch(pa.array([None], pa.int64()), n[:1], n[1:2], np.array([n.sum()]))

    parts = tiled(points, run, "cell long, n_in long, n_out long, n long", tag=tag)
    return parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n_in", "n_out", "n")])


def decimals(places: int) -> tuple[Callable[[np.ndarray], np.ndarray], float]:
    """Cells of distances rounded to decimals, in units of the last."""
    unit = 10.0**places
    return (lambda d: d * unit + 0.5), unit


def rounded_counts(points: DataFrame, tag: str, places: int = 6) -> DataFrame:
    """d, n_in, n_out, n: pairs of one tag, of different tags, and all, by their distance rounded to decimals (null: not known)."""
    d = F.when(F.col("cell") == BEYOND, float("nan")).otherwise(F.col("cell") / 10.0**places)
    return cell_counts(points, *decimals(places), tag=tag).select(d.alias("d"), "n_in", "n_out", "n")


def rounded_pairs(points: DataFrame, places: int = 6, cells: bool = False) -> DataFrame:
    """i, j, d of all pairs i < j, d rounded to decimals and null where not known; with ``cells`` in units of the last decimal, as a long."""
    place, steep = decimals(places)

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        for at, to, _, cell, mask in _settled_cells(tile, place, steep):
            r, c = np.nonzero(np.ones(cell.shape, bool) if mask is None else mask)
            v = cell[r, c]
            for part in range(0, len(r), 1 << 18):
                p = slice(part, part + (1 << 18))
                yield _batch(*tile.named(r[p] + at.start, c[p] + to.start), np.where(np.isfinite(v[p]), v[p], BEYOND).astype(np.int64) if cells else v[p] / steep)
        for at, to, mask in _unknown(tile):
            r, c = np.nonzero(mask)
            yield _batch(*tile.named(r + at.start, c + to.start), pa.nulls(len(r), pa.int64() if cells else pa.float64()))

    kind = key_kind(points)
    return tiled(points, run, f"i {kind}, j {kind}, d {'long' if cells else 'double'}")


def all_pairs(points: DataFrame, key: str, vector: str, few: int | None = None) -> DataFrame:
    """i, j, d of all pairs i < j; d is null where not known."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        for at, to, _, _, mask in tile.blocks(known=False):
            r, c = np.nonzero(np.ones((at.stop - at.start, to.stop - to.start), bool) if mask is None else mask)
            for part in range(0, len(r), 1 << 18):
                i, j = r[part : part + (1 << 18)] + at.start, c[part : part + (1 << 18)] + to.start
                sure = (tile.a.length[i] == tile.b.length[j]) & (tile.a.length[i] >= 0)
                yield _batch(*tile.named(i, j), pa.array(tile.exact(i, j), mask=~sure))

    kind = key_kind(points, key)
    return tiled(points, run, f"i {kind}, j {kind}, d double", key, vector, few=few)


def tag_sums(points: DataFrame, tag: str) -> DataFrame:
    """a, b, total, known, n: the sum of distances of pairs by their tags, the number of known ones and of all, in parts."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(at: slice, to: slice, values: np.ndarray, column: int) -> None:
            s, t = np.argsort(tile.s[at], kind="stable"), np.argsort(tile.t[to], kind="stable")
            u, v = np.unique(tile.s[at], return_index=False), np.unique(tile.t[to])
            down = np.add.reduceat(values[s], np.searchsorted(tile.s[at][s], u), axis=0)
            both = np.add.reduceat(down[:, t], np.searchsorted(tile.t[to][t], v), axis=1)
            for p, x in enumerate(u.tolist()):
                for q, y in enumerate(v.tolist()):
                    sums.setdefault((x, y), np.zeros(3))[column] += both[p, q]

        for at, to, d, _, mask in tile.distances():
            counted = np.ones(d.shape) if mask is None else mask.astype(float)
            add(at, to, d if mask is None else np.where(mask, d, 0.0), 0)
            add(at, to, counted, 1)
            add(at, to, counted, 2)
        for at, to, mask in _unknown(tile):
            add(at, to, mask.astype(float), 2)
        labels = {-1: None} | dict(zip(tile.s.tolist(), tile.a.tags.to_pylist())) | dict(zip(tile.t.tolist(), tile.b.tags.to_pylist()))
        found = [(labels[x], labels[y], *v) for (x, y), v in sums.items() if v[2]]
        if found:
            a, b, total, known, n = zip(*found)
            yield _batch(pa.array(a, tile.a.tags.type), pa.array(b, tile.a.tags.type), np.array(total), np.array(known).astype(np.int64), np.array(n).astype(np.int64))

    mark = key_kind(points, tag)
    return tiled(points, run, f"a {mark}, b {mark}, total double, known long, n long", tag=tag)


def _extreme(tile: Tile, r0: int, c0: int, square: np.ndarray, error: float, least: bool) -> float:
    """The exact least or largest distance of a block whose pairs that do not count are NaN; NaN if none does."""
    edge = (np.nanmin if least else np.nanmax)(square) if not np.isnan(square).all() else np.nan
    if np.isnan(edge):
        return edge
    with np.errstate(invalid="ignore"):
        r, c = np.nonzero(square <= edge + 2 * error if least else square >= edge - 2 * error)
    return float((np.min if least else np.max)(tile.exact(r + r0, c + c0)))


def tag_extremes(points: DataFrame, tag: str) -> DataFrame:
    """apart, within: the least distance of pairs of different tags and the largest of one tag."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        apart, within = np.nan, np.nan
        for at, to, square, error, mask in tile.blocks():
            kind = _kinds(tile, at, to)
            for k in (0, 1):
                counted = kind == k if mask is None else mask & (kind == k)
                x = _extreme(tile, at.start, to.start, np.where(counted, square, np.nan), error, k == 1)
                apart, within = (np.fmin(apart, x), within) if k else (apart, np.fmax(within, x))
        yield _batch(*[pa.array([v], pa.float64(), from_pandas=True) for v in (apart, within)])

    parts = tiled(points, run, "apart double, within double", tag=tag)
    return parts.agg(F.min("apart").alias("apart"), F.max("within").alias("within"))


def farthest(points: DataFrame) -> DataFrame:
    """item, near, far: the least and the largest distance of each point to another, in parts."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        for one in (tile,) if tile.same else (tile, tile.turned()):
            near, far = np.full(len(one.i), np.nan), np.full(len(one.i), np.nan)
            for at, to, square, error, mask in one.blocks(pairs=False):
                if mask is not None:
                    square[~mask] = np.nan
                for out, order in ((near, np.fmin), (far, np.fmax)):
                    edge = order.reduce(square, axis=1)[:, None]
                    r, c = np.nonzero(square <= edge + 2 * error if order is np.fmin else square >= edge - 2 * error)
                    order.at(out, r + at.start, one.exact(r + at.start, c + to.start))
            yield _batch(one.a.keys, *[pa.array(v, pa.float64(), from_pandas=True) for v in (near, far)])

    return tiled(points, run, f"item {key_kind(points)}, near double, far double")


def spanning_forests(points: DataFrame) -> DataFrame:
    """i, j, d: a minimum spanning forest of each tile's pairs, which together hold one of all pairs. Ties are open.

    By Boruvka rounds: each component but the largest takes its shortest pair that leads out of it.
    """

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        shift = 0 if tile.same else len(tile.i)
        ways = ((tile, 0, shift),) if tile.same else ((tile, 0, shift), (tile.turned(), shift, 0))
        root = np.arange(shift + len(tile.j))
        taken: list[tuple[int, int]] = []
        while True:
            largest = np.bincount(root).argmax() if len(taken) else -1
            r, c, s = [], [], []
            for one, base, other in ways:
                left = np.flatnonzero(root[base : base + len(one.i)] != largest)
                step = max(1, PAIRS // max(1, len(one.j)))
                for k in range(0, len(left), step):
                    at = left[k : k + step]
                    square, error = one.squares(at, slice(None))
                    square[root[base + at][:, None] == root[other : other + len(one.j)]] = np.inf
                    if one.same:
                        square[one.i[at][:, None] == one.j] = np.inf
                    known = one.known(at, slice(None))
                    if known is not None:
                        square[~known] = np.inf
                    if not error:
                        square[np.isnan(square)] = np.inf
                    to = square.argmin(1)
                    least = square[np.arange(len(at)), to]
                    out = np.flatnonzero(np.isfinite(least))
                    d = one.exact(at[out], to[out])
                    # Where the error is not small beside the square, the shortest is found exactly.
                    close = np.flatnonzero(least[out] < 1e9 * error)
                    p, q = np.nonzero(square[out[close]] <= (least[out[close]] + 2 * error)[:, None])
                    exact = one.exact(at[out[close[p]]], q)
                    for n in np.lexsort((-exact, p)).tolist():
                        to[out[close[p[n]]]], d[close[p[n]]] = q[n], exact[n]
                    r.append(base + at[out])
                    c.append(other + to[out])
                    s.append(d)
            r, c, s = (np.concatenate(v) if v else np.zeros(0, int) for v in (r, c, s))
            order = np.lexsort((s, root[r]))
            first = order[np.flatnonzero(np.diff(root[r][order], prepend=-1))]
            first = first[np.argsort(s[first], kind="stable")]
            forest = Forest()
            joined = [forest.join(u, v) for u, v in zip(root[r[first]].tolist(), root[c[first]].tolist())]
            if not any(joined):
                break
            kept = first[joined]
            taken += zip(r[kept].tolist(), c[kept].tolist())
            to = np.arange(len(root))
            for x in list(forest.parent):
                to[x] = forest.find(x)
            root = to[root]
        if taken:
            r, c = np.array(taken).T
            if not tile.same:
                back = r >= shift
                r, c = np.where(back, c, r), np.where(back, r, c) - shift
            yield _batch(*tile.named(r, c), tile.exact(r, c))

    kind = key_kind(points)
    return tiled(points, run, f"i {kind}, j {kind}, d double")


def ranked_bins(points: DataFrame, tag: str, size: float, places: int = 6) -> DataFrame:
    """item, bin, n_in, n_out: points of the item's tag and of others by average rank of their rounded distance from it, ``size`` ranks to a bin, the item itself (at 0) included.

    A task holds all points and the distances of a few items from them.
    """
    place, unit = decimals(places)
    top = np.iinfo(np.int64).max

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        rows = max(1, PAIRS // max(1, len(tile.j)))
        everything = slice(0, len(tile.j))
        edges = size * np.arange(1, int((len(tile.j) + 1) / size) + 2)
        for at in range(0, len(tile.i), rows):
            r = slice(at, min(at + rows, len(tile.i)))
            square, error = tile.squares(r, everything)
            least = 1e9 * error
            again = square < least if error else np.zeros(square.shape, bool)
            d = np.sqrt(square)
            y = place(d)
            v = np.floor(y)
            if error:
                off = 2 * unit * error / np.sqrt(least)
                again |= (y - v < off) | (y - v > 1 - off)
                i, j = np.nonzero(again)
                v[i, j] = np.floor(place(tile.exact(i + at, j)))
            known = tile.known(r, everything)
            v = np.where(np.isfinite(v), v, BEYOND).astype(np.int64)
            if known is not None:
                v[~known] = top
            itself = tile.i[r, None] == tile.j
            v[itself] = 0
            kind = _kinds(tile, r, everything)
            kind[itself] = 0
            if v.max() < 1 << 31:
                v = v.astype(np.int32)
            items, bins, n_in, n_out = [], [], [], []
            for k in range(len(v)):
                every, mine, neither = (np.sort(x) for x in (v[k], v[k][kind[k] == 0], v[k][kind[k] == 2]))
                on = edges[edges <= len(every)]
                group = every[np.minimum(np.ceil(on).astype(int), len(every)) - 1]
                low, high = np.searchsorted(every, group, "left"), np.searchsorted(every, group, "right")
                beyond = (low + 1 + high) / 2 >= on  # the tied ones lie in the next bin
                cut = lambda x: np.where(beyond, np.searchsorted(x, group, "left"), np.searchsorted(x, group, "right"))
                total, a, c = (np.diff(np.concatenate([[0], at_edges, [len(x)]])) for at_edges, x in ((np.where(beyond, low, high), every), (cut(mine), mine), (cut(neither), neither)))
                some = np.flatnonzero(total)
                items.append(np.full(len(some), at + k))
                bins.append(some)
                n_in.append(a[some])
                n_out.append((total - a - c)[some])
            yield _batch(tile.a.keys.take(pa.array(np.concatenate(items))), np.concatenate(bins), np.concatenate(n_in).astype(np.int64), np.concatenate(n_out).astype(np.int64))

    return tiled(points, run, f"item {key_kind(points)}, bin long, n_in long, n_out long", tag=tag, strips=True)


def _by_digits(d: np.ndarray) -> np.ndarray:
    """A number whose floor keeps 18 binary digits of a distance behind its first."""
    return np.where(np.isfinite(d), np.ascontiguousarray(d).view(np.int64) / float(1 << 34), np.nan)


def digit_counts(points: DataFrame, tag: str) -> DataFrame:
    """cell, n_in, n_out, n as ``cell_counts``: cells of equal first digits, in order of distance."""
    return cell_counts(points, _by_digits, 0.0, tag)


def digit_pairs(points: DataFrame, tag: str, cells: list[int | None], firsts: list | None = None) -> DataFrame:
    """cell, d, i, n_in, n_out, n of pairs (i, j) in some cells of ``digit_counts``, in parts; with ``firsts``, keys, their pairs one by one and ``j``."""
    chosen = np.array(sorted(c for c in cells if c is not None) or [-1])

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        def found(r: np.ndarray, c: np.ndarray, kind: np.ndarray, cell: np.ndarray | None) -> pa.RecordBatch:
            i, j = tile.named(r, c)
            d = np.zeros(len(r)) if cell is None else tile.exact(r, c)
            one = [(kind == k).astype(np.int64) for k in (0, 1)] + [np.ones(len(r), np.int64)]
            if firsts is None:
                code = np.minimum(tile.i[r], tile.j[c])
                order = np.lexsort((code, d))
                start = np.flatnonzero((np.diff(d[order], prepend=np.nan) != 0) | (np.diff(code[order], prepend=-1) != 0)) if len(r) else order
                one = [np.add.reduceat(x[order], start) if len(r) else x for x in one]
                at = order[start]
            else:
                at = np.flatnonzero(pc.is_in(i, value_set=pa.array(firsts, i.type)).to_numpy(zero_copy_only=False))
                one = [x[at] for x in one]
            nulls = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64())
            place, d = nulls if cell is None else (pa.array(cell[at]), pa.array(d[at]))
            return _batch(place, d, i.take(pa.array(at)), *one, *([] if firsts is None else [j.take(pa.array(at))]))

        for at, to, _, cell, mask in _settled_cells(tile, _by_digits, 0.0):
            cell = np.where(np.isfinite(cell), cell, BEYOND).astype(np.int64)
            hit = chosen[np.minimum(np.searchsorted(chosen, cell), len(chosen) - 1)] == cell
            r, c = np.nonzero(hit if mask is None else hit & mask)
            yield found(r + at.start, c + to.start, _kinds(tile, at, to)[r, c], cell[r, c])
        for at, to, mask in _unknown(tile) if None in cells else ():
            r, c = np.nonzero(mask)
            yield found(r + at.start, c + to.start, _kinds(tile, at, to)[r, c], None)

    kind = key_kind(points)
    return tiled(points, run, f"cell long, d double, i {kind}, n_in long, n_out long, n long" + ("" if firsts is None else f", j {kind}"), tag=tag)
