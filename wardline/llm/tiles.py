"""Searches by inner product over whole-number vectors: tiles of all rows, blocks of queries, and lists of the best that are merged as a tree.

Rows are packed into tiles of bounded size and written. Queries are blocks that come from the tiles. The work is a grid: queries are dealt
into groups that fit a task, tiles into columns, and a cell takes one group's queries past one column's tiles, one tile at a time. A cell
sends back the best rows of each of its queries; cells of a row of the grid are merged by FAN at a time until one list is left.
A tile is sent once to each group of queries, so what is moved for a product shrinks with the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import salted_lookup, written

#: Components in a tile, in the queries of a cell, and in the tiles that go past them; rows in a tile at most.
TILE, GROUP, COLUMN, ROWS = 1 << 18, 1 << 21, 1 << 23, 4096
#: Lists that are merged at once; queries whose products are held at once; tasks of the grid at most.
FAN, STRIP, TASKS = 16, 256, 10_000
#: Lengths of vectors up to which the shape of the grid, a row for each, is broadcast.
LENGTHS = 10_000
#: Stand for no row in a list: below all scores, behind all ids.
NO_SCORE, NO_ID = -(2**63 - 1), 2**63 - 1
PACKED = "tile long, dim int, label int, ids binary, at binary, x binary, kind string, near binary, want binary"
LISTS = "tile long, c int, scores binary, ids binary"


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a column of vectors: for each length, the places of its usable ones and their components as a matrix.

    Null vectors and those with a null or non-finite component aren't usable; empty ones are."""
    there = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    lengths = column.value_lengths().take(pa.array(there)).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # nulls among numbers become NaN
    starts = np.cumsum(lengths) - lengths
    bad = np.zeros(len(there), bool)
    bad[np.repeat(np.arange(len(there)), lengths)[~np.isfinite(flat)]] = True
    for n in np.unique(lengths[~bad]):
        rows = np.flatnonzero(~bad & (lengths == n))
        yield there[rows], flat[starts[rows][:, None] + np.arange(n)]


def whole_numbers(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """by_length() with each component x as floor(scale * x). Components that leave the whole numbers of 62 bits are an error."""
    for at, x in by_length(column):
        with np.errstate(over="ignore"):
            x = np.floor(scale * x.astype(float))
        if np.abs(x).max(initial=0) >= 2.0**62:
            raise ValueError("a component leaves the whole numbers of 62 bits")
        yield at, x.astype(np.int64)


def packed(x: np.ndarray) -> tuple[bytes, str]:
    """A matrix of whole numbers in the smallest type that holds it."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return x.astype(kind).tobytes(), kind


def unpacked(row: dict) -> np.ndarray:
    n = len(row["ids"]) // 8
    return np.frombuffer(row["x"], row["kind"]).reshape(n, row["dim"])


class Packer:
    """Gathers rows by a key (length, label) and lets go of them as tiles; at most four tiles' components wait."""

    def __init__(self):
        self.waiting: dict[tuple, list] = {}
        self.held = self.tiles = 0

    def add(self, key: tuple, ids: np.ndarray, x: np.ndarray, near: np.ndarray | None = None) -> Iterator[dict]:
        most = max(1, min(ROWS, TILE // max(1, key[0])))
        for i in range(0, len(ids), most):
            part = slice(i, i + most)
            self.waiting.setdefault(key, []).append((ids[part], x[part], None if near is None else near[part]))
            self.held += max(1, key[0]) * len(ids[part])
            if sum(len(p[0]) for p in self.waiting[key]) >= most:
                yield from self.close(key, most)
        while self.held > 4 * TILE:
            yield from self.close(max(self.waiting, key=lambda k: sum(p[1].size for p in self.waiting[k])), 1)

    def close(self, key: tuple, least: int = 1) -> Iterator[dict]:
        """Tiles of the rows that wait under a key; fewer than least of them go on waiting."""
        parts = self.waiting.pop(key)
        ids, x = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        near = None if parts[0][2] is None else np.concatenate([p[2] for p in parts])
        self.held -= max(1, key[0]) * len(ids)
        most, i = max(1, min(ROWS, TILE // max(1, key[0]))), 0
        while len(ids) - i >= max(1, least):
            pick = np.argsort(ids[i : i + most], kind="stable") + i  # by id, so that of equal scores the first counts
            data, kind = packed(x[pick])
            yield {"tile": (TaskContext.get().partitionId() << 32) + self.tiles, "dim": key[0], "label": key[1], "ids": ids[pick].astype(np.int64).tobytes(), "at": None, "x": data, "kind": kind, "near": None if near is None else near[pick].astype(np.float32).tobytes(), "want": None}
            self.tiles += 1
            i += most
        if i < len(ids):
            self.waiting[key] = [(ids[i:], x[i:], None if near is None else near[i:])]
            self.held += max(1, key[0]) * (len(ids) - i)

    def rest(self) -> Iterator[dict]:
        for key in list(self.waiting):
            yield from self.close(key)


def as_batch(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=schema)


ARROW = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("label", pa.int32()), ("ids", pa.binary()), ("at", pa.binary()), ("x", pa.binary()), ("kind", pa.string()), ("near", pa.binary()), ("want", pa.binary())])
_LISTS = pa.schema([("tile", pa.int64()), ("c", pa.int32()), ("scores", pa.binary()), ("ids", pa.binary())])


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def blocks(tiles: DataFrame, picks: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of tiles whose ids are picked, as blocks of queries that know their places in the tile."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            ids = np.frombuffer(row["ids"], np.int64)
            at = np.flatnonzero(picks(ids))
            if len(at):
                yield as_batch(row | {"ids": ids[at].tobytes(), "at": at.tobytes(), "x": unpacked(row)[at].tobytes(), "near": None}, ARROW)

    return tiles.mapInArrow(cut, PACKED)


def products(a: np.ndarray, b: np.ndarray, most_a: int, most_b: int) -> np.ndarray:
    """Exact inner products of whole-number rows, each to each, in the fastest type that holds all their sums."""
    most = a.shape[1] * most_a * most_b
    if most >= 1 << 63:
        raise ValueError("an inner product may leave the long")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def lowest(kind: np.dtype):
    return -np.inf if np.issubdtype(kind, np.floating) else NO_SCORE


class Best:
    """The k best rows of each of n queries so far: higher scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), NO_SCORE, np.int64), np.full((n, k), NO_ID, np.int64)

    def floor(self, rows, kind: np.dtype) -> np.ndarray:
        """The score that a row must reach to get into each list."""
        last = self.scores[rows, -1]
        return np.where(last == NO_SCORE, lowest(kind), last).astype(kind)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take what is best of scores (a row for each of rows, a column for each of ids, which are in order; lowest() is no offer)."""
        k, floor, low = self.scores.shape[1], self.floor(rows, scores.dtype)[:, None], lowest(scores.dtype)
        m = (scores >= floor) & (scores > low)
        many = np.flatnonzero(m.sum(axis=1) > 2 * k)
        if len(many):  # of these rows only what is above the k-th score, and the first of those that equal it
            s = scores[many]
            least = np.maximum(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None], floor[many])
            equal = (s == least) & (s > low)
            m[many] = (s > least) | (equal & (np.cumsum(equal, axis=1) <= k))
        r, c = np.nonzero(m)
        if not len(r):
            return
        hit = np.unique(r)
        into = rows[hit]
        row = np.concatenate([np.repeat(np.arange(len(hit)), k), np.searchsorted(hit, r)])
        score = np.concatenate([self.scores[into].ravel(), scores[r, c].astype(np.int64)])
        ident = np.concatenate([self.ids[into].ravel(), ids[c]])
        order = np.lexsort((ident, -score, row))
        row = row[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        self.scores[into] = score[order][keep].reshape(-1, k)
        self.ids[into] = ident[order][keep].reshape(-1, k)


class Queries:
    """The blocks of a cell as one matrix."""

    def __init__(self, rows: list[dict], lists: int, k: int):
        self.tiles, self.dim = [r["tile"] for r in rows], rows[0]["dim"]
        ids = [np.frombuffer(r["ids"], np.int64) for r in rows]
        self.ends = np.cumsum([len(i) for i in ids])
        self.ids = np.concatenate(ids)
        self.at = np.concatenate([np.frombuffer(r["at"], np.int64) for r in rows])
        self.home = np.repeat(np.array(self.tiles, np.int64), [len(i) for i in ids])
        self.label = np.repeat(np.array([-1 if r["label"] is None else r["label"] for r in rows]), [len(i) for i in ids])
        self.x = np.concatenate([unpacked(r) for r in rows])
        self.most = int(np.abs(self.x.astype(np.int64)).max(initial=0))
        self.brackets = None  # whatever look() makes of the queries once
        self.want = None if rows[0]["want"] is None else np.concatenate([np.frombuffer(r["want"], np.int64).reshape(len(i), -1) for r, i in zip(rows, ids, strict=True)])
        self.best = [Best(len(self.ids), k) for _ in range(lists)]

    def told(self, c: int) -> Iterator[pa.RecordBatch]:
        """The lists of each block: queries by lists by places."""
        scores, ids = (np.stack([getattr(b, name) for b in self.best], axis=1) for name in ("scores", "ids"))
        for tile, end, start in zip(self.tiles, self.ends, [0, *self.ends], strict=False):
            yield as_batch({"tile": tile, "c": c, "scores": scores[start:end].tobytes(), "ids": ids[start:end].tobytes()}, _LISTS)


def grid(queries: DataFrame, tiles: DataFrame, look: Callable[[Queries, dict], None], k: int, lists: int = 1) -> DataFrame:
    """(tile, scores, ids) for each block of queries: look is called with the queries of a cell and each tile of it, and offers to
    queries.best, which has so many lists of k rows for each query. Only vectors of one length meet."""
    spark = queries.sparkSession
    components = (F.octet_length("ids") / 8).cast("long") * F.greatest(F.col("dim"), F.lit(1))
    size = lambda df, name: df.groupBy("dim").agg(F.sum(components).alias(name), F.count("*").alias(f"n_{name}"))
    least = 2 * spark.sparkContext.defaultParallelism  # so many columns at least, where there are tiles for them
    shape = size(queries, "q").join(size(tiles, "t"), "dim").select("dim", F.ceil(F.col("q") / GROUP).cast("int").alias("gs"), F.greatest(F.ceil(F.col("t") / COLUMN), F.least("n_t", F.lit(least))).cast("int").alias("cs"))
    shape = written(shape, "grid")  # a row for each length of vectors
    most = shape.agg(F.max("cs").alias("cs"), F.sum(F.col("gs").cast("long") * F.col("cs")).alias("cells"), F.count("*").alias("n")).first()
    if most["cs"] is None:
        return spark.createDataFrame([], "tile long, scores binary, ids binary")
    to = lambda n, salt: F.pmod(F.xxhash64("tile", F.lit(salt)), F.col(n)).cast("int")
    # few lengths, as there nearly always are, go to the tiles
    placed = lambda df: df.join(F.broadcast(shape), "dim") if most["n"] <= LENGTHS else salted_lookup(df, shape, ["dim"], ["tile"]).where("gs is not null")
    q = placed(queries).select(F.lit(0).alias("side"), to("gs", 1).alias("g"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), *tiles.columns)
    t = placed(tiles).select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("gs") - 1)).alias("g"), to("cs", 2).alias("c"), *tiles.columns)
    both = q.unionByName(t).repartition(int(min(most["cells"], TASKS)), "dim", "g", "c").sortWithinPartitions("dim", "g", "c", "side", "tile")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, came, mine = None, [], None
        for row in each_row(batches):
            if cell != (row["dim"], row["g"], row["c"]):
                if mine is not None:
                    yield from mine.told(cell[2])
                cell, came, mine = (row["dim"], row["g"], row["c"]), [], None
            if row["side"] == 0:
                came.append(row)
            elif came or mine is not None:
                if mine is None:
                    mine, came = Queries(came, lists, k), []
                look(mine, row)
        if mine is not None:
            yield from mine.told(cell[2])

    found = written(both.mapInArrow(walk, LISTS), "lists")
    left = most["cs"]
    while left > 1:
        found = found.withColumn("c", (F.col("c") / FAN).cast("int")).groupBy("tile", "c").applyInArrow(_merge(k), LISTS)
        left = -(-left // FAN)
    return found.select("tile", "scores", "ids")


def _merge(k: int):
    def merge(t: pa.Table) -> pa.Table:
        scores, ids = (np.concatenate([np.frombuffer(v, np.int64).reshape(-1, k) for v in t.column(n).to_pylist()]) for n in ("scores", "ids"))
        n = t.num_rows
        scores, ids = (v.reshape(n, -1, k).transpose(1, 0, 2).reshape(-1, n * k) for v in (scores, ids))
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        best = {"tile": t.column("tile")[0].as_py(), "c": t.column("c")[0].as_py()} | {name: np.take_along_axis(v, order, axis=1).tobytes() for name, v in (("scores", scores), ("ids", ids))}
        return pa.Table.from_pylist([best], schema=_LISTS)

    return merge
