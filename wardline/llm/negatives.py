"""Hard negatives by a pivot table: inner products become Euclidean distances, and distances to pivots bracket them.

With M the largest squared length of all rows, a row x gets one more component, the root of M - |x|^2, and an anchor a gets a zero. Then
|x' - a'|^2 = M + |a|^2 - 2 (a x): the higher the score, the shorter the way. Each row keeps its distances to some pivots (augmented rows
themselves). By the triangle inequality the way from an anchor to a row is at least the largest difference of their distances to a pivot, and at most
the least sum; so every score lies between two bounds that need no product. Bounds of a whole tile, from the least and largest distances
in it, come first, then those of its rows; only rows that may still be among the wanted are multiplied, exactly.

Rows lie in tiles by label, nearest pivot and distance to it, which makes the distances in a tile alike. One pass finds each anchor's positives among
the tiles of its label, a second one the negatives in the others, where every positive gives a window of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import written
from wardline.llm.tiles import ARROW, NO_SCORE, PACKED, STRIP, Packer, Queries, as_batch, blocks, by_length, each_row, grid, lowest, products, unpacked, whole_numbers

SCALE, EVERY, POSITIVES, NEGATIVES = 256.0, 100, 5, 10
#: Shares of a positive's score between which a negative's must lie, in hundredths.
LEAST, MOST = 30, 90
#: Pivots, picked far from each other out of a sample that steers only what can be left out.
PIVOTS, PIVOT_SAMPLE = 16, 512
_FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def lifted(x: np.ndarray, most: int) -> np.ndarray:
    """Rows with the component that makes all squared lengths equal to most."""
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))[:, None]])


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each the farthest from those before it."""
    picked, away = [0], np.full(len(sample), np.inf)
    while len(picked) < min(count, len(sample)):
        away = np.minimum(away, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
        picked.append(int(away.argmax()))
    return sample[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(d, 0.0))


class Brackets:
    """Bounds of scores of some anchors from their distances to the pivots."""

    def __init__(self, anchors: np.ndarray, pivots: np.ndarray, most: int):
        squares = (anchors.astype(float) ** 2).sum(axis=1)
        self.sum = most + squares
        # distances are kept in float32: what that and the roots may be off by, in the square, is far below this
        self.slack = 1e-5 * self.sum + 1.0
        self.to = distances(np.hstack([anchors.astype(float), np.zeros((len(anchors), 1))]), pivots)

    def score(self, rows, way: np.ndarray) -> np.ndarray:
        return (self.sum[rows].reshape(-1, *[1] * (way.ndim - 1)) - way * way) / 2

    def of_tile(self, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score that any row of a tile may have with each anchor."""
        if not near.shape[1]:
            return np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        low, high, to = near.min(axis=0), near.max(axis=0), self.to[rows]
        short = np.maximum(np.maximum(to - high, low - to), 0.0).max(axis=1)
        return self.score(rows, (to + high).min(axis=1)) - self.slack[rows], self.score(rows, short) + self.slack[rows]

    def of_rows(self, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of each anchor with each row."""
        short, long = np.zeros((len(rows), len(near)), np.float32), np.full((len(rows), len(near)), np.inf, np.float32)
        for p in range(near.shape[1]):
            to = self.to[rows, p].astype(np.float32)[:, None]
            np.maximum(short, np.abs(to - near[:, p]), out=short)
            np.minimum(long, to + near[:, p], out=long)
        slack = self.slack[rows][:, None]
        return self.score(rows, long) - slack, self.score(rows, short) + slack


def _survivors(queries: Queries, tile: dict, rows: np.ndarray, brackets: Brackets, need: np.ndarray, cap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, their exact scores with some rows of a tile, those rows' ids) for all pairs whose score may lie between need and cap; pairs that can't, and
    an anchor with itself, have the lowest score."""
    x, ids = unpacked(tile), np.frombuffer(tile["ids"], np.int64)
    near = np.frombuffer(tile["near"], np.float32).reshape(len(ids), -1)
    least, most = brackets.of_tile(rows, near)
    rows = rows[(most >= need[rows]) & (least <= cap[rows])]
    top = int(np.abs(x.astype(np.int64)).max(initial=0))
    for i in range(0, len(rows), STRIP):
        strip = rows[i : i + STRIP]
        least, most = brackets.of_rows(strip, near)
        may = (most >= need[strip][:, None]) & (least <= cap[strip][:, None])
        own = np.flatnonzero(queries.home[strip] == tile["tile"])
        may[own, queries.at[strip[own]]] = False
        r, c = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if len(r):
            scores = products(queries.x[strip[r]], x[c], queries.most, top)
            scores[~may[np.ix_(r, c)]] = lowest(scores.dtype)
            yield strip[r], scores, ids[c]


def windows(positive_scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest whole score within the shares of a positive's; none where there is no positive."""
    tens, rest = np.divmod(positive_scores, 100)
    low, high = LEAST * tens - (-LEAST * rest) // 100, MOST * tens + (MOST * rest) // 100
    missing = positive_scores == NO_SCORE
    return np.where(missing, 1, low), np.where(missing, 0, high)


def _marked(queries: Queries, pivots: dict[int, np.ndarray], most: int) -> Brackets:
    """The brackets of a cell's queries, made once."""
    if queries.brackets is None:
        queries.brackets = Brackets(queries.x, pivots.get(queries.dim, np.zeros((0, queries.dim + 1))), most)
    return queries.brackets


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: float = SCALE, ident: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by `every`. A score is the inner product with the anchor after a component x became floor(scale * x);
    higher scores come first, ties by the smaller id. An anchor's positives are its first other rows of the same label, all if there
    are fewer. For each of them come the first rows of other labels with LEAST * positive <= 100 * negative <= MOST * positive, all if fewer; where there
    are none, or no positive, there is no row. A positive with a score below zero has no negatives.

    Where the id is divisible by 7, the label first becomes (label + 1) % 10. Rows without an id, a label or a vector, or with a null or
    non-finite component, take no part. Vectors meet those of their own length only. Repeated rows count each: they are positives of one another,
    and each repeated anchor has rows of its own. Scores that might leave a long are an error. Other columns play no
    part, whatever their names. An empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch.column(2), scale):
                part = batch.take(pa.array(at))
                squares = (x.astype(float) ** 2).sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(squares)], names=["vec_id", "label", "x", "squares"])

    k = F.col(ident).cast("long")
    kind = F.col(label).cast("int")
    source = vectors.select(k.alias("vec_id"), F.when(k % 7 == 0, (kind + 1) % 10).otherwise(kind).alias("label"), F.col(column).cast("array<double>").alias("x"))
    rows = written(source.where("vec_id is not null and label is not null").mapInArrow(keep, "vec_id long, label int, x array<long>, squares double"), "vectors")
    longest = rows.agg(F.max("squares")).first()[0]
    most = int(np.nextafter(longest or 0.0, np.inf)) + 1
    pivots: dict[int, np.ndarray] = {}
    for r in rows.select("x").orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(PIVOT_SAMPLE).collect():
        pivots.setdefault(len(r["x"]), []).append(r["x"])
    pivots = {n: far_apart(lifted(np.array(p, float).reshape(len(p), n), most), PIVOTS) for n, p in pivots.items()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(2)):
                part, p = batch.take(pa.array(at)), pivots.get(x.shape[1])
                near = np.zeros((len(x), 0)) if p is None else distances(lifted(x, most), p)
                first = near.argmin(axis=1) if near.shape[1] else np.zeros(len(x), int)
                away = near.min(axis=1) if near.shape[1] else np.zeros(len(x))
                lists = pa.array([v.tobytes() for v in near.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(first, pa.int32()), pa.array(away), lists], names=["vec_id", "label", "x", "dim", "pivot", "away", "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, x in by_length(batch.column(2)):
                near = np.frombuffer(b"".join(batch.column(6).take(pa.array(at)).to_pylist()), np.float32).reshape(len(at), -1)
                cuts = np.flatnonzero(np.diff(labels[at])) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    for row in packer.add((x.shape[1], int(labels[at[part[0]]])), ids[at[part]], x[part], near[part]):
                        yield as_batch(row, ARROW)
        for row in packer.rest():
            yield as_batch(row, ARROW)

    table = rows.select("vec_id", "label", "x").mapInArrow(measure, "vec_id long, label int, x array<long>, dim int, pivot int, away double, near binary")
    table = written(table, "pivot-table")
    # rows that are alike in all of these are told apart by where they lie, so that no group of copies meets in one task
    order = ["dim", "label", "pivot", "away", "place"]
    dealt = table.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    tiles = written(dealt.select(*table.columns).mapInArrow(pack, PACKED), "tiles")
    anchors = written(blocks(tiles, lambda ids: ids % every == 0), "anchors")

    def look_positives(queries: Queries, tile: dict) -> None:
        same = np.flatnonzero(queries.label == tile["label"])
        need = queries.best[0].floor(slice(None), np.dtype(float))
        for at, scores, ids in _survivors(queries, tile, same, _marked(queries, pivots, most), need, np.full(len(need), np.inf)):
            queries.best[0].offer(at, scores, ids)

    def look_negatives(queries: Queries, tile: dict) -> None:
        other = np.flatnonzero(queries.label != tile["label"])
        low, high = windows(queries.want[:, positives:])
        floors = np.stack([b.floor(slice(None), np.dtype(float)) for b in queries.best], axis=1)
        open_ = low <= high
        need = np.where(open_, np.maximum(low, floors), np.inf).min(axis=1)
        cap = np.where(open_, high, -np.inf).max(axis=1)
        for at, scores, ids in _survivors(queries, tile, other, _marked(queries, pivots, most), need, cap):
            for w, best in enumerate(queries.best):
                fits = (scores >= low[at, w][:, None]) & (scores <= high[at, w][:, None])
                best.offer(at, np.where(fits, scores, lowest(scores.dtype)).astype(scores.dtype), ids)

    def with_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            want = np.hstack([np.frombuffer(row.pop(n), np.int64).reshape(-1, positives) for n in ("p_ids", "p_scores")])
            yield as_batch(row | {"want": want.tobytes()}, ARROW)

    first = grid(anchors, tiles, look_positives, positives)
    joined = anchors.join(first.select("tile", F.col("ids").alias("p_ids"), F.col("scores").alias("p_scores")), "tile")
    anchors = written(joined.select(*anchors.columns, "p_ids", "p_scores").mapInArrow(with_positives, PACKED), "positives")
    second = grid(anchors, tiles, look_negatives, negatives, positives)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            q, want, scores, ids = (np.frombuffer(row[n], np.int64) for n in ("q", "want", "scores", "ids"))
            want, fine = want.reshape(len(q), 2, positives), scores != NO_SCORE
            each = lambda v: np.repeat(v.ravel(), negatives)[fine]
            rank = np.tile(np.arange(1, negatives + 1, dtype=np.int32), len(q) * positives)[fine]
            yield pa.RecordBatch.from_arrays([np.repeat(q, negatives * positives)[fine], each(want[:, 0]), rank, ids[fine], each(want[:, 1]), scores[fine]], schema=_FOUND)

    out = anchors.select("tile", F.col("ids").alias("q"), "want").join(second, "tile").select("q", "want", "scores", "ids")
    return out.mapInArrow(spell, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
