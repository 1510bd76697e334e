"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are dealt to the nearest of some pivots, moved there once, and written as tiles. A pair of tiles is skipped if the angle between
their centres exceeds both radii and the linking angle together. For the other pairs of tiles the int8 components are
multiplied (as whole numbers within float32) and each product is off by at most
e_a * |y| + |x'| * e_b, where e is the length of what quantising a vector lost; only pairs that may reach the
threshold by this bound are computed in double precision. A product's first components come first, with the lengths of the rest as a bound. Pairs of tiles are a Cartesian product of the written table with itself, whose
tasks read both sides where they lie: no bytes are copied for a pair, so what is moved and kept grows with the vectors, not with their pairs.
A task sends back how many partners each vector has and edges that span its linked groups, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import connected_components, drop_written, written
from wardline.llm.tiles import by_length, each_row

THRESHOLD = 0.95
#: Vectors in a tile, about, and its components; pivots at most, which only steer which tiles can be skipped, and the components of all of them.
TILE, COMPONENTS, PIVOTS, PIVOT_COMPONENTS = 4096, 1 << 20, 1024, 1 << 21
#: Rounding in float32 scales and double norms, added to every bound.
SLACK = 1e-6
#: Eighths of the components that products are looked at by first.
HEAD = 3
#: Edges that a task holds before it reduces them to those that span.
EDGES = 1 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale of each row, length of each row's error)."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def tile_product(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, same: bool = False, block: int = 256) -> np.ndarray:
    """Boolean matrix: which rows of x and y (unit vectors) have a cosine of at least threshold. same: y is x."""
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    fx, fy = qx.astype(np.float32), qy.astype(np.float32).T.copy()
    # sums of up to 1000 products of int8 stay below 2 ** 24, where float32 is exact; longer ones are off by 2 ** -24 for each product at most
    slack = SLACK + (x.shape[1] * 2.0**-23 if x.shape[1] > 1000 else 0.0)
    # of the bound, a row takes the largest error in y, so that products need one scaling and one comparison
    least = ((threshold - slack - ex - (1.0 + ex) * ey.max(initial=0)) / sx).astype(np.float32) * np.float32(1 - 3e-7)
    least[least < 0] *= np.float32(1 + 1e-6)
    scales = sy.astype(np.float32)
    # most pairs are ruled out by their first components: what the others add is at most the product of their lengths
    head = x.shape[1] * HEAD // 8
    hx, hy = (np.concatenate([q[:, :head].astype(np.float32), np.ceil(np.linalg.norm(q[:, head:].astype(float), axis=1, keepdims=True)).astype(np.float32)], axis=1) for q in (qx, qy))
    hy = hy.T.copy()
    out = np.zeros((len(x), len(y)), bool)
    wide, heads = 8 * block, head > 8

    def may(a: np.ndarray, b: np.ndarray, rows, cols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and columns, from the first, that have a product within reach, and which of theirs are."""
        near = a @ b
        near *= scales[cols]
        maybe = near >= least[rows, None]
        if not maybe.any():
            return np.arange(0), np.arange(0), maybe[:0, :0]
        r, c = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        return r, c, maybe[np.ix_(r, c)]

    for i in range(0, len(x), block):
        for j in range(0, len(y), wide):
            rows, cols = np.arange(i, min(i + block, len(x))), np.arange(j, min(j + wide, len(y)))
            if heads:
                r, c, maybe = may(hx[i : i + block], hy[:, j : j + wide], rows, cols)
                heads = 4 * maybe.size < len(rows) * len(cols)  # where many are left, this is in vain
                rows, cols = rows[r], cols[c]
            if len(rows):
                r, c, maybe = may(fx[rows], fy[:, cols], rows, cols)
                rows, cols = rows[r], cols[c]
            if len(rows):
                out[np.ix_(rows, cols)] = (x[rows] @ y[cols].T >= threshold) & maybe
    if same:
        np.fill_diagonal(out, False)
    return out


def _span(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, least id) that connect what the boolean matrix links between the ids a of rows and b of columns."""
    r, c = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(r):
        return a[:0], a[:0]
    m, la, lb = linked[np.ix_(r, c)], a[r].copy(), b[c].copy()
    t = m.T.copy()
    far = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.array([lb[row].min(initial=far) for row in m]))
        nb = np.minimum(lb, np.array([na[col].min(initial=far) for col in t]))
        if (na == la).all() and (nb == lb).all():
            return np.concatenate([a[r], b[c]]), np.concatenate([la, lb])
        la, lb = na, nb


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, least id that it reaches) that connect what the edges (u, v) connect, one for each id but the least ones."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(ids))
    while True:
        la, lb = least[a], least[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return ids[least != np.arange(len(ids))], ids[least[least != np.arange(len(ids))]]
        np.minimum.at(least, la, low)  # what both ends pointed to points on
        np.minimum.at(least, lb, low)
        while (least[least] != least).any():
            least = least[least]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or a component that isn't finite link with nothing; so do
    null ids, whose component is null. Vectors of another length than most are compared with those of their length
    only. Equal vectors are one class from the start and count as links of each other. Rows that share
    an id and a vector count as copies; different vectors under one id are compared each, and each has a row of its own. A cosine
    of exactly the threshold links. Very long vectors are compared whole. Other columns play no part. An empty table gives no rows.
    """
    source = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    shape = source.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    pivots = _pivots(source, shape["n"], max(1, shape["dim"] or 1))
    table = written(source.mapInArrow(_told(pivots), "vec_id long, good boolean, dim int, d1 long, d2 long, pivot int"), "vectors")
    tiles = _tiles(source, table, pivots)
    found = written(_links(tiles, threshold), "tile-links")
    # equal vectors are a class with a number of its own: ids may repeat, with other vectors
    classes = written(tiles.select("tile", "cids", "copies", "d1", "d2").mapInArrow(_unpack, "cls long, cid long, copies long, d1 long, d2 long"), "classes")
    drop_written(tiles)
    degree = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    comps = written(connected_components(found.where("b is not null").select("a", "b")), "components").withColumnRenamed("id", "cls")
    # written, so that both sides of the joins have a shuffle of their own and Spark can split that of a hot component or vector
    least = written(comps.join(classes.select("cls", "cid"), "cls").groupBy("component").agg(F.min("cid").alias("component_id")), "least")
    comps = comps.join(least, "component").select("cls", "component_id")
    facts = classes.join(degree, "cls", "left").join(comps, "cls", "left").where("copies > 1 or others > 0").select("d1", "d2", "cid", "copies", "others", "component_id")
    linked = F.col("good") & F.col("vec_id").isNotNull()
    rows = table.where(linked).select("vec_id", "d1", "d2").join(facts, ["d1", "d2"], "left")
    n_links = (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("long")
    rows = rows.select("vec_id", n_links.alias("n_links"), F.coalesce("component_id", "cid", "vec_id").alias("component_id"))
    rows = rows.union(table.where(~linked).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return rows.select("vec_id", "n_links", "component_id", (F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))).alias("kept"))


Pivots = dict[int, tuple[int, np.ndarray]]
Batches = Iterator[pa.RecordBatch]


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch of (vec_id, embedding), for each length: the places of usable vectors, the vectors, and their 128-bit keys as two longs."""
    for at, x in by_length(batch.column(1)):
        fine = x.any(axis=1)
        at, x = at[fine], x[fine] + 0.0
        if len(at):
            yield at, x, np.frombuffer(b"".join([xxhash.xxh3_128_digest(v.tobytes()) for v in x]), np.int64).reshape(-1, 2)


def _nearest(x: np.ndarray, pivots: Pivots) -> np.ndarray:
    """The number of each row's pivot, or 0. All in whole numbers, so that equal vectors always have the same one."""
    if x.shape[1] not in pivots:
        return np.zeros(len(x), np.int32)
    first, p = pivots[x.shape[1]]
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return (np.rint(np.ldexp(x, 12 - exponent[:, None])) @ p.T).argmax(axis=1).astype(np.int32) + first


def _bytes(x: np.ndarray) -> list[bytes]:
    """Each row's components, as float32 where these are the same numbers."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return [(s if fine else v).tobytes() for s, v, fine in zip(short, x, (short == x).all(axis=1), strict=True)]


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    """n rows that _bytes() made, all of one kind, as doubles."""
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * dim else np.float64).reshape(n, dim).astype(float)


def _pivots(source: DataFrame, n: int, dim: int) -> Pivots:
    """Pivots by length of vector: (number of the first, whole-number rows); the usable vectors with the least hashes."""
    few = min(PIVOTS, n // TILE + 1, max(1, PIVOT_COMPONENTS // dim))
    if few == 1:
        return {}

    def look(batches: Batches) -> Batches:
        for batch in batches:
            for _, x, keys in _usable(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(_bytes(x), pa.binary())], names=["dim", "d1", "d2", "x"])

    order = F.pmod(F.xxhash64("d1", "d2"), F.lit(1 << 40))
    sample = source.mapInArrow(look, "dim int, d1 long, d2 long, x binary").withColumn("order", order).where(F.col("order") < int(min(1.0, 8 * few / n) * (1 << 40)))
    found: dict[int, list] = {}
    for r in sample.dropDuplicates(["d1", "d2"]).orderBy("order", "d1", "d2").limit(few).collect():
        found.setdefault(r["dim"], []).append(_matrix(bytes(r["x"]), 1, r["dim"])[0])
    out, first = {}, 1
    for d, rows in sorted(found.items()):
        out[d] = (first, np.rint(unit(np.array(rows)) * 4096))
        first += len(rows)
    return out


def _told(pivots: Pivots) -> Callable[[Batches], Batches]:
    """A pass over (vec_id, embedding) that tells usable vectors and gives them keys and pivots."""

    def told(batches: Batches) -> Batches:
        for batch in batches:
            good, dim, pivot, keys = np.zeros(len(batch), bool), np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32), np.zeros((len(batch), 2), np.int64)
            for at, x, k in _usable(batch):
                good[at], dim[at], pivot[at], keys[at] = True, x.shape[1], _nearest(x, pivots), k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(dim), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(pivot)], names=["vec_id", "good", "dim", "d1", "d2", "pivot"])

    return told


def _tiles(source: DataFrame, table: DataFrame, pivots: Pivots) -> DataFrame:
    """A row for each tile: its number, which is that of its first class, and its classes' least ids, copies, keys and vectors. Vectors move once."""
    sizes = table.where("good and vec_id is not null").groupBy("pivot").agg(F.approx_count_distinct("d1").alias("n"), F.avg("dim").alias("dim")).collect()  # a row for each pivot
    most_rows, most_components = TILE, COMPONENTS
    parts = np.ones(max([0, *(r["pivot"] for r in sizes)]) + 1, np.int64)
    for r in sizes:
        parts[r["pivot"]] = max(1, round(r["n"] / most_rows), int(r["n"] * r["dim"] // most_components))
    starts = np.cumsum(parts) - parts

    def place(batches: Batches) -> Batches:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, x, keys in _usable(batch):
                # copies within a batch travel once
                _, one, which, copies = np.unique(keys, axis=0, return_index=True, return_inverse=True, return_counts=True)
                cid = np.full(len(one), np.iinfo(np.int64).max)
                np.minimum.at(cid, which.ravel(), ids[at])
                x, keys = x[one], keys[one]
                pivot = _nearest(x, pivots)
                slot = starts[pivot] + (keys[:, 0].view(np.uint64) % parts[pivot].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(cid), pa.array(copies.astype(np.int64)), pa.array(_bytes(x), pa.binary())], names=["slot", "dim", "d1", "d2", "cid", "copies", "x"])

    def pack(batches: Batches) -> Batches:
        waiting: dict[tuple[int, int], list] = {}
        held, number = 0, TaskContext.get().partitionId() << 40

        def close(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal held, number
            rows = pa.Table.from_batches(waiting.pop(key))
            n, dim = len(rows), key[1]
            held -= n * dim
            data = rows.column("x").to_pylist()
            if len({len(v) for v in data}) > 1:
                data = [_matrix(v, 1, dim).tobytes() for v in data]
            data = b"".join(data)
            x = unit(_matrix(data, n, dim))
            centre = unit(x.sum(axis=0, keepdims=True) + 1e-12)[0]
            radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) + 1e-6
            row = {"tile": number, "dim": dim, **{k: rows.column(k).to_numpy().tobytes() for k in ("cid", "copies", "d1", "d2")}, "x": data, "centre": centre.tolist(), "radius": radius}
            number += n
            return pa.RecordBatch.from_pylist([{"cids" if k == "cid" else k: v for k, v in row.items()}], schema=_TILES)

        for batch in batches:
            slot, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s, d in np.unique(np.stack([slot, dim], axis=1), axis=0).tolist():
                mine = batch.filter(pa.array((slot == s) & (dim == d)))
                most = max(1, min(most_rows * 7 // 4, most_components // d))  # half a tile more, and what counts and hashes are off by
                while len(mine):
                    there = sum(map(len, waiting.setdefault((s, d), [])))
                    waiting[s, d].append(mine.slice(0, most - there))
                    held += len(waiting[s, d][-1]) * d
                    mine = mine.slice(most - there)
                    if there + len(waiting[s, d][-1]) >= most:
                        yield close((s, d))
            while held > 4 * most_components:
                yield close(max(waiting, key=lambda k: k[1] * sum(map(len, waiting[k]))))
        for key in list(waiting):
            yield close(key)

    placed = source.mapInArrow(place, "slot int, dim int, d1 long, d2 long, cid long, copies long, x binary").repartition("slot")
    classes = placed.groupBy("slot", "dim", "d1", "d2").agg(F.min("cid").alias("cid"), F.sum("copies").alias("copies"), F.any_value("x").alias("x"))
    return written(classes.mapInArrow(pack, "tile long, dim int, cids binary, copies binary, d1 binary, d2 binary, x binary, centre array<double>, radius double"), "tiles")


_TILES = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("cids", pa.binary()), ("copies", pa.binary()), ("d1", pa.binary()), ("d2", pa.binary()), ("x", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])


def _unpack(batches: Batches) -> Batches:
    """A row for each class of tiles."""
    for row in each_row(batches):
        columns = [np.frombuffer(row[k], np.int64) for k in ("cids", "copies", "d1", "d2")]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (row["tile"] + np.arange(len(columns[0])), *columns)], names=["cls", "cid", "copies", "d1", "d2"])


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, null, n): class a has n linked vectors in other classes; (a, b, null): edges that span linked classes."""
    side = lambda k: tiles.select(F.col("tile").alias(k), F.col("dim").alias(f"dim_{k}"), F.col("copies").alias(f"n_{k}"), F.col("x").alias(f"x_{k}"), F.col("centre").alias(f"c{k}"), F.col("radius").alias(f"r{k}")).hint("shuffle_replicate_nl")
    cosine = F.aggregate(F.zip_with("ci", "cj", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    near = (F.col("i") == F.col("j")) | (angle <= F.col("ri") + F.col("rj") + F.acos(F.lit(threshold)) + 1e-6)
    # two tiles meet once; by a bit of their hashes in the one order or the other, so that tasks on both sides of the diagonal have work
    odd = F.xxhash64("i").bitwiseXOR(F.xxhash64("j")).bitwiseAND(F.lit(1)) == 1
    once = F.when(odd, F.col("i") > F.col("j")).otherwise(F.col("i") <= F.col("j"))
    pairs = side("i").join(side("j"), (F.col("dim_i") == F.col("dim_j")) & once & near)

    def multiply(batches: Batches) -> Batches:
        counts: dict[int, np.ndarray] = {}
        edges, held, last, x = [], 0, None, None
        for row in each_row(batches):
            na, nb = (np.frombuffer(row[k], np.int64).astype(float) for k in ("n_i", "n_j"))
            if row["i"] != last:
                last, x = row["i"], unit(_matrix(row["x_i"], len(na), row["dim_i"]))
            same = row["i"] == row["j"]
            y = x if same else unit(_matrix(row["x_j"], len(nb), row["dim_i"]))
            linked = tile_product(x, y, threshold, same)
            if not linked.any():
                continue
            r, c = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            of_a, of_b = counts.setdefault(row["i"], np.zeros(len(na))), counts.setdefault(row["j"], np.zeros(len(nb)))
            for k in range(0, len(r), 256):
                m = linked[np.ix_(r[k : k + 256], c)].astype(float)
                of_a[r[k : k + 256]] += m @ nb[c]
                if not same:
                    of_b[c] += na[r[k : k + 256]] @ m
            edges.append(_span(linked, row["i"] + np.arange(len(na)), row["j"] + np.arange(len(nb))))
            held += len(edges[-1][0])
            if held > EDGES:
                edges = [_forest(*(np.concatenate(v) for v in zip(*edges, strict=True)))]
                held = len(edges[0][0])
        for tile, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(tile + at), pa.nulls(len(at), pa.int64()), pa.array(n[at].astype(np.int64))], names=["a", "b", "n"])
        if edges:
            u, v = _forest(*(np.concatenate(v) for v in zip(*edges, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["a", "b", "n"])

    return pairs.select("i", "j", "dim_i", "n_i", "x_i", "n_j", "x_j").mapInArrow(multiply, "a long, b long, n long")
