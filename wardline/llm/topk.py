"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging of per-query lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import written
from wardline.llm.tiles import ARROW, NO_SCORE, PACKED, STRIP, Packer, Queries, as_batch, blocks, each_row, grid, lowest, products, unpacked, whole_numbers

K, SCALE, EVERY = 20, 64.0, 20
_FOUND = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def tiled(vectors: DataFrame, scale: float, ident: str, column: str) -> DataFrame:
    """Usable rows with an id as tiles, in the order in which they lie in their files, so that no key can gather them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, x in whole_numbers(batch.column(1), scale):
                for row in packer.add((x.shape[1], None), ids[at], x):
                    yield as_batch(row, ARROW)
        for row in packer.rest():
            yield as_batch(row, ARROW)

    return vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(pack, PACKED)


def look(queries: Queries, tile: dict) -> None:
    """Products of a cell's queries and a tile, a strip of queries at a time; a query isn't offered its own row."""
    x, ids = unpacked(tile), np.frombuffer(tile["ids"], np.int64)
    most = int(np.abs(x.astype(np.int64)).max(initial=0))
    for i in range(0, len(queries.ids), STRIP):
        rows = np.arange(i, min(i + STRIP, len(queries.ids)))
        scores = products(queries.x[rows], x, queries.most, most)
        own = np.flatnonzero(queries.home[rows] == tile["tile"])
        scores[own, queries.at[rows[own]]] = lowest(scores.dtype)
        queries.best[0].offer(rows, scores, ids)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query (all, if fewer), ties to the smaller vec_id.

    Queries are rows whose id is divisible by `every`; candidates are all rows but the query's own. A component x becomes floor(scale * x),
    and a score is the inner product as a whole number. Rows without an id or a vector, or with a null or non-finite component, take no
    part. Vectors meet those of their own length only, empty ones (score 0) too. Repeated rows are candidates each, also for one
    another, and each repeated query has a list of its own. Scores that might leave a long are an error. Other
    columns play no part, whatever their names. An empty table, or one without queries, gives no rows.
    """
    tiles = written(tiled(vectors, scale, ident, column), "tiles")
    queries = written(blocks(tiles, lambda ids: ids % every == 0), "queries")
    lists = grid(queries, tiles, look, k)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            q, scores, ids = (np.frombuffer(row[n], np.int64) for n in ("q", "scores", "ids"))
            fine = scores != NO_SCORE
            yield pa.RecordBatch.from_arrays([np.repeat(q, k)[fine], np.tile(np.arange(1, k + 1, dtype=np.int32), len(q))[fine], ids[fine], scores[fine]], schema=_FOUND)

    return queries.select("tile", F.col("ids").alias("q")).join(lists, "tile").select("q", "scores", "ids").mapInArrow(spell, "query_id long, rank int, vec_id long, score long")
