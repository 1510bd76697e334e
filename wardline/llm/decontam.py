"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: wherever the item occurs with at most k edits,
one piece occurs unchanged. One Aho-Corasick pass finds exact piece hits in a document, and Myers' bit-parallel
distance verifies the stretch around each hit against the whole item.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item. An item too short for one must stand unchanged, as whole words.
RATE = 0.05
#: Items are sent to the executors in blocks of at most so many characters; each block is one pass over the documents.
BLOCK_CHARS = 4_000_000

_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    """Lower case, runs of white space as one space: what both sides are matched in."""
    return _SPACE.sub(" ", text.lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, as (start, piece)."""
    at = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def best_match(item: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(edits, end) of the stretch of text nearest to the whole item, by Myers' bit vectors; the first of equals."""
    m = len(item)
    if masks is None:
        masks = bit_masks(item)
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score = full, 0, m
    best, at = m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # no carry: a match may start anywhere
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def bit_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


class Searcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for ident, text in items:
            item = normal(text)
            if not item:
                continue
            budget = int(len(item) * rate)
            n = len(self.items)
            self.items.append((ident, item, budget, bit_masks(item)))
            for start, piece in pieces(item, budget):
                where[piece].append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, edits, end in the normalised text) of each item that occurs, at its best place."""
        if self.empty:
            return []
        t = normal(text)
        wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
        exact: dict[int, int] = {}
        for end, (length, at) in self.automaton.iter(t):
            for n, start in at:
                budget, size = self.items[n][2], len(self.items[n][1])
                begin = end - length + 1 - start
                if not budget:
                    if not t[max(0, begin - 1) : begin].isalnum() and not t[end + 1 : end + 2].isalnum():
                        exact.setdefault(n, end + 1)
                    continue
                wanted[n].append((max(0, begin - budget), min(len(t), begin + size + budget)))
        out = [(self.items[n][0], 0, at) for n, at in exact.items()]
        for n, spans in wanted.items():
            ident, item, budget, masks = self.items[n]
            spans.sort()
            best, at, done = len(item), 0, -1
            i = 0
            while i < len(spans) and best:
                a, b = spans[i]
                while i + 1 < len(spans) and spans[i + 1][0] <= b:  # hits of one place share a stretch
                    i += 1
                    b = max(b, spans[i][1])
                edits, end = best_match(item, t[a:b], masks)
                if edits < best:
                    best, at = edits, a + end
                i += 1
            if best <= budget:
                out.append((ident, best, at))
        return sorted(out)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, end): each document and item of which it holds a stretch within the item's budget.

    Matching is in lower case with runs of white space as one space; end is a place in the text so normalised, the first of equally
    good ones. An item has an edit for every 1 / rate characters; shorter ones must stand unchanged as whole words. Null items and
    those of white space match nothing; null and empty texts hold nothing. Rows that repeat are reported once for each row, items
    that repeat once. Very long texts are searched whole. Items are taken in blocks of about BLOCK_CHARS characters, so what a task
    holds is bounded however large the benchmark is; each block is one pass over the documents, without a shuffle of them. An empty
    table on either side gives no rows. Other columns of docs play no part.
    """
    schema = f"`{ident}` long, item_id long, edits int, end int"
    out = None
    for shared in _blocks(benchmark):
        found = docs.select(F.col(ident).cast("long").alias(ident), F.col(text).alias("text")).mapInArrow(_search(shared, rate, ident), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _blocks(benchmark: DataFrame):
    """Broadcast blocks of (item id, text). A block's size is measured before it is collected: it has at most twice
    BLOCK_CHARS characters, or one item."""
    spark = benchmark.sparkSession
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).where(F.trim("t") != "").distinct()
    size = usable.agg(F.sum(F.length("t")).alias("n"), F.max(F.length("t")).alias("top")).first()
    if not size["n"]:
        return
    blocks = -(-size["n"] // BLOCK_CHARS)
    block = lambda: F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks))
    while usable.groupBy(block().alias("k")).agg(F.sum(F.length("t")).alias("n")).agg(F.max("n")).first()[0] > max(2 * BLOCK_CHARS, size["top"]):
        blocks *= 2
    for k in range(blocks):
        part = usable if blocks == 1 else usable.where(block() == k)
        yield spark.sparkContext.broadcast([(r["item_id"], r["t"]) for r in part.collect()])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """docs without the rows that hold an item, as contaminated() tells: a filter, block by block, without a shuffle. Null and
    empty texts stay."""
    for shared in _blocks(benchmark):
        docs = docs.where(~_holds(shared, rate)(F.coalesce(text, F.lit(""))))
    return docs


def _holds(shared, rate: float):
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = Searcher(shared.value, rate)
        for texts in batches:
            yield pa.array([bool(searcher.find(t.as_py())) for t in texts], pa.bool_())

    return holds


def _search(shared, rate: float, ident: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, rate)
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if t.is_valid for hit in searcher.find(t.as_py())]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[ident, "item_id", "edits", "end"])

    return search
