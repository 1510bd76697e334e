"""Removal of long byte strings that occur more than once in a corpus: suffix arrays over shards by content.

Each window of WIDTH bytes has an anchor, the least hash among its GRAM-byte strings; equal windows have equal anchors at
the same distance. The windows with one anchor are a stretch of text, a segment. Most anchors' strings occur
once in the corpus, so their windows do too. Equal segments under an anchor repeat all their windows. What is left are
anchors with several different segments: those segments, one of each kind, are dealt into shards by their anchor, and
a shard's suffix array with its permuted common prefixes tells which windows repeat.

So no window is compared that can't repeat. The segments of most anchors fit in one shard, and shards need nothing from each
other. An anchor with more is dealt over as many shards as its bytes need: each of them finds the repeats within itself in the same
way. What its shards share is found by blocks of windows: equal windows lie at one distance from their anchor, so blocks of distances
compare. Where no other shard holds the bytes that all windows of a block have in common, none of them repeats there; only
other blocks are cut into smaller ones, down to single windows.

Passages of WORDS words that several rows share may be shorter than WIDTH bytes. They are found beside that and remove nothing: a row's
words, as hashes, are cut into segments in the same way, and their segments take the same steps, but only other rows count. Different
segments under one anchor are compared by their windows' 128-bit digests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import written
from wardline.llm.minhash import _BASE, _MIX, _powers, _scatter, word_hashes
from wardline.llm.suffix import repeated_windows

WIDTH, GRAM = 400, 160
#: Words of a passage that rows share, and of the strings among which its anchor is chosen.
WORDS, WORD_GRAM = 51, 20
#: Windows of a text that are looked at together; bounds a task's memory whatever a text's length.
CHUNK = 1 << 20
#: Bytes in a shard, about: what a suffix array is sorted in without leaving the processor's caches.
SHARD_BYTES = 1 << 20
#: Distances from the anchor in a block, step by step, where shards of one anchor are compared.
BLOCKS = (64, 8, 1)

_POW, _INV = _powers(_BASE, CHUNK + WIDTH), _powers(pow(_BASE, -1, 2**64), CHUNK + WIDTH)
_LOW = np.uint64((1 << 24) - 1)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w adjacent values, by running minima from both ends of blocks of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def passage_words(data: bytes | pa.Buffer, chunk: int = CHUNK) -> np.ndarray:
    """A hash of each word of a text, in order; about chunk bytes are looked at together, and a word of any length is whole."""
    view, parts, at = memoryview(data), [], 0
    while len(view) - at > chunk:
        space = _SPACE.search(view, at + chunk)
        if not space:
            break
        parts.append(word_hashes(view[at : space.start()]))
        at = space.start()
    return np.concatenate([*parts, word_hashes(view[at:])])


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def segments(data: bytes | np.ndarray, width: int = WIDTH, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each segment of a text, or of the hashes of its words, in order; chunk is at most CHUNK."""
    fps, firsts, counts = [], [], []
    raw = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) - width + 1, chunk):
        part = raw[at : at + chunk + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_MIX[part] if part.dtype == np.uint8 else part) * _POW[: len(part)], out=sums[1:])
        h = _scatter((sums[gram:] - sums[:-gram]) * _INV[: len(part) - gram + 1])
        # the place in the low bits: the least value is the leftmost of the least hashes
        chosen = _least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & _LOW
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        fps.append(h[chosen[first].astype(np.int64)])
        firsts.append(first + at)
        counts.append(np.diff(np.append(first, len(chosen))))
    none = np.empty(0, np.int64)
    return (np.concatenate(fps) if fps else none.astype(np.uint64)), np.concatenate([none, *firsts]), np.concatenate([none, *counts])


def _digests(data: pa.Buffer | np.ndarray, unit: int, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """A hash of what the windows of each segment cover; a window has width parts of unit bytes."""
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data).cast("B")
    return np.array([digest(view[unit * i : unit * (i + m + width - 1)]) for i, m in zip(first.tolist(), count.tolist(), strict=True)], np.uint64)


def word_segments(lists: list[np.ndarray], words: int = WORDS, gram: int = WORD_GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, which list, first window, number of windows, fresh) of each segment of lists of hashes of words.

    fresh is 2 for the first segment of its list under an anchor, 1 for the first with its content, else 0. Each list has `words` words at least."""
    size = np.array([len(x) for x in lists])
    base, every = np.cumsum(size) - size, np.concatenate(lists)
    fp, first, count = segments(every, words, min(gram, words))
    # a segment has one anchor, so its windows within lists, if it has any, are in the list where its last window begins
    stop = first + count
    of = np.searchsorted(base, stop - 1, side="right") - 1
    first, stop = np.maximum(first, base[of]), np.minimum(stop, (base + size - words + 1)[of])
    left = stop > first
    fp, of, first, count = fp[left], of[left], first[left], (stop - first)[left]
    s = _digests(every, 8, first, count, words)
    fresh = np.zeros(len(fp), np.int8)
    for x in (fp, s):
        order = np.lexsort((x, of))
        fresh[order[np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (of[order][1:] != of[order][:-1])])]] += 1
    return fp, s, of, first - base[of], count, fresh


#: Words of rows that are cut into segments together.
TOGETHER = 1 << 16


def _records(keyed: DataFrame, width: int, words: int) -> DataFrame:
    """(fp, s, k1, k2, at, n, word, fresh): every segment of every row; s is a hash of its content, n its windows, word tells segments of
    words from those of bytes. fresh is as in word_segments, and 2 for all segments of bytes: there, a row's repeats count."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            parts, ids, lists, held = [], [], [], 0

            def put(of: np.ndarray, fp: np.ndarray, s: np.ndarray, first: np.ndarray, count: np.ndarray, word: bool, fresh: np.ndarray) -> None:
                parts.append((fp.view(np.int64), s.view(np.int64), k1[of], k2[of], first.astype(np.int32), count.astype(np.int32), np.full(len(fp), word), fresh))

            for i, text in enumerate(batch.column(2)):
                data = text.as_buffer() if text.is_valid else None
                if data is None:
                    continue
                if data.size >= width:
                    fp, first, count = segments(data, width)
                    put(np.full(len(fp), i), fp, _digests(data, 1, first, count, width), first, count, False, np.full(len(fp), 2, np.int8))
                if data.size >= 2 * words - 1 and len(hashes := passage_words(data)) >= words:
                    ids.append(i)
                    lists.append(hashes)
                    held += len(hashes)
                if held >= TOGETHER:
                    fp, s, of, first, count, fresh = word_segments(lists, words)
                    put(np.array(ids)[of], fp, s, first, count, True, fresh)
                    ids, lists, held = [], [], 0
            if lists:
                fp, s, of, first, count, fresh = word_segments(lists, words)
                put(np.array(ids)[of], fp, s, first, count, True, fresh)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["fp", "s", "k1", "k2", "at", "n", "word", "fresh"])

    return keyed.select("k1", "k2", "data").mapInArrow(cut, "fp long, s long, k1 long, k2 long, at int, n int, word boolean, fresh byte")


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, words: int = WORDS) -> DataFrame:
    """docs with n_bytes, removed (array of structs start, stop: maximal runs of bytes), kept (binary, without them) and shared_words.

    A byte is removed if a string of `width` bytes that covers it also starts anywhere else in the corpus, in the same
    text or another; strings never span texts and are judged on the input. Texts are taken as UTF-8; null texts are
    empty. Rows that repeat are copies of each other and lose everything if they are long enough. Very long texts are
    read whole, a chunk of windows at a time. An empty table stays empty. Columns of docs called n_bytes, removed,
    kept or shared_words are replaced; others may have any name.

    shared_words is how many words (runs of bytes other than ASCII white space) of a row stand in passages of `words` words that
    another row has too, whatever their bytes and the space between them. What only one row repeats is not shared, and rows that
    repeat share everything.
    """
    docs = docs.drop("n_bytes", "removed", "kept", "shared_words")
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in names]
    # a row travels as one column, so that its names meet no others; k1 and k2 stand for its content
    keyed = docs.select(F.struct(*names).alias("row"), data.alias("data"), F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), data).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).alias("k2"))
    records = written(_records(keyed, width, words), "segments")
    count = lambda least: F.sum((F.col("fresh") >= least).cast("int")).alias("c")
    anchors = records.groupBy("fp").agg(count(2), F.min("s").alias("s0"), F.max("s").alias("s1")).where("c > 1").select("fp", (F.col("s0") != F.col("s1")).alias("mixed"))
    # what is joined is written first: then both sides have a shuffle of their own, and a hot anchor's can be split
    again = written(records.join(written(anchors, "anchors"), "fp"), "repeated-anchors")
    kinds = again.where("mixed").groupBy("fp", "s").agg(F.min(F.struct("k1", "k2", "at")).alias("rep"), count(1), F.min("n").alias("n"), F.bool_and("word").alias("word"))
    kinds = written(kinds, "kinds")
    # segments that occur twice repeat whole; single ones are compared with the other kinds of their anchor
    marked = again.join(kinds.select("fp", "s", "rep", "c"), ["fp", "s"], "left").select("k1", "k2", "fp", "s", "at", "n", "word", (~F.col("mixed") | (F.coalesce("c", F.lit(2)) > 1)).alias("whole"), (F.col("rep") == F.struct("k1", "k2", "at")).alias("rep"))
    # a set: rows that repeat have one key and the same segments
    lists = marked.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n", "fp", "s", "word", "whole", F.coalesce("rep", F.lit(False)).alias("rep"))).alias("segs"))
    # a text travels once, in its row
    held = written(keyed.select("row", "k1", "k2").join(written(lists, "row-segments"), ["k1", "k2"], "left"), "held")
    held = held.withColumn("data", F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary"))
    touched = held.where("segs is not null")
    of_bytes = kinds.where("not word")
    verdicts = _judged(touched, of_bytes, width)

    single = of_bytes.where("c = 1").select("rep.k1", "rep.k2", "fp", "s", "rep.at")
    found = single.join(verdicts, ["fp", "s"]).select("k1", "k2", F.explode("runs").alias("r"), "at").groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b"))).alias("found"))
    shared = _shared(touched, words)
    sure = lambda word: F.transform(F.filter("segs", lambda x: x["whole"] & (x["word"] == word)), lambda x: F.struct(x["at"].alias("a"), (x["at"] + x["n"]).alias("b")))
    more = lambda c: F.coalesce(c, F.array().cast("array<struct<a:int,b:int>>"))
    joined = touched.join(written(found, "found"), ["k1", "k2"], "left").join(written(shared, "shared"), ["k1", "k2"], "left")
    joined = joined.select("row", "data", F.concat(sure(False), more("found")).alias("wins"), F.concat(sure(True), more("shared")).alias("passages"))
    rest = held.where("segs is null").select("row", F.octet_length("data").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,stop:long>>").alias("removed"), F.col("data").alias("kept"), F.lit(0).cast("long").alias("shared_words"))
    return _prune(joined, width, words).union(rest).select("row.*", "n_bytes", "removed", "kept", "shared_words")


def _shared(touched: DataFrame, words: int) -> DataFrame:
    """(k1, k2, shared): runs of windows of words that other rows have too, in segments that no other row has whole.

    Such a segment stands in one row only. Its windows are held against each other row's, and against one copy of each segment
    that several rows have."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ident, at, sure, content = [], [], [], []
            for i, (segs, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                view = memoryview(passage_words(t.as_buffer())).cast("B")
                for x in segs:
                    places = range(x["at"], x["at"] + x["n"])
                    ident.append(np.full(len(places), i))
                    at.extend(places)
                    sure.append(np.full(len(places), x["whole"]))
                    content.extend(digest(view[8 * p : 8 * (p + words)]) for p in places)
            halves = np.frombuffer(b"".join(content), np.int64).reshape(-1, 2)
            rows = batch.select([0, 1]).take(pa.array(np.concatenate(ident) if ident else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at, pa.int32()), pa.array(np.concatenate(sure) if sure else np.empty(0, bool)), *(pa.array(np.ascontiguousarray(halves[:, j])) for j in (0, 1))], names=["k1", "k2", "at", "sure", "i1", "i2"])

    asked = F.filter("segs", lambda x: x["word"] & (~x["whole"] | x["rep"]))
    windows = touched.select("k1", "k2", asked.alias("segs"), "data").where("size(segs) > 0").mapInArrow(cut, "k1 long, k2 long, at int, sure boolean, i1 long, i2 long")
    windows = written(windows, "passage-windows")
    both = windows.groupBy("i1", "i2").agg(*(f(c).alias(f"{c}_{name}") for c in ("k1", "k2") for name, f in (("lo", F.min), ("hi", F.max))), F.bool_or("sure").alias("sure"), F.bool_and("sure").alias("known"))
    both = both.where("not known and (sure or k1_lo <> k1_hi or k2_lo <> k2_hi)").select("i1", "i2")
    places = windows.where("not sure").join(written(both, "shared-windows"), ["i1", "i2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("at").alias("at"))
    return places.select("k1", "k2", F.transform("at", lambda i: F.struct(i.alias("a"), (i + 1).alias("b"))).alias("shared"))


def _prune(rows: DataFrame, width: int, words: int) -> DataFrame:
    """Turn repeated windows into maximal runs of removed bytes, and take them out; rows has (row, data, wins, passages)."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, kept, shared = [], [], [], []
            for data, wins, passages in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                depth = np.zeros(len(raw) + 1, np.int64)
                for w in wins:
                    depth[w["a"]] += 1
                    depth[w["b"] + width - 1] -= 1
                gone = np.cumsum(depth)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
                size.append(len(raw))
                removed.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(raw[~gone].tobytes())
                covered = end = 0
                for a, b in sorted((x["a"], x["b"] + words - 1) for x in passages):
                    covered += max(0, b - max(a, end))
                    end = max(end, b)
                shared.append(covered)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()), pa.array(shared, pa.int64())], names=["row", "n_bytes", "removed", "kept", "shared_words"])

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n_bytes long, removed array<struct<start:long,stop:long>>, kept binary, shared_words long").fields])
    return rows.select("row", "data", "wins", "passages").mapInArrow(prune, schema)


def _judged(touched: DataFrame, kinds: DataFrame, width: int) -> DataFrame:
    """(fp, s, runs): runs of repeated windows, within a segment, of segments that stand in a mixed group."""
    per = kinds.groupBy("fp").agg(F.sum(F.col("n") + width).alias("bytes"))
    total = per.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    wide = written(per.where(F.col("bytes") > SHARD_BYTES).select("fp", F.ceil(F.col("bytes") / SHARD_BYTES).cast("int").alias("parts")), "wide-anchors")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, s, whole, body = [], [], [], []
            for segs, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(t.as_buffer())
                for x in segs:
                    fp.append(x["fp"])
                    s.append(x["s"])
                    whole.append(x["whole"])
                    body.append(bytes(view[x["at"] : x["at"] + x["n"] + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(s, pa.int64()), pa.array(whole, pa.bool_()), pa.array(body, pa.binary())], names=["fp", "s", "whole", "body"])

    reps = touched.select(F.filter("segs", lambda x: x["rep"] & ~x["word"]).alias("segs"), "data").where("size(segs) > 0").mapInArrow(fetch, "fp long, s long, whole boolean, body binary")
    # a row that stands twice in the table names its segment twice
    one = reps.dropDuplicates(["fp", "s"])
    narrow = F.pmod(F.xxhash64("fp"), F.lit(shards))

    def shard(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_runs(t.column("fp"), t.column("s"), repeated_windows(t.column("body").to_pylist(), width))])

    def judged(dealt: DataFrame) -> DataFrame:
        return dealt.select("shard", "fp", "s", "body").groupBy("shard").applyInArrow(shard, "fp long, s long, runs array<struct<a:int,b:int>>")

    if wide.isEmpty():
        return judged(one.withColumn("shard", narrow))
    dealt = one.join(wide, "fp", "left").withColumn("shard", F.when(F.col("parts").isNull(), narrow).otherwise(F.xxhash64("fp", F.pmod(F.xxhash64(F.lit(3), "s"), F.col("parts")))))
    dealt = written(dealt, "bodies")
    within = written(judged(dealt), "judged")
    spread = dealt.where("parts is not null").drop("parts").join(within, ["fp", "s"], "left")
    return within.union(_across(written(spread, "wide-bodies"), width))


def _across(spread: DataFrame, width: int) -> DataFrame:
    """(fp, s, runs): windows that stand in several shards of an anchor and that their own shard, whose runs are given, has once.

    A block is asked for while it has such windows. Of the other blocks with the same windows one is enough."""
    asked, parent = spread.withColumn("blocks", F.lit(None).cast("array<int>")), None
    for size in BLOCKS:
        rows = written(_blocks(asked, size, parent, width), "blocks")
        key = ["fp", "b", "i1", "i2"]
        shared = rows.groupBy(*key).agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.bool_or("open").alias("asked")).where("lo <> hi and asked").select(*key)
        rows = written(rows.join(written(shared, "shared-blocks"), key, "left_semi"), "blocks-left")
        if size > 1:
            same = rows.where("not open").groupBy("fp", "shard", "b", "u1", "u2").agg(F.min("s").alias("s")).select("fp", "s", "b")
            left = rows.where("open").select("fp", "s", "b").union(same).groupBy("fp", "s").agg(F.collect_set("b").alias("blocks"))
            asked, parent = spread.join(written(left, "blocks-asked"), ["fp", "s"]), size
    return rows.where("open").groupBy("fp", "s").agg(F.transform(F.array_sort(F.collect_set("at")), lambda i: F.struct(i.alias("a"), (i + 1).alias("b"))).alias("runs"))


def _blocks(asked: DataFrame, size: int, parent: int | None, width: int) -> DataFrame:
    """A row for each block of `size` distances of each segment, within the given blocks of `parent` distances or everywhere.

    i1, i2 are a digest of what all windows of the block share, u1, u2 one of what the segment's windows in it cover; open says
    whether one of these is not known to repeat, and at is the first of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ident, b, at, opened, common, covered = [], [], [], [], [], []
            for i, (body, whole, runs, blocks) in enumerate(zip(batch.column(0), *(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                view = memoryview(body.as_buffer())
                known = np.full(len(view) - width + 1, whole)
                for r in runs or ():
                    known[r["a"] : r["b"]] = True
                far = _anchor_place(view[:width])
                near = far - len(known) + 1
                chosen = None if blocks is None else set(blocks)
                for k in range(near // size, far // size + 1):
                    if chosen is not None and k * size // parent not in chosen:
                        continue
                    low, high = k * size, k * size + size - 1
                    first, last = far - min(high, far), far - max(low, near)
                    ident.append(i)
                    b.append(k)
                    at.append(first)
                    opened.append(not known[first : last + 1].all())
                    common.append(digest(view[far - low : far - high + width]))
                    covered.append(digest(view[first : last + width], seed=far - first))
            halves = [np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (common, covered)]
            ids = batch.select(["fp", "s", "shard"]).take(pa.array(ident, pa.int64()))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(b, pa.int32()), pa.array(at, pa.int32()), pa.array(opened, pa.bool_()), *(pa.array(np.ascontiguousarray(h[:, j])) for h in halves for j in (0, 1))], names=_CUT)

    return asked.select("body", "whole", "runs", "blocks", "fp", "s", "shard").mapInArrow(cut, "fp long, s long, shard long, b int, at int, open boolean, i1 long, i2 long, u1 long, u2 long")


_CUT = ["fp", "s", "shard", "b", "at", "open", "i1", "i2", "u1", "u2"]


def _anchor_place(window: memoryview, gram: int = GRAM) -> int:
    """Where the anchor of a window begins in it."""
    part = np.frombuffer(window, np.uint8)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_MIX[part] * _POW[: len(part)], out=sums[1:])
    return int(np.argmin(_scatter((sums[gram:] - sums[:-gram]) * _INV[: len(part) - gram + 1]) & ~_LOW))


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _runs(fp, s, marks: list[np.ndarray]) -> pa.RecordBatch:
    found = []
    for m in marks:
        e = np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]))).tolist()
        found.append([{"a": a, "b": b} for a, b in zip(e[::2], e[1::2], strict=True)])
    keep = pa.array([bool(x) for x in found], pa.bool_())
    return pa.RecordBatch.from_arrays([fp.combine_chunks(), s.combine_chunks(), pa.array(found, _RUNS)], names=["fp", "s", "runs"]).filter(keep)
