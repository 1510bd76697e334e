"""MinHash near-dedup by an inverted join on signature coordinates.

Each text becomes the set of its distinct five-word shingles (64-bit hashes of the words in order) and a signature of
K minima. Two sets whose similarity is 0.75 agree in about 48 of 64 coordinates, and in fewer than T = 28 with a
probability of about 2.5e-8. Documents are posted under their coordinate-value pairs, but only under a prefix: with all
pairs in order of how many documents share them, two documents that agree in T coordinates meet among the first
K - T + 1 of each. Pairs that nobody shares come first and need no posting, so a document that shares fewer than T
pairs with others, such as one with a common passage, is skipped altogether. Agreements are counted on the signatures
of documents that meet in a list, and pairs with T of them go on to the exact test on the full sets.

Lists are not expanded into all their pairs. Equal sets are one class from the start. Each class is first tested
against one class that it meets, the one whose pairs are shared most, and what is linked so far is contracted. Only classes
in lists that still hold several components go on. Among those, pairs are formed by the shingles themselves, the rarest
first: two sets with a similarity of 0.75 share a shingle within the first quarter of the larger one's and within the first
seventh of the smaller one's, and their places there bound the intersection. So copies that stay under 0.75 among thousands
of their kind form no pairs, since their own shingles come first. The pairs across components that are left must agree in T coordinates too,
and are tested on the full sets. Texts move once; pairs carry hashed sets, and a join's hot side can be split because the other side is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import connected_components, salted_lookup, written

K, T = 64, 28
WORDS = 5
#: Links join sets with 100 * |intersection| >= PERCENT * |union|.
PERCENT = 75
_rng = np.random.Generator(np.random.PCG64(20240229))
_MIX = _rng.integers(0, 2**64, 256, np.uint64)
_TIMES = _rng.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**32, K, np.uint32)
_MUL = _rng.integers(0, 2**32, K, np.uint32) | np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, 1 << 16), _powers(pow(_BASE, -1, 2**64), 1 << 16)


def _scatter(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, words being runs of bytes other than ASCII white space."""
    global _POW, _INV
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    if len(data) > len(_POW):
        n = 1 << len(data).bit_length()
        _POW, _INV = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
    start, stop = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[data] * _POW[: len(data)], out=sums[1:])
    return _scatter((sums[stop] - sums[start]) * _INV[start] + (stop - start).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text: five words each, or all its words as one if there are fewer."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        total += w[j : len(w) - n + 1 + j] * _TIMES[j % len(_TIMES)]
    return np.unique(_scatter(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """K minima of the low halves of the hashes under K bijections, as int32."""
    low = hashes.astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, ((low[None, i : i + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=out)
    return out.view(np.int32)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signed(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): set size, a 128-bit digest of the set, and the signature (null if empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sigs, empty = [], [], [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py())
                digest = xxhash.xxh3_128_digest(h.tobytes())
                n.append(len(h))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                sigs.append(signature(h))
                empty.append(not len(h))
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *sigs]), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * K, pa.int32()), flat, mask=pa.array(empty, pa.bool_())) if n else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(cid, n, set, hs): how many shingles each text has, a hash of all, and they themselves as sorted 64-bit hashes; texts has (cid, text)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            whole = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(whole), lists], names=["cid", "n", "set", "hs"])

    return texts.select("cid", "text").mapInArrow(spell, "cid long, n int, set long, hs array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; sets has (cid, hs). No set is gathered with another but in its pair."""
    one, two = sets.select(F.col("cid").alias("a"), F.col("hs").alias("ha")), sets.select(F.col("cid").alias("b"), F.col("hs").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= PERCENT * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link and whose signatures agree in T coordinates; other columns of pairs stay."""
    one = sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    two = sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.where((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (same >= T)).drop("sa", "sb", "na", "nb")


def _mixed(lists: DataFrame) -> DataFrame:
    """The classes (cid, comp) in lists (key, cid, comp) that hold several components."""
    mixed = written(lists.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key"), "mixed")
    return lists.join(mixed, "key", "left_semi").select("cid", "comp").distinct()


def _across(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of classes (cid, comp) of different components that may be similar, by prefixes of their shingles.

    A class's shingles stand in order of how many classes have them (then by hash). Sets x and y, |x| <= |y|, with an
    intersection of at least PERCENT percent of their union share one of x's first |x| - ceil(2p / (1 + p) |x|) + 1
    shingles and one of y's first |y| - ceil(p |y|) + 1, p = PERCENT / 100; for the first that they share, what lies behind it in
    either order bounds the intersection. Shingles that one class has alone come first and are never posted.
    """
    # an id may stand for several sets: each has its own order
    held = sets.join(classes, "cid").select("cid", "comp", "set", "n", F.explode("hs").alias("h"))
    often = written(held.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "shared-shingles")
    ranked = held.join(often, "h").groupBy("cid", "comp", "set", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("mine"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("mine"))
    large = (F.col("n") - F.ceil(F.col("n") * F.lit(PERCENT) / 100) + 1).cast("int")
    small = (F.col("n") - F.ceil(F.col("n") * F.lit(2 * PERCENT) / (100 + PERCENT)) + 1).cast("int")
    ranked = ranked.withColumn("small", small).where(F.col("alone") < large)
    posted = ranked.select("cid", "comp", "n", "small", "alone", F.posexplode(F.slice("mine", F.lit(1), F.greatest(large - F.col("alone"), F.lit(0)))).alias("i", "p"))
    posted = written(posted.select("cid", "comp", "n", (F.col("i") + F.col("alone")).alias("at"), (F.col("i") + F.col("alone") < F.col("small")).alias("first"), F.col("p.h").alias("h")), "shingle-postings")
    mixed = posted.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("first").alias("any")).where("c0 < c1 and any").select("h")
    posted = written(posted.join(written(mixed, "mixed-shingles"), "h", "left_semi"), "mixed-postings")
    one = posted.where("first").select("h", F.col("cid").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("ix"))
    two = posted.select("h", F.col("cid").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("at").alias("iy"))
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    most = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    possible = (F.col("cx") != F.col("cy")) & ordered & (100 * F.col("nx") >= PERCENT * F.col("ny")) & ((100 + PERCENT) * most >= PERCENT * (F.col("nx") + F.col("ny")))
    return one.join(two, "h").where(possible).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _posted(sigs: DataFrame) -> DataFrame:
    """(key, cid, fame): each class under the prefix of its coordinate-value pairs, the rarest first. fame sums over all its
    pairs how many share them: in a group of copies the text they were made from has most."""
    pairs = sigs.select("cid", F.posexplode("sig").alias("at", "v")).select((F.shiftleft(F.col("at").cast("long"), 32) + F.col("v") + F.lit(1 << 31)).alias("key"), "cid")
    shared = written(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-pairs")
    mine = pairs.join(shared, "key").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("mine")).where(F.size("mine") >= T)
    fame = F.aggregate("mine", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return mine.select("cid", fame.alias("fame"), F.explode(F.slice("mine", 1, F.size("mine") - T + 1)).alias("p")).select(F.col("p.key").alias("key"), "cid", "fame")


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id that links reach, its own included; kept says whether that is the row's own.
    Null texts and texts without words have no shingles and link with nothing. Rows that share a doc_id count as one
    document as regards links; a null doc_id links with nothing, its component is null and it is kept. Ties can't
    occur between different ids. Very long texts are read whole. An empty table gives no rows.
    """
    table = written(signed(docs, text, ident), "signed")
    # classes of equal sets, under the least doc_id; empty sets and null ids stay out
    usable = table.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("cid"), F.max("doc_id").alias("top"))
    sigs = written(usable.join(classes.select("d1", "d2", F.col("cid").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi").dropDuplicates(["d1", "d2", "doc_id"]).select(F.col("doc_id").alias("cid"), "n_shingles", "sig"), "signatures")
    posted = written(_posted(sigs), "postings")
    heads = posted.groupBy("key").agg(F.max(F.struct("fame", (-F.col("cid")).alias("minus"))).alias("top"), F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
    heads = written(heads.select("key", (-F.col("top.minus")).alias("centre"), F.col("top.fame").alias("known")), "lists")
    lists = written(posted.select("key", "cid").join(heads, "key"), "listed")

    stars = written(lists.where("centre <> cid").select(F.col("centre").alias("a"), F.col("cid").alias("b"), "known").distinct(), "stars")
    nearest = _agreeing(stars, sigs).groupBy("b").agg(F.max_by("a", F.struct("known", -F.col("a"))).alias("a")).select("a", "b")
    # texts move once, and only those that meet another; from here on pairs carry hashed sets
    met = written(stars.select(F.col("a").alias("cid")).union(stars.select("b")).distinct(), "met")
    texts = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("cid"), F.col(text).alias("text"))
    sets = written(shingle_sets(texts.join(met, "cid").dropDuplicates()), "sets")
    links = written(confirmed(written(nearest, "nearest"), sets), "links")
    comps = written(connected_components(links), "components")
    apart = lists.select("key", "cid").join(comps.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    rest = written(_mixed(written(apart, "parts")), "rest")
    more = confirmed(written(_agreeing(_across(rest, sets), sigs), "candidates"), sets)
    # rows that share an id but not a set are one document: their classes are linked through the id
    many = usable.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).where("x <> y").select("doc_id")
    same = usable.join(written(many, "ids-of-several-sets"), "doc_id", "left_semi").join(classes.select("d1", "d2", "cid"), ["d1", "d2"])
    ids = same.where("doc_id <> cid").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    final = connected_components(links.union(more).union(ids))

    copies = classes.where("cid < top").select("d1", "d2", "cid")
    rows = salted_lookup(table.select("doc_id", "n_shingles", "d1", "d2"), copies, ["d1", "d2"], ["doc_id"])
    rows = rows.withColumn("cid", F.when(F.col("n_shingles") > 0, F.coalesce("cid", "doc_id")).otherwise(F.col("doc_id")))
    moved = final.where("component < id").select(F.col("id").alias("cid"), "component")
    rows = salted_lookup(rows, moved, ["cid"], ["doc_id"]).withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "cid")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))
