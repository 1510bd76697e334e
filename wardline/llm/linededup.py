"""Line dedup by distinct-site spread.

Each distinct line (a 128-bit hash) gets HyperLogLog sketches of the sites (sources) it occurs on and of the whole texts
it occurs in; sketches merge by aggregation. Lines whose estimate is far below the threshold stay and those far above go;
lines near it get exact distinct counts first. What goes is removed from every document, whatever is left of it.

Copies of one text, on however many sites, count once: a line needs as many different texts as sites, so what only
copies share isn't boilerplate and stays for near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import row_key, salted_lookup, written

#: A line on so many distinct sites, in as many different texts, is boilerplate.
SITES = 10
#: log2 of the sketches' registers; a relative standard error of 1.04 / sqrt(2 ** LOG_K), here 3.3 %.
LOG_K = 10
#: Estimates within this factor of the threshold are near it: six standard errors.
NEAR = 0.2


def _hashes(line):
    return [F.xxhash64(line).alias("l1"), F.xxhash64(F.lit(1), line).alias("l2")]


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """(l1, l2, sites): hashes of lines that are on at least `sites` distinct sites and in as many different whole
    texts. Lines of white space only don't count, nor does a null site.

    Lines are counted first, with partial sums before the shuffle: a line seen fewer than `sites` times, as most are,
    never gets a sketch. Sketches are built where the rows are and only they are shuffled, so a line that fills a third
    of all rows weighs no more than any other.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = docs.where(F.col(site).isNotNull()).select(F.xxhash64(F.col(site).cast("string")).alias("site"), F.xxhash64(whole).alias("whole"), F.explode(F.split(whole, "\n")).alias("line")).where(F.col("line").rlike(r"\S"))
    slim = lines.select(*_hashes(F.col("line")), "site", "whole")
    # a line seen fewer than `sites` times can't be on as many sites: most lines end here, before any sketch
    several = (F.col("s0") != F.col("s1")) & (F.col("w0") != F.col("w1")) if sites > 1 else F.lit(True)
    seen = slim.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.min("site").alias("s0"), F.max("site").alias("s1"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where((F.col("n") >= sites) & several).select("l1", "l2")
    # over salts: a line in a third of all rows meets the few that are looked for in many tasks, and is summed up there
    among = lambda few: salted_lookup(slim, few.withColumn("there", F.lit(True)), ["l1", "l2"], ["whole", "site"]).where("there")
    repeated = among(seen)
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LOG_K)))
    sketched = repeated.groupBy("l1", "l2").agg(sketch("site").alias("est"), sketch("whole").alias("texts"))
    sketched = written(sketched.where(F.least("est", "texts") >= sites * (1 - NEAR)), "spread")
    far = sketched.where(F.least("est", "texts") > sites * (1 + NEAR)).select("l1", "l2", F.col("est").cast("long").alias("sites"))
    near = sketched.where(F.least("est", "texts") <= sites * (1 + NEAR))
    # only what is near the threshold is counted exactly, sites or texts
    exactly = lambda c, est: F.when(F.max(est) > sites * (1 + NEAR), F.max(est)).otherwise(F.count_distinct(F.when(F.col(est) <= sites * (1 + NEAR), F.col(c)))).cast("long")
    exact = among(near).groupBy("l1", "l2").agg(exactly("site", "est").alias("sites"), exactly("whole", "texts").alias("texts")).where(F.least("sites", "texts") >= sites).select("l1", "l2", "sites")
    return far.union(exact)


def remove_lines(docs: DataFrame, gone: DataFrame, text: str = "text") -> DataFrame:
    """docs without the lines in gone, and n_lines_removed. Columns and their order stay; n_lines_removed comes last.

    The hashes to remove are gathered for each document, as many as it has such lines, and joined to it by its
    content; documents without such lines stay as they are, null texts too. A document of such lines only becomes empty.
    """
    keys = row_key(*docs.columns)
    keyed = docs.select("*", *[k.alias(f"__{n}") for k, n in zip(keys, ("k1", "k2"), strict=True)])
    lines = keyed.select("__k1", "__k2", F.explode(F.array_distinct(F.split(F.coalesce(text, F.lit("")), "\n"))).alias("line")).select("__k1", "__k2", *_hashes(F.col("line")))
    hits = lines.join(gone.select("l1", "l2"), ["l1", "l2"], "left_semi").groupBy("__k1", "__k2").agg(F.collect_set("l1").alias("__gone"))
    joined = keyed.join(hits, ["__k1", "__k2"], "left")
    parts = F.split(F.col(text), "\n")
    left = F.filter(parts, lambda x: ~F.array_contains("__gone", F.xxhash64(x)))
    hit = F.col("__gone").isNotNull()
    out = [F.when(hit, F.array_join(left, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns if c != "n_lines_removed"]
    return joined.select(*out, F.when(hit, F.size(parts) - F.size(left)).otherwise(0).cast("long").alias("n_lines_removed"))


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """docs without the lines that at least `sites` distinct sites share in different texts, and n_lines_removed.

    Null texts stay null, empty ones empty; null sites count for nothing, yet their documents lose boilerplate too; repeated
    rows count as one site and one text; very long lines and texts are hashed and cut whole. A line on exactly `sites` sites goes.
    An empty table stays empty. A column called n_lines_removed is replaced; others may have any name.
    """
    gone = written(boilerplate(docs, text, site, sites), "boilerplate")
    return remove_lines(docs, gone, text)
