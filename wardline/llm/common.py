"""What several corpus operators share: the shared folder, written tables, row keys and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir) as a full URI. Where it is unset, one is made in local mode, as in
    tests; on a cluster that is an error, since no folder of the driver's is shared."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        base = sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wardline-")
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/wardline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and a lost executor costs nothing.

    The size of such a table grows with the input and its files are far smaller than its rows in memory, so a join with it
    shuffles both sides instead of broadcasting it by the size of its files."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def drop_written(df: DataFrame) -> None:
    """Delete the folder of a table that written() made, when nothing will read it any more."""
    spark = df.sparkSession
    mine = shared_folder(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for folder in folders:
        if "/wardline-" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(mine.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit columns k1, k2 that stand for a row's content; equal rows get equal keys, nulls included."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("k2")]


def salted_lookup(rows: DataFrame, facts: DataFrame, keys: list[str], deal_by: list[str], salts: int = 16) -> DataFrame:
    """rows left-joined with facts (at most one row for each value of keys) where a few keys may hold most rows.

    Rows are dealt out by a hash of deal_by besides the key, and each fact is repeated for every salt, so that no
    task gets all rows of a hot key. Null keys find nothing.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*deal_by), F.lit(salts)).cast("int"))
    spread = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*keys, "__salt"], "left").drop("__salt")


#: Edges that one task handles at least while components settle.
EDGES_A_TASK = 50_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long) by alternating large and small stars.

    Returns (id, component): every id that occurs in an edge, with the smallest id it reaches. The number of rounds grows
    with the logarithm of the longest chain. A hub's neighbours are never gathered: only minima are aggregated, and they are
    written before they are joined with the edges, so that both sides of the join have a shuffle of their own and Spark can
    split the hub's.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    before, count = None, e.count()
    for _ in range(max_rounds):
        few = count // EDGES_A_TASK + 1  # few edges need few tasks and files
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(few), "least")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large.coalesce(few), "large-stars")
        # large star: larger neighbours point to the least one; now small star: the others do, and the node itself
        least = written(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(few), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b")
        new = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(few), "edges")
        sign = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        for old in (e, low, large, least):
            drop_written(old)
        e = new
        if before == (sign["n"], sign["h"]):
            break
        before, count = (sign["n"], sign["h"]), sign["n"]
    else:
        raise RuntimeError("connected components did not settle")
    low = e.groupBy("a").agg(F.min("b").alias("component"))
    roots = e.select("b").distinct().join(low.select(F.col("a").alias("b")), "b", "left_anti")
    return low.select(F.col("a").alias("id"), "component").union(roots.select(F.col("b").alias("id"), F.col("b").alias("component")))
