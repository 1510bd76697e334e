"""Rate limits in batches and streams against a walk through all requests in order."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.streaming.limits import decide_hits, rate_limit, rate_limit_stream

REQUEST = "id long, key string, s double"


def plain(rows, limit, window):
    by = defaultdict(list)
    for i, k, t in rows:
        if t is not None:
            by[k].append((t, i))
    out = {i: None for i, _, t in rows if t is None}
    for hits in by.values():
        hits.sort()
        out |= {i: a for (_, i), a in zip(hits, decide_hits([t for t, _ in hits], [], limit, window)[0], strict=True)}
    return out


def made(seed, n=3000):
    """Quiet keys, one with a third of all requests, bursts, ties, requests a window apart, null keys and times."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None, "d"])
        t = rnd.choice([rnd.uniform(0, 5000), rnd.choice([60.0, 120.0, 600.0, 660.0, 720.5]) + rnd.randint(0, 20), float(rnd.randint(0, 300))])
        rows.append((i, k, None if i % 500 == 7 else round(t, 3)))
    return rows


@pytest.mark.parametrize(("limit", "window"), [(1, 60.0), (3, 60.0), (30, 60.0), (5, 7.5)])
def test_batches_equal_a_walk(spark, limit, window):
    rows = made(limit)
    d = spark.createDataFrame(rows, REQUEST).select("id", "key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    got = {r["id"]: r["allowed"] for r in rate_limit(d, "key", "ts", "id", limit, window).collect()}
    assert got == plain(rows, limit, window)
    assert rate_limit(d.limit(0), "key", "ts", "id").count() == 0


def test_a_busy_key_is_walked_in_many_parts(spark):
    rows = [(i, "k", (i // 5) * 200.0 + i % 5) for i in range(1000)]  # a burst above the limit every 200 seconds
    d = spark.createDataFrame(rows, REQUEST).select("id", "key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    out = rate_limit(d, "key", "ts", "id", 3, 60.0)
    assert {r["id"]: r["allowed"] for r in out.collect()} == plain(rows, 3, 60.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rate_limit(d, "key", "ts", "id", 3, 60.0).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_streams_decide_as_batches_do(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(i, k, t) for i, k, t in made(9, 600) if t is not None and k is not None]
    rows.sort(key=lambda r: r[2])
    rnd = random.Random(1)
    came = sorted(rows, key=lambda r: r[2] + rnd.uniform(0, 50))  # up to 50 seconds late
    came.insert(300, came[299])  # a request that is sent twice
    end = [(10_000, "end", 20_000.0)]  # takes the watermark past all others
    late = [(20_000, "a", 1.0)]
    shape = lambda part: spark.createDataFrame(part, REQUEST).select("id", "key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    folder = str(tmp_path / "in")
    for part in (came[:150], came[150:300], came[300:450], came[450:], end, late, [(10_001, "end", 30_000.0)]):
        shape(part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken in the order of their times
    stream = spark.readStream.schema("id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    out = rate_limit_stream(stream, "key", "ts", "id", 3, 60.0)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = [(r["id"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["id"] < 10_000]
    assert len(got) == len(dict(got)) and dict(got) == plain(rows, 3, 60.0)  # each once, as in a batch; the late one is dropped
