"""Rate limits and streams: the same analysis over readStream, and a sliding window whose denials don't count."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, WINDOW = 30, 60.0


def decide_hits(times: list[float], recent: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Whether each request of a key, in order of time, is allowed; a hit exactly a window old still counts, a denial never does."""
    out = []
    for now in times:
        recent = [t for t in recent if now - t <= window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(now)
    return out, recent


def rate_limit(requests: DataFrame, key: str, ts: str, ident: str, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """(ident, key, now, allowed) for a batch. Requests without a time are neither allowed nor denied (null); null keys are one key.

    Time is cut into stretches of a window each. A stretch is quiet if it and the one before it have no more requests than the limit: all of its requests
    are allowed, wherever they are looked at. Only busy stretches are walked in order, each run of them in a task of its own that begins with the
    hits of the quiet stretch before; nothing that lies further back counts. So a key's requests are spread over many tasks unless it stays
    above its limit all the time. A walk takes rows batch by batch, with only the last `limit` hits carried over.
    """
    step = int(window * 1e6)
    d = requests.select(F.col(ident).cast("long").alias("id"), F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    d = d.withColumn("stretch", F.floor(F.col("at") / step).cast("long"))
    in_order = Window.partitionBy("key").orderBy("stretch")
    f = d.where("at is not null").groupBy("key", "stretch").agg(F.count("*").alias("n"))
    near = lambda look, c: F.when(look("stretch").over(in_order) == F.col("stretch") + (1 if look is F.lead else -1), look(c).over(in_order))
    f = f.withColumn("busy", F.col("n") + F.coalesce(near(F.lag, "n"), F.lit(0)) > limit)
    f = f.withColumn("head", F.when(F.col("busy") & ~F.coalesce(near(F.lag, "busy"), F.lit(False)), F.col("stretch")))
    f = f.withColumn("run", F.when(F.col("busy"), F.last("head", ignorenulls=True).over(in_order))).withColumn("before", ~F.col("busy") & F.coalesce(near(F.lead, "busy"), F.lit(False)))
    f = f.select(F.col("key").alias("k"), F.col("stretch").alias("s"), "run", "before")
    d = d.join(f, F.col("key").eqNullSafe(F.col("k")) & (F.col("stretch") == F.col("s")), "left")
    # quiet requests go on as they are, spread by their stretch; those before a busy run go to it once more, as what it begins with
    part = lambda kind, place: F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("place"))
    goes = F.when(F.col("run").isNotNull(), F.array(part(2, F.col("run")))).when(F.col("before"), F.array(part(0, F.col("stretch")), part(1, F.col("stretch") + 1))).otherwise(F.array(part(0, F.col("stretch"))))
    d = d.select("id", "key", (F.col("at") / 1e6).alias("now"), F.inline(goes))
    d = d.withColumn("walked", F.when(F.col("kind") > 0, 1).otherwise(0))
    d = d.repartition("key", "walked", "place").sortWithinPartitions("key", "walked", "place", "now", "id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = object(), []
        for pdf in batches:
            allowed = []
            for k, kind, place, now in zip(pdf["key"], pdf["kind"], pdf["place"], pdf["now"], strict=True):
                if not kind:
                    allowed.append(None if now != now else True)
                    continue
                if (k, place) != last:
                    last, recent = (k, place), []
                fine, recent = decide_hits([now], recent, limit, window)
                allowed += fine
            out = pdf.assign(allowed=pd.array(allowed, "boolean"))[pdf["kind"] != 1]
            yield out[["id", "key", "now", "allowed"]]

    return d.mapInPandas(walk, "id long, key string, now double, allowed boolean")


def decisions(due: list[tuple[float, int]], key: tuple, allowed: list[bool]) -> pd.DataFrame:
    keys = pd.Series([key[0]] * len(due), dtype=object)
    return pd.DataFrame({"id": pd.Series([i for _, i in due], dtype="int64"), "key": keys, "now": pd.Series([t for t, _ in due], dtype="float64"), "allowed": pd.Series(allowed, dtype="bool")})


class Limiter(StatefulProcessor):
    """The limit of one key over a stream in event time.

    Requests wait until the watermark has passed them, so that they are decided in order of their time however they came; then hits that
    still count are all that stays. A timer stands at the first request that waits, or a window behind the last hit, when a key is forgotten.
    """

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, now double")
        self.hits = handle.getValueState("hits", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:  # chunk by chunk: a key's rows are never held together here
            self.waiting.appendList(list(zip(pdf["id"].astype("int64").tolist(), pdf["now"].astype(float).tolist(), strict=True)))
            first = min([pdf["now"].min(), *([] if first is None else [first])])
        if first is not None:
            self.handle.registerTimer(int(first * 1000) + 1)
        yield decisions([], key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        held = sorted((now, ident) for ident, now in self.waiting.get())
        due = [(now, ident) for now, ident in held if now < passed]
        left = held[len(due) :]
        recent = list(self.hits.get()[0]) if self.hits.exists() else []
        allowed, recent = decide_hits([now for now, _ in due], recent, self.limit, self.window)
        recent = [t for t in recent if passed - t <= self.window]
        if left:
            self.waiting.put([(ident, now) for now, ident in left])
            self.handle.registerTimer(int(left[0][0] * 1000) + 1)
        else:
            self.waiting.clear()
        if recent:
            self.hits.update((recent,))
            if not left:
                self.handle.registerTimer(int((recent[-1] + self.window) * 1000) + 1)
        else:
            self.hits.clear()
        yield decisions(due, key, allowed)

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, key: str, ts: str, ident: str, limit: int = LIMIT, window: float = WINDOW, delay: str = "1 minute") -> DataFrame:
    """rate_limit() over a stream: the same decisions on the same requests, each as soon as the watermark has passed it.

    Requests may come in any order up to `delay` late; later ones are dropped without a decision, and so are a request's repetitions (its id
    and key again within the delay). Requests without a time are dropped, null keys are none. The session needs RocksDB as its state store."""
    d = requests.select(F.col(ident).cast("long").alias("id"), F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("ts is not null and key is not null")
    d = d.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id", "key"]).withColumn("now", F.unix_micros("ts") / 1e6)
    return d.groupBy("key").transformWithStateInPandas(Limiter(limit, window), "id long, key string, now double, allowed boolean", "Append", "EventTime")


def analyse_stream(stream: DataFrame, analyse, sink_folder: str, checkpoint: str):
    """Analyse a stream of messages in micro-batches; returns the running query. Each batch has a folder of its own under its
    number, so one that is tried again replaces what it wrote before."""

    def put(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{sink_folder}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).start()
