"""Cases and events as append-only tables: views, queue, statistics, trusted senders, retention and export.

Every function takes and returns DataFrames; what a database would do in place is a new row or a rewritten table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import Config
from wardline.operators.masking import mask_sender, mask_text
from wardline.operators.responses import model_version

ACTORS = ("user", "analyst", "system")
USER_ACTIONS = ("appeal_legitimate", "report_scam", "links_revealed", "trust_sender_requested", "trust_sender_confirmed", "trust_sender_cancelled", "trust_sender_removed")
OUTCOMES = ("confirmed_scam", "overturned_legitimate")
EXPORT = (
    "case_id ts channel status masked_message sender_masked claimed_sender signals rule_hits llm_output llm_status score tier confidence "
    "needs_review mode intervention user_action analyst_outcome model_version config_hash latency_ms"
).split()


def keyed_hash(value: Column, pepper: str) -> Column:
    """HMAC-SHA256 of the stripped value in lower case, its first 24 hex digits. The pads are literals of the plan: where
    plans are logged, hash before."""
    key = pepper.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    clean = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")).cast("binary")
    return F.left(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, clean), 256))), 256), F.lit(24))


def case_rows(decided: DataFrame, now: Column, pepper: str, config: Config | None = None) -> DataFrame:
    """Audit rows of analysed messages: masked text and senders, JSON of signals and hits, a key that is the same when a
    task runs twice."""
    config = config or Config()
    d = mask_text(decided, "display_text", "masked_message", "__n")
    hosts = F.array_sort(F.array_distinct(F.transform("urls", lambda u: u["host"])))
    signals = F.to_json(F.struct(hosts.alias("hosts"), F.size("phones").alias("phones"), F.size("emails").alias("emails"), F.slice(F.transform("amounts", lambda a: a["value"]), 1, 10).alias("amounts"), "in_word_zero_width", "compat_chars"))
    return d.select(
        F.left(F.sha2(F.concat_ws("|", F.coalesce("msg_id", F.lit("")), F.coalesce("user_id", F.lit("")), F.coalesce("display_text", F.lit(""))), 256), F.lit(12)).alias("case_id"),
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"),
        F.unix_timestamp(now).cast("double").alias("ts_epoch"),
        keyed_hash(F.coalesce("user_id", F.lit("")), pepper).alias("user_hash"),
        "channel", "status", "masked_message", mask_sender(F.col("sender_id")).alias("sender_masked"), "claimed_sender", signals.alias("signals"),
        F.to_json("hits").alias("rule_hits"), F.lit(None).cast("string").alias("llm_output"), "llm_status", "score", "tier", "confidence",
        F.col("needs_review").cast("int").alias("needs_review"), "mode", F.col("action").alias("intervention"), F.lit(None).cast("string").alias("user_action"),
        F.lit("pending").alias("analyst_outcome"), model_version(F.col("llm_status"), F.lit(None).cast("string") if "llm_model" not in decided.columns else F.col("llm_model")).alias("model_version"), F.lit(config.config_hash).alias("config_hash"), F.lit(None).cast("double").alias("latency_ms"),
    )


def record(cases: DataFrame, folder: str) -> None:
    """Append cases and their system events."""
    cases.write.mode("append").parquet(f"{folder}/audit_log")
    intervention_events(cases).write.mode("append").parquet(f"{folder}/case_events")


def intervention_events(cases: DataFrame) -> DataFrame:
    return cases.select(F.xxhash64("case_id", "ts").alias("event_id"), "case_id", "ts", "ts_epoch", F.lit("system").alias("actor"), F.concat(F.lit("intervention:"), F.col("intervention")).alias("event_type"), F.lit("{}").alias("detail"))


def valid_events(events: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of known cases by known actors, the rest)."""
    known = F.coalesce(F.col("actor").isin(*ACTORS), F.lit(False))
    ids = cases.select("case_id").distinct()
    return events.where(known).join(ids, "case_id", "left_semi"), events.where(~known).unionByName(events.where(known).join(ids, "case_id", "left_anti"))


def get_case(cases: DataFrame, case_id) -> DataFrame:
    return cases.where(F.col("case_id") == case_id)


def case_events(events: DataFrame, case_id) -> DataFrame:
    return events.where(F.col("case_id") == case_id).orderBy("event_id")


def case_view(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Cases with the latest event of the user and of an analyst, in one aggregation over the events."""
    last = lambda actor: F.max_by(F.when(F.col("actor") == actor, F.col("event_type")), F.when(F.col("actor") == actor, F.col("event_id")))
    has = lambda kind: F.coalesce(F.bool_or(F.col("event_type") == kind), F.lit(False))
    latest = events.groupBy("case_id").agg(last("user").alias("__user"), last("analyst").alias("__analyst"), has("appeal_legitimate").alias("appealed"), has("report_scam").alias("reported"))
    d = cases.join(latest, "case_id", "left")
    return d.withColumns({"user_action": F.coalesce("__user", "user_action"), "analyst_outcome": F.coalesce("__analyst", "analyst_outcome"), "appealed": F.coalesce("appealed", F.lit(False)), "reported": F.coalesce("reported", F.lit(False))}).drop("__user", "__analyst")


def analyst_queue(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Open cases that someone should look at, with rank and reasons: appeals, then reviews, then reports, then the rest, newest
    first. Order them by (rank, ts desc, case_id)."""
    high, review = F.coalesce(F.col("tier").isin("HIGH", "CRITICAL"), F.lit(False)), F.coalesce(F.col("needs_review") == 1, F.lit(False))
    d = case_view(cases, events).where((F.col("analyst_outcome") == "pending") & (F.col("status") == "OK") & (high | review | F.col("appealed") | F.col("reported")))
    rank = F.when(F.col("appealed"), 0).when(review, 1).when(F.col("reported"), 2).otherwise(3)
    why = F.concat_ws(", ", F.when(F.col("appealed"), "user appeal"), F.when(review, "needs review"), F.when(F.col("reported"), "user report"), F.when(high, F.concat(F.lit("tier "), F.col("tier"))))
    return d.withColumn("rank", rank).withColumn("reasons", why)


def decision_stats(cases: DataFrame, events: DataFrame) -> DataFrame:
    """One row: cases, flagged, appeals, reports, decisions and rates (0 where nothing is below the line)."""
    v = case_view(cases, events)
    flagged = F.count_if(F.col("tier").isin("MEDIUM", "HIGH", "CRITICAL"))
    event = events.agg(F.count_distinct(F.when(F.col("event_type") == "appeal_legitimate", F.col("case_id"))).alias("appeals"), F.count_distinct(F.when(F.col("event_type") == "report_scam", F.col("case_id"))).alias("reports"))
    one = v.agg(F.count("*").alias("total_cases"), flagged.alias("flagged_cases"), F.count_if(F.col("analyst_outcome") == OUTCOMES[0]).alias("confirmed_scam"), F.count_if(F.col("analyst_outcome") == OUTCOMES[1]).alias("overturned_legitimate"))
    d = one.crossJoin(event).withColumn("analyst_decisions", F.col("confirmed_scam") + F.col("overturned_legitimate"))  # one row by one row
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 3), F.lit(0.0))
    return d.withColumn("appeal_rate", rate("appeals", "flagged_cases")).withColumn("overturn_rate", rate("overturned_legitimate", "analyst_decisions"))


def cases_by_tier(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.coalesce("tier", F.lit("INSUFFICIENT_DATA")).alias("tier")).agg(F.count("*").alias("n"))


def appeal_outcomes(cases: DataFrame, events: DataFrame) -> DataFrame:
    return case_view(cases, events).where("appealed").groupBy("analyst_outcome").agg(F.count("*").alias("n"))


def recent_cases(cases: DataFrame, n: int = 200) -> DataFrame:
    return cases.orderBy(F.desc("ts"), "case_id").limit(n)


def trusted_senders(trust_events: DataFrame) -> DataFrame:
    """The state of (user_hash, sender_hash): the first event's case and mask, the last one's activity and time."""
    return trust_events.groupBy("user_hash", "sender_hash").agg(F.min_by("sender_masked", "event_id").alias("sender_masked"), F.min_by("case_id", "event_id").alias("case_id"), F.max_by("added_ts", "event_id").alias("added_ts"), F.max_by("active", "event_id").alias("active"))


def trust_transitions(events: DataFrame) -> DataFrame:
    """Two-step trust: a confirmation or cancellation counts if the last step before it is a request; a removal always does."""
    from pyspark.sql import Window

    steps = events.where(F.col("event_type").startswith("trust_sender_"))
    before = F.lag("event_type").over(Window.partitionBy("user_hash", "sender_hash").orderBy("event_id"))
    d = steps.withColumn("before", before)
    fine = F.col("event_type").isin("trust_sender_requested", "trust_sender_removed") | (F.coalesce(F.col("before") == "trust_sender_requested", F.lit(False)))
    return d.withColumn("accepted", fine).withColumn("active", F.when(fine & (F.col("event_type") == "trust_sender_confirmed"), True).when(fine & (F.col("event_type") == "trust_sender_removed"), False))


def with_trust(messages: DataFrame, trusted: DataFrame) -> DataFrame:
    """messages (with user_hash, sender_hash) with trusted_sender; a left join, so it holds for streams too."""
    active = trusted.where("active").select("user_hash", "sender_hash", F.lit(True).alias("__trusted")).distinct()
    return messages.join(active, ["user_hash", "sender_hash"], "left").withColumn("trusted_sender", F.coalesce("__trusted", F.lit(False))).drop("__trusted")


def purge(cases: DataFrame, events: DataFrame, now_epoch: float, days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases kept, events kept, one row of counts): cases strictly older than the cut-off go, with their events."""
    cutoff = now_epoch - days * 86400.0
    gone = cases.where(F.col("ts_epoch") < cutoff).select("case_id").distinct()
    kept = cases.where(F.coalesce(F.col("ts_epoch") >= cutoff, F.lit(True)))
    lost = events.join(gone, "case_id", "left_semi")
    log = cases.agg(F.count_if(F.col("ts_epoch") < cutoff).alias("cases_deleted")).crossJoin(lost.agg(F.count("*").alias("events_deleted")))  # one row by one row
    return kept, events.join(gone, "case_id", "left_anti"), log


def export_csv(cases: DataFrame, path: str) -> None:
    export_rows(cases).write.option("header", True).mode("overwrite").csv(path)


def export_rows(cases: DataFrame) -> DataFrame:
    return cases.select(*EXPORT).orderBy("ts", "case_id")


def ask(views: dict[str, DataFrame], sql: str, *values) -> DataFrame:
    """Any query over the store's tables and views, by the names given. Each ? in it is bound to a value, which is never read as SQL."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return next(iter(views.values())).sparkSession.sql(sql, args=list(values))


def recent_purges(log: DataFrame, n: int = 5) -> DataFrame:
    """The last purges of a log (ts, cases_deleted, events_deleted), newest first."""
    return log.orderBy(F.desc("ts"), F.desc("cases_deleted")).limit(n)
