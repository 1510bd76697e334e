"""What leaves the analysis: responses as JSON, log lines without contents or secrets, the service's own description, and texts as a screen shows them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import Config
from wardline.functions.spans import bound
from wardline.operators import evidence
from wardline.operators.ingest import INVISIBLE, to_display

NAME, VERSION, RULESET = "wardline", "1.0", "2024.1"
# Fields that a log line may have, and what is taken out of it.
LOGGED = ("case_id", "tier", "score", "mode", "llm_status", "latency_ms", "rule_ids", "needs_review", "status", "quality_flags", "error_kind", "channel", "action", "model", "config_hash")
SECRET = r"sk-[A-Za-z0-9_\-]{8,}|(?i:x-api-key|authorization)\s*[:=]\s*\S+"
MATH_LETTERS = (0x1D400, 0x1D7FF)


def model_version(status: Column, model: Column) -> Column:
    """Which rules and which classifier a verdict rests on; the classifier counts only where its answer was used."""
    return F.concat(F.lit(f"{NAME}-{VERSION}/{RULESET}/"), F.coalesce(F.when(status == "ok", model), F.lit("rules-only")))


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "[REDACTED]")


def log_lines(df: DataFrame, event: Column, level: str = "INFO", logger: str = NAME) -> DataFrame:
    """df with a JSON log line: level, logger, event, and those of the table's columns that may be logged. Keys and headers that carry secrets are
    taken out of events and of the whole line; contents never get there."""
    fields = [F.col(c) for c in LOGGED if c in df.columns]
    line = F.to_json(F.struct(F.lit(level).alias("level"), F.lit(logger).alias("logger"), redacted(event).alias("event"), *fields))
    return df.withColumn("log_line", redacted(line))


def overlaid(spans: Column) -> Column:
    """Spans (start, end, category, label, ord) of a row as disjoint segments (start, end, category, labels), in order: between two bounds the
    category of highest priority among the spans that cover it (ties: the first), and all their labels in their order."""
    whole = F.filter(spans, lambda s: s["end"] > s["start"])

    def cut(ss: Column) -> Column:
        ends = F.array_sort(F.array_distinct(F.concat(F.transform(ss, lambda s: s["start"]), F.transform(ss, lambda s: s["end"]))))

        def pieces(b: Column) -> Column:
            def piece(a: Column, i: Column) -> Column:
                over = F.filter(ss, lambda s: (s["start"] <= a) & (s["end"] > a))
                first = F.get(F.array_sort(F.transform(over, lambda s: F.struct((-evidence.priority(s["category"])).alias("p"), s["ord"].alias("o"), s["category"].alias("c")))), F.lit(0))
                labels = F.array_distinct(F.transform(F.array_sort(F.transform(over, lambda s: F.struct(s["ord"].alias("o"), s["label"].alias("l")))), lambda x: x["l"]))
                return F.struct(a.alias("start"), F.get(b, i + 1).alias("end"), first["c"].alias("category"), labels.alias("labels"))

            return F.filter(F.transform(b, piece), lambda p: p["end"].isNotNull() & p["category"].isNotNull())

        return bound(ends, pieces)

    return bound(whole, cut)


def hit_segments(hits: Column, hidden: Column) -> Column:
    """The spans of a row's hits, in places of the displayed text, as disjoint segments."""
    each = F.flatten(F.transform(hits, lambda h, i: F.transform(h["spans"], lambda s, j: F.struct(
        to_display(s["start"], hidden).alias("start"), F.when(s["end"] > s["start"], to_display(s["end"] - 1, hidden) + 1).otherwise(s["end"]).alias("end"),
        h["category"].alias("category"), F.concat_ws(" ", h["rule_id"], h["name"]).alias("label"), (i * 1000 + j).alias("ord")))))
    return overlaid(each)


def responses(decided: DataFrame, config: Config | None = None) -> DataFrame:
    """(msg_id, code, body): an analysed message as a client gets it. Blocks that a row has nothing for (risk and evidence without enough data, a verdict
    without a classifier) are left out.

    decided is what analyse() returns; where it has a column code other than 200 (see readers.parse_payloads), the body is its error."""
    config = config or Config()
    have = set(decided.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    d = decided.withColumn("__segments", hit_segments(F.col("hits"), F.col("hidden_positions")))
    pieces = F.transform(evidence.display_pieces(F.col("display_text"), F.col("__segments"), F.col("hidden_positions")), lambda p: F.struct(p["text"].alias("text"), p["category"].alias("category"), p["labels"].alias("labels"), F.when(p["hidden"], True).alias("hidden_char")))
    ok, asked = F.col("tier").isNotNull(), col("llm_status", "string")
    body = F.struct(
        "status", "quality_flags", "original_length", pieces.alias("segments"),
        F.transform("urls", lambda u: F.struct(u["raw"].alias("raw"), u["host"].alias("host"))).alias("links"),
        F.struct("action", "headline", "tips", "checklist", "links_disabled", "requires_confirmation", "recommend_report").alias("intervention"),
        model_version(asked, col("llm_model", "string")).alias("model_version"), F.lit(config.config_hash).alias("config_hash"),
        F.struct(F.lit(config.medium).alias("medium"), F.lit(config.high).alias("high"), F.lit(config.critical).alias("critical")).alias("tiers"),
        F.when(ok, F.struct("score", "tier", "confidence", "mode", "rule_score", "llm_score", "needs_review", "degraded_confidence", "adjustments", "factors")).alias("risk"),
        F.when(ok, F.struct("rule_explanations", "score_explanation", "injection_detected")).alias("evidence"),
        F.when(asked.isNotNull(), F.struct(asked.alias("status"), F.when(asked == "ok", col("llm_scam_type", "string")).alias("scam_type"), F.when(asked == "ok", col("llm_confidence", "double")).alias("confidence"))).alias("llm"),
    )
    code = F.coalesce(col("code", "int"), F.lit(200))
    return d.select("msg_id", code.alias("code"), F.when(code == 200, F.to_json(body)).otherwise(F.to_json(F.struct(col("error", "string").alias("error")))).alias("body"))


def service_info(spark: SparkSession, cases: DataFrame, classifier: bool = False) -> DataFrame:
    """One row that describes the service. cases are demonstrations (group, title, expect, channel, sender, claimed, text, image, bytes, simulate);
    those of bytes and simulated ones are for tests and aren't shown."""
    shown = cases.where("bytes is null and not coalesce(simulate, false)")
    fields = F.struct("group", "title", "expect", "channel", "sender", "claimed", "text", F.when(F.col("image").isNotNull(), F.concat(F.lit("/demo/"), F.col("image"))).alias("image"))
    demos = shown.agg(F.array_sort(F.collect_list(fields)).alias("demo_cases"))  # a catalogue, written by hand
    return demos.select(F.lit(NAME).alias("service"), F.lit(f"{VERSION}/{RULESET}").alias("version"), F.lit("hybrid" if classifier else "rules_only").alias("mode"), F.lit(False).alias("stores_data"), "demo_cases")


def screen_text(text: Column) -> Column:
    """What is seen of a text on a screen: without invisible characters, mathematical letters as plain ones, without pictures."""
    letters = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(MATH_LETTERS[0], MATH_LETTERS[1] + 1)]
    one = [(a, b) for a, b in letters if len(b) == 1 and a != b]
    plain = F.translate(F.translate(text, INVISIBLE, ""), "".join(a for a, _ in one), "".join(b for _, b in one))
    return F.regexp_replace(plain, r"[\p{So}\x{10000}-\x{10FFFF}]", "")
