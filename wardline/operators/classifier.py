"""The optional classifier: who is asked, with what, through a function that a deployment injects, and a strict reading of its answer."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import Config
from wardline.functions.lexicon import SCAM_TYPES, TACTICS

FIELDS = ("confidence", "indicators", "manipulation_tactics", "rationale", "scam_type")
SCHEMA = "scam_type string, indicators array<string>, manipulation_tactics array<string>, confidence double, rationale string"


def gate(evaluated: DataFrame, config: Config, available: bool) -> DataFrame:
    """Adds llm_gate: ask, skipped (policy), disabled (no provider) or null (switched off or not enough data)."""
    asked = F.lit(config.llm_policy == "always") | F.col("rule_score").between(config.ambiguous_min, config.ambiguous_max)
    value = F.when(F.lit(not config.llm_enabled) | (F.col("status") != "OK"), F.lit(None).cast("string")).when(F.lit(not available), "disabled").when(asked, "ask").otherwise("skipped")
    return evaluated.withColumn("llm_gate", value)


def prompt(masked: Column, channel: Column, sender: Column, claimed: Column, nonce: Column) -> Column:
    """The untrusted message between tags with a nonce; look-alike tags inside lose their brackets; metadata is JSON."""
    safe = F.regexp_replace(masked, r"(?i)</?\s*untrusted_[a-z_]*[^>]*>", "[tag removed]")
    tag = F.concat(F.lit("untrusted_message_"), nonce)
    meta = F.to_json(F.struct(channel.alias("channel"), sender.alias("sender"), claimed.alias("claimed_sender")))
    return F.concat(F.lit("<"), tag, F.lit(">\n"), safe, F.lit("\n</"), tag, F.lit(">\n"), meta)


def read_verdict(raw: Column) -> Column:
    """struct(status, verdict): an answer counts only if it is one JSON object, fenced or not, with exactly the fields, types,
    values and lengths of a verdict, and doesn't call a message legitimate at a confidence over 0.6."""
    body = F.regexp_replace(F.regexp_replace(raw, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    keys = F.array_sort(F.call_function("json_object_keys", body))
    v = F.from_json(body, SCHEMA, {"mode": "PERMISSIVE"})
    number = F.get_json_object(body, "$.confidence").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & ~body.rlike(r'"confidence"\s*:\s*"')
    fits = (
        (keys == F.array(*map(F.lit, FIELDS))) & number & v["scam_type"].isin(*SCAM_TYPES) & v["confidence"].between(0, 1)
        & (F.size(v["indicators"]) <= 15) & F.forall(v["indicators"], lambda i: i.isNotNull() & (F.length(i) <= 300))
        & (F.size(v["manipulation_tactics"]) <= 12) & F.forall(v["manipulation_tactics"], lambda t: F.coalesce(t.isin(*TACTICS), F.lit(False)))
        & F.length(v["rationale"]).between(1, 1500) & ~((v["scam_type"] == "legitimate") & (v["confidence"] > 0.6))
    )
    valid = F.coalesce(fits, F.lit(False))
    status = F.when(keys.isNull(), "invalid_json").when(valid, "ok").otherwise("schema_error")
    return F.struct(status.alias("status"), F.when(valid, v).alias("verdict"))


def injection_flagged(verdict: Column) -> Column:
    return F.array_contains(verdict["manipulation_tactics"], "prompt_injection") | F.exists(verdict["indicators"], lambda i: F.lower(i).startswith("prompt_injection"))


def classify(gated: DataFrame, prompts: Column, complete: Callable[[str], str] | None) -> DataFrame:
    """Adds llm_status, llm_confidence, llm_scam_type and llm_injection_flagged. Only rows that the gate lets through are sent to
    complete(), which a task calls row by row; what it raises becomes a status by the exception's name."""
    rest = gated.where(F.coalesce(F.col("llm_gate") != "ask", F.lit(True)))
    none = rest.withColumns({"llm_status": F.col("llm_gate"), "llm_confidence": F.lit(None).cast("double"), "llm_scam_type": F.lit(None).cast("string"), "llm_injection_flagged": F.lit(None).cast("boolean")})
    if complete is None:
        return none

    @F.arrow_udf("struct<raw:string,error:string>")
    def ask(texts: pa.Array) -> pa.Array:
        return pa.array([_answer(complete, t) for t in texts.to_pylist()], pa.struct([("raw", pa.string()), ("error", pa.string())]))

    a = gated.where(F.col("llm_gate") == "ask").withColumn("__prompt", prompts).withColumn("__a", ask("__prompt")).withColumn("__v", read_verdict(F.col("__a.raw")))
    sent = a.withColumns({"llm_status": F.coalesce("__a.error", "__v.status"), "llm_confidence": F.col("__v.verdict.confidence"), "llm_scam_type": F.col("__v.verdict.scam_type"), "llm_injection_flagged": injection_flagged(F.col("__v.verdict"))}).drop("__prompt", "__a", "__v")
    return none.unionByName(sent)


def _answer(complete: Callable[[str], str], text: str) -> dict:
    try:
        return {"raw": complete(text), "error": None}
    except Exception as e:  # noqa: BLE001  (a provider may raise anything; a row's failure is data)
        name = type(e).__name__.lower()
        return {"raw": None, "error": "timeout" if "timeout" in name else "refusal" if "refusal" in name else "api_error"}


