"""From rule score and optional classifier verdict to score, tier, confidence, factors, intervention and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import TIERS, Config
from wardline.functions.spans import settled

FAILURES = ("timeout", "api_error", "invalid_json", "schema_error", "refusal")
#: Columns of a verdict, null where there is none.
VERDICT = {"llm_status": "string", "llm_confidence": "double", "llm_scam_type": "string", "llm_injection_flagged": "boolean"}


def tier_of(score: Column, config: Config) -> Column:
    return F.when(score >= config.critical, "CRITICAL").when(score >= config.high, "HIGH").when(score >= config.medium, "MEDIUM").otherwise("LOW")


def tier_rank(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == t, F.lit(i)) for i, t in enumerate(TIERS)], F.lit(-1))


MODES = ("hybrid", "rules_only", "rules_only_fallback")


def confidence_of(mode: Column, diff: Column, edge: Column, config: Config) -> Column:
    """Confidence by mode, disagreement (0 to 100) and distance to a tier's edge (0 to 10), out of a literal list of all 3 333
    values: each is rounded as its exact binary value rounds, which a product of columns would not be."""
    caps = (config.hybrid_cap, config.rules_cap, config.fallback_cap)
    values = [round(cap * (1.0 - d / 100) * min(1.0, 0.5 + e / 20), 2) for cap in caps for d in range(101) for e in range(11)]
    place = F.coalesce(*[F.when(mode == m, F.lit(i)) for i, m in enumerate(MODES)]) * 1111 + diff * 11 + edge
    return F.get(F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>"), place)


def score(evaluated: DataFrame, config: Config | None = None) -> DataFrame:
    """Adds mode, llm_score, score, tier, confidence, needs_review, degraded_confidence, adjustments and factors.

    Blend, then in this order: a request with an impersonation is at least the combo floor; CRITICAL needs such a
    combination; a disagreement of rules and classifier never ends in CRITICAL. Rows without enough data have a null tier.
    """
    config = config or Config()
    have = set(evaluated.columns)
    d = evaluated.withColumns({c: F.lit(None).cast(t) for c, t in VERDICT.items() if c not in have})
    ok, verdict = F.col("status") == "OK", F.col("llm_status") == "ok"
    d = d.withColumn("mode", F.when(verdict, "hybrid").when(F.col("llm_status").isin(*FAILURES), "rules_only_fallback").otherwise("rules_only"))
    d = d.withColumn("llm_score", F.when(verdict, F.bround(F.col("llm_confidence") * 100).cast("int")))
    rules, llm = F.col("rule_score"), F.col("llm_score")
    d = d.withColumn("__apart", F.coalesce(F.abs(rules - llm) >= config.disagreement, F.lit(False)))
    d = d.withColumn("__steered", F.coalesce(F.array_contains("fired", "PROMPT_INJECTION") & (llm < rules) & ~F.coalesce("llm_injection_flagged", F.lit(False)), F.lit(False)))
    blend = F.col("mode") == "hybrid"
    blend = blend & ~F.col("__steered")
    d = d.withColumn("needs_review", F.col("__apart") | F.col("__steered")).withColumn("degraded_confidence", F.col("mode") == "rules_only_fallback")
    d = d.withColumn("__blended", F.greatest(F.lit(0), F.least(F.lit(100), F.when(blend, F.round(config.rules_weight * rules + config.llm_weight * llm).cast("int")).otherwise(rules))))
    floor = getattr(config, config.combo_floor.lower())
    d = d.withColumn("__floored", F.when(F.col("critical_combo"), F.greatest("__blended", F.lit(floor))).otherwise(F.col("__blended")))
    capped = (F.col("__floored") >= config.critical) & (~F.col("critical_combo") | F.col("needs_review"))
    d = d.withColumn("score", F.when(ok, F.when(capped, F.lit(config.critical - 1)).otherwise(F.col("__floored")))).withColumn("tier", F.when(ok, tier_of(F.col("score"), config)))
    says = F.array(
        F.when(F.col("__apart"), F.concat(F.lit("Rules ("), rules.cast("string"), F.lit(") and classifier ("), llm.cast("string"), F.lit(") disagree: an analyst will look"))),
        F.when(F.col("__steered"), "Classifier's verdict discarded: it missed an injection and rated the message lower than the rules"),
        F.when(F.col("mode") == "rules_only_fallback", F.concat(F.lit("Classifier unavailable ("), F.col("llm_status"), F.lit("): rules only"))),
        F.when(F.col("__floored") > F.col("__blended"), F.concat(F.lit(f"Raised to {config.combo_floor}: "), F.col("combo_reason"))),
        F.when(capped & ~F.col("critical_combo"), "Capped at HIGH: CRITICAL needs a request combined with an impersonation"),
        F.when(capped & F.col("critical_combo"), "Capped at HIGH: a disagreement is never CRITICAL by itself"),
    )
    d = d.withColumn("adjustments", F.filter(says, lambda s: s.isNotNull()))
    edge = F.least(*[F.abs(F.col("score") - t) for t in (config.medium, config.high, config.critical)], F.lit(10))
    d = d.withColumn("diff", F.when(blend, F.abs(rules - llm)).otherwise(0).cast("int")).withColumn("edge", F.coalesce(edge, F.lit(0)).cast("int"))
    d = d.withColumn("confidence", F.when(ok, confidence_of(F.col("mode"), F.col("diff"), F.col("edge"), config)))
    d = settled(d)
    part = F.when(blend, F.lit(config.rules_weight)).otherwise(1.0)
    by_rule = F.transform("hits", lambda h, i: F.struct(F.round(h["weight"] * part, 1).alias("contribution"), i.alias("i"), h["name"].alias("name"), F.lit("rule").alias("source"), h["reason"].alias("detail")))
    model = F.struct(F.when(blend, F.round(llm * config.llm_weight, 1)).otherwise(0.0).alias("contribution"), F.size("hits").alias("i"), F.lit("LLM_CLASSIFIER").alias("name"), F.lit("llm").alias("source"), F.concat(F.coalesce("llm_scam_type", F.lit("")), F.when(blend, "").otherwise(" (discarded)")).alias("detail"))
    kind = "array<struct<contribution:double,i:int,name:string,source:string,detail:string>>"
    factors = F.concat(by_rule.cast(kind), F.when(llm.isNotNull(), F.array(model).cast(kind)).otherwise(F.array().cast(kind)))
    ordered = F.array_sort(F.transform(factors, lambda x: F.struct((-F.abs(x["contribution"])).alias("k"), x["i"].alias("i"), x.alias("x"))))
    d = d.withColumn("factors", F.transform(ordered, lambda y: F.struct(y["x"]["name"].alias("name"), y["x"]["source"].alias("source"), y["x"]["contribution"].alias("contribution"), y["x"]["detail"].alias("detail"))))
    return d.drop("__apart", "__steered", "__blended", "__floored", "diff", "edge")


#: tier -> (action, headline, links disabled, confirmation, report).
POLICY = {
    "LOW": ("ALLOW", "Nothing suspicious found", False, False, False),
    "MEDIUM": ("SOFT_WARN", "Some warning signs: be careful", False, False, False),
    "HIGH": ("INTERSTITIAL", "Probably a scam: links are off", True, True, False),
    "CRITICAL": ("BLOCK_LINKS", "A scam: do not respond", True, True, True),
    None: ("UNABLE_TO_ANALYZE", "This message could not be analysed", False, False, False),
}
BASE_TIPS = ("Check the sender through a channel you already trust.", "Never answer with codes, passwords or card details.")
CHECKLIST = ("Do not click, answer or call.", "Contact the sender by a number you already have.", "If you gave away a secret, change it and call your bank.", "If you sent money, ask your bank to recall it.", "Report the message.")
#: Advice by rule.
TIPS = {
    "CREDENTIAL_REQUEST": "Nobody honest asks you for a password, PIN or code.", "PAYMENT_METHOD": "Gift cards, crypto and transfers cannot be taken back.",
    "P2P_TRANSFER_REQUEST": "Treat payment apps like cash.", "LOOKALIKE_DOMAIN": "The link imitates a brand: type the address yourself.",
    "SENDER_MISMATCH": "The sender is not who the message says.", "SHORTENED_URL": "Short links hide where they go.", "IP_LITERAL_URL": "Companies do not link to bare addresses.",
    "NEW_NUMBER_FAMILY": "Call your relative on the number you know.", "TOO_GOOD_TO_BE_TRUE": "Prizes and easy money are lures.", "OFF_PLATFORM": "Leaving the platform removes its protection.",
    "SECRECY": "Talk to someone you trust first.", "OBFUSCATION": "The message hides or disguises characters.", "PROMPT_INJECTION": "The message tries to steer an automatic filter.",
    "REMOTE_ACCESS": "Never give a caller access to your device.", "PAYMENT_REDIRECTION": "Confirm new bank details by a known number.", "UPFRONT_FEE": "A fee in advance is a common scam.",
    "CALLBACK_LURE": "Use the number on your card, not the one in the message.", "THREAT": "Threats are meant to rush you.", "URGENCY": "Time pressure is a trick; real matters can wait.",
}


def policy_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, *p) for t, p in POLICY.items()], "tier string, action string, headline string, links_disabled boolean, requires_confirmation boolean, recommend_report boolean")


def decide(scored: DataFrame) -> DataFrame:
    """Adds action, headline, links_disabled, requires_confirmation, recommend_report, tips and checklist."""
    d = scored
    for i, (name, kind) in enumerate((("action", "string"), ("headline", "string"), ("links_disabled", "boolean"), ("requires_confirmation", "boolean"), ("recommend_report", "boolean"))):
        d = d.withColumn(name, F.coalesce(*[F.when(F.col("tier") == t, F.lit(p[i])) for t, p in POLICY.items() if t], F.lit(POLICY[None][i])).cast(kind))
    book = F.create_map(*[F.lit(x) for kv in TIPS.items() for x in kv])
    own = F.slice(F.array_distinct(F.filter(F.transform("fired", lambda n: F.try_element_at(book, n)), lambda t: t.isNotNull())), 1, 4)
    base, none = F.array(*map(F.lit, BASE_TIPS)), F.array().cast("array<string>")
    d = d.withColumn("tips", F.when(F.col("tier").isNull(), base).when(F.col("tier") == "LOW", none).when(F.col("tier") == "MEDIUM", F.concat(own, base)).otherwise(own))
    return d.withColumn("checklist", F.when(F.col("tier") == "CRITICAL", F.array(*map(F.lit, CHECKLIST))).otherwise(none))
