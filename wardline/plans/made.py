"""Further registered queries: rows made from the tables for operators that need special texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.config import Config
from wardline.functions import lexicon as lx
from wardline.functions.spans import clauses, rx
from wardline.operators import brands, casestore, classifier, evidence, ingest, masking, metrics, rules, scoring
from wardline.plans.registry import _CASES, _EVENTS, _RECORDS, _TRUST, _cases, _events, _quote, _records, query, table, spread
from wardline.sources import readers

_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "abcdefghijklmnopqrstuvwxyz")
_ZERO, _TURN = "​", "‮"
_NAME = "abcdefghijklmnopqrstuvwxyz"


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by(k: Column, *choices: Column) -> Column:
    """The choice at k modulo their number."""
    out = F.when(k % len(choices) == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(k % len(choices) == i, c)
    return out


_GATE = "CASE WHEN doc_id % 7 IN (0, 1) THEN 'binary_input' WHEN doc_id % 7 = 2 THEN 'non_text_input' WHEN length(text) > 8000 THEN 'too_long' WHEN trim(text) = '' THEN 'empty' WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'no_text_content' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 15 THEN 'too_short' END"


@query(f"SELECT doc_id, {_GATE} AS gate FROM documents")
def byte_gates(spark, sf_dir):
    """Bytes instead of text: broken UTF-8, a zero, nothing at all, and whole documents."""
    body = F.col("text").cast("binary")
    made = _by(F.col("doc_id"), F.concat(body, F.lit(b"\xff")), F.concat(body, F.lit(b"\x00")), F.lit(None).cast("binary"), body, body, body, body)
    d = ingest.normalise(table(spark, sf_dir, "documents").select("doc_id", made.alias("text_bytes")), Config())
    first = F.get("quality_flags", F.lit(0))
    return d.select("doc_id", F.when(first.isin("binary_input", "non_text_input", "too_long", "empty", "no_text_content", "too_short"), first).alias("gate"))


@query("SELECT p_partkey, 'a note for you: ' || p_name AS display, length(regexp_replace(p_name, '[^a-z]', '', 'g'))::INTEGER AS wide FROM part")
def wide_letters(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", _text("a note for you: ", F.translate("p_name", _NAME, _WIDE)).alias("text"))
    return ingest.normalise(d, Config()).select("p_partkey", F.col("display_text").alias("display"), F.col("compat_chars").alias("wide"))


@query("SELECT o_orderkey, (o_orderkey % 4)::INTEGER AS inside, (o_orderkey % 3)::INTEGER AS turns, (o_orderkey % 4 + o_orderkey % 3)::INTEGER AS removed, 'a note for you ' || repeat('ab ', (o_orderkey % 4)::INTEGER) || 'the end' AS clean FROM orders")
def invisible_characters(spark, sf_dir):
    k = F.col("o_orderkey")
    text = _text("a note for you ", F.repeat(F.lit(f"a{_ZERO}b "), (k % 4).cast("int")), F.repeat(F.lit(_TURN), (k % 3).cast("int")), "the end")
    d = ingest.normalise(table(spark, sf_dir, "orders").select(k, text.alias("text")), Config())
    return d.select("o_orderkey", F.col("in_word_zero_width").alias("inside"), F.col("bidi_controls").alias("turns"), F.col("zero_width_removed").alias("removed"), F.col("clean_text").alias("clean"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_extract_all('a plain note for you ' || p_name, '[A-Za-z]+'), lambda w: contains(w, 'o') AND regexp_matches(w, '[^o]')), lambda w: replace(w, 'o', 'о')), ' ') AS mixed FROM part")
def mixed_scripts(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.translate(_text("a plain note for you ", F.col("p_name")), "o", "о").alias("text"))
    return ingest.normalise(d, Config()).select("p_partkey", F.array_join("mixed_script_words", " ").alias("mixed"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN ['sms', 'email', 'chat'][(c_custkey % 4 + 1)::INTEGER] ELSE 'sms' END AS channel FROM customer")
def channels(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, ingest.parse_channel(_by(k, F.lit("SMS"), F.lit("Email"), F.lit("chat"), F.lit("fax"))).alias("channel"))


_AT = "CASE WHEN 3 <= p_size THEN p_size + 1 ELSE p_size END"


@query(f"SELECT p_partkey, CASE WHEN 20 <= b THEN b + 1 ELSE b END AS shown FROM (SELECT p_partkey, CASE WHEN 9 <= a THEN a + 1 ELSE a END AS b FROM (SELECT p_partkey, {_AT} AS a FROM part))")
def display_places(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ingest.to_display(F.col("p_size"), F.array(F.lit(3), F.lit(9), F.lit(20))).alias("shown"))


_HOSTS = "(SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages)"


@query(f"SELECT page_id, host || '/p' AS raw, host, regexp_matches(host, '(^|\\.)xn--') AS puny FROM {_HOSTS} WHERE regexp_full_match(host, '(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+(?:{lx.TLDS})')")
def links_without_scheme(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    d = table(spark, sf_dir, "pages").select("page_id", _text("see ", host, "/p for more").alias("t"))
    return d.select("page_id", F.explode(ingest.extract_urls(F.col("t"), F.col("t"))).alias("u")).select("page_id", "u.raw", "u.host", F.col("u.is_punycode").alias("puny"))


@query("SELECT o_orderkey, 'u' || o_orderkey || '@mail.example.com' AS email, '212-555-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS phone, '$' || o_orderkey || '.50' AS amount, '0x' || lpad(o_orderkey::VARCHAR, 40, '0') AS wallet, 'https://shop.example.com/o?id=' || o_orderkey AS link FROM orders")
def entities(spark, sf_dir):
    k = F.col("o_orderkey")
    text = _text("Write to u", k, "@mail.example.com or call 212-555-", F.lpad((k % 10000).cast("string"), 4, "0"), " about $", k, ".50 for 0x", F.lpad(k.cast("string"), 40, "0"), ", see https://shop.example.com/o?id=", k, ". Thank you")
    d = ingest.ingest(spread(table(spark, sf_dir, "orders").select(k)).select(k, text.alias("text")))
    values = lambda c: F.array_join(F.transform(c, lambda s: s["value"]), " ")
    return d.select("o_orderkey", values("emails").alias("email"), values("phones").alias("phone"), values("amounts").alias("amount"), values("crypto").alias("wallet"), F.array_join(F.transform("urls", lambda u: u["raw"]), " ").alias("link"))


_BRANDS = [(b.ord, (b.aliases or b.exact)[0], b.display, b.key, b.domains[0]) for b in brands.brands()]
_BRAND_SQL = "(VALUES " + ", ".join(f"({o}, {_quote(a)}, {_quote(d)}, {_quote(k)}, {_quote(w)})" for o, a, d, k, w in _BRANDS) + ") AS b(ord, alias, display, key, domain)"


def _branded(spark, sf_dir):
    known = F.broadcast(spark.createDataFrame(_BRANDS, "ord int, alias string, display string, key string, domain string"))  # 37 rows
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(_BRANDS)).cast("int").alias("ord")).join(known, "ord")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN display END AS claimed, 1 AS mentioned FROM customer JOIN {_BRAND_SQL} ON ord = c_custkey % {len(_BRANDS)}")
def claimed_brands(spark, sf_dir):
    """A brand before "alert:" is claimed, one that is talked about isn't."""
    k, alias = F.col("c_custkey"), F.col("alias")
    text = F.when(k % 2 == 0, _text(alias, " alert: parcel ", k, " is on its way to you")).otherwise(_text("We like ", alias, " a lot, said number ", k))
    d = _branded(spark, sf_dir).select(k, text.alias("t"))
    return d.select(k, brands.brand_field(F.try_element_at(brands.claims(F.col("t")), F.lit(1))["brand"], "display").alias("claimed"), F.size(brands.mentions(F.col("t"))).alias("mentioned"))


# gov.uk is a public suffix too, so what stands before it belongs to the registrable domain, which then is nobody's
@query(f"SELECT c_custkey, CASE WHEN domain <> 'gov.uk' THEN display END AS owner, domain <> 'gov.uk' AS owned FROM customer JOIN {_BRAND_SQL} ON ord = c_custkey % {len(_BRANDS)}")
def brand_owners(spark, sf_dir):
    reg = brands.registrable_domain(_text("u", F.col("c_custkey"), ".", F.col("domain")))
    return _branded(spark, sf_dir).select("c_custkey", brands.brand_field(brands.official_brand(reg), "display").alias("owner"), brands.owns(F.col("ord"), reg).alias("owned"))


_CLAUSE = "string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?;])[\\s\\p{Z}]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), '[\\s\\p{Z}]+[-–—][\\s\\p{Z}]+', chr(1), 'g'), chr(1))"


@query(f"SELECT doc_id, len(list_filter({_CLAUSE}, lambda x: x <> '')) AS n, list_aggregate(list_transform({_CLAUSE}, lambda x: length(x)), 'sum')::BIGINT AS chars FROM documents")
def clause_counts(spark, sf_dir):
    # aggregates over a document's clauses grow arrays, which is meant for messages: here the breaks alone are split at
    parts = F.split(F.coalesce("text", F.lit("")), rx(lx.CLAUSE_BREAK), -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(parts, lambda x: x != "")).cast("long").alias("n"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("SELECT conv_id, turn, length(text) AS last_end, 0 AS first_start FROM conversations WHERE regexp_matches(text, '^[^\\n.!?;–—-]+[.!?;]?$')")
def single_clauses(spark, sf_dir):
    """Messages without a break inside are one clause from start to end."""
    d = table(spark, sf_dir, "conversations").where(F.col("text").rlike(r"\A[^\n.!?;–—-]+[.!?;]?\z"))
    c = clauses(F.col("text"), rx(lx.CLAUSE_BREAK))
    return d.select("conv_id", "turn", F.element_at(c, -1)["end"].cast("long").alias("last_end"), F.element_at(c, 1)["start"].alias("first_start"))


_CAP = (0.95, 0.75, 0.55)
_CONFIDENCE = "[" + ", ".join(repr(round(cap * (1.0 - d / 100) * min(1.0, 0.5 + e / 20), 2)) for cap in _CAP for d in range(101) for e in range(11)) + "]"
_SCORED = f"""(SELECT *, CASE WHEN floored >= 80 AND (NOT combo OR review) THEN 79 ELSE floored END AS score FROM (
 SELECT *, CASE WHEN combo THEN greatest(blended, 55) ELSE blended END AS floored FROM (
 SELECT *, apart OR steered AS review, CASE WHEN mode = 'hybrid' AND NOT steered THEN round(0.6::DOUBLE * rules + 0.4::DOUBLE * llm)::INTEGER ELSE rules END AS blended FROM (
 SELECT *, coalesce(abs(rules - llm) >= 45, false) AS apart, coalesce(injected AND llm < rules AND NOT flagged, false) AS steered FROM (
 SELECT doc_id, (doc_id * 7 % 101)::INTEGER AS rules, doc_id % 3 = 0 AS combo, doc_id % 5 = 0 AS injected, doc_id % 2 = 0 AS flagged,
  CASE doc_id % 4 WHEN 0 THEN 'rules_only' WHEN 1 THEN 'rules_only_fallback' ELSE 'hybrid' END AS mode, CASE WHEN doc_id % 4 > 1 THEN (doc_id * 13 % 101)::INTEGER END AS llm FROM documents)))))"""


@query(f"""SELECT doc_id, mode, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 55 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS tier, review AS needs_review, mode = 'rules_only_fallback' AS degraded,
 {_CONFIDENCE}[1 + (CASE mode WHEN 'hybrid' THEN 0 WHEN 'rules_only' THEN 1 ELSE 2 END) * 1111 + (CASE WHEN mode = 'hybrid' AND NOT steered THEN abs(rules - llm) ELSE 0 END) * 11 + least(abs(score - 30), abs(score - 55), abs(score - 80), 10)]::DOUBLE AS confidence FROM {_SCORED}""")
def score_cases(spark, sf_dir):
    """Blends, floors, caps, failures and steered verdicts over all kinds of inputs."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", (k * 7 % 101).cast("int").alias("rule_score"), (k % 3 == 0).alias("critical_combo"), F.when(k % 5 == 0, F.array(F.lit("PROMPT_INJECTION"))).otherwise(F.array().cast("array<string>")).alias("fired"), (k % 2 == 0).alias("llm_injection_flagged"), _by(k, F.lit(None).cast("string"), F.lit("timeout"), F.lit("ok"), F.lit("ok")).alias("llm_status"), F.when(k % 4 > 1, (k * 13 % 101) / 100).alias("llm_confidence"))
    d = d.withColumns({"status": F.lit("OK"), "hits": F.array().cast(f"array<{rules.HIT}>"), "combo_reason": F.lit("x"), "llm_scam_type": F.lit("unclear")})
    return scoring.score(d).select("doc_id", "mode", "score", "tier", "needs_review", F.col("degraded_confidence").alias("degraded"), "confidence")


_TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL", None)
# tier, action, links off, confirmation, report, tips (two basic ones without a tier; advice on two rules; both at MEDIUM; none at LOW), steps
_POLICY = """(VALUES (0, 'LOW', 'ALLOW', false, false, false, 0, 0), (1, 'MEDIUM', 'SOFT_WARN', false, false, false, 4, 0), (2, 'HIGH', 'INTERSTITIAL', true, true, false, 2, 0),
 (3, 'CRITICAL', 'BLOCK_LINKS', true, true, true, 2, 5), (4, NULL, 'UNABLE_TO_ANALYZE', false, false, false, 2, 0)) AS p(i, tier, action, links_disabled, requires_confirmation, recommend_report, tips, steps)"""


@query(f"SELECT c_custkey, action, links_disabled, requires_confirmation, recommend_report, tips, steps FROM customer JOIN {_POLICY} ON i = c_custkey % 5")
def policy_actions(spark, sf_dir):
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(k, _by(k, *[F.lit(t).cast("string") for t in _TIERS]).alias("tier"), F.array(F.lit("URGENCY"), F.lit("THREAT"), F.lit("KNOWN_CONTACT")).alias("fired"))
    return scoring.decide(d).select(k, "action", "links_disabled", "requires_confirmation", "recommend_report", F.size("tips").alias("tips"), F.size("checklist").alias("steps"))


_MASKED = "CASE o_orderkey % 9 WHEN 0 THEN 'go to https://[CREDENTIALS]@x.example.org/a' WHEN 1 THEN 'ssn [SSN] is mine' WHEN 2 THEN 'call [PHONE] at eight' WHEN 3 THEN 'Your code is [OTP]' WHEN 4 THEN 'card [CARD] ok' WHEN 5 THEN 'card 4111111111111112 ok' WHEN 6 THEN 'paid $' || o_orderkey || ' in 2024' WHEN 7 THEN '[OTP] is your login code' ELSE 'pay to [IBAN] today' END"


@query(f"SELECT o_orderkey, {_MASKED} AS masked, CASE WHEN o_orderkey % 9 IN (5, 6) THEN 0 ELSE 1 END AS kinds FROM orders")
def mask_kinds(spark, sf_dir):
    k = F.col("o_orderkey")
    six, four = F.lpad((k % 900_000 + 100_000).cast("string"), 6, "0"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0")
    text = _by(k, _text("go to https://u", k, ":pw@x.example.org/a"), _text("ssn 123-45-", four, " is mine"), _text("call +1 (212) 555-", four, " at eight"), _text("Your code is ", six), F.lit("card 4111 1111 1111 1111 ok"), F.lit("card 4111111111111112 ok"), _text("paid $", k, " in 2024"), _text(six, " is your login code"), F.lit("pay to GB82 WEST 1234 5698 7654 32 today"))
    d = masking.mask_text(table(spark, sf_dir, "orders").select(k, text.alias("t")), "t")
    return d.select(k, F.col("masked_text").alias("masked"), F.size("mask_counts").alias("kinds"))


@query("SELECT c_custkey, left(sha256(inner2 || unhex(sha256(inner1 || encode(lower(c_name))))), 24) AS user_hash FROM (SELECT *, " + ", ".join("'" + "".join(f"\\x{b ^ x:02X}" for b in b"pepper".ljust(64, b"\0")) + f"'::BLOB AS inner{i}" for i, x in ((1, 0x36), (2, 0x5C))) + " FROM customer)")
def sender_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", casestore.keyed_hash(F.col("c_name"), "pepper").alias("user_hash"))


_STATE = f"(SELECT user_hash, sender_hash, arg_max(active, event_id) AS active FROM (SELECT * FROM {_TRUST} WHERE active IS NOT NULL) GROUP BY user_hash, sender_hash)"


@query(f"SELECT event_id, coalesce(s.active, false) AS trusted_sender FROM (SELECT event_id, user_id::VARCHAR AS user_hash, event_type AS sender_hash FROM events) e LEFT JOIN {_STATE} s USING (user_hash, sender_hash)")
def trusted_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_hash"), F.col("event_type").alias("sender_hash"), "value")
    x = F.col("event_id").cast("string")
    state = casestore.trusted_senders(e.select("event_id", "user_hash", "sender_hash", x.alias("case_id"), x.alias("sender_masked"), x.alias("added_ts"), (F.col("value") > 50).alias("active")).where("active is not null"))
    return casestore.with_trust(e, state).select("event_id", "trusted_sender")


_STEPS = "['trust_sender_requested', 'trust_sender_confirmed', 'trust_sender_cancelled', 'trust_sender_removed']"


@query(f"SELECT event_id, step IN ('trust_sender_requested', 'trust_sender_removed') OR coalesce(lag(step) OVER (PARTITION BY user_id ORDER BY event_id) = 'trust_sender_requested', false) AS accepted FROM (SELECT event_id, user_id, {_STEPS}[(event_id * 7 % 4 + 1)::INTEGER] AS step FROM events)")
def trust_steps(spark, sf_dir):
    step = F.get(F.array(*[F.lit(f"trust_sender_{s}") for s in ("requested", "confirmed", "cancelled", "removed")]), (F.col("event_id") * 7 % 4).cast("int"))
    d = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_hash"), F.lit("s").alias("sender_hash"), step.alias("event_type"))
    return casestore.trust_transitions(d).select("event_id", "accepted")


@query(f"SELECT event_id, actor, event_type FROM {_EVENTS} WHERE case_id = '1'")
def one_case_events(spark, sf_dir):
    return casestore.case_events(_events(spark, sf_dir), "1").select("event_id", "actor", "event_type")


@query(f"SELECT case_id, ts, status FROM {_CASES} WHERE case_id = '1'")
def one_case(spark, sf_dir):
    return casestore.get_case(_cases(spark, sf_dir), "1").select("case_id", "ts", "status")


@query(f"SELECT id, CASE id % 4 WHEN 1 THEN 'asked without an imitation, so that the floor of HIGH did not hold' WHEN 2 THEN 'all weights together stayed below HIGH' ELSE 'pressed or imitated, but asked for no secret and no payment' END AS why FROM {_RECORDS} WHERE label = 'scam' AND tier = 'MEDIUM'")
def under_warned(spark, sf_dir):
    fired = _by(F.col("id"), *[F.array(*map(F.lit, names)).cast("array<string>") for names in ((), ("PAYMENT_METHOD",), ("URGENCY", "PAYMENT_METHOD", "SENDER_MISMATCH"), ("LOOKALIKE_DOMAIN",))])
    return metrics.under_warned(_records(spark, sf_dir).withColumn("fired", fired)).select("id", "why")


_ITEM_WORDS = "(SELECT item_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY item_id) AS total FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) GROUP BY item_id, w)"


@query(
    f"""WITH k AS (SELECT count(*) AS k FROM benchmark), a AS {_ITEM_WORDS}, h AS (SELECT id, w, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY id, w),
 s AS (SELECT h.id, sum(least(h.n, a.n)) AS hits FROM h JOIN a ON a.w = h.w AND a.item_id = h.id % (SELECT k FROM k) GROUP BY h.id)
 SELECT doc_id AS id, CASE WHEN total IS NULL THEN 1.0 ELSE coalesce(hits, 0) / total END::DOUBLE AS recall FROM documents JOIN (SELECT item_id, any_value(total)::DOUBLE AS total FROM benchmark LEFT JOIN a USING (item_id) GROUP BY item_id) t ON t.item_id = doc_id % (SELECT k FROM k) LEFT JOIN s ON s.id = doc_id"""
)
def document_recall(spark, sf_dir):
    """Every document against a benchmark item, the item's words as often as they occur."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seen"), (F.col("doc_id") % b.select(F.count("*")).scalar()).alias("item_id"))
    return metrics.word_recall(d.join(b, "item_id"))


_VERDICT = '{"scam_type":"phishing","indicators":["x"],"manipulation_tactics":["urgency"],"confidence":%s,"rationale":"because"}'


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 200 > 100 THEN 'schema_error' ELSE 'ok' END WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'schema_error' ELSE 'schema_error' END AS status FROM documents")
def verdict_status(spark, sf_dir):
    k = F.col("doc_id")
    good = F.replace(F.lit(_VERDICT), F.lit("%s"), ((k % 200) / 100).cast("string"))
    raw = _by(k, good, F.lit("I think this is fine"), F.lit(""), F.replace(good, F.lit("phishing"), F.lit("odd")), F.replace(good, F.lit('"rationale"'), F.lit('"more":1,"rationale"')))
    return table(spark, sf_dir, "documents").select("doc_id", classifier.read_verdict(raw)["status"].alias("status"))


@query("SELECT p_partkey, '<mark class=\"request\" title=\"a; &quot;b&quot;\">' || 'x&lt;' || p_size || '</mark> &amp; ' || p_name || '<br>end' AS html FROM part")
def marked_html(spark, sf_dir):
    head = _text("x<", F.col("p_size"))
    d = table(spark, sf_dir, "part").select("p_partkey", _text(head, " & ", F.col("p_name"), "\nend").alias("t"), F.array(F.struct(F.lit(0).alias("start"), F.length(head).alias("end"), F.lit("request").alias("category"), F.array(F.lit("a"), F.lit('"b"')).alias("labels"))).alias("s"))
    return d.select("p_partkey", evidence.highlighted(F.col("t"), F.col("s")).alias("html"))


@query("SELECT o_orderkey, [200, 400, 400, 413, 400, 200][(o_orderkey % 6 + 1)::INTEGER] AS code, CASE o_orderkey % 6 WHEN 0 THEN 'hello ' || o_orderkey WHEN 5 THEN '' ELSE NULL END AS text FROM orders")
def web_payloads(spark, sf_dir):
    """Good requests, one that is no object, a wrong channel, one too large, a wrong type, and one without a text."""
    k = F.col("o_orderkey")
    raw = _by(k, _text('{"text": "hello ', k, '", "channel": "sms"}'), F.lit("[1, 2]"), F.lit('{"text": "x", "channel": "fax"}'), F.concat(F.lit('{"text": "'), F.repeat(F.lit("x"), 70_000), F.lit('"}')), F.lit('{"text": "x", "known_contact": "yes"}'), F.lit("{}"))
    d = readers.parse_payloads(table(spark, sf_dir, "orders").select(k, raw.alias("payload")))
    return d.select(k, "code", F.when(F.col("code") == 200, F.col("text")).alias("text"))


#: (text, rules that must fire): words of a rule where it must not fire, and rules that hang on more than the text.
_CALM = (
    ("Do not share your code with anyone who calls you, says note {n}", "PROTECTIVE_LANGUAGE"),
    ("Reply with the promo code {n} to get the offer that you like", ""),
    ("Our code of conduct, in version {n}, is for you to read", ""),
    ("We met at the old bank of the river, seat {n} was free", ""),
    ("My brother likes to send cards from the sea, {n} of them by now", ""),
    ("The delivery of parcel {n} went well and we thank you", ""),
    ("Never pay anyone with gift cards, says leaflet {n} of the club", ""),
    ("I paid for {n} tickets and you can have one of them", ""),
)
_CALM_SQL = "(VALUES " + ", ".join(f"({i}, {_quote(names)})" for i, (_, names) in enumerate(_CALM)) + ") AS c(i, names)"


@query(f"SELECT o_orderkey, names FROM orders JOIN {_CALM_SQL} ON i = o_orderkey % {len(_CALM)}")
def calm_messages(spark, sf_dir):
    k = F.col("o_orderkey")
    text = _by(k, *[F.replace(F.lit(t), F.lit("{n}"), k.cast("string")) for t, _ in _CALM])
    d = table(spark, sf_dir, "orders").repartition(4 * spark.sparkContext.defaultParallelism).select(k, k.cast("string").alias("msg_id"), text.alias("text"))
    return rules.evaluate(ingest.ingest(d)).select("o_orderkey", F.array_join("fired", " ").alias("names"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS trusted, c_custkey % 2 = 0 AS misread, c_custkey % 2 = 1 AS imitated FROM customer")
def screenshots_and_trust(spark, sf_dir):
    """A domain one letter off is an error of recognition in a screenshot and an imitation in a text."""
    k = F.col("c_custkey")
    d = spread(table(spark, sf_dir, "customer").select(k)).select(k, k.cast("string").alias("msg_id"), _text("Order ", k, " of ours is at http://paypall.com/o for you").alias("text"), (k % 2 == 0).alias("trusted_sender"), F.when(k % 2 == 0, F.array(F.lit("from_image"))).alias("extra_flags"))
    d = rules.evaluate(ingest.ingest(d))
    has = lambda n: F.array_contains("fired", n)
    return d.select(k, has("TRUSTED_SENDER").alias("trusted"), has("POSSIBLE_LOOKALIKE_OCR").alias("misread"), has("LOOKALIKE_DOMAIN").alias("imitated"))


