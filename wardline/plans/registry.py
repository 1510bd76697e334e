"""All registered queries of the library, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import Config
from wardline.functions import lexicon as lx
from wardline.functions.spans import any_of, rx
from wardline.operators import brands, casestore, evidence, ingest, layout, masking, metrics, rules, scoring
from wardline.plans.messages import TEMPLATES, analyse, templated
from wardline.streaming.limits import rate_limit

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_PEPPER = "pepper"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table's rows dealt over four tasks a core, if its files make fewer: for rows that cost much more than reading them."""
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def _quote(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


#: The templates as SQL, with the rules that must fire and what they add up to.
def _score(names: str) -> int:
    return max(0, min(100, sum(lx.WEIGHTS[n] for n in names.split() if n != "-")))


def _combo(names: str) -> bool:
    got = set(names.split())
    return bool(got & set(lx.REQUESTS)) and bool(got & {*lx.IMPERSONATIONS, "AUTHORITY_CLAIM"})


_VALUES = "(VALUES " + ", ".join(f"({i}, {_quote(t)}, {_quote(names)}, {_score(names)}, {_combo(names)})" for i, (_, _, _, _, t, names) in enumerate(TEMPLATES)) + ") AS t(tid, template, names, rule_sum, combo)"
_MESSAGES = f"(SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, o_orderkey, o_custkey, tid, replace(template, '{{n}}', CAST(o_orderkey AS VARCHAR)) AS text, names, rule_sum, combo FROM orders JOIN {_VALUES} ON o_orderkey % {len(TEMPLATES)} = tid)"
_FINAL = f"""(SELECT *, CASE WHEN names = '-' THEN NULL WHEN s >= 80 AND NOT combo THEN 79 ELSE s END AS score FROM
  (SELECT *, CASE WHEN combo THEN greatest(rule_sum, 55) ELSE rule_sum END AS s FROM {_MESSAGES}))"""
_TIER = "CASE WHEN score IS NULL THEN NULL WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 55 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis_tiers(spark, sf_dir)


def _evaluated(spark, sf_dir):
    return rules.evaluate(ingest.ingest(templated(spark, sf_dir)))


@query(f"SELECT tier, action, count(*) AS n, sum(coalesce(score, -1))::BIGINT AS total FROM (SELECT score, {_TIER} AS tier, CASE WHEN score IS NULL THEN 'UNABLE_TO_ANALYZE' WHEN score >= 80 THEN 'BLOCK_LINKS' WHEN score >= 55 THEN 'INTERSTITIAL' WHEN score >= 30 THEN 'SOFT_WARN' ELSE 'ALLOW' END AS action FROM {_FINAL}) GROUP BY ALL")
def analysis_tiers(spark, sf_dir):
    """The whole analysis, by tier and action."""
    return analyse(templated(spark, sf_dir)).groupBy("tier", "action").agg(F.count("*").alias("n"), F.sum(F.coalesce("score", F.lit(-1))).alias("total"))


@query(f"SELECT msg_id, coalesce(score, -1) AS score, {_TIER} AS tier FROM {_FINAL}")
def scored_messages(spark, sf_dir):
    return analyse(templated(spark, sf_dir)).select("msg_id", F.coalesce("score", F.lit(-1)).alias("score"), "tier")


@query(f"SELECT rule AS name, count(*) AS n FROM (SELECT unnest(string_split(names, ' ')) AS rule FROM {_MESSAGES} WHERE names NOT IN ('', '-')) GROUP BY rule")
def rule_frequency(spark, sf_dir):
    return rules.rule_hits(_evaluated(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))


def _word_rule(name: str):
    patterns = any_of(lx.WORDS[name])
    # the oracle's expressions have no look-around; these patterns have none either
    sql = f"SELECT tid, count(*) AS n FROM {_MESSAGES} WHERE regexp_matches(replace(text, chr(8203), ''), {_quote('(?i)' + patterns)}) GROUP BY tid"

    def run(spark, sf_dir):
        return templated(spark, sf_dir).where(F.translate("text", lx.ZERO_WIDTH, "").rlike(rx(patterns))).groupBy("tid").agg(F.count("*").alias("n"))

    run.__name__ = f"rule_{name.lower()}"
    query(sql)(run)


for _name in lx.WORDS:
    _word_rule(_name)


@query("SELECT doc_id, length(text) AS original_length, length(text) > 5000 AS truncated, CASE WHEN length(text) > 8000 THEN 'too_long' WHEN trim(text) = '' THEN 'empty' WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'no_text_content' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 15 THEN 'too_short' END AS gate FROM documents")
def ingest_gates(spark, sf_dir):
    d = ingest.normalise(table(spark, sf_dir, "documents").select("doc_id", "text"), Config())
    return d.select("doc_id", "original_length", (F.col("original_length") > 5000).alias("truncated"), F.when(F.get("quality_flags", F.lit(0)).isin("too_long", "empty", "no_text_content", "too_short"), F.get("quality_flags", F.lit(0))).alias("gate"))


_LIST = lambda words: "[" + ", ".join(_quote(w) for w in words) + "]"


@query(f"SELECT doc_id, len(list_filter(w, lambda x: list_contains({_LIST(lx.ENGLISH)}, x))) AS english, len(list_filter(w, lambda x: list_contains({_LIST(lx.FOREIGN)}, x))) AS other FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda x: lower(x)) AS w FROM documents)")
def stopword_counts(spark, sf_dir):
    n = lambda kept: ingest.stopword_count(F.col("text"), kept).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n(lx.ENGLISH).alias("english"), n(lx.FOREIGN).alias("other"))


@query(f"SELECT p_partkey, 'a plain note for you ' || translate(replace(replace(replace(p_name, 'a', 'а'), 'o', 'ο'), 'e', 'е'), {_quote(lx.LOOKALIKE_FROM)}, {_quote(lx.LOOKALIKE_TO)}) AS folded FROM part")
def homoglyph_fold(spark, sf_dir):
    """Part names with three letters of other scripts in them, as the analysis reads them."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a plain note for you "), F.translate("p_name", "aoe", "аοе")).alias("text"))
    return ingest.normalise(d, Config()).select("p_partkey", F.col("analysis_text").alias("folded"))


_HOST = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"
_REG = f"CASE WHEN len(p) >= 3 AND list_contains({_LIST(lx.SUFFIXES)}, array_to_string(p[-2:], '.')) THEN array_to_string(p[-3:], '.') WHEN len(p) < 2 THEN array_to_string(p, '.') ELSE array_to_string(p[-2:], '.') END"


@query(f"SELECT page_id, host, {_REG} AS registrable FROM (SELECT page_id, {_HOST} AS host, string_split({_HOST}, '.') AS p FROM pages)")
def registrable_domains(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), brands.registrable_domain(host).alias("registrable"))


@query("SELECT page_id, u AS raw FROM (SELECT page_id, unnest(regexp_extract_all(url, '(?i)(?:https?)://[^\\s<>\"''()\\[\\]{}]+')) AS u FROM pages)")
def page_urls(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", F.explode(ingest.extract_urls(F.col("url"), F.col("url"))).alias("u"))
    return d.select("page_id", "u.raw")


@query()
def message_entities(spark, sf_dir):
    d = ingest.ingest(table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("msg_id"), "text"))
    return d.select("msg_id", "status", F.size("urls").alias("urls"), F.size("emails").alias("emails"), F.size("phones").alias("phones"), F.size("amounts").alias("amounts"), F.size("crypto").alias("crypto"))


@query("SELECT * FROM (VALUES ('paypa1.com','PayPal','leetspeak'),('paypal-secure.com','PayPal','brand-in-domain'),('paypla.com','PayPal','typosquat'),('paypal.com.evil.io','PayPal','subdomain-trick'),('chase.com-login.net','Chase','subdomain-trick'),('rnicrosoft.com','Microsoft','leetspeak'),('wellsfrago.com','Wells Fargo','typosquat')) AS t(host, brand, technique)")
def lookalike_hosts(spark, sf_dir):
    """Every host of pages, none of which imitates a brand, and some that do."""
    hosts = ["paypa1.com", "paypal-secure.com", "paypla.com", "paypal.com.evil.io", "chase.com-login.net", "rnicrosoft.com", "wellsfrago.com", "phase.com", "example.org", "www.paypal.com", None]
    seen = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1)).alias("host"))
    d = brands.lookalike_hosts(seen.union(spark.createDataFrame([(h,) for h in hosts], "host string")))
    return d.select("host", brands.brand_field(F.col("brand_ord"), "display").alias("brand"), "technique")


@query("SELECT DISTINCT p_name, damerau_levenshtein(w, 'paypal')::INTEGER AS distance, damerau_levenshtein(w, w[2:2] || w[1:1] || w[3:])::INTEGER AS swapped FROM (SELECT p_name, split_part(p_name, ' ', 1) AS w FROM part)")
def edit_distance(spark, sf_dir):
    """First words of all names: to a brand, and to themselves with two letters swapped, which is one edit."""
    w = F.substring_index("p_name", " ", 1)
    swapped = F.concat(F.substring(w, 2, 1), F.substring(w, 1, 1), F.substr(w, F.lit(3)))
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", brands.osa_distance(w, F.lit("paypal")).alias("distance"), brands.osa_distance(w, swapped).alias("swapped"))


@query("SELECT c_custkey, replace(replace(translate(lower(c_name), '013457@$', 'oleastas'), 'rn', 'm'), 'vv', 'w') AS plain FROM customer")
def deleet(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", brands.deleet(F.col("c_name")).alias("plain"))


@query("SELECT o_orderkey, 'mail [EMAIL]@mail.example.com or visit https://u.example.com/p?[QUERY]' AS masked FROM orders")
def mask_addresses(spark, sf_dir):
    text = F.concat(F.lit("mail a"), F.col("o_custkey").cast("string"), F.lit("@mail.example.com or visit https://u.example.com/p?id="), F.col("o_orderkey").cast("string"))
    return masking.mask_text(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), "t").select("o_orderkey", F.col("masked_text").alias("masked"))


@query()
def mask_documents(spark, sf_dir):
    d = masking.mask_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")
    return d.select("doc_id", F.md5("masked_text").alias("masked_md5"), F.to_json("mask_counts").alias("counts"))


_LUHN = "list_reduce(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(d[i:i] AS INT) > 4 THEN 2 * CAST(d[i:i] AS INT) - 9 ELSE 2 * CAST(d[i:i] AS INT) END ELSE CAST(d[i:i] AS INT) END), lambda a, b: a + b) % 10 = 0"


@query(f"SELECT o_orderkey, {_LUHN} AS valid FROM (SELECT o_orderkey, lpad(CAST(4000000000000000 + o_orderkey * 7 AS VARCHAR), 16, '0') AS d FROM orders)")
def luhn(spark, sf_dir):
    digits = (F.lit(4000000000000000) + F.col("o_orderkey") * 7).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", masking.luhn_ok(digits).alias("valid"))


@query("SELECT s_suppkey, (CAST('32142829' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') || '161182' AS HUGEINT) % 97) = 1 AS valid FROM supplier")
def iban(spark, sf_dir):
    value = F.concat(F.lit("GB82"), F.lit("WEST"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", masking.iban_ok(value).alias("valid"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '[EMAIL]@shop.example' WHEN c_custkey % 4 = 1 THEN '[PHONE …' || right('1555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 2) || ']' WHEN c_custkey % 4 = 2 THEN '12345' ELSE '[HANDLE]' END AS masked FROM customer")
def mask_senders(spark, sf_dir):
    k = F.col("c_custkey")
    sender = F.when(k % 4 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@shop.example"))).when(k % 4 == 1, F.concat(F.lit("+1 555 "), F.lpad(k.cast("string"), 7, "0"))).when(k % 4 == 2, "12345").otherwise("someone")
    return table(spark, sf_dir, "customer").select("c_custkey", masking.mask_sender(sender).alias("masked"))


# cases are orders, their events are the orders' lines

_CASES = "(SELECT CAST(o_orderkey AS VARCHAR) AS case_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS ts, epoch(o_orderdate)::DOUBLE AS ts_epoch, CASE WHEN o_orderkey % 11 = 0 THEN 'INSUFFICIENT_DATA' ELSE 'OK' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'LOW' WHEN o_orderkey % 4 = 1 THEN 'MEDIUM' WHEN o_orderkey % 4 = 2 THEN 'HIGH' ELSE 'CRITICAL' END AS tier, (o_orderkey % 13 = 0)::INTEGER AS needs_review, NULL::VARCHAR AS user_action, 'pending' AS analyst_outcome FROM orders)"
_EVENTS = "(SELECT l_orderkey * 10000000 + l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber AS event_id, CAST(l_orderkey AS VARCHAR) AS case_id, CASE l_linenumber % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'user' ELSE 'system' END AS actor, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_quantity < 10 THEN 'overturned_legitimate' ELSE 'confirmed_scam' END WHEN 1 THEN CASE WHEN l_quantity < 15 THEN 'appeal_legitimate' WHEN l_quantity < 25 THEN 'report_scam' ELSE 'links_revealed' END ELSE 'intervention:ALLOW' END AS event_type FROM lineitem)"


def _cases(spark, sf_dir):
    k = F.col("o_orderkey")
    tier = F.when(k % 11 == 0, F.lit(None)).when(k % 4 == 0, "LOW").when(k % 4 == 1, "MEDIUM").when(k % 4 == 2, "HIGH").otherwise("CRITICAL")
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), F.unix_timestamp("o_orderdate").cast("double").alias("ts_epoch"), F.when(k % 11 == 0, "INSUFFICIENT_DATA").otherwise("OK").alias("status"), tier.alias("tier"), (k % 13 == 0).cast("int").alias("needs_review"), F.lit(None).cast("string").alias("user_action"), F.lit("pending").alias("analyst_outcome"))


def _events(spark, sf_dir):
    m, q = F.col("l_linenumber") % 3, F.col("l_quantity")
    actor = F.when(m == 0, "analyst").when(m == 1, "user").otherwise("system")
    kind = F.when(m == 0, F.when(q < 10, "overturned_legitimate").otherwise("confirmed_scam")).when(m == 1, F.when(q < 15, "appeal_legitimate").when(q < 25, "report_scam").otherwise("links_revealed")).otherwise("intervention:ALLOW")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 100 * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_orderkey").cast("string").alias("case_id"), actor.alias("actor"), kind.alias("event_type"))


_VIEW = f"(SELECT c.* EXCLUDE (user_action, analyst_outcome), coalesce((SELECT event_type FROM {_EVENTS} e WHERE e.case_id = c.case_id AND actor = 'user' ORDER BY event_id DESC LIMIT 1), user_action) AS user_action, coalesce((SELECT event_type FROM {_EVENTS} e WHERE e.case_id = c.case_id AND actor = 'analyst' ORDER BY event_id DESC LIMIT 1), analyst_outcome) AS analyst_outcome, case_id IN (SELECT case_id FROM {_EVENTS} WHERE event_type = 'appeal_legitimate') AS appealed, case_id IN (SELECT case_id FROM {_EVENTS} WHERE event_type = 'report_scam') AS reported FROM {_CASES} c)"
_QUEUE = f"(SELECT *, CASE WHEN appealed THEN 0 WHEN needs_review = 1 THEN 1 WHEN reported THEN 2 ELSE 3 END AS rank, concat_ws(', ', CASE WHEN appealed THEN 'user appeal' END, CASE WHEN needs_review = 1 THEN 'needs review' END, CASE WHEN reported THEN 'user report' END, CASE WHEN tier IN ('HIGH', 'CRITICAL') THEN 'tier ' || tier END) AS reasons FROM {_VIEW} WHERE analyst_outcome = 'pending' AND status = 'OK' AND (tier IN ('HIGH', 'CRITICAL') OR needs_review = 1 OR appealed OR reported))"


@query(f"SELECT case_id, user_action, analyst_outcome FROM {_VIEW}")
def case_view(spark, sf_dir):
    return casestore.case_view(_cases(spark, sf_dir), _events(spark, sf_dir)).select("case_id", "user_action", "analyst_outcome")


@query(f"SELECT case_id, ts, rank, reasons FROM {_QUEUE}")
def analyst_queue(spark, sf_dir):
    return casestore.analyst_queue(_cases(spark, sf_dir), _events(spark, sf_dir)).select("case_id", "ts", "rank", "reasons").orderBy("rank", F.desc("ts"), "case_id")


@query(f"SELECT *, confirmed_scam + overturned_legitimate AS analyst_decisions, round(appeals::DOUBLE / flagged_cases, 3) AS appeal_rate, round(overturned_legitimate::DOUBLE / (confirmed_scam + overturned_legitimate), 3) AS overturn_rate FROM (SELECT count(*) AS total_cases, count(*) FILTER (tier IN ('MEDIUM', 'HIGH', 'CRITICAL')) AS flagged_cases, count(*) FILTER (analyst_outcome = 'confirmed_scam') AS confirmed_scam, count(*) FILTER (analyst_outcome = 'overturned_legitimate') AS overturned_legitimate FROM {_VIEW}), (SELECT count(DISTINCT case_id) FILTER (event_type = 'appeal_legitimate') AS appeals, count(DISTINCT case_id) FILTER (event_type = 'report_scam') AS reports FROM {_EVENTS})")
def decision_stats(spark, sf_dir):
    return casestore.decision_stats(_cases(spark, sf_dir), _events(spark, sf_dir))


@query(f"SELECT coalesce(tier, 'INSUFFICIENT_DATA') AS tier, count(*) AS n FROM {_CASES} GROUP BY ALL")
def cases_by_tier(spark, sf_dir):
    return casestore.cases_by_tier(_cases(spark, sf_dir))


@query(f"SELECT analyst_outcome, count(*) AS n FROM {_VIEW} WHERE appealed GROUP BY ALL")
def appeal_outcomes(spark, sf_dir):
    return casestore.appeal_outcomes(_cases(spark, sf_dir), _events(spark, sf_dir))


@query(f"SELECT case_id, ts FROM {_CASES} ORDER BY ts DESC, case_id LIMIT 200")
def recent_cases(spark, sf_dir):
    return casestore.recent_cases(_cases(spark, sf_dir)).select("case_id", "ts")


@query(f"SELECT event_id, case_id, actor, event_type FROM {_EVENTS} WHERE case_id IN (SELECT case_id FROM {_CASES} WHERE status = 'OK')")
def valid_events(spark, sf_dir):
    return casestore.valid_events(_events(spark, sf_dir), _cases(spark, sf_dir).where("status = 'OK'"))[0]


@query(f"SELECT event_id, case_id FROM {_EVENTS} WHERE case_id NOT IN (SELECT case_id FROM {_CASES} WHERE status = 'OK')")
def rejected_events(spark, sf_dir):
    return casestore.valid_events(_events(spark, sf_dir), _cases(spark, sf_dir).where("status = 'OK'"))[1].select("event_id", "case_id")


@query(f"SELECT (SELECT count(*) FROM {_CASES} WHERE ts_epoch < 852076800.0::DOUBLE - 30 * 86400.0) AS cases_deleted, (SELECT count(*) FROM {_EVENTS} WHERE case_id IN (SELECT case_id FROM {_CASES} WHERE ts_epoch < 852076800.0::DOUBLE - 30 * 86400.0)) AS events_deleted")
def retention_purge(spark, sf_dir):
    return casestore.purge(_cases(spark, sf_dir), _events(spark, sf_dir), 852076800.0, 30)[2]


_TRUST = "(SELECT event_id, CAST(user_id AS VARCHAR) AS user_hash, event_type AS sender_hash, CAST(event_id AS VARCHAR) AS case_id, 'm' || CAST(event_id AS VARCHAR) AS sender_masked, CAST(event_id AS VARCHAR) AS added_ts, value > 50 AS active FROM events)"


@query(f"SELECT user_hash, sender_hash, arg_min(sender_masked, event_id) AS sender_masked, arg_min(case_id, event_id) AS case_id, arg_max(added_ts, event_id) AS added_ts, arg_max(active, event_id) AS active FROM (SELECT * FROM {_TRUST} WHERE active IS NOT NULL) GROUP BY user_hash, sender_hash")
def trusted_senders(spark, sf_dir):
    e = F.col("event_id").cast("string")
    d = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_hash"), F.col("event_type").alias("sender_hash"), e.alias("case_id"), F.concat(F.lit("m"), e).alias("sender_masked"), e.alias("added_ts"), (F.col("value") > 50).alias("active")).where("active is not null")
    return casestore.trusted_senders(d)


# evaluation: labels are the truth, a document's quality stands for its tier

_RECORDS = "(SELECT l.doc_id AS id, CASE WHEN toxic = 1 THEN 'scam' ELSE 'legit' END AS label, CASE l.doc_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'INSUFFICIENT' END AS tier, CASE WHEN quality = 1 THEN 'dev' ELSE 'holdout' END AS split, lang AS category, n_chars::DOUBLE AS latency_ms FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    tier = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL", "INSUFFICIENT"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "scam").otherwise("legit").alias("label"), tier.alias("tier"), F.when(F.col("quality") == 1, "dev").otherwise("holdout").alias("split"), F.col("lang").alias("category"), F.col("n_chars").cast("double").alias("latency_ms"))


_POINTS = f"(SELECT r.*, point, CASE point WHEN 'warn' THEN tier IN ('MEDIUM', 'HIGH', 'CRITICAL') ELSE tier IN ('HIGH', 'CRITICAL') END AS f FROM {_RECORDS} r, (VALUES ('warn'), ('interrupt')) AS p(point))"
_COUNTS = f"(SELECT point, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) FILTER (f AND label = 'scam') AS tp, count(*) FILTER (f AND label <> 'scam') AS fp, count(*) FILTER (NOT f AND label <> 'scam') AS tn, count(*) FILTER (NOT f AND label = 'scam') AS fn FROM {_POINTS} GROUP BY GROUPING SETS ((point), (point, split)))"
_R = lambda a, b: f"coalesce(round(({a})::DOUBLE / nullif({b}, 0), 3), 0.0::DOUBLE)"


@query(f"SELECT point, split, tp, fp, tn, fn, {_R('tp', 'tp + fp')} AS precision, {_R('tp', 'tp + fn')} AS recall, {_R('2 * tp', '2 * tp + fp + fn')} AS f1, {_R('fp', 'fp + tn')} AS fpr, {_R('tp + tn', 'tp + fp + tn + fn')} AS accuracy FROM {_COUNTS}")
def binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(_records(spark, sf_dir))


@query(f"SELECT label, " + ", ".join(f'count(*) FILTER (tier = \'{t}\') AS "{t}"' for t in metrics.TIERS) + f" FROM {_RECORDS} GROUP BY label")
def confusion(spark, sf_dir):
    return metrics.confusion(_records(spark, sf_dir))


@query(f"SELECT label, category, count(*) AS n, count(*) FILTER (tier IN ('MEDIUM', 'HIGH', 'CRITICAL')) AS warned, count(*) FILTER (tier IN ('HIGH', 'CRITICAL')) AS interrupted FROM {_RECORDS} GROUP BY ALL")
def per_category(spark, sf_dir):
    return metrics.per_category(_records(spark, sf_dir))


@query(f"SELECT label, round(quantile_cont(latency_ms, 0.5), 2) AS p50, round(quantile_cont(latency_ms, 0.95), 2) AS p95, round(avg(latency_ms), 2) AS mean FROM {_RECORDS} GROUP BY label")
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(_records(spark, sf_dir), "latency_ms", "label")


@query(f"SELECT id, error FROM (SELECT id, CASE WHEN label = 'scam' AND tier NOT IN ('MEDIUM', 'HIGH', 'CRITICAL') THEN 'false negative (no warning)' WHEN label = 'legit' AND tier IN ('MEDIUM', 'HIGH', 'CRITICAL') THEN 'false positive (' || tier || ')' END AS error FROM {_RECORDS}) WHERE error IS NOT NULL")
def misclassified(spark, sf_dir):
    return metrics.misclassified(_records(spark, sf_dir)).select("id", "error")


@query("WITH p AS (SELECT b.item_id AS id, b.text AS source, d.text AS seen FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), a AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(source), '[a-z0-9]+')) AS w FROM p) GROUP BY ALL), c AS (SELECT id, w, count(*) AS m FROM (SELECT id, unnest(regexp_extract_all(lower(seen), '[a-z0-9]+')) AS w FROM p) GROUP BY ALL) SELECT id, sum(least(n, coalesce(m, 0)))::BIGINT AS hits, sum(n)::BIGINT AS words FROM a LEFT JOIN c USING (id, w) GROUP BY id")
def word_hits(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("source")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seen")), "id")
    a, b = metrics.word_counts(p, "id", "source"), metrics.word_counts(p, "id", "seen").withColumnRenamed("n", "m")
    return a.join(b, ["id", "w"], "left").groupBy("id").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("hits"), F.sum("n").alias("words"))


@query("WITH p AS (SELECT b.item_id AS id, b.text AS source, d.text AS seen FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), a AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(source), '[a-z0-9]+')) AS w FROM p) GROUP BY ALL), c AS (SELECT id, w, count(*) AS m FROM (SELECT id, unnest(regexp_extract_all(lower(seen), '[a-z0-9]+')) AS w FROM p) GROUP BY ALL) SELECT p.id, coalesce(recall, 1.0)::DOUBLE AS recall FROM p LEFT JOIN (SELECT id, sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n)::DOUBLE AS recall FROM a LEFT JOIN c USING (id, w) GROUP BY id) r ON r.id = p.id")
def word_recall(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("source")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seen")), "id")
    return metrics.word_recall(p)


# spans from lines of orders

_CATS = list(lx.PRIORITY)
_SPANS = "(SELECT l_orderkey AS msg_id, l_partkey % 40 AS s, l_partkey % 40 + l_suppkey % 15 AS e, (" + _LIST(_CATS) + ")[(l_linenumber % 7 + 1)::INTEGER] AS category, 'L' || CAST((l_partkey * 10 + l_linenumber) * 1000 + l_suppkey % 1000 AS VARCHAR) AS label, (l_partkey * 10 + l_linenumber) * 1000 + l_suppkey % 1000 AS ord FROM lineitem)"
_PRI = "CASE category " + " ".join(f"WHEN '{c}' THEN {p}" for c, p in lx.PRIORITY.items()) + " END"


@query(
    f"""WITH sp AS (SELECT DISTINCT * FROM {_SPANS} WHERE e > s), b AS (SELECT DISTINCT msg_id, p FROM (SELECT msg_id, s AS p FROM sp UNION ALL SELECT msg_id, e FROM sp)),
 q AS (SELECT msg_id, p, lead(p) OVER (PARTITION BY msg_id ORDER BY p) AS q FROM b),
 f AS (SELECT q.msg_id, p, q, arg_max(category, {_PRI} * 100000000000 - ord) AS category, string_agg(label, '|' ORDER BY ord) AS labels FROM q JOIN sp ON sp.msg_id = q.msg_id AND s <= p AND e >= q WHERE q IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, CASE WHEN lag(q) OVER w = p AND lag(category) OVER w = category AND lag(labels) OVER w = labels THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY msg_id ORDER BY p)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY msg_id ORDER BY p) AS run FROM r)
 SELECT msg_id, min(p)::BIGINT AS "start", max(q)::BIGINT AS "end", category, labels FROM g GROUP BY msg_id, run, category, labels"""
)
def span_overlay(spark, sf_dir):
    n = (F.col("l_partkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_suppkey") % 1000
    cats = F.array(*map(F.lit, _CATS))
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("msg_id"), (F.col("l_partkey") % 40).alias("start"), (F.col("l_partkey") % 40 + F.col("l_suppkey") % 15).alias("end"), F.element_at(cats, (F.col("l_linenumber") % 7 + 1).cast("int")).alias("category"), F.concat(F.lit("L"), n.cast("string")).alias("label"), n.alias("ord"))
    return evidence.overlay(d).select("msg_id", "start", "end", "category", F.array_join("labels", "|").alias("labels"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
 w(event_id, user_id, i, t, recent, allowed) AS (SELECT event_id, user_id, i, t, [t], true FROM e WHERE i = 1 UNION ALL
  SELECT event_id, user_id, i, t, CASE WHEN len(near) < 3 THEN list_append(near, t) ELSE near END, len(near) < 3 FROM (SELECT e.event_id, e.user_id, e.i, e.t, list_filter(w.recent, lambda x: e.t - x <= 3600) AS near FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
 SELECT event_id AS id, user_id::VARCHAR AS key, t AS now, allowed FROM w""")
def request_limits(spark, sf_dir):
    return rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=3, window=3600.0)


@query("SELECT event_id, '22000' AS sender_hint, 'Your parcel ' || CAST(event_id AS VARCHAR) || ' is waiting at https://www.example.com/a-b and more words' || chr(10) || 'Pay £20 now please.' AS text FROM events")
def layout_messages(spark, sf_dir):
    k = F.col("event_id")
    line = lambda text, y, h=20.0: F.struct(text.alias("text"), F.lit(0.9).alias("confidence"), F.lit(10.0).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(200.0).alias("x1"), F.lit(float(y + h)).alias("y1"))
    lines = F.array(line(F.lit("9:41 AM"), 0), line(F.lit("22000"), 40), line(F.concat(F.lit("Your parcel "), k.cast("string"), F.lit(" is waiting at")), 80), line(F.lit("https.//www.example.com/a-"), 102), line(F.lit("b and more words"), 124), line(F.lit("Pay f20 now please."), 190))
    return layout.extract_messages(spread(table(spark, sf_dir, "events").select("event_id")).select("event_id", lines.alias("lines"))).select("event_id", "sender_hint", "text")


@query("SELECT conf, rules, abs(rules - conf) >= 45 AS needs_review, least(round(0.6::DOUBLE * rules + 0.4::DOUBLE * conf), 79)::INTEGER AS score FROM (SELECT (doc_id % 101)::INTEGER AS conf, (doc_id * 7 % 80)::INTEGER AS rules FROM documents)")
def hybrid_blend(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 101).cast("int").alias("conf"), (F.col("doc_id") * 7 % 80).cast("int").alias("rule_score"))
    d = d.withColumns({"status": F.lit("OK"), "hits": F.array().cast(f"array<{rules.HIT}>"), "fired": F.array().cast("array<string>"), "critical_combo": F.lit(False), "combo_reason": F.lit(None).cast("string"), "llm_status": F.lit("ok"), "llm_confidence": F.col("conf") / 100, "llm_scam_type": F.lit("unclear"), "llm_injection_flagged": F.lit(False)})
    return scoring.score(d).select("conf", F.col("rule_score").alias("rules"), "needs_review", "score")
