"""Registered queries over whole texts and over rows made of them: clauses, respacing, screens, display pieces and image headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import lexicon as lx
from wardline.functions.spans import clauses, extended, located_long, running_totals, rx
from wardline.operators import brands, casestore, evidence, layout, metrics, respace, responses, rules
from wardline.plans.messages import analyse, templated
from wardline.plans.made import _BRAND_SQL, _BRANDS, _branded, _by, _text
from wardline.plans.registry import _CASES, _EVENTS, _FINAL, _LIST, _R, _RECORDS, _TIER, _cases, _events, _records, query, table, spread
from wardline.sources import readers

# DuckDB has no look-behind: a break after a sign takes the sign along, which belongs to the clause before
_SPACE = "[\\s\\x0b\\x{85}\\p{Z}]"
_BREAK = f"[.!?;]{_SPACE}+|\\n+|{_SPACE}+[-–—]{_SPACE}+"
_CLAUSES = f"""(SELECT doc_id, k, text, a::INTEGER AS start, (a + length(p) + CASE WHEN regexp_matches(b, '^[.!?;]') THEN 1 ELSE 0 END)::INTEGER AS stop FROM (
 SELECT doc_id, k, text, p, b, coalesce(sum(length(p) + length(b)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
 SELECT doc_id, text, generate_subscripts(ps, 1) AS k, unnest(ps) AS p, unnest(list_append(bs, '')) AS b FROM (SELECT doc_id, text, regexp_split_to_array(text, '{_BREAK}') AS ps, regexp_extract_all(text, '{_BREAK}') AS bs FROM documents))))"""


@query(f'SELECT doc_id, start, stop AS "end", md5(substr(text, start + 1, stop - start)) AS clause FROM {_CLAUSES} WHERE stop > start')
def document_clauses(spark, sf_dir):
    """Every clause of every document, with its place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(clauses(F.col("text"), rx(lx.CLAUSE_BREAK))).alias("c"))
    return d.select("doc_id", "c.start", "c.end", F.md5("c.value").alias("clause"))


_NOT = "regexp_replace(text, '\\b(and|und|et|y)\\b', 'not', 'g')"


@query(
    f"""SELECT doc_id, start, regexp_matches(array_to_string(w, ' '), '(^|[^\\p{{L}}\\p{{N}}_])(never|not|no one|nobody|without)([^\\p{{L}}\\p{{N}}_]|$)|n[''’]t($|[^\\p{{L}}\\p{{N}}_])') AS denied FROM (
 SELECT doc_id, start, list_slice(list_filter(regexp_split_to_array(regexp_extract(substr(text, start + 1, stop - start), '([^,:]*)$', 1), '{_SPACE}+'), lambda x: x <> ''), -5, -1) AS w FROM {_CLAUSES.replace("FROM documents", f"FROM (SELECT doc_id, {_NOT} AS text FROM documents)")} WHERE stop > start)"""
)
def denied_clauses(spark, sf_dir):
    """Whether one of the last five words of each clause denies what would follow: "and" is read as "not" here."""
    text = F.regexp_replace("text", r"(?<![A-Za-z0-9_])(and|und|et|y)(?![A-Za-z0-9_])", "not")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(clauses(text, rx(lx.CLAUSE_BREAK))).alias("c"))
    return d.select("doc_id", "c.start", rules.negated_before(F.col("c.value"), F.length("c.value")).alias("denied"))


@query(
    """WITH RECURSIVE words AS (SELECT unnest(regexp_extract_all(lower(p_name), '\\p{L}+')) AS w FROM part), costs AS (SELECT w, -ln(count(*) / (SELECT count(*) FROM words)) AS cost FROM words GROUP BY w HAVING count(*) >= 2),
 names AS (SELECT DISTINCT replace(p_name, ' ', '') AS s FROM part),
 ways(s, pos, said, total) AS (SELECT s, 0, '', 0.0::DOUBLE FROM names UNION ALL SELECT s, pos + length(w), said || ' ' || w, total + cost FROM ways JOIN costs ON substr(s, pos + 1, length(w)) = w WHERE length(w) > 1),
 best AS (SELECT s, arg_min(said, total) AS said FROM ways WHERE pos = length(s) GROUP BY s)
 SELECT p_partkey, CASE WHEN length(s) < 4 OR s IN (SELECT w FROM costs) OR said IS NULL THEN s ELSE trim(said) END AS respaced FROM (SELECT p_partkey, replace(p_name, ' ', '') AS s FROM part) LEFT JOIN best USING (s)"""
)
def respaced_names(spark, sf_dir):
    """Part names without their spaces, cut again by what words of part names cost. SQL lists all ways to cut them."""
    d = table(spark, sf_dir, "part")
    return respace.respace(d.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("t")), "t", respace.word_costs(d, "p_name")).select("p_partkey", "respaced")


def gap_places(text: Column) -> Column:
    """Where spaces stand, as the number of other characters before each."""
    return running_totals(F.transform(F.slice(F.split(text, " ", -1), F.lit(1), F.size(F.split(text, " ", -1)) - 1), lambda p: F.length(p)))


@query()
def respaced_documents(spark, sf_dir):
    """Spaces between letters are taken out of all documents and put back by what words cost in them: how many were, came back, and came elsewhere.

    A way to cut a whole text can't be said in SQL; a test holds it against brute force."""
    docs, least = table(spark, sf_dir, "documents"), 4 * spark.sparkContext.defaultParallelism
    # a document costs milliseconds: a few files are too few partitions for that
    d = docs.repartition(least) if docs.rdd.getNumPartitions() < least else docs
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("glued", F.regexp_replace("text", r"(?<=\p{L}) (?=\p{L})", ""))
    d = respace.respace(d, "glued", respace.word_costs(docs, "text"))
    return extended(d, "n", respace.GAPS, respace.gap_counts).select("doc_id", "n.taken", "n.back", "n.elsewhere")


# a turn of a conversation as a phone shows it: status bar, sender, who it is, the beginning of the text, and the text in lines

_WORDS = "list_filter(regexp_split_to_array(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' +'), lambda x: x <> '')"


@query(
    f"""SELECT conv_id, turn, '22000' AS sender_hint, CASE WHEN turn % 2 = 0 THEN 'Harbour Club' END AS claimed_hint, turn % 3 > 0 AS previewed,
 (CASE WHEN turn % 2 = 0 THEN 'Harbour Club ' ELSE '' END) || array_to_string(list_transform(range(0, ((len(w) + 5) // 6)::BIGINT), lambda i: array_to_string(w[6 * i + 1 : 6 * i + 6], ' ') || ' x' || i || 'z'), ' ') AS text
 FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations WHERE role = 'user') WHERE len(w) >= 12"""
)
def screens(spark, sf_dir):
    """Screens made of the turns of conversations with a dozen words or more: what is read off them again."""
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " +"), lambda x: x != "")
    d = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", words.alias("w")).where(F.size("w") >= 12)
    box = lambda text, y: F.struct(text.alias("text"), F.lit(0.9).alias("confidence"), F.lit(10.0).alias("x0"), y.cast("double").alias("y0"), F.lit(200.0).alias("x1"), (y + 20).cast("double").alias("y1"))
    body = F.transform(F.sequence(F.lit(0), ((F.size("w") + 5) / 6).cast("int") - 1), lambda i: box(F.concat(F.array_join(F.slice("w", 6 * i + 1, F.lit(6)), " "), F.lit(" x"), i.cast("string"), F.lit("z")), 62 + 22 * i))
    name = F.when(F.col("turn") % 2 == 0, F.array(box(F.lit("Harbour Club"), F.lit(40)))).otherwise(F.array().cast(f"array<{layout.LINE}>"))
    first = F.when(F.col("turn") % 3 > 0, F.array(box(F.concat(F.array_join(F.slice("w", 1, 3), " "), F.lit(" th9")), F.lit(20)))).otherwise(F.array().cast(f"array<{layout.LINE}>"))
    # a preview that stands before the name repeats the beginning of what follows it, the name included
    d = d.withColumn("lines", F.concat(F.array(box(F.lit("Today9:41AM"), F.lit(-40)), box(F.lit("22000"), F.lit(-20))), first, name, body))
    d = layout.extract_messages(d)
    return d.select("conv_id", "turn", "sender_hint", "claimed_hint", (F.size("dropped") > 1).alias("previewed"), "text")


_GLUED = f"(SELECT o_orderkey AS k, ({_LIST(layout.CHROME_WORDS)})[(o_orderkey * 7 % {len(layout.CHROME_WORDS)} + 1)::INTEGER] || CASE o_orderkey % 5 WHEN 0 THEN '·' WHEN 1 THEN '9:41AM' WHEN 2 THEN '' WHEN 3 THEN '12/3/2024' ELSE ' ' END || ({_LIST(layout.CHROME_WORDS)})[(o_custkey % {len(layout.CHROME_WORDS)} + 1)::INTEGER] || CASE WHEN o_orderkey % 4 = 0 THEN 'q' || o_custkey ELSE '' END AS t FROM orders)"
_SQUASHED = "^(?:" + "|".join(layout.CHROME_WORDS) + "|\\d{1,2}[:.]\\d{2}(?:am|pm)?|\\d{1,2}/\\d{1,2}(?:/\\d{2,4})?|[·•|,.:()-])+$"


@query(f"SELECT k AS o_orderkey, t, length(s) <= {layout.GLUED_CHARS} AND regexp_matches(s, '{_SQUASHED}') AND regexp_matches(s, '{'|'.join(layout.CHROME_MARKERS)}|\\d{{1,2}}[:.]\\d{{2}}') AS chrome FROM (SELECT *, lower(replace(t, ' ', '')) AS s FROM {_GLUED})")
def glued_interface(spark, sf_dir):
    """Two interface words with signs, times or dates between them, some with a tail that is no part of an interface."""
    k, words = F.col("o_orderkey"), F.array(*map(F.lit, layout.CHROME_WORDS))
    pick = lambda n: F.get(words, (n % len(layout.CHROME_WORDS)).cast("int"))
    t = F.concat(pick(k * 7), _by(k, F.lit("·"), F.lit("9:41AM"), F.lit(""), F.lit("12/3/2024"), F.lit(" ")), pick(F.col("o_custkey")), F.when(k % 4 == 0, _text("q", F.col("o_custkey"))).otherwise(""))
    return table(spark, sf_dir, "orders").select(k, t.alias("t"), layout.is_glued_chrome(t).alias("chrome"))


_ZERO = "​"
_SHOWN = f"(SELECT conv_id, turn, replace(replace(text, 'n ', 'n{_ZERO} '), 'e.', 'e{_ZERO}{_ZERO}.') AS t FROM conversations)"


@query(
    f"""WITH c AS (SELECT conv_id, turn, i, substr(t, i::INTEGER + 1, 1) AS ch FROM (SELECT *, unnest(range(0, length(t))) AS i FROM {_SHOWN})),
 s AS (SELECT *, ch = '{_ZERO}' AS hidden, i // 8 AS j, i % 8 < CASE WHEN i // 8 % 3 = 0 THEN 8 ELSE 5 END AS inside FROM c),
 m AS (SELECT *, CASE WHEN inside THEN CASE WHEN j // 2 % 2 = 0 THEN 'link' ELSE 'request' END END AS category, CASE WHEN inside THEN 'L' || (j // 2 % 3) ELSE '' END AS labels FROM s),
 f AS (SELECT *, CASE WHEN hidden OR lag(hidden) OVER w OR lag(category) OVER w IS DISTINCT FROM category OR lag(labels) OVER w <> labels OR i = 0 THEN 1 ELSE 0 END AS head FROM m WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
 g AS (SELECT *, sum(head) OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM f)
 SELECT conv_id, turn, (n - 1)::INTEGER AS n, string_agg(ch, '' ORDER BY i) AS text, category, labels, hidden FROM g GROUP BY conv_id, turn, n, category, labels, hidden"""
)
def display_pieces(spark, sf_dir):
    """Turns of conversations with invisible characters, cut at these and at the bounds of spans."""
    t = F.replace(F.replace("text", F.lit("n "), F.lit(f"n{_ZERO} ")), F.lit("e."), F.lit(f"e{_ZERO}{_ZERO}."))
    d = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", t.alias("t"))
    span = lambda j: F.struct((8 * j).alias("start"), F.least(8 * j + F.when(j % 3 == 0, 8).otherwise(5), F.length("t")).alias("end"), F.when((j / 2).cast("int") % 2 == 0, "link").otherwise("request").alias("category"), F.array(F.concat(F.lit("L"), ((j / 2).cast("int") % 3).cast("string"))).alias("labels"))
    spans = F.filter(F.transform(F.sequence(F.lit(0), (F.length("t") / 8).cast("int")), span), lambda s: s["end"] > s["start"])
    hidden = F.transform(located_long(F.col("t"), _ZERO), lambda s: s["start"])
    d = d.withColumn("spans", spans).withColumn("hidden", hidden)
    d = d.select("conv_id", "turn", F.posexplode(evidence.display_pieces(F.col("t"), F.col("spans"), F.col("hidden"))).alias("n", "p"))
    return d.select("conv_id", "turn", "n", "p.text", "p.category", F.array_join("p.labels", ";").alias("labels"), "p.hidden")


_W, _H = "(o_orderkey % 5000 + 1)", "(o_custkey % 6000 + 1)"


@query(
    f"""SELECT k AS o_orderkey, format, CASE WHEN flag IS DISTINCT FROM 'corrupt_image' THEN w END AS width, CASE WHEN flag IS DISTINCT FROM 'corrupt_image' THEN h END AS height, turn AS orientation,
 CASE WHEN flag IS NULL THEN greatest(1, round(ws * share)) END::BIGINT AS shown_width, CASE WHEN flag IS NULL THEN greatest(1, round(hs * share)) END::BIGINT AS shown_height, flag FROM (
 SELECT *, least(1.0::DOUBLE, 2000.0::DOUBLE / greatest(ws, hs)) AS share FROM (SELECT *, CASE WHEN turn >= 5 THEN h ELSE w END AS ws, CASE WHEN turn >= 5 THEN w ELSE h END AS hs FROM (
 SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'JPEG' WHEN 6 THEN 'JPEG' ELSE 'WEBP' END AS format, {_W} AS w, {_H} AS h,
  CASE WHEN o_orderkey % 7 IN (0, 1, 2, 3) THEN (o_orderkey % 8 + 1)::INTEGER END AS turn, CASE WHEN o_orderkey % 7 = 6 THEN 'corrupt_image' WHEN {_W} * {_H} > 25000000 THEN 'image_too_many_pixels' END AS flag FROM orders)))"""
)
def image_headers(spark, sf_dir):
    """Headers of made images of all kinds: PNG with EXIF, JPEG in either byte order with filling bytes, three kinds of WEBP, and a JPEG without a size."""
    k = F.col("o_orderkey")
    w, h, turn = k % 5000 + 1, F.col("o_custkey") % 6000 + 1, k % 8 + 1
    big = lambda n, size: F.lpad(F.hex(n), 2 * size, "0")
    little = lambda n, size: F.concat(*[F.substring(big(n, size), 2 * i + 1, 2) for i in reversed(range(size))])
    tiff = F.concat(F.lit("4D4D002A000000080002010000040000000100000001011200030000000100"), big(turn, 1), F.lit("0000" + "00000000"))
    other = F.concat(F.lit("49492A0008000000" + "0100" + "1201030001000000"), little(turn, 2), F.lit("0000" + "00000000"))
    chunk = lambda name, data: F.concat(big(F.length(data) / 2, 4), F.lit(name), data, F.lit("00000000"))
    part = lambda name, data: F.concat(F.lit(name), little((F.length(data) / 2).cast("long"), 4), data, F.when((F.length(data) / 2) % 2 == 1, "00").otherwise(""))
    png = F.concat(F.lit("89504E470D0A1A0A"), chunk("49484452", F.concat(big(w, 4), big(h, 4), F.lit("0802000000"))).substr(1, 1000), chunk("65584966", tiff), F.lit("0000000049454E44AE426082"))
    frame = lambda mark: F.concat(F.lit(mark + "001108"), big(h, 2), big(w, 2), F.lit("03012200021101031101"), F.lit("FFDA"))
    app1 = lambda t: F.concat(F.lit("FFE1"), big((F.length(t) / 2).cast("long") + 8, 2), F.lit("457869660000"), t)
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), app1(tiff), F.lit("FFFFFFDB0004AAAA"), frame("FFC0"))
    jpeg2 = F.concat(F.lit("FFD8"), app1(other), F.lit("FFC40004AAAA"), frame("FFC2"))
    riff = lambda *parts: F.concat(F.lit("5249464600000000" + "57454250"), *parts)
    vp8x = riff(part("56503858", F.concat(F.lit("08000000"), little(w - 1, 3), little(h - 1, 3))), part("41414141", F.lit("010203")), part("45584946", tiff))
    vp8 = riff(part("56503820", F.concat(F.lit("0000009D012A"), little(w, 2), little(h, 2))))
    vp8l = riff(part("5650384C", F.concat(F.lit("2F"), little(w - 1 + (h - 1) * 16384, 4))))
    content = F.unhex(_by(k, png, jpeg, jpeg2, vp8x, vp8, vp8l, F.lit("FFD8FFE00004AAAAFFD9")))
    d = readers.judge_images(table(spark, sf_dir, "orders").select(k, content.alias("content")), most_pixels=25_000_000)
    return d.select("o_orderkey", "format", "width", "height", "orientation", "shown_width", "shown_height", "flag")


_READ = "(SELECT page_id, page_id % 3 AS variant, url AS truth, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, '.com', '.c0m') ELSE replace(url, '/', ' ') END AS got, ['LOW', 'MEDIUM', 'HIGH'][(page_id % 5 % 3 + 1)::INTEGER] AS tier, ['LOW', 'MEDIUM', NULL][(page_id % 7 % 3 + 1)::INTEGER] AS text_tier, length(html)::DOUBLE / 10 AS ms FROM pages)"
_DOMAINS = "list_distinct(regexp_extract_all(lower({}), '" + metrics.DOMAIN + "'))"


@query(
    f"""WITH r AS {_READ}, w AS (SELECT page_id, w, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(truth), '[a-z0-9]+')) AS w FROM r) GROUP BY ALL), h AS (SELECT page_id, w, count(*) AS m FROM (SELECT page_id, unnest(regexp_extract_all(lower(got), '[a-z0-9]+')) AS w FROM r) GROUP BY ALL),
 c AS (SELECT page_id, sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n) AS recall FROM w LEFT JOIN h USING (page_id, w) GROUP BY page_id),
 d AS (SELECT r.*, recall, tier = coalesce(text_tier, 'INSUFFICIENT') AS t, (tier IN ('MEDIUM', 'HIGH', 'CRITICAL')) = coalesce(text_tier IN ('MEDIUM', 'HIGH', 'CRITICAL'), false) AS v, list_has_all({_DOMAINS.format("got")}, {_DOMAINS.format("truth")}) AS k FROM r JOIN c USING (page_id))
 SELECT CASE WHEN grouping(variant) = 1 THEN 'all' ELSE variant::VARCHAR END AS variant, count(*) AS n, round(avg(recall), 3) AS recall, count(*) FILTER (t) AS same_tier, count(*) FILTER (v) AS same_warning, count(*) FILTER (k) AS domains_kept, round(quantile_cont(ms, 0.5), 2) AS median_ms FROM d GROUP BY ROLLUP (variant)"""
)
def variant_scores(spark, sf_dir):
    """URLs of pages as read in three ways, against what they are."""
    k, url = F.col("page_id"), F.col("url")
    tier = lambda n, *of: F.get(F.array(*[F.lit(t).cast("string") for t in of]), (k % n % 3).cast("int"))
    got = _by(k, url, F.replace(url, F.lit(".com"), F.lit(".c0m")), F.replace(url, F.lit("/"), F.lit(" ")))
    d = table(spark, sf_dir, "pages").select(k.alias("id"), (k % 3).cast("string").alias("variant"), url.alias("truth"), got.alias("got"), tier(5, "LOW", "MEDIUM", "HIGH").alias("tier"), tier(7, "LOW", "MEDIUM", None).alias("text_tier"), (F.length("html") / 10).alias("ms"))
    return metrics.variant_scores(d)


_JUDGED = f"(SELECT *, CASE WHEN id % 2 = 0 THEN 'rules' ELSE 'hybrid' END AS mode, CASE WHEN tier = 'INSUFFICIENT' THEN NULL ELSE id % 100 END AS score, array_to_string(list_filter([CASE WHEN id % 3 = 0 THEN 'SHORTENED_URL' END, CASE WHEN id % 2 = 0 THEN 'URGENCY' END], lambda x: x IS NOT NULL), ', ') AS fired, CASE WHEN id % 2 = 1 THEN ' The classifier said phishing (' || (id % 100) || ').' ELSE '' END AS said FROM {_RECORDS})"
_F3 = lambda a, b: f"printf('%.3f', {_R(a, b)})"


@query(
    f"""WITH j AS {_JUDGED}, p AS (SELECT j.*, point, coalesce(CASE point WHEN 'warn' THEN tier IN ('MEDIUM', 'HIGH', 'CRITICAL') ELSE tier IN ('HIGH', 'CRITICAL') END, false) AS f FROM j, (VALUES ('warn'), ('interrupt')) AS x(point)),
 c AS (SELECT mode, point, grouping(split) AS g, split, count(*) AS n, count(*) FILTER (f AND label = 'scam') AS tp, count(*) FILTER (f AND label <> 'scam') AS fp, count(*) FILTER (NOT f AND label <> 'scam') AS tn, count(*) FILTER (NOT f AND label = 'scam') AS fn FROM p GROUP BY GROUPING SETS ((mode, point), (mode, point, split)))
 SELECT mode, '1 summary' AS section, CASE WHEN g = 1 THEN '' ELSE split END || ' ' || point AS place, '| ' || concat_ws(' | ', mode, CASE WHEN g = 1 THEN 'all' ELSE split END, n, point, {_F3("tp", "tp + fp")}, {_F3("tp", "tp + fn")}, {_F3("2 * tp", "2 * tp + fp + fn")}, {_F3("fp", "fp + tn")}, tp, fp, tn, fn) || ' |' AS line FROM c
 UNION ALL SELECT mode, '2 label by tier', label, '| ' || concat_ws(' | ', label, {", ".join(f"count(*) FILTER (tier = '{t}')" for t in metrics.TIERS)}) || ' |' FROM j GROUP BY mode, label
 UNION ALL SELECT mode, '3 categories', label || ':' || category, '| ' || concat_ws(' | ', label || ':' || category, count(*) FILTER (tier IN ('MEDIUM', 'HIGH', 'CRITICAL')), count(*) FILTER (tier IN ('HIGH', 'CRITICAL')), count(*)) || ' |' FROM j GROUP BY mode, label, category
 UNION ALL SELECT mode, '4 errors', id::VARCHAR, '**' || id || '** ' || CASE WHEN label = 'scam' THEN 'false negative (no warning): ' || CASE WHEN tier = 'INSUFFICIENT' THEN 'No analysis ran: stopped at the gate by too_short.' ELSE 'Fired: ' || CASE WHEN fired = '' THEN 'no rule' ELSE fired END || '; score ' || score || ' is ' || (30 - score) || ' below MEDIUM.' || said || ' Nothing asked for a secret or a payment, and nobody was imitated.' END
  ELSE 'false positive (' || tier || '): Fired: ' || CASE WHEN fired = '' THEN 'none' ELSE fired END || '; score ' || score || '. Harmless messages of this kind have these patterns too.' END FROM j WHERE (label = 'scam') <> (tier IN ('MEDIUM', 'HIGH', 'CRITICAL'))
 UNION ALL SELECT mode, section, '', line FROM (SELECT DISTINCT mode FROM j), (VALUES ('1 summary', '| mode | split | n | point | precision | recall | F1 | false positives | TP | FP | TN | FN |'), ('2 label by tier', '| label | {" | ".join(metrics.TIERS)} |'), ('3 categories', '| category | warned | interrupted | n |')) AS h(section, line)"""
)
def report_lines(spark, sf_dir):
    """A report on labelled documents, in two modes."""
    k = F.col("id")
    d = _records(spark, sf_dir).withColumn("mode", F.when(k % 2 == 0, "rules").otherwise("hybrid")).withColumn("score", F.when(F.col("tier") != "INSUFFICIENT", k % 100))
    fired = F.filter(F.array(F.when(k % 3 == 0, "SHORTENED_URL"), F.when(k % 2 == 0, "URGENCY")), lambda x: x.isNotNull())
    d = d.withColumns({"fired": fired, "quality_flags": F.array(F.lit("too_short")), "llm_type": F.when(k % 2 == 1, "phishing"), "llm_score": F.when(k % 2 == 1, k % 100)})
    return metrics.report(d)


@query(f"SELECT c.case_id, tier, count(e.event_id) AS events FROM {_CASES} c LEFT JOIN {_EVENTS} e ON e.case_id = c.case_id AND e.actor = 'user' WHERE tier = 'HIGH' AND c.case_id <> '1'' OR ''1'' = ''1' GROUP BY c.case_id, tier HAVING count(e.event_id) >= 1")
def asked_cases(spark, sf_dir):
    """SQL over the store's tables with bound values, one of which tries to be SQL."""
    views = {"audit_log": _cases(spark, sf_dir), "case_events": _events(spark, sf_dir)}
    sql = "SELECT c.case_id, tier, count(e.event_id) AS events FROM audit_log c LEFT JOIN case_events e ON e.case_id = c.case_id AND e.actor = ? WHERE tier = ? AND c.case_id <> ? GROUP BY c.case_id, tier HAVING count(e.event_id) >= ?"
    return casestore.ask(views, sql, "user", "HIGH", "1' OR '1' = '1", 1)


@query("SELECT o_orderdate::VARCHAR AS ts, o_orderkey AS cases_deleted FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_purges(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("cases_deleted"))
    return casestore.recent_purges(d).select(F.col("ts").cast("string").alias("ts"), "cases_deleted")


@query(f"SELECT doc_id, md5(regexp_replace('authorization: ' || source || ' ' || text, '{responses.SECRET}', '[REDACTED]', 'g')) AS event, source = 'logged' AS leaked FROM documents")
def redacted_logs(spark, sf_dir):
    """Whole documents as events of a log, behind a header that carries a secret: what is left of them, and that no field beside it gets into a line."""
    event = F.concat(F.lit("authorization: "), F.col("source"), F.lit(" "), F.col("text"))
    d = responses.log_lines(table(spark, sf_dir, "documents"), event)
    return d.select("doc_id", F.md5(responses.redacted(event)).alias("event"), (F.size(F.array_except(F.call_function("json_object_keys", F.col("log_line")), F.array(F.lit("level"), F.lit("logger"), F.lit("event")))) > 0).alias("leaked"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\p{So}\\x{10000}-\\x{10FFFF}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x{AD}\\x{180E}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g')) AS shown FROM documents")
def screen_texts(spark, sf_dir):
    """Documents with pictures, invisible characters and mathematical letters put in are shown as they were."""
    bold = "".join(chr(0x1D41A + i) for i in range(26))
    spoiled = F.replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", bold), F.lit(" "), F.lit(" ★​😀"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(responses.screen_text(spoiled)).alias("shown"))


@query(f"SELECT msg_id, {_TIER} AS tier, CASE WHEN score IS NULL THEN 'UNABLE_TO_ANALYZE' WHEN score >= 80 THEN 'BLOCK_LINKS' WHEN score >= 55 THEN 'INTERSTITIAL' WHEN score >= 30 THEN 'SOFT_WARN' ELSE 'ALLOW' END AS action, text AS said, names = 'OBFUSCATION' AS hides, '{responses.NAME}-{responses.VERSION}/{responses.RULESET}/rules-only' AS model_version FROM {_FINAL}")
def response_bodies(spark, sf_dir):
    """Bodies of responses, read again: tier, action, and the text out of its pieces."""
    d = responses.responses(analyse(templated(spark, sf_dir)))
    body = F.from_json("body", "struct<risk:struct<tier:string>,intervention:struct<action:string>,segments:array<struct<text:string,hidden_char:boolean>>,model_version:string>")
    d = d.select("msg_id", body.alias("b"))
    return d.select("msg_id", F.col("b.risk.tier").alias("tier"), F.col("b.intervention.action").alias("action"), F.array_join(F.transform("b.segments", lambda p: p["text"]), "").alias("said"), F.exists("b.segments", lambda p: F.coalesce(p["hidden_char"], F.lit(False))).alias("hides"), F.col("b.model_version").alias("model_version"))


# Of each brand: a letter of its name left out, a digit for a letter, words added to it, and its domain before another one. Names of fewer than six letters
# may not be one letter off, those without o, e, l or s have no digit, and gov.uk is a public suffix: these are hosts of nobody.
_IMITATED = f"(SELECT c_custkey, c_custkey // {len(_BRANDS)} % 4 AS kind, b.* FROM customer JOIN {_BRAND_SQL} ON ord = c_custkey % {len(_BRANDS)})"


@query(
    f"""SELECT c_custkey, host, display AS brand, CASE kind WHEN 0 THEN 'typosquat' WHEN 1 THEN 'leetspeak' WHEN 2 THEN 'brand-in-domain' ELSE 'subdomain-trick' END AS technique FROM (
 SELECT *, CASE kind WHEN 0 THEN left(key, length(key) - 2) || right(key, 1) || '.net' WHEN 1 THEN translate(key, 'oels', '0315') || '.net' WHEN 2 THEN key || '-secure.net' ELSE domain || '.c' || c_custkey || '.io' END AS host FROM {_IMITATED})
 WHERE length(key) >= 6 AND domain <> 'gov.uk' AND (kind <> 1 OR regexp_matches(key, '[oels]'))"""
)
def imitated_hosts(spark, sf_dir):
    """Four imitations of each brand's name and domain, over all customers."""
    k, kind = F.col("c_custkey"), (F.col("c_custkey") / len(_BRANDS)).cast("long") % 4
    d = _branded(spark, sf_dir).where("length(key) >= 6 and domain <> 'gov.uk'").where((kind != 1) | F.col("key").rlike("[oels]"))
    n = F.length("key")
    host = _by(kind, _text(F.left("key", n - 2), F.right("key", F.lit(1)), ".net"), _text(F.translate("key", "oels", "0315"), ".net"), _text(F.col("key"), "-secure.net"), _text(F.col("domain"), ".c", k, ".io"))
    d = d.select(k, host.alias("host"))
    return d.join(brands.lookalike_hosts(d), "host").select(k, "host", brands.brand_field(F.col("brand_ord"), "display").alias("brand"), "technique")


_BOXES = "(SELECT l_orderkey AS k, (l_partkey % 60)::DOUBLE AS y0, (l_partkey % 60 + 10 + l_suppkey % 20)::DOUBLE AS y1, (l_linenumber * 37 % 90)::DOUBLE AS x0, 'w' || l_linenumber || 'z' || l_suppkey || CASE WHEN l_partkey % 5 = 0 THEN '-' ELSE '' END AS t FROM lineitem)"


@query(
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y0, x0, y1, t) AS i FROM {_BOXES}),
 w(k, i, r, top, bottom) AS (SELECT k, i, 1, y0, y1 FROM b WHERE i = 1 UNION ALL SELECT k, i, CASE WHEN joins THEN r ELSE r + 1 END, CASE WHEN joins THEN top ELSE y0 END, CASE WHEN joins THEN bottom ELSE y1 END FROM (SELECT b.*, r, top, bottom, (b.y0 + b.y1) / 2 BETWEEN top AND bottom AS joins FROM w JOIN b ON b.k = w.k AND b.i = w.i + 1)),
 rows AS (SELECT k, r, string_agg(t, ' ' ORDER BY x0, t) AS text, min(y0) AS y0, max(y1) AS y1 FROM w JOIN b USING (k, i) GROUP BY k, r),
 s AS (SELECT k, r, text, CASE WHEN r = 1 THEN '' WHEN y0 - lag(y1) OVER o > 0.9::DOUBLE * median(y1 - y0) OVER (PARTITION BY k) THEN chr(10) WHEN lag(text) OVER o LIKE '%-' THEN '' ELSE ' ' END AS gap FROM rows WINDOW o AS (PARTITION BY k ORDER BY r))
 SELECT k AS l_orderkey, count(*)::INTEGER AS rows, string_agg(gap || text, '' ORDER BY r) AS text FROM s GROUP BY k"""
)
def layout_rows(spark, sf_dir):
    """Boxes of all places and heights, one for each line of an order: rows by lines of sight, paragraphs by gaps, cut words joined."""
    d, at = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 60
    text = _text("w", F.col("l_linenumber"), "z", F.col("l_suppkey"), F.when(F.col("l_partkey") % 5 == 0, "-").otherwise(""))
    left = (F.col("l_linenumber") * 37 % 90).cast("double")
    box = F.struct(text.alias("text"), F.lit(0.9).alias("confidence"), left.alias("x0"), at.cast("double").alias("y0"), (left + 30).alias("x1"), (at + 10 + F.col("l_suppkey") % 20).cast("double").alias("y1"))
    d = d.groupBy("l_orderkey").agg(F.collect_list(box).alias("lines"))  # a handful of lines each
    d = d.withColumn("r", layout.rows(F.col("lines").cast(f"array<{layout.LINE}>")))
    return d.select("l_orderkey", F.size("r").alias("rows"), layout.paragraphs(F.col("r")).alias("text"))
