"""From recognised text boxes to a message: rows, interface text, paragraphs and repairs, as folds over a row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.lexicon import TLDS
from wardline.functions.spans import bound

LINE = "struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>"
# Patterns and words of a phone's interface, of a sender's line, and repairs of misread signs.
CHROME = (
    r"(?i)^(today|yesterday|now|justnow|delivered|read|sent|seen|textmessage|imessage|sms|mms|rcs|(today|yesterday)?(at)?\d{1,2}[:.]\d{2}(am|pm)?|"
    r"(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?.{0,12}\d{1,2}[:.]\d{2}(am|pm)?|(read|delivered)(at)?\d{1,2}[:.]\d{2}(am|pm)?)$"
)
CHROME_WORDS = (
    "text message messages imessage sms mms rcs chat today yesterday now just delivered read sent seen edited am pm to me via end encrypted type a an "
    "at on from reply more details unknown sender contact info mon monday tue tues tuesday wed wednesday thu thur thurs thursday fri friday sat saturday "
    "sun sunday jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december"
).split()
CHROME_MARKERS = "message messages imessage sms mms rcs today yesterday now delivered read seen edited me".split()
TIME = r"(?i)^\d{1,2}[:.]\d{2}([ap]m)?$|^\d{1,2}/\d{1,2}(/\d{2,4})?$|^\d{1,2}([ap]m)$"
NAME_LINE = r"^[A-Za-z][A-Za-z&'.-]*( [A-Za-z&'.()-]+){0,3}$"
NO_NAMES = "urgent important alert notice warning reminder hi hello hey dear attention final".split()
#: Longest interface text without spaces, and longest part of one: an hour with am or pm, a date with a year.
GLUED_CHARS, PART_CHARS = 40, 10
SENDER_LINE = r"^(\+?[\d\s().-]{5,20}|[\w.+-]+@[\w-]+(\.[\w-]+)+|\d{5,6})$"
REPAIRS = (
    (r"(?<![A-Za-z])f(?=\d{1,3}(?:[,.]\d{3})*(?:\.\d{2})?\b)", "£"),
    (r"(?i)\b(https?)[.,;]?/{1,2}(?=[\w.-])", "$1://"),
    (r"(?i)\bwww[.,]{1,2}(?=\w)", "www."),
)


def rows(lines: Column) -> Column:
    """Boxes on one line of sight as one row: by top and left, a box joins the last row if its centre lies within the row's first
    box. A row has its boxes' texts from left to right, the least confidence and the hull."""
    ordered = F.array_sort(F.transform(lines, lambda l: F.struct(l["y0"].alias("y0"), l["x0"].alias("x0"), l["y1"].alias("y1"), l["x1"].alias("x1"), l["text"].alias("text"), l["confidence"].alias("confidence"))))
    box = "struct<y0:double,x0:double,y1:double,x1:double,text:string,confidence:double>"
    begin = F.array().cast(f"array<array<{box}>>")

    def step(acc: Column, l: Column) -> Column:
        last = F.element_at(acc, -1)
        centre = (l["y0"] + l["y1"]) / 2
        joins = F.when(F.size(acc) > 0, (last[0]["y0"] <= centre) & (centre <= last[0]["y1"])).otherwise(False)
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.array(l))))).otherwise(F.concat(acc, F.array(F.array(l))))

    grouped = F.aggregate(ordered, begin, step)

    def merged(r: Column) -> Column:
        by_left = F.array_sort(F.transform(r, lambda b: F.struct(b["x0"].alias("x0"), F.regexp_replace(b["text"], r"(?U)^\s+|\s+$", "").alias("t"))))
        text = F.array_join(F.filter(F.transform(by_left, lambda b: b["t"]), lambda t: t != ""), " ")
        pick = lambda name, f: f(F.transform(r, lambda b: b[name]))
        return F.struct(text.alias("text"), pick("confidence", F.array_min).alias("confidence"), pick("x0", F.array_min).alias("x0"), pick("y0", F.array_min).alias("y0"), pick("x1", F.array_max).alias("x1"), pick("y1", F.array_max).alias("y1"))

    return F.filter(F.transform(grouped, merged), lambda r: r["text"] != "")


def is_glued_chrome(text: Column) -> Column:
    """Interface words, times, dates and signs without anything between them ("TextMessage·Today9:41AM"), a strong word or a time among them.

    The text without its spaces is cut by dynamic programming: a place can be reached if a part of the closed vocabulary ends there that
    begins at a place that can be reached. Only short texts that hold a strong word or a time come that far."""
    low = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    part = lambda w: w.isin(*CHROME_WORDS) | w.rlike(r"^(?:\d{1,2}[:.]\d{2}(?:am|pm)?|\d{1,2}/\d{1,2}(?:/\d{2,4})?|[·•|,.:()-])$")

    def covered(s: Column) -> Column:
        ends_at = lambda ok, i: F.exists(F.sequence(F.lit(1), F.least(i, F.lit(PART_CHARS))), lambda n: F.get(ok, i - n) & part(F.substr(s, i - n + 1, n)))
        return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(s)), F.array(F.lit(True)), lambda ok, i: F.concat(ok, F.array(ends_at(ok, i)))), -1)

    may = lambda s: F.length(s).between(1, GLUED_CHARS) & s.rlike("|".join(CHROME_MARKERS) + r"|\d{1,2}[:.]\d{2}")
    return bound(low, lambda s: F.when(may(s), covered(s)).otherwise(False))


def is_chrome(text: Column) -> Column:
    """Interface text: a known label or time, words of the interface only with a strong one or a time (with spaces or without), or a clock with a glyph or two."""
    signs = F.regexp_extract_all(F.regexp_replace(text, r"(?U)[^\w:/.@+\s-]", ""), F.lit(r"(?U)\S+"), F.lit(0))
    tokens = F.filter(F.transform(signs, lambda w: F.btrim(w, F.lit(".-"))), lambda w: w != "")

    def judged(tokens: Column, words: Column) -> Column:
        timed = F.size(words) < F.size(tokens)
        only = (F.size(tokens) <= 8) & (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*CHROME_WORDS))
        return (F.size(tokens) == 0) | (only & (timed | F.exists(words, lambda w: w.isin(*CHROME_MARKERS)))) | (timed & (F.size(words) <= 2) & F.forall(words, lambda w: F.length(w) <= 4))

    of_tokens = bound(tokens, lambda ts: bound(F.transform(F.filter(ts, lambda t: ~t.rlike(TIME)), lambda t: F.lower(t)), lambda ws: judged(ts, ws)))
    return F.regexp_replace(text, r"\s+", "").rlike(CHROME) | is_glued_chrome(text) | of_tokens


def is_garbage(text: Column, confidence: Column) -> Column:
    good = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    two = text.rlike(r"(?s)[\p{L}\p{N}].*?[\p{L}\p{N}]")
    return ~two | ((confidence < 0.6) & (good / F.greatest(F.lit(1), F.length(F.replace(text, F.lit(" "), F.lit("")))) < 0.5))


def host_incomplete(token: Column) -> Column:
    rest = F.regexp_replace(token, r"(?i)^(https?://|hxxps?://)", "")
    host = F.regexp_replace(F.substring_index(rest, ":", 1), r"\.+$", "")
    return ~rest.rlike("[/?]") & ~host.rlike(rf"(?i)\.({TLDS})$")


def glued(before: Column, after: Column) -> Column:
    """Two lines of a paragraph: cut words and cut links are joined without a space, all else with one."""
    first = F.regexp_extract(after, r"^(\S*)", 1)
    hyphen = before.endswith("-") & ~before.endswith(" -")

    def joined(last: Column) -> Column:
        cut = last.rlike(r"(?i)(https?://|hxxps?://|www\.)\S*$") & first.rlike(r"^[A-Za-z0-9./?=&%#_~:+-]+$")
        close = last.rlike(r"[-./_=?&%#:]$") | first.rlike(r"^[./_?=&#%-]") | host_incomplete(last)
        return F.when((cut & close) | (hyphen & ~cut), F.concat(before, after)).otherwise(F.concat_ws(" ", before, after))

    return F.when(before == "", after).otherwise(bound(F.regexp_extract(before, r"(?<!\S)(\S*+)$", 1), joined))


def typical_height(found: Column) -> Column:
    """The median height of rows."""
    heights = F.array_sort(F.transform(found, lambda r: F.greatest(F.lit(1.0), r["y1"] - r["y0"])))
    middle = lambda hs, n: (F.get(hs, ((n - 1) / 2).cast("int")) + F.get(hs, (n / 2).cast("int"))) / 2
    return bound(heights, lambda hs: middle(hs, F.size(hs)))


def paragraphs(found: Column) -> Column:
    """Rows as text: a gap of more than 0.9 typical heights starts a new paragraph."""
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(None).cast("double").alias("bottom"))

    def step(acc: Column, r: Column, typical: Column) -> Column:
        breaks = (acc["now"] != "") & F.coalesce(r["y0"] - acc["bottom"] > 0.9 * typical, F.lit(False))
        return F.struct(F.when(breaks, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(breaks, r["text"]).otherwise(glued(acc["now"], r["text"])).alias("now"), r["y1"].alias("bottom"))

    ended = lambda acc: F.array_join(F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]), "\n")
    return bound(found, lambda rs: bound(typical_height(rs), lambda typical: F.aggregate(rs, begin, lambda acc, r: step(acc, r, typical), ended)))


def repaired(text: Column) -> Column:
    for pattern, put in REPAIRS:
        text = F.regexp_replace(text, pattern, put)
    return text


def preview_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def is_preview(words: Column, following: Column) -> Column:
    """Whether words (three or more) repeat the beginning of the words that follow: four fifths of them, each as often as it
    occurs in both, within twice as many words and four; the last, which may be cut off, aside."""
    asked = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    there = F.slice(following, F.lit(1), 2 * F.size(words) + 4)
    times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    hits = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))
    both = F.struct(asked.alias("a"), there.alias("b"))
    return (F.size(words) >= 3) & (5 * bound(both, lambda p: hits(p["a"], p["b"])) >= 4 * (F.size(words) - 1))


def leading_previews(texts: Column, beyond: Column | None = None) -> Column:
    """How many rows at the top only repeat what follows them, as subjects and previews do. The last row never does. beyond has for each row the
    first one that it may repeat; without it that is the next."""

    def count(both: Column) -> Column:
        words = both["words"]
        first = lambda i: i + 1 if beyond is None else F.get(both["beyond"], i)
        rest = lambda i: F.flatten(F.slice(words, first(i) + 1, F.greatest(F.size(words) - first(i), F.lit(0))))
        begin = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

        def step(acc: Column, i: Column) -> Column:
            more = F.when(acc["on"] & (i < F.size(words) - 1), is_preview(F.get(words, i), rest(i))).otherwise(False)
            return F.when(more, F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("on")))

        return F.aggregate(F.sequence(F.lit(0), F.size(words)), begin, step, lambda acc: acc["n"])

    fields = [F.transform(texts, preview_words).alias("words")] + ([] if beyond is None else [beyond.alias("beyond")])
    return bound(F.struct(*fields), count)


def repeatable(found: Column, headers: Column) -> Column:
    """For each row the first one that it may repeat as a preview: the next one for the headers at the top, else the first row of the next paragraph (if there
    is none, the number of rows). Lines of a paragraph share words with the lines after them, and are no previews of these."""

    def of(b: Column) -> Column:
        far = lambda j: F.get(b["rows"], j)["y0"] - F.get(b["rows"], j - 1)["y1"] > 0.9 * b["typical"]
        heads = lambda n: F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: (j < n) & far(j))
        return bound(heads(F.size(b["rows"])), lambda h: F.transform(b["rows"], lambda _, i: F.when(i < b["headers"], i + 1).otherwise(F.coalesce(F.get(F.filter(h, lambda j: j > i), F.lit(0)), F.size(b["rows"])))))

    return bound(F.struct(found.alias("rows"), typical_height(found).alias("typical"), headers.alias("headers")), of)


def clean_paragraphs(text: Column) -> Column:
    """Text that recognition has put together already: (text, sender_hint) without interface paragraphs, with a leading line of a sender lifted
    out and signs repaired."""
    kept = F.filter(F.split(text, "\n", -1), lambda p: (F.regexp_replace(p, r"(?U)\s+", "") != "") & ~is_chrome(p))
    trimmed = lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")

    def lifted(ps: Column) -> Column:
        first = F.get(ps, F.lit(0))
        sender = F.when((F.size(ps) > 1) & (F.length(first) <= 50) & trimmed(first).rlike(SENDER_LINE), trimmed(first))
        return F.struct(repaired(F.array_join(F.when(sender.isNotNull(), F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0)))).otherwise(ps), "\n")).alias("text"), sender.alias("sender_hint"))

    return bound(kept, lifted)


def extract_messages(images: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds rows, dropped (interface text, garbage and previews of the body), sender_hint (a number or address in the header), claimed_hint (a short
    title there, which stays in the text), text and mean_confidence.

    images has an array of LINE per row; null and empty arrays give an empty text.
    """
    none = F.array().cast(f"array<{LINE}>")
    d = images.withColumn("__rows", rows(F.coalesce(F.col(lines).cast(f"array<{LINE}>"), none)))
    junk = lambda r: is_chrome(r["text"]) | is_garbage(r["text"], r["confidence"])
    d = d.withColumn("__kept", F.filter("__rows", lambda r: ~junk(r))).withColumn("dropped", F.transform(F.filter("__rows", junk), lambda r: r["text"]))
    body = lambda r: (F.regexp_count(r["text"], F.lit(r"\s+")) >= 4) | r["text"].rlike(r"[.!?]\s*$")
    d, at = d.withColumn("__at", F.array_position(F.transform("__kept", body), True).cast("int")), F.col("__at")
    zone = F.greatest(F.when(at > 0, at - 1).otherwise(F.size("__kept")), F.lit(1)) + 2
    header = F.transform(F.slice("__kept", 1, zone), lambda r: F.when((F.length(r["text"]) <= 50) & r["text"].rlike(SENDER_LINE), r["text"]))
    d = d.withColumn("sender_hint", F.try_element_at(F.filter(header, lambda s: s.isNotNull()), F.lit(1)))
    first = F.array_position(F.transform("__kept", lambda r: r["text"]), F.col("sender_hint"))
    d = d.withColumn("__left", bound(first, lambda n: F.filter("__kept", lambda r, i: F.coalesce(i + 1 != n, F.lit(True)))))
    headers = F.greatest(F.when(at > 0, at - 1).otherwise(F.size("__kept")) - F.when(F.col("sender_hint").isNotNull(), 1).otherwise(0), F.lit(0))
    titles = F.slice("__left", F.lit(1), headers)
    named = F.filter(F.transform(titles, lambda r: r["text"]), lambda t: (F.length(t) <= 30) & t.rlike(NAME_LINE) & ~F.lower(t).isin(*NO_NAMES))
    d = d.withColumn("claimed_hint", F.when(F.size("__left") > 1, F.get(named, F.lit(0))))
    d = d.withColumn("__previews", leading_previews(F.transform("__left", lambda r: r["text"]), repeatable(F.col("__left"), headers)))
    d = d.withColumn("dropped", F.concat("dropped", F.transform(F.slice("__left", F.lit(1), F.col("__previews")), lambda r: r["text"])))
    left = F.slice("__left", F.col("__previews") + 1, F.size("__left"))
    mean = F.try_divide(F.aggregate(F.col(lines).cast(f"array<{LINE}>"), F.lit(0.0), lambda a, l: a + l["confidence"]), F.size(lines))
    return d.withColumn("text", repaired(paragraphs(left))).withColumn("mean_confidence", mean).withColumn("rows", F.transform("__rows", lambda r: r["text"])).drop("__rows", "__kept", "__at", "__left", "__previews")
