"""Looks at texts: places of matches from one pass, and classes that ASCII doesn't reach."""

import random

import regex
from pyspark.sql import functions as F

from wardline.functions import lexicon as lx
from wardline.functions.spans import located, located_any, message_clauses, rx
from wardline.operators import ingest, layout, rules
from wardline.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def odd_texts():
    rnd = random.Random(7)
    pieces = ["code", "CODE", " ", "$5", "$0", "\\", "\\1", ".", "; ", "\n", "\n\n", " - ", "é", "😀", "0x" + "0" * 40, "212-555-0199", "a@b.org", "x.com/a", "ſ", "K", "\0", "don't", "send", "paypal", "from", "́"]
    made = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    return [None, "", "\0", "\0\0", "code", "codecode", "a code", "code a", *made, *made[:5]]


def test_places_of_matches_in_odd_texts(spark):
    patterns = {"word": (r"code|send", True), "sign": (r"[$\\.]", False), "PHONE": (lx.PHONE, False), "EMAIL": (lx.EMAIL, False), "CRYPTO": (lx.CRYPTO, False), "AMOUNT": (lx.AMOUNT, True), "URL": (lx.URL, True), "GIVE": (lx.GIVE_VERB, True)}
    d = spark.createDataFrame(list(enumerate(odd_texts())), "i int, t string")
    found = {k: located(F.col("t"), rx(p, fold)) for k, (p, fold) in patterns.items()}
    two = [patterns["word"][0], lx.GIVE_VERB]
    got = rows(d.select("t", *[v.alias(k) for k, v in found.items()], located(F.col("t"), rx("code"), F.lit(None).cast("boolean")).alias("unsure"), located_any(F.col("t"), two).alias("any")))
    assert len(got) == 413
    spans = lambda p, fold, t: [(m.start(), m.end(), m.group()) for m in regex.finditer(p, t or "", regex.I * fold)]
    for r in got:
        plain = lambda name: [(s["start"], s["end"], s["value"]) for s in r[name]]  # noqa: B023, E731
        assert r["unsure"] == []
        for k, (p, fold) in patterns.items():
            assert plain(k) == spans(p, fold, r["t"]), (k, r["t"])
        assert plain("any") == sorted({s for p in two for s in spans(p, True, r["t"])}), r["t"]


def test_clauses_of_odd_texts(spark):
    breaks = rx(lx.CLAUSE_BREAK)
    for r in rows(spark.createDataFrame([(t,) for t in odd_texts()], "t string").select("t", message_clauses(F.col("t"), breaks).alias("c"))):
        if r["t"] is None:
            assert r["c"] is None
            continue
        ends = [(m.start(), m.end()) for m in regex.finditer(lx.CLAUSE_BREAK, r["t"])]
        parts = [(a, b) for (_, a), (b, _) in zip([(0, 0), *ends], [*ends, (len(r["t"]), 0)], strict=True)]
        assert [(c["start"], c["end"], c["value"]) for c in r["c"]] == [(a, b, r["t"][a:b]) for a, b in parts if b > a], r["t"]


def test_a_pattern_goes_over_a_text_once(spark):
    """A text that had a match was looked at, searched twice for values and once more for the gaps between them."""
    d = spark.createDataFrame([("a\0code",)], "t string")
    plan = d.select(located(F.col("t"), rx("zzcodezz")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 0 and plan.count("regexp_replace") == 1
    # texts with the sign that stands for matches are searched as before
    assert plan.count("regexp_extract_all") == 1 and plan.count("split(t") == 1
    parted = d.select(message_clauses(F.col("t"), rx("zzcodezz")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert parted.count("regexp_extract_all") == 1 and parted.count("regexp_replace") == 1


def test_control_signs_and_lookalike_letters(spark):
    signs = [*map(chr, [*range(1, 32), 127, 128, 0x85, 0xA0, 0xAD, 0x378, 0xE000, 0xFDD0, 0x1F600])]
    texts = [f"a plain text {c * 3} of ours" for c in signs]
    # three in 23 signs are too many, if they are controls or signs that stand for nothing
    many = {t: t[13] not in "\n\r\t" and regex.match(r"[\p{Cc}\p{Co}\p{Cn}]", t[13]) is not None for t in texts}
    got = {r["text"]: r["quality_flags"] == ["binary_input"] for r in rows(ingest.ingest(spark.createDataFrame([(t,) for t in texts], "text string")).select(F.expr("display_text").alias("shown"), "quality_flags", "original_length", "text"))}
    assert got == many
    links = [("see http://раypal.com now, my friend", True), ("see http://paypal.com/é now, my friend", False), ("see http://paypal.com now, my friend", False)]
    for r in rows(ingest.ingest(spark.createDataFrame(links, "text string, want boolean")).select("urls", "want")):
        assert [u["has_homoglyphs"] for u in r["urls"]] == [r["want"]]


def plain_is_chrome(text):
    """is_chrome() as it was written before its words were bound."""
    tokens = F.filter(F.transform(F.split(text, r"(?U)\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"(?U)[^\w:/.@+-]", ""), r"^[.-]+|[.-]+$", "")), lambda w: w != "")
    words = F.transform(F.filter(tokens, lambda t: ~t.rlike(layout.TIME)), lambda t: F.lower(t))
    timed = F.size(words) < F.size(tokens)
    only = (F.size(tokens) <= 8) & (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*layout.CHROME_WORDS))
    return F.regexp_replace(text, r"\s+", "").rlike(layout.CHROME) | layout.is_glued_chrome(text) | (F.size(tokens) == 0) | (only & (timed | F.exists(words, lambda w: w.isin(*layout.CHROME_MARKERS)))) | (timed & (F.size(words) <= 2) & F.forall(words, lambda w: F.length(w) <= 4))


def plain_is_garbage(text, confidence):
    good = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return (good < 2) | ((good / F.greatest(F.lit(1), F.length(F.replace(text, F.lit(" "), F.lit("")))) < 0.5) & (confidence < 0.6))


def plain_glued(before, after):
    last, first = F.regexp_extract(before, r"(\S*)$", 1), F.regexp_extract(after, r"^(\S*)", 1)
    cut = last.rlike(r"(?i)(https?://|hxxps?://|www\.)\S*$") & first.rlike(r"^[A-Za-z0-9./?=&%#_~:+-]+$")
    close = last.rlike(r"[-./_=?&%#:]$") | first.rlike(r"^[./_?=&#%-]") | layout.host_incomplete(last)
    hyphen = before.endswith("-") & ~before.endswith(" -")
    return F.when(before == "", after).when((cut & close) | (~cut & hyphen), F.concat(before, after)).otherwise(F.concat_ws(" ", before, after))


def test_lines_of_screens_are_judged_as_before(spark):
    rnd = random.Random(11)
    pieces = ["9:41", "AM", "today", "Message", "·", "...", "-", " ", " ", "  ", "\n", "\u2028", "\u0085", "\u00a0", "é", "😀", "www.a.co", "http://x.y/", "a-", ".b", "me", "Read", "10/12", "(1)", "_", "x", "\0", "?"]
    made = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 6))) for _ in range(1500)]
    d = spark.createDataFrame([(a, rnd.choice(made), rnd.choice([0.3, 0.9, None])) for a in [None, "", *made]], "a string, b string, c double")
    both = {
        "chrome": (layout.is_chrome(F.col("a")), plain_is_chrome(F.col("a"))),
        "garbage": (layout.is_garbage(F.col("a"), F.col("c")), plain_is_garbage(F.col("a"), F.col("c"))),
        "glued": (layout.glued(F.col("a"), F.col("b")), plain_glued(F.col("a"), F.col("b"))),
    }
    got = rows(d.select("a", "b", *[x.alias(f"{k}_{i}") for k, pair in both.items() for i, x in enumerate(pair)]))
    for k in both:
        assert [(r["a"], r["b"], r[f"{k}_0"]) for r in got if r[f"{k}_0"] != r[f"{k}_1"]] == [], k
    assert {r["chrome_0"] for r in got} == {True, False, None}


def test_words_of_a_line_are_taken_once(spark):
    """Each test of a line's words cut the line anew, and each row asked again where the body begins."""
    plan = registry.layout_messages(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{1,2}/") <= 3 and plan.count("[.!?]") == 1
    # heights are sorted once for previews and once for paragraphs
    assert plan.count("array_sort") <= 4
    empty = [None, [], [{"text": None, "confidence": None, "x0": None, "y0": None, "x1": None, "y1": None}]]
    got = rows(layout.extract_messages(spark.createDataFrame([(x,) for x in empty], f"lines array<{layout.LINE}>")).select("text", "sender_hint", "dropped"))
    assert got == [{"text": "", "sender_hint": None, "dropped": []}] * 3


def test_messages_without_hosts_travel_as_empty_arrays(spark):
    """Nulls made the writer of a batch pass again over all rows since the last message with a host."""
    made = [("a plain note for you and me", None, []), ("see http://paypa1.com/track and wait", None, ["paypa1.com"]), ("write to me@paypa1.com for that", "x@b.org", ["paypa1.com", "b.org"]), (None, None, []), ("", None, [])]
    d = rules.with_context(ingest.ingest(spark.createDataFrame(made, "text string, sender_id string, want array<string>")))
    got = rows(d.select("text", "__hosts", "__links", "__mails", "__imitates", "want"))
    assert len(got) == len(made)
    for r in got:
        assert r["__hosts"] == r["want"] and [h and h["technique"] for h in r["__imitates"]] == ["leetspeak" if h == "paypa1.com" else None for h in r["want"]]
        assert [x["host"] for x in [*r["__links"], *r["__mails"]]] == r["want"]
