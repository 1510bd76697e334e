"""Places in long texts, respacing, screens, display pieces and image headers against plain versions."""

import itertools
import json
import math
import random
import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from wardline.functions import lexicon as lx
from wardline.functions.spans import clauses, extended, located_long, message_clauses, running_totals, rx
from wardline.operators import casestore, evidence, ingest, layout, masking, metrics, respace, responses
from wardline.plans import texts
from wardline.plans.messages import analyse
from wardline.sources import readers

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_running_totals_and_places_in_long_texts(spark):
    rnd = random.Random(1)
    lists = [[], [5], [rnd.randint(0, 9) for _ in range(255)], [rnd.randint(0, 9) for _ in range(256)], [rnd.randint(0, 9) for _ in range(257)], [1] * 70_000]
    got = [r["t"] for r in rows(spark.createDataFrame([(v,) for v in lists], "v array<int>").select(running_totals(F.col("v")).alias("t")))]
    assert got == [list(itertools.accumulate(v)) for v in lists]
    made = ["", "a", "a. b! c", "x - y — z\n\n\nw", " . ", "one;  two\n", "😀. é! b", "the end. " * 40_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string")
    split = re.compile(r"(?<=[.!?;])\s+|\n+|\s+[-–—]\s+")
    for r in rows(frame.select("i", clauses(F.col("t"), rx(lx.CLAUSE_BREAK)).alias("c"), F.when(F.length("t") < 5000, message_clauses(F.col("t"), rx(lx.CLAUSE_BREAK))).alias("m"), located_long(F.col("t"), "[a-z]+").alias("w"))):
        t, pos, want = made[r["i"]], 0, []
        for m in split.finditer(t):
            want.append((pos, m.start()))
            pos = m.end()
        want.append((pos, len(t)))
        assert [(c["start"], c["end"]) for c in r["c"]] == [(a, b) for a, b in want if b > a]
        assert r["m"] is None or r["m"] == r["c"]
        assert all(t[c["start"] : c["end"]] == c["value"] for c in r["c"])
        assert [(w["start"], w["end"], w["value"]) for w in r["w"]] == [(*m.span(), m[0]) for m in re.finditer("[a-z]+", t)]


def test_cuts_are_the_cheapest_of_all():
    rnd = random.Random(2)
    costs = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))): rnd.uniform(1, 9) for _ in range(25)} | {"a": 2.5}
    speller = respace.Speller(costs)
    for _ in range(300):
        run = "".join(rnd.choice("abc") for _ in range(rnd.randint(4, 10)))
        best, way = math.inf, [run]
        for cuts in itertools.product((0, 1), repeat=len(run) - 1):
            parts, start = [], 0
            for i, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(run[start:i])
                    start = i
            if all(p in costs and (len(p) > 1 or p in "ai") for p in parts) and sum(costs[p] for p in parts) < best - 1e-9:
                best, way = sum(costs[p] for p in parts), parts
        got = speller.pieces(run)
        assert got == [run] if run in costs or best == math.inf else abs(sum(costs[p] for p in got) - best) < 1e-9 and "".join(got) == "".join(way)


def test_respacing(spark):
    words = "on your account we have been making limited apple the for you buy to".split()
    texts_ = spark.createDataFrame([(" ".join(words * 2),)], "t string")
    costs = respace.word_costs(texts_, "t")
    assert {r["word"] for r in rows(costs)} == set(words) and respace.word_costs(texts_, "t", most=3).count() == 3
    cases = {
        "onyouraccount": "on your account", "PayPal": "PayPal", "I'vebeenmaking": "I've been making", "tobuy5": "to buy 5", "5Apple": "5 Apple", "m365 1Z999": "m365 1Z999",
        "limited.We have": "limited. We have", "https://onyour.com/onyour foryou": "https://onyour.com/onyour for you", "you,to": "you, to", "xyonyour": "xyonyour", "": "", None: None, "onyour" * 3000: ("on your " * 3000).strip(),
    }
    d = respace.respace(spark.createDataFrame([(k, 1) for k in cases], "t string, costs int"), "t", costs)
    assert {r["t"]: r["respaced"] for r in rows(d)} == cases
    assert rows(respace.respace(d.select("t").limit(0), "t", costs.limit(0))) == []


def test_most_dropped_spaces_come_back(spark):
    total = texts.respaced_documents(spark, "/root/testdata/sf0.01").agg(F.sum("taken").alias("t"), F.sum("back").alias("b"), F.sum("elsewhere").alias("e")).first()
    assert total["b"] > 0.75 * total["t"] and total["e"] < 0.3 * total["t"]  # words of the documents are random syllables, which can be cut in many ways


def test_glued_interface_text(spark):
    cases = {"TextMessage·Today9:41AM": True, "to me": True, "readthis now": False, "deliveredx": False, "nowmeseen": True, "today12/3/2024": True, "9:41": True, "theanme": False, "·": False, "": False, None: None, "now" * 20: False}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", layout.is_glued_chrome(F.col("t")).alias("c"))
    got = {r["t"]: bool(r["c"]) for r in rows(d)}
    assert got == {k: bool(v) for k, v in cases.items()}


def plain_previews(texts_):
    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts_]
    n = 0
    while n < len(words) - 1:
        pool, hits = sum(words[n + 1 :], [])[: 2 * len(words[n]) + 4], 0
        for w in words[n][:-1]:
            if w in pool:
                pool.remove(w)
                hits += 1
        if len(words[n]) < 3 or hits < 0.8 * (len(words[n]) - 1):
            break
        n += 1
    return n


def test_previews(spark):
    rnd = random.Random(3)
    made = [[" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 7))) for _ in range(rnd.randint(0, 6))] for _ in range(400)]
    made += [["a b c", "a b c"], ["a a a x", "a b a c"], ["one two th", "One, two! three four"]]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(made)], "i int, v array<string>").select("i", layout.leading_previews(F.col("v")).alias("n"))
    got = {r["i"]: r["n"] for r in rows(d)}
    assert [got[i] for i in range(len(made))] == [plain_previews(v) for v in made] and len(set(got.values())) > 2


def test_screens_with_headers(spark):
    line = lambda t, y: {"text": t, "confidence": 0.9, "x0": 0.0, "y0": float(y), "x1": 50.0, "y1": float(y + 20)}
    made = [
        ([line("Chase", 0), line("Your account is on hold until you call us.", 40)], None, "Chase"),
        ([line("URGENT", 0), line("Your account is on hold until you call us.", 40)], None, None),
        ([line("+1 212 555 0123", 0), line("Mom", 30), line("Could you send me the money now?", 60)], "+1 212 555 0123", "Mom"),
    ]
    d = layout.extract_messages(spark.createDataFrame([(i, lines) for i, (lines, _, _) in enumerate(made)], f"i int, lines array<{layout.LINE}>"))
    assert {r["i"]: (r["sender_hint"], r["claimed_hint"]) for r in rows(d)} == {i: (s, c) for i, (_, s, c) in enumerate(made)}
    pasted = {"9:41 AM\n22000\nPay f20 at https.//x.org": ("Pay £20 at https://x.org", "22000"), "22000": ("22000", None), "": ("", None)}
    got = {r["t"]: (r["c"]["text"], r["c"]["sender_hint"]) for r in rows(spark.createDataFrame([(k,) for k in pasted], "t string").select("t", layout.clean_paragraphs(F.col("t")).alias("c")))}
    assert got == pasted


def test_hidden_characters_are_pieces_and_marked(spark):
    zero = "​"
    span = "array<struct<start:int,end:int,category:string,labels:array<string>>>"
    made = [
        (f"ab{zero}cd", [(0, 4, "link", ["x"])], [2], [("ab", "link", False), (zero, "link", True), ("c", "link", False), ("d", None, False)]),
        ("abcd", [(0, 2, "link", ["x"]), (2, 4, "link", ["x"])], [], [("abcd", "link", False)]),
        ("😀b", [(0, 1, "lure", ["x"])], [], [("😀", "lure", False), ("b", None, False)]),
        (zero + zero, [], [0, 1], [(zero, None, True), (zero, None, True)]),
        ("", [], [], []),
    ]
    d = spark.createDataFrame([(i, t, s, h) for i, (t, s, h, _) in enumerate(made)], f"i int, t string, s {span}, h array<int>")
    d = d.select("i", evidence.display_pieces(F.col("t"), F.col("s"), F.col("h")).alias("p"), evidence.highlighted(F.col("t"), F.col("s")).alias("html"))
    for r in rows(d):
        assert [(p["text"], p["category"], p["hidden"]) for p in r["p"]] == made[r["i"]][3]
        assert zero not in r["html"] and r["html"].count("hidden character") == made[r["i"]][0].count(zero)


def test_odd_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"\x08\x02\0\0\0" + b"\0" * 4
    endless = b"\xff\xd8" + b"\xff\xe0\0\2" * 5000 + b"\xff\xc0\0\x11\x08\0\5\0\6"
    cases = {"empty": (b"", "empty_image"), "null": (None, "empty_image"), "text": (b"hello there, no image", "not_an_image"), "png": (png, None), "cut png": (png[:12], "corrupt_image"), "cut jpeg": (b"\xff\xd8\xff", "corrupt_image"), "endless": (endless, "corrupt_image"), "riff": (b"RIFF\0\0\0\0WEBPVP8X", "corrupt_image"), "large": (png + b"\0" * 500, "image_too_large")}
    d = readers.judge_images(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "k string, content binary"), most_bytes=30_000)
    got = {r["k"]: r for r in rows(d)}
    assert {k: r["flag"] for k, r in got.items() if k != "large"} == {k: f for k, (_, f) in cases.items() if k != "large"}
    assert (got["png"]["width"], got["png"]["height"], got["png"]["shown_height"], got["png"]["orientation"]) == (7, 9, 9, None)
    large = readers.judge_images(spark.createDataFrame([(cases["large"][0],)], "content binary"), most_bytes=400).first()
    assert large["flag"] == "image_too_large" and large["width"] is None


# addresses and bare domains as they were written before they were made possessive
PLAIN_EMAIL = r"[A-Za-z0-9._%+-]+@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})"
PLAIN_DOMAIN = r"(?<![@\w.-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:" + lx.TLDS + r")(?![\w-])(?:/[^\s<>\"'()]*)?"


def test_possessive_patterns_match_as_plain_ones():
    rnd = random.Random(4)
    pieces = ["a", "b1", "-", ".", "@", "com", "co", "x" * 30, "org.", "1.2.", ".a.b.", "net", " ", "é", "/p", "_", "a@b.com", "io", "x" * 63, "a-"]
    url = lx.URL[lx.URL.index("|(?<![@") + 1 :]
    for _ in range(4000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14)))
        assert [m.group() for m in regex.finditer(lx.EMAIL, t)] == [m.group() for m in re.finditer(PLAIN_EMAIL, t)], t
        assert [(m.group(), m[1]) for m in regex.finditer(lx.MASK_EMAIL, t)] == [(m.group(), m[1]) for m in re.finditer(PLAIN_EMAIL, t)], t
        assert [m.span() for m in regex.finditer(url, t, regex.I)] == [m.span() for m in re.finditer(PLAIN_DOMAIN, t, re.I)], t


def plain_mask(text):
    """Masking by substitution after substitution."""
    t = "".join(c for c in text if c not in lx.ZERO_WIDTH + lx.BIDI)
    digits = lambda v: re.sub(r"\D", "", v)

    def luhn(v):
        d = [int(c) for c in digits(v)][::-1]
        return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0

    def iban(v):
        s = v.replace(" ", "").upper()
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    t = regex.sub(lx.MASK_USERINFO, r"\1[CREDENTIALS]@", t)
    t = regex.sub(lx.MASK_QUERY, r"\1?[QUERY]", t)
    t = re.sub(PLAIN_EMAIL, r"[EMAIL]@\1", t)
    t = re.sub(lx.MASK_IBAN, lambda m: "[IBAN]" if iban(m[0]) else m[0], t)
    t = re.sub(lx.MASK_CARD, lambda m: "[CARD]" if luhn(m[0]) else m[0], t)
    t = re.sub(lx.MASK_SSN_NEAR, r"\1[SSN]", re.sub(lx.MASK_SSN, "[SSN]", t))
    t = re.sub(lx.MASK_PHONE, lambda m: "[PHONE]" if 7 <= len(digits(m[0])) <= 15 else m[0], t)
    t = re.sub(lx.MASK_OTP_BEFORE, "[OTP]", re.sub(lx.MASK_OTP_AFTER, r"\1[OTP]", t))
    return re.sub(lx.MASK_OTP_ALONE, "[OTP]", t)


def test_masks_of_whole_documents_and_of_long_addresses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    made = [
        ("Your code is 482913. Don't share it.",), ("Call (415) 555-0132 today or +44 7700 900123 please",), ("card 4111​1111 1111 1111 now",), ("Balance $100.00 in 2026, tracking 1Z999AA10123456784",),
        ("IBAN GB82 WEST 1234 5698 7654 32 and GB00 WEST 1234 5698 7654 32",), ("ref 4111 1111 1111 1112",), ("social security no 123456789, PIN: 4821",), ("",),
    ]
    long = {"me@" + "a." * 200_000 + "com now": "[EMAIL]@" + "a." * 200_000 + "com now", "x@" + "1." * 200_000 + " end": "x@" + "1." * 200_000 + " end", "y" * 200_000 + " z@b.org": "y" * 200_000 + " [EMAIL]@b.org"}
    frame = docs.union(spark.createDataFrame(made + [(t,) for t in long], "text string"))
    got = masking.mask_text(frame, "text").select("text", "masked_text").collect()
    assert len(got) == 1011 and [r["masked_text"] for r in got] == [long.get(r["text"]) or plain_mask(r["text"]) for r in got]
    long = "see " + "a." * 2400 + "zz or " + "b." * 40 + "com for more"
    d = ingest.ingest(spark.createDataFrame([("1", long)], "msg_id string, text string")).first()
    assert d["status"] == "OK" and [u["raw"] for u in d["urls"]] == ["b." * 40 + "com"]


def test_variants_and_reports_on_odd_rows(spark):
    read = "variant string, id long, truth string, got string, tier string, text_tier string, ms double"
    made = [("a", 1, "one two two x.com", "two one", "LOW", None, 3.0), ("a", 2, None, None, None, None, 5.0), ("b", 3, "x.com", "x.com y.org", "HIGH", "MEDIUM", 1.0)]
    got = {r["variant"]: tuple(r)[1:] for r in metrics.variant_scores(spark.createDataFrame(made, read)).collect()}
    assert got == {"a": (2, 0.7, 1, 2, 1, 4.0), "b": (1, 1.0, 0, 1, 1, 1.0), "all": (3, 0.8, 1, 3, 2, 3.0)}
    records = "mode string, split string, label string, category string, tier string, id long, score long, fired array<string>, quality_flags array<string>, llm_type string, llm_score long"
    rows_ = [("rules", "dev", "scam", "c", None, 1, None, [], ["empty"], None, None), ("rules", "dev", "scam", "c", "LOW", 2, 7, ["THREAT"], [], "phishing", 90)]
    lines = [r["line"] for r in metrics.report(spark.createDataFrame(rows_, records)).orderBy("mode", "section", "place").collect()]
    assert lines[0].startswith("| mode |") and "| rules | all | 2 | interrupt | 0.000 | 0.000 | 0.000 | 0.000 | 0 | 0 | 0 | 2 |" in lines
    assert lines[-2:] == ["**1** false negative (no warning): No analysis ran: stopped at the gate by empty.", "**2** false negative (no warning): Fired: THREAT; score 7 is 23 below MEDIUM. The classifier said phishing (90). Nothing asked for a secret or a payment, and nobody was imitated."]
    assert metrics.report(spark.createDataFrame([], records)).count() == 0


def test_bound_values_are_never_read_as_sql(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y' OR '1' = '1"), (3, "?")], "id int, name string")
    ask = lambda v: [r["id"] for r in casestore.ask({"names_here": d}, "SELECT id FROM names_here WHERE name = ?", v).collect()]
    assert (ask("x"), ask("y' OR '1' = '1"), ask("?"), ask("x'; DROP VIEW names_here; --"), ask("x")) == ([1], [2], [3], [], [1])
    with pytest.raises(Exception, match="UNBOUND|parameter|PARAMETER"):
        casestore.ask({"names_here": d}, "SELECT id FROM names_here WHERE name = ?").collect()
    log = spark.createDataFrame([(f"2024-01-0{i}", i, i) for i in range(1, 8)], "ts string, cases_deleted int, events_deleted int")
    assert [r["cases_deleted"] for r in casestore.recent_purges(log).collect()] == [7, 6, 5, 4, 3]


def test_segments_of_a_row_equal_those_of_the_table(spark):
    rnd = random.Random(7)
    cats = list(lx.PRIORITY)
    made = []
    for m in range(60):
        for i in range(rnd.randint(0, 8)):
            a = rnd.randint(0, 20)
            made.append((m, a, a + rnd.randint(0, 9), rnd.choice(cats), f"L{rnd.randint(0, 3)}", i))
    d = spark.createDataFrame(made, "msg_id int, start int, end int, category string, label string, ord int")
    want = sorted((r["msg_id"], r["start"], r["end"], r["category"], tuple(r["labels"])) for r in evidence.overlay(d).collect())
    spans = d.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "category", "label", "ord"))).alias("s"))
    # pieces that the table joins are joined when they are shown
    got = []
    for r in spans.select("msg_id", responses.overlaid(F.col("s")).alias("o")).collect():
        out = []
        for p in r["o"]:
            if out and out[-1][2] == p["start"] and out[-1][3:] == (p["category"], tuple(p["labels"])):
                out[-1] = (*out[-1][:2], p["end"], *out[-1][3:])
            else:
                out.append((r["msg_id"], p["start"], p["end"], p["category"], tuple(p["labels"])))
        got += out
    assert sorted(got) == want


def test_responses_logs_and_screens(spark):
    d = spark.createDataFrame([("1", "reply with your password at http://10.20.30.40/x or it is closed"), ("2", "ok")], "msg_id string, text string")
    got = {r["msg_id"]: json.loads(r["body"]) for r in responses.responses(analyse(d)).collect()}
    assert set(got["1"]) >= {"risk", "evidence", "segments", "links", "intervention", "tiers"} and not {"risk", "evidence"} & set(got["2"])
    assert got["1"]["links"] == [{"raw": "http://10.20.30.40/x", "host": "10.20.30.40"}] and "".join(p["text"] for p in got["1"]["segments"]) == d.first()["text"]
    assert got["2"]["intervention"]["action"] == "UNABLE_TO_ANALYZE" and got["2"]["model_version"].endswith("/rules-only")
    bad = analyse(d).withColumns({"code": F.lit(413), "error": F.lit("body too large")})
    assert {(r["code"], r["body"]) for r in responses.responses(bad).collect()} == {(413, '{"error":"body too large"}')}

    logs = spark.createDataFrame([("c1", "HIGH", "my secret text", "x-api-key: abc sk-abcdefghij")], "case_id string, tier string, text string, event string")
    line = json.loads(responses.log_lines(logs, F.col("event")).first()["log_line"])
    assert line == {"level": "INFO", "logger": "wardline", "event": "[REDACTED] [REDACTED]", "case_id": "c1", "tier": "HIGH"}

    texts_ = {"a​b": "ab", "\U0001d400\U0001d7ce": "A0", "hi 😀★": "hi ", "": "", None: None}
    shown = spark.createDataFrame([(k,) for k in texts_], "t string").select("t", responses.screen_text(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in shown.collect()} == texts_

    cases = spark.createDataFrame([("g", "a", "LOW", "sms", None, None, "t", "p.png", None, None), ("g", "b", "LOW", "sms", None, None, "t", None, b"x", None), ("g", "c", "LOW", "sms", None, None, "t", None, None, True)], "group string, title string, expect string, channel string, sender string, claimed string, text string, image string, bytes binary, simulate boolean")
    info = responses.service_info(spark, cases).first()
    assert [(c["title"], c["image"]) for c in info["demo_cases"]] == [("a", "/demo/p.png")] and info["mode"] == "rules_only" and responses.service_info(spark, cases.limit(0)).first()["demo_cases"] == []


def test_entities_of_documents_and_turns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 5000").select(F.concat(F.lit("d"), "doc_id").alias("msg_id"), "text")
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("msg_id"), "text")
    made = [("m1", "pay $1,200.50 or 30 EUR to bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq or 0x52908400098527886E0F7030069857D2E4169EE7 soon"), ("m2", "mail a.b@c.org, see https://x.org/?q=a@b.org or call (415) 555-0132, 212-555-0199 or 555-0132 today"), ("m3", "write to info@shop.example.com or visit shop.example.com/a now please")]
    frame = docs.union(turns).union(spark.createDataFrame(made, "msg_id string, text string"))
    kinds = ("emails", "crypto", "phones", "amounts")
    seen = 0
    for r in ingest.ingest(frame).where("status = 'OK'").select("msg_id", "analysis_text", "urls", *kinds).collect():
        t = r["analysis_text"]
        spans = lambda p, flags=0: [m.span() for m in regex.finditer(p, t, flags)]  # noqa: B023, E731
        within = lambda s, others: any(a <= s[0] < b for a, b in others)
        links = [(u["start"], u["end"]) for u in r["urls"]]
        emails = spans(lx.EMAIL)
        trimmed = []
        for a, b in spans(lx.URL, regex.I):
            raw = t[a:b].rstrip(".,;:!?)'\"")
            if "." in re.sub(r"^(?:https?|hxxps?)://", "", raw, flags=re.I).split("/")[0].split("?")[0].split("#")[0]:
                trimmed.append((a, a + len(raw)))
        shut = trimmed + emails
        crypto = [s for s in spans(lx.CRYPTO) if not within(s, shut)]
        phones = [s for s in spans(lx.PHONE) if not within(s, shut + crypto) and 7 <= len(re.sub("[^0-9]", "", t[s[0] : s[1]])) <= 15]
        amounts = [s for s in spans(lx.AMOUNT, regex.I) if not within(s, shut)]
        for kind, want in zip(kinds, (emails, crypto, phones, amounts), strict=True):
            assert [(s["start"], s["end"]) for s in r[kind]] == want, (r["msg_id"], kind)
            seen += len(want)
        assert links == [s for s in trimmed if not within(s, emails)]
    assert seen > 30


def test_cutting_is_quick_beside_long_words_and_counts_gaps_as_columns_do(spark):
    rnd = random.Random(4)
    made = {"".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 5))): rnd.uniform(1, 9) for _ in range(60)}
    speller = respace.Speller(made | {"x" * 5000: 9.0, "abcdx": 9.0})
    run = "".join(rnd.choice(list(made)) for _ in range(20_000))
    began = time.perf_counter()
    got = speller.pieces(run)
    # looking back from every place as far as the longest word was not done after 25 s
    assert time.perf_counter() - began < 5 and "".join(got) == run and all(p in made for p in got)
    texts_ = ["a b  cd e", " ab", "ab ", "é 😀 x y", "", "a b c d e f"]
    put = ["ab  c d e", "a b", "ab", "é😀 xy ", "", "abc def"]
    d = spark.createDataFrame([(t, t.replace("a b", "ab"), p) for t, p in zip(texts_, put, strict=True)], "text string, glued string, respaced string")
    placed = [F.array_distinct(texts.gap_places(F.col(c))).alias(f"_{c}") for c in ("text", "glued", "respaced")]
    e = extended(d, "n", respace.GAPS, respace.gap_counts).select("n", *placed)
    taken, new = F.array_except("_text", "_glued"), F.array_except("_respaced", "_glued")
    for r in rows(e.select("n.*", F.size(taken).alias("t"), F.size(F.array_intersect(taken, new)).alias("b"), F.size(F.array_except(new, taken)).alias("e"))):
        assert (r["taken"], r["back"], r["elsewhere"]) == (r["t"], r["b"], r["e"])


def test_lines_of_a_body_are_no_previews_of_each_other(spark):
    line = lambda t, y: {"text": t, "confidence": 0.9, "x0": 0.0, "y0": float(y), "x1": 50.0, "y1": float(y + 20)}
    same = [line("22000", 0), line("The the the the thw Of x0z", 40), line("heed the ed be the a x1z", 62), line("the er the Of sh er x2z", 84)]
    subject = [line("22000", 0), line("Your parcel waits for you at the dep", 40), line("Your parcel waits for you at the depot today.", 100), line("Come soon.", 122)]
    twice = [line("22000", 0), line("Your parcel waits for you at", 40), line("the depot of our town in", 62), line("Your parcel waits for you at", 120), line("the depot of our town in the north.", 142)]
    short = [line("22000", 0), line("Your parcel waits th9", 20), line("Harbour Club", 40), line("Your parcel waits for you at x0z", 62), line("the depot x1z", 84)]
    made = [same, subject, twice, short]
    d = layout.extract_messages(spark.createDataFrame(list(enumerate(made)), f"i int, lines array<{layout.LINE}>"))
    got = {r["i"]: (len(r["dropped"]), r["text"]) for r in rows(d.select("i", "dropped", "text"))}
    assert got[0] == (0, "The the the the thw Of x0z heed the ed be the a x1z the er the Of sh er x2z")
    assert got[1] == (1, "Your parcel waits for you at the depot today. Come soon.")
    assert got[2] == (2, "Your parcel waits for you at the depot of our town in the north.")
    assert got[3] == (1, "Harbour Club Your parcel waits for you at x0z the depot x1z")


def test_one_file_is_dealt_over_tasks(spark):
    """Rows of one file that cost much to work on came in one task."""
    from wardline.plans import made, registry, texts

    for f in (made.entities, made.screenshots_and_trust, registry.layout_messages, registry.mask_documents, texts.display_pieces):
        assert f(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism, f.__name__


def test_pieces_of_many_spans_against_a_plain_sweep(spark):
    """Every bound looked at every span: 8,000 spans took 16,000 x 8,000 looks."""
    text, n = "abcdefghij" * 4000, 8000
    spans = [(5 * i, 5 * i + (0 if i % 7 == 0 else 3), "link" if i % 2 else "request", [str(i % 3)]) for i in range(n)]
    hidden = list(range(1, 40000, 997))
    d = spark.createDataFrame([(text, spans, hidden)], "t string, spans array<struct<start:int,end:int,category:string,labels:array<string>>>, hidden array<int>")
    began = time.time()
    got = [(p["text"], p["category"], p["labels"], p["hidden"]) for p in d.select(evidence.display_pieces(F.col("t"), F.col("spans"), F.col("hidden")).alias("p")).first()["p"]]
    assert time.time() - began < 60
    cover = [None] * len(text)
    for a, b, c, names in spans:
        cover[a:b] = [(c, tuple(names))] * (b - a)
    want = []
    for i, ch in enumerate(text):
        c, names = cover[i] or (None, ())
        now = (c, list(names), i in set(hidden[i // 997 : i // 997 + 1]))
        if want and not now[2] and not want[-1][3] and want[-1][1:3] == now[:2]:
            want[-1] = (want[-1][0] + ch, *want[-1][1:])
        else:
            want.append((ch, *now))
    assert got == want
