"""The 25 rules over ingested messages, as columns: hits with reasons, spans and snippets, and their sum.

Rules that only look for words ask one combined pattern first and locate its parts only where it matched. Rules that look at
clauses are nested higher-order functions over the clauses of the text. Nothing here moves rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import Config
from wardline.functions import lexicon as lx
from wardline.functions.spans import Words, answered, first_letters, has, has_any, located, located_any, message_clauses, no_spans, rx, settled, shifted, starts_in
from wardline.operators import brands as br

HIT = "struct<rule_id:string,name:string,category:string,weight:int,reason:string,spans:array<struct<start:int,end:int>>,snippets:array<string>>"
SPANS = "array<struct<start:int,end:int>>"


#: Patterns that are looked for in whole texts, and the words of a text that these looks ask first.
LOOKS = (
    *(p for patterns in lx.WORDS.values() for p in patterns), *lx.NEW_NUMBER, *lx.PROTECTIVE, *lx.CALL_CONTEXT, *lx.AUTHORITY, *br.MENTIONS,
    lx.FAMILY, lx.SECRET, lx.VERIFY_ACCOUNT, lx.ASK_CODE, lx.PAY_TERM, lx.PAY_VERB, lx.P2P_TERM, lx.P2P_VERB, lx.CALL_VERB,
)
_WORDS = "__words"


def _words() -> Words:
    return Words(F.col(_WORDS), LOOKS)


def negated_before(clause: Column, at: Column) -> Column:
    """Whether one of the five words before a place denies it; a comma or colon ends the reach."""
    near = F.regexp_extract(F.substr(clause, F.lit(1), at), r"([^,:]*)$", 1)
    words = F.filter(F.split(near, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), 5), " ").rlike(rx(lx.NEGATION))


def _secret_terms(clause: Column) -> Column:
    """Terms for secrets in a clause; a code counts unless its neighbours make it a promo code, a code of conduct and the like."""

    def secret(t: Column) -> Column:
        before = F.regexp_extract(F.substr(clause, F.lit(1), t["start"]), r"(?U)(\S+)\s*$", 1)
        plain = F.lower(F.regexp_replace(before, r"(?U)\W", "")).isin(*lx.PLAIN_CODE_BEFORE) | F.substr(clause, t["end"] + 1, F.lit(40)).rlike(rx(lx.PLAIN_CODE_AFTER))
        return ~F.lower(t["value"]).rlike("^codes?$") | ~plain

    return F.filter(located(clause, rx(lx.SECRET)), secret)


def secret_spans(text: Column, bad_link: Column, words: Words | None = None) -> Column:
    """Spans of terms for secrets and of verbs with them, by kind: asks, protects or none of these."""

    def judged(c: Column) -> Column:
        clause = c["value"]

        def of_term(t: Column) -> Column:
            before = F.substr(clause, F.lit(1), t["start"])
            reach = lambda p: F.filter(located(before, rx(p)), lambda v: t["start"] - v["end"] <= 60)
            verbs = F.concat(reach(lx.GIVE_VERB), F.when(bad_link & has(before, lx.YOUR_BEFORE), reach(lx.ENTER_VERB)).otherwise(no_spans()))
            negated = F.exists(verbs, lambda v: negated_before(clause, v["start"]))
            denied = has(before, lx.NEGATION) & has(clause, lx.PROTECTIVE_VERB)
            asks = (F.size(verbs) > 0) & ~negated
            start = F.when(asks, F.element_at(verbs, -1)["start"]).otherwise(t["start"])
            kind = F.when(asks, "asks").when(((F.size(verbs) > 0) & negated) | denied, "protects")
            return F.struct((c["start"] + start).alias("start"), (c["start"] + t["end"]).alias("end"), kind.alias("kind"))

        terms = _secret_terms(clause)
        ready = F.filter(located(clause, rx(lx.HAVE_READY)), lambda m: F.exists(terms, lambda t: (m["start"] <= t["start"]) & (t["start"] < m["end"])) & ~negated_before(clause, m["start"]))
        verify = F.filter(located(clause, rx(lx.VERIFY_ACCOUNT)), lambda m: bad_link & ~negated_before(clause, m["start"]))
        whole = F.transform(F.concat(ready, verify), lambda m: F.struct((c["start"] + m["start"]).alias("start"), (c["start"] + m["end"]).alias("end"), F.lit("asks").alias("kind")))
        return F.concat(F.transform(terms, of_term), whole)

    relevant = has_any(text, [lx.SECRET, lx.VERIFY_ACCOUNT], words)
    return F.when(relevant, F.flatten(F.transform(message_clauses(text, rx(lx.CLAUSE_BREAK)), judged))).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def credential_spans(text: Column, found: Column, words: Words | None = None) -> tuple[Column, Column]:
    """(spans that ask for a secret, spans that protect one), given secret_spans()."""
    of = lambda kind: F.transform(F.filter(found, lambda s: s["kind"] == kind), _bare)
    asked = F.array_sort(F.array_distinct(F.concat(of("asks"), F.transform(located(text, rx(lx.ASK_CODE)), _bare))))
    none = F.array().cast(SPANS)
    return F.when((F.size(found) > 0) | has(text, lx.ASK_CODE, words), asked).otherwise(none), F.when(F.size(found) > 0, F.array_sort(F.array_distinct(of("protects")))).otherwise(none)


def _bare(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"))


def bare(spans: Column) -> Column:
    return F.transform(spans, _bare)


def clause_pair_spans(text: Column, term: str, verb: str, words: Words | None = None) -> Column:
    """Terms and the first verb that isn't denied, of each clause that has both."""

    def pair(c: Column) -> Column:
        terms, verbs = located(c["value"], rx(term)), F.filter(located(c["value"], rx(verb)), lambda v: ~negated_before(c["value"], v["start"]))
        return F.when((F.size(terms) > 0) & (F.size(verbs) > 0), shifted(F.concat(terms, F.slice(verbs, 1, 1)), c["start"])).otherwise(no_spans())

    pairs = F.array_sort(F.array_distinct(bare(F.flatten(F.transform(message_clauses(text, rx(lx.CLAUSE_BREAK)), pair)))))
    return F.when(has(text, term, words) & has(text, verb, words), pairs).otherwise(F.array().cast(SPANS))


def with_context(signals: DataFrame) -> DataFrame:
    """Columns that several rules need: claimed brand, sender's domain and digits, and judged links."""
    sender = F.col("sender_id")
    d = settled(signals.withColumn(_WORDS, first_letters(F.col("analysis_text"), LOOKS)))
    d = d.withColumn("sender_domain", F.when(F.instr(sender, "@") > 0, F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(sender, "@", -1), r"(?U)^\s+|\s+$", ""), "^>+|>+$", ""))))
    d = d.withColumn("sender_digits", F.when(sender.isNull() | (F.instr(sender, "@") > 0), "").otherwise(F.regexp_replace(sender, "[^0-9]", "")))
    d = d.withColumn("__claims", F.filter(br.claims(F.col("analysis_text"), _words()), lambda c: ~starts_in(c, F.col("urls")) & ~starts_in(c, F.col("emails"))))
    d = d.withColumn("__meta", br.brand_of_sender(F.col("claimed_sender"))).withColumn("claimed_brand", F.coalesce("__meta", F.try_element_at("__claims", F.lit(1))["brand"]))
    d = d.withColumn("brand_spans", bare(F.filter("__claims", lambda c: c["brand"] == F.col("claimed_brand"))))
    own = F.when(F.col("sender_domain").isNotNull(), F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.col("sender_domain").alias("host")))).otherwise(F.array().cast("array<struct<start:int,end:int,host:string>>"))
    mails = F.transform("emails", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lower(F.substring_index(e["value"], "@", -1)).alias("host")))
    d = d.withColumn("__own", own).withColumn("__mailed", F.concat(mails, F.col("__own")))
    hosts = F.concat(F.transform("urls", lambda u: u["host"]), F.transform("__mailed", lambda m: m["host"]))
    # empty arrays, not nulls: after each row Arrow's writer passes again over all nulls since the last array of a batch
    d = answered(d.withColumn("__hosts", hosts), "__imitates", br.IMITATIONS, "__hosts", br.imitations)
    spoof = lambda u: (u["has_homoglyphs"] | u["is_punycode"]) & u["official"].isNotNull()
    link_pairs = F.arrays_zip(F.col("urls").alias("u"), F.slice("__imitates", 1, F.size("urls")).alias("i"))
    mail_pairs = F.arrays_zip(F.col("__mailed").alias("m"), F.slice("__imitates", F.size("urls") + 1, F.size("__mailed")).alias("i"))
    links = F.transform(F.when(F.size("urls") > 0, link_pairs), lambda x: F.struct(x["u"]["start"].alias("start"), x["u"]["end"].alias("end"), x["u"]["host"].alias("host"), x["u"]["registrable"].alias("registrable"), x["u"]["official"].alias("official"), spoof(x["u"]).alias("spoofed"), (x["u"]["has_homoglyphs"] | x["u"]["is_punycode"]).alias("odd"), x["i"].alias("imitates"), (F.array_contains("quality_flags", "from_image") & ~spoof(x["u"]) & F.coalesce(x["i"]["one_off"], F.lit(False))).alias("ocr_typo")))
    mails = F.transform(F.when(F.size("__mailed") > 0, mail_pairs), lambda x: F.struct(x["m"]["start"].alias("start"), x["m"]["end"].alias("end"), x["m"]["host"].alias("host"), x["i"].alias("imitates")))
    imitated = "struct<brand_ord:int,technique:string,one_off:boolean>"
    d = d.withColumn("__links", F.coalesce(links, F.array().cast(f"array<struct<start:int,end:int,host:string,registrable:string,official:int,spoofed:boolean,odd:boolean,imitates:{imitated},ocr_typo:boolean>>")))
    d = d.withColumn("__mails", F.coalesce(mails, F.array().cast(f"array<struct<start:int,end:int,host:string,imitates:{imitated}>>")))
    d = d.withColumn("ocr_typos", F.filter("__links", lambda u: u["ocr_typo"]))
    d = d.withColumn("bad_link", F.exists("urls", lambda u: u["is_ip_literal"] | u["has_homoglyphs"] | u["is_punycode"] | u["official"].isNull()))
    d = settled(d.withColumn("__secrets", secret_spans(F.col("analysis_text"), F.col("bad_link"), _words())))
    asks, protects = credential_spans(F.col("analysis_text"), F.col("__secrets"), _words())
    d = d.withColumns({"asks_spans": asks, "protects_spans": protects}).drop("__secrets")
    return settled(d).withColumns({"__look": _lookalikes(), "__away": _mismatches()})


_SAYS = "array<struct<start:int,end:int,says:string>>"


def _lookalikes() -> Column:
    """(start, end, says) of every host that imitates a brand, or with digits for letters the claimed organisation."""
    named = lambda u, i: F.concat(F.lit("'"), u["host"], F.lit("' imitates "), br.brand_field(i["brand_ord"], "display"), F.lit(" ("), i["technique"], F.lit(")"))
    spelled = lambda u: F.concat(F.lit("'"), u["host"], F.lit("' spells "), br.brand_field(u["official"], "display"), F.lit(" with look-alike letters"))
    item = lambda u, says: F.struct(u["start"].alias("start"), u["end"].alias("end"), says.alias("says"))
    links = F.transform("__links", lambda u: item(u, F.when(u["spoofed"], spelled(u)).when(~u["ocr_typo"], named(u, u["imitates"]))))
    mails = F.transform("__mails", lambda m: item(m, named(m, m["imitates"])))
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce("claimed_sender", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(*lx.ORG_STOPWORDS))
    hosts = F.concat(F.transform("__links", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), u["host"].alias("host"))), F.col("__own"))
    raw = lambda u: F.regexp_replace(F.substring_index(br.registrable_domain(u["host"]), ".", 1), "[^a-z0-9]", "")
    swapped = lambda u: (br.deleet(raw(u)) != raw(u)) & F.exists(tokens, lambda t: F.contains(br.deleet(raw(u)), t) & ~F.contains(raw(u), t))
    orgs = F.transform(hosts, lambda u: item(u, F.when(swapped(u), F.concat(F.lit("'"), u["host"], F.lit("' has digits for letters of '"), F.col("claimed_sender"), F.lit("'")))))
    found = F.filter(F.concat(links, mails, orgs), lambda x: x["says"].isNotNull())
    # no hosts, nothing to say
    return F.when((F.size("__links") > 0) | (F.size("__mails") > 0), found).otherwise(F.array().cast(_SAYS))


def _mismatches() -> Column:
    brand, dom = F.col("claimed_brand"), F.col("sender_domain")
    name, kind = br.brand_field(brand, "display"), br.brand_field(brand, "kind")
    away = lambda u: ~(u["ocr_typo"] & (u["imitates"]["brand_ord"] == brand)) & (u["odd"] | (~br.owns(brand, u["registrable"]) & u["official"].isNull()))
    item = lambda s, e, says: F.struct(s.alias("start"), e.alias("end"), says.alias("says"))
    none = F.lit(-1)
    claimed = F.concat_ws(" ", F.coalesce("claimed_sender", F.lit("")), F.left("analysis_text", F.lit(200)))
    links = F.when(brand.isNotNull(), F.transform(F.filter("__links", away), lambda u: item(u["start"], u["end"], F.concat(F.lit("claims to be "), name, F.lit(" but links to "), u["host"])))).otherwise(F.array().cast(_SAYS))
    single = F.array(
        F.when(brand.isNotNull() & dom.isNotNull() & ~br.owns(brand, br.registrable_domain(dom)), item(none, none, F.concat(F.lit("claims to be "), name, F.lit(" but writes from @"), dom))),
        F.when(brand.isNotNull() & (F.length("sender_digits") >= 10) & kind.isin("bank", "government", "delivery", "payments"), item(none, none, F.concat(name, F.lit(" writes from a personal-looking number")))),
        F.when(dom.isNotNull() & br.registrable_domain(dom).isin(*lx.FREEMAIL) & has(claimed, lx.EXECUTIVE), item(none, none, F.concat(F.lit("an executive writes from free mail @"), dom))),
    )
    # nobody is claimed or written from, nothing to say
    return F.when(brand.isNotNull() | dom.isNotNull(), F.concat(F.filter(single, lambda x: x.isNotNull()), links)).otherwise(F.array().cast(_SAYS))


def _said(items: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(items, lambda x: x["says"])), "; ")


def _placed(items: Column) -> Column:
    return bare(F.filter(items, lambda x: x["start"] >= 0))


def _obfuscation_spans() -> Column:
    text, hidden = F.col("analysis_text"), F.transform("hidden_positions", lambda h, k: h - k)
    words = lambda p: located(text, rx(p))
    split = F.when(F.col("in_word_zero_width") > 0, F.filter(words(r"[\p{L}\p{N}]+"), lambda w: F.exists(hidden, lambda i: (w["start"] <= i) & (i <= w["end"])))).otherwise(no_spans())
    folded = F.transform("mixed_script_words", lambda w: F.translate(w, lx.LOOKALIKE_FROM, lx.LOOKALIKE_TO))
    mixed = F.when(F.size("mixed_script_words") > 0, F.filter(words(r"\p{L}+"), lambda w: F.array_contains(folded, w["value"]))).otherwise(no_spans())
    return F.concat(bare(split), bare(mixed), bare(F.filter("urls", lambda u: u["is_punycode"])))


#: Reasons of the rules that need no details.
REASONS = {
    "URGENCY": "Presses you to act fast", "THREAT": "Threatens loss, penalties or legal action", "TOO_GOOD_TO_BE_TRUE": "Offers what is too good to be true",
    "OFF_PLATFORM": "Wants to move to another messenger", "SECRECY": "Asks for secrecy or against checking", "PROMPT_INJECTION": "Holds instructions for an automatic filter",
    "REMOTE_ACCESS": "Follows the pattern of false technical support", "PAYMENT_REDIRECTION": "Says that payment details have changed", "UPFRONT_FEE": "Asks for a fee in advance",
}


def _detectors() -> dict[str, Callable[[], tuple[Column | None, Column, Column]]]:
    """Rule name -> (fired, reason, spans); a rule without fired fires where it has spans. A deployment may put further entries in DETECTORS."""
    text, seen = F.col("analysis_text"), _words()
    none = F.array().cast(SPANS)

    def words(name: str):
        return lambda: (has_any(text, lx.WORDS[name], seen), F.lit(REASONS[name]), bare(located_any(text, lx.WORDS[name], seen)))

    def listed(spans: Column, reason: str | Column):
        return None, F.lit(reason) if isinstance(reason, str) else reason, spans

    def payment():
        pairs = clause_pair_spans(text, lx.PAY_TERM, lx.PAY_VERB, seen)
        coins = F.array_sort(F.array_distinct(F.concat(pairs, bare(F.col("crypto")))))
        return listed(F.when((F.size("crypto") > 0) & has(text, lx.PAY_VERB, seen), coins).otherwise(pairs), "Asks for payment by gift card, crypto-currency or transfer")

    def new_number():
        found = located_any(text, lx.NEW_NUMBER, seen)
        family = F.slice(located(text, rx(lx.FAMILY), seen.may_have([lx.FAMILY])), 1, 1)
        fired = has_any(text, lx.NEW_NUMBER, seen) & ((F.col("channel") != "email") | has(text, lx.FAMILY, seen))
        return fired, F.lit("Says to be family or a friend on a new number"), bare(F.concat(found, family))

    def obfuscation():
        parts = F.array(
            F.when(F.col("in_word_zero_width") > 0, F.concat(F.col("in_word_zero_width").cast("string"), F.lit(" invisible characters inside words"))),
            F.when(F.col("bidi_controls") > 0, "controls that turn the direction of writing"),
            F.when(F.size("mixed_script_words") > 0, F.concat(F.lit("words of mixed scripts: "), F.array_join(F.slice("mixed_script_words", 1, 3), ", "))),
            F.when(F.col("compat_chars") >= 3, F.concat(F.col("compat_chars").cast("string"), F.lit(" stylised letters"))),
            F.when(F.exists("urls", lambda u: u["is_punycode"]), "an internationalised domain"),
        )
        said = F.filter(parts, lambda p: p.isNotNull())
        return F.size(said) > 0, F.concat(F.lit("Obfuscation: "), F.array_join(said, "; ")), _obfuscation_spans()

    def authority(placed: bool = True):
        generic = located_any(text, lx.AUTHORITY, seen) if placed else no_spans()
        claimed = F.coalesce("claimed_sender", F.lit(""))
        org = (claimed != "") & (has(claimed, lx.ORG_WORD) | has(claimed, lx.EXECUTIVE) | F.col("__meta").isNotNull())
        who = F.filter(F.array(br.brand_field(F.col("claimed_brand"), "display"), F.when(org, F.concat(F.lit("'"), claimed, F.lit("'")))), lambda w: w.isNotNull())
        label = F.when(F.size(who) > 0, F.array_join(F.array_distinct(who), ", ")).otherwise("an authority")
        return has_any(text, lx.AUTHORITY, seen) | (F.size("brand_spans") > 0) | (F.size(who) > 0), F.concat(F.lit("Claims to be "), label, F.lit("; this is not verified")), F.concat(F.col("brand_spans"), bare(generic))

    def callback():
        def in_clause(c: Column) -> Column:
            verb = F.slice(located(c["value"], rx(lx.CALL_VERB)), 1, 1)
            phone = F.slice(F.filter("phones", lambda p: (c["start"] <= p["start"]) & (p["start"] < c["end"])), 1, 1)
            fires = (F.size(verb) > 0) & ((F.size(phone) > 0) | F.exists(verb, lambda v: F.contains(F.lower(v["value"]), F.lit("press"))))
            return F.when(fires, F.concat(shifted(verb, c["start"]), phone)).otherwise(no_spans())

        pressed = has_any(text, lx.WORDS["URGENCY"] + lx.WORDS["THREAT"] + lx.CALL_CONTEXT, seen)
        spans = F.when(has(text, lx.CALL_VERB, seen) & authority(False)[0] & pressed, bare(F.flatten(F.transform(message_clauses(text, rx(lx.CLAUSE_BREAK)), in_clause)))).otherwise(none)
        return listed(spans, "Wants you to call a number from the message")

    def lookalike():
        items = F.col("__look")
        return F.size(items) > 0, F.concat(F.lit("Lookalike domain: "), _said(items)), _placed(items)

    def mismatch():
        items = F.col("__away")
        return F.size(items) > 0, F.concat(F.lit("Sender mismatch: "), _said(items)), F.concat(F.slice("brand_spans", 1, 1), _placed(items))

    def links(pick, reason):
        return lambda: listed(bare(F.filter("urls", pick)), reason)

    def official():
        names = F.array_join(F.array_sort(F.array_distinct(F.transform("urls", lambda u: br.brand_field(u["official"], "display")))), ", ")
        return (F.size("urls") > 0) & ~F.col("bad_link"), F.concat(F.lit("All links go to "), names), bare(F.col("urls"))

    cautious = F.array_sort(F.array_distinct(F.concat(F.col("protects_spans"), bare(located_any(text, lx.PROTECTIVE)))))
    protective = F.when((F.size("protects_spans") > 0) | has_any(text, lx.PROTECTIVE, seen), cautious).otherwise(none)
    return {
        "URGENCY": words("URGENCY"),
        "THREAT": words("THREAT"),
        "CREDENTIAL_REQUEST": lambda: listed(F.col("asks_spans"), "Asks for a code, password, PIN or card details"),
        "PAYMENT_METHOD": payment,
        "P2P_TRANSFER_REQUEST": lambda: listed(clause_pair_spans(text, lx.P2P_TERM, lx.P2P_VERB, seen), "Asks for money over a payment app"),
        "LOOKALIKE_DOMAIN": lookalike,
        "SENDER_MISMATCH": mismatch,
        "SHORTENED_URL": links(lambda u: u["is_shortener"], "A shortened link hides where it goes"),
        "IP_LITERAL_URL": links(lambda u: u["is_ip_literal"], "A link goes to a bare address"),
        "NEW_NUMBER_FAMILY": new_number,
        "TOO_GOOD_TO_BE_TRUE": words("TOO_GOOD_TO_BE_TRUE"),
        "OFF_PLATFORM": words("OFF_PLATFORM"),
        "SECRECY": words("SECRECY"),
        "OBFUSCATION": obfuscation,
        "PROMPT_INJECTION": words("PROMPT_INJECTION"),
        "REMOTE_ACCESS": words("REMOTE_ACCESS"),
        "PAYMENT_REDIRECTION": words("PAYMENT_REDIRECTION"),
        "UPFRONT_FEE": words("UPFRONT_FEE"),
        "CALLBACK_LURE": callback,
        "AUTHORITY_CLAIM": authority,
        "POSSIBLE_LOOKALIKE_OCR": lambda: listed(bare(F.col("ocr_typos")), "A link from a screenshot is one letter off an official domain"),
        "PROTECTIVE_LANGUAGE": lambda: listed(protective, "Words of caution as real senders use them"),
        "OFFICIAL_LINKS_ONLY": official,
        "KNOWN_CONTACT": lambda: (F.col("known_contact"), F.lit("You know this sender"), none),
        "TRUSTED_SENDER": lambda: (F.coalesce("trusted_sender", F.lit(False)), F.lit("You trust this sender"), none),
    }


#: Detectors that a deployment adds: name -> a function that gives (fired, reason, spans).
DETECTORS: dict[str, Callable[[], tuple[Column | None, Column, Column]]] = {}


def evaluate(signals: DataFrame, config: Config | None = None) -> DataFrame:
    """Adds hits (in order of weight), fired (rule names), rule_raw, rule_score, critical_combo and combo_reason.

    Whether a rule fires is a column of its own, and names and sums come from these. Spans, snippets and reasons are made for rows
    that fired, in hits only, and not at all where nobody reads hits.
    """
    config = config or Config()
    text, ok = F.col("analysis_text"), F.col("status") == "OK"
    specs = {name: (ident, category) for ident, name, category in lx.RULES}
    found = {name: detect() for name, detect in (_detectors() | DETECTORS).items()}
    # rules without a test of their own fire where they have spans
    listed = {f"__s_{name}": F.when(ok, spans.cast(SPANS)) for name, (fired, _, spans) in found.items() if fired is None}
    d = settled(settled(with_context(signals)).withColumns(listed))
    tests = {f"__f_{name}": F.coalesce(ok & (F.size(F.col(f"__s_{name}")) > 0 if fired is None else fired), F.lit(False)) for name, (fired, _, _) in found.items()}
    d = settled(d.withColumns(tests))
    # an attacker can write these rules' words: they don't count beside anything suspicious
    suspicious = [F.col(f"__f_{n}") for n in found if specs.get(n, (n, "lure"))[1] in ("request", "obfuscation", "link") or n in lx.IMPERSONATIONS]
    clear = ~functools.reduce(Column.__or__, suspicious)
    counts = {n: F.col(f"__f_{n}") & clear if n in lx.SELF_WRITTEN else F.col(f"__f_{n}") for n in found}
    weights = {n: config.weights.get(n, 0) for n in found}
    # penalties first, the heaviest first
    order = sorted(found, key=lambda n: (weights[n] < 0, -abs(weights[n]), specs.get(n, (n,))[0]))
    d = d.withColumn("fired", F.array_compact(F.array(*[F.when(counts[n], F.lit(n)) for n in order])))
    d = d.withColumn("rule_raw", functools.reduce(Column.__add__, [F.when(counts[n], F.lit(weights[n])).otherwise(0) for n in order]))
    d = d.withColumn("rule_score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("rule_raw"))))

    def hit(name: str) -> Column:
        ident, category = specs.get(name, (name, "lure"))
        fired, reason, spans = found[name]
        spans = F.col(f"__s_{name}") if fired is None else spans.cast(SPANS)
        snippets = lambda s: F.slice(F.array_distinct(F.transform(F.filter(s, lambda x: x["end"] > x["start"]), lambda x: F.substr(text, x["start"] + 1, x["end"] - x["start"]))), 1, 5)
        one = lambda s: F.struct(F.lit(ident).alias("rule_id"), F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit(weights[name]).alias("weight"), reason.alias("reason"), s.alias("spans"), snippets(s).alias("snippets"))
        return F.when(counts[name], F.transform(F.array(spans), one)[0])

    d = d.withColumn("hits", F.array_compact(F.array(*[hit(n) for n in order])))
    d = settled(d.select(*[c for c in d.columns if not c.startswith(("__s_", "__f_", "__links", "__mail", "__own", "__look", "__away", "__imitates", "__hosts", "__claims", "__meta", _WORDS))]))
    asked = F.array_intersect("fired", F.array(*map(F.lit, lx.REQUESTS)))
    posed = F.array_intersect("fired", F.array(*map(F.lit, lx.IMPERSONATIONS)))
    verified = F.col("known_contact") | F.coalesce("trusted_sender", F.lit(False))
    combo = (F.size(asked) > 0) & ((F.size(posed) > 0) | (F.array_contains("fired", "AUTHORITY_CLAIM") & ~verified))
    who = F.when(F.size(posed) > 0, F.array_join(F.array_sort(posed), " + ")).otherwise("AUTHORITY_CLAIM (unverified)")
    reason = F.concat(F.array_join(F.array_sort(asked), " + "), F.lit(" combined with "), who)
    return settled(d.withColumn("critical_combo", combo).withColumn("combo_reason", F.when(combo, reason)))


def rule_hits(evaluated: DataFrame) -> DataFrame:
    """The long form: a row for each message and hit."""
    return evaluated.select("msg_id", F.explode("hits").alias("h")).select("msg_id", "h.*")


def rule_catalog(spark, config: Config | None = None) -> DataFrame:
    config = config or Config()
    return spark.createDataFrame([(i, n, c, config.weights[n]) for i, n, c in lx.RULES], "rule_id string, name string, category string, weight int")
