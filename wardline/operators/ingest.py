"""Normalisation, gates and extraction: one message per row becomes typed columns, without a shuffle.

The only Python is the Unicode normalisation (NFKC), which Spark lacks; rows of plain ASCII pass it as nulls.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.config import Config
from wardline.functions import lexicon as lx
from wardline.functions.spans import answered, located, rx, settled, starts_in
from wardline.operators.brands import official_brand, registrable_domain

CHANNELS = ("sms", "email", "chat")
#: Columns of a message and their types; those that a table lacks are null.
MESSAGE = {
    "msg_id": "string", "user_id": "string", "text": "string", "text_bytes": "binary", "channel": "string", "sender_id": "string",
    "claimed_sender": "string", "known_contact": "boolean", "trusted_sender": "boolean", "extra_flags": "array<string>", "precheck_flags": "array<string>",
}
INVISIBLE = lx.ZERO_WIDTH + lx.BIDI
_SPACE_ENDS = r"(?U)^\s+|\s+$"


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


#: One of the letters that are folded; ASCII isn't compared with each of them.
_LOOKALIKE = rf"(?=\P{{ASCII}})[{_class(lx.LOOKALIKE_FROM)}]"


def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def stopword_count(text: Column, words) -> Column:
    """How many words of a text, in any case, are among some."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.lower(w))
    return F.size(F.filter(found, lambda w: w.isin(*words)))


def parse_channel(channel: Column) -> Column:
    return F.when(F.lower(channel).isin(*CHANNELS), F.lower(channel)).otherwise("sms")


def conform(messages: DataFrame) -> DataFrame:
    """messages with every column of MESSAGE, in its type; other columns stay behind these."""
    have = dict(messages.dtypes)
    cols = [(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in MESSAGE.items()]
    return messages.select(*cols, *[c for c in messages.columns if c not in MESSAGE])


def normalise(messages: DataFrame, config: Config) -> DataFrame:
    """Decode, gate, normalise and fold. Adds status, quality_flags, display_text, analysis_text, clean_text, original_length,
    truncated and the counts of obfuscation. The first gate that a message fails names its flag:
    pre-checks, not text, binary, too long, empty, then nothing but signs, too short and language."""
    m = conform(messages).withColumn("channel", parse_channel(F.col("channel"))).withColumn("known_contact", F.coalesce("known_contact", F.lit(False)))
    bad = F.col("text").isNull() & F.col("text_bytes").isNotNull() & ~F.call_function("is_valid_utf8", F.col("text_bytes").cast("string"))
    m = m.withColumn("__raw", F.coalesce("text", F.when(~bad, F.col("text_bytes").cast("string")))).withColumn("original_length", F.coalesce(F.length("__raw"), F.octet_length("text_bytes"), F.lit(0)))
    raw = F.col("__raw")
    # printable ASCII, most of all texts, is ruled out before the classes of Unicode are asked
    control = F.regexp_count(raw, F.lit(r"(?=[^ -~\n\r\t])[\p{Cc}\p{Cs}\p{Co}\p{Cn}]"))
    binary = (F.instr(raw, "\x00") > 0) | (control > config.max_control_ratio * F.length(raw))
    early = (
        F.when(F.size("precheck_flags") > 0, F.lit("precheck"))
        .when(bad, "binary_input").when(raw.isNull(), "non_text_input").when(binary, "binary_input")
        .when(F.col("original_length") > config.reject_over, "too_long").when(~raw.rlike(r"(?U)\S"), "empty")
    )
    m = m.withColumn("__early", early).withColumn("__ascii", raw.rlike(r"^\p{ASCII}*$"))
    m = answered(m.withColumn("__plain", F.when(F.col("__early").isNull() & ~F.col("__ascii"), raw)), "__nfkc", T.StringType(), "__plain", _nfkc)
    display = F.when(F.col("__early").isNull(), F.coalesce("__nfkc", raw))
    m = m.withColumn("__display", display).withColumn("truncated", F.coalesce(F.length("__display") > config.truncate_at, F.lit(False)))
    m = m.withColumn("display_text", F.coalesce(F.left("__display", F.lit(config.truncate_at)), F.lit("")))
    # what is removed or folded is never ASCII
    plain = F.coalesce("__ascii", F.lit(False))
    m = m.withColumn("clean_text", F.when(plain, F.col("display_text")).otherwise(F.translate("display_text", INVISIBLE, "")))
    m = m.withColumn("analysis_text", F.when(plain, F.col("clean_text")).otherwise(F.translate("clean_text", lx.LOOKALIKE_FROM, lx.LOOKALIKE_TO)))
    words = F.regexp_extract_all("clean_text", F.lit(r"\p{L}+"), F.lit(0))
    mixed = F.filter(words, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))
    m = m.withColumn("mixed_script_words", F.when(F.col("__ascii"), F.array().cast("array<string>")).otherwise(mixed))
    letters = F.regexp_count("clean_text", F.lit(r"\p{L}"))
    other = F.regexp_count("clean_text", F.lit(r"(?:(?!\p{IsLatin})\p{L})"))
    excused = F.regexp_count(F.array_join("mixed_script_words", " "), F.lit(r"(?:(?!\p{IsLatin})\p{L})"))
    ratio = F.when(F.col("__ascii") | (letters == 0), F.lit(0.0)).otherwise((other - excused) / letters)
    small = F.regexp_extract_all(F.lower("analysis_text"), F.lit("[a-z]+"), F.lit(0))  # the words of ASCII texts
    counted = lambda words: F.when(plain, F.size(F.filter(small, lambda w: w.isin(*words)))).otherwise(stopword_count(F.col("analysis_text"), words))
    foreign = (ratio > 0.3) | ((counted(lx.FOREIGN) >= 3) & (counted(lx.FOREIGN) > 2 * counted(lx.ENGLISH)))
    late = F.when(~F.col("analysis_text").rlike(r"[\p{L}\p{N}]"), "no_text_content").when(F.length(F.regexp_replace("analysis_text", _SPACE_ENDS, "")) < config.min_chars, "too_short").when(foreign, "unsupported_language")
    m = m.withColumn("__flag", F.coalesce("__early", late)).withColumn("status", F.when(F.col("__flag").isNull(), "OK").otherwise("INSUFFICIENT_DATA"))
    extra = F.coalesce("extra_flags", F.array().cast("array<string>"))
    flags = F.when(F.col("__flag") == "precheck", F.col("precheck_flags")).when(F.col("__flag").isNotNull(), F.array("__flag")).otherwise(F.when(F.col("truncated"), F.concat(F.array(F.lit("truncated")), extra)).otherwise(extra))
    ok = F.col("status") == "OK"
    m = m.withColumn("quality_flags", flags)
    zero, both = _class(lx.ZERO_WIDTH), _class(INVISIBLE)
    counts = {
        "zero_width_removed": F.regexp_count("display_text", F.lit(f"[{both}]")),
        "in_word_zero_width": F.regexp_count("display_text", F.lit(rf"(?<=[\p{{L}}\p{{N}}])[{zero}](?=[\p{{L}}\p{{N}}{both}])")),
        "bidi_controls": F.regexp_count("display_text", F.lit(f"[{_class(lx.BIDI)}]")),
        "compat_chars": F.regexp_count(raw, F.lit(r"[\x{1D400}-\x{1D7FF}\x{FF21}-\x{FF5A}]")),
        "homoglyph_chars": F.length(F.regexp_replace(F.array_join("mixed_script_words", ""), f"[^{_class(lx.LOOKALIKE_FROM)}]", "")),
    }
    m = m.withColumns({k: F.when(ok & ~plain, v).otherwise(0).cast("int") for k, v in counts.items()})
    hidden = F.filter(F.sequence(F.lit(0), F.length("display_text")), lambda i: (i < F.length("display_text")) & F.substr(F.col("display_text"), i + 1, F.lit(1)).rlike(f"[{both}]"))
    m = m.withColumn("hidden_positions", F.when(ok & (F.col("zero_width_removed") > 0), hidden).otherwise(F.array().cast("array<int>")))
    m = m.withColumns({c: F.when(ok, F.col(c)).otherwise("") for c in ("analysis_text", "clean_text")}).withColumn("mixed_script_words", F.when(ok, F.col("mixed_script_words")).otherwise(F.array().cast("array<string>")))
    return m.drop("__raw", "__early", "__ascii", "__nfkc", "__plain", "__display", "__flag")


def to_display(position: Column, hidden: Column) -> Column:
    """Where a position of the analysis text stands in the displayed text, given the places of hidden characters, in order."""
    return F.aggregate(hidden, position, lambda at, h: F.when(h <= at, at + 1).otherwise(at))


def extract_urls(text: Column, clean: Column) -> Column:
    """Links as (start, end, raw, host, registrable, official, is_shortener, is_ip_literal, is_punycode, has_homoglyphs)."""
    trimmed = F.transform(located(text, rx(lx.URL), F.contains(text, F.lit(".")) | F.contains(text, F.lit("://"))), lambda s: F.struct(s["start"].alias("start"), F.regexp_replace(s["value"], r"""[.,;:!?)'"]+$""", "").alias("raw")))
    rest = lambda u: F.regexp_replace(F.regexp_extract(F.regexp_replace(u["raw"], r"(?i)^(?:https?|hxxps?)://", ""), r"^([^/?#]*)", 1), r"^.*@", "")
    host = lambda u: F.when(rest(u).startswith("["), F.concat(F.substring_index(rest(u), "]", 1), F.lit("]"))).otherwise(F.regexp_replace(F.lower(F.substring_index(rest(u), ":", 1)), r"\.+$", ""))
    hosted = F.filter(F.transform(trimmed, lambda u: F.struct(u["start"].alias("start"), u["raw"].alias("raw"), host(u).alias("host"))), lambda u: F.instr(u["host"], ".") > 0)
    decode = lambda h: F.array_join(F.transform(F.split(h, r"\."), lambda p: F.when(p.startswith("xn--"), F.coalesce(F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toUnicode"), p), p)).otherwise(p)), ".")
    decoded = F.transform(hosted, lambda u: F.struct(u["start"].alias("start"), u["raw"].alias("raw"), F.when(F.instr(u["host"], "xn--") > 0, F.lower(F.translate(decode(u["host"]), lx.LOOKALIKE_FROM, lx.LOOKALIKE_TO))).otherwise(u["host"]).alias("host"), (F.instr(u["host"], "xn--") > 0).alias("puny"), u["host"].rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$").alias("ip")))
    owned = F.transform(decoded, lambda u: F.struct(u["start"].alias("start"), u["raw"].alias("raw"), u["host"].alias("host"), u["puny"].alias("puny"), u["ip"].alias("ip"), F.when(u["ip"], u["host"]).otherwise(registrable_domain(u["host"])).alias("reg")))
    return F.transform(
        owned,
        lambda u: F.struct(
            u["start"].alias("start"),
            (u["start"] + F.length(u["raw"])).alias("end"),
            u["raw"].alias("raw"),
            u["host"].alias("host"),
            u["reg"].alias("registrable"),
            F.when(~u["ip"], official_brand(u["reg"])).alias("official"),
            ((u["reg"].isin(*lx.SHORTENERS) | u["host"].isin(*lx.SHORTENERS)) & (u["ip"] | official_brand(u["reg"]).isNull())).alias("is_shortener"),
            u["ip"].alias("is_ip_literal"),
            u["puny"].alias("is_punycode"),
            F.substr(clean, u["start"] + 1, F.length(u["raw"])).rlike(_LOOKALIKE).alias("has_homoglyphs"),
        ),
    )


def extract(normal: DataFrame) -> DataFrame:
    """Adds urls, emails, crypto, phones and amounts; links and addresses shut out what lies in them."""
    text = F.col("analysis_text")
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    d = normal.withColumn("__urls", extract_urls(text, F.col("clean_text"))).withColumn("emails", located(text, rx(lx.EMAIL, fold=False), F.contains(text, F.lit("@"))))
    d = d.withColumn("__skip", F.concat(F.transform("__urls", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"))), F.transform("emails", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end")))))
    d = d.withColumn("crypto", F.filter(located(text, rx(lx.CRYPTO, fold=False)), lambda s: ~starts_in(s, F.col("__skip"))))
    d = d.withColumn("phones", F.filter(located(text, rx(lx.PHONE, fold=False), text.rlike(rx(r"\d{3}", fold=False))), lambda s: ~starts_in(s, F.col("__skip")) & ~starts_in(s, F.col("crypto")) & digits(s).between(7, 15)))
    d = d.withColumn("amounts", F.filter(located(text, rx(lx.AMOUNT)), lambda s: ~starts_in(s, F.col("__skip"))))
    d = settled(d)
    return d.withColumn("urls", F.filter("__urls", lambda u: ~starts_in(u, F.col("emails")))).drop("__urls", "__skip")


def ingest(messages: DataFrame, config: Config | None = None) -> DataFrame:
    return extract(settled(normalise(messages, config or Config())))
