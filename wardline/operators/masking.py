"""Masking of personal data in messages and of senders, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import lexicon as lx

KINDS = ("credentials", "query", "email", "iban", "card", "ssn", "phone", "otp")


def luhn_ok(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def iban_ok(value: Column) -> Column:
    """Length, form and the remainder 1 by 97 of the letters as numbers, the first four signs moved to the end."""
    s = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))
    code = lambda c: F.ascii(c)
    step = lambda a, c: F.when(code(c) >= 65, (a * 100 + code(c) - 55) % 97).otherwise((a * 10 + code(c) - 48) % 97)
    return F.length(s).between(15, 34) & s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1)


def _swap(text: Column, pattern: str, put: str, fits) -> tuple[Column, Column]:
    """The text with every match that fits replaced, and how many were: what lies between the matches, and the matches or
    what is put for them, joined in order. Texts without a match are left alone."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    may = text.rlike(pattern)
    pieces = F.zip_with(F.split(text, pattern, -1), values, lambda gap, v: F.concat(gap, F.when(v.isNull(), "").when(fits(v), put).otherwise(v)))
    return F.when(may, F.array_join(pieces, "")).otherwise(text), F.when(may, F.size(F.filter(values, fits))).otherwise(0)


def mask_text(df: DataFrame, text: str, out: str = "masked_text", counts: str = "mask_counts") -> DataFrame:
    """df with the masked text and a map of how many values of each kind were masked (kinds without any are left out).

    Each step sees what the ones before have put in place: invisible characters, credentials and queries of links,
    addresses, account numbers, cards, social security numbers, phones, one-time codes.
    """
    d = df.withColumn("__t", F.translate(F.col(text), lx.ZERO_WIDTH + lx.BIDI, ""))
    tally: dict[str, list[str]] = {k: [] for k in KINDS}
    steps = [
        ("credentials", lx.MASK_USERINFO, "$1[CREDENTIALS]@", None), ("query", lx.MASK_QUERY, "$1?[QUERY]", None), ("email", lx.MASK_EMAIL, "[EMAIL]@$1", None),
        ("iban", lx.MASK_IBAN, "[IBAN]", iban_ok), ("card", lx.MASK_CARD, "[CARD]", luhn_ok), ("ssn", lx.MASK_SSN, "[SSN]", None), ("ssn", lx.MASK_SSN_NEAR, "$1[SSN]", None),
        ("phone", lx.MASK_PHONE, "[PHONE]", lambda v: F.length(F.regexp_replace(v, r"\D", "")).between(7, 15)),
        ("otp", lx.MASK_OTP_AFTER, "$1[OTP]", None), ("otp", lx.MASK_OTP_BEFORE, "[OTP]", None), ("otp", lx.MASK_OTP_ALONE, "[OTP]", None),
    ]
    for i, (kind, pattern, put, fits) in enumerate(steps):
        t, p = F.col("__t"), "(?U)" + pattern
        may = t.rlike(p)
        new, n = (F.when(may, F.regexp_replace(t, p, put)).otherwise(t), F.when(may, F.regexp_count(t, F.lit(p))).otherwise(0)) if fits is None else _swap(t, p, put, fits)
        d = d.withColumns({f"__n{i}": n, "__t": new})
        tally[kind].append(f"__n{i}")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), sum((F.col(c) for c in cols[1:]), F.col(cols[0])).alias("v")) for k, cols in tally.items()])
    return d.withColumn(out, F.col("__t")).withColumn(counts, F.map_from_entries(F.filter(pairs, lambda x: x["v"] > 0))).drop("__t", *[c for cols in tally.values() for c in cols])


def mask_sender(sender: Column) -> Column:
    """A sender with the person taken out: an address keeps its domain, a phone its last two digits, a short code itself."""
    s = F.translate(F.regexp_replace(sender, r"(?U)^\s+|\s+$", ""), lx.ZERO_WIDTH + lx.BIDI, "")
    digits = F.regexp_replace(s, r"\D", "")
    host = F.regexp_extract(s, lx.MASK_EMAIL, 1)
    short = (digits != "") & (F.length(digits) <= 6) & ~s.rlike("[A-Za-z]")
    return F.when(sender.isNull() | (sender == ""), sender).when(host != "", F.concat(F.lit("[EMAIL]@"), host)).when(short, s).when(F.length(digits).between(7, 15), F.concat(F.lit("[PHONE …"), F.right(digits, F.lit(2)), F.lit("]"))).otherwise("[HANDLE]")
