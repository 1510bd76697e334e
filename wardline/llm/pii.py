"""Personal data: patterns, and information-theoretic sanitisation of the terms around them. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The corpus then says which terms give a
protected entity away: for a term t in the context of an entity e, the pointwise mutual information
log2(p(e, t) / (p(e) p(t))) reaches the entity's whole information content log2(1 / p(e)) where t never
occurs without e. A term whose share of that content is at least DISCLOSURE is sanitised wherever it stands, whether or
not the entity is named there. The context is the whole document, and every entity is estimated; where a term and an entity
share few documents, the lower confidence bound of p(e | t) counts instead of its estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import row_key, salted_lookup, written

KINDS = ("email", "ip", "card", "phone")
#: Least length of a term, documents with entity and term from which p(e | t) counts as estimated, standard errors of its bound below.
TERM_CHARS, SUPPORT, Z = 3, 3, 1.96
#: Disclosing terms up to which they are broadcast to the documents.
BROADCAST_TERMS = 200_000
#: Share of an entity's information content from which a term discloses it.
DISCLOSURE = 0.8

#: The contract's patterns. Where a match can only begin at the start of a run or behind a match, this is said, so that a
#: long run without a match costs its length and not its square.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a match at all: cheap to look for.
NEEDS = {"email": "@", "phone": "+"}
_SPAN = "struct<kind:string,start:int,end:int,value:string>"
_WORD_BREAK = r"[^\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(_digits(value))
    return n.between(16, 19) & F.call_function("luhn_check", _digits(value)) if kind == "card" else n.between(8, 15)


#: Places of a block in prefix_sums: arrays grow within a block and by a place for each block, never by one for each value.
BLOCK = 256


def prefix_sums(values: Column) -> Column:
    """Sums of an int array up to each place, its own value included."""
    grow = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))
    running = lambda v, first: F.aggregate(v, F.struct(first.alias("sum"), F.array().cast("array<int>").alias("out")), grow, lambda acc: acc["out"])

    def summed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(v, at + 1, F.lit(BLOCK)))
        before = lambda b: F.concat(F.array(F.lit(0)), running(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)), F.lit(0)))
        parts = lambda b: F.zip_with(b, F.slice(before(b), F.lit(1), F.size(b)), lambda x, first: running(x, first))
        return F.flatten(F.transform(F.array(blocks), parts)[0])

    return F.transform(F.array(values), summed)[0]  # bound by a lambda, so that it is computed once


def located(text: Column, pattern: Column, kind: str) -> Column:
    """The matches of a pattern in a text, leftmost and not overlapping, as an array of spans in code points.

    Splitting at the same pattern gives what lies between the matches; a match's end is the length of all up to it.
    """
    value = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        ends = prefix_sums(F.zip_with(both["gaps"], both["values"], lambda g, v: F.length(g) + F.length(v)))
        return F.zip_with(ends, both["values"], lambda e, v: F.struct(F.lit(kind).alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return F.transform(F.array(F.struct(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gaps"), value.alias("values"))), placed)[0]


def base_spans(text: Column, kind: str) -> Column:
    """A kind's spans in a text that isn't null; matches that fail its test are dropped, without a second try."""
    pattern = PATTERNS[kind]
    may = text.contains(NEEDS[kind]) & text.rlike(pattern) if kind in NEEDS else text.rlike(pattern)
    if kind == "card":  # most digit runs are short: 16 digits must come together
        may = text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    return F.when(may, F.filter(located(text, F.lit(pattern), kind), lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def with_base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """docs with an array of base spans (kind, start, end, value), by kind as listed and then by start."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.concat(*[base_spans(t, k) for k in KINDS]))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), _WORD_BREAK), lambda w: F.length(w) >= TERM_CHARS))


def disclosing_terms(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """(term, share): terms that give a protected entity away; spans has (text, base) for documents with base spans.

    All counts are of documents (rows). Entities with the same documents have the same shares and stand as one class, so
    a document with many entities of its own has its terms counted once. Counts have partial sums before the shuffle, so
    what moves is at most the distinct terms of each task, or of each class in it.
    """
    texts = spans.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text", "base")
    texts = written(texts.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first("base").alias("base")), "protected-texts")
    named = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    entities = texts.select("k1", "k2", "n", F.explode(named).alias("e"))
    total_of = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    classes = entities.groupBy("e").agg(F.sum("n").alias("ce"), total_of("k1").alias("s1"), total_of("k2").alias("s2"))
    held = salted_lookup(entities, classes, ["e"], ["k1"]).select("k1", "k2", F.struct("ce", "s1", "s2").alias("c"))
    held = held.groupBy("k1", "k2").agg(F.collect_set("c").alias("classes"))
    pairs = texts.join(held, ["k1", "k2"]).select("n", "classes", _terms(F.col("text")).alias("terms")).select("n", F.explode("classes").alias("c"), "terms")
    together = pairs.select("n", "c.ce", "c.s1", "c.s2", F.explode("terms").alias("term")).groupBy("ce", "s1", "s2", "term").agg(F.sum("n").alias("cet"))
    together = written(together, "together")
    if together.isEmpty():
        return together.select("term", F.lit(0.0).alias("share"))
    total = docs.count()
    counted = docs.select(F.explode(_terms(F.coalesce(text, F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("ct"))
    # a share of DISCLOSURE means p(e | t) >= p(e) ** (1 - DISCLOSURE), and p(e) >= 1 / total: frequent terms can't reach it
    most = together.groupBy("term").agg(F.max("cet").alias("most"))
    may = counted.join(most, "term").where(F.col("most") >= F.col("ct") * F.lit(0.999 * total ** (DISCLOSURE - 1))).select("term", "ct")
    rated = salted_lookup(together, may, ["term"], ["s1"]).where("ct is not null")
    p = F.col("cet") / F.col("ct")
    low = (p + Z * Z / 2 / F.col("ct") - Z * F.sqrt(p * (1 - p) / F.col("ct") + Z * Z / 4 / (F.col("ct") * F.col("ct")))) / (1 + Z * Z / F.col("ct"))  # Wilson's bound
    pmi = F.log2(F.when(F.col("cet") >= SUPPORT, p).otherwise(low) * F.lit(float(total)) / F.col("ce"))
    share = pmi / F.greatest(F.log2(F.lit(float(total)) / F.col("ce")), F.lit(1e-9))
    return rated.withColumn("share", share).where(F.col("share") >= DISCLOSURE).groupBy("term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base (spans by pattern) and spans (those, then the disclosing terms' spans of kind "term").

    A term's span is left out where it touches a base span. Null and empty texts have no spans; repeated rows get equal
    spans; very long texts and matches are read whole, at a cost nearly in proportion to their number; an empty table stays empty. Columns
    called base or spans are replaced; others may have any name.
    """
    docs = docs.drop("base", "spans")
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), F.col(text).alias("text"), *[k.alias(n) for k, n in zip(row_key(*names), ("k1", "k2"), strict=True)])
    # base spans are located once; rows that have some are few
    slim = with_base_spans(keyed.select("k1", "k2", "text"))
    some = written(slim.where("size(base) > 0"), "protected")
    none = F.array().cast(f"array<{_SPAN}>")
    terms = written(disclosing_terms(docs, some.select("text", "base"), text), "terms")
    listed = terms.select("term")
    if listed.count() <= BROADCAST_TERMS:  # else both sides are shuffled
        listed = F.broadcast(listed)
    hits = keyed.select("k1", "k2", F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term")).join(listed, "term", "left_semi")
    facts = hits.select("k1", "k2", "term", F.lit(None).cast(f"array<{_SPAN}>").alias("base")).union(some.select("k1", "k2", F.lit(None).cast("string"), "base"))
    facts = written(facts.groupBy("k1", "k2").agg(F.collect_set("term").alias("terms"), F.first("base", True).alias("base")), "row-facts")
    body = F.col("row").getField(text)  # a text travels once, in its row
    joined = keyed.select("row", "k1", "k2").join(facts, ["k1", "k2"], "left").withColumn("base", F.coalesce("base", none))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    found = F.filter(located(body, pattern, "term"), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.when(F.size("terms") > 0, F.concat("base", found)).otherwise(F.col("base"))
    return joined.select("row.*", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to their kind in brackets and terms removed; of spans that overlap, the first counts."""
    t = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        late = s["start"] < acc["at"]
        return F.struct(F.when(late, acc["at"]).otherwise(s["end"]).alias("at"), F.when(late, acc["out"]).otherwise(new).alias("out"))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.length(t))))
