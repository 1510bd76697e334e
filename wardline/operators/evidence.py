"""Evidence: overlapping spans become disjoint segments, and explanations become text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.lexicon import PRIORITY
from wardline.functions.spans import bound, running_totals
from wardline.operators.ingest import INVISIBLE, to_display


def priority(category: Column) -> Column:
    return F.coalesce(*[F.when(category == c, F.lit(p)) for c, p in PRIORITY.items()], F.lit(0))


def overlay(spans: DataFrame, key: str = "msg_id") -> DataFrame:
    """(key, start, end, category, labels) from (key, start, end, category, label, ord): disjoint segments.

    A sweep: the bounds of a key's spans, in order, make elementary segments; each takes the category of highest
    priority among the spans that cover it, and all their labels in order; equal neighbours are joined.
    """
    spans = spans.where("end > start")
    bounds = spans.select(key, F.col("start").alias("p")).union(spans.select(key, F.col("end").alias("p"))).distinct()
    by_place = Window.partitionBy(key).orderBy("p")
    pieces = bounds.withColumn("q", F.lead("p").over(by_place)).where("q is not null")
    held = pieces.join(spans, key).where("start <= p and end >= q")
    pick = F.max_by("category", F.struct(priority(F.col("category")), -F.col("ord")))
    labels = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]))
    flat = held.groupBy(key, "p", "q").agg(pick.alias("category"), labels.alias("labels"))
    w = Window.partitionBy(key).orderBy("p")
    new = ~((F.lag("q").over(w) == F.col("p")) & (F.lag("category").over(w) == F.col("category")) & (F.lag("labels").over(w) == F.col("labels")))
    runs = flat.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "run").agg(F.min("p").alias("start"), F.max("q").alias("end"), F.first("category").alias("category"), F.first("labels").alias("labels")).drop("run")


def hit_spans(evaluated: DataFrame) -> DataFrame:
    """The spans of all hits in places of the displayed text, as overlay() takes them."""
    rows = evaluated.select("msg_id", "hidden_positions", F.posexplode("hits").alias("i", "h")).select("msg_id", "hidden_positions", "i", "h", F.posexplode("h.spans").alias("j", "s"))
    hidden = F.col("hidden_positions")
    return rows.select("msg_id", to_display(F.col("s.start"), hidden).alias("start"), F.when(F.col("s.end") > F.col("s.start"), to_display(F.col("s.end") - 1, hidden) + 1).otherwise(F.col("s.end")).alias("end"), F.col("h.category").alias("category"), F.concat_ws(" ", "h.rule_id", "h.name").alias("label"), (F.col("i") * 1000 + F.col("j")).alias("ord"))


def explained(scored: DataFrame) -> DataFrame:
    """Adds rule_explanations, score_explanation and injection_detected."""
    quote = lambda h: F.when(F.size(h["snippets"]) > 0, F.concat(F.lit(' - "'), h["snippets"][0], F.lit('"'))).otherwise("")
    said = F.transform("hits", lambda h: F.concat(F.lit("["), h["rule_id"], F.lit("] "), h["reason"], F.lit(" ("), F.when(h["weight"] > 0, "+").otherwise(""), h["weight"].cast("string"), F.lit(")"), quote(h)))
    base = F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit("/100, tier "), F.col("tier"), F.lit(", by "), F.col("mode"), F.lit("."))
    return scored.withColumn("rule_explanations", said).withColumn("score_explanation", F.concat_ws(" ", base, F.array_join("adjustments", ". "))).withColumn("injection_detected", F.array_contains("fired", "PROMPT_INJECTION") | F.coalesce("llm_injection_flagged", F.lit(False)))


def escaped(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


#: What stands for an invisible character in HTML.
HIDDEN_MARK = '<span class="hidden" title="hidden character">&#9670;</span>'
PIECE = "struct<text:string,category:string,labels:array<string>,hidden:boolean>"


def display_pieces(text: Column, spans: Column, hidden: Column) -> Column:
    """The text cut into pieces (text, category, labels, hidden), so that a client needs no offsets.

    spans are (start, end, category, labels), disjoint and in order; hidden are the places of invisible characters, each of which is a piece
    of its own. A sweep over the bounds of both: a piece belongs to the span that covers it, and neighbours of one category with the
    same labels are one piece unless one of them is hidden. An empty or null text has no pieces."""
    n = F.length(text)
    fits = lambda p: (p >= 0) & (p <= n)
    ends = F.concat(F.array(F.lit(0), n), F.transform(spans, lambda s: s["start"].cast("int")), F.transform(spans, lambda s: s["end"].cast("int")), hidden.cast("array<int>"), F.transform(hidden, lambda p: (p + 1).cast("int")))

    filled = F.filter(spans, lambda s: s["end"] > s["start"])

    def counted(bounds: Column) -> Column:
        """(p, k) for every bound: k spans begin at it or before it, so only the last of these can cover what follows."""
        mark = lambda p, kind: F.struct(p.cast("int").alias("p"), F.lit(kind).alias("kind"))
        marks = F.array_sort(F.concat(F.transform(filled, lambda s: mark(s["start"], 0)), F.transform(bounds, lambda p: mark(p, 1))))
        with_counts = lambda m: F.zip_with(m, running_totals(F.transform(m, lambda x: 1 - x["kind"])), lambda x, k: F.struct(x["p"].alias("p"), x["kind"].alias("kind"), k.alias("k")))
        return F.filter(bound(marks, with_counts), lambda x: x["kind"] == 1)

    def cut(both: Column) -> Column:
        bounds = both["bounds"]

        def piece(x: Column, i: Column) -> Column:
            a, b = x["p"], F.get(bounds, i + 1)["p"]
            last = F.get(both["spans"], x["k"] - 1)
            over = F.when(b <= last["end"], last)
            return F.struct(a.alias("a"), b.alias("b"), over["category"].alias("category"), F.coalesce(over["labels"], F.array().cast("array<string>")).alias("labels"), F.array_contains(both["hidden"], a).alias("hidden"))

        return F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), piece)

    def joined(pieces: Column) -> Column:
        same = lambda x, y: ~x["hidden"] & ~y["hidden"] & x["category"].eqNullSafe(y["category"]) & (x["labels"] == y["labels"])
        heads = F.filter(pieces, lambda p, i: (i == 0) | ~same(p, F.get(pieces, F.greatest(i - 1, F.lit(0)))))
        told = lambda h, p, stop: F.struct(F.substr(text, p["a"] + 1, stop - p["a"]).alias("text"), p["category"].alias("category"), p["labels"].alias("labels"), p["hidden"].alias("hidden"))
        return bound(heads, lambda h: F.transform(h, lambda p, i: told(h, p, F.coalesce(F.get(h, i + 1)["a"], n))))

    whole = lambda bounds: F.struct(counted(bounds).alias("bounds"), filled.alias("spans"), hidden.cast("array<int>").alias("hidden"))
    pieces = bound(bound(bound(F.array_sort(F.array_distinct(F.filter(ends, fits))), whole), cut), joined)
    return F.when(n > 0, pieces).otherwise(F.array().cast(f"array<{PIECE}>"))


def marked_hidden(escaped_text: Column) -> Column:
    """Escaped text with a visible mark for each invisible character."""
    return F.regexp_replace(escaped_text, "[" + "".join(f"\\x{{{ord(c):x}}}" for c in INVISIBLE) + "]", HIDDEN_MARK)


def highlighted(text: Column, segments: Column) -> Column:
    """HTML of a text with its segments (start, end, category, labels; disjoint and in order) marked, all else escaped and invisible characters shown."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = marked_hidden(escaped(F.substr(text, acc["at"] + 1, s["start"] - acc["at"])))
        mark = F.concat(F.lit('<mark class="'), s["category"], F.lit('" title="'), escaped(F.array_join(s["labels"], "; ")), F.lit('">'), marked_hidden(escaped(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), F.lit("</mark>"))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    return F.replace(F.aggregate(segments, begin, step, lambda acc: F.concat(acc["out"], marked_hidden(escaped(F.substr(text, acc["at"] + 1, F.length(text)))))), F.lit("\n"), F.lit("<br>"))
