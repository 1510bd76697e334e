"""Evaluation: confusion, precision and recall at two operating points, rollups, percentiles and word recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.lexicon import IMPERSONATIONS, REQUESTS

TIERS = ("INSUFFICIENT", "LOW", "MEDIUM", "HIGH", "CRITICAL")
POINTS = {"warn": ("MEDIUM", "HIGH", "CRITICAL"), "interrupt": ("HIGH", "CRITICAL")}


def _rate(a, b):
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b), 3), F.lit(0.0))


def binary_metrics(records: DataFrame) -> DataFrame:
    """records (label, tier, split) -> a row for each operating point and split, and for all splits together (split 'all')."""
    flagged = F.coalesce(F.when(F.col("point") == "warn", F.col("tier").isin(*POINTS["warn"])).otherwise(F.col("tier").isin(*POINTS["interrupt"])), F.lit(False))
    scam = F.col("label") == "scam"
    d = records.select("label", "tier", "split", F.explode(F.array(*map(F.lit, POINTS))).alias("point")).withColumn("f", flagged)
    d = d.rollup("point", "split").agg(F.grouping("point").alias("g"), F.grouping("split").alias("gs"), F.count_if(F.col("f") & scam).alias("tp"), F.count_if(F.col("f") & ~scam).alias("fp"), F.count_if(~F.col("f") & ~scam).alias("tn"), F.count_if(~F.col("f") & scam).alias("fn")).where("g = 0")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return d.select("point", F.when(F.col("gs") == 1, "all").otherwise(F.col("split")).alias("split"), "tp", "fp", "tn", "fn", _rate(tp, tp + fp).alias("precision"), _rate(tp, tp + fn).alias("recall"), _rate(2 * tp, 2 * tp + fp + fn).alias("f1"), _rate(fp, fp + tn).alias("fpr"), _rate(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def confusion(records: DataFrame) -> DataFrame:
    """label by tier, every cell filled."""
    return records.withColumn("tier", F.coalesce("tier", F.lit("INSUFFICIENT"))).groupBy("label").pivot("tier", list(TIERS)).count().na.fill(0)


def per_category(records: DataFrame) -> DataFrame:
    return records.groupBy("label", "category").agg(F.count("*").alias("n"), F.count_if(F.col("tier").isin(*POINTS["warn"])).alias("warned"), F.count_if(F.col("tier").isin(*POINTS["interrupt"])).alias("interrupted"))


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """p50 and p95 with linear interpolation, and the mean."""
    p = lambda q: F.round(F.percentile(value, q), 2)
    return df.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg(value), 2).alias("mean"))


def misclassified(records: DataFrame) -> DataFrame:
    warned = F.coalesce(F.col("tier").isin(*POINTS["warn"]), F.lit(False))
    error = F.when((F.col("label") == "scam") & ~warned, "false negative (no warning)").when((F.col("label") == "legit") & warned, F.concat(F.lit("false positive ("), F.col("tier"), F.lit(")")))
    return records.withColumn("error", error).where("error is not null")


def under_warned(records: DataFrame) -> DataFrame:
    """Scams that were warned of but not interrupted, with why: by the names of the rules that fired."""
    asked, posed = (F.arrays_overlap("fired", F.array(*map(F.lit, names))) for names in (REQUESTS, IMPERSONATIONS))
    why = F.when(~asked, "pressed or imitated, but asked for no secret and no payment").when(~posed, "asked without an imitation, so that the floor of HIGH did not hold").otherwise("all weights together stayed below HIGH")
    return records.where((F.col("label") == "scam") & (F.col("tier") == "MEDIUM")).withColumn("why", why)


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return df.select(key, F.explode(words).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))


def word_recall(pairs: DataFrame, key: str = "id", source: str = "source", seen: str = "seen") -> DataFrame:
    """(key, recall): the share of the source's words, as often as they occur, that were seen. Sources without words have 1."""
    a, b = word_counts(pairs, key, source), word_counts(pairs, key, seen).withColumnRenamed("n", "m")
    hit = a.join(b, [key, "w"], "left").groupBy(key).agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("recall"))
    return pairs.select(key).join(hit, key, "left").select(key, F.coalesce("recall", F.lit(1.0)).alias("recall"))


# Domains that are compared between a text and what was read of it.
DOMAIN = r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|info|xyz|top|shop|app|co|io|support)\b"


def domains(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(DOMAIN), F.lit(0)))


def variant_scores(read: DataFrame) -> DataFrame:
    """read (variant, id, truth, got, tier, text_tier, ms) -> a row for each variant, and one for all (variant "all"): n, mean word recall, how many
    agree with the text's own tier and warning, how many have all of its domains, and the exact median of the time.

    Word recall is a join; all else is one pass over the rows with grouping sets. A null tier is INSUFFICIENT; a null text has no words and no domains."""
    tier = lambda c: F.coalesce(c, F.lit("INSUFFICIENT"))
    warned = lambda c: tier(F.col(c)).isin(*POINTS["warn"])
    texts = read.select("id", F.coalesce("truth", F.lit("")).alias("truth"), F.coalesce("got", F.lit("")).alias("got"))
    d = read.join(word_recall(texts, "id", "truth", "got"), "id")
    has = F.size(F.array_except(domains(F.coalesce("truth", F.lit(""))), domains(F.coalesce("got", F.lit(""))))) == 0
    d = d.select("variant", "recall", "ms", (tier(F.col("tier")) == tier(F.col("text_tier"))).alias("t"), (warned("tier") == warned("text_tier")).alias("w"), has.alias("h"))
    d = d.rollup("variant").agg(F.grouping("variant").alias("g"), F.count("*").alias("n"), F.round(F.avg("recall"), 3).alias("recall"), F.count_if("t").alias("same_tier"), F.count_if("w").alias("same_warning"), F.count_if("h").alias("domains_kept"), F.round(F.percentile("ms", F.lit(0.5)), 2).alias("median_ms"))
    return d.withColumn("variant", F.when(F.col("g") == 1, "all").otherwise(F.col("variant"))).drop("g")


def why_wrong(records: DataFrame, medium: int = 30) -> DataFrame:
    """Misclassified records with an automatic analysis. records has label, tier, score, fired (names of rules), quality_flags, llm_type and llm_score."""
    fired = F.array_join("fired", ", ")
    llm = F.coalesce(F.concat(F.lit(" The classifier said "), F.col("llm_type"), F.lit(" ("), F.col("llm_score").cast("string"), F.lit(").")), F.lit(""))
    score = F.coalesce("score", F.lit(0))
    gated = F.concat(F.lit("No analysis ran: stopped at the gate by "), F.array_join("quality_flags", ", "), F.lit("."))
    missed = F.concat(F.lit("Fired: "), F.when(fired == "", "no rule").otherwise(fired), F.lit("; score "), score.cast("string"), F.lit(" is "), (F.lit(medium) - score).cast("string"), F.lit(" below MEDIUM."), llm, F.lit(" Nothing asked for a secret or a payment, and nobody was imitated."))
    flagged = F.concat(F.lit("Fired: "), F.when(fired == "", "none").otherwise(fired), F.lit("; score "), score.cast("string"), F.lit(". Harmless messages of this kind have these patterns too."))
    d = misclassified(records)
    return d.withColumn("analysis", F.when(F.col("error").startswith("false positive"), flagged).when(F.coalesce("tier", F.lit("INSUFFICIENT")) == "INSUFFICIENT", gated).otherwise(missed))


def report(records: DataFrame, medium: int = 30) -> DataFrame:
    """(mode, section, place, line): the lines of a Markdown report on records (mode, split, label, category, tier, id and what why_wrong() asks for), to be read
    in the order of these columns.

    Summary, confusion and categories are grouping sets of one pass over the records; the analysis of errors has a line for each. Nothing is
    gathered: what is ordered are lines that are keyed by their section."""
    scam, at = F.col("label") == "scam", lambda p: F.coalesce(F.col("tier").isin(*POINTS[p]), F.lit(False))
    sums = [F.count("*").alias("n")]
    for p in POINTS:
        sums += [F.count_if(at(p) & scam).alias(f"{p}_tp"), F.count_if(at(p) & ~scam).alias(f"{p}_fp"), F.count_if(~at(p) & ~scam).alias(f"{p}_tn"), F.count_if(~at(p) & scam).alias(f"{p}_fn")]
    sums += [F.count_if(F.coalesce("tier", F.lit("INSUFFICIENT")) == t).alias(f"tier_{t}") for t in TIERS]
    m, s, lab, cat = (F.col(c) for c in ("mode", "split", "label", "category"))
    sets = records.groupingSets([[m], [m, s], [m, lab], [m, lab, cat]], m, s, lab, cat).agg(F.grouping_id().alias("set"), *sums)
    # the bits of a set tell which of mode, split, label and category are summed over: 7, 3, 5 and 4
    share = lambda a, b: F.format_string("%.3f", _rate(a, b))

    def summary(p: str) -> Column:
        tp, fp, tn, fn = (F.col(f"{p}_{x}") for x in ("tp", "fp", "tn", "fn"))
        numbers = [F.col("n"), F.lit(p), share(tp, tp + fp), share(tp, tp + fn), share(2 * tp, 2 * tp + fp + fn), share(fp, fp + tn), tp, fp, tn, fn]
        return F.concat(F.lit("| "), F.concat_ws(" | ", m, F.when(F.col("set") == 7, "all").otherwise(s), *[x.cast("string") for x in numbers]), F.lit(" |"))

    line = lambda section, place, text: F.struct(F.lit(section).alias("section"), place.alias("place"), text.alias("line"))
    overall = [line("1 summary", F.concat_ws(" ", F.when(F.col("set") == 7, "").otherwise(s), F.lit(p)), summary(p)) for p in POINTS]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", lab, *[F.col(f"tier_{t}").cast("string") for t in TIERS]), F.lit(" |"))
    flags = lambda p: (F.col(f"{p}_tp") + F.col(f"{p}_fp")).cast("string")
    kinds = F.concat(F.lit("| "), F.concat_ws(" | ", F.concat_ws(":", lab, cat), flags("warn"), flags("interrupt"), F.col("n").cast("string")), F.lit(" |"))
    lines = F.when(F.col("set").isin(7, 3), F.array(*overall)).when(F.col("set") == 5, F.array(line("2 label by tier", lab, cells))).otherwise(F.array(line("3 categories", F.concat_ws(":", lab, cat), kinds)))
    heads = F.array(
        line("1 summary", F.lit(""), F.lit("| mode | split | n | point | precision | recall | F1 | false positives | TP | FP | TN | FN |")),
        line("2 label by tier", F.lit(""), F.lit("| label | " + " | ".join(TIERS) + " |")), line("3 categories", F.lit(""), F.lit("| category | warned | interrupted | n |")),
    )
    tables = sets.select("mode", F.inline(F.when(F.col("set") == 7, F.concat(heads, lines)).otherwise(lines)))
    wrong = why_wrong(records, medium).select("mode", F.lit("4 errors").alias("section"), F.col("id").cast("string").alias("place"), F.concat(F.lit("**"), F.col("id").cast("string"), F.lit("** "), F.col("error"), F.lit(": "), F.col("analysis")).alias("line"))
    return tables.unionByName(wrong)


def containment(df: DataFrame, truth: str, got: str) -> DataFrame:
    return df.withColumn("contained", F.size(F.array_except(truth, got)) == 0)


def status_counts(df: DataFrame) -> DataFrame:
    return df.where("llm_status is not null").groupBy("llm_status").agg(F.count("*").alias("n"))


def merge_modes(new: DataFrame, old: DataFrame) -> DataFrame:
    """New results, and old ones of modes that were not run again."""
    return new.unionByName(old.join(new.select("mode").distinct(), "mode", "left_anti"))
