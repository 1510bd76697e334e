"""URL filters: rules by host and path, and for all other URLs a path-template tree with smoothed labelled purity.

The tree is built from branching to branching as DataFrames, from counts by host and path. Below each node of a host's tree a
segment that is variable by form (digits, hexadecimal or a date) becomes a wildcard; siblings whose smoothed share of blocked labels
can't be told from the node's become one branch, those with few labels or none too, and what is left of very many siblings
becomes a wildcard. The leaves are the templates, and a template whose smoothed share of blocked labels is high enough is rejected.

What a branch lacks in labels of its own it takes from around it. The labels are a table of labelled URLs or, without one, what
the rules say of the URLs that they fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import salted_lookup, written

#: A node with more distinct children than this, seen fewer than RARE times each on average, has variable children.
CHILDREN, RARE = 16, 4.0
#: Two shares differ if they are this many standard errors apart.
Z = 1.96
#: Weight and value of the prior share, and the smoothed share from which a template is rejected.
PRIOR_ROWS, PRIOR_SHARE, PURITY = 2.0, 0.5, 0.8
#: Wildcards in templates, with a character that no path has: any segment, siblings in one, what lies below all labels.
ANY, LIKE, DEEPER = "?", "?~", "?+"
#: The rules of the contract, as (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_VARIABLE = r"^(?:[0-9]+(?:\.[A-Za-z]{1,5})?|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2})?)$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case and path; both empty where the url is null or has no "://"."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its verdict; null where none fits. Rules are a short configured list."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def templates(paths: DataFrame) -> DataFrame:
    """The leaf template of each row of (host, path, n, labelled, blocked), one row for each host and path, in column template, and
    in column prior the share of blocked labels expected from around the template.

    A node's prior comes from the labels outside it, the nearest first: ((b outside, below its parent) + PRIOR_ROWS *
    (the parent's prior)) / ((l outside, below its parent) + PRIOR_ROWS), so no label counts twice. Children whose smoothed share can't
    be told from the node's become one branch, those without labels too. The tree grows to the end of the deepest
    labelled path: what lies deeper has no labels to tell it apart. A chain of single children, which leaves the prior as it is,
    is passed in one step, so a path costs a round for each node on it where others leave it, however long it is.
    """
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(_VARIABLE), ANY).otherwise(s))
    paths = written(paths.withColumn("rest", segments), "labelled-paths")
    depth = paths.where("labelled > 0").agg(F.max(F.size("rest"))).first()[0] or 0
    cut = F.when(F.size("rest") > depth, F.concat(F.slice("rest", 1, depth), F.array(F.lit(DEEPER)))).otherwise(F.col("rest"))
    tree = paths.withColumn("rest", cut).withColumn("template", F.lit("")).withColumn("prior", F.lit(PRIOR_SHARE))
    done = None
    while True:
        # "" stands for paths that end at the node
        at = tree.withColumn("seg", F.coalesce(F.get("rest", F.lit(0)), F.lit(""))).withColumn("tail", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))))
        child = at.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.min("prior").alias("prior"), F.min("tail").alias("low"), F.max("tail").alias("high"))
        inner = F.col("seg") != ""
        node = child.groupBy("host", "template").agg(F.count_if(inner).alias("kinds"), F.sum(F.when(inner, F.col("n"))).alias("nn"), F.sum("l").alias("nl"), F.sum("b").alias("nb"))
        share = (F.col("nb") + PRIOR_ROWS * F.col("prior")) / (F.col("nl") + PRIOR_ROWS)
        far = F.abs((F.col("b") + PRIOR_ROWS * share) / (F.col("l") + PRIOR_ROWS) - share) > Z * F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) / (F.col("l") + PRIOR_ROWS))
        many = (F.col("kinds") > CHILDREN) & (F.col("nn") < RARE * F.col("kinds"))
        name = F.when(F.col("seg").isin("", ANY, DEEPER), F.col("seg")).when(many & (F.col("l") == 0), ANY).when((F.col("kinds") > 1) & ~far, LIKE).otherwise(F.col("seg"))
        names = child.join(node, ["host", "template"]).withColumn("name", name)
        # the least and the greatest of a branch's tails begin alike as far as all of them do
        differ = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        around = names.groupBy("host", "template", "name").agg(((F.min("nb") - F.sum("b") + PRIOR_ROWS * F.min("prior")) / (F.min("nl") - F.sum("l") + PRIOR_ROWS)).alias("around"), F.min("low").alias("low"), F.max("high").alias("high"))
        around = around.select("host", "template", "name", "around", F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int").alias("alike"), (differ == 0).alias("alone"))
        names = names.select("host", "template", "seg", "name").join(around, ["host", "template", "name"])
        grown = F.when(F.col("name") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), F.array_join(F.concat(F.array("name"), F.slice("tail", F.lit(1), F.col("alike"))), "/")))
        rest = F.when(~F.col("alone") & (F.col("name") != ""), F.slice("tail", F.col("alike") + 1, F.size("tail")))
        step = at.join(names, ["host", "template", "seg"]).select("host", "path", "n", "labelled", "blocked", rest.alias("rest"), grown.alias("template"), F.col("around").alias("prior"))
        step = written(step, "template-tree")
        ended, tree = step.where("rest is null").drop("rest"), step.where("rest is not null")
        done = ended if done is None else done.union(ended)
        if tree.isEmpty():
            return done


def judge(pages: DataFrame, rules=RULES, url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """pages with host, path, template, rule and verdict (allow or block). labels has (url, verdict), pages or others.

    A rule's verdict holds where a rule fits; without labels the rules' verdicts are also the labels of the tree. Elsewhere the
    template decides: blocked if (blocked + PRIOR_ROWS * prior) / (labelled + PRIOR_ROWS) reaches PURITY, where the prior is the
    share expected from around the template and PRIOR_SHARE on a host without labels. So a host without any is allowed, and a branch
    without any goes as its host does. With labels a rule's matches say nothing about other URLs. Rows are counted by host and path before
    anything is dealt out by host, so a host with a third of all pages costs as many rows as it has paths; the verdicts by host and
    path are joined back over salts.

    Null and odd urls have empty host and path and are judged like a host of that name; very long urls are read whole, and the
    tree is as deep as the deepest labelled path; a share of exactly PURITY blocks, and of several rules of one length the least by text
    holds; repeated rows get equal verdicts; an empty table gives no rows. Columns of pages called host, path, template, rule or
    verdict are replaced; others may have any name.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "template", "rule", "verdict")]
    names = [f"`{c.replace('`', '``')}`" for c in kept]
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*names).alias("row"), host.alias("host"), path.alias("path"), F.xxhash64(*names).alias("deal"))
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    known = F.col("says").isNotNull() if labels is None else F.lit(False)
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(known).alias("labelled"), F.count_if(known & (F.col("says") == "block")).alias("blocked"))
    if labels is not None:
        host, path = host_and_path(F.col("url"))
        given = labels.where(F.col("verdict").isin("allow", "block")).select(host.alias("host"), path.alias("path"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("labelled"), (F.col("verdict") == "block").cast("long").alias("blocked"))
        paths = given.unionByName(paths).groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    leaves = templates(paths)
    purity = leaves.groupBy("host", "template").agg(((F.sum("blocked") + PRIOR_ROWS * F.min("prior")) / (F.sum("labelled") + PRIOR_ROWS)).alias("purity"))
    # a template may hold a third of all paths; what is repeated for every salt is shuffled and never broadcast
    verdicts = salted_lookup(leaves, purity.hint("merge"), ["host", "template"], ["path"]).select("host", "path", "template", F.when(F.col("purity") >= PURITY, "block").otherwise("allow").alias("by_tree"))
    judged = salted_lookup(rows, written(verdicts, "verdicts"), ["host", "path"], ["deal"])
    return judged.select("row.*", "host", "path", "template", "rule", F.coalesce("says", "by_tree").alias("verdict"))
