"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, centroids, decontam, embeddings, linededup, minhash, negatives, pii, repeats, topk, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = F.transform("removed", lambda r: r["stop"] - r["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("removed") > 0).alias("has_repeats"),
        F.col("shared_words").alias("n_shared_words"),
        F.call_function("make_valid_utf8", F.col("kept").cast("string")).alias("text"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, ranks, pattern, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.col("edits").cast("long").alias("edits"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_minhash_neardup": op10_minhash_neardup,
    "op11_exponion": op11_exponion,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_topk_search": op13_topk_search,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Components of links e(a, b) among ids v(id): the least id that reaches each one.
_REACH = "ab AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(id, root) AS (SELECT id, id FROM v UNION SELECT ab.b, r.root FROM r JOIN ab ON ab.a = r.id), comp AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)"
_BASE32 = " || ".join(f"substr('{_UPPER}234567', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::INTEGER >> {shift}) & 31), 1)" for i in range(8) for shift in (15, 10, 5, 0))

#: Usable vectors as whole numbers, kept as doubles, in which sums of their products are exact.
_WHOLE = "(SELECT *, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0{more})"


def _clusters() -> str:
    """Rounds of assignments a and centroids c, one after the other."""
    k, rounds, dim = centroids.CLUSTERS, centroids.ROUNDS, centroids.DIM
    near = "SELECT vec_id, x, arg_min(num, [d, num]) AS num, min(d) AS d FROM (SELECT v.vec_id, v.x, c.num, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS d FROM v, {c} c) GROUP BY vec_id, x"
    mean = "SELECT {c}.num, coalesce(m.x, {c}.x) AS x FROM {c} LEFT JOIN (SELECT num, list(f ORDER BY i) AS x FROM (SELECT num, i, floor(sum(y) / count(*)) AS f FROM (SELECT num, generate_subscripts(x, 1) AS i, unnest(x) AS y FROM {a}) GROUP BY num, i) GROUP BY num) m USING (num)"
    steps = [f"v AS {_WHOLE.format(scale=64, more=f' AND len(embedding) = {dim}')}", f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS num, x FROM (SELECT x, sha256('{centroids.SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS ({near.format(c=f'c{i}')})")
        if i < rounds:
            steps.append(f"c{i + 1} AS ({mean.format(c=f'c{i}', a=f'a{i}')})")
    last = f"SELECT vec_id, num::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY num))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN (SELECT num, sha256(array_to_string(list_transform(x, lambda y: y::BIGINT), ',')) AS h FROM c{rounds}) USING (num)"
    return "WITH " + ", ".join(steps) + " " + last


_NEGATIVES = f"""WITH v AS (SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM {_WHOLE.format(scale=256, more=" AND label IS NOT NULL")}),
 s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % {negatives.EVERY} = 0),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {negatives.POSITIVES}),
 n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND {negatives.LEAST} * positive_score <= 100 * s.score AND 100 * s.score <= {negatives.MOST} * positive_score)
 SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}"""
_TOP = f"""WITH v AS {_WHOLE.format(scale=64, more="")},
 s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % {topk.EVERY} = 0)
 SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {topk.K}"""

#: What DuckDB says of the same tables. The other operators can't be said in SQL: bytes of a text cut by place, disclosing terms,
#: merges, fitted scores, edit distances within stretches and a tree that is built level by level. Tests hold those against brute force.
ORACLE: dict[str, str] = {
    "op2_warc": f"""SELECT page_id, octet_length(encode(t)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
 FROM (SELECT page_id, t, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS low FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))""",
    "op3_embedding_neardup": f"""WITH RECURSIVE g AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 e AS (SELECT p.id AS a, q.id AS b FROM g p JOIN g q ON p.id < q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.95), v AS (SELECT vec_id AS id FROM embeddings), {_REACH},
 n AS (SELECT a AS id, count(*) AS n_links FROM ab GROUP BY a)
 SELECT v.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN comp USING (id) LEFT JOIN n USING (id)""",
    "op5_line_dedup": f"""WITH l AS (SELECT source, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE source IS NOT NULL),
 b AS (SELECT line FROM l WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY line HAVING least(count(DISTINCT source), count(DISTINCT t)) >= {linededup.SITES}),
 d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, coalesce((SELECT list(line) FROM b), []) AS gone FROM documents)
 SELECT doc_id, (len(parts) - len(kept))::BIGINT AS n_lines_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM (SELECT *, list_filter(parts, lambda x: NOT list_contains(gone, x)) AS kept FROM d)""",
    "op10_minhash_neardup": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh FROM w),
 x AS (SELECT id, len(sh) AS n, unnest(sh) AS g FROM s), p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
 e AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)), v AS (SELECT id FROM s), {_REACH}
 SELECT s.id AS doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.id = component_id AS kept FROM s JOIN comp USING (id)""",
    "op11_exponion": _clusters(),
    "op12_hard_negatives": _NEGATIVES,
    "op13_topk_search": _TOP,
}
