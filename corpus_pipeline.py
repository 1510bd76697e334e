"""A corpus pipeline over documents: toxic ones go, boilerplate lines go, one of each near-duplicate group stays,
documents with benchmark passages go, and what is left is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, decontam, linededup, minhash, toxicity
from wardline.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is fitted on labelled rows of docs that aren't held out.

    A null text scores as the empty one, very long texts are scored whole, and equal texts, repeated rows among them, stay or go
    together; a score of exactly 0.5 goes. Without labels of both kinds every score is the share of toxic ones. An empty table stays
    empty, and further columns stay as they are.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(F.col("text"), model) < 0.5)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share.

    Null and empty texts stay, and so does a document that loses all its lines, as an empty one. Null sources count for nothing;
    repeated rows count as one text; a line on exactly the least number of sources goes; very long texts and lines are taken
    whole. An empty table stays empty, and further columns stay as they are.
    """
    return linededup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates; a row without an id is in no group.

    Null texts and those without words link with nothing and stay. Rows that repeat an id stay or go together. Very long texts
    are compared whole; a similarity of exactly 0.75 links. An empty table stays empty, and further columns stay as they are.
    """
    others = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(written(others, "near-duplicates"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts stay; very long ones are searched whole; an item with exactly as many edits as it may have is held; repeated
    rows stay or go together. Without items all documents stay. An empty table stays empty, and further columns stay as they are.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and whether the ids decode to the text.

    Null and empty texts have no tokens and decode to nothing, which counts as the same; very long texts are encoded whole;
    repeated rows get equal tokens. An empty table stays empty. Further columns are left out.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, decoded="__decoded")
    same = F.col("__decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", encode),
]
#: Toxicity scores, edit distances and token ids can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
