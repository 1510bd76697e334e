"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from wardline.llm import bpe, decontam, linededup, toxicity
from test_corpus_operators import brute_lines, brute_near, plain_distance, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [rows(docs)]
    for _, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(rows(docs))
    return seen


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    assert all(set(s[0]) == set(stages[0][0]) for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    m = toxicity.Matcher(model)
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in stages[0] if m.score(r["text"]) < 0.5}


def test_boilerplate_lines_go(stages):
    before = sorted(stages[1], key=lambda r: r["doc_id"])
    assert [r["text"] for r in sorted(stages[2], key=lambda r: r["doc_id"])] == [t for _, t in brute_lines(before, linededup.SITES)]


def test_one_of_each_group_stays(stages):
    kept = {i for i, (_, _, k) in brute_near(stages[2]).items() if k}
    assert {r["doc_id"] for r in stages[3]} == kept


def test_benchmark_passages_go(spark, stages):
    items = [decontam.normal(r["text"]) for r in rows(spark.read.parquet(f"{SF}/benchmark.parquet"))]
    left = {r["doc_id"] for r in stages[4]}
    for r in stages[3]:
        t = decontam.normal(r["text"])
        holds = any(i in t for i in items)
        assert not (holds and r["doc_id"] in left)
        if r["doc_id"] not in left:
            assert any(plain_distance(i, t) <= int(len(i) * decontam.RATE) for i in items)


def test_tokens_are_the_librarys(stages):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    for r in stages[5]:
        assert r["token_ids"] == theirs.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) and r["round_trip"]
