"""The pipeline's stages, each against brute force on its own input, and the registered queries."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup_operators import brute_classes, brute_removed
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from siftwork.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Rows after each stage; the first entry is the input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(90_001, None, "en", "s", None), (90_002, "", "en", "s", 0), (90_003, "12 !? 34", None, None, 8), (90_004, "the " * 30_000, "en", "s", 120_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        out.append(docs.collect())
    return out


def test_stages_keep_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "suffix_dedup", "packing"]
    assert all(tuple(rows[0].asDict()) == corpus_pipeline.COLUMNS for rows in stages[:-1])


def test_language_stage_rejects_texts_without_language(stages):
    before, after = {r["doc_id"]: r for r in stages[0]}, {r["doc_id"] for r in stages[1]}
    assert not after & {90_001, 90_002, 90_003} and 90_004 in after
    assert {i for i, r in before.items() if re.search(r"[^\W\d_]{3}", r["text"] or "")} == after


def test_quality_stage_keeps_good_documents(spark, sf, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = {r["doc_id"] for r in stages[1]}, {r["doc_id"] for r in stages[2]}
    assert after < before
    known = [i for i in before if i in labels]
    assert np.mean([(i in after) == (labels[i] == 1) for i in known]) > 0.9  # learned from some sixty labels
    assert np.mean([i in after for i in known if labels[i] == 1]) > 0.97


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2]]
    kept = {i for (i, _), c in zip(rows, brute_classes(rows), strict=True) if i == c}
    assert {r["doc_id"] for r in stages[3]} == kept


def test_suffix_stage_cuts_repeats(stages):
    rows = stages[3]
    texts = [r["text"].encode() for r in rows]
    want = {}
    for r, t, flags in zip(rows, texts, brute_removed(texts, 200), strict=True):
        left = np.frombuffer(t, np.uint8)[~flags].tobytes().decode("utf-8", "ignore")
        if left:
            want[r["doc_id"]] = (left, len(left))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[4]} == want


def test_packing_stage_is_exact(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 2] for r in stages[4]}
    got: dict = {}
    for r in sorted(stages[5], key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), np.uint32).tolist())
    assert got == want


def test_run_applies_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(sorted(r.asDict())) for r in rows).keys() == {("doc_id", "doc_tokens", "ids", "length", "offset", "sequence_id", "start")}
    assert sum(r["length"] for r in rows) > 0


def test_run_over_no_documents(spark, sf, tmp_path):
    """Every stage of a table without rows gives one without rows."""
    import shutil

    shutil.copy(f"{sf}/labels.parquet", tmp_path / "labels.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered_queries():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14)) and "pipeline" in names


def test_contract_columns(spark, sf):
    """Names, types and whole tables of the queries that a contract fixes."""
    want = {
        "op2_additive_ann": ["query_id bigint", "rank int", "vec_id bigint", "score double"],
        "op3_bm25_packing": ["doc_id bigint", "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint"],
        "op6_pu_quality": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
        "op7_suffix_dedup": ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"],
        "op9_language_id": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
        "op10_bpe_transducer": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
        "op11_source_audit": ["lang string", "source string", "part string", "item string", "value bigint", "rank int"],
        "op12_lexical_search": ["item_id bigint", "rank int", "doc_id bigint", "score bigint"],
        "op13_html_text": ["page_id bigint", "url string", "text string", "n_chars bigint"],
    }
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, columns in want.items():
        df = __spark_entry__.queries()[name](spark, sf)
        assert [f"{c} {t}" for c, t in df.dtypes] == columns
        if name not in ("op2_additive_ann", "op3_bm25_packing", "op11_source_audit", "op12_lexical_search", "op13_html_text"):
            assert df.count() == n


def test_chat_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()["op5_chat_format"])
    names = [d[0] for d in cursor.description]
    df = __spark_entry__.queries()["op5_chat_format"](spark, sf)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(str, cursor.fetchall()))
    row = df.where(F.col("conv_id") == -7).first()
    said = "\\### Assistant: </turn> ok"
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and row["n_turns"] == 2
