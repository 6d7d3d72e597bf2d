"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from ledgerlens.llm import bpe, decontam, line_dedup, toxicity
from test_near_dedup import brute as near_brute

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's output, written and read again."""
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DIR).write.parquet(path)
        out.append((docs.toPandas(), docs := spark.read.parquet(path)))
    return [(before, after.toPandas()) for before, after in out]


def ids(df):
    return sorted(df["doc_id"])


def test_columns(steps):
    for _, after in steps[:-1]:
        assert list(after.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark, steps):
    before, after = steps[0]
    rated = toxicity.rated(spark.createDataFrame(before, DOCS), spark.read.parquet(f"{DIR}/labels.parquet")).toPandas()
    assert ids(after) == ids(rated[rated.predicted == 0]) and 0 < len(after) < len(before)


def test_line_dedup(steps):
    before, after = steps[1]
    con = duckdb.connect()
    con.register("documents", before)
    want = {r[0]: r[3] for r in con.sql(line_dedup.SQL).fetchall()}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in zip(after.doc_id, after.text)} == want
    assert (after.n_chars == after.text.str.len()).all() and len(after) == len(before)


def test_near_dedup(steps):
    before, after = steps[2]
    want = [r[0] for r in near_brute(list(zip(before.doc_id.tolist(), before.text)), 5) if r[3]]
    assert ids(after) == sorted(want) and len(after) < len(before)


def test_decontamination(steps):
    before, after = steps[3]
    con = duckdb.connect()
    con.register("documents", before)
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DIR}/benchmark.parquet'")
    bad = {r[0] for r in con.sql(f"SELECT doc_id FROM ({decontam.SQL}) WHERE contaminated").fetchall()}
    assert ids(after) == sorted(set(before.doc_id) - bad) and bad


def test_byte_bpe(steps):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    before, after = steps[4]
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANK_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = after.set_index("doc_id")
    for d, t in zip(before.doc_id, before.text):
        assert bytes(got.ids[d]) == np.array(library.encode_ordinary(t), dtype="<u4").tobytes()
        assert got.decoded_sha256[d] == hashlib.sha256(t.encode()).hexdigest()


def test_odd_rows_pass(spark):
    """Nulls, empty texts and repeated rows go through all stages; an empty table gives empty ones."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, None, None, None, None), (None, "a b c d e f", "en", "s", 11),
            (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "A b c d e f", "en", "s", 11)]
    for rows, want in ((rows, [None, None, 1, 2, 3]), ([], [])):
        docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "N_Chars").selectExpr("*", "1 AS kept", "2 AS text_key")
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), stage(spark, docs, DIR).schema)
        assert sorted([r.doc_id for r in docs.collect()], key=str) == sorted(want, key=str)


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, DIR).toPandas()
    assert ids(got) == ids(steps[-1][1]) and isinstance(got, pd.DataFrame)
