"""Stems are chosen over all qualifying features, however many there are, and copies do not crowd them out."""

import zlib

import numpy as np

from ledgerlens.llm import toxicity
from ledgerlens.llm.common import Scratch


def corpus(tail):
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    long = " ".join(word() for _ in range(2000))
    texts = [(f"{long} {tail(k)}", 1) for k in range(20)] + [(f"what a vilzork {word()} {word()}", 1) for _ in range(5)]
    return texts + [(f"a fine {word()} {word()}", 0) for _ in range(200)]


def learned(spark, texts):
    ids = iter(k for k in range(10_000) if zlib.crc32(str(k).encode()) % 5)
    rows = [(next(ids), t, label) for t, label in texts]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    return toxicity.learn(docs, spark.createDataFrame([(k, label) for k, _, label in rows], "doc_id bigint, toxic int")).stems


def test_long_copies_leave_other_stems(spark):
    same, near = learned(spark, corpus(lambda k: "")), learned(spark, corpus(lambda k: f"tail{k:04d}"))
    assert list(same) == ["vilzork~"]
    assert len(near) == 2 and "vilzork~" in near


def test_blocks_choose_as_one_search(spark):
    r = np.random.default_rng(8)
    texts = [(bool(k % 3), sorted({f"f{int(i):02d}{'$~'[int(i) % 2]}" for i in r.integers(0, 40, 3)})) for k in range(150)]
    weight = {f: 1.0 for _, found in texts for f in found}
    want = toxicity.cover(texts, weight)
    edges = spark.createDataFrame([(k, t, f) for k, (t, found) in enumerate(texts) for f in found], "k bigint, toxic boolean, feature string")
    odds = spark.createDataFrame([(f, float(np.e)) for f in weight], "feature string, odds double")
    assert len(want) > 4
    for block in (5, 1000):
        assert list(toxicity.covered(edges, odds, Scratch(spark, "test"), block)) == list(want)
