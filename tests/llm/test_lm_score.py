"""Language-model scores against plain counting."""

import math
import re
from collections import Counter

import numpy as np

from ledgerlens.llm import lm_score
from ledgerlens.llm.blocks import packed_hashes, unpacked_hashes

SCHEMA = "doc_id bigint, text string, n_words int, chunk string"


def brute(rows):
    docs = [[w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] for _, t in rows]
    grams = [Counter(tuple(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in docs]
    all_ = sum(grams, Counter())
    total = sum(map(len, docs))
    out = []
    for (doc_id, _), w, own in zip(rows, docs, grams):
        c = lambda g: all_[g] - own[g]  # noqa: B023, E731
        s, levels = 0.0, [0, 0, 0]
        for i in range(len(w)):
            tri, bi = tuple(w[i - 2:i + 1]), tuple(w[i - 1:i + 1])
            if i > 1 and c(tri) > 0:
                s, m = s + math.log(c(tri) / c(tri[:2])), 2
            elif i > 0 and c(bi) > 0:
                s, m = s + math.log(0.4 * c(bi) / c(bi[:1])), 1
            else:
                s, m = s + math.log(0.16 * max(1, c((w[i],))) / max(1, total - len(w))), 0
            levels[m] += 1
        out.append((doc_id, len(w), levels, round(s, 6)))
    return sorted(out, key=str)


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], SCHEMA)
    got = [(r.doc_id, r.n_words, r.n_by_order, round(r.log_score, 6)) for r in lm_score.scored(df, **sizes).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A b a b a"), (4, "A b a b a"), (None, "x y z a b"), (5, " \n"), (6, "é x y z w"), (7, "the " * 20_000)]
    check(spark, rows)
    check(spark, rows, chunk=10, bucket=3)


def test_real_documents_in_many_chunks(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    check(spark, rows, chunk=20_000, bucket=5_000)


def test_empty_table(spark):
    check(spark, [])


def test_hashes_travel_plain_below_their_mean_difference():
    rng = np.random.default_rng(3)
    for n, plain in ((0, 8), (1, 7), (20_000, 6), (20_000, 0)):
        keys = np.unique(rng.integers(0, 2**64, n, dtype="uint64"))
        raw = packed_hashes(keys, plain)
        assert (unpacked_hashes(raw) == keys).all() and len(raw) <= len(packed_hashes(keys, 0)) * 1.01 + 64
        assert raw[8:8 + n] == (np.diff(keys, prepend=np.uint64(0)) & np.uint64(255)).astype("uint8").tobytes() or not plain


def test_own_counts_of_repeats_within_and_across_documents():
    x = lm_score.Exploded(["a b a b\va", "", "a b c", "  d"], 3)
    assert x.sizes.tolist() == [5, 0, 3, 2]
    assert x.others(x.counts, 0).tolist() == [1, 1, 1, 1, 1, 3, 2, 0, 0, 0]
    assert x.others(x.counts, 1).tolist() == [0, 1, 0, 1, 0, 0, 2, 0, 0, 0]
