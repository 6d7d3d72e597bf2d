"""Repeated strings against plain counting of all windows."""

from collections import Counter

import numpy as np

from ledgerlens.llm import repeats

SCHEMA = "doc_id bigint, text string, kept string, n_bytes int"


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(rows, raws):
        cov = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                cov[i:i + length] = [True] * length
        spans = sum(c and not (i and cov[i - 1]) for i, c in enumerate(cov))
        out.append((doc_id, len(r), sum(cov), spans, bytes(b for b, c in zip(r, cov) if not c)))
    return sorted(out, key=str)


def check(spark, rows, length=200, **how):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(df, length, **how).collect()]
    assert sorted(got, key=str) == brute(rows, length)


def planted(n, seed):
    """Random texts with copies, shared passages with and without edits, and periodic runs."""
    r = np.random.default_rng(seed)
    text = lambda k: "".join(r.choice(list("abcdé "), k))
    passages = [text(int(r.integers(30, 120))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [text(int(r.integers(0, 60)))]
        for _ in range(int(r.integers(0, 4))):
            p = passages[int(r.integers(6))]
            if r.random() < 0.4:
                i = int(r.integers(len(p)))
                p = p[:i] + "#" + p[i + 1:]
            parts += [p[int(r.integers(0, 15)):], text(int(r.integers(0, 40)))]
        if r.random() < 0.1:
            parts.append("xy" * int(r.integers(5, 60)))
        rows.append((k, "".join(parts)))
    return rows + rows[:5]


def test_small_windows(spark, monkeypatch):
    rows = planted(60, 1) + [(None, None), (900, ""), (901, "a" * 300), (902, "short")]
    check(spark, rows, 24, seed=16, chunk=900, bucket=50)
    check(spark, rows, 24, seed=16, many=2, chunk=900, bucket=50)
    monkeypatch.setattr(repeats, "BLOCK", 500)  # several blocks to a chunk
    check(spark, rows, 24, seed=20, many=0, chunk=100_000)
    check(spark, rows, 24, seed=20, many=3, chunk=2_000)


def test_whole_length(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(70).collect()]
    rows += [(1000 + k, "u" * k + rows[3][1] + str(k) + rows[5][1][10:]) for k in range(4)]
    check(spark, rows, chunk=30_000, bucket=2_000)


def test_empty_table(spark):
    check(spark, [])


def test_merge_of_transforms():
    strings = [b"abracadabra", b"cadabrabra", b"abra"]
    classes, text_end = repeats.merged(strings, 4)
    data = b"".join(strings)
    for i in range(len(data)):
        for j in range(len(data)):
            assert (classes[i] == classes[j]) == (data[i:min(text_end[i], i + 4)] == data[j:min(text_end[j], j + 4)])
