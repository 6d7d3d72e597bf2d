"""Ranked search against plain Python and the SQL; tiles, slices, blocks and ties change nothing."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from ledgerlens.llm import ranked_search

DOCS = "doc_id bigint, text string, score int, Doc_ids string"
ITEMS = "item_id bigint, text string, rank int"
FIND = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return FIND.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    tf = [(d, Counter(words(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n_docs, total = len(tf), sum(n for _, _, n in tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in tf:
            m = 50 + 50 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(words(text)) & set(c))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def odd():
    r = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "naïve", "9"]
    p = 1 / np.arange(1, 65)
    text = lambda n: " ".join(r.choice(vocabulary, n, p=p / p.sum()))
    docs = [(int(d), text(int(r.integers(1, 40)))) for d in r.permutation(150)]
    docs += [(None, docs[0][1]), (None, docs[0][1]), (3, docs[5][1]), (3, docs[5][1]), (500, None), (501, ""), (502, " .,;\n"),
             (503, "w1 " * 30_000 + "W1-w2_w3"), (504, "É W1"), (505, "w1[w2]{w3}@9"), (506, " w59 ")]
    docs += [(600 + k, "w1 w2 w3") for k in range(60)]  # more ties than places
    items = [(1, "w1 W2 w2"), (1, "w1 W2 w2"), (None, "w50, w51 É"), (4, None), (5, "..."), (6, "unknown words"), (7, text(80)), (8, "é 9"), (9, "w59")]
    return docs, items


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], DOCS).repartition(5)
    i = spark.createDataFrame([(a, b, 1) for a, b in items], ITEMS).repartition(2)
    got = ranked_search.search(d, i, **more)
    assert dict(got.dtypes)["rank"] == "int"
    return sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_against_brute_force_and_sql(spark, oracle):
    docs, items = odd()
    want = brute(docs, items, 50)
    got = run(spark, docs, items)
    assert got == want
    tables = {"documents": pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}),
              "benchmark": pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"})}
    names = ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in got), key=str) == oracle(ranked_search.SQL, **tables)


@pytest.mark.parametrize("more", [{"block": 100, "item_rows": 2}, {"width": 3, "doc_rows": 7}, {"k": 4, "doc_rows": 1}], ids=["blocks", "slices", "few"])
def test_tiles_change_nothing(spark, more):
    docs, items = odd()
    assert run(spark, docs, items, **more) == brute(docs, items, more.get("k", 50))


def test_empty_tables(spark):
    docs, items = odd()
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_large_corpora_stay_in_64_bits():
    lengths = np.array([10**7, 3], dtype="int64")
    assert ranked_search.length_part(lengths, 3 * 10**11, 10**14).tolist() == [50 + 50 * 10**7 * 3 * 10**11 // 10**14, 50 + 50 * 3 * 3 * 10**11 // 10**14]
