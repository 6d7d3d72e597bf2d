"""The n-gram join against all pairs of exact sets, and the blocked product against plain intersections."""

import re

import numpy as np
import pandas as pd
import pytest

from ledgerlens.llm import linking, ngram_join
from ledgerlens.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, class string, component_id int, Chunk int"


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1) if w else 0)})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if group[i] != group[j] and inter and None not in (rows[i][0], rows[j][0]) and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, len(s), None if d is None else least[g]) for (d, _), s, g in zip(rows, sets, group)), key=str)


def edited(r, words, n, word):
    words = list(words)
    for i in r.choice(len(words), n, replace=False):
        words[i] = word()
    return words


def corpus(seed, copies):
    """Copies of one text with more and more edits, chains of small edits, a common passage in unlike texts, and odd rows."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    base, passage = [word() for _ in range(100)], [word() for _ in range(60)]
    texts = [edited(r, base, int(r.integers(0, 9)), word) for _ in range(copies)]
    for _ in range(4):
        chain = [word() for _ in range(60)]
        for _ in range(10):
            texts.append(chain)
            chain = edited(r, chain, int(r.integers(1, 3)), word)
    texts += [passage + [word() for _ in range(int(r.integers(3, 12)))] for _ in range(copies // 2)]
    texts += [[word() for _ in range(int(r.integers(1, 50)))] for _ in range(20)]
    ids = r.permutation(10 * len(texts))[:len(texts)]
    rows = [(int(d), " ".join(t)) for d, t in zip(ids, texts)]
    rows += [(None, rows[0][1]), (None, None), (-1, None), (-2, ""), (-3, " \n\t"), (-4, "One two"), (-5, "oNE  two\n"), (-6, "One"), (-7, "É é"), (-8, "é É")]
    return rows + [rows[0], rows[0], (rows[1][0], "another text of a known row")]


def run(spark, rows, size=4, percent=85, **more):
    df = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, ngram_join.ngram_classes(df, size, percent, **more).collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"spread": 0, "entries": 500, "chunk": 4000, "bucket": 900}], ids=["pairs", "blocks"])
def test_against_brute_force(spark, more):
    rows = corpus(4, 60)
    assert run(spark, rows, **more) == brute(rows, 4, 85)


def test_other_sizes_and_sql(spark, oracle):
    rows = [r for r in corpus(6, 20)[:-3] if r[0] is not None]
    assert run(spark, rows, 3, 70, spread=0, entries=300) == brute(rows, 3, 70)
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])
    names = ["doc_id", "n_shingles", "component_id"]
    got = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in run(spark, rows)), key=str)
    assert got == oracle(ngram_join.sql(4, 85), documents=docs)


def test_empty_unlinked_and_long(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1)]
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(3, long), (2, long.upper() + " end"), (1, "one two three four five")]
    assert run(spark, rows) == [(1, 2, 1), (2, 19_998, 2), (3, 19_997, 2)]


def test_product_of_blocks():
    r = np.random.default_rng(1)
    x, y = ([r.choice(300, int(r.integers(1, 90)), replace=False).astype("int64") for _ in range(n)] for n in (17, 23))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert linking.overlaps(x, y, width=11).tolist() == want


def test_hot_key_costs_rows_by_block(spark):
    """A key that all sets share: blocks meet, pairs don't."""
    r = np.random.default_rng(3)
    sets = [(i, 40, [int(v) for v in r.choice(10_000, 40, replace=False)]) for i in range(600)]
    sets[7] = (7, 40, sets[3][2][:39] + [20_000])
    scratch = Scratch(spark, "hot")
    held = scratch.write(spark.createDataFrame(sets, "id bigint, n bigint, grams array<bigint>"))
    keys = scratch.write(held.selectExpr("1L AS key", "id", "n"))
    parts = linking.linked(keys, held, 85, scratch, entries=4_000)
    assert sorted(map(tuple, parts.collect())) == [(3, 3), (7, 3)]
    met = [p for p in scratch_tables(spark, scratch) if "-meet" in p]
    assert len(met) == 1 and spark.read.parquet(met[0]).count() <= 7 * 8 / 2  # of 179,700 pairs


def scratch_tables(spark, scratch):
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(scratch.root)
    return [f.getPath().toString() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
