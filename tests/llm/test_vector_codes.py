"""Product codes against plain Python k-means over integers, and against the SQL."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from ledgerlens.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, Away int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(v, label, [math.floor(4096 * x) for x in e]) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[tuple(e[p * width:(p + 1) * width]) for p in range(parts)] for _, _, e in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((dist(c[p], b), i) for i, b in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        to = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [c[p] for c, t in zip(cut, to) if t[p][1] == i]
                if own:
                    books[p][i] = tuple(sum(x) // len(own) for x in zip(*own))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    to, by_label = assign(), {}
    for (_, label, _), t in zip(kept, to):
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in t)
    return sorted(((v, "".join(f"{i:02x}" for _, i in t), sum(d for d, _ in t), by_label[label], digest) for (v, label, _), t in zip(kept, to)), key=str)


def vectors(n, width, seed):
    r = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in r.normal(0, 0.3, width)], None if i % 7 == 0 else int(i % 3)) for i in r.permutation(n)]


def frame(spark, rows):
    return spark.createDataFrame([(v, e, label, "x", 1) for v, e, label in rows], SCHEMA).repartition(3)


def odd():
    rows = vectors(90, 16, 1)
    rows += [(5, None, 1), (6, [None] + [0.0] * 15, 1), (7, [float("nan")] * 16, 1), (8, [float("inf")] + [1.0] * 15, 2), (None, rows[0][1], None),
             (None, rows[0][1], None), (3, rows[4][1], 2), (3, rows[4][1], 2), (0, [-0.1] * 16, 1)]
    return rows + [(1000 + k, rows[2][1], 1) for k in range(60)]  # one very common vector


@pytest.mark.parametrize("rows", [odd(), vectors(9, 8, 2), vectors(40, 32, 3)], ids=["odd", "few", "wide"])
def test_against_brute_force_and_sql(spark, oracle, rows):
    got = sorted(map(tuple, vector_codes.compressed(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    table = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64", "label": "Int64"})
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in got), key=str) == oracle(vector_codes.sql(), embeddings=table)


def test_empty_tables_and_bad_lengths(spark):
    assert vector_codes.compressed(frame(spark, [])).count() == 0
    assert vector_codes.compressed(frame(spark, [(1, None, 1), (2, [float("nan")], None)])).count() == 0
    for rows in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compressed(frame(spark, rows))


def test_bounds_prune_and_change_nothing():
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (4, 16, 8))
    parts = centres[np.arange(4), r.integers(0, 16, (300, 4))] + r.integers(-60, 60, (300, 4, 8))
    pivots = centres[:, :4]
    away = vector_codes.squares(parts[:, :, None], pivots[None])
    code, error, evaluated = vector_codes.nearest(parts, away, pivots, centres)
    every = vector_codes.squares(parts[:, :, None], centres[None])
    assert (code == every.argmin(axis=2)).all() and (error == every.min(axis=2)).all()
    assert evaluated < every.size / 3
