"""Near-dedup against all pairs of exact sets."""

import re
import zlib

import numpy as np

from ledgerlens.llm import near_dedup

SCHEMA = "doc_id bigint, text string, class string, component_id int"


def brute(rows, size):
    sets = []
    for doc_id, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        n = max(1, len(w) - size + 1) if w else 0
        sets.append({tuple(w[i:i + size]) for i in range(n)})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and None not in (rows[i][0], rows[j][0]) and 100 * inter >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for (doc_id, _), s, g in zip(rows, sets, group):
        comp = min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None)
        comp = None if doc_id is None else comp
        out.append((doc_id, len(s), comp, comp == doc_id))
    return sorted(out, key=str)


def check(spark, rows, size):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    got = sorted(map(tuple, near_dedup.near_groups(df, size).drop("text_key").collect()), key=str)
    assert got == brute(rows, size)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    check(spark, [(5, None), (6, ""), (7, " \n\t"), (1, "A b"), (2, "a B"), (2, "a B"), (None, "a b"), (None, "a b"), (3, "a b c d"),
                  (4, "a b c d e"), (8, "É x y z"), (9, "é x y z"), (10, long), (11, long + " end"), (12, long.upper())], 4)


def test_chains_and_stars(spark):
    """Chains of small edits (linked only step by step) and a large group of near copies that isn't all linked."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows = []
    for g in range(6):
        words = [word() for _ in range(60)]
        for step in range(14):
            rows.append((int(r.integers(10**9)), " ".join(words)))
            words = list(words)
            for _ in range(int(r.integers(1, 4))):
                words[int(r.integers(60))] = word()
    base = [word() for _ in range(80)]
    for k in range(70):
        words = list(base)
        for i in r.choice(80, int(r.integers(0, 7)), replace=False):
            words[i] = word()
        rows.append((int(r.integers(10**9)), " ".join(words)))
    check(spark, rows, 4)
    check(spark, rows, 5)


def test_hot_near_copies_and_hot_unlike_bucket(spark):
    """A group of near copies around the threshold, and texts that share most of one passage but no link."""
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(90)], []
    for k in range(160):
        words = list(base)
        for i in r.choice(120, int(r.integers(0, 11)), replace=False):
            words[i] = word()
        rows.append((int(r.integers(10**9)), " ".join(words)))
        rows.append((int(r.integers(10**9)), " ".join(passage + [word() for _ in range(int(r.integers(14, 25)))])))
    check(spark, rows, 4)


def test_empty_texts_beside_near_copies(spark):
    """Empty documents in the same batch leave the others' classes as they are."""
    r = np.random.default_rng(5)
    rows = []
    for k in range(12):
        words = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(90)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words, "end"])), (10 * k + 2, None if k % 2 else "")]
    check(spark, rows, 4)


def test_empty_and_unlinked(spark):
    check(spark, [], 4)
    check(spark, [(1, "one two three four five"), (2, "six seven eight nine ten")], 5)


def test_signature_is_stable():
    s = near_dedup.shingles("a b c d e f", 4)
    assert len(s) == 3 and zlib.crc32(near_dedup.signature(s, 8).tobytes()) == zlib.crc32(near_dedup.signature(s, 8).tobytes())
