"""Operators with oracle SQL on a small table of odd rows: nulls, empties, ties, repeated rows, clashing names, empty tables."""

import pandas as pd
import pytest

from ledgerlens.llm import decontam, exact_dedup, license_scan, line_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Keep_id int, digest string, drop string"
FOOT = "common foot line of the site"


def odd_rows():
    rows = [(1, None, None), (2, "", "a"), (3, None, "a"), (None, "Abc", "a"), (None, None, None), (4, "aBC", "b"), (5, "ABC", None),
            (5, "ABC", None), (6, "É", "a"), (7, "é", "a"), (8, "É", "b"), (9, "x " * 30_000, "b"), (9, "x " * 30_000 + "y", "b"),
            (10, "Released under the MIT Licence!\n\nbody", "a"), (11, "  all RIGHTS reserved.", "a"), (12, "copyright 2020 me\nMIT", "b"),
            (13, "licence licence\n© 2001\nLicensed under CC-BY-NC 4.0", "a"), (14, "one\n\n\ntwo\r\nthree", "b"), (15, "\n\n", "b")]
    rows += [(100 + k, f"text {k}\n{FOOT}\n{FOOT}\nmore {k % 7}", "site") for k in range(20)]
    rows += [(200 + k, "The quick brown fox jumps over the lazy dog and runs far away today, ok? " + "pad " * k, "site") for k in range(6)]
    return [(d, t, "en", s, 0, 1, "x", "y") for d, t, s in rows]


BENCH = [(1, "quick brown fox jumps over the lazy dog and runs far away today"), (2, "the quick brown fox jumps over the lazy dog and runs far away"),
         (3, "Abc"), (3, "Abc"), (4, None), (5, " ... "), (None, "pad"), (10, "over the lazy"), (20, "over the lazy"), (6, "É"), (7, "x x x")]


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [odd_rows(), []], ids=["odd", "empty"])
def test_operators_match_their_sql(spark, oracle, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    docs = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "text": "string", "source": "string"})
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    items = pd.DataFrame(BENCH, columns=["item_id", "text"]).astype({"item_id": "Int64", "text": "string"})
    assert rows_of(exact_dedup.exact_groups(df, salts=3)) == oracle(exact_dedup.SQL, documents=docs)
    assert rows_of(line_dedup.line_report(df)) == oracle(line_dedup.SQL, documents=docs)
    assert rows_of(license_scan.scan(df)) == oracle(license_scan.sql(), documents=docs)
    want = oracle(decontam.SQL, documents=docs, benchmark=items)
    for block_rows in (50_000, 3):
        assert rows_of(decontam.contamination(df, bench, block_rows=block_rows).drop("text_key")) == want


def test_empty_benchmark(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    out = decontam.contamination(df, spark.createDataFrame([], "item_id bigint, text string")).collect()
    assert len(out) == len(odd_rows()) and not any(r.contaminated or r.n_hit for r in out)


def test_boilerplate_goes_and_other_lines_stay(spark):
    out = {r.doc_id: r for r in line_dedup.clean_lines(spark.createDataFrame(odd_rows(), SCHEMA)).collect()}
    # 26 pages of the host: the foot line is on 20 of them, "more 0" on three
    assert out[100].text == "text 0" and out[100].n_removed == 3 and out[14].n_removed == 0


def test_small_hosts_lose_their_boilerplate(spark, oracle):
    rows = [(k, f"page {k}\nfoot\nhead", "en", f"host{k // 3}", 0, 1, "x", "y") for k in range(9)] + [(20, "alone\nfoot", "en", "one", 0, 1, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.text for r in line_dedup.clean_lines(df).collect()}
    assert out == {k: f"page {k}" for k in range(9)} | {20: "alone\nfoot"}
    docs = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    assert rows_of(line_dedup.line_report(df)) == oracle(line_dedup.SQL, documents=docs)
