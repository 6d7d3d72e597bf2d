"""Line dedup by site-relative frequency (native).

A line is boilerplate on a host when it stands on at least ``min_pages`` of
the host's pages and on more than ``percent`` per cent of them.  Pages are
reduced to distinct lines before anything is shuffled, lines are counted per
(host, line) with map-side combining, and what is left after the threshold is
small: on average a host has at most (distinct lines of a page) * 100 /
``percent`` such lines.  The lists are written to the shared folder and join the
pages by host; Spark broadcasts the written table only when its size allows
(pages are then not shuffled), and otherwise can split a hot host's pages.

Lines end at ``\\n``; blank lines are never dropped.  Null text counts as empty
and null host as the host named ''.  Every row gives a row, repeated rows count
as pages of their own, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, pick

PERCENT = 5
MIN_PAGES = 2  # a line must repeat at all; the ratio decides


def boilerplate(pages: DataFrame, percent: int, min_pages: int) -> DataFrame:
    """host, lines: the boilerplate lines of each host that has any."""
    lines = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).where(F.trim("line") != "")
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return (
        often.join(totals, "host").where(F.col("n") * 100 > F.col("pages") * percent)
        .groupBy("host").agg(F.collect_list("line").alias("drop"))
    )


def clean_lines(docs: DataFrame, percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """Documents' columns plus n_lines and n_removed; ``text`` without boilerplate lines."""
    names = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
    pages = pick(docs, **names).select(
        "doc_id", "lang", "source", F.coalesce("source", F.lit("")).alias("host"),
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("drop", x)))
    lists = Scratch(docs.sparkSession, "boilerplate").write(boilerplate(pages, percent, min_pages))
    return (
        pages.join(lists, "host", "left")
        .select("doc_id", "lang", "source", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept"))
        .select("doc_id", F.array_join("kept", "\n").alias("text"), "lang", "source", "n_lines",
                (F.col("n_lines") - F.size("kept")).alias("n_removed"))
    )


def line_report(docs: DataFrame, percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    return clean_lines(docs, percent, min_pages).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH p AS (SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p)
           WHERE trim(line) <> '' GROUP BY host, line),
     t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
     b AS (SELECT c.host, list(line) AS dropped FROM c JOIN t ON c.host = t.host
           WHERE n >= {MIN_PAGES} AND n * 100 > pages * {PERCENT} GROUP BY c.host),
     k AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)) AS kept
           FROM p LEFT JOIN b ON p.host = b.host)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""
