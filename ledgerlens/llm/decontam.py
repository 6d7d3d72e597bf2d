"""Benchmark decontamination by Wu-Manber search over words.

Words are the symbols of the search.  The patterns are the windows of
``size`` consecutive words of the benchmark items (an item of fewer words is
one window).  Patterns of one length share a shift table keyed by blocks of
two words (one for one-word patterns): the table says how far the search may
jump, since no pattern can end before that.  Where the shift is zero, the
suffix block selects the patterns that end with it, and comparing all words
confirms an occurrence.

Benchmark windows are searched in blocks of at most about ``block_rows``
(window, item) rows, so that what is collected and broadcast at a time has a
fixed bound however large the benchmark is; documents are read once per block
and never shuffled with their texts.  Results of several blocks are united
per document.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
Null texts have no words, items without words have no window.  Every row gives
a row; rows that agree in doc_id and text are searched as one and have equal
results.  An item_id that repeats counts once; null item_ids are left out.  An
empty benchmark contaminates nothing.  A long text is searched whole by one
task, which holds its words.  Documents are read once for each block of
benchmark windows: meant for a benchmark, not for two tables of corpus size.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import UPPER, Scratch, lower_az, pick

WINDOW = 13
BLOCK_ROWS = 50_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "doc_id bigint, text_key binary, n_words bigint, places array<bigint>, items array<string>, first boolean"


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (window, item_id); a window is its words joined by blanks."""
    b = pick(benchmark, item_id="string", text="string").where(F.col("item_id").isNotNull())
    words = F.regexp_extract_all(lower_az(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    b = b.select("item_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return b.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("window")).distinct()


class WuManber:
    """Tables of one block of windows; ``find`` yields (start, end, pattern number)."""

    def __init__(self, patterns: list[tuple[str, ...]]):
        by_length = defaultdict(list)
        for k, p in enumerate(patterns):
            by_length[len(p)].append(k)
        self.patterns, self.tables = patterns, []
        for m, ks in sorted(by_length.items()):
            block = min(2, m)
            shift: dict = {}
            bucket = defaultdict(list)
            for k in ks:
                p = patterns[k]
                for end in range(block, m + 1):
                    b = p[end - block:end]
                    shift[b] = min(shift.get(b, m), m - end)
                bucket[p[m - block:]].append(k)
            self.tables.append((m, block, shift, dict(bucket)))

    def find(self, words: list[str]):
        n = len(words)
        for m, block, shift, bucket in self.tables:
            free, i = m - block + 1, m
            jump = shift.get
            while i <= n:
                step = jump((words[i - 2], words[i - 1]) if block == 2 else (words[i - 1],), free)
                if step:
                    i += step
                    continue
                text = tuple(words[i - m:i])
                for k in bucket[text[m - block:]]:
                    if self.patterns[k] == text:
                        yield i - m, i, k
                i += 1


def searcher(shared, everything: bool):
    """Search of one block: a row per document, or with ``everything`` false per document with hits."""

    def run(batches):
        windows = shared.value
        machine = WuManber([tuple(w.split(" ")) for w in windows])
        items = list(windows.values())
        word = re.compile(WORD)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                raw = (text or "").encode()
                words = word.findall(raw.lower().decode())  # of bytes, lower() changes A-Z only
                places, found = set(), set()
                for start, end, k in machine.find(words):
                    places.update(range(start, end))
                    found.update(items[k])
                if everything or places:
                    out.append((doc_id, hashlib.sha256(raw).digest(), len(words), sorted(places), sorted(found), everything))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "n_words", "places", "items", "first"]).astype({"doc_id": "Int64"})

    return run


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text_key, n_words, places (numbers of the hit words), items: one row per document."""
    spark = docs.sparkSession
    d = pick(docs, doc_id="bigint", text="string")
    windows = Scratch(spark, "windows").write(item_windows(benchmark, size))
    blocks = max(1, -(-windows.count() // block_rows))
    found = None
    for b in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == b)
        patterns = defaultdict(list)
        for r in own.collect():  # at most about block_rows rows
            patterns[r["window"]].append(r["item_id"])
        shared = spark.sparkContext.broadcast(dict(patterns))
        hits = d.mapInPandas(searcher(shared, b == 0), FOUND)
        if blocks == 1:
            return hits
        hits = Scratch(spark, "hits").write(hits)
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    return united(found)


def united(found: DataFrame) -> DataFrame:
    """The hits of several blocks for each document; as many rows as the first block has for it."""
    per_doc = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if("first").alias("rows"))
    return per_doc.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("row", "rows")


def text_key(text: Column) -> Column:
    """The text_key of a text, on the JVM side."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key."""
    s = search(docs, benchmark, size, block_rows)
    n_hit = F.size("places").cast("bigint")
    return s.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), "text_key")


SQL = f"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w
           FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
     p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS win
           FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM i WHERE len(w) > 0)),
     n AS (SELECT DISTINCT len(string_split(win, ' ')) AS m FROM p),
     d AS (SELECT row_number() OVER () AS row, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents),
     o AS (SELECT row, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
           FROM (SELECT row, m, w, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, n WHERE len(w) >= m)),
     h AS (SELECT o.row, o.s, o.m, p.item FROM o JOIN p ON o.win = p.win),
     c AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(generate_series(s, s + m - 1)) AS place FROM h) GROUP BY row),
     t AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), FALSE) AS contaminated
FROM d LEFT JOIN c ON d.row = c.row LEFT JOIN t ON d.row = t.row
"""
