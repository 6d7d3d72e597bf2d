"""Ranked lexical search by dense blocked matrix products.

Item tiles: up to ``ITEMS`` items and their own compact vocabulary, as an
incidence matrix.  Document tiles: up to ``DOCS`` documents, kept sparse as
(document, term, occurrences) over the vocabulary of a block of item tiles and
written once.  For a pair of tiles the impacts of the documents' terms are laid
out densely, document by term, and multiplied with the incidences in float64
(BLAS).  Impacts are integers, and a slice of the vocabulary is so narrow that
its partial sums stay below 2^53, so every product is exact; slices are added
up in 64-bit integers.

Of each product a task keeps an item's ``k`` highest scores, equal ones by
ascending doc_id, so ties at the last place fall as they would over all rows.
What tasks keep meets in two steps: within groups of about the square root of
the number of tiles, then over the groups; no step gathers more than that.

The statistics (number of documents and terms, documents holding a term) cover
all documents.  Items are ranked in blocks of ``BLOCK`` bytes of terms, and
documents are read once for each: one block for a usual benchmark, several for
a large table of items.

A document with null or empty text, or without terms, counts in no statistic
and is never ranked.  Every row is a document of its own: rows that repeat a
doc_id rank one by one, and a null doc_id comes after all others of its score.
Every row of items is ranked by itself, also if it repeats another; an item
without terms has no rows.  Texts of any length are read whole; one document
makes at most one row per item.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import UPPER, Scratch, pick

K = 50
ITEMS, DOCS, ENTRIES, WIDTH = 64, 512, 2_000_000, 4096
BLOCK = 32_000_000
EXACT = 2**53 - 1
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_TILE = "item_ids array<bigint>, terms array<binary>, holders binary, places binary"
DOC_TILE = "doc_ids array<bigint>, lengths binary, n_docs bigint, n_terms bigint, rows binary, terms binary, counts binary"
FOUND = "item bigint, item_id bigint, part bigint, doc_id bigint, score bigint"

#: A-Z to a-z, separators to spaces; every other byte stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def item_tiles(size: int):
    """Items to tiles: which item holds which term of the tile's vocabulary."""

    def tile(ids, sets):
        vocabulary = sorted(set().union(*sets))
        at = {t: i for i, t in enumerate(vocabulary)}
        holders = np.repeat(np.arange(len(sets), dtype="int32"), [len(s) for s in sets])
        places = np.array([at[t] for s in sets for t in s], dtype="int32")
        return pd.DataFrame({"item_ids": [ids], "terms": [vocabulary], "holders": [holders.tobytes()], "places": [places.tobytes()]})

    def run(batches):
        ids, sets = [], []
        for batch in batches:
            for item_id, text in zip(batch["item_id"].astype("Int64"), batch["text"]):
                own = set(terms(text))
                if own:
                    ids.append(None if item_id is pd.NA else int(item_id))
                    sets.append(own)
                if len(sets) == size:
                    yield tile(ids, sets)
                    ids, sets = [], []
        if sets:
            yield tile(ids, sets)

    return run


def blocks(tiles, size: int):
    """Lists of item tiles with about ``size`` bytes of terms."""
    block, held = [], 0
    for t in tiles:
        bytes_ = sum(len(x) + 16 for x in t["terms"])
        if block and held + bytes_ > size:
            yield block
            block, held = [], 0
        block.append(t)
        held += bytes_
    if block:
        yield block


def doc_tiles(vocabulary, docs: int, entries: int):
    """Documents to sparse tiles over the vocabulary (a broadcast: term to number)."""

    def tile(ids, lengths, found):
        sizes = [len(f) for f in found]
        flat = np.array([x for f in found for x in f], dtype="int64").reshape(-1, 2)
        rows = np.repeat(np.arange(len(ids), dtype="uint16"), sizes)
        return pd.DataFrame({
            "doc_ids": [ids], "lengths": [np.array(lengths, dtype="int64").tobytes()], "n_docs": [len(ids)], "n_terms": [sum(lengths)],
            "rows": [rows.tobytes()], "terms": [flat[:, 0].astype("uint32").tobytes()], "counts": [flat[:, 1].astype("uint32").tobytes()]})

    def run(batches):
        number = vocabulary.value
        ids, lengths, found, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                own = terms(text)
                if not own:
                    continue
                ids.append(None if doc_id is pd.NA else int(doc_id))
                lengths.append(len(own))
                found.append([(number[t], n) for t, n in Counter(own).items() if t in number])
                held += len(found[-1])
                if len(ids) == docs or held >= entries:
                    yield tile(ids, lengths, found)
                    ids, lengths, found, held = [], [], [], 0
        if ids:
            yield tile(ids, lengths, found)

    return run


def holding(size: int):
    """In how many of a task's documents each term stands."""

    def run(batches):
        n = np.zeros(size, dtype="int64")
        for batch in batches:
            for raw in batch["terms"]:
                n += np.bincount(np.frombuffer(raw, dtype="uint32"), minlength=size)
        own = np.flatnonzero(n)
        yield pd.DataFrame({"term": own, "n": n[own]})

    return run


def length_part(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of the documents: 50 + (50 * length * n_docs) div n_terms."""
    if 50 * int(lengths.max()) * n_docs < 2**63:
        return 50 + (50 * lengths * n_docs) // n_terms
    return np.array([50 + 50 * n * n_docs // n_terms for n in lengths.tolist()], dtype="int64")


def products(tile: dict, rows: np.ndarray, words: np.ndarray, impact: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """Scores, document by item: dense slices of impacts times incidences, exact in float64."""
    place = tile["number"][words]
    own = place >= 0
    rows, place, impact = rows[own], place[own], impact[own]
    scores = np.zeros((n_rows, len(tile["item_ids"])), dtype="int64")
    for begin in range(0, tile["n_terms"], width):
        end = min(begin + width, tile["n_terms"])
        within = (place >= begin) & (place < end)
        dense = np.zeros((n_rows, end - begin))
        dense[rows[within], place[within] - begin] = impact[within]
        scores += (dense @ tile["incidence"](begin, end)).astype("int64")
    return scores


class Best:
    """The k best documents of each item so far, equal scores by ascending doc_id (null last)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, dtype="int64")
        self.kept = [(np.empty(0, dtype="int64"),) * 3 for _ in range(items)]

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        enough = scores >= self.least[first:first + scores.shape[1]]
        for i in np.flatnonzero(enough.any(axis=0)).tolist():
            own = np.flatnonzero(enough[:, i])
            score, gone, doc = (np.concatenate(x) for x in zip(self.kept[first + i], (scores[own, i], missing[own], ids[own])))
            order = np.lexsort((doc, gone, -score))[:self.k]
            self.kept[first + i] = score[order], gone[order], doc[order]
            if len(order) == self.k:
                self.least[first + i] = score[order[-1]]

    def rows(self, item_ids: list, base: int, part: int):
        for i, (score, gone, doc) in enumerate(self.kept):
            if len(score):
                yield pd.DataFrame({"item": base + i, "item_id": pd.array([item_ids[i]] * len(score), dtype="Int64"), "part": part,
                                    "doc_id": pd.arrays.IntegerArray(doc.copy(), gone.astype(bool)), "score": score})


def scorer(shared, n_docs: int, n_terms: int, base: int, k: int, widest: int, groups: int):
    """Each task's k best documents of each item of the block."""

    def run(batches):
        block, weights = shared.value
        n_words = len(weights)
        tiles, item_ids = [], []
        for t in block:
            number = np.full(n_words, -1, dtype="int64")
            number[t["numbers"]] = np.arange(len(t["numbers"]))
            holders, places = np.frombuffer(t["holders"], dtype="int32"), np.frombuffer(t["places"], dtype="int32")

            def incidence(begin, end, holders=holders, places=places, n=len(t["item_ids"])):
                own = (places >= begin) & (places < end)
                out = np.zeros((end - begin, n))
                out[places[own] - begin, holders[own]] = 1
                return out

            tiles.append({"number": number, "n_terms": len(t["numbers"]), "item_ids": t["item_ids"], "incidence": incidence})
            item_ids += list(t["item_ids"])
        # an impact is less than the largest weight times 10^6
        width = min(widest, max(1, EXACT // max(1, int(weights.max()) * 10**6)))
        best = Best(len(item_ids), k)
        for batch in batches:
            for ids, lengths, rows, words, counts in zip(*(batch[c] for c in ("doc_ids", "lengths", "rows", "terms", "counts"))):
                lengths, rows = np.frombuffer(lengths, dtype="int64"), np.frombuffer(rows, dtype="uint16").astype("int64")
                words, counts = np.frombuffer(words, dtype="uint32"), np.frombuffer(counts, dtype="uint32").astype("int64")
                m = length_part(lengths, n_docs, n_terms)
                impact = weights[words] * ((10**9 * counts) // (1000 * counts + 20 * m[rows]))
                missing = np.array([i is None or i != i for i in ids], dtype="int64")
                doc = np.array([0 if gone else int(i) for i, gone in zip(ids, missing)], dtype="int64")
                first = 0
                for t in tiles:
                    best.add(first, products(t, rows, words, impact, len(lengths), width), doc, missing)
                    first += len(t["item_ids"])
        yield from best.rows(item_ids, base, TaskContext.get().partitionId() % groups)

    return run


def best_of(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, item_rows: int = ITEMS, doc_rows: int = DOCS,
           width: int = WIDTH) -> DataFrame:
    """item (number of the row), item_id, rank, doc_id, score of each item's k best documents."""
    spark, out = docs.sparkSession, None
    scratch = Scratch(spark, "search")
    d = pick(docs, doc_id="bigint", text="string")
    tiles = scratch.write(pick(items, item_id="bigint", text="string").mapInPandas(item_tiles(item_rows), ITEM_TILE), "items")
    base = 0
    for own in blocks(tiles.toLocalIterator(), block):  # a block of bounded size at a time
        number: dict = {}
        packed = [{"item_ids": list(t["item_ids"]), "holders": bytes(t["holders"]), "places": bytes(t["places"]),
                   "numbers": np.array([number.setdefault(bytes(x), len(number)) for x in t["terms"]], dtype="int64")} for t in own]
        vocabulary = spark.sparkContext.broadcast(number)
        sparse = scratch.write(d.mapInPandas(doc_tiles(vocabulary, doc_rows, ENTRIES), DOC_TILE), "docs")
        n_tiles, n_docs, n_terms = sparse.agg(F.count(F.lit(1)), F.sum("n_docs"), F.sum("n_terms")).first()
        if n_docs:
            holds = sparse.select("terms").mapInPandas(holding(len(number)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
            held = np.zeros(len(number), dtype="int64")
            for r in holds.collect():  # at most one row for each term of the block
                held[r["term"]] = r["n"]
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in held.tolist()], dtype="int64")
            shared = spark.sparkContext.broadcast((packed, weights))
            found = sparse.mapInPandas(scorer(shared, n_docs, n_terms, base, k, width, math.isqrt(n_tiles)), FOUND)
            found = best_of(found, k, "item", "part").drop("rank")
            found = scratch.write(best_of(found, k, "item").drop("part"), "found")
            out = found if out is None else out.unionByName(found)
        base += sum(len(t["item_ids"]) for t in packed)
        vocabulary.unpersist()
    if out is None:
        return spark.createDataFrame([], "item bigint, item_id bigint, doc_id bigint, score bigint, rank int")
    return out


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}') AS w FROM documents),
     t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
     l AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY r),
     c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM l),
     f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
     i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}') AS w FROM benchmark),
     q AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(w) AS term FROM i)),
     s AS (SELECT q.item, q.item_id, t.r, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * big_n) // big_l))))) AS BIGINT) AS score
           FROM q JOIN t ON q.term = t.term JOIN f ON f.term = t.term JOIN l ON l.r = t.r, c GROUP BY q.item, q.item_id, t.r),
     k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
           FROM s JOIN d ON d.r = s.r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {K}
"""
