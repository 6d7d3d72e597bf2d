"""Stupid-backoff language-model scores, each document by the counts of all others.

A word w after the words u v is worth c(uvw) / c(uv) if the others know uvw,
else ``ALPHA`` times the same with the shorter context, at last the share of w
among their words (at least one occurrence is assumed).  A document's score is
the sum of the logarithms.  Counts are those of the whole corpus less the
document's own, so its own n-grams do not vouch for themselves.

The count tables of all orders are partitioned by hash: each of ``buckets``
tasks holds a range of n-gram hashes.  A chunk of documents explodes its
n-grams, sends the distinct ones with their counts to the buckets, gets the
totals back and sums its documents' scores.  An n-gram travels once per chunk
however often it occurs, so neither a frequent n-gram nor a hot source makes a
task larger: a chunk is bounded by ``CHUNK`` characters (or one document) and a
bucket by the number of buckets, which follows the size of the corpus.  Hashes
travel in blocks (sorted, as compressed differences), not as rows: a row for
each of an input's n-grams takes several times the input on disk.

N-grams are told apart by 64-bit hashes.  Words are runs of characters other
than white space after lower-casing A-Z.  Null text counts as empty: no words,
log_score 0 and no mean.  Every row is a document of its own, so a repeated row
knows its copy's n-grams.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import SENT, chunked, opened, packed, packed_hashes, sender, unpacked, unpacked_hashes
from ledgerlens.llm.common import lower_az, pick

ORDER = 3
ALPHA = 0.4
CHUNK = 6_000_000
BUCKET = 1_500_000
WORD = r"[^\x20\x09-\x0D]+"
ASKED = "chunk string, bucket int, hashes binary, counts binary"
TOLD = "chunk string, bucket int, totals binary"
SCORED = "doc_id bigint, n_words bigint, n_by_order array<bigint>, log_score double"


class Exploded:
    """The n-grams of a chunk: ``keys`` sorted and distinct; ``ends[m]`` the words that end an (m+1)-gram, ``numbers[m]`` which one."""

    def __init__(self, texts: list[str], order: int, placed: bool = True):
        known, words, sizes = {}, [], []
        for t in texts:
            own = t.encode().lower().split()  # of bytes, lower() changes A-Z only and split() cuts at what WORD leaves out
            sizes.append(len(own))
            words.append(np.fromiter((known.setdefault(w, len(known)) for w in own), dtype="int32", count=len(own)))
        self.sizes = np.array(sizes, dtype="int64")
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        digest = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in known]), dtype="<u8")
        hashes = digest[np.concatenate(words)] if words else np.empty(0, dtype="uint64")
        del words, known
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        key, parts, self.ends = np.zeros(len(hashes), dtype="uint64"), [], []
        with np.errstate(over="ignore"):
            for m in range(order):
                end = np.flatnonzero(place >= m)
                # the hash of an m-gram and its next word, mixed
                key[end] = ((hashes[end] if not m else key[end - 1] ^ hashes[end]) + np.uint64(m + 1)) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(29)
                key *= np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(32)
                parts.append(key[end])
                self.ends.append(end)
        del hashes, key, place
        keys, sizes = np.concatenate(parts), [len(e) for e in self.ends]
        del parts
        if placed:
            self.keys, number, self.counts = np.unique(keys, return_inverse=True, return_counts=True)
            self.numbers = np.split(number, np.cumsum(sizes)[:-1])
        else:
            self.keys, self.counts = np.unique(keys, return_counts=True)

    def slices(self, buckets: int) -> np.ndarray:
        """Where each bucket's keys end."""
        bounds = [(b + 1) * 2**64 // buckets for b in range(buckets - 1)]
        return np.append(np.searchsorted(self.keys, np.array(bounds, dtype="uint64")), len(self.keys))

    def others(self, totals: np.ndarray, m: int) -> np.ndarray:
        """For each word, how often the other documents have the (m+1)-gram that ends at it."""
        end, number = self.ends[m], self.numbers[m]
        own = np.ones(len(end), dtype="int64")
        again = np.flatnonzero(self.counts[number] > 1)  # what the chunk has once, its document has once
        _, same, n = np.unique(self.doc[end[again]] * np.int64(len(self.keys)) + number[again], return_inverse=True, return_counts=True)
        own[again] = n[same]
        out = np.zeros(len(self.doc), dtype="int64")
        out[end] = totals[number] - own
        return out


def asker(size: int, order: int, buckets: int):
    def run(batches):
        for name, _, texts in chunked(batches, size):
            x = Exploded(texts, order, placed=False)
            ends, rows, begin = x.slices(buckets), [], 0
            plain = (64 - len(x.keys).bit_length()) // 8  # differences are random up to their mean
            for b, end in enumerate(ends.tolist()):
                if end > begin:
                    keys = x.keys[begin:end]
                    rows.append((name, b, packed_hashes(keys, plain), packed(x.counts[begin:end].astype("uint32"))))
                begin = end
            yield pd.DataFrame(rows, columns=["chunk", "bucket", "hashes", "counts"])

    return run


def totalled(rows: pd.DataFrame) -> pd.DataFrame:
    """The totals of a bucket's hashes, for each chunk in the order it asked."""
    keys = [unpacked_hashes(h) for h in rows["hashes"]]
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unpacked(c, "uint32") for c in rows["counts"]])
    totals = np.bincount(number, weights=counts).astype("uint64")[number]
    parts = np.split(totals, np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "totals": [packed(p) for p in parts]})


def summer(order: int, alpha: float, corpus_words: int):
    def run(sent: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, texts = list(sent["doc_ids"].iloc[0]), opened(sent["texts"].iloc[0])
        x = Exploded(texts, order)
        totals = [unpacked(t, "uint64") for t in told.sort_values("bucket")["totals"]]
        totals = np.concatenate(totals).astype("int64") if totals else np.empty(0, dtype="int64")
        if len(totals) != len(x.keys):
            raise ValueError("a chunk and the totals it was told differ")
        seen = [x.others(totals, m) for m in range(order)]
        rest = np.maximum(1, corpus_words - x.sizes)[x.doc]
        score = np.log(np.maximum(seen[0], 1)) - np.log(rest) + (order - 1) * np.log(alpha)
        level = np.zeros(len(x.doc), dtype="int64")
        for m in range(1, order):
            known = np.flatnonzero(seen[m] > 0)
            score[known] = np.log(seen[m][known]) - np.log(seen[m - 1][known - 1]) + (order - 1 - m) * np.log(alpha)
            level[known] = m
        by_order = np.bincount(x.doc * order + level, minlength=order * len(texts)).reshape(-1, order)
        sums = np.bincount(x.doc, weights=score, minlength=len(texts))
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"), "n_words": x.sizes,
                             "n_by_order": list(by_order), "log_score": sums})

    return run


def scored(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_by_order (words scored with 1, 2, ... words at once), log_score: one row per document."""
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.size(F.regexp_extract_all(lower_az(F.col("text")), F.lit(WORD), F.lit(0)))
    corpus_words = d.agg(F.sum(words)).first()[0] or 0
    buckets = max(1, -(-order * corpus_words // bucket))
    asked = d.mapInPandas(asker(chunk, order, buckets), ASKED)
    told = asked.groupBy("bucket").applyInPandas(totalled, TOLD)
    sent = d.mapInPandas(sender(chunk), SENT)
    return sent.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(summer(order, alpha, corpus_words), SCORED)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_trigram, n_bigram, n_unigram, log_score, mean_log_score."""
    n = F.col("n_by_order")
    return scored(docs).select(
        "doc_id", "n_words", n[2].alias("n_trigram"), n[1].alias("n_bigram"), n[0].alias("n_unigram"),
        F.round("log_score", 4).alias("log_score"),
        F.round(F.try_divide("log_score", "n_words"), 6).alias("mean_log_score"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
     t AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a, len(w) AS n
           FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d)),
     n AS (SELECT count(*) AS total FROM t),
     u AS (SELECT c, r, count(*) AS k, sum(count(*)) OVER (PARTITION BY c) - count(*) AS o FROM t GROUP BY c, r),
     g AS (SELECT b, c, r, sum(count(*)) OVER (PARTITION BY b, c) - count(*) AS o FROM t WHERE i > 1 GROUP BY b, c, r),
     h AS (SELECT a, b, c, r, sum(count(*)) OVER (PARTITION BY a, b, c) - count(*) AS o FROM t WHERE i > 2 GROUP BY a, b, c, r),
     s AS (SELECT t.r, CASE WHEN h.o > 0 THEN 3 WHEN g.o > 0 THEN 2 ELSE 1 END AS m,
                  CASE WHEN h.o > 0 THEN ln(h.o) - ln(p.o) WHEN g.o > 0 THEN ln({ALPHA}) + ln(g.o) - ln(v.o)
                       ELSE 2 * ln({ALPHA}) + ln(greatest(u.o, 1)) - ln(greatest(1, total - n)) END AS x
           FROM n, t JOIN u ON u.c = t.c AND u.r = t.r LEFT JOIN g ON g.b = t.b AND g.c = t.c AND g.r = t.r
           LEFT JOIN h ON h.a = t.a AND h.b = t.b AND h.c = t.c AND h.r = t.r
           LEFT JOIN g p ON p.b = t.a AND p.c = t.b AND p.r = t.r LEFT JOIN u v ON v.c = t.b AND v.r = t.r),
     f AS (SELECT r, count(*) FILTER (m = 3) AS n3, count(*) FILTER (m = 2) AS n2, count(*) FILTER (m = 1) AS n1, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n3, 0) AS n_trigram, coalesce(n2, 0) AS n_bigram, coalesce(n1, 0) AS n_unigram,
       round(coalesce(x, 0.0), 4) AS log_score, round(x / nullif(len(w), 0), 6) AS mean_log_score
FROM d LEFT JOIN f ON f.r = d.r
"""
