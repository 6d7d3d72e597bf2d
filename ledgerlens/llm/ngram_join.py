"""N-gram Jaccard join: a blocked sparse product of documents by n-gram incidence.

The incidence matrix is cut into chunks of documents and buckets of n-gram
hashes.  A chunk asks each bucket for its distinct n-grams, with the number of
its documents that hold them, and is told how many documents of the corpus do;
an n-gram travels once per chunk however many documents hold it.  An n-gram of
one document adds to no overlap.  This gives two bounds from sizes alone:

* a document's n-grams that others hold are at most its overlap with any other,
  so a document with fewer than ``percent`` of its size is linked with nothing;
* of two linked documents each has a shared n-gram among its
  size - ceil(percent * size) + 1 rarest ones, so only these are columns in which
  candidates meet (ordered by frequency, then hash).

Candidates are resolved by `linking`: products of blocks of documents add up the
overlap counts, pairs below the bounds of their sizes are discarded, and pairs
that are connected already are not made.

Documents with equal sets form a class: a chunk asks for each of its classes
once, and only classes go on.  A class with copies in several chunks may pass
the first bound by them, which costs a row and no link.  N-grams are told apart
by 64-bit hashes.  Null text counts as empty.  Documents without words
have n_shingles 0 and stand alone; fewer words than an n-gram make one.  Rows
with a null doc_id stand alone with a null component_id.  Rows that repeat a
doc_id each give a row and are judged by their own texts.  A long text is one
document of a chunk and is read whole.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import chunked, opened, packed, unpacked
from ledgerlens.llm.common import Scratch, pick
from ledgerlens.llm.linking import linked

#: Lower-cases A-Z and turns the separators (space and 0x09 to 0x0D) into spaces.
SPACES = bytes(range(9, 14))
FOLD = bytes(32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK, BUCKET = 6_000_000, 2_000_000
WORDS_AT_HAND = 500_000
CHUNKED = "chunk string, doc_ids array<bigint>, sizes array<bigint>, classes array<bigint>, texts binary"
ASKED = "chunk string, bucket bigint, hashes binary, counts binary"
TOLD = "chunk string, bucket bigint, totals binary"
HELD = "id bigint, n bigint, grams array<bigint>, columns array<bigint>"


class WordHashes(dict):
    """Hashes of words, each made once while it is at hand; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_AT_HAND:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def ngrams(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """The set of hashed n-grams of a text, sorted, as unsigned 64-bit integers."""
    words = text.encode().translate(FOLD).split()
    if not words:
        return np.empty(0, dtype="uint64")
    digest = np.fromiter(map(hashes.__getitem__, words), dtype="uint64", count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype="uint64")
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out + digest[k:k + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def writer(size: int, chunk: int):
    """Documents to chunks: their set sizes, classes (0 for an empty set) and compressed texts."""

    def run(batches):
        hashes = WordHashes()
        for name, ids, texts in chunked(batches, chunk):
            sets = [ngrams(t, size, hashes) for t in texts]
            raw = [t.encode() for t in texts]
            head = np.array([len(raw), *map(len, raw)], dtype="int64").tobytes()
            yield pd.DataFrame({"chunk": [name], "doc_ids": [ids], "sizes": [[len(s) for s in sets]],
                                "classes": [[class_of(s) if len(s) else 0 for s in sets]], "texts": [zlib.compress(head + b"".join(raw), 6)]})

    return run


class Incidence:
    """The n-grams of a chunk's classes: ``grams`` sorted and distinct; of each entry its class and which gram it is."""

    def __init__(self, texts: bytes, doc_ids, classes, size: int, hashes: WordHashes):
        every, own = opened(texts), {}
        for i, (doc_id, c) in enumerate(zip(doc_ids, classes)):
            if c and doc_id is not None and doc_id == doc_id:
                own.setdefault(c, i)
        self.classes = list(own)
        sets = [ngrams(every[i], size, hashes) for i in own.values()]
        self.sizes = np.array([len(s) for s in sets], dtype="int64")
        self.row = np.repeat(np.arange(len(sets)), self.sizes)
        self.grams, self.number = np.unique(np.concatenate([np.empty(0, dtype="uint64"), *sets]), return_inverse=True)


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so they ascend with them."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def asker(size: int, buckets: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for name, texts, doc_ids, classes in zip(*(batch[c] for c in ("chunk", "texts", "doc_ids", "classes"))):
                x = Incidence(texts, doc_ids, classes, size, hashes)
                counts = np.bincount(x.number, minlength=len(x.grams)).astype("uint32")
                bucket = bucket_of(x.grams, buckets)
                begins = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))  # of buckets that occur
                rows = [(name, int(bucket[b]), packed(np.diff(x.grams[b:e], prepend=np.uint64(0))), packed(counts[b:e]))
                        for b, e in zip(begins.tolist(), [*begins[1:].tolist(), len(x.grams)])]
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "hashes", "counts"])

    return run


def totalled(rows: pd.DataFrame) -> pd.DataFrame:
    """In how many documents a bucket's n-grams stand, for each chunk in the order it asked."""
    grams = [np.cumsum(unpacked(h, "uint64"), dtype="uint64") for h in rows["hashes"]]
    _, number = np.unique(np.concatenate(grams), return_inverse=True)
    counts = np.concatenate([unpacked(c, "uint32") for c in rows["counts"]])
    totals = np.bincount(number, weights=counts).astype("uint64")[number]
    parts = np.split(totals, np.cumsum([len(g) for g in grams])[:-1])
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "totals": [packed(p) for p in parts]})


def holder(size: int, percent: int):
    """Of each class that can have a link, the n-grams that others hold and those in which candidates meet."""

    def run(sent: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out, hashes = [], WordHashes()
        for texts, doc_ids, classes in zip(sent["texts"], sent["doc_ids"], sent["classes"]):
            x = Incidence(texts, doc_ids, classes, size, hashes)
            totals = [unpacked(t, "uint64") for t in told.sort_values("bucket")["totals"]]
            totals = np.concatenate([np.empty(0, dtype="uint64"), *totals])
            if len(totals) != len(x.grams):
                raise ValueError("a chunk and the totals it was told differ")
            rank = np.lexsort((x.grams, totals))  # by frequency, then hash
            place = np.empty(len(rank), dtype="int64")
            place[rank] = np.arange(len(rank))
            shared = totals > 1
            least = -(-percent * x.sizes // 100)
            held = np.bincount(x.row, weights=shared[x.number], minlength=len(x.sizes)).astype("int64")
            ends = np.cumsum(x.sizes)
            for d in np.flatnonzero(held >= least).tolist():
                grams = x.number[ends[d] - x.sizes[d]:ends[d]]
                grams = grams[shared[grams]]
                columns = grams[np.argsort(place[grams])][:held[d] - least[d] + 1]  # those of the rarest that others hold
                out.append((int(x.classes[d]), int(x.sizes[d]), x.grams[grams].view("int64"), x.grams[columns].view("int64")))
        return pd.DataFrame(out, columns=["id", "n", "grams", "columns"])

    return run


def ngram_classes(docs: DataFrame, size: int, percent: int, chunk: int = CHUNK, bucket: int = BUCKET, **more) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    scratch = Scratch(docs.sparkSession, "ngram")
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = scratch.write(d.mapInPandas(writer(size, chunk), CHUNKED), "chunks")
    each = chunks.select(F.explode(F.arrays_zip("doc_ids", "sizes", "classes")).alias("x"))
    each = scratch.write(each.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").alias("n"), F.col("x.classes").alias("class")), "each")
    entries = each.agg(F.sum("n")).first()[0] or 0
    sent = chunks.select("chunk", "doc_ids", "classes", "texts")
    asked = sent.mapInPandas(asker(size, max(1, -(-entries // bucket))), ASKED)
    told = asked.groupBy("bucket").applyInPandas(totalled, TOLD)
    held = sent.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(holder(size, percent), HELD)
    held = scratch.write(held.dropDuplicates(["id"]), "held")  # copies of a class in several chunks
    keys = scratch.write(held.select(F.explode("columns").alias("key"), "id", "n"), "columns")
    parts = linked(keys, held.select("id", "n", "grams"), percent, scratch, **more)
    full = each.where("n > 0 AND doc_id IS NOT NULL")
    least = full.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    if parts is not None:
        least = scratch.write(least, "classes")
        member = least.join(parts.toDF("class", "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        member = scratch.write(member, "member")
        first = scratch.write(member.groupBy("component").agg(F.min("component_id").alias("component_id")), "first")
        least = scratch.write(member.drop("component_id").join(first, "component").select("class", "component_id"), "least")
    out = each.join(least, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def sql(size: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE
  d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS sh
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {size - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
  r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
