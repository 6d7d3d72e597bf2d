"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

Signature: a shingle is a 64-bit hash of its words, folded to a place of a
universe of 2^32 places.  One permutation of the universe scatters the places;
coordinate k of the signature is the least value of a second permutation that
is shifted circularly by k, so the two permutations give all coordinates.

Banding: ``BANDS`` bands of ``ROWS`` coordinates.  Two sets of similarity 0.8
miss all 40 bands of five coordinates with a probability of about 1e-7.

Equal sets form a class and only classes go on, so copies are never paired.
Classes that agree in a band are candidates.  `linking` resolves them without
making all pairs of a bucket: buckets with the same members count once, members
are tested with hubs of their bucket in rounds, and what is not connected then
meets in products of bounded blocks.  Every candidate pair is tested on the full
sets of shingles or connected already, so no link is lost to a cap.

Only the sets of classes that share a bucket are written, each from one text.
A long text is one row and is read whole.

Null text counts as empty.  Documents without words have n_shingles 0, stand
alone and are kept; fewer words than a shingle make one shingle.  Rows with a
null doc_id stand alone likewise: component_id is null and kept is true.  Rows
that repeat a doc_id each give a row and are judged by their own texts.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, pick
from ledgerlens.llm.linking import linked

WORD = rb"[^\x20\x09-\x0D]+"
BANDS, ROWS = 40, 5
BROADCAST_ROWS = 4_000_000
SIGNED = "doc_id bigint, text_key bigint, n_shingles bigint, class bigint, bands array<bigint>"

# Odd multipliers of the two permutations of the 32-bit universe.
SCATTER = (0x85EBCA6B, 0xC2B2AE35)
SHIFTED = (0x9E3779B1, 0x85EBCA77)


def shingles(text: str, size: int) -> np.ndarray:
    """The set of hashed word shingles of a text, sorted, as unsigned 64-bit integers."""
    words = re.findall(WORD, text.encode().lower())  # of bytes, lower() changes A-Z only
    if not words:
        return np.empty(0, dtype="uint64")
    known: dict = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype="int64", count=len(words))
    digest = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in known], dtype="uint64")
    hashes = digest[number]
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), dtype="uint64")
    with np.errstate(over="ignore"):
        for k in range(min(size, len(words))):
            out = (out ^ hashes[k:k + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(sets: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash coordinates of a set that is not empty."""
    with np.errstate(over="ignore"):
        x = (sets ^ (sets >> np.uint64(32))).astype("uint32")
        x ^= x >> np.uint32(16)
        x *= np.uint32(SCATTER[0])
        x ^= x >> np.uint32(13)
        x *= np.uint32(SCATTER[1])
        x ^= x >> np.uint32(16)
        out = np.full(coordinates, 0xFFFFFFFF, dtype="uint32")
        shifts = np.arange(coordinates, dtype="uint32")[:, None]
        for begin in range(0, len(x), 512):
            y = x[None, begin:begin + 512] - shifts
            y *= np.uint32(SHIFTED[0])
            y ^= y >> np.uint32(15)
            y *= np.uint32(SHIFTED[1])
            y ^= y >> np.uint32(16)
            np.minimum(out, y.min(axis=1), out=out)
    return out


def class_of(sets: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(sets.tobytes(), digest_size=8).digest(), "little", signed=True)


def signer(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                s = shingles(text, size)
                if not len(s):
                    out.append((doc_id, key, 0, 0, []))  # a null here would turn the batch's classes into floats
                    continue
                sig = signature(s, bands * rows).reshape(bands, rows).astype("<u4")
                keys = [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8, salt=bytes([b])).digest(), "little", signed=True)
                        for b, r in enumerate(sig)]
                out.append((doc_id, key, len(s), class_of(s), keys))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "n_shingles", "class", "bands"]).astype({"doc_id": "Int64"})

    return run


def setter(size: int):
    def run(batches):
        for batch in batches:
            sets = [shingles(t, size) for t in batch["text"]]
            yield pd.DataFrame({"id": [class_of(s) for s in sets], "n": [len(s) for s in sets], "grams": [s.view("int64") for s in sets]})

    return run


def candidate_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """id, n, grams of the classes that share a bucket, each from one text."""
    wanted = scratch.write(classes.join(keys.select("id").distinct(), "id", "left_semi").select("doc_id", "text_key"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:  # 16 bytes a row; beyond that both sides are shuffled
        wanted = F.broadcast(wanted)
    texts = docs.withColumn("text_key", text_key(F.col("text"))).join(wanted, ["doc_id", "text_key"], "left_semi").select("text")
    sets = scratch.write(texts.mapInPandas(setter(size), "id bigint, n bigint, grams array<bigint>"), "sets")
    copies = sets.groupBy("id").agg(F.count(F.lit(1)).alias("of")).where("of > 1")  # of repeated rows
    return sets if copies.isEmpty() else scratch.write(sets.dropDuplicates(["id"]), "sets")


def text_key(text: Column) -> Column:
    """Tells a doc_id's texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_groups(docs: DataFrame, size: int, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key."""
    scratch = Scratch(docs.sparkSession, "near")
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = scratch.write(d.withColumn("text_key", text_key(F.col("text"))).mapInPandas(signer(size, bands, rows), SIGNED), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # copies combine before the shuffle
    classes = full.groupBy(F.col("class").alias("id")).agg(
        F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"))
    classes = scratch.write(classes.select("id", "one.doc_id", "one.text_key", "n", "bands"), "classes")
    banded = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    banded = banded.select(F.xxhash64("band", "key").alias("key"), "id", "n")
    shared = scratch.write(banded.groupBy("key").agg(F.count(F.lit(1)).alias("of")).where("of > 1").drop("of"), "shared")
    keys = scratch.write(banded.join(shared, "key"), "buckets")
    own = classes.select(F.col("id").alias("class"), F.col("doc_id").alias("component_id"))
    parts = None if keys.isEmpty() else linked(keys, candidate_sets(d, classes, keys, scratch, size), percent, scratch)
    if parts is not None:
        member = scratch.write(own.join(parts, own["class"] == parts["id"], "left").select(
            "class", F.coalesce("component", "class").alias("component"), "component_id"), "member")
        first = scratch.write(member.groupBy("component").agg(F.min("component_id").alias("component_id")), "first")
        own = scratch.write(member.drop("component_id").join(first, "component").select("class", "component_id"), "own")
    out = signed.join(own, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")


def sql(size: int) -> str:
    return rf"""
WITH RECURSIVE
  d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS sh
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {size - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       coalesce(c.m, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
