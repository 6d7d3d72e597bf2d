"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each Spark task splits its texts into words with the tokenizer's pattern and
hands the words it has not met yet to an in-process DuckDB.  There a word is a
set of (word, position, token) rows, at first one per byte.  A recursive query
joins each row and its neighbour with the merge table and contracts each word's
leftmost pair of minimum rank, until no pair of the word can be merged.
Decoding joins the ids with the vocabulary and aggregates their bytes in the
order of their positions.

A word that is in the vocabulary as a whole is that token.  Words of more than
``WIDE`` bytes contract all occurrences of their minimum pair in one step if
this is proven to give the same tokens (no longer token made of the new one
has a smaller rank); the query is run again from its last state after about
``WIDE_ROWS`` rows, so that not all steps are held at once.

A word of more than ``PIECE`` bytes is cut into pieces that are encoded as words
of their own, many in one query, and neighbouring pieces are joined round by
round: the tokens around a seam are encoded anew, with more of them until the
first and the last one come out as they were.  A sequence of tokens is the
encoding of its bytes if each two neighbours are the encoding of theirs, so
what lies outside is right as it is.  A word thus takes time in proportion to
its length.

Memory per task is bounded: texts go through in slices of about
``SLICE_CHARS`` characters (a text is never split), words through DuckDB in
slices of ``SLICE_BYTES`` (pieces of a long word likewise), and the memory of known words keeps no
others than those of the texts at hand when it holds ``MEMO`` words.  The rank file (under 1 MB) and the merge table made of it
(108,299 rows) are read and made on the driver and broadcast.

Null text counts as empty: no tokens, empty decoded bytes.  Every row gives a
row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pick

WIDE = 64
PIECE, CONTEXT = 256, 8
SLICE_CHARS = 1_000_000
SLICE_BYTES = 400_000
WIDE_ROWS = 2_000_000
MEMO = 200_000
CODED = "doc_id bigint, ids binary, decoded binary"

#: One contraction per word and step.  A word's positions stay 1, 2, 3, ...; a row knows the token after its own.
NARROW_SQL = """
WITH RECURSIVE t(w, pos, tok, nxt, step) AS (
  SELECT w, pos, tok, nxt, 0 FROM start
  UNION ALL
  SELECT a.w, CASE WHEN a.pos > b.pos THEN a.pos - 1 ELSE a.pos END,
         CASE WHEN a.pos = b.pos + 1 THEN b.rank ELSE a.tok END,
         CASE WHEN a.pos = b.pos - 1 THEN b.rank ELSE a.nxt END, a.step + 1
  FROM t a JOIN (
    SELECT w, CAST(min(key) & 4294967295 AS INTEGER) AS pos, CAST(min(key) >> 32 AS INTEGER) AS rank
    FROM (SELECT t.w, (CAST(m.rank AS BIGINT) << 32) + t.pos AS key FROM t JOIN merges m ON m.l = t.tok AND m.r = t.nxt)
    GROUP BY w) b ON a.w = b.w
  WHERE a.pos <> b.pos
)
SELECT w, tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY w, pos
"""

#: All contractions of a word's minimum pair in a step, where that is the same.
WIDE_SQL = """
WITH RECURSIVE t(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN done THEN best ELSE tok END, step + 1
  FROM (
    SELECT *, lag(done) OVER (PARTITION BY w ORDER BY pos) AS before
    FROM (
      SELECT *, hit AND (ordinal = 1 OR together AND
               (row_number() OVER (PARTITION BY w, hit, rn - ordinal ORDER BY pos)) % 2 = 1) AS done
      FROM (
        SELECT *, coalesce(rank = best, false) AS hit,
               sum(CASE WHEN rank = best THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY pos) AS ordinal
        FROM (
          SELECT a.*, m.rank, m.together, min(m.rank) OVER (PARTITION BY a.w) AS best
          FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt,
                       row_number() OVER (PARTITION BY w ORDER BY pos) AS rn FROM t) a
          LEFT JOIN merges m ON m.l = a.tok AND m.r = a.nxt
        ) WHERE best IS NOT NULL
      )
    )
  )
  WHERE NOT coalesce(before, false) AND step < $most
)
SELECT w, tok, last FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM t) WHERE step = last ORDER BY w, pos
"""

DECODE_SQL = """
SELECT doc, unhex(string_agg(v.hex, '' ORDER BY pos)) AS bytes
FROM ids JOIN vocab v ON v.id = ids.id GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a rank file (lines of base64 token and rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pd.DataFrame:
    """l, r, rank, together: the pairs of tokens that join to a token.

    ``together``: every pair that the merged token can take part in has a
    larger rank than it, so contracting all its occurrences at once leaves out
    no smaller pair.
    """
    rows = []
    least = {}  # of each token, the least rank of the tokens made of it and one more
    for t, rank in ranks.items():
        for k in range(1, len(t)):
            a, b = ranks.get(t[:k]), ranks.get(t[k:])
            if a is not None and b is not None:
                rows.append((a, b, rank))
                for part in (a, b):
                    least[part] = min(least.get(part, rank), rank)
    m = pd.DataFrame(rows, columns=["l", "r", "rank"]).astype("int32")
    m["together"] = [least.get(x, x + 1) > x for x in m["rank"].tolist()]
    return m


class Coder:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: pd.DataFrame | None = None):
        import duckdb
        import regex

        self.ranks, self.find, self.memo = ranks, regex.compile(pattern).findall, {}
        self.bytes_of = {rank: t for t, rank in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype="int32")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.table("merges", merge_table(ranks) if merges is None else merges)
        self.table("vocab", pd.DataFrame({"id": list(ranks.values()), "hex": [t.hex() for t in ranks]}))

    def table(self, name: str, rows: pd.DataFrame) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merged(self, words: list[bytes], sql: str) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], dtype="int64")
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = pd.DataFrame({
            "w": np.repeat(np.arange(len(words), dtype="int32"), sizes), "pos": at.astype("int32"),
            "tok": self.first[np.frombuffer(b"".join(words), dtype="uint8")]})
        if sql == NARROW_SQL:
            nxt = np.append(start["tok"].to_numpy()[1:], np.int32(-1))
            nxt[np.cumsum(sizes) - 1] = -1  # no token comes after a word's last
            start["nxt"] = nxt
        while True:
            self.table("start", start)
            if sql == NARROW_SQL:
                out = self.db.execute(sql).fetchnumpy()
                break
            most = max(1, WIDE_ROWS // len(start))
            out = self.db.execute(sql, {"most": most}).fetchnumpy()
            if not (out["last"] >= most).any():
                break
            start = pd.DataFrame({"w": out["w"], "pos": np.arange(len(out["w"]), dtype="int32"), "tok": out["tok"]})
        ends = np.searchsorted(out["w"], np.arange(len(words)), side="right") * 4
        packed = np.asarray(out["tok"]).astype("<u4").tobytes()
        return [packed[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """As ``merged``, each different word once, by the program for its length and in slices."""
        known: dict = {}
        for sql, own in ((NARROW_SQL, [w for w in set(words) if len(w) <= WIDE]), (WIDE_SQL, [w for w in set(words) if len(w) > WIDE])):
            begin = size = 0
            for k, w in enumerate(own):
                size += len(w)
                if size >= SLICE_BYTES or k + 1 == len(own):
                    known.update(zip(own[begin:k + 1], self.merged(own[begin:k + 1], sql)))
                    begin, size = k + 1, 0
        return [known[w] for w in words]

    def merged_long(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of any length, by pieces whose seams are mended."""
        cut = [[w[i:i + PIECE] for i in range(0, len(w), PIECE)] for w in words]
        ids = iter(self.merged_all([p for pieces in cut for p in pieces]))
        rows = [[np.frombuffer(next(ids), dtype="<u4") for _ in pieces] for pieces in cut]
        while any(len(pieces) > 1 for pieces in rows):
            seams = [(k, j) for k, pieces in enumerate(rows) for j in range(0, len(pieces) - 1, 2)]
            done, size = {}, CONTEXT
            while seams:
                around = [(rows[k][j][-size:], rows[k][j + 1][:size]) for k, j in seams]
                spelled = [b"".join(map(self.bytes_of.__getitem__, np.concatenate(x).tolist())) for x in around]
                left = []
                for (k, j), (low, high), code in zip(seams, around, self.merged_all(spelled)):
                    x, y, new = rows[k][j], rows[k][j + 1], np.frombuffer(code, dtype="<u4")
                    if (len(low) == len(x) or new[0] == low[0]) and (len(high) == len(y) or new[-1] == high[-1]):
                        done[k, j] = np.concatenate([x[:len(x) - len(low)], new, y[len(high):]])
                    else:
                        left.append((k, j))
                seams, size = left, size * 4
            rows = [[done.get((k, j), pieces[j]) for j in range(0, len(pieces), 2)] for k, pieces in enumerate(rows)]
        return [pieces[0].tobytes() for pieces in rows]

    def learn(self, words: set[str]) -> None:
        """Encode words into the memory."""
        short, long = [], []
        for w in words:
            raw = w.encode()
            if raw in self.ranks:
                self.memo[w] = self.ranks[raw].to_bytes(4, "little")
            else:
                (long if len(raw) > PIECE else short).append((w, raw))
        for own, program in ((short, self.merged_all), (long, self.merged_long)):
            self.memo.update((w, code) for (w, _), code in zip(own, program([raw for _, raw in own])))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        at, words = pd.factorize(np.array([w for own in split for w in own], dtype=object))
        new = [w for w in words.tolist() if w not in self.memo]
        if len(self.memo) > MEMO:
            self.memo = {w: self.memo[w] for w in words.tolist() if w in self.memo}
        self.learn(set(new))
        codes = [self.memo[w] for w in words.tolist()]
        # the ids of all occurrences in a row, copied from those of the different words
        ids, sizes = np.frombuffer(b"".join(codes), dtype="<u4"), np.array([len(c) // 4 for c in codes], dtype="int64")
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        begin = (np.cumsum(sizes) - sizes)[at]
        packed = ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes[at])].tobytes()
        cuts = (4 * ends[np.cumsum([0] + [len(own) for own in split])]).tolist()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(packed), dtype="<u4").astype("int32")
        sizes = [len(p) // 4 for p in packed]
        self.table("ids", pd.DataFrame({
            "doc": np.repeat(np.arange(len(packed), dtype="int32"), sizes), "pos": np.arange(len(ids), dtype="int32"), "id": ids}))
        out = dict(self.db.execute(DECODE_SQL).fetchall())
        return [bytes(out.get(k, b"")) for k in range(len(packed))]


def sliced(texts: list[str], most: int):
    """Runs of texts of about ``most`` characters, each of at least one text."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t) + 1
    if texts:
        yield begin, len(texts)


def coded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit), decoded bytes: one row per document."""
    spark = docs.sparkSession
    read = read_ranks(rank_file)
    given = spark.sparkContext.broadcast((read, pattern, merge_table(read)))

    def run(batches):
        coder = None
        for batch in batches:
            coder = coder or Coder(*given.value)
            texts = batch["text"].tolist()
            for i, j in sliced(texts, SLICE_CHARS):
                ids = coder.encode(texts[i:j])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[i:j].astype("Int64").array, "ids": ids, "decoded": coder.decode(ids)})

    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInPandas(run, CODED)


def digest_columns() -> list:
    return [F.col("doc_id"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return coded(docs, rank_file, pattern).select(*digest_columns())
