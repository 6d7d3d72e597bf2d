"""Vector code compression: product codebooks fitted by integer k-means, with LAESA pivots.

A vector is cut into ``PARTS`` consecutive parts; each part position has its own
codebook of ``ENTRIES`` entries.  The squared distances of every part to
``PIVOTS`` fixed pivots (the first initial entries of its codebook) are
computed once and written beside the parts.  In a round only the distances of
pivots to entries are new: the triangle inequality gives a lower bound for each
part and entry, entries are tried by ascending bound, and an entry whose bound
exceeds the best distance found is never evaluated.  Evaluations are exact in
64-bit integers; bounds are lowered by more than a float's error, so pruning
never changes a result.

Rounds run as Spark jobs: workers assign their parts and add them up by entry,
Spark sums the partial sums, and the driver gets one number for each component
of the codebooks (parts x entries x places), never vectors.

Vectors that are null or hold null or non-finite components are dropped.  Rows
with a null vec_id are coded too, and start a codebook only if there are fewer
than ``ENTRIES`` rows with one.  Repeated rows each give a row; equal vec_ids
are ordered by their vectors.  Fewer vectors than entries make a smaller
codebook.  Vectors of different lengths, of a length that the parts do not
divide, or with components of 65,536 or more raise a ValueError.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, pick

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 8, 16, 6, 4096, 4
LARGEST = 65_536
ROWS_AT_ONCE = 8192
SLACK = 1e-12


def stacked(batches, rows: int = ROWS_AT_ONCE):
    """Arrow batches joined to tables of about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix(table: pa.Table, column: str, *shape: int) -> np.ndarray:
    """A list column whose lists are equally long, as an array of integers."""
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in table[column].chunks]
    return np.concatenate(values).astype("int64").reshape(table.num_rows, *shape)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis."""
    return np.square(x - y).sum(axis=-1)


def lists(x: np.ndarray, kind) -> pa.Array:
    width = int(np.prod(x.shape[1:]))
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype="int32") * width, pa.array(x.ravel(), type=kind))


def nearest(parts: np.ndarray, away: np.ndarray, pivots: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of every part, its squared distance, and how many distances were evaluated.

    ``parts`` (rows, positions, width), ``away`` (rows, positions, pivots: squared
    distances), ``pivots`` and ``books`` (positions, pivots or entries, width).
    Equal distances take the lower entry.
    """
    between = np.sqrt(squares(pivots[:, None], books[:, :, None]))  # position, entry, pivot
    root = np.sqrt(away)
    low = np.zeros((*parts.shape[:2], books.shape[1]))
    for p in range(pivots.shape[1]):
        x, y = root[:, :, p, None], between[None, :, :, p]
        np.maximum(low, np.abs(x - y) - SLACK * (x + y), out=low)
    position = np.tile(np.arange(parts.shape[1]), len(parts))
    flat, low = parts.reshape(-1, parts.shape[2]), low.reshape(-1, books.shape[1])
    order = np.argsort(low, axis=1, kind="stable")
    low = np.square(np.take_along_axis(low, order, axis=1))
    best = np.full(len(flat), np.iinfo("int64").max, dtype="int64")
    code = np.full(len(flat), books.shape[1], dtype="int64")
    left, evaluated = np.arange(len(flat)), 0
    for k in range(books.shape[1]):
        # bounds only rise along a row's order and its best only falls: what is pruned stays so
        left = left[low[left, k] <= best[left] * (1 + SLACK)]
        if not len(left):
            break
        entry = order[left, k]
        found = squares(flat[left], books[position[left], entry])
        evaluated += len(left)
        better = (found < best[left]) | ((found == best[left]) & (entry < code[left]))
        best[left[better]], code[left[better]] = found[better], entry[better]
    return code.reshape(parts.shape[:2]), best.reshape(parts.shape[:2]), evaluated


def measured(pivots: np.ndarray):
    """Adds the squared distances of all parts to the pivots of their position."""

    def run(batches):
        for t in stacked(batches):
            parts = matrix(t, "parts", pivots.shape[0], pivots.shape[2])
            away = squares(parts[:, :, None], pivots[None])
            yield from t.append_column("away", lists(away, pa.int64())).to_batches()

    return run


def added(pivots: np.ndarray, books: np.ndarray):
    """The partial sums of a task: position, entry, place, total, n."""

    def run(batches):
        shape = books.shape
        total, n = np.zeros(shape, dtype="int64"), np.zeros(shape[:2], dtype="int64")
        for t in stacked(batches):
            parts = matrix(t, "parts", shape[0], shape[2])
            code, _, _ = nearest(parts, matrix(t, "away", *pivots.shape[:2]), pivots, books)
            for p in range(shape[0]):
                np.add.at(total[p], code[:, p], parts[:, p])
                n[p] += np.bincount(code[:, p], minlength=shape[1])
        position, entry, place = np.indices(shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.ravel()) for x in (position, entry, place, total, np.broadcast_to(n[:, :, None], shape))],
            names=["position", "entry", "place", "total", "n"])

    return run


def coder(pivots: np.ndarray, books: np.ndarray):
    def run(batches):
        hexes = np.array([f"{k:02x}" for k in range(books.shape[1])])
        for t in stacked(batches):
            parts = matrix(t, "parts", books.shape[0], books.shape[2])
            code, error, _ = nearest(parts, matrix(t, "away", *pivots.shape[:2]), pivots, books)
            yield pa.RecordBatch.from_arrays(
                [t["vec_id"].combine_chunks(), t["label"].combine_chunks(), pa.array(["".join(c) for c in hexes[code]], type=pa.string()), pa.array(error.sum(axis=1))],
                names=["vec_id", "label", "code", "error"])

    return run


def finite(vector: Column) -> Column:
    """False for null vectors and those with null or non-finite components."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~broken


def kept_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    v = pick(vectors, vec_id="bigint", label="bigint", embedding="array<double>").where(finite(F.col("embedding")))
    return v.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale)).alias("parts"))


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
              pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """The written table of parts and pivot distances, the pivots and the fitted codebooks (None without vectors)."""
    kept = kept_vectors(vectors, scale)
    far = F.array_max(F.transform("parts", F.abs))
    seen = kept.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("parts")).alias("least"), F.max(F.size("parts")).alias("most"), F.max(far).alias("far")).first()
    if not seen["n"]:
        return None
    if seen["least"] != seen["most"] or seen["most"] % parts:
        raise ValueError(f"vectors must have one length that {parts} divides, found {seen['least']} to {seen['most']}")
    if (seen["far"] or 0) > LARGEST * scale:
        raise ValueError(f"components must be smaller than {LARGEST}")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).collect()  # at most `entries` rows
    books = np.array([r["parts"] for r in first], dtype="int64").reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    fixed = books[:, :pivots].copy()
    scratch = Scratch(kept.sparkSession, "codes")
    schema = "vec_id bigint, label bigint, parts array<bigint>, away array<bigint>"
    table = scratch.write(kept.mapInArrow(measured(fixed), schema), "parts")
    for _ in range(rounds):
        sums = table.mapInArrow(added(fixed, books), "position bigint, entry bigint, place bigint, total bigint, n bigint")
        sums = sums.groupBy("position", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
        for r in sums.collect():  # at most one row for each component of the codebooks
            books[r["position"], r["entry"], r["place"]] = r["total"] // r["n"]
    return table, fixed, books


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
               pivots: int = PIVOTS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    fitted = codebooks(vectors, parts, entries, rounds, scale, pivots)
    if not fitted:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    table, fixed, books = fitted
    scratch = Scratch(vectors.sparkSession, "coded")
    coded = scratch.write(table.mapInArrow(coder(fixed, books), "vec_id bigint, label bigint, code string, error bigint"), "coded")
    by_label = scratch.write(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    def assign(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (SELECT p.r, p.p, p.v, min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'i': b.i}}) AS m
       FROM p JOIN b{r} b ON p.p = b.p GROUP BY p.r, p.p, p.v)"""

    def update(r: int) -> str:
        return f"""
s{r} AS (SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v
       FROM (SELECT p, m.i AS i, k, CAST(sum(v[k]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, m, v, unnest(generate_series(1, len(v))) AS k FROM a{r}) GROUP BY ALL) GROUP BY p, i),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN s{r} s ON s.p = b.p AND s.i = b.i)"""

    steps = ",".join(f"{assign(r)},{update(r)}" for r in range(rounds))
    return f"""
WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS r, vec_id, label, e FROM f),
p AS MATERIALIZED (SELECT r, p, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS v FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS i, v FROM p WHERE r <= {entries}),{steps},{assign(rounds)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) AS h FROM b{rounds}),
c AS (SELECT r, string_agg(printf('%02x', CAST(m.i AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256
FROM k JOIN c ON k.r = c.r, h
"""
