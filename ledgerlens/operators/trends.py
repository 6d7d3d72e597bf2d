"""Theil-Sen trend of a customer's lines (CUS-2 volume trend, CUS-3 spend trend).

slope = median over all pairs i < j of (y_j - y_i) / (j - i), where i, j are
positions of the customer's lines in a total order (OrderDate, then order,
line and product keys).  Customers with fewer than 3 lines get 0.

Values are whole multiples of 1 / ``SCALE`` (others, and values of 9e9 or more,
raise a ValueError), so differences are exact and a slope is one rounding of a
quotient of whole numbers.  Two ways of taking
the median give the same double:

* light (n <= LOCAL_MAX, virtually every customer): the customer's lines are
  grouped into one pandas batch (bounded size) and the median is taken over
  the pairwise slopes in numpy.
* heavy (n > LOCAL_MAX): nothing of the customer is gathered in one task.
  The middle slopes are found by bisection over the doubles t.  A rounded
  slope is at most t if the exact one is at most T, the middle between t and
  the next double, and never equals T.  With T = m / p in whole numbers that
  is z_i >= z_j for z = y * p - m * x, in exact decimals.  Such pairs are
  counted as a sum over bit levels of the position: at level l the pairs whose
  positions first differ in bit l are (left half, right half) of one block,
  counted by one range-sorted pass with per-partition offsets (see
  ``_count_dominated``).  The state of the search is a table joined by key.
"""

from __future__ import annotations

import math
import struct
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.order_stats import _differs
from ledgerlens.session import stored

LOCAL_MAX = 2048  # light path: at most ~2.1M pairwise slopes (~50 MB transient numpy) per customer


SCALE = 1_000_000  # values have at most six decimals; others raise
EXACT = 1e-15  # a double's error, relative
SLOPES = 1 << 20  # slopes held at once, unless those of one key are more
WAYS = 7  # thresholds tested in a pass, for three bits of the result


def theil_sen_trends(lines: DataFrame, targets: dict[str, str], order_cols: list[str],
                     key: str = "CustomerID", local_max: int | None = None,
                     distinct: dict[str, str] | None = None) -> DataFrame:
    """One row per key with a Theil-Sen slope column per ``targets`` entry.

    ``targets`` maps output column -> y column of ``lines``, ``distinct`` output
    column -> one of ``order_cols`` whose different values are counted by the way.  Light keys
    (at most ``local_max`` lines) are gathered as one ordered array per key
    (bounded by ``local_max``) and solved by a vectorised Pandas UDF, many
    keys per Arrow batch; heavy keys take the distributed path.
    """
    local_max = LOCAL_MAX if local_max is None else local_max
    distinct = distinct or {}
    ycols = list(dict.fromkeys(targets.values()))
    targets = {out: f"_y_{y}" for out, y in targets.items()}
    whole = lambda c: F.round(F.col(c).cast("double") * SCALE).cast("bigint")
    # a single y orders as its whole number does
    order = [f"_y_{c}" if [c] == ycols and c not in distinct.values() else c for c in order_cols]
    base = lines.select(key, *[c for c in order_cols if c in order], *[whole(c).alias(f"_y_{c}") for c in ycols])
    y = [F.col(c).cast("double") for c in ycols]
    off = [F.abs(v - whole(c) / SCALE) > F.greatest(F.abs(v), F.lit(1.0)) * EXACT for v, c in zip(y, ycols)]
    checked = lines.select(key, F.greatest(*[F.abs(v) for v in y], F.lit(0.0)).alias("_far"), F.coalesce(reduce(or_, off), F.lit(False)).alias("_off"))
    seen = checked.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("_far").alias("_far"), F.max("_off").alias("_off")).agg(
        F.max("_n").alias("n"), F.max("_far").alias("far"), F.max("_off").alias("off")).first()
    if seen["off"] or (seen["far"] or 0.0) * SCALE >= 2.0**53:
        raise ValueError(f"trends need values below {2.0**53 / SCALE:.3g} that are whole multiples of 1 / {SCALE}")
    base = base.where(F.col(key).isNotNull())
    light, heavy = base, None
    if (seen["n"] or 0) > local_max:
        counts = base.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        sized = base.join(counts, on=key, how="inner")
        light, heavy = (sized.where(few).drop("_n") for few in (F.col("_n") <= local_max, F.col("_n") > local_max))
    out_schema = T.StructType([lines.schema[key]] + [T.StructField(o, T.DoubleType()) for o in targets])
    ordered = F.sort_array(F.collect_list(F.struct(*dict.fromkeys([*order, *targets.values()]))))
    # dealt by key before they are gathered: no arrays of part of the lines are made and merged
    arrays = light.repartition(key).groupBy(key).agg(ordered.alias("_rows"))
    slope = F.pandas_udf(_median_slopes, T.DoubleType())
    light_out = arrays.select(key, *[slope(F.col(f"_rows.{y}")).alias(out) for out, y in targets.items()],
                              *[F.size(F.array_compact(F.array_distinct(F.col(f"_rows.{c}")))).cast("bigint").alias(out)
                                for out, c in distinct.items()])
    if heavy is not None:
        heavy_out = _heavy_trends(heavy, targets, order, key, out_schema)
        if distinct:
            heavy_out = heavy_out.join(heavy.groupBy(key).agg(*[F.countDistinct(c).alias(out) for out, c in distinct.items()]), key)
        return light_out.unionByName(heavy_out)
    return light_out


def _median_slopes(ys: pd.Series) -> pd.Series:
    """Median slope of each array of whole numbers, arrays of equal length together; 0 of fewer than 3."""
    sizes, out = ys.map(len).to_numpy(), np.zeros(len(ys))
    for n in np.unique(sizes[sizes >= 3]):
        i, j = np.triu_indices(n, k=1)
        far, same = (j - i).astype(np.float64), np.flatnonzero(sizes == n)
        step = max(1, SLOPES // len(far))
        for at in (same[k:k + step] for k in range(0, len(same), step)):
            y = np.stack([np.asarray(ys.iloc[k], dtype=np.int64) for k in at])
            out[at] = np.median((y[:, j] - y[:, i]) / far, axis=1) / SCALE
    return pd.Series(out)


# ---------------------------------------------------------------------------
# heavy path: distributed exact selection of the median slope

def _f2i(x: float) -> int:
    """Order-preserving map from doubles to integers."""
    b = struct.unpack("<q", struct.pack("<d", x))[0]
    return b if b >= 0 else -(b & 0x7FFFFFFFFFFFFFFF) - 1


def _i2f(i: int) -> float:
    b = i if i >= 0 else (-(i + 1)) | (1 << 63)
    if b >= 1 << 63:
        b -= 1 << 64
    return struct.unpack("<d", struct.pack("<q", b))[0]


def _count_dominated(points: DataFrame, key: str, n_levels: int, strict: bool = False,
                     weight_col: str | None = None) -> DataFrame:
    """key, tid, cnt: the number of pairs (i < j) with z_i >= z_j.

    ``points``: key, tid, x (0..n-1 position), z.
    Each point is emitted once per bit level l; at level l a point belongs to
    block x >> (l+1) and half (x >> l) & 1.  Pairs across halves of a block
    are counted in one pass: rows are range partitioned on
    (key, tid, level, block, z desc, half), each partition counts, for every
    right-half row, the left-half rows before it locally, and adds the
    left-half rows of the same block in earlier partitions (an offset from a
    table with at most partitions + blocks rows).
    """
    spark = points.sparkSession
    levels = F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1))).alias("lvl")
    wcol = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    exploded = points.select(key, "tid", "x", "z", wcol.alias("w"), levels)
    pow_l = F.pow(F.lit(2), F.col("lvl")).cast("long")
    exploded = exploded.select(
        key, "tid", "lvl",
        F.floor(F.col("x") / (pow_l * 2)).cast("long").alias("blk"),
        F.pmod(F.floor(F.col("x") / pow_l), F.lit(2)).cast("int").alias("half"),
        F.col("z"), "w")
    keys = [key, "tid", "lvl", "blk"]
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at equal z a left row precedes a right row (>=) or follows it (strict >)
    half_order = F.col("half").desc() if strict else F.col("half").asc()
    ordered = (exploded.repartitionByRange(n_parts, *[F.col(c) for c in keys], F.col("z").desc(), half_order)
               .sortWithinPartitions(*keys, F.col("z").desc(), half_order)
               .withColumn("_pid", F.spark_partition_id())).select("_pid", *keys, "half", "w")
    key_type = points.schema[key].dataType
    schema = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField(key, key_type),
                           T.StructField("tid", T.LongType()), T.StructField("lvl", T.IntegerType()),
                           T.StructField("blk", T.LongType()), T.StructField("n_left", T.LongType()),
                           T.StructField("n_right", T.LongType()), T.StructField("local", T.LongType())])

    def scan(batches):
        # rows arrive sorted by (group, z, half); a group never reappears after
        # it ends, so only the running left count of the current group is
        # carried between batches and each batch emits its own partial sums
        carry_key, carry_left = None, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            g = pdf[[key, "tid", "lvl", "blk"]]
            is_left = (pdf["half"] == 0).astype("int64")
            left = is_left * pdf["w"].astype("int64")
            change = _differs(g, carry_key)
            seg = change.cumsum()
            before = left.groupby(seg).cumsum() - left
            if not change.iloc[0]:
                before[seg == seg.iloc[0]] += carry_left
            right = 1 - is_left
            sums = pd.DataFrame({"n_left": left, "n_right": right, "local": before * right}).groupby(seg, sort=False).sum()
            heads = g[~seg.duplicated()].reset_index(drop=True)
            whole = seg.iloc[0] == seg.iloc[-1] and not change.iloc[0]
            carry_left = (carry_left if whole else 0) + int(sums["n_left"].iloc[-1])
            carry_key = g.iloc[-1]
            yield pd.concat([heads, sums.reset_index(drop=True)], axis=1).assign(_pid=int(pdf["_pid"].iloc[0]))[
                [f.name for f in schema.fields]]

    summary = ordered.mapInPandas(scan, schema).groupBy("_pid", key, "tid", "lvl", "blk").agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"), F.sum("local").alias("local"))
    w = Window.partitionBy(key, "tid", "lvl", "blk").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    combined = summary.withColumn("_off", F.coalesce(F.sum("n_left").over(w), F.lit(0)))
    return combined.groupBy(key, "tid").agg(
        F.sum(F.col("local") + F.col("n_right") * F.col("_off")).alias("cnt"))


def _threshold(t: float, n: int) -> tuple[int, int]:
    """m, p with m / p between the exact slopes that round to t or less and the others (p a power of two).

    Slopes of n lines are 0 or at least 1 / n, so thresholds nearer to 0 than
    that can be moved without changing which slopes they part.
    """
    least = Fraction(1, 1 << (n.bit_length() + 1))
    part = (Fraction(t) + Fraction(math.nextafter(t, math.inf))) / 2
    if abs(part) < least:
        part = least if t >= 0 else -least
    return part.numerator, part.denominator


def _thresholds(lo: pd.Series, hi: pd.Series, n: pd.Series, way: pd.Series) -> pd.DataFrame:
    """The ``way``-th of WAYS doubles between two, and what parts the slopes there."""
    mids = [a + (b - a) * w // (WAYS + 1) for a, b, w in zip(lo.tolist(), hi.tolist(), way.tolist())]
    parts = [_threshold(_i2f(m), k) for m, k in zip(mids, n.tolist())]
    return pd.DataFrame({"mid": mids, "m": [Decimal(a) for a, _ in parts], "p": [Decimal(b) for _, b in parts]})


def _doubles(i: pd.Series) -> pd.Series:
    return i.map(_i2f).astype("float64")


def _images(v: pd.Series) -> pd.Series:
    return v.map(lambda x: _f2i(float(x))).astype("int64")


def _heavy_trends(heavy: DataFrame, targets: dict[str, str], order: list[str], key: str,
                  out_schema: T.StructType) -> DataFrame:
    from ledgerlens.operators.order_stats import row_index

    ycols = sorted(set(targets.values()))
    indexed = row_index(heavy, order, [key], out_col="x").select(key, "x", *ycols)
    indexed = stored(indexed, "lines")
    image, double = F.pandas_udf(_images, T.LongType()), F.pandas_udf(_doubles, T.DoubleType())
    threshold = F.pandas_udf(_thresholds, "mid bigint, m decimal(38,0), p decimal(38,0)")
    stats = indexed.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                     *[(F.max(c) - F.min(c)).cast("double").alias(f"span{c}") for c in ycols])
    n_levels = max(1, int(stats.agg(F.max("n")).first()[0]).bit_length())
    n_pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    wanted = [F.struct(F.lit(out).alias("out"), F.lit(y).alias("y"), r.alias("k"), (F.col(f"span{y}") + 1.0).alias("span"))
              for out, y in targets.items()
              for r in (((n_pairs - 1) / 2).cast("bigint"), (n_pairs / 2).cast("bigint"))]
    state = stats.select(key, "n", F.posexplode(F.array(*wanted)).alias("tid", "s")).select(
        key, "n", F.col("tid").cast("bigint").alias("tid"), "s.out", "s.y", "s.k",
        image(-F.col("s.span")).alias("lo"), image(F.col("s.span")).alias("hi"))
    state = stored(state, "state")
    # count(slope <= lo) <= k < count(slope <= hi)
    while not (active := state.where(F.col("hi") - 1 > F.col("lo"))).isEmpty():
        ways = active.withColumn("way", F.explode(F.sequence(F.lit(1), F.lit(WAYS))))
        ways = ways.withColumn("t", threshold("lo", "hi", "n", "way")).where("t.mid > lo")
        asked = stored(ways.select(key, (F.col("tid") * (WAYS + 1) + F.col("way")).alias("tid"), "y", "t.*"), "asked")
        y = F.coalesce(*[F.when(F.col("y") == c, F.col(c)) for c in ycols]).cast("decimal(20,0)")
        z = y * F.col("p") - F.col("m") * F.col("x").cast("decimal(20,0)")
        counts = _count_dominated(indexed.join(asked, key).select(key, "tid", "x", z.alias("z")), key, n_levels)
        found = asked.join(counts, [key, "tid"], "left").select(
            key, F.floor(F.col("tid") / (WAYS + 1)).alias("tid"), "mid", F.coalesce("cnt", F.lit(0)).alias("cnt"))
        found = found.join(state.select(key, "tid", "k"), [key, "tid"])
        bounds = found.groupBy(key, "tid").agg(F.max(F.when(F.col("cnt") <= F.col("k"), F.col("mid"))).alias("above"),
                                               F.min(F.when(F.col("cnt") > F.col("k"), F.col("mid"))).alias("below"))
        state = stored(state.join(bounds, [key, "tid"], "left").select(
            key, "n", "tid", "out", "y", "k", F.coalesce("above", "lo").alias("lo"), F.coalesce("below", "hi").alias("hi")), "state")
    slope = state.select(key, "n", "out", double("hi").alias("v"))
    middle = lambda out: F.sum(F.when(F.col("out") == out, F.col("v"))) / 2 / SCALE
    return slope.groupBy(key).agg(*[
        F.when(F.max("n") >= 3, middle(out)).otherwise(0.0).alias(out) for out in targets]).select(
        *[F.col(f.name).cast(f.dataType) for f in out_schema])
