"""Exact order statistics and ranks without funnelling data through one task.

* ``exact_quantiles`` finds exact (linearly interpolated, pandas-style)
  quantiles by histogram narrowing: each pass is one distributed scan that
  returns at most ``targets x buckets`` counts to the driver; once a target's
  bucket holds at most ``final_size`` values those values (a bounded set) are
  fetched and the order statistic is picked exactly.  No global sort, no
  exact-percentile count map in a single task.
* ``top_k_sum`` sums the k largest values through the k-th largest value
  (ties handled exactly), so k may grow with the data (top 5 % of customers).
* ``row_index`` numbers rows in a total order (optionally within groups) by
  range partitioning plus per-partition offsets: a hot group is spread over
  many tasks instead of one window partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import stored

N_BUCKETS = 1024
FINAL_SIZE = 4096


def collect_scalars(df: DataFrame) -> Row:
    """First row of a one-row aggregate (global agg without grouping keys)."""
    return df.collect()[0]


def _order_statistics(values: DataFrame, targets: list[dict], group_cols: list[str],
                      bounds: dict | None = None) -> dict:
    """Exact r-th smallest value (0-based) for each target.

    ``values``: columns group_cols + ['v'] (non-null doubles).
    ``targets``: dicts with the group key values, 'tid' and 'r'.
    Returns {tid: value}.
    """
    spark = values.sparkSession
    if not group_cols:
        values = values.withColumn("_g", F.lit(0))
        group_cols = ["_g"]
        targets = [{**t, "_g": 0} for t in targets]
    gkey = [F.col(c) for c in group_cols]
    if bounds is None:
        bounds = {tuple(r[c] for c in group_cols): (r["lo"], r["hi"], r["n"]) for r in
                  values.groupBy(*gkey).agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                            F.count(F.lit(1)).alias("n")).collect()}
    elif group_cols == ["_g"] and () in bounds:
        bounds = {(0,): bounds[()]}
    result: dict = {}
    below = {}  # infinities are counted apart; only finite values are narrowed
    if any(math.isinf(x) for lo, hi, _ in bounds.values() for x in (lo, hi)):
        inf, finite = F.lit(float("inf")), F.abs("v") < F.lit(float("inf"))
        edges = values.groupBy(*gkey).agg(
            F.count_if(F.col("v") == -inf).alias("below"), F.count_if(finite).alias("n"),
            F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi")).collect()
        bounds = {tuple(r[c] for c in group_cols): (r["lo"], r["hi"], r["n"]) for r in edges}
        below = {tuple(r[c] for c in group_cols): r["below"] for r in edges}
        values = values.where(finite)
    pending = []
    for t in targets:
        key = tuple(t[c] for c in group_cols)
        lo, hi, n = bounds[key]
        rank = t["r"] - below.get(key, 0)
        if 0 <= rank < n:
            pending.append({**t, "lo": lo, "hi": hi, "r_left": rank, "cnt": n})
        else:
            result[t["tid"]] = float("-inf") if rank < 0 else float("inf")
    tschema = T.StructType(
        [values.schema[c] for c in group_cols]
        + [T.StructField("tid", T.LongType()), T.StructField("lo", T.DoubleType()),
           T.StructField("hi", T.DoubleType())])
    while pending:
        # targets whose interval is a single value or small enough: finish
        small = [t for t in pending if t["lo"] == t["hi"] or t["cnt"] <= FINAL_SIZE]
        for t in small:
            if t["lo"] == t["hi"]:
                result[t["tid"]] = t["lo"]
        fetch = [t for t in small if t["lo"] != t["hi"]]
        if fetch:
            tdf = spark.createDataFrame(
                [tuple(t[c] for c in group_cols) + (t["tid"], float(t["lo"]), float(t["hi"])) for t in fetch], tschema)
            joined = values.join(F.broadcast(tdf), on=group_cols, how="inner")
            got: dict = {}
            for r in joined.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))) \
                    .select("tid", "v").collect():
                got.setdefault(r["tid"], []).append(r["v"])
            for t in fetch:
                vals = sorted(got.get(t["tid"], []))
                result[t["tid"]] = vals[t["r_left"]]
        pending = [t for t in pending if t not in small]
        if not pending:
            break
        tdf = spark.createDataFrame(
            [tuple(t[c] for c in group_cols) + (t["tid"], float(t["lo"]), float(t["hi"])) for t in pending], tschema)
        joined = values.join(F.broadcast(tdf), on=group_cols, how="inner")
        half = lambda c: F.col(c) / 2  # noqa: E731  the full width may overflow
        bucket = F.least(F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * N_BUCKETS), F.lit(N_BUCKETS - 1))
        hist = (joined.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
                .groupBy("tid", bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("bmin"), F.max("v").alias("bmax"))
                .collect())
        by_tid: dict = {}
        for r in hist:
            by_tid.setdefault(r["tid"], []).append(r)
        nxt = []
        for t in pending:
            acc = 0
            for r in sorted(by_tid[t["tid"]], key=lambda r: r["b"]):
                if acc + r["c"] > t["r_left"]:
                    nxt.append({**t, "lo": r["bmin"], "hi": r["bmax"], "r_left": t["r_left"] - acc, "cnt": r["c"]})
                    break
                acc += r["c"]
        pending = nxt
    return result


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = ()) -> list[dict]:
    """Linearly interpolated quantiles (numpy/pandas default) of value_col.

    NULL values are ignored.  With group_cols, one result per (group, p);
    meant for few groups (segments, clusters): the driver handles
    groups x probs x buckets counts per pass.
    Returns a list of dicts: group values, 'p', 'value'.
    """
    group_cols = list(group_cols)
    values = df.select(*group_cols, F.col(value_col).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")).persist()
    try:
        counts = values.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                                 F.max("v").alias("hi")).collect()
        bounds = {tuple(g[c] for c in group_cols): (g["lo"], g["hi"], g["n"]) for g in counts}
        targets, plan = [], []
        tid = 0
        for g in counts:
            n = g["n"]
            key = {c: g[c] for c in group_cols}
            for p in probs:
                h = (n - 1) * p
                lo_r, hi_r = int(math.floor(h)), int(math.ceil(h))
                frac = h - lo_r
                targets.append({**key, "tid": tid, "r": lo_r})
                targets.append({**key, "tid": tid + 1, "r": hi_r})
                plan.append((key, p, tid, tid + 1, frac))
                tid += 2
        got = _order_statistics(values, targets, group_cols, bounds) if targets else {}
        out = []
        for key, p, a, b, frac in plan:
            va, vb = got[a], got[b]
            out.append({**key, "p": p, "value": va if va == vb or frac == 0 else va + (vb - va) * frac})
        return out
    finally:
        values.unpersist()


def exact_quantile(df: DataFrame, value_col: str, p: float) -> float | None:
    res = exact_quantiles(df, value_col, [p])
    return res[0]["value"] if res else None


def top_k_sum(df: DataFrame, value_col: str, k: int) -> float:
    """Sum of the k largest non-null values (exact, ties included once each)."""
    if k <= 0:
        return 0.0
    values = df.select(F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull()).persist()
    try:
        n = values.count()
        k = min(k, n)
        if k == 0:
            return 0.0
        thr = _order_statistics(values, [{"tid": 0, "r": n - k}], [])[0]
        row = values.agg(F.sum(F.when(F.col("v") > thr, F.col("v"))).alias("s"),
                         F.count_if(F.col("v") > thr).alias("c")).collect()[0]
        above = row["s"] or 0.0
        return above + (k - row["c"]) * thr
    finally:
        values.unpersist()


def _differs(keys: pd.DataFrame, before: pd.Series | None = None) -> pd.Series:
    """Whether each row's keys differ from those of the row before (``before`` for the first); NULL equals NULL."""
    prev = keys.shift(1)
    out = ((keys != prev) & ~(keys.isna() & prev.isna())).any(axis=1)
    if len(keys):
        first = keys.iloc[0]
        out.iloc[0] = before is None or bool(((first != before) & ~(first.isna() & before.isna())).any())
    return out


def running_sum(df: DataFrame, order_cols: Sequence[str], value_col: str | None = None,
                group_cols: Sequence[str] = (), out_col: str = "running",
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value_col`` (row count if None) in
    ``order_cols`` order, optionally restarting per group.

    Rows are range partitioned on (group_cols, order_cols) and summed locally
    (mapInPandas over the sorted partition); each (partition, group) gets the
    total of the same group in earlier partitions as offset.  The offset table
    has at most partitions + groups rows.  A hot group is spread over many
    tasks instead of one window partition.  ``order_cols`` should make the
    order total where ties matter.
    """
    group_cols = list(group_cols)
    keys = group_cols + list(order_cols)
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    val = F.lit(1).cast("double") if value_col is None else F.col(value_col).cast("double")
    # Both the local pass and the per-partition totals must see the same
    # range partitioning, also after an executor is lost: the bounds are
    # sampled per exchange, so the partitioned rows are checkpointed and read
    # twice.  The last key splits ties over partitions.
    tied = df.withColumn("_val", F.coalesce(val, F.lit(0.0))).withColumn("_tie", F.monotonically_increasing_id())
    ordered = (tied.repartitionByRange(n_parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
               .withColumn("_pid", F.spark_partition_id())).checkpoint()
    schema = T.StructType(ordered.schema.fields + [T.StructField("_local", T.DoubleType())])

    def accumulate(batches):
        last_key, carry = None, 0.0
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(_local=pd.Series([], dtype="float64"))
                continue
            v = pdf["_val"].astype("float64")
            if group_cols:
                change = _differs(pdf[group_cols], last_key)
                seg = change.cumsum()
                local = v.groupby(seg).cumsum()
                if not change.iloc[0]:
                    local[seg == seg.iloc[0]] += carry
                last_key = pdf[group_cols].iloc[-1]
            else:
                local = v.cumsum() + carry
            carry = float(local.iloc[-1])
            yield pdf.assign(_local=local.values)

    summed = ordered.mapInPandas(accumulate, schema)
    totals = ordered.groupBy("_pid", *group_cols).agg(F.sum("_val").alias("_t"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w), F.lit(0.0))).drop("_t")
    return (summed.join(offsets, on=["_pid"] + group_cols, how="inner")
            .withColumn(out_col, F.col("_local") + F.col("_off"))
            .drop("_pid", "_local", "_off", "_val"))


def prefix_sums(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str], prefix: str = "upto_",
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of several columns at once, in ``order_cols`` order (which is total).

    Rows are range partitioned and stored once; window sums run within a range,
    and what the ranges before hold is added.  Only one row of totals for each
    range reaches the driver.
    """
    spark, order_cols, value_cols = df.sparkSession, list(order_cols), list(value_cols)
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(df.repartitionByRange(n_parts, *order_cols).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = sorted(ordered.groupBy("_range").agg(*[F.sum(c).alias(c) for c in value_cols]).collect(), key=lambda r: r["_range"])
    offsets, held = [], [0] * len(value_cols)
    for r in totals:  # at most n_parts rows
        offsets.append((r["_range"], *held))
        held = [h + (r[c] or 0) for h, c in zip(held, value_cols)]
    types = {f.name: f.dataType.simpleString() for f in ordered.groupBy().agg(*[F.sum(c).alias(c) for c in value_cols]).schema.fields}
    schema = "_range int, " + ", ".join(f"_before_{i} {types[c]}" for i, c in enumerate(value_cols))
    offsets = [(o[0], *[float(x) if types[c] == "double" else x for x, c in zip(o[1:], value_cols)]) for o in offsets]
    within = Window.partitionBy("_range").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.select("*", *[F.sum(c).over(within).alias(f"_own_{i}") for i, c in enumerate(value_cols)])
    out = out.join(F.broadcast(spark.createDataFrame(offsets, schema)), "_range")
    return out.select(*df.columns, *[(F.col(f"_own_{i}") + F.col(f"_before_{i}")).alias(prefix + c) for i, c in enumerate(value_cols)])


def row_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
              out_col: str = "row_idx", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (within groups)."""
    out = running_sum(df, order_cols, None, group_cols, "_rs", num_partitions)
    return out.withColumn(out_col, (F.col("_rs") - 1).cast("long")).drop("_rs")


def average_rank(df: DataFrame, value_col: str, out_col: str = "rank") -> DataFrame:
    """pandas rank(method='average'): 1-based, ties share the mean position.

    Works on the distinct values with their counts: rank = rows below + (count+1)/2.
    """
    counts = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("_c")).where(F.col(value_col).isNotNull())
    cum = prefix_sums(counts, [value_col], ["_c"])
    ranks = cum.select(value_col, (F.col("upto__c") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out_col))
    return df.join(ranks, on=value_col, how="left")


def next_distinct(df: DataFrame, key: str, value: str, out_col: str, num_partitions: int | None = None) -> DataFrame:
    """key, value, ``out_col`` = the key's next larger value (NULL for its last) of distinct (key, value) rows.

    A lead over ranges of (key, value): windows run within a range, and the
    last value of a key in a range is followed by the key's first one in its
    next range.  A key has at most one row for each range there.
    """
    n_parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(df.select(key, value).repartitionByRange(n_parts, key, value).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = ranges.withColumn("_next", F.lead(value).over(Window.partitionBy("_range", key).orderBy(value)))
    heads = ranges.groupBy(key, "_range").agg(F.min(value).alias("_first"))
    heads = heads.select(key, "_range", F.lead("_first").over(Window.partitionBy(key).orderBy("_range")).alias("_after")).where("_after IS NOT NULL")
    return inside.join(heads, [key, "_range"], "left").select(key, value, F.coalesce("_next", "_after").alias(out_col))


def next_in_order(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  value_cols: Sequence[str], prefix: str = "next_",
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``prefix + v`` = v of the following row of the same group in
    ``order_cols`` order (NULL for a group's last row): a ``lead`` that does
    not put a whole group into one window partition.

    Rows are range partitioned and shifted locally; a partition's last row
    takes the first row of the next non-empty partition when it belongs to
    the same group.  Only one head row per partition reaches the driver.
    """
    group_cols, order_cols, value_cols = list(group_cols), list(order_cols), list(value_cols)
    keys = group_cols + order_cols
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = (tied.repartitionByRange(n_parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
               .withColumn("_pid", F.spark_partition_id())).checkpoint()
    head_schema = T.StructType([ordered.schema["_pid"]] + [ordered.schema[c] for c in group_cols + value_cols])

    def heads(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["_pid"] + group_cols + value_cols].head(1)
                return

    head_rows = {r["_pid"]: r for r in ordered.mapInPandas(heads, head_schema).collect()}
    pids = sorted(head_rows)
    following = {p: head_rows[q] for p, q in zip(pids, pids[1:])}
    out_schema = T.StructType(ordered.schema.fields + [
        T.StructField(prefix + v, ordered.schema[v].dataType) for v in value_cols])

    def shift(batches):
        # stream batch by batch; the last row of a batch is held back until
        # the first row of the next batch (or the next partition) is known
        held = None
        pid = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pid = int(pdf["_pid"].iloc[0])
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            same_next = ~_differs(pdf[group_cols]).shift(-1, fill_value=True)
            out = pdf.copy()
            for v in value_cols:
                out[prefix + v] = pdf[v].shift(-1).where(same_next, None).astype(object)
            held = pdf.iloc[[-1]].reset_index(drop=True)
            yield out.iloc[:-1]
        if held is not None:
            last = held.copy()
            nxt = following.get(pid)
            gk_last = tuple(last[c].iloc[0] for c in group_cols)
            same = nxt is not None and tuple(nxt[c] for c in group_cols) == gk_last
            for v in value_cols:
                last[prefix + v] = pd.Series([nxt[v] if same else None], dtype=object)
            yield last

    return ordered.mapInPandas(shift, out_schema).drop("_pid")


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """Exact quantiles of several columns in one set of passes: the columns
    are stacked into (name, value) rows and narrowed as groups."""
    cols = list(cols)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("_s")) \
        .select("_s._col", "_s._v")
    res = exact_quantiles(stacked, "_v", probs, ["_col"])
    out: dict[str, dict[float, float]] = {c: {} for c in cols}
    for r in res:
        out[r["_col"]][r["p"]] = r["value"]
    return out


def average_ranks(df: DataFrame, cols: Sequence[str], suffix: str = "_rank") -> DataFrame:
    """``average_rank`` for several columns from one stacked pass: distinct
    (column, value) counts, one running sum grouped by column, then one
    join per column against the (small, persisted) rank table."""
    cols = list(cols)
    base = df.persist()
    stacked = base.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("_s")) \
        .select("_s._col", "_s._v").where(F.col("_v").isNotNull())
    counts = stacked.groupBy("_col", "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sum(counts, ["_v"], "_c", ["_col"], out_col="_cum")
    ranks = cum.select("_col", "_v", (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias("_rk")).persist()
    out = base
    for c in cols:
        rc = ranks.where(F.col("_col") == F.lit(c)).select(F.col("_v").alias(f"_v_{c}"), F.col("_rk").alias(c + suffix))
        out = out.join(rc, F.col(c).cast("double") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return out
