"""Unsupervised segmentation (SEG-1..7, PRJ-9) on ``pyspark.ml``.

* PRJ-9: z-scores with the population standard deviation (one-row
  aggregate injected as literals) after numpy-style nan/inf replacement.
* SEG-1: the reference's neighbour embedding is single-machine; re-aimed to
  ``pyspark.ml.feature.PCA(k=2)`` on the standardised features.
* SEG-2: the reference's hierarchical density clustering is single-machine;
  re-aimed to grid density clustering on the 2-D projection: points are
  counted per grid cell, cells with at least ``min_samples`` points are
  dense, dense cells that touch (8-neighbourhood) form one cluster
  (connected components by min-label propagation over cells, lineage cut
  with ``checkpoint()``), points outside dense cells and clusters smaller
  than ``min_cluster_size`` are noise (-1).  No point pairs are formed.
* SEG-3..5: ``KMeans`` with seeded restarts, ``ClusteringEvaluator``
  silhouette (squared Euclidean), k chosen from the inertia curve.
* SEG-6/7: profiles per label (exact medians per segment) and names.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import finite_or
from ledgerlens.operators.order_stats import collect_scalars, exact_quantiles, exact_quantiles_multi

# Fixed values (must equal the reference for equal results) -------------
GENOME_FEATURES = ["Recency", "Frequency", "Monetary", "AvgOrderValue", "PurchaseFrequency", "PredictedCLV",
                   "ProbAlive"]
NAN_FILL, POSINF_FILL, NEGINF_FILL = 0.0, 1e6, -1e6
NOISE_NAME = "Noise/Outliers"
# -----------------------------------------------------------------------


def standardize(df: DataFrame, cols: list[str], key: str = "CustomerID") -> DataFrame:
    """PRJ-9: fillna(0) + nan_to_num(posinf=1e6, neginf=-1e6), then
    (x - mean) / population std (0 when the column is constant)."""
    clean = df.select(key, *[finite_or(F.col(c), NAN_FILL, POSINF_FILL, NEGINF_FILL).alias(c) for c in cols])
    m = collect_scalars(clean.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                  *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    out = []
    for c in cols:
        sd = m[f"s_{c}"]
        z = (F.col(c) - F.lit(m[f"m_{c}"])) / F.lit(sd) if sd else F.lit(0.0)
        out.append(z.alias(c))
    return clean.select(key, *out)


def _vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def pca_projection(df: DataFrame, cols: list[str] | None = None, key: str = "CustomerID",
                   min_rows: int = 10) -> DataFrame:
    """SEG-1: (key, PC1, PC2) of the standardised features (needs >= 2
    features present and >= ``min_rows`` rows)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    cols = [c for c in (cols or GENOME_FEATURES) if c in df.columns]
    n = collect_scalars(df.agg(F.count(F.lit(1))))[0]
    if len(cols) < 2 or n < min_rows:
        raise ValueError("insufficient data for the projection")
    z = _vectors(standardize(df, cols, key), cols).persist()
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(z)
    arr = vector_to_array(F.col("pc"))
    return model.transform(z).select(key, arr[0].alias("PC1"), arr[1].alias("PC2"))


#: Rows in a partition that KMeans passes over; fits, and rows of them, that are held at the same time.
FIT_ROWS, FITS, HELD_ROWS = 100_000, 8, 4_000_000


def _training_rows(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """The kept vectors in partitions worth a task: a fit makes about fifty
    passes, so the partitions of the shuffles before it cost more than its rows."""
    rows = _vectors(df.select(key, *cols), cols)
    n = collect_scalars(rows.agg(F.count(F.lit(1))))[0]
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / FIT_ROWS))
    return (rows.coalesce(most) if rows.rdd.getNumPartitions() > most else rows).persist()


def kmeans(df: DataFrame, cols: list[str], k: int = 5, key: str = "CustomerID", seed: int = 42,
           n_init: int = 10):
    """SEG-3 / SEG-4: best of ``n_init`` seeded KMeans fits by training cost;
    returns (labels DataFrame(key, Segment), inertia, silhouette)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    data = _training_rows(df, cols, key)
    model, cost = _best_fits(data, [k], seed, n_init)[0]
    pred = model.transform(data)
    sil = ClusteringEvaluator(featuresCol="features", predictionCol="Segment").evaluate(pred) if k > 1 else 0.0
    return pred.select(key, F.col("Segment").cast("int").alias("Segment")), float(cost), float(sil)


def _best_fits(data: DataFrame, ks: list[int], seed: int, n_init: int) -> list[tuple]:
    """For each k the model of least training cost of ``n_init`` seeded fits, and
    the cost.  Jobs over few rows are short, so several fits run at the same time;
    each holds the rows as vectors, as ``fit`` does for a table that is not kept itself."""
    from pyspark.ml.clustering import KMeans
    rows = data.select("features")

    def fit(k_seed):
        m = KMeans(k=k_seed[0], seed=k_seed[1], featuresCol="features", predictionCol="Segment").fit(rows)
        return m, float(m.summary.trainingCost)

    at_once = max(1, min(FITS, HELD_ROWS // max(1, data.count())))
    with ThreadPool(at_once) as pool:
        fits = pool.map(inheritable_thread_target(data.sparkSession)(fit), [(k, seed + i) for k in ks for i in range(n_init)], chunksize=1)
    return [min(fits[i:i + n_init], key=lambda x: x[1]) for i in range(0, len(fits), n_init)]


def inertia_curve(df: DataFrame, cols: list[str], max_clusters: int = 10, key: str = "CustomerID",
                  seed: int = 42, n_init: int = 10) -> list[tuple[int, float]]:
    n = collect_scalars(df.agg(F.count(F.lit(1))))[0]
    data = _training_rows(df, cols, key)
    ks = list(range(2, min(max_clusters + 1, n)))
    try:
        return [(k, cost) for k, (_, cost) in zip(ks, _best_fits(data, ks, seed, n_init))]
    finally:
        data.unpersist()


def optimal_k(inertias: list[float], rule: str = "reference") -> int:
    """SEG-5: k from the inertia curve for k = 2, 3, ...

    ``reference``: argmin of the second differences + 2 (the reference's
    indexing); ``elbow``: argmax of the second differences + 3 (the k at
    the strongest bend).  Fewer than three inertias -> 2."""
    if len(inertias) < 3:
        return 2
    dd = np.diff(np.diff(np.asarray(inertias, dtype=float)))
    return int(np.argmin(dd) + 2) if rule == "reference" else int(np.argmax(dd) + 3)


CELL_STEPS = 17


def density_cell(points: DataFrame, x: str = "PC1", y: str = "PC2", min_samples: int = 10) -> float:
    """A cell side from the data: the smallest of the span / 2^k at which half
    of the points lie in cells of at least ``min_samples`` points."""
    p = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    s = collect_scalars(p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")))
    span = max(s["x1"] - s["x0"], s["y1"] - s["y0"]) if s["n"] else 0.0
    if not span:
        return 1.0
    k = F.explode(F.sequence(F.lit(0), F.lit(CELL_STEPS - 1))).alias("k")
    side = F.lit(span) / F.pow(F.lit(2.0), F.col("k"))
    cells = p.select("x", "y", k).groupBy("k", F.floor((F.col("x") - s["x0"]) / side).alias("cx"), F.floor((F.col("y") - s["y0"]) / side).alias("cy")).agg(F.count(F.lit(1)).alias("c"))
    dense = cells.where(F.col("c") >= min_samples).groupBy("k").agg(F.sum("c").alias("held")).collect()  # a row for each side
    return span / 2.0 ** max([r["k"] for r in dense if 2 * r["held"] >= s["n"]], default=0)


def density_report(points: DataFrame, labels: DataFrame, x: str = "PC1", y: str = "PC2", key: str = "CustomerID") -> DataFrame:
    """SEG-2's quality row: clusters, noise points, and the silhouette of the
    clustered points without noise (0 with fewer than two clusters)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    counts = labels.agg(F.countDistinct(F.when(F.col("Segment") >= 0, F.col("Segment"))).alias("n_clusters"), F.count_if(F.col("Segment") < 0).alias("n_noise"))
    row = collect_scalars(counts)
    quality = 0.0
    if row["n_clusters"] > 1:
        clustered = _vectors(points.join(labels.where("Segment >= 0"), key).select(x, y, "Segment"), [x, y])
        quality = ClusteringEvaluator(featuresCol="features", predictionCol="Segment").evaluate(clustered)
    return counts.withColumn("silhouette", F.lit(float(quality)))


def grid_density_clusters(points: DataFrame, x: str = "PC1", y: str = "PC2", key: str = "CustomerID",
                          cell: float = 0.25, min_samples: int = 10, min_cluster_size: int = 30) -> DataFrame:
    """SEG-2 (re-aimed): grid density clusters with noise label -1.

    Labels spread to neighbour cells and jump to their label's own label until
    nothing changes, so long clusters need few rounds and none is broken up.
    """
    pts = points.select(key, F.floor(F.col(x) / cell).cast("long").alias("cx"),
                        F.floor(F.col(y) / cell).cast("long").alias("cy")).persist()
    cells = pts.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    dense = cells.where(F.col("n") >= min_samples).select(
        "cx", "cy", "n", (F.col("cx") * F.lit(1 << 32) + F.col("cy")).alias("label"))
    dense = dense.withColumn("id", F.col("label")).checkpoint()
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    while True:
        spread = dense.select("cx", "cy", "label", F.explode(offsets).alias("o")).select(
            (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"),
            F.col("label").alias("nl"))
        best = spread.groupBy("cx", "cy").agg(F.min("nl").alias("nl"))
        upd = dense.join(best, ["cx", "cy"], "left").select(
            "cx", "cy", "n", "id", F.least(F.col("label"), F.coalesce("nl", F.col("label"))).alias("label"),
            F.col("label").alias("_old"))
        # pointer jump: a label is a cell's id and takes that cell's label; the root learns of a smaller one
        root = upd.groupBy(F.col("_old").alias("id")).agg(F.min("label").alias("_root"))
        upd = upd.join(root, "id", "left").withColumn("label", F.least("label", F.coalesce("_root", "label"))).drop("_root")
        jump = upd.select(F.col("id").alias("label"), F.col("label").alias("_to"))
        upd = upd.join(jump, "label", "left").select(
            "cx", "cy", "n", "id", F.least("label", F.coalesce("_to", "label")).alias("label"), "_old")
        upd = upd.withColumn("_chg", F.col("label") < F.col("_old")).drop("_old").checkpoint()
        changed = collect_scalars(upd.agg(F.count_if(F.col("_chg"))))[0]
        dense = upd.drop("_chg")
        if changed == 0:
            break
    dense = dense.drop("id")
    sizes = dense.groupBy("label").agg(F.sum("n").alias("size"))
    keep = sizes.where(F.col("size") >= min_cluster_size)
    # clusters are few (bounded by dense cells / min_cluster_size): a global
    # rank over them is cheap
    ranked = keep.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("Segment"))
    labels = dense.join(ranked, "label", "inner").select("cx", "cy", "Segment")
    out = pts.join(labels, ["cx", "cy"], "left").select(key, F.coalesce("Segment", F.lit(-1)).cast("int")
                                                         .alias("Segment"))
    return out


def profile_segments(df: DataFrame, label_col: str, feature_cols: list[str]) -> DataFrame:
    """SEG-6 / AGG-12: size, % and mean / median / std of each feature per
    label; label -1 is 'Noise/Outliers', others 'Segment <label>'."""
    feats = [c for c in feature_cols if c in df.columns]
    total = collect_scalars(df.agg(F.count(F.lit(1))))[0]
    agg = df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("Size"),
        *[e for c in feats for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])
    # one set of narrowing passes for all features
    stacked = df.select(label_col, F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in feats])).alias("_s")) \
        .select(label_col, "_s._col", "_s._v") if feats else None
    meds = {(r[label_col], r["_col"]): r["value"] for r in exact_quantiles(stacked, "_v", [0.5], [label_col, "_col"])} if feats else {}
    med_rows = [(lab, *[meds.get((lab, c)) for c in feats]) for lab in sorted({k[0] for k in meds})]
    med_schema = ", ".join([f"{label_col} {df.schema[label_col].dataType.simpleString()}"]
                           + [f"{c}_median double" for c in feats])
    med_df = df.sparkSession.createDataFrame(med_rows, med_schema) if med_rows else None
    out = agg.join(F.broadcast(med_df), label_col, "left") if med_df is not None else agg
    name = F.when(F.col(label_col) == -1, F.lit(NOISE_NAME)).otherwise(
        F.concat(F.lit("Segment "), F.col(label_col).cast("string")))
    cols = [name.alias("Segment"), F.col(label_col).alias("Label"), "Size",
            (F.col("Size") / F.lit(float(total)) * 100.0).alias("Percentage")]
    for c in feats:
        cols += [f"{c}_mean", f"{c}_median", f"{c}_std"]
    return out.select(*cols)


def assign_segment_names(profiles: DataFrame) -> DataFrame:
    """SEG-7: business names from profile means against the median over
    segments; missing columns count as false."""
    known = [c for c in ("TotalSpend_mean", "Frequency_mean", "RecencyDays_mean") if c in profiles.columns]
    medians = exact_quantiles_multi(profiles, known, [0.5]) if known else {}

    def flag(col: str, op: str):
        if not medians.get(col):
            return F.lit(False)
        med = medians[col][0.5]
        return (F.col(col) > F.lit(med)) if op == ">" else (F.col(col) < F.lit(med))
    hv, fr, rc = flag("TotalSpend_mean", ">"), flag("Frequency_mean", ">"), flag("RecencyDays_mean", "<")
    name = (F.when(hv & fr & rc, "VIP Champions").when(hv & fr, "At-Risk VIPs").when(hv, "Big Spenders")
            .when(fr & rc, "Loyal Regulars").when(rc, "New Active").when(fr, "Loyal but Lapsing")
            .otherwise("At Risk"))
    return profiles.select("Segment", "Label", name.alias("Name"))
