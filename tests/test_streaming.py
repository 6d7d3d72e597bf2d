import tempfile

from pyspark.sql import functions as F

from ledgerlens.sources.tables import Catalog
from ledgerlens.streaming.incremental import latest_state, rfm_from_state, start_rfm_stream
from ledgerlens.operators.value import calculate_rfm

SMOKE = "/root/testdata/sf0.001"


def test_streaming_rfm_matches_batch(spark):
    og = Catalog(spark, SMOKE).order_grain()
    src = tempfile.mkdtemp(prefix="ledgerlens-stream-src-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="ledgerlens-stream-ckpt-", dir="/tmp")
    cut = og.agg(F.max("OrderDate")).collect()[0][0].replace(month=1, day=1)  # orders arrive by date
    og.where(F.col("OrderDate") < F.lit(cut)).write.mode("append").parquet(src)
    table = tempfile.mkdtemp(prefix="ledgerlens-stream-table-", dir="/tmp")
    q = start_rfm_stream(spark, src, table, ckpt, "30 days")
    try:
        q.processAllAvailable()
        og.where(F.col("OrderDate") >= F.lit(cut)).write.mode("append").parquet(src)
        q.processAllAvailable()
        state = latest_state(spark, table)
        assert state.count() == state.select("CustomerID").distinct().count()
        got = {r["CustomerID"]: r for r in rfm_from_state(state).collect()}
    finally:
        q.stop()
    want = {r["CustomerID"]: r for r in calculate_rfm(og).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g["Recency"], g["Frequency"], g["Age"]) == (w["Recency"], w["Frequency"], w["Age"])
        assert abs(g["Monetary"] - w["Monetary"]) < 1e-6
