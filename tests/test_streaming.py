"""The streaming contingency audit equals the batch audit."""

import os
import tempfile

import pytest

from paritylab.operators import fairness as fm
from paritylab.sources.fixtures import load_view
from paritylab.streaming import metrics_from_stream_counts, stream_fairness_counts
from tests.conftest import SMOKE


def test_stream_equals_batch(spark):
    d = load_view(spark, SMOKE, "audit_orders").select("segment", "y", "y_pred")
    src = tempfile.mkdtemp(prefix="paritylab-stream-")
    d.repartition(4).write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(d.schema).parquet(os.path.join(src, "in"))
    counts = stream_fairness_counts(stream, "segment", "BUILDING", "y", "y_pred")
    q = (counts.writeStream.outputMode("complete").format("memory").queryName("fair_counts")
         .option("checkpointLocation", os.path.join(src, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = metrics_from_stream_counts(spark.table("fair_counts")).first()
    want = fm.fairness_metrics(d, "segment", "BUILDING", label="y", pred="y_pred").first()
    for m in ("spd", "di", "eod", "aod"):
        assert got[m] == pytest.approx(want[m])
