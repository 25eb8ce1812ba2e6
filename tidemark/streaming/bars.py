"""Live bars without a watermark: each micro-batch recomputes exactly the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bucket
from tidemark.operators.bars import ohlcv


def maintain_bars(ticks: DataFrame, batch: DataFrame, width: int) -> DataFrame:
    """Bars of the buckets with a tick in ``batch``, computed from all resolved ``ticks``.

    Late ticks land in their bucket however old they are. The touched buckets reach the scan as a left-semi join.
    """
    touched = batch.select("symbol", bucket(F.col("timestamp"), width).alias("_bucket")).distinct()
    inside = ticks.withColumn("_bucket", bucket(F.col("timestamp"), width)).join(touched, ["symbol", "_bucket"], "left_semi")
    return ohlcv(inside.drop("_bucket"), width)
