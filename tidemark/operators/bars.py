"""Time-bucket aggregates. Each is one hash aggregation: partial per task, one shuffle of partial bars, final."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bucket, max_ignoring_nan
from tidemark.operators.order import moment
from tidemark.schema import COLUMNS, PRICES

Aggregate = Callable[[DataFrame, int], DataFrame]


def _grouped(ticks: DataFrame, width: int):
    return ticks.groupBy(F.col("symbol"), bucket(F.col("timestamp"), width).alias("bucket"))


def _flat(bars: DataFrame, close: Column, volume: Column) -> DataFrame:
    """The seven-column shape in which sums and counts travel: prices are zero but the close."""
    zero = F.lit(0.0)
    return bars.select(
        F.col("bucket").alias("timestamp"), "symbol", *[zero.alias(p) for p in PRICES[:3]],
        close.alias("close"), volume.alias("volume"),
    )


def ohlcv(ticks: DataFrame, width: int) -> DataFrame:
    """Open, high, low, close and volume of each non-empty bucket; NaN does not win a high.

    Of several ticks at the time of an open or close the first by sequence, where that is known, gives it, as in SQL."""
    return _grouped(ticks, width).agg(
        F.min_by("open", moment(ticks)).alias("open"),
        max_ignoring_nan(F.col("high")).alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", moment(ticks, first_wins=True)).alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("bucket", "timestamp").select(*COLUMNS)


def sum_bars(ticks: DataFrame, width: int) -> DataFrame:
    """Total volume of each bucket, as close and as volume."""
    bars = _grouped(ticks, width).agg(F.sum("volume").alias("total"))
    return _flat(bars, F.col("total").cast("double"), F.col("total"))


def count_bars(ticks: DataFrame, width: int, compat: bool = False) -> DataFrame:
    """Ticks in each bucket; with ``compat`` a constant one per non-empty bucket."""
    bars = _grouped(ticks, width).agg(F.count(F.lit(1)).alias("total"))
    total = F.lit(1).cast("long") if compat else F.col("total")
    return _flat(bars, total.cast("double"), total)


def _mean(weighted: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(weighted / total.cast("double"))


def _weighted(exact: bool) -> Column:
    """Sum of close times volume. ``exact`` adds decimals of two places, so the order of addition cannot show."""
    if exact:
        return F.sum(F.col("close").cast("decimal(18,2)") * F.col("volume").cast("decimal(18,0)")).cast("double")
    return F.sum(F.col("close") * F.col("volume"))


def vwap_bars(ticks: DataFrame, width: int, exact: bool = False) -> DataFrame:
    """Volume-weighted average close of each bucket, 0.0 where no volume traded."""
    bars = _grouped(ticks, width).agg(_weighted(exact).alias("weighted"), F.sum("volume").alias("total"))
    mean = _mean(F.col("weighted"), F.col("total"))
    return bars.select(
        F.col("bucket").alias("timestamp"), "symbol", *[mean.alias(p) for p in PRICES], F.col("total").alias("volume")
    )


def range_vwap(ticks: DataFrame, symbol: str, exact: bool = False) -> DataFrame:
    """One row for the whole input, stamped with its first tick; zeros when there is none."""
    zero = F.lit(0).cast("long")
    total = F.coalesce(F.sum("volume"), zero)
    one = ticks.agg(
        F.coalesce(F.min("timestamp"), zero).alias("timestamp"),
        F.coalesce(_weighted(exact), F.lit(0.0)).alias("weighted"),
        total.alias("total"),
    )
    mean = _mean(F.col("weighted"), F.col("total"))
    return one.select(
        "timestamp", F.lit(symbol).alias("symbol"), *[mean.alias(p) for p in PRICES], F.col("total").alias("volume")
    )
