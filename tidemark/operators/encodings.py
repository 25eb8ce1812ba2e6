"""Codecs as analytic views. Parquet does the storage side; these expose the same transforms for analysis.

Each needs the symbol's previous tick. Ticks are dealt by symbol and span of time, so a symbol that has most ticks is
sorted by many tasks; the last tick of every span, one row each, is carried over to the symbol's next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions import HOUR
from tidemark.operators.order import by_time, moment
from tidemark.schema import SEQ

SPAN = 24 * HOUR


def _within(ticks: DataFrame) -> WindowSpec:
    return Window.partitionBy("symbol", "_span").orderBy(*by_time(ticks))


def _spans() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("_span")


def _spanned(ticks: DataFrame, span: int) -> DataFrame:
    return ticks.withColumn("_span", F.floor(F.col("timestamp") / F.lit(span)).cast("long"))


def with_previous(ticks: DataFrame, column: str, span: int = SPAN) -> DataFrame:
    """``_previous``: the column's value in the symbol's previous tick, null on its first."""
    dealt = _spanned(ticks, span)
    last = dealt.groupBy("symbol", "_span").agg(F.max_by(column, moment(ticks)).alias("_last"))
    carried = last.select("symbol", "_span", F.lag("_last").over(_spans()).alias("_carried"))
    inner = dealt.withColumn("_nth", F.row_number().over(_within(ticks))).withColumn("_inner", F.lag(column).over(_within(ticks)))
    joined = inner.join(carried, ["symbol", "_span"])
    previous = F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_inner"))
    return joined.withColumn("_previous", previous).drop("_span", "_nth", "_inner", "_carried")


def delta(ticks: DataFrame, column: str = "timestamp") -> DataFrame:
    """``delta``: difference to the previous tick of the symbol, null on its first."""
    return with_previous(ticks, column).withColumn("delta", F.col(column) - F.col("_previous")).drop("_previous")


def double_delta(ticks: DataFrame, column: str = "close") -> DataFrame:
    """``double_delta``: difference of consecutive differences, null on the first two ticks of a symbol."""
    once = with_previous(ticks, column).withColumn("_d", F.col(column) - F.col("_previous")).drop("_previous")
    return with_previous(once, "_d").withColumn("double_delta", F.col("_d") - F.col("_previous")).drop("_d", "_previous")


def xor_previous(ticks: DataFrame, column: str = "close") -> DataFrame:
    """``same``: whether the value repeats the symbol's previous one bit for bit (a zero XOR). 0.0 and -0.0, which
    compare as equal, are told apart as they are written; Spark has one NaN only."""
    value, previous = F.col(column), F.col("_previous")
    same = (value == previous) & ((value != 0) | (value.cast("string") == previous.cast("string")))
    return with_previous(ticks, column).withColumn("same", F.coalesce(same, F.lit(False))).drop("_previous")


def volume_runs(ticks: DataFrame, span: int = SPAN) -> DataFrame:
    """Run lengths of equal consecutive volumes: symbol, run (from 1), volume, run_length, first_timestamp."""
    known = with_previous(ticks, "volume", span)
    changed = F.coalesce((F.col("volume") != F.col("_previous")).cast("int"), F.lit(1))
    marked = _spanned(known.withColumn("_new", changed).drop("_previous"), span)
    # Runs begun in all earlier spans, and in this one so far.
    begun = marked.groupBy("symbol", "_span").agg(F.sum("_new").alias("_begun"))
    earlier = begun.select("symbol", "_span", (F.sum("_begun").over(_spans()) - F.col("_begun")).alias("_earlier"))
    so_far = F.sum("_new").over(_within(ticks).rowsBetween(Window.unboundedPreceding, 0))
    islands = marked.withColumn("_so_far", so_far).join(earlier, ["symbol", "_span"]).withColumn("run", F.col("_earlier") + F.col("_so_far"))
    return islands.groupBy("symbol", "run").agg(
        F.max("volume").alias("volume"),
        F.count(F.lit(1)).alias("run_length"),
        F.min("timestamp").alias("first_timestamp"),
    )


def symbol_ids(log: DataFrame) -> DataFrame:
    """Dictionary of symbols numbered from 0 by first appearance. The ranking sees one row per symbol only."""
    first = log.groupBy("symbol").agg(F.min(SEQ).alias("_first"))
    order = Window.orderBy("_first")
    return first.select("symbol", (F.row_number().over(order) - 1).alias("symbol_id"))
