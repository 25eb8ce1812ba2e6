"""Views of other tables as ticks, and ingest from rows or columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions import epoch_ns
from tidemark.schema import COLUMNS, PRICES, SEQ, TICK_SCHEMA

# Rows that the driver turns into a DataFrame at once.
PART_ROWS = 100_000
PLACE = "_place"


def _raw_bounds(ts: Column, start: int | None, end: int | None) -> Column:
    """The range on the stored microsecond column, widened to whole microseconds, so that Parquet can prune."""
    bound = F.lit(True)
    if start is not None:
        bound &= ts >= F.timestamp_micros(F.lit(start // 1000)).cast("timestamp_ntz")
    if end is not None:
        bound &= ts <= F.timestamp_micros(F.lit(-(-end // 1000))).cast("timestamp_ntz")
    return bound


def ticks_from_events(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events as ticks with sequence ``event_id``. Nanosecond bounds, when given, also restrict the scan itself."""
    rows = events if start is None and end is None else events.filter(_raw_bounds(F.col("ts"), start, end))
    value = F.col("value")
    return rows.select(
        epoch_ns(F.col("ts")).alias("timestamp"), F.col("event_type").alias("symbol"),
        value.alias("open"), (value + 1).alias("high"), (value - 1).alias("low"), value.alias("close"),
        (F.col("user_id") + 1).alias("volume"), F.col("event_id").alias(SEQ),
    )


def ticks_from_orders(orders: DataFrame) -> DataFrame:
    """Orders as ticks whose keys repeat; ``o_orderkey`` orders the writes."""
    price = F.col("o_totalprice")
    return orders.select(
        epoch_ns(F.col("o_orderdate")).alias("timestamp"), F.col("o_orderpriority").alias("symbol"),
        *[price.alias(name) for name in PRICES], F.col("o_custkey").alias("volume"), F.col("o_orderkey").alias(SEQ),
    )


def bars_from_lineitem(lineitem: DataFrame, width: int) -> DataFrame:
    """Order-free bars of shipped items: keys repeat here, so a bar has no open or close."""
    from tidemark.functions import bucket

    price, size = F.col("l_extendedprice"), F.col("l_quantity")
    worth = F.sum(price.cast("decimal(18,2)")).cast("double")
    traded = F.sum(size.cast("long"))
    return lineitem.groupBy(
        F.col("l_returnflag").alias("symbol"), bucket(epoch_ns(F.col("l_shipdate")), width).alias("timestamp")
    ).agg(
        F.max(price / size).alias("high"), F.min(price / size).alias("low"),
        traded.alias("volume"), (worth / traded.cast("double")).alias("vwap"),
    )


def from_rows(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Ticks from mappings; absent prices and volumes are zero. They are sent as Arrow batches."""
    rows = list(rows)

    def column(name: str) -> pa.Array:
        if name in PRICES:
            return pa.array([float(row.get(name, 0.0)) for row in rows], pa.float64())
        if name == "volume":
            return pa.array([row.get(name, 0) for row in rows], pa.int64())
        return pa.array([row[name] for row in rows], pa.string() if name == "symbol" else pa.int64())

    return spark.createDataFrame(pa.table({name: column(name) for name in COLUMNS}), TICK_SCHEMA)


def _arrays(columns: Mapping[str, Sequence]) -> dict[str, Sequence]:
    arrays = {name: columns[name] for name in COLUMNS if name != "symbol"}
    if len({len(values) for values in arrays.values()}) > 1:
        raise ValueError("all arrays must have same length")
    return arrays


def from_columns(spark: SparkSession, symbol: str, columns: Mapping[str, Sequence]) -> DataFrame:
    """Ticks of one symbol from six arrays of one length, sent as Arrow batches."""
    arrays = _arrays(columns)
    frame = pd.DataFrame({name: pd.Series(values, dtype="float64" if name in PRICES else "int64") for name, values in arrays.items()})
    frame.insert(1, "symbol", symbol)
    return spark.createDataFrame(frame[list(COLUMNS)], TICK_SCHEMA)


def in_parts(rows: Iterable, size: int | None = None) -> Iterator[list]:
    """Lists of up to ``size`` of the rows, read as they are asked for."""
    rest = iter(rows)
    while part := list(islice(rest, size or PART_ROWS)):
        yield part


def column_parts(columns: Mapping[str, Sequence]) -> Iterator[dict[str, Sequence]]:
    """The same six arrays, some rows at a time."""
    arrays = _arrays(columns)
    for low in range(0, max(1, len(arrays["timestamp"])), PART_ROWS):
        yield {name: values[low : low + PART_ROWS] for name, values in arrays.items()}


def spooled(frames: Iterable[DataFrame], folder: str) -> DataFrame | None:
    """What comes in parts as one DataFrame, None if nothing comes. A single part stays as it is; of more, each is written
    to ``folder`` before the next is asked for, its rows with their places in PLACE, so that the driver holds one."""
    frames = iter(frames)
    begin = list(islice(frames, 2))
    if len(begin) < 2:
        return begin[0] if begin else None
    spark, schema = begin[0].sparkSession, begin[0].schema
    for number, frame in enumerate(chain(begin, frames)):
        # The one partition keeps the order.
        place = F.lit(number << 33).cast("long") + F.monotonically_increasing_id()
        frame.coalesce(1).withColumn(PLACE, place).write.parquet(f"{folder}/{number:08d}")
    return spark.read.schema(StructType([*schema, StructField(PLACE, LongType())])).parquet(f"{folder}/*")
