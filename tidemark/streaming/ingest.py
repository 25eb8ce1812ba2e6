"""Continuous ingest: any streaming source of ticks into a segment store, one segment per micro-batch.

No watermark: a tick of any age is accepted and upserts its key. The manifest remembers the last batch of each stream,
so one that is replayed after a failure is added once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.schema import PRICES, TICK_SCHEMA
from tidemark.sources.store import SegmentStore

_BROKEN = "_broken"


def parse_ticks(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts as ticks, with ``error``: null, or why the tick is refused. Numbers that are missing become zero."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TICK_SCHEMA)
    raw = F.col(column).cast("string")
    tick = F.from_json(raw, f"{fields}, {_BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"tick.{name}"), F.lit(0)).cast(TICK_SCHEMA[name].dataType)

    error = (
        F.when(F.col(f"tick.{_BROKEN}").isNotNull() | F.col("tick").isNull(), "not a tick in JSON")
        .when(F.col("tick.symbol").isNull(), "missing symbol")
        .when(F.col("tick.timestamp").isNull(), "missing timestamp")
        .when(F.col("tick.volume") < 0, "negative volume")
    )
    return lines.select(raw.alias("raw"), tick.alias("tick")).select(
        F.col("tick.timestamp").alias("timestamp"), F.col("tick.symbol").alias("symbol"), *[number(p).alias(p) for p in PRICES],
        number("volume").alias("volume"), "raw", error.alias("error"),
    )


def ingest_stream(stream: DataFrame, store: SegmentStore, checkpoint: str, once: bool = True, rejects: str | None = None) -> StreamingQuery:
    """Start appending ``stream`` to ``store``; with ``once`` it stops when the source is drained.

    A stream with an ``error`` column (see :func:`parse_ticks`) has its refused ticks written to ``rejects``, by batch;
    of other streams a bad tick fails the batch.
    """
    trigger = {"availableNow": True} if once else {"processingTime": "1 second"}

    def add(batch: DataFrame, number: int) -> None:
        good = batch
        if "error" in batch.columns:
            good = batch.filter("error IS NULL")
            if rejects is not None:
                batch.filter("error IS NOT NULL").select("raw", "error").write.mode("overwrite").json(f"{rejects}/batch={number}")
        store.append(good, batch=(checkpoint, number))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest_json(spark: SparkSession, directory: str, store: SegmentStore, checkpoint: str, rejects: str | None = None) -> StreamingQuery:
    """Ingest a directory of JSON-lines ticks; numbers that are missing become zero. With ``rejects`` bad lines go there."""
    if rejects is None:
        return ingest_stream(spark.readStream.schema(TICK_SCHEMA).json(directory), store, checkpoint)
    return ingest_stream(parse_ticks(spark.readStream.text(directory)), store, checkpoint, rejects=rejects)


def ingest_kafka(spark: SparkSession, options: dict[str, str], store: SegmentStore, checkpoint: str, rejects: str) -> StreamingQuery:
    """Ingest JSON ticks from Kafka topics, one per message, without end; needs Spark's Kafka connector on the class path."""
    messages = spark.readStream.format("kafka").options(**options).load()
    return ingest_stream(parse_ticks(messages), store, checkpoint, once=False, rejects=rejects)
