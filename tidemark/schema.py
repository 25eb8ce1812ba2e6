"""The tick schema and the checks that ingest applies to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ = "_seq"
PRICES = ("open", "high", "low", "close")
COLUMNS = ("timestamp", "symbol", *PRICES, "volume")

TICK_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("symbol", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in PRICES],
        T.StructField("volume", T.LongType()),
    ]
)
LOG_SCHEMA = T.StructType([*TICK_SCHEMA.fields, T.StructField(SEQ, T.LongType())])


def conform(df: DataFrame) -> DataFrame:
    """Project ``df`` to the tick schema.

    ``timestamp`` and ``symbol`` are required: a null in either, or a negative volume, fails the job
    that reads the result. Prices and volume default to zero when null or absent.
    """
    have = set(df.columns)
    for name in ("timestamp", "symbol"):
        if name not in have:
            raise ValueError(f"missing required column: {name}")

    def required(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind)
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"null {name}")).cast(kind))

    def defaulted(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind)) if name in have else F.lit(0).cast(kind)

    volume = defaulted("volume", "long")
    checked = F.when(volume >= 0, volume).otherwise(F.raise_error(F.lit("negative volume")).cast("long"))
    return df.select(
        required("timestamp", "long").alias("timestamp"),
        required("symbol", "string").alias("symbol"),
        *[defaulted(name, "double").alias(name) for name in PRICES],
        checked.alias("volume"),
    )
