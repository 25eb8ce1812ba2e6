"""Key resolution: one tick per (symbol, timestamp), the one ingested last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import SEQ


def last_write_wins(log: DataFrame, keep_seq: bool = False) -> DataFrame:
    """Keep the row with the largest sequence of each key.

    Planned with a window-group limit: each task keeps its best row of a key before the shuffle, so a key
    that was overwritten very often sends one row per task. Filters on key columns go below it.
    """
    newest = Window.partitionBy("symbol", "timestamp").orderBy(F.col(SEQ).desc())
    kept = log.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    return kept if keep_seq else kept.drop(SEQ)


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Union of overlapping runs with keys resolved across them."""
    return last_write_wins(reduce(DataFrame.unionByName, runs))
