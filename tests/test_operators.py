import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import HOUR, MINUTE, SECOND, bucket
from tidemark.operators import bars, encodings, last_write_wins, price_filter, range_scan
from tidemark.plans import plan
from tidemark.schema import COLUMNS, LOG_SCHEMA, TICK_SCHEMA, conform

NAN = float("nan")


def ticks(spark, rows):
    return spark.createDataFrame([(t, s, *map(float, p), v) for t, s, p, v in rows], TICK_SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.orderBy("symbol", "timestamp").collect()]


@pytest.fixture
def two_bars(spark):
    at = [0, 20 * SECOND, 60 * SECOND - 1, 60 * SECOND, 61 * SECOND, 119 * SECOND]
    return ticks(spark, [(t, "A", (10 + i, 20 + i, 5 - i, 15 + i), 100 + i) for i, t in enumerate(at)])


def test_bars(two_bars):
    assert rows_of(bars.ohlcv(two_bars, MINUTE)) == [(0, "A", 10, 22, 3, 17, 303), (MINUTE, "A", 13, 25, 0, 20, 312)]
    assert rows_of(bars.sum_bars(two_bars, MINUTE))[0] == (0, "A", 0, 0, 0, 303, 303)
    assert rows_of(bars.count_bars(two_bars, MINUTE))[1] == (MINUTE, "A", 0, 0, 0, 3, 3)
    assert rows_of(bars.count_bars(two_bars, MINUTE, compat=True))[1] == (MINUTE, "A", 0, 0, 0, 1, 1)
    assert rows_of(bars.vwap_bars(two_bars, MINUTE))[0][2] == pytest.approx((15 * 100 + 16 * 101 + 17 * 102) / 303)


def test_buckets_truncate_toward_zero(spark):
    df = spark.createDataFrame([(s * SECOND,) for s in (-90, -30, 0, 30, 90)], "t long")
    assert [r[0] for r in df.select(bucket(F.col("t"), MINUTE)).collect()] == [-MINUTE, 0, 0, 0, MINUTE]


def test_nan(spark):
    df = ticks(spark, [(0, "A", (1, NAN, 1, NAN), 1), (1, "A", (1, 3, 1, 2), 1), (2, "B", (1, NAN, 1, NAN), 1)])
    assert price_filter(df, ">", 0).count() == price_filter(df, ">=", 0).count() == 1
    assert price_filter(df, "<", 9).count() == price_filter(df, "=", 2).count() == 1
    a, b = rows_of(bars.ohlcv(df, HOUR))
    assert a[3] == 3 and math.isnan(b[3])


def test_empty_and_zero_volume(spark):
    none = ticks(spark, [])
    assert rows_of(bars.ohlcv(none, HOUR)) == []
    assert rows_of(bars.range_vwap(none, "A")) == [(0, "A", 0, 0, 0, 0, 0)]
    assert rows_of(bars.vwap_bars(ticks(spark, [(0, "A", (1, 1, 1, 1), 0)]), HOUR))[0][5] == 0
    assert range_scan(ticks(spark, [(5, "A", (1, 1, 1, 1), 1)]), "A", 9, 1).count() == 0


def test_nanoseconds_are_exact(spark):
    t = 1_700_000_000_000_000_000
    df = ticks(spark, [(t, "A", (1, 1, 1, 1), 1), (t + 1, "A", (1, 1, 1, 1), 1)])
    assert plan(df, f"SELECT * FROM A WHERE timestamp BETWEEN {t + 1} AND {t + 1}").count() == 1


def test_last_write_wins(spark):
    log = spark.createDataFrame([(1, "A", 1.0, 1.0, 1.0, c, 1, seq) for c, seq in ((7.0, 3), (5.0, 1), (6.0, 2))], LOG_SCHEMA)
    assert [r["close"] for r in last_write_wins(log).collect()] == [7.0]


def test_conform(spark):
    df = spark.createDataFrame([(1, "A", None)], "timestamp long, symbol string, close double")
    assert rows_of(conform(df)) == [(1, "A", 0, 0, 0, 0, 0)]
    with pytest.raises(Exception, match="null symbol"):
        conform(df.withColumn("symbol", F.lit(None).cast("string"))).collect()
    with pytest.raises(Exception, match="negative volume"):
        conform(df.withColumn("volume", F.lit(-1))).collect()


def test_encodings(spark):
    df = ticks(spark, [(i * i, "A", (1, 1, 1, c), v) for i, (c, v) in enumerate([(1, 5), (1, 5), (4, 6), (9, 5)])])
    assert [r["delta"] for r in encodings.delta(df).orderBy("timestamp").collect()] == [None, 1, 3, 5]
    assert [r["double_delta"] for r in encodings.double_delta(df).orderBy("timestamp").collect()] == [None, None, 3, 2]
    assert [r["same"] for r in encodings.xor_previous(df).orderBy("timestamp").collect()] == [False, True, False, False]
    runs = [(r["volume"], r["run_length"]) for r in encodings.volume_runs(df).orderBy("run").collect()]
    assert runs == [(5, 2), (6, 1), (5, 1)]


def test_codec_views_across_spans(spark):
    """Previous ticks are found over empty spans, and zeros of different sign are different bits."""
    day = 24 * HOUR
    rows = [(0, -0.0, 7), (5, 0.0, 7), (3 * day, 0.0, 7), (3 * day + 1, NAN, 8), (9 * day, NAN, 8), (-day, 4.0, 1)]
    df = ticks(spark, [(t, "A", (1, 1, 1, c), v) for t, c, v in rows])
    by_time = lambda d, c: [r[c] for r in d.orderBy("timestamp").collect()]
    assert by_time(encodings.delta(df), "delta") == [None, day, 5, 3 * day - 5, 1, 6 * day - 1]
    assert by_time(encodings.xor_previous(df), "same") == [False, False, False, True, False, True]
    assert [(r["run"], r["run_length"]) for r in encodings.volume_runs(df).orderBy("run").collect()] == [(1, 1), (2, 3), (3, 2)]


def fold(rows, width):
    """One pass over ticks in time order, as a model of the bars."""
    out = []
    for t, (o, h, lo, c), v in sorted(rows):
        start = int(t / width) * width
        if out and out[-1][0] == start:
            bar = out[-1]
            bar[2], bar[3], bar[4], bar[5] = max(bar[2], h), min(bar[3], lo), c, bar[5] + v
        else:
            out.append([start, o, h, lo, c, v])
    return out


def test_bars_match_a_fold(spark):
    rng = random.Random(7)
    rows = [(t, tuple(float(rng.randrange(100)) for _ in range(4)), rng.randrange(9)) for t in rng.sample(range(-5000, 5000), 800)]
    got = rows_of(bars.ohlcv(ticks(spark, [(t, "A", p, v) for t, p, v in rows]).repartition(5), 60))
    assert [[t, *rest] for t, _, *rest in got] == fold(rows, 60)


def test_plans_prune_and_push_down(spark):
    from tidemark.queries import END, START, events

    text = plan(events(spark, "/root/testdata/sf0.001", START, END), f"SELECT close FROM click WHERE timestamp BETWEEN {START} AND {END}")
    physical = text._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in physical and "EqualTo(event_type,click)" in physical
    assert "user_id" not in physical.split("ReadSchema")[-1].split("\n")[0]


def test_columns_in_order(two_bars):
    assert tuple(bars.ohlcv(two_bars, MINUTE).columns) == COLUMNS
