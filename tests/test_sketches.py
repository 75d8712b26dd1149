"""Quantile sketches: errors within the bound, merged weeks without events, distances of distributions."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from lorequarry.operators import telemetry

T0 = datetime(2026, 1, 5)


def events(spark, values, days=7):
    rows = [(T0 + timedelta(days=i % days, seconds=i % 80_000), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts timestamp, value double").repartition(5)


def test_a_week_from_stored_days(spark, tmp_path):
    r = np.random.default_rng(1)
    values = np.concatenate([r.lognormal(0, 2, 30_000), [5.0] * 3_000])
    odd = spark.createDataFrame([(T0, None), (T0, float("nan")), (T0, float("inf")), (None, 1.0)], "ts timestamp, value double")
    telemetry.daily_sketches(events(spark, values).unionByName(odd), F.col("value")).write.parquet(f"{tmp_path}/days")
    days = spark.read.parquet(f"{tmp_path}/days")
    assert days.count() == 7 and days.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    shares = (0.01, 0.25, 0.5, 0.95, 0.99)
    week = telemetry.merged_sketches(days, F.lit("w")).select("n", *[telemetry.sketch_quantile(F.col("sketch"), s).alias(f"q{s}") for s in shares]).first()
    assert week.n == len(values)
    for s in shares:
        x = week[f"q{s}"]
        assert (values < x).mean() - 0.01 <= s <= (values <= x).mean() + 0.01


def test_distances(spark):
    r = np.random.default_rng(2)
    one, same, shifted = (telemetry.merged_sketches(telemetry.daily_sketches(events(spark, r.normal(m, 1, 8_000)), F.col("value")), F.lit(1)).select(F.col("sketch").alias(n)) for m, n in ((0, "a"), (0, "b"), (1, "c")))
    row = one.crossJoin(same).crossJoin(shifted).select(telemetry.sketch_distance(F.col("a"), F.col("b")).alias("none"), telemetry.sketch_distance(F.col("a"), F.col("c")).alias("some")).first()
    assert row.none < 0.04 and abs(row.some - 0.383) < 0.04  # 2 * Phi(1/2) - 1


def test_nothing_to_sketch(spark):
    assert telemetry.daily_sketches(events(spark, [1.0]).filter("value > 2"), F.col("value")).count() == 0
