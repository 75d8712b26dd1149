"""Batch analytics over query telemetry: health, usage, sessions, rates, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prices in dollars for a million tokens.
GENERATE = {"input": 3.0, "output": 15.0}
BATCH = {"input": 0.5, "output": 2.5, "cache_write": 0.625, "cache_read": 0.05}
# Alert limits.
ERROR_SHARE, SLOW_P95, DAILY_CHANGE = 0.05, 10.0, 0.20


def cost(prices: dict[str, float], counts: dict[str, Column]) -> Column:
    """Dollars for token counts by kind."""
    out = F.lit(0.0)
    for kind, n in counts.items():
        out = out + F.coalesce(n, F.lit(0)) * F.lit(prices[kind]) / F.lit(1e6)
    return out


def daily_health(events: DataFrame, failed: Column, seconds: Column) -> DataFrame:
    """(day, n, errors, p95, change, alert flags): per day volume, failures, latency and change against the day before."""
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.percentile(seconds, F.lit(0.95)).alias("p95"))
    before = F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("day"))  # a row per day
    daily = daily.withColumn("change", (F.col("n") - before) / before)
    return daily.withColumns({"too_many_errors": F.col("errors") / F.col("n") > ERROR_SHARE, "too_slow": F.col("p95") > SLOW_P95, "index_jump": F.coalesce(F.abs("change") > DAILY_CHANGE, F.lit(False))})


def usage(events: DataFrame, group: str, n: int) -> DataFrame:
    """The n most active users of each group, ties by user."""
    counts = events.groupBy(group, "user_id").agg(F.count("*").alias("events"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("events"), "user_id"))).filter(F.col("place") <= n)


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, started, ended, n): runs of a user's events with gaps below the limit."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp")) >= gap_minutes * 60_000_000, F.lit(True))
    marked = events.withColumn("_new", new.cast("int")).withColumn("_session", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "_session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("_session")


def windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows of event time."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def low_confidence(events: DataFrame, score: Column, limit: float) -> DataFrame:
    """Per day the share of queries whose best score is below the limit."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(score < limit).alias("low"), F.avg((score < limit).cast("int")).alias("share"))


def progress(requests: DataFrame) -> DataFrame:
    """(status, n, percent) of a batch of requests."""
    total = requests.agg(F.count("*").alias("total"))
    counts = requests.groupBy("status").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def index_coverage(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: documents expected, stored among them, missing, and stored without being expected."""
    have, want = (df.select(key).distinct().withColumn(name, F.lit(True)) for df, name in ((stored, "have"), (expected, "want")))
    both = have.join(want, key, "full_outer")
    return both.agg(F.count("want").alias("expected"), F.count_if(F.expr("have and want")).alias("stored"), F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected"))


#: Size of a quantile sketch: ranks are off by less than a hundredth, nearly always, whatever the number of values.
SKETCH_K = 400


def daily_sketches(events: DataFrame, value: Column, by: tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """(day, by, n, sketch): the values of each day, and of each of its groups, as a quantile sketch of some kilobytes; null and non-finite values don't count."""
    kept = events.select(F.to_date("ts").alias("day"), *by, value.cast("double").alias("_value"))
    usable = F.col("_value").isNotNull() & ~F.isnan("_value") & (F.abs("_value") < float("inf"))
    kept = kept.filter(usable & F.col("day").isNotNull())
    return kept.groupBy("day", *by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, period: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(period, by, n, sketch): stored sketches merged into those of longer periods, without the events."""
    return sketches.groupBy(period.alias("period"), *by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantile(sketch: Column, share: float) -> Column:
    """The value below or at which so large a share of a sketch's values lies, within the sketch's error."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def sketch_distance(a: Column, b: Column, steps: int = 100) -> Column:
    """The Kolmogorov distance of two sketches' distributions, to one part in steps and the sketches' error."""
    shares = F.array(*[F.lit((i + 0.5) / steps) for i in range(steps)])
    one, two = (F.kll_sketch_get_quantile_double(s, shares) for s in (a, b))
    rank = lambda quantiles, x: F.size(F.filter(quantiles, lambda q: q <= x)) / F.lit(steps)
    return F.array_max(F.transform(F.concat(one, two), lambda x: F.abs(rank(one, x) - rank(two, x))))
