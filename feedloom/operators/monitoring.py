"""Request-log counters and latency summaries, batch and windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import FeedbackRules
from feedloom.functions.columns import fixed_sum
from feedloom.functions.ordering import top_per

SERIES = ("total", "recall", "prerank", "rank", "rerank")


def request_counters(log: DataFrame) -> DataFrame:
    """One row of counts over the request log."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    recommend = F.col("event") == "recommend"
    hits = n(recommend & F.col("cache_hit"))
    return log.agg(
        F.count("*").alias("request_count"),
        n(recommend).alias("recommend_request_count"),
        n(F.col("event") == "feedback").alias("feedback_request_count"),
        n(F.col("event") == "health").alias("health_request_count"),
        n(F.col("event") == "error").alias("error_count"),
        n(recommend & F.col("degraded_mode")).alias("degraded_mode_count"),
        hits.alias("cache_hit_count"),
        (hits / F.greatest(n(recommend), F.lit(1))).alias("cache_hit_rate"),
        F.coalesce(F.sum(F.when(recommend, F.col("returned_items"))), F.lit(0)).alias("recommended_items_count"),
    )


def latency_summary(log: DataFrame, rules: FeedbackRules = FeedbackRules()) -> DataFrame:
    """(series, n, mean, p50, p95, p99) over the newest ``latency_window`` samples of each series.

    The window is cut before the percentiles, on both sides of the shuffle.
    """
    samples = F.array(
        *[F.struct(F.lit(s).alias("series"), F.col(f"{s}_latency_ms").cast("double").alias("ms")) for s in SERIES]
    )
    rows = log.filter(F.col("event") == "recommend").select("time_ms", "event_id", F.explode(samples).alias("x"))
    rows = rows.select("time_ms", "event_id", "x.series", "x.ms").filter(F.col("ms").isNotNull())
    order = [F.col("time_ms").desc(), F.col("event_id").desc()]
    last = _newest(rows, order, rules.latency_window)
    return last.groupBy("series").agg(
        F.count("*").alias("n"),
        (fixed_sum("ms") / F.count("*")).alias("mean"),
        F.percentile("ms", 0.5).alias("p50"),
        F.percentile("ms", 0.95).alias("p95"),
        F.percentile("ms", 0.99).alias("p99"),
    )


def _newest(rows: DataFrame, order: list, n: int, spread: int = 64) -> DataFrame:
    """Newest n rows per series in two steps: per slice of the series, then over the slices.

    A handful of series hold all rows, so the first step spreads each over many tasks.
    """
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64("event_id"), F.lit(spread)))
    partial = top_per(sliced, ["series", "_slice"], order, n, "_r").drop("_r", "_slice")
    return top_per(partial, "series", order, n, "_r").drop("_r")


def windowed_requests(log: DataFrame, width: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Counters per tumbling window; with a stream, set the watermark before calling."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    recommend = F.col("event") == "recommend"
    return (
        log.groupBy(F.window(ts, width).alias("w"), "event")
        .agg(
            F.count("*").alias("requests"),
            n(recommend & F.col("cache_hit")).alias("cache_hits"),
            n(F.col("degraded_mode")).alias("degraded"),
            F.sum(F.col("total_latency_ms")).alias("latency_sum"),
            F.max("total_latency_ms").alias("latency_max"),
        )
        .select(F.col("w.start").alias("window_start"), "event", "requests", "cache_hits", "degraded", "latency_sum", "latency_max")
    )
