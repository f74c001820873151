"""Labels, item and user preparation, interaction join and date splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import LabelRules, SplitDates
from feedloom.functions.columns import clip, date_to_ymd, days_between, flag, num, ymd_to_date


def add_labels(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """watch_ratio, finish, like, long_watch.

    The ratio is single precision, so thresholds are compared in single precision
    too: a ratio of exactly 0.95 passes a 0.95 threshold.
    """
    play = F.greatest(num("play_time_ms"), F.lit(0.0))
    duration = num("duration_ms")
    ratio = F.when(duration > 0, play / duration).otherwise(0.0)
    out = df.withColumn("watch_ratio", clip(ratio, 0.0, rules.max_ratio).cast("float"))
    at_least = lambda bound: F.col("watch_ratio") >= F.lit(bound).cast("float")
    if rules.use_long_view and "long_view" in df.columns:
        long_watch = num("long_view") > 0
    else:
        long_watch = at_least(rules.long_ratio) | (play >= rules.long_ms)
    return out.withColumns(
        {
            "finish": F.when(at_least(rules.finish_ratio), 1).otherwise(0),
            "like": num("is_like").cast("int"),
            "long_watch": F.when(long_watch, 1).otherwise(0),
        }
    )


def add_positive(df: DataFrame, name: str = "is_positive") -> DataFrame:
    hit = (F.coalesce("long_watch", F.lit(0)) > 0) | (F.coalesce("finish", F.lit(0)) > 0) | (
        F.coalesce("like", F.lit(0)) > 0
    )
    return df.withColumn(name, F.when(hit, 1).otherwise(0))


def prepare_items(items: DataFrame) -> DataFrame:
    parsed = F.try_to_date(F.substring(F.trim(F.col("upload_dt")), 1, 10), "yyyy-MM-dd")
    return items.withColumns(
        {
            "upload_date": date_to_ymd(parsed),
            "tag": F.coalesce(F.col("tag").cast("string"), F.lit("unknown")),
            "author_id": F.coalesce(F.col("author_id").try_cast("bigint"), F.lit(-1).cast("bigint")),
        }
    )


def prepare_users(users: DataFrame) -> DataFrame:
    return users.withColumn("user_id", F.col("user_id").try_cast("bigint"))


def prepare_interactions(logs: DataFrame, items: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """Typed, labelled exposures with their item side and age at exposure.

    The item side has one row per video.  Spark broadcasts it when it measures
    small; otherwise the sort-merge join splits a hot video through AQE.
    """
    typed = add_positive(add_labels(logs, rules)).withColumns(
        {
            "user_id": F.col("user_id").try_cast("bigint"),
            "video_id": F.col("video_id").try_cast("bigint"),
            "date": F.col("date").try_cast("int"),
            "time_ms": F.coalesce(F.col("time_ms").try_cast("bigint"), F.lit(0).cast("bigint")),
            "hourmin": F.coalesce(F.col("hourmin").try_cast("int"), F.lit(-1)),
        }
    )
    side = items.select(
        "video_id", "author_id", "tag", "upload_dt", "upload_date", "video_duration"
    ).dropDuplicates(["video_id"])
    out = typed.join(side, "video_id", "left")
    return out.withColumns(
        {
            "freshness_days": days_between(ymd_to_date("date"), ymd_to_date("upload_date")),
            "author_id": F.coalesce("author_id", F.lit(-1).cast("bigint")),
            "tag": F.coalesce("tag", F.lit("unknown")),
        }
    )


def in_time_order(df: DataFrame) -> DataFrame:
    """Total order for a written table; stages themselves do not need it."""
    return df.orderBy("time_ms", "user_id", "video_id")


def split_by_date(df: DataFrame, dates: SplitDates = SplitDates()) -> dict[str, DataFrame]:
    """Three filters on inclusive bounds.

    Gaps drop rows and overlapping bounds put a row in two splits, so one CASE
    over the date would not do.
    """
    if dates.strategy != "date":
        raise ValueError(f"unsupported split strategy: {dates.strategy}")
    d = F.col("date")
    return {
        "train": df.filter(d <= dates.train_end),
        "val": df.filter((d >= dates.val_start) & (d <= dates.val_end)),
        "test": df.filter(d >= dates.test_start),
    }


def split_summary(splits: dict[str, DataFrame]) -> DataFrame:
    tagged = [
        d.select(F.lit(name).alias("split"), "user_id", "video_id", "date") for name, d in splits.items()
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("split")
        .agg(
            F.count("*").alias("rows"),
            F.countDistinct("user_id").alias("users"),
            F.countDistinct("video_id").alias("items"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


def positive_pairs(df: DataFrame, label: str = "is_positive") -> DataFrame:
    """Distinct (user, item) pairs with a positive label."""
    return df.filter(flag(label) == 1).select("user_id", "video_id").distinct()


def attach_label(candidates: DataFrame, split: DataFrame, label: str = "is_positive") -> DataFrame:
    pairs = positive_pairs(split, label).withColumn("label", F.lit(1))
    return candidates.join(pairs, ["user_id", "video_id"], "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )
