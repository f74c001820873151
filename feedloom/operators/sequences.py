"""Per-user behaviour sequences, oldest first.

A user may hold any share of the log: rows are cut to the newest ``max_len``
before they are collected, and the cut also runs on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import SequenceRules
from feedloom.functions.columns import flag, tail
from feedloom.functions.ordering import top_per

_NEWEST = lambda: [F.col("time_ms").desc(), F.col("video_id").desc()]
_EMPTY = lambda: F.array().cast("array<bigint>")


def _ordered_ids(condition=None):
    """Collected items of the (already trimmed) rows, oldest first."""
    pair = F.struct("time_ms", "video_id", "_back")
    kept = F.collect_list(pair if condition is None else F.when(condition, pair))
    oldest_first = F.array_sort(kept)
    return F.transform(oldest_first, lambda x: x["video_id"])


def user_sequences(train: DataFrame, rules: SequenceRules = SequenceRules()) -> DataFrame:
    """watch_seq, like_seq, long_watch_seq (last ``max_len`` each), history_len, last_time_ms."""
    base = train.select("user_id", "video_id", "time_ms", flag("like").alias("l"), flag("long_watch").alias("w"))
    wanted = [
        (F.lit("watch"), F.lit(rules.watch)),
        (F.lit("like"), F.lit(rules.like) & (F.col("l") == 1)),
        (F.lit("long"), F.lit(rules.long_watch) & (F.col("w") == 1)),
    ]
    kinds = F.filter(F.array(*[F.when(cond, name) for name, cond in wanted]), lambda k: k.isNotNull())
    rows = base.select("user_id", "video_id", "time_ms", F.explode(kinds).alias("kind"))
    recent = top_per(rows, ["user_id", "kind"], _NEWEST(), rules.max_len, "_back")
    lists = recent.groupBy("user_id").agg(
        *[
            _ordered_ids(F.col("kind") == kind).alias(name)
            for kind, name in (("watch", "watch_seq"), ("like", "like_seq"), ("long", "long_watch_seq"))
        ]
    )
    totals = (
        base.groupBy("user_id")
        .agg(F.count("*").alias("history_len"), F.max("time_ms").alias("last_time_ms"))
        .filter(F.col("history_len") >= rules.min_history)
    )
    return totals.join(lists, "user_id", "left").select(
        "user_id",
        F.coalesce("watch_seq", _EMPTY()).alias("watch_seq"),
        F.coalesce("like_seq", _EMPTY()).alias("like_seq"),
        F.coalesce("long_watch_seq", _EMPTY()).alias("long_watch_seq"),
        "history_len",
        "last_time_ms",
    )


def recent_positives(train: DataFrame, max_len: int, label: str = "is_positive") -> DataFrame:
    """(user_id, seq): the last ``max_len`` positives in time order, repeats kept."""
    rows = train.filter(flag(label) == 1).select("user_id", "video_id", "time_ms")
    recent = top_per(rows, "user_id", _NEWEST(), max_len, "_back")
    return recent.groupBy("user_id").agg(_ordered_ids().alias("seq"))


def positive_sequences(train: DataFrame, max_len: int = 100, label: str = "is_positive") -> DataFrame:
    """Last ``max_len`` positives first, then only the first occurrence of each item."""
    return recent_positives(train, max_len, label).withColumn("seq", F.array_distinct("seq"))


def newest_first(df: DataFrame, seq: str, limit: int | None = None) -> DataFrame:
    """One row per (user, place): ``back`` is 0 for the newest item."""
    arr = F.col(seq) if limit is None else tail(seq, limit)
    return df.select("user_id", F.posexplode(F.reverse(arr)).alias("back", "video_id"))
