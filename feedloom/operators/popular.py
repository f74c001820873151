"""Global popularity and its per-user candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.config import PopularRules
from feedloom.functions.columns import num
from feedloom.functions.ordering import dense_numbers, ranked
from feedloom.session import stage


def item_counts(train: DataFrame) -> DataFrame:
    has = set(train.columns)
    like = num("like") if "like" in has else (num("is_like") if "is_like" in has else F.lit(0))
    long_watch = num("long_watch") if "long_watch" in has else F.lit(0)
    finish = num("finish") if "finish" in has else F.lit(0)
    total = lambda c: F.sum(c.cast("bigint"))
    return train.groupBy("video_id").agg(
        F.count("*").alias("exposure_count"),
        total(F.when(num("play_time_ms") > 0, 1).otherwise(0)).alias("play_count"),
        total(like).alias("like_count"),
        total(long_watch).alias("long_watch_count"),
        total(finish).alias("finish_count"),
        F.countDistinct("user_id").alias("unique_user_count"),
        F.max("time_ms").alias("last_time_ms"),
    )


def popularity(rules: PopularRules) -> Column:
    weighted = [
        ("play_count", rules.w_play),
        ("like_count", rules.w_like),
        ("long_watch_count", rules.w_long),
        ("finish_count", rules.w_finish),
    ]
    score = F.lit(0.0)
    for name, w in weighted:
        score = score + F.lit(w) * F.log1p(F.col(name) + F.lit(rules.smoothing))
    return score + F.lit(rules.w_exposure) * F.log1p(F.col("exposure_count"))


def popular_items(train: DataFrame, rules: PopularRules = PopularRules()) -> DataFrame:
    """Top ``topk`` items.  The rank window sees only those rows, never the catalogue."""
    order = [
        F.col("source_score").desc(),
        F.col("long_watch_count").desc(),
        F.col("like_count").desc(),
        F.col("play_count").desc(),
        F.col("video_id").asc(),
    ]
    scored = item_counts(train).withColumn("source_score", popularity(rules).cast("float"))
    top = scored.orderBy(*order).limit(rules.topk)
    return top.withColumn("popular_rank", F.row_number().over(Window.orderBy(*order)))


def linear_popular_items(train: DataFrame, rules: PopularRules = PopularRules()) -> DataFrame:
    """Fallback ranking: the same weights on plain counts, clicks as plays."""
    score = (
        F.lit(rules.w_play) * F.sum(num("is_click"))
        + F.lit(rules.w_like) * F.sum(num("like"))
        + F.lit(rules.w_long) * F.sum(num("long_watch"))
        + F.lit(rules.w_finish) * F.sum(num("finish"))
    )
    return train.groupBy("video_id").agg(score.alias("source_score"))


def _as_array(items: DataFrame, rank: Column, limit: int) -> Column:
    """The first ``limit`` popular rows as one array: a scalar subquery of known size."""
    rows = items.orderBy(rank, "video_id").limit(limit).select(
        rank.cast("bigint").alias("r"),
        F.col("video_id").alias("v"),
        F.col("source_score").cast("double").alias("s"),
    )
    return rows.agg(F.array_sort(F.collect_list(F.struct("r", "v", "s"))).alias("p")).scalar()


def popular_candidates(
    users: DataFrame,
    items: DataFrame,
    topk: int = 300,
    history: DataFrame | None = None,
    exclude_seen: bool = True,
) -> DataFrame:
    """The popular list minus what each user has seen, the first ``topk`` of each.

    The list is read in blocks of ``topk`` rows.  A seen item with fewer than ``topk`` unseen ones
    before it moves the user's end by one place, so each user reads the blocks up to that end and
    none beyond; no user-by-item product is formed, and a row holds at most one block.
    """
    ids = users.select("user_id").distinct()
    if not exclude_seen or history is None:
        listed = ids.withColumn("_p", _as_array(items, F.col("popular_rank"), topk))
        return _candidate_rows(listed.select("user_id", F.explode("_p").alias("x")))
    listed = items.select(
        F.col("popular_rank").cast("bigint").alias("r"),
        F.col("video_id").alias("v"),
        F.col("source_score").cast("double").alias("s"),
    )
    placed = dense_numbers(listed, [F.col("r").asc(), F.col("v").asc()], "p", "popular-places")
    block = F.floor((F.col("p") - 1) / topk).cast("bigint")
    blocks = placed.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("p", "r", "v", "s"))).alias("rows"))
    seen = history.select("user_id", F.col("video_id").alias("v")).join(placed.select("v", "p"), "v").select("user_id", "p").distinct()
    seen = ranked(seen.join(ids, "user_id", "left_semi"), "user_id", [F.col("p").asc()], "j")
    before = seen.where(F.col("p") - F.col("j") < topk).groupBy("user_id", block.alias("block")).agg(F.collect_list("p").alias("gone"))
    before = stage(before, "popular-seen")
    ends = before.groupBy("user_id").agg(F.sum(F.size("gone")).alias("n"))
    ends = ids.join(ends, "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + topk).alias("end"))
    wanted = ends.select("user_id", "end", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("end") - 1) / topk).cast("bigint"))).alias("block"))
    held = wanted.join(before, ["user_id", "block"], "left").join(blocks, "block")
    fresh = F.filter("rows", lambda x: (x["p"] <= F.col("end")) & (F.col("gone").isNull() | ~F.array_contains("gone", x["p"])))
    return _candidate_rows(held.select("user_id", F.explode(fresh).alias("x")))


def _candidate_rows(listed: DataFrame) -> DataFrame:
    return listed.select(
        "user_id",
        F.col("x.v").alias("video_id"),
        F.lit("popular").alias("recall_source"),
        F.col("x.s").alias("source_score"),
        F.col("x.r").alias("source_rank"),
    )
