"""Fusing the recall channels into one candidate table per user."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.config import CANDIDATE_COLUMNS, MergeRules
from feedloom.functions.columns import FINE_SCALE, fixed_sum, log2p, num
from feedloom.functions.ordering import ranked, top_per

from feedloom.sources.schemas import require_columns

NO_QUOTA = 1_000_000_000


def union_candidates(frames: list[DataFrame]) -> DataFrame:
    """All channels under the five-column contract."""
    parts = []
    for i, frame in enumerate(f for f in frames if f is not None):
        require_columns(frame.columns, CANDIDATE_COLUMNS, f"candidate frame {i}")
        rank = F.coalesce(num("source_rank", None).cast("bigint"), F.lit(NO_QUOTA).cast("bigint"))
        parts.append(
            frame.select(
                F.col("user_id").cast("bigint").alias("user_id"),
                F.col("video_id").cast("bigint").alias("video_id"),
                F.col("recall_source").cast("string").alias("recall_source"),
                num("source_score").alias("source_score"),
                rank.alias("source_rank"),
            )
        )
    if not parts:
        raise ValueError("no candidate frames")
    return reduce(DataFrame.unionByName, parts)


def known_channels(candidates: DataFrame, sources: tuple) -> DataFrame:
    """Fail on a channel the rules do not list: its scores would have no column."""
    name = F.col("recall_source")
    error = F.raise_error(F.concat(F.lit("unlisted recall channel: "), F.coalesce(name, F.lit("null"))))
    return candidates.withColumn("recall_source", F.when(name.isin(*sources), name).otherwise(error.cast("string")))


def _by_source(table: dict, default) -> Column:
    """CASE over the channel name with the configured value per channel."""
    out = F.lit(table.get("default", default))
    for name, value in table.items():
        if name != "default":
            out = F.when(F.col("recall_source") == name, F.lit(value)).otherwise(out)
    return out


def apply_quota(candidates: DataFrame, quota: dict) -> DataFrame:
    """Best ``quota[source]`` rows per user and channel; a quota of zero drops the channel."""
    order = [F.col("source_score").desc(), F.col("source_rank").asc(), F.col("video_id").asc()]
    limit = _by_source(quota, NO_QUOTA)
    kept = candidates.filter(limit > 0)
    return ranked(kept, ["user_id", "recall_source"], order, "_q").filter(F.col("_q") <= limit).drop("_q")


def normalise_scores(candidates: DataFrame) -> DataFrame:
    """Min-max per channel over the whole table; equal scores fall back to 1/log2(rank+1)."""
    bounds = candidates.groupBy("recall_source").agg(
        F.min("source_score").alias("_lo"), F.max("source_score").alias("_hi")
    )
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.col("source_score") - F.col("_lo")) / span).otherwise(
        1.0 / log2p("source_rank", 1)
    )
    # bounds holds one row per recall channel
    return candidates.join(F.broadcast(bounds), "recall_source").select(
        *CANDIDATE_COLUMNS, scaled.cast("float").alias("source_score_norm")
    )


def merge_candidates(frames: list[DataFrame], rules: MergeRules = MergeRules()) -> DataFrame:
    """One row per (user, item) with the summed channel weights, best ``final_topk`` per user.

    The union is spread by user once; quota, merge and final rank all work on that
    layout.  A user holds at most the sum of the channel quotas.
    """
    raw = known_channels(union_candidates(frames), rules.sources).repartition("user_id")
    scored = normalise_scores(apply_quota(raw, rules.quota)).withColumn(
        "_w", F.col("source_score_norm").cast("double") * _by_source(rules.weights, 1.0)
    )
    # flags and extremes per channel keep this a plain hash aggregation
    per_source = []
    for name in rules.sources:
        mine = F.col("recall_source") == name
        per_source.append(F.max(F.when(mine, F.col("source_score"))).alias(f"{name}_score"))
        per_source.append(F.min(F.when(mine, F.col("source_rank"))).alias(f"{name}_rank"))
    merged = scored.groupBy("user_id", "video_id").agg(
        F.max("source_score").alias("source_score"),
        F.min("source_rank").alias("source_rank"),
        fixed_sum("_w", FINE_SCALE).cast("float").alias("merged_score"),
        *per_source,
    )
    present = [(s, F.col(f"{s}_rank").isNotNull()) for s in sorted(rules.sources)]
    merged = merged.select(
        "user_id",
        "video_id",
        F.concat_ws("|", *[F.when(has, F.lit(s)) for s, has in present]).alias("recall_source"),
        "source_score",
        "source_rank",
        "merged_score",
        reduce(lambda a, b: a + b, [has.cast("int") for _, has in present]).alias("source_count"),
        *[c for s in rules.sources for c in (f"{s}_score", f"{s}_rank")],
    )
    order = [
        F.col("merged_score").desc(),
        F.col("source_count").desc(),
        F.col("source_rank").asc(),
        F.col("video_id").asc(),
    ]
    return top_per(merged, "user_id", order, rules.final_topk, "merged_rank")


def single_source_candidates(candidates: DataFrame) -> DataFrame:
    """The merged contract for rows of one channel: the raw score is the merged score."""
    order = [F.col("source_score").desc(), F.col("source_rank").asc(), F.col("video_id").asc()]
    return ranked(candidates, "user_id", order, "merged_rank").withColumns(
        {"merged_score": F.col("source_score").cast("float"), "source_count": F.lit(1)}
    )


def drop_seen(candidates: DataFrame, history: DataFrame | None, topk: int) -> DataFrame:
    """Anti join with the history, then the best ``topk`` per user."""
    out = candidates
    if history is not None:
        out = out.join(history.select("user_id", "video_id").distinct(), ["user_id", "video_id"], "left_anti")
    order = [F.col("source_score").desc(), F.col("source_rank").asc(), F.col("video_id").asc()]
    return top_per(out, "user_id", order, topk, "_k").drop("_k")


def supplement(candidates: DataFrame, extra: DataFrame, minimum: int) -> DataFrame:
    """Users with fewer than ``minimum`` candidates also get the rows of ``extra`` they lack."""
    counts = candidates.groupBy("user_id").agg(F.count("*").alias("_n"))
    short = (
        extra.join(counts, "user_id", "left")
        .filter(F.coalesce("_n", F.lit(0)) < minimum)
        .drop("_n")
    )
    both = candidates.select(*CANDIDATE_COLUMNS).withColumn("_p", F.lit(0)).unionByName(
        short.select(*CANDIDATE_COLUMNS).withColumn("_p", F.lit(1))
    )
    first = Window.partitionBy("user_id", "video_id").orderBy("_p", F.col("source_score").desc())
    return both.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_p")


def drop_recent(candidates: DataFrame, states: DataFrame, column: str = "recent_viewed", size: int = 50) -> DataFrame:
    """Remove the items among the last ``size`` views of the user's state."""
    from feedloom.functions.columns import tail

    recent = states.select("user_id", tail(column, size).alias("_recent"))
    return (
        candidates.join(recent, "user_id", "left")
        .filter(F.col("_recent").isNull() | ~F.array_contains("_recent", F.col("video_id")))
        .drop("_recent")
    )


def waterfall(stages: list[DataFrame], k: int) -> DataFrame:
    """First list, then the items the next list adds, and so on, at most k per user.

    Each stage is (user_id, video_id, pos, score, source, reason) with at most a
    short list per user.
    """
    tagged = [s.withColumn("_stage", F.lit(i)) for i, s in enumerate(stages)]
    rows = reduce(DataFrame.unionByName, tagged)
    first = Window.partitionBy("user_id", "video_id").orderBy("_stage", "pos")
    once = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return (
        top_per(once, "user_id", [F.col("_stage"), F.col("pos"), F.col("video_id")], k, "_k")
        .withColumn("pos", F.col("_k"))
        .select("user_id", "video_id", "pos", "score", "source", "reason")
    )
