"""Micro-batch recommendation: requests joined with state, then the batch operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import FeedbackRules, RerankRules, VectorRules
from feedloom.operators.merge import drop_recent, single_source_candidates, supplement
from feedloom.operators.popular import popular_candidates
from feedloom.operators.rank_metrics import coarse_topk
from feedloom.operators.rerank import greedy_rerank, with_item_meta
from feedloom.operators.scoring import degraded_scores, ranked_candidates
from feedloom.operators.vector_search import mean_vector, vector_candidates
from feedloom.session import stage


@dataclass
class Assets:
    """Tables a serving batch reads."""

    items: DataFrame
    popular: DataFrame
    item_vectors: DataFrame | None = None
    user_vectors: DataFrame | None = None


def user_queries(users: DataFrame, assets: Assets, synthetic: bool = True) -> DataFrame:
    """Vector of every user; unknown users take the mean of all user vectors."""
    known = users.join(assets.user_vectors.select(F.col("id").alias("user_id"), "vector"), "user_id", "left")
    if not synthetic:
        return known.filter("vector is not null").select(F.col("user_id").alias("id"), "vector")
    mean = mean_vector(assets.user_vectors).select(F.col("vector").cast("array<float>")).scalar()
    return known.select(F.col("user_id").alias("id"), F.coalesce("vector", mean).alias("vector"))


def recommend_batch(
    requests: DataFrame,
    states: DataFrame,
    assets: Assets,
    split: str = "test",
    rules: FeedbackRules = FeedbackRules(),
    rerank: RerankRules | None = RerankRules(),
    vectors: VectorRules = VectorRules(),
    score=degraded_scores,
) -> DataFrame:
    """(user_id, video_id, final_rank, rerank_score, ...) for the requesting users.

    requests: (user_id, top_k).  ``score`` adds coarse_score and rank_score; the
    default falls back to the recall score.  Without ``rerank`` rules the best scores are the list.
    """
    users = requests.groupBy("user_id").agg(
        F.greatest(F.lit(1), F.least(F.max("top_k"), F.lit(rules.max_topk))).alias("top_k")
    )
    popular = popular_candidates(users, assets.popular, max(rules.popular_topk, rules.prerank_topk))
    if assets.item_vectors is not None and assets.user_vectors is not None:
        found = vector_candidates(
            user_queries(users.select("user_id"), assets), assets.item_vectors, rules.recall_topk, "twotower_faiss", None, vectors
        )
        found = drop_recent(found, states, "recent_viewed", rules.recent_filter)
        extra = drop_recent(popular, states, "recent_viewed", rules.recent_filter)
        candidates = supplement(found, extra, rules.prerank_topk)
    else:
        candidates = drop_recent(popular, states, "recent_viewed", rules.recent_filter)
    scored = score(single_source_candidates(candidates))
    cut = coarse_topk(scored, rules.prerank_topk)
    fine = ranked_candidates(cut)
    if rerank is None:
        lists = fine.withColumnsRenamed({"rank_position": "final_rank", "rank_score": "rerank_score"})
        return lists.join(users, "user_id").filter(F.col("final_rank") <= F.col("top_k"))
    lists = greedy_rerank(with_item_meta(fine, assets.items, split, rerank), replace(rerank, topk=rules.max_topk))
    return lists.join(users, "user_id").filter(F.col("final_rank") <= F.col("top_k"))


# ------------------------------------------------------------------ streams


def serving_sink(states: Callable[[], DataFrame], assets: Assets, **options) -> Callable[[str], Callable[[DataFrame, int], None]]:
    """foreachBatch sink for a stream of requests (user_id, top_k): lists for each micro-batch.

    ``states`` gives the stored states as they are when the batch runs.  A batch writes the folder of
    its number, so one that is repeated after a lost driver or executor replaces itself.
    """

    def sink(path: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, number: int) -> None:
            recommend_batch(batch, states(), assets, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

        return write

    return sink


def refreshing_sink(assets: Assets, top_k: int, **options) -> Callable[[str], Callable[[DataFrame, int], None]]:
    """foreachBatch sink for the change feed of ``feedback_states``: new lists for users whose state has changed.

    The rows of the feed are the users' new states.  Users that expired get no list.
    """

    def sink(path: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, number: int) -> None:
            changed = stage(batch.where(~F.col("expired")) if "expired" in batch.columns else batch, "changed")
            requests = changed.select("user_id", F.lit(top_k).alias("top_k"))
            recommend_batch(requests, changed, assets, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

        return write

    return sink


def newest_lists(history: DataFrame) -> DataFrame:
    """Each user's lists of the last micro-batch that wrote one."""
    last = history.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return history.join(last, ["user_id", "batch"], "left_semi")
