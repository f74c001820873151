"""Negative sampling with a hash key instead of a random generator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import SamplingRules
from feedloom.functions.columns import md5_key, num
from feedloom.functions.ordering import top_per


def sample_negatives(
    candidates: DataFrame,
    split: str,
    rules: SamplingRules = SamplingRules(),
    label: str = "label",
    keep_test: bool = True,
) -> DataFrame:
    """All positives plus, per user, min(ceil(positives * ratio), cap) negatives in hash order.

    A split without positives or without negatives comes back unchanged; a ratio
    of zero keeps only positives.
    """
    if label not in candidates.columns or (split not in ("train", "val") and keep_test):
        return candidates
    ratio = rules.train_ratio if split == "train" else rules.val_ratio
    positive = num(label) > 0
    pos, neg = candidates.filter(positive), candidates.filter(~positive)
    if ratio <= 0:
        return pos
    seed = rules.seed + (0 if split == "train" else rules.val_seed_shift)
    counts = pos.groupBy("user_id").agg(F.count("*").alias("_pos"))
    keyed = neg.join(counts, "user_id", "left" if rules.include_zero_positive else "inner")
    quota = F.least(F.ceil(F.coalesce("_pos", F.lit(1)) * F.lit(ratio)), F.lit(rules.max_negatives))
    order = [md5_key(seed, F.col("user_id"), F.col("video_id")), F.col("video_id")]
    sampled = (
        top_per(keyed, "user_id", order, rules.max_negatives, "_r")
        .filter(F.col("_r") <= quota)
        .drop("_r", "_pos")
    )
    both_kinds = candidates.agg(
        (F.coalesce(F.max(F.when(positive, 1)), F.lit(0)) + F.coalesce(F.max(F.when(~positive, 1)), F.lit(0))).alias("k")
    ).scalar()
    usual = pos.unionByName(sampled).filter(both_kinds == 2)
    return usual.unionByName(candidates.filter(both_kinds < 2))
