"""Item co-occurrence, the distance-weighted item graph, and neighbour expansion.

Pairs come from one user's positive list, which is cut to ``max_history`` items
first, so a user yields at most max_history^2 / 2 unordered pairs however long
the log is.  Pairs are summed on the map side and mirrored only after the sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import GraphRules, ItemCfRules
from feedloom.functions.columns import FINE_SCALE, fixed_sum, log2p, tail
from feedloom.functions.ordering import top_per
from feedloom.operators.sequences import positive_sequences




def _pairs(sequences: DataFrame, reach: int | None) -> DataFrame:
    """Unordered item pairs of each list as (a, b, w, gap), a < b, at most ``reach`` apart."""
    lists = sequences.filter(F.size("seq") >= 2).withColumn("w", 1.0 / log2p(F.size("seq"), 2))
    first = lists.select("seq", "w", F.posexplode("seq").alias("i", "x"))
    length = F.lit(reach) if reach is not None else F.greatest(F.size("seq"), F.lit(1))
    rest = F.slice("seq", F.col("i") + 2, length)
    return (
        first.select("w", "x", F.posexplode(rest).alias("gap", "y"))
        .filter("x <> y")
        .select(
            F.least("x", "y").alias("a"),
            F.greatest("x", "y").alias("b"),
            "w",
            (F.col("gap") + 1).alias("gap"),
        )
    )


def _mirrored(pairs: DataFrame, *extra: str) -> DataFrame:
    both = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))
    return pairs.select(F.explode(both).alias("e"), *extra).select(
        F.col("e.i").alias("video_id"), F.col("e.j").alias("neighbor_video_id"), *extra
    )


def item_frequency(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.explode("seq").alias("video_id")).groupBy("video_id").agg(
        F.count("*").alias("freq")
    )


def itemcf_neighbors(
    train: DataFrame, rules: ItemCfRules = ItemCfRules(), label: str = "is_positive"
) -> DataFrame:
    """Neighbours with sim = cooc / (sqrt(freq_i * freq_j) + shrinkage)."""
    seqs = positive_sequences(train, rules.max_history, label)
    freq = item_frequency(seqs)
    sums = (
        _pairs(seqs, None)
        .groupBy("a", "b")
        .agg(fixed_sum("w").alias("cooccurrence"))
        .filter(F.col("cooccurrence") >= rules.min_cooccurrence)
    )
    fa = freq.select(F.col("video_id").alias("a"), F.col("freq").alias("fa"))
    fb = freq.select(F.col("video_id").alias("b"), F.col("freq").alias("fb"))
    scored = sums.join(fa, "a").join(fb, "b").withColumn(
        "similarity",
        F.col("cooccurrence") / (F.sqrt(F.col("fa").cast("double") * F.col("fb")) + F.lit(rules.shrinkage)),
    )
    both = _mirrored(scored.filter("similarity > 0"), "a", "fa", "fb", "similarity", "cooccurrence")
    forward = F.col("video_id") == F.col("a")
    rows = both.withColumns(
        {
            "item_freq": F.when(forward, F.col("fa")).otherwise(F.col("fb")),
            "neighbor_freq": F.when(forward, F.col("fb")).otherwise(F.col("fa")),
        }
    )
    order = [F.col("similarity").desc(), F.col("cooccurrence").desc(), F.col("neighbor_video_id").asc()]
    return top_per(rows, "video_id", order, rules.max_neighbors, "neighbor_rank").select(
        "video_id",
        "neighbor_video_id",
        "similarity",
        "cooccurrence",
        "item_freq",
        "neighbor_freq",
        "neighbor_rank",
    )


def item_graph(train: DataFrame, rules: GraphRules = GraphRules(), label: str = "is_positive") -> DataFrame:
    """Undirected edges between items at most ``window`` places apart, weighted 1/log2(2+n)/gap."""
    seqs = positive_sequences(train, rules.max_history, label)
    sums = (
        _pairs(seqs, rules.window)
        .groupBy("a", "b")
        .agg(fixed_sum(F.col("w") / F.col("gap")).alias("edge_weight"))
        .filter(F.col("edge_weight") >= rules.min_weight)
    )
    order = [F.col("edge_weight").desc(), F.col("neighbor_video_id").asc()]
    return top_per(_mirrored(sums, "edge_weight"), "video_id", order, rules.max_neighbors, "neighbor_rank").select(
        "video_id", "neighbor_video_id", "edge_weight", "neighbor_rank"
    )


def expand_neighbors(sequences: DataFrame, neighbors: DataFrame, rules: ItemCfRules = ItemCfRules()) -> DataFrame:
    """(user_id, video_id, score) with score = sum of similarity * recency^place.

    Neighbours travel as one short array per item (at most ``max_neighbors``), so
    the join matches one row per history item and expands after it.
    """
    if rules.sequence_col not in sequences.columns:
        raise KeyError(f"missing sequence column: {rules.sequence_col}")
    recent = sequences.select("user_id", tail(rules.sequence_col, rules.max_history).alias("seq"))
    places = recent.select("user_id", F.posexplode(F.reverse("seq")).alias("back", "video_id"))
    # one weight per (user, item): repeats of an item in the list add up
    weights = places.groupBy("user_id", "video_id").agg(
        fixed_sum(F.pow(F.lit(rules.recency), F.col("back")), FINE_SCALE).alias("w")
    )
    lists = neighbors.groupBy("video_id").agg(
        F.collect_list(F.struct(F.col("neighbor_video_id").alias("v"), F.col("similarity").alias("s"))).alias("nb")
    )
    hits = weights.join(lists, "video_id").select("user_id", "w", F.explode("nb").alias("n"))
    scores = hits.groupBy("user_id", F.col("n.v").alias("video_id")).agg(
        fixed_sum(F.col("n.s") * F.col("w"), FINE_SCALE).alias("score")
    )
    if not rules.exclude_seen:
        return scores
    # the list joins once per user: beside every history item it would be moved as often as it is long
    return scores.join(recent, "user_id").filter(~F.array_contains("seq", F.col("video_id"))).drop("seq")


def itemcf_candidates(sequences: DataFrame, neighbors: DataFrame, rules: ItemCfRules = ItemCfRules()) -> DataFrame:
    scores = expand_neighbors(sequences, neighbors, rules)
    order = [F.col("score").desc(), F.col("video_id").asc()]
    return top_per(scores, "user_id", order, rules.topk, "source_rank").select(
        "user_id",
        "video_id",
        F.lit("itemcf").alias("recall_source"),
        F.col("score").alias("source_score"),
        F.col("source_rank").cast("bigint").alias("source_rank"),
    )
