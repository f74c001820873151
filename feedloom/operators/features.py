"""Train-only statistics and the feature frames of the coarse and fine stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.config import TASKS, FeatureRules
from feedloom.functions.columns import days_between, flag, left_pad, num, share, tail, ymd_to_date
from feedloom.operators.sequences import recent_positives
from feedloom.sources.schemas import require_columns
from feedloom.sources.tables import existing

STAT_LABELS = ("is_positive", "like", "finish", "long_watch")
_STAT_NAMES = ("positive", "like", "finish", "long_watch")


def _history_stats(train: DataFrame, key: str, other: str, prefix: str, unique: str) -> DataFrame:
    counts = [
        F.sum(num(label)).alias(f"{prefix}_train_{name}_count") for label, name in zip(STAT_LABELS, _STAT_NAMES)
    ]
    out = train.groupBy(key).agg(
        F.count("*").alias(f"{prefix}_train_exposure_count"),
        F.countDistinct(other).alias(unique),
        *counts,
    )
    rate = share(f"{prefix}_train_positive_count", f"{prefix}_train_exposure_count")
    return out.withColumn(f"{prefix}_train_positive_rate", rate)


def user_stats(train: DataFrame) -> DataFrame:
    require_columns(train.columns, ["user_id", "video_id", *STAT_LABELS], "train split")
    return _history_stats(train, "user_id", "video_id", "user", "user_train_unique_items")


def item_stats(train: DataFrame) -> DataFrame:
    require_columns(train.columns, ["user_id", "video_id", *STAT_LABELS], "train split")
    return _history_stats(train, "video_id", "user_id", "item", "item_train_unique_users")


def task_labels(split: DataFrame, tasks: tuple = TASKS) -> DataFrame:
    """Best outcome of each task per (user, item), limited to 0 or 1."""
    require_columns(split.columns, ["user_id", "video_id", *tasks], "split")
    clipped = lambda t: F.least(F.greatest(num(t), F.lit(0.0)), F.lit(1.0)).cast("int")
    return split.groupBy("user_id", "video_id").agg(*[F.max(clipped(t)).alias(t) for t in tasks])


def history_counts(train: DataFrame, items: DataFrame, by: str, label: str = "is_positive") -> DataFrame:
    """(user_id, by, n): positives of each user per author or tag; unknown values are left out."""
    meta = items.select("video_id", by).dropDuplicates(["video_id"])
    rows = train.filter(flag(label) == 1).select("user_id", "video_id")
    return rows.join(meta, "video_id").filter(F.col(by).isNotNull()).groupBy("user_id", by).agg(
        F.count("*").alias("n")
    )


def source_features(df: DataFrame, rules: FeatureRules = FeatureRules()) -> DataFrame:
    """Filled score and rank per channel, presence flags, and source_count when absent."""
    have = set(df.columns)
    out = {}
    for s in rules.sources:
        score = num(f"{s}_score", rules.score_default) if f"{s}_score" in have else F.lit(rules.score_default)
        rank = num(f"{s}_rank", rules.rank_default) if f"{s}_rank" in have else F.lit(rules.rank_default)
        out[f"{s}_score"] = score.cast("float")
        out[f"{s}_rank"] = rank.cast("float")
        out[f"has_{s}"] = F.when(rank.cast("float") < F.lit(rules.rank_default).cast("float"), 1).otherwise(0)
    if "source_count" in have:
        count: Column = num("source_count")
    else:
        count = reduce(lambda a, b: a + b, [out[f"has_{s}"] for s in rules.sources])
    out["source_count"] = count.cast("float")
    return df.withColumns(out)


def _numeric_defaults(df: DataFrame, names: list[str]) -> DataFrame:
    """Float columns where missing ranks mean 'very far' and missing scores mean zero."""
    out = {}
    for c in names:
        default = 1_000_000.0 if "rank" in c else 0.0
        out[c] = (num(c, default) if c in df.columns else F.lit(0.0)).cast("float")
    return df.withColumns(out)


def reference_date(rules: FeatureRules, split: str) -> Column:
    if split not in rules.reference_dates:
        raise KeyError(f"missing reference date for split {split}")
    return ymd_to_date(F.lit(int(rules.reference_dates[split])))


def _freshness(rules: FeatureRules, split: str) -> Column:
    return days_between(reference_date(rules, split), ymd_to_date("upload_date")).cast("float")


def _item_side(items: DataFrame, rules: FeatureRules, stats: tuple = ()) -> DataFrame:
    return existing(items, "video_id", rules.item_categorical, rules.item_numeric, ["upload_date"], stats)


def _user_side(users: DataFrame, rules: FeatureRules) -> DataFrame:
    return existing(users, "user_id", rules.user_categorical, rules.user_numeric)


def coarse_frame(
    candidates: DataFrame,
    users: DataFrame,
    items: DataFrame,
    sequences: DataFrame,
    stats_by_user: DataFrame,
    stats_by_item: DataFrame,
    split: str,
    rules: FeatureRules = FeatureRules(),
) -> DataFrame:
    """Candidates with user, item, history-length and train-stat columns.

    User tables are joined to each other first and item tables likewise, so the
    wide candidate table is moved at most once per key.
    """
    require_columns(candidates.columns, ["user_id", "video_id"], "candidates")
    by_user, by_item = coarse_sides(users, items, sequences, stats_by_user, stats_by_item, rules)
    return coarse_values(candidates.join(by_user, "user_id", "left").join(by_item, "video_id", "left"), split, rules)


def coarse_sides(
    users: DataFrame, items: DataFrame, sequences: DataFrame, stats_by_user: DataFrame, stats_by_item: DataFrame, rules: FeatureRules = FeatureRules()
) -> tuple[DataFrame, DataFrame]:
    """The user columns and the item columns of the coarse frame, one row per key."""
    by_user = _user_side(users, rules)
    if "history_len" in sequences.columns:
        lengths = sequences.select("user_id", "history_len").dropDuplicates(["user_id"])
        by_user = by_user.join(lengths, "user_id", "full")
    by_user = by_user.join(stats_by_user, "user_id", "full")
    stat_columns = rules.item_stat_numeric if rules.use_item_stats else ()
    return by_user, _item_side(items, rules, stat_columns).join(stats_by_item, "video_id", "full")


def coarse_values(joined: DataFrame, split: str, rules: FeatureRules = FeatureRules()) -> DataFrame:
    """The coarse frame from candidates that already hold their user and item columns."""
    out = _numeric_defaults(joined, ["merged_score", "source_score", "source_rank", "merged_rank"])
    out = source_features(out, rules)
    fresh = _freshness(rules, split) if "upload_date" in out.columns else F.lit(0.0).cast("float")
    return out.withColumn("freshness_days", fresh)


def fine_frame(
    candidates: DataFrame,
    labels: DataFrame,
    users: DataFrame,
    items: DataFrame,
    train: DataFrame,
    split: str,
    rules: FeatureRules = FeatureRules(),
    tasks: tuple = TASKS,
) -> DataFrame:
    """Candidates with task labels, side features and same-author / same-tag history counts."""
    out = candidates.join(labels, ["user_id", "video_id"], "left").withColumns(
        {t: F.coalesce(F.col(t), F.lit(0)) for t in tasks}
    )
    by_user, by_item = fine_sides(users, items, train, rules)
    out = out.join(by_user, "user_id", "left").join(by_item, "video_id", "left")
    for by, name in (("author_id", "author"), ("tag", "tag")):
        counts = history_counts(train, items, by).withColumnRenamed("n", f"hist_same_{name}_count")
        out = out.join(counts, ["user_id", by], "left")
    return fine_values(out, split, rules, tasks)


def fine_sides(users: DataFrame, items: DataFrame, train: DataFrame, rules: FeatureRules = FeatureRules()) -> tuple[DataFrame, DataFrame]:
    """The user columns and the item columns of the fine frame, one row per key."""
    lengths = (
        train.filter(flag("is_positive") == 1)
        .groupBy("user_id")
        .agg(F.least(F.count("*"), F.lit(3 * rules.history_len)).alias("history_len"))
    )
    return _user_side(users, rules).join(lengths, "user_id", "full"), _item_side(items, rules, rules.item_stat_numeric)


def history_lists(train: DataFrame, items: DataFrame, by: str, name: str) -> DataFrame:
    """(user_id, <name>_keys, <name>_n): ``history_counts`` as one row per user."""
    counts = history_counts(train, items, by)
    lists = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), "n"))).alias("_h"))
    return lists.select("user_id", F.col("_h.k").alias(f"{name}_keys"), F.col("_h.n").alias(f"{name}_n"))


def fine_values(out: DataFrame, split: str, rules: FeatureRules = FeatureRules(), tasks: tuple = TASKS) -> DataFrame:
    """The fine frame from candidates that already hold their labels, sides and history counts."""
    out = out.withColumn("rank_label", F.greatest(*tasks))
    out = source_features(out, rules)
    out = _numeric_defaults(
        out,
        ["source_score", "source_rank", "merged_score", "source_count", "merged_rank", "coarse_score", "coarse_rank"],
    )
    out = out.withColumns(
        {
            "history_len": F.coalesce("history_len", F.lit(0)).cast("float"),
            "hist_same_author_count": F.coalesce("hist_same_author_count", F.lit(0)).cast("float"),
            "hist_same_tag_count": F.coalesce("hist_same_tag_count", F.lit(0)).cast("float"),
        }
    ).withColumns(
        {
            "hist_has_same_author": F.when(F.col("hist_same_author_count") > 0, 1).otherwise(0),
            "hist_has_same_tag": F.when(F.col("hist_same_tag_count") > 0, 1).otherwise(0),
        }
    )
    fresh = F.coalesce(_freshness(rules, split), F.lit(0.0)) if "upload_date" in out.columns else F.lit(0.0)
    return out.withColumn("freshness_days", fresh.cast("float"))


# ---------------------------------------------------------- column choice


def _present(df: DataFrame, names) -> list[str]:
    return [c for c in dict.fromkeys(names) if c in df.columns]


def coarse_columns(df: DataFrame, rules: FeatureRules = FeatureRules()) -> tuple[list[str], list[str]]:
    """(categorical, numeric) columns of the coarse stage, in a fixed order."""
    cat = _present(df, ["user_id", "video_id", "recall_source", *rules.user_categorical, *rules.item_categorical])
    stat = []
    for p, unique in (("user", "user_train_unique_items"), ("item", "item_train_unique_users")):
        stat += [f"{p}_train_exposure_count", unique]
        stat += [f"{p}_train_{n}_count" for n in _STAT_NAMES] + [f"{p}_train_positive_rate"]
    numeric = [
        "source_score",
        "source_rank",
        "merged_score",
        "source_count",
        "merged_rank",
        "freshness_days",
        "history_len",
        *[f"{s}_score" for s in rules.sources],
        *[f"{s}_rank" for s in rules.sources],
        *[f"has_{s}" for s in rules.sources],
        *rules.user_numeric,
        *rules.item_numeric,
        *stat,
        *(rules.item_stat_numeric if rules.use_item_stats else ()),
    ]
    return cat, [c for c in _present(df, numeric) if c not in cat]


def fine_columns(df: DataFrame, rules: FeatureRules = FeatureRules()) -> tuple[list[str], list[str]]:
    """(categorical, numeric) columns of the fine stage, in a fixed order."""
    cat = _present(
        df,
        ["user_id", "video_id", "author_id", "tag", "recall_source", *rules.user_categorical, *rules.item_categorical],
    )
    numeric = [
        "source_score",
        "source_rank",
        "merged_score",
        "source_count",
        "merged_rank",
        "coarse_score",
        "coarse_rank",
        "history_len",
        "hist_same_author_count",
        "hist_same_tag_count",
        "hist_has_same_author",
        "hist_has_same_tag",
        "freshness_days",
        *[f"{s}_score" for s in rules.sources],
        *[f"{s}_rank" for s in rules.sources],
        *[f"has_{s}" for s in rules.sources],
        *rules.user_numeric,
        *rules.item_numeric,
        *rules.item_stat_numeric,
    ]
    return cat, [c for c in _present(df, numeric) if c not in cat]


# ------------------------------------------------------- history per target


def target_histories(
    candidates: DataFrame,
    train: DataFrame,
    codes: DataFrame,
    rules: FeatureRules = FeatureRules(),
) -> DataFrame:
    """(user_id, video_id, hist_item_seq): encoded positives without the target, left-padded with 0.

    The last 3 * history_len positives are encoded once per user.  The target is
    masked before the last history_len are taken.  codes: (value, code).
    """
    n = rules.history_len
    raw = recent_positives(train, 3 * n)
    places = raw.select("user_id", F.posexplode("seq").alias("pos", "video_id"))
    coded = places.join(codes.select(F.col("value").alias("video_id"), "code"), "video_id", "left")
    item = F.struct("pos", F.col("video_id").alias("v"), F.coalesce("code", F.lit(0)).cast("int").alias("c"))
    per_user = coded.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("_h"))
    kept = F.col("_h")
    if rules.exclude_target:
        kept = F.filter("_h", lambda x: x["v"] != F.col("video_id"))
    seq = F.transform(tail(F.coalesce(kept, F.array().cast("array<struct<pos:int,v:bigint,c:int>>")), n), lambda x: x["c"])
    return candidates.select("user_id", "video_id").join(per_user, "user_id", "left").select(
        "user_id", "video_id", left_pad(seq, n, 0).alias("hist_item_seq")
    )


def tower_inputs(users: DataFrame, sequences: DataFrame, user_codes: DataFrame, item_codes: DataFrame, max_len: int = 50,
                 sequence_col: str = "watch_seq") -> DataFrame:
    """(user_id, user_idx, seq_item_idx): encoded user and left-padded encoded sequence; 0 is unknown."""
    ids = users.select("user_id").distinct()
    places = sequences.select("user_id", F.posexplode(tail(sequence_col, max_len)).alias("pos", "value"))
    coded = places.join(item_codes.select("value", "code"), "value", "left")
    item = F.struct("pos", F.coalesce("code", F.lit(0)).cast("bigint").alias("c"))
    seqs = coded.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("_s")
    )
    uc = user_codes.select(F.col("value").alias("user_id"), F.col("code").alias("_u"))
    empty = F.array().cast("array<bigint>")
    return ids.join(uc, "user_id", "left").join(seqs, "user_id", "left").select(
        "user_id",
        F.coalesce("_u", F.lit(0)).cast("bigint").alias("user_idx"),
        left_pad(F.coalesce("_s", empty), max_len, 0).cast("array<bigint>").alias("seq_item_idx"),
    )
