"""Parameters of every stage, with the default values the stages must use.

All numbers below are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SPLITS = ("train", "val", "test")
CHANNELS = ("popular", "itemcf", "twotower", "twotower_faiss", "graph_emb")
TASKS = ("long_watch", "finish", "like")
CANDIDATE_COLUMNS = ("user_id", "video_id", "recall_source", "source_score", "source_rank")


@dataclass(frozen=True)
class LabelRules:
    finish_ratio: float = 0.95
    long_ratio: float = 0.70
    long_ms: float = 18000.0
    max_ratio: float = 5.0
    use_long_view: bool = True


@dataclass(frozen=True)
class SplitDates:
    """Inclusive YYYYMMDD bounds."""

    train_end: int = 20220424
    val_start: int = 20220425
    val_end: int = 20220430
    test_start: int = 20220501
    strategy: str = "date"


@dataclass(frozen=True)
class SequenceRules:
    max_len: int = 50
    min_history: int = 1
    watch: bool = True
    like: bool = True
    long_watch: bool = True


@dataclass(frozen=True)
class PopularRules:
    topk: int = 300
    candidate_topk: int = 300
    smoothing: float = 1.0
    w_play: float = 1.0
    w_like: float = 6.0
    w_long: float = 3.0
    w_finish: float = 2.0
    w_exposure: float = 0.05
    exclude_seen: bool = True


@dataclass(frozen=True)
class ItemCfRules:
    topk: int = 300
    max_neighbors: int = 200
    max_history: int = 100
    min_cooccurrence: float = 2.0
    shrinkage: float = 10.0
    recency: float = 0.92
    exclude_seen: bool = True
    sequence_col: str = "watch_seq"


@dataclass(frozen=True)
class GraphRules:
    window: int = 5
    max_history: int = 100
    min_weight: float = 0.1
    max_neighbors: int = 200
    walk_length: int = 16
    walks_per_node: int = 3
    context_window: int = 4
    dim: int = 64
    epochs: int = 2
    candidate_topk: int = 300
    recency: float = 0.92
    exclude_seen: bool = True
    seed: int = 2026


@dataclass(frozen=True)
class VectorRules:
    similarity: str = "cosine"
    cells: int = 256
    probes: int = 32
    topk: int = 500
    block_rows: int = 4096
    seed: int = 2026


@dataclass(frozen=True)
class MergeRules:
    weights: dict = field(
        default_factory=lambda: {
            "popular": 0.15,
            "itemcf": 0.25,
            "twotower": 0.35,
            "twotower_faiss": 0.35,
            "graph_emb": 0.02,
        }
    )
    quota: dict = field(
        default_factory=lambda: {
            "popular": 300,
            "itemcf": 300,
            "twotower": 300,
            "twotower_faiss": 300,
            "graph_emb": 10,
        }
    )
    final_topk: int = 500
    sources: tuple = CHANNELS


@dataclass(frozen=True)
class SamplingRules:
    train_ratio: float = 5.0
    val_ratio: float = 10.0
    max_negatives: int = 80
    include_zero_positive: bool = False
    seed: int = 2026
    val_seed_shift: int = 0


PRERANK_SAMPLING = SamplingRules()
RANK_SAMPLING = SamplingRules(train_ratio=4.0, val_ratio=8.0, val_seed_shift=17)


@dataclass(frozen=True)
class FeatureRules:
    sources: tuple = CHANNELS
    score_default: float = 0.0
    rank_default: float = 1_000_000.0
    reference_dates: dict = field(
        default_factory=lambda: {"train": 20220424, "val": 20220430, "test": 20220508}
    )
    user_categorical: tuple = (
        "user_active_degree",
        "follow_user_num_range",
        "fans_user_num_range",
        "friend_user_num_range",
        "register_days_range",
    )
    user_numeric: tuple = (
        "is_lowactive_period",
        "is_live_streamer",
        "is_video_author",
        "follow_user_num",
        "fans_user_num",
        "friend_user_num",
        "register_days",
    ) + tuple(f"onehot_feat{i}" for i in range(18))
    item_categorical: tuple = (
        "author_id",
        "tag",
        "video_type",
        "upload_type",
        "visible_status",
        "music_type",
    )
    item_numeric: tuple = ("video_duration", "server_width", "server_height", "counts")
    item_stat_numeric: tuple = (
        "show_cnt",
        "play_cnt",
        "complete_play_cnt",
        "valid_play_cnt",
        "long_time_play_cnt",
        "short_time_play_cnt",
        "like_cnt",
        "comment_cnt",
        "follow_cnt",
        "share_cnt",
        "collect_cnt",
        "play_progress",
    )
    use_item_stats: bool = False
    history_len: int = 50
    exclude_target: bool = True


@dataclass(frozen=True)
class ScoreRules:
    prerank_topk: int = 100
    prerank_eval: tuple = (50, 100)
    task_weights: dict = field(
        default_factory=lambda: {"long_watch": 0.45, "finish": 0.25, "like": 0.30}
    )
    rank_eval: tuple = (10, 20)
    mrr_k: int = 10


@dataclass(frozen=True)
class RepeatRules:
    """Penalties for one grouping key (author or tag) inside a list."""

    enabled: bool = True
    max_count: int = 10
    hard_max_count: bool = False
    max_consecutive: int = 99
    hard_max_consecutive: bool = False
    repeat_penalty: float = 0.05
    consecutive_penalty: float = 0.20
    new_bonus: float = 0.0


@dataclass(frozen=True)
class RerankRules:
    topk: int = 20
    eval_topk: tuple = (10, 20)
    mrr_k: int = 10
    min_multiplier: float = 0.55
    max_multiplier: float = 1.35
    author: RepeatRules = RepeatRules(
        max_count=2,
        hard_max_count=True,
        max_consecutive=1,
        repeat_penalty=0.05,
        consecutive_penalty=0.20,
        new_bonus=0.01,
    )
    tag: RepeatRules = RepeatRules(
        max_count=6,
        max_consecutive=2,
        repeat_penalty=0.03,
        consecutive_penalty=0.10,
        new_bonus=0.03,
    )
    fresh_enabled: bool = True
    fresh_weight: float = 0.08
    fresh_days: float = 10.0
    fresh_threshold_days: int = 20
    missing_freshness: int = 9999
    reference_dates: dict = field(default_factory=lambda: {"val": 20220430, "test": 20220508})


@dataclass(frozen=True)
class ExperimentRules:
    seed: int = 2026
    traffic: dict = field(default_factory=lambda: {"control": 0.5, "treatment": 0.5})
    topk: tuple = (10, 50)
    primary: str = "long_view_rate@10"
    bootstrap_samples: int = 500
    confidence: float = 0.95
    min_users: int = 5


@dataclass(frozen=True)
class ColdStartRules:
    topk: tuple = (10, 50)
    pool: int = 100
    low_active_max: int = 3
    medium_active_max: int = 10
    low_exposure_max: int = 10
    medium_exposure_max: int = 100
    use_global: bool = True
    use_category: bool = True
    use_freshness: bool = True
    freshness_weight: float = 0.05
    low_exposure_share: float = 0.6
    tag_limit: int = 3
    per_tag: int = 100
    user_segments: tuple = ("new_user", "low_active_user", "medium_active_user", "high_active_user")
    item_segments: tuple = ("new_item", "low_exposure_item", "medium_exposure_item", "popular_item")
    # weight of each list origin, per user segment
    baseline_weights: tuple = (0.45, 0.70, 1.0, 1.0)
    category_weights: tuple = (1.15, 0.70, 0.15, 0.05)
    global_weights: tuple = (0.95, 0.45, 0.05, 0.0)


@dataclass(frozen=True)
class FeedbackRules:
    max_history: int = 50
    long_ratio: float = 0.7
    skip_ratio: float = 0.2
    state_ttl_seconds: int = 604_800
    recent_filter: int = 50
    recall_topk: int = 500
    prerank_topk: int = 100
    popular_topk: int = 200
    default_topk: int = 10
    max_topk: int = 50
    latency_window: int = 5000
