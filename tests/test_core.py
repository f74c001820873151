"""Hand-computed fixtures: each expected value was worked out on paper."""

import math

import pytest
from pyspark.sql import functions as F

from feedloom.config import (
    ColdStartRules,
    ExperimentRules,
    FeatureRules,
    ItemCfRules,
    LabelRules,
    MergeRules,
    SamplingRules,
    SequenceRules,
    SplitDates,
)
from feedloom.functions.columns import num, tail, ymd_to_date
from feedloom.operators import cold_start as C
from feedloom.operators.encoders import encode, fit_codes, numeric_profile, zscore
from feedloom.operators.experiments import assign_groups, bootstrap, group_metrics
from feedloom.operators.features import source_features, target_histories
from feedloom.operators.itemcf import itemcf_neighbors
from feedloom.operators.labels import add_labels, split_by_date
from feedloom.operators.list_eval import list_metrics
from feedloom.operators.merge import drop_recent, merge_candidates, supplement, waterfall
from feedloom.operators.policies import popular_policy
from feedloom.operators.popular import popular_candidates
from feedloom.operators.rank_metrics import auc_table, list_quality, log_loss_table
from feedloom.operators.sampling import sample_negatives
from feedloom.operators.sequences import positive_sequences, user_sequences
from feedloom.sources.schemas import ITEM_STAT_COLUMNS, LOG_COLUMNS, USER_COLUMNS, require_columns
from feedloom.sources.tables import assert_unique, check_embeddings, read_ranked_lists, save_embeddings


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_watch_ratio_and_finish(spark):
    df = spark.createDataFrame(
        [(1, "95000", 100000), (2, "1", 0), (3, "600000", 100000), (4, "-5", 100), (5, "oops", 100)],
        "id int, play_time_ms string, duration_ms long",
    ).withColumns({"is_like": F.lit(None).cast("int"), "long_view": F.lit(0)})
    got = {r["id"]: (round(r["watch_ratio"], 6), r["finish"], r["like"]) for r in add_labels(df).collect()}
    assert got == {1: (0.95, 1, 0), 2: (0.0, 0, 0), 3: (5.0, 1, 0), 4: (0.0, 0, 0), 5: (0.0, 0, 0)}


def test_long_watch_fallback(spark):
    df = spark.createDataFrame([(1, 70, 100), (2, 18000, 1000000), (3, 69, 100)], "id int, play_time_ms int, duration_ms int")
    df = df.withColumn("is_like", F.lit(0))
    got = {r["id"]: r["long_watch"] for r in add_labels(df, LabelRules()).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_number_and_date_hygiene(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("inf",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(num("v", 7.0)).collect()] == [1.5, 7.0, 7.0, 7.0, 7.0]
    d = spark.createDataFrame([(20240229,), (20230229,), (20241301,), (0,), (None,)], "d int")
    assert [str(r[0]) for r in d.select(ymd_to_date("d")).collect()] == ["2024-02-29", "None", "None", "None", "None"]


def test_splits_keep_gaps_and_overlaps(spark):
    df = spark.createDataFrame([(d,) for d in (1, 2, 3, 4, 5)], "date int")
    got = split_by_date(df, SplitDates(2, 2, 3, 5))
    assert [sorted(r[0] for r in got[s].collect()) for s in ("train", "val", "test")] == [[1, 2], [2, 3], [5]]
    with pytest.raises(ValueError):
        split_by_date(df, SplitDates(strategy="random"))


def test_positive_sequence_cuts_before_it_dedupes(spark):
    df = spark.createDataFrame([(1, v, t, 1) for t, v in enumerate([3, 1, 3, 2, 1])], "user_id long, video_id long, time_ms long, is_positive int")
    assert positive_sequences(df, 4).first()["seq"] == [1, 3, 2]


def test_user_sequences(spark):
    data = [(1, 10, 1, 0, 1), (1, 11, 2, 1, 0), (1, 12, 3, 1, 0), (2, 9, 5, 0, 0)]
    df = spark.createDataFrame(data, "user_id long, video_id long, time_ms long, like int, long_watch int")
    got = {r["user_id"]: r.asDict() for r in user_sequences(df, SequenceRules(max_len=2)).collect()}
    assert got[1]["watch_seq"] == [11, 12] and got[1]["like_seq"] == [11, 12] and got[1]["long_watch_seq"] == [10]
    assert got[1]["history_len"] == 3 and got[1]["last_time_ms"] == 3
    assert got[2]["like_seq"] == [] and got[2]["watch_seq"] == [9]
    assert user_sequences(df, SequenceRules(min_history=2)).count() == 1


def test_tail_of_short_array(spark):
    df = spark.createDataFrame([([7],), ([],), ([1, 2, 3],)], "a array<int>")
    assert [r[0] for r in df.select(tail("a", 2)).collect()] == [[7], [], [2, 3]]


def test_cooccurrence(spark):
    data = [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 1, 1)]
    df = spark.createDataFrame(data, "user_id long, video_id long, time_ms long").withColumn("is_positive", F.lit(1))
    got = {(r[0], r[1]): (round(r[2], 6), round(r[3], 6), r[4], r[5], r[6]) for r in itemcf_neighbors(df, ItemCfRules(min_cooccurrence=0.0, shrinkage=1.0)).collect()}
    assert got[(1, 2)] == (0.269801, 0.930677, 3, 2, 1)
    assert got[(1, 3)] == (0.157639, 0.430677, 3, 1, 2)
    assert got[(2, 3)][0] == 0.178392 and len(got) == 6


def _cand(spark, data):
    return spark.createDataFrame(data, "user_id long, video_id long, recall_source string, source_score double, source_rank long")


def test_merge(spark):
    pop = _cand(spark, [(1, 10, "popular", 5.0, 1), (1, 11, "popular", 3.0, 2)])
    cf = _cand(spark, [(1, 11, "itemcf", 0.8, 1), (1, 12, "itemcf", 0.8, 2)])
    got = merge_candidates([pop, cf]).orderBy("merged_rank").collect()
    assert [r["video_id"] for r in got] == [11, 12, 10]
    assert [round(r["merged_score"], 6) for r in got] == [0.25, 0.157732, 0.15]
    top = got[0]
    assert (top["recall_source"], top["source_score"], top["source_rank"], top["source_count"]) == ("itemcf|popular", 3.0, 1, 2)
    assert (top["popular_rank"], top["itemcf_rank"], top["graph_emb_rank"]) == (2, 1, None)
    assert merge_candidates([pop, cf], MergeRules(quota={"popular": 0, "default": 1})).count() == 1
    with pytest.raises(Exception, match="unlisted recall channel"):
        merge_candidates([_cand(spark, [(1, 1, "other", 1.0, 1)])]).collect()


def test_popular_keeps_global_rank(spark):
    items = spark.createDataFrame([(1, 3.0, 1), (2, 2.0, 2), (3, 1.0, 3)], "video_id long, source_score float, popular_rank int")
    users = spark.createDataFrame([(7,)], "user_id long")
    seen = spark.createDataFrame([(7, 1)], "user_id long, video_id long")
    got = popular_candidates(users, items, 2, seen).orderBy("source_rank")
    assert rows(got, "video_id", "source_rank") == [(2, 2), (3, 3)]


def test_popular_candidates_go_past_any_number_of_seen_items(spark):
    items = spark.createDataFrame([(i, i, 10.0 - i) for i in range(1, 9)], "video_id long, popular_rank long, source_score double")
    users = spark.createDataFrame([(7,), (8,), (9,), (10,)], "user_id long")
    log = [(7, v) for v in (1, 2, 3, 4, 5, 5, 99)] + [(8, 2), (8, 8)] + [(10, v) for v in range(1, 8)]
    seen = spark.createDataFrame(log, "user_id long, video_id long")
    got = popular_candidates(users, items, 2, seen).orderBy("user_id", "source_rank")
    assert rows(got, "user_id", "video_id") == [(7, 6), (7, 7), (8, 1), (8, 3), (9, 1), (9, 2), (10, 8)]


def test_popular_policy_without_rank_sorts_best_first(spark):
    items = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, 5.0)], "video_id long, source_score double")
    users = spark.createDataFrame([(7,), (8,)], "user_id long")
    seqs = spark.createDataFrame([(7, [2])], "user_id long, watch_seq array<long>")
    got = popular_policy(users, items, seqs, 2).orderBy("user_id", "pos")
    assert rows(got, "user_id", "video_id", "pos") == [(7, 3, 1), (7, 1, 2), (8, 2, 1), (8, 3, 2)]


def test_rank_quality(spark):
    df = spark.createDataFrame([(1, i + 1, y) for i, y in enumerate([0, 1, 0, 1])], "user_id long, pos int, rank_label int")
    full = list_quality(df, "pos", (2,), 10).first()
    assert round(full["ndcg_2"], 6) == 0.386853 and full["mrr"] == 0.5
    shown = list_quality(df.filter("pos <= 2"), "pos", (2,), 10).first()
    assert round(shown["ndcg_2"], 6) == 0.63093


def test_auc_and_loss(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "p double, y int").withColumn("one", F.lit(1))
    pairs = {"a": ("y", "p"), "single": ("one", "p")}
    assert {r[0]: r[1] for r in auc_table(df, pairs).collect()} == {"a": 0.875, "single": None}
    loss = {r[0]: r[1] for r in log_loss_table(df, pairs).collect()}
    want = -(math.log(0.9) + math.log(0.6) + math.log(0.4) + math.log(0.8)) / 4
    assert abs(loss["a"] - want) < 1e-8 and loss["single"] is None


def test_adjacent_rate_divides_by_length(spark):
    data = [(1, i + 1, t, 1, 3.0, 1) for i, t in enumerate("xxyx")]
    df = spark.createDataFrame(data, "user_id long, final_rank int, tag string, author_id long, freshness_days double, rank_label int")
    got = {r[0]: r[1] for r in list_metrics(df, df, "final_rank").collect()}
    assert got["adjacent_same_tag_rate"] == 0.25 and got["adjacent_same_author_rate"] == 0.75


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "v double")
    assert abs(df.agg(F.percentile("v", 0.9)).first()[0] - 7.9) < 1e-9


def test_hash_groups(spark):
    users = spark.createDataFrame([(0,), (1,), (2,)], "user_id long")
    got = assign_groups(users, ExperimentRules()).orderBy("user_id").collect()
    assert [r["bucket"] for r in got] == [0.0913737915669945, 0.6731024809009843, 0.37580653537069725]
    assert [r["group"] for r in got] == ["control", "treatment", "control"]
    with pytest.raises(ValueError):
        assign_groups(users, ExperimentRules(traffic={"a": 0.0}))


def test_group_metrics_count_users_without_lists(spark):
    lists = spark.createDataFrame([(1, 5, 1, 2.0), (1, 6, 2, 1.0), (1, 7, 3, None)], "user_id long, video_id long, pos int, score double")
    groups = spark.createDataFrame([(1, "g"), (2, "g")], "user_id long, group string")
    truth = spark.createDataFrame([(1, 6, 1, 1, 0, 0), (2, 6, 1, 0, 0, 0)], "user_id long, video_id long, is_pos int, is_long int, is_like int, is_click int")
    items = spark.createDataFrame([(5, "x"), (6, "x"), (7, "y"), (8, "z")], "video_id long, tag string")
    counts = spark.createDataFrame([(1, 4), (2, 1)], "user_id long, impressions long")
    got = {r["metric"]: r["value"] for r in group_metrics(lists, groups, truth, items, counts, (10,)).collect()}
    assert got["hit_rate@10"] == 0.5 and got["long_view_rate@10"] == 0.05 and got["precision@10"] == 0.05
    assert got["coverage@10"] == 0.75 and got["average_score"] == 1.5 and got["impressions"] == 5
    assert abs(got["category_diversity@10"] - (2 / 3) / 2) < 1e-8


def test_bootstrap_skips_small_arms(spark):
    v = spark.createDataFrame([(i, "control" if i % 2 else "treatment", i % 3 / 2.0) for i in range(6)], "user_id long, group string, value double")
    assert bootstrap(v).first()["skipped"] == 1
    many = spark.range(400).select(F.col("id").alias("user_id"), F.when(F.col("id") % 2 == 0, "control").otherwise("treatment").alias("group"), (F.col("id") % 5 / 5.0 + (F.col("id") % 2) * 0.3).alias("value"))
    r = bootstrap(many).first()
    assert r["skipped"] == 0 and r["delta_low"] < r["observed_delta"] < r["delta_high"] and r["delta_low"] > 0.15


def test_cold_start_fusion(spark):
    lists = lambda ids: spark.createDataFrame([(1, v, i + 1) for i, v in enumerate(ids)], "user_id long, video_id long, pos int")
    seg = spark.createDataFrame([(1, "new_user")], "user_id long, segment string")
    items = spark.createDataFrame([(v, "popular_item") for v in (10, 11, 12)], "video_id long, segment string")
    got = C.fuse_lists(lists([10, 11]), lists([11]), lists([12]), seg, items, ColdStartRules()).orderBy("pos")
    assert [(r["video_id"], round(r["score"], 6)) for r in got.collect()] == [(11, 1.433918), (12, 0.95), (10, 0.45)]
    fresh = C.fuse_lists(lists([10]), lists([]), lists([]), seg, items.filter("video_id > 10"), ColdStartRules()).first()
    assert round(fresh["score"], 6) == 0.5 and fresh["reason"] == "baseline|freshness:new_item"


def test_encoder_and_zscore(spark):
    df = spark.createDataFrame([("b", 1.0), (None, 2.0), ("a", 3.0)], "t string, v double")
    codes = fit_codes(df, "t")
    assert {r[0]: r[1] for r in codes.collect()} == {"__MISSING__": 1, "a": 2, "b": 3}
    other = spark.createDataFrame([("a",), ("zzz",), (None,)], "t string")
    assert sorted(r[0] for r in encode(other, "t", codes).collect()) == [0, 1, 2]
    prof = numeric_profile(df.withColumn("c", F.lit(4.0)), ["v", "c"])
    assert {r[0]: (r[1], r[2]) for r in prof.collect()} == {"v": (2.0, 1.0), "c": (4.0, 1.0)}
    assert sorted(r[0] for r in zscore(df, prof, ["v"]).select("v").collect()) == [-1.0, 0.0, 1.0]


def test_negative_sampling_rules(spark):
    data = [(1, v, 1 if v < 2 else 0) for v in range(30)] + [(2, v, 0) for v in range(10)]
    df = spark.createDataFrame(data, "user_id long, video_id long, label int")
    got = sample_negatives(df, "train", SamplingRules())
    assert {r[0]: r[1] for r in got.groupBy("user_id").count().collect()} == {1: 12}
    assert sample_negatives(df, "test").count() == 40
    assert sample_negatives(df, "train", SamplingRules(train_ratio=0)).count() == 2
    assert sample_negatives(df.filter("label = 0"), "train").count() == 38
    assert sample_negatives(df, "train", SamplingRules(max_negatives=3, include_zero_positive=True)).count() == 8
    again = sample_negatives(df.repartition(7), "train", SamplingRules())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_source_features_and_history(spark):
    df = spark.createDataFrame([(1, 5, 3)], "user_id long, video_id long, popular_rank long")
    r = source_features(df, FeatureRules()).first()
    assert (r["has_popular"], r["has_itemcf"], r["source_count"], r["itemcf_rank"]) == (1, 0, 1.0, 1_000_000.0)
    train = spark.createDataFrame([(1, v, t, 1) for t, v in enumerate([4, 5, 6, 5])], "user_id long, video_id long, time_ms long, is_positive int")
    codes = spark.createDataFrame([(4, 1), (5, 2), (6, 3)], "value long, code int")
    cand = spark.createDataFrame([(1, 5), (1, 9), (2, 5)], "user_id long, video_id long")
    got = {(r[0], r[1]): r[2] for r in target_histories(cand, train, codes, FeatureRules(history_len=3)).collect()}
    assert got == {(1, 5): [0, 1, 3], (1, 9): [2, 3, 2], (2, 5): [0, 0, 0]}


def test_set_operations(spark):
    a = _cand(spark, [(1, 5, "itemcf", 0.5, 1)])
    b = _cand(spark, [(1, 5, "popular", 9.0, 1), (1, 6, "popular", 8.0, 2), (2, 6, "popular", 8.0, 2)])
    assert sorted(rows(supplement(a, b, 2), "user_id", "video_id", "recall_source")) == [(1, 5, "itemcf"), (1, 6, "popular"), (2, 6, "popular")]
    assert supplement(a, b.filter("user_id = 1"), 1).count() == 1
    state = spark.createDataFrame([(1, [6, 5])], "user_id long, recent_viewed array<long>")
    assert sorted(rows(drop_recent(b, state, size=1), "user_id", "video_id")) == [(1, 6), (2, 6)]
    stage = lambda ids, s: spark.createDataFrame([(1, v, i + 1, 1.0, s, s) for i, v in enumerate(ids)], "user_id long, video_id long, pos int, score double, source string, reason string")
    got = waterfall([stage([3, 1], "x"), stage([1, 2, 4], "y")], 3).orderBy("pos")
    assert rows(got, "video_id", "pos", "source") == [(3, 1, "x"), (1, 2, "x"), (2, 3, "y")]


def test_schema_checks(spark, tmp_path):
    assert (len(LOG_COLUMNS), len(USER_COLUMNS), len(ITEM_STAT_COLUMNS)) == (19, 31, 52)
    with pytest.raises(ValueError, match="missing required"):
        require_columns(["a"], ["a", "b"], "t")
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, vector array<float>")
    with pytest.raises(ValueError, match="size"):
        check_embeddings(df)
    with pytest.raises(ValueError, match="duplicate"):
        assert_unique(spark.createDataFrame([(1,), (1,)], "k long"), ["k"], "t")
    path = save_embeddings(df.filter("id = 1"), str(tmp_path / "emb"))
    lists, status = read_ranked_lists(spark, path, "rank", "rank_position", ["s"], 5)
    assert not status["available"] and lists.count() == 0 and "missing" in status["detail"]
    assert read_ranked_lists(spark, str(tmp_path / "none"), "rank", "r", ["s"], 5)[1]["detail"] == "file not found"
    (tmp_path / "pointer").mkdir()
    (tmp_path / "pointer" / "x.parquet").write_text("version https://git-lfs.github.com/spec/v1\n")
    assert not read_ranked_lists(spark, str(tmp_path / "pointer"), "rank", "r", ["s"], 5)[1]["available"]
