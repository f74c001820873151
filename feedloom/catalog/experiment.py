"""Checks of policies, offline comparison and cold-start analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog.inputs import events, orders, rounded
from feedloom.catalog.ranking import cut_rows, final_orders, ideal_sql, rank_lists, ranked_orders
from feedloom.catalog.recall import CELLS, SPARSE
from feedloom.catalog.sql import cte, fixed, md5_fraction, sql
from feedloom.config import ColdStartRules, ExperimentRules, ItemCfRules
from feedloom.operators import cold_start as C
from feedloom.operators.experiments import (
    PER_USER,
    assign_groups,
    bootstrap,
    ground_truth,
    group_metrics,
    impressions,
    lift_table,
    primary_values,
    user_metrics,
)
from feedloom.operators.itemcf import itemcf_neighbors
from feedloom.operators.policies import embedding_policy, full_policy, itemcf_policy, only_users, popular_policy
from feedloom.operators.popular import popular_items
from feedloom.operators.sequences import positive_sequences
from feedloom.operators.vector_search import recency_profiles
from feedloom.session import stage

LIST = ["user_id", "video_id", "pos", "score", "source"]
RULES = ExperimentRules()
COLD = ColdStartRules(low_active_max=8, medium_active_max=16, low_exposure_max=20, medium_exposure_max=25)


def _users(x):
    return x.test.select("user_id").distinct()


def groups(spark, sf):
    return rounded(assign_groups(_users(orders(spark, sf)), RULES), "bucket", digits=9)


def truth(spark, sf):
    return ground_truth(orders(spark, sf).test)


def _popular(x, k=50):
    return popular_policy(_users(x), popular_items(x.train), x.sequences, k)


def _cf(x, k=50):
    return itemcf_policy(_users(x), itemcf_neighbors(x.train, SPARSE), x.sequences, k, SPARSE)


def policy_popular(spark, sf):
    return rounded(_popular(orders(spark, sf)).select(*LIST), "score", digits=4)


def policy_cf(spark, sf):
    return rounded(_cf(orders(spark, sf)).select(*LIST), "score")


def policy_embedding(spark, sf):
    x = events(spark, sf).staged()
    prof = stage(recency_profiles(positive_sequences(x.train), x.item_vectors), "profiles")
    return rounded(embedding_policy(_users(x), prof, x.item_vectors, x.sequences, 20, CELLS).select(*LIST), "score", digits=4)


def _stages(x, rerank=True):
    lists = rank_lists(x)
    out = {"recall_candidates": cut_rows(lists, k=50).drop("_x"), "prerank": cut_rows(lists, k=30).drop("_x")}  # policies read 50 places
    if rerank:
        ranked, final = final_orders(x)
        out.update({"rank": ranked.filter("rank_position <= 25"), "rerank": final})
    else:
        out["rank"] = ranked_orders(x).filter("rank_position <= 25")
    return out


def policy_full(spark, sf):
    return rounded(full_policy(_stages(orders(spark, sf).staged()), 50).select(*LIST), "score", digits=4)


def policy_without_rerank(spark, sf):
    x = orders(spark, sf).staged()
    return rounded(full_policy(_stages(x, rerank=False), 50, with_rerank=False).select(*LIST), "score", digits=4)


def per_user(spark, sf):
    x = orders(spark, sf).staged()
    out = user_metrics(_popular(x), _users(x), ground_truth(x.test), x.items).drop("score_sum", "score_n")
    return rounded(out, *[c for c in out.columns if c != "user_id"], digits=5)


def _arms(x):
    """Popular for the control users, co-occurrence for the treatment users."""
    g = stage(assign_groups(_users(x), RULES).select("user_id", "group"), "groups")
    a = only_users(_popular(x), g.filter("group = 'control'"))
    b = only_users(_cf(x), g.filter("group = 'treatment'"))
    return g, stage(a.unionByName(b), "lists")


def comparison(spark, sf):
    x = orders(spark, sf).staged()
    g, lists = _arms(x)
    m = group_metrics(lists, g, ground_truth(x.test), x.items, impressions(x.test), RULES.topk)
    return rounded(lift_table(m), "control", "treatment", "relative_lift")


def intervals(spark, sf):
    x = orders(spark, sf).staged()
    g, lists = _arms(x)
    values = primary_values(user_metrics(lists, g, ground_truth(x.test), x.items), g, "recall@50")
    out = bootstrap(stage(values, "values"), RULES)
    return rounded(out, *[c for c in out.columns if c not in ("control_users", "treatment_users", "skipped")], digits=5)


# ---------------------------------------------------------------- cold start


def _segments(x):
    return C.user_segments(_users(x), x.train, x.sequences, COLD)


def segments_user(spark, sf):
    return _segments(orders(spark, sf))


def segments_item(spark, sf):
    x = orders(spark, sf).staged()
    return C.item_segments(x.items, x.train, COLD)


def sizes_user(spark, sf):
    x = orders(spark, sf).staged()
    return C.user_segment_sizes(_segments(x), impressions(x.test), COLD)


def sizes_item(spark, sf):
    x = orders(spark, sf).staged()
    return C.item_segment_sizes(C.item_segments(x.items, x.train, COLD), COLD)


def tags_recent(spark, sf):
    x = orders(spark, sf).staged()
    return C.recent_tags(x.train, x.sequences, x.items, COLD)


def tag_lists(spark, sf):
    return C.category_popular(orders(spark, sf).train, COLD)


def _category(x):
    mine = C.recent_tags(x.train, x.sequences, x.items, COLD).join(_users(x), "user_id", "left_semi")
    return C.category_candidates(mine, C.category_popular(x.train, COLD), x.sequences, COLD)


def category_lists(spark, sf):
    return rounded(_category(orders(spark, sf)), "score")


def _fused(x):
    seg = stage(_segments(x), "segments")
    items = stage(C.item_segments(x.items, x.train, COLD), "item-segments")
    base = stage(_cf(x, COLD.pool), "baseline")
    cat, pop = stage(_category(x), "category"), _popular(x, COLD.pool)
    return base, cat, seg, items, C.fuse_lists(base, cat, pop, seg, items, COLD)


def fused(spark, sf):
    out = _fused(orders(spark, sf))[-1]
    return rounded(out.select("user_id", "video_id", "pos", "score", "reason"), "score", digits=5)


def lift_by_segment(spark, sf):
    x = orders(spark, sf).staged()
    base, _, seg, _, enhanced = _fused(x)
    t, n = stage(ground_truth(x.test), "truth"), impressions(x.test)
    b = C.segment_metrics(base, seg, t, x.items, n, COLD)
    e = C.segment_metrics(stage(enhanced, "enhanced"), seg, t, x.items, n, COLD)
    keep = F.col("metric").isin("hit_rate@10", "recall@50", "long_view_rate@10", "coverage@10")
    return rounded(C.segment_lift(b.filter(keep), e.filter(keep)), "baseline", "enhanced", "lift")


def metrics_by_segment(spark, sf):
    x = orders(spark, sf).staged()
    out = C.segment_metrics(_popular(x), _segments(x), ground_truth(x.test), x.items, impressions(x.test), COLD)
    return rounded(out, "value")


def item_segment_report(spark, sf):
    x = orders(spark, sf).staged()
    items = C.item_segments(x.items, x.train, COLD)
    out = C.item_segment_metrics(_popular(x), items, ground_truth(x.test), COLD)
    return rounded(out, "hit_rate", "share_of_recommendations", "share_of_hits")


def usage(spark, sf):
    x = orders(spark, sf).staged()
    return C.enhancement_usage(_segments(x), _category(x), COLD)


QUERIES = {
    "ab_groups": groups,
    "ground_truth": truth,
    "policy_popular": policy_popular,
    "policy_itemcf": policy_cf,
    "policy_embedding": policy_embedding,
    "policy_full": policy_full,
    "policy_without_rerank": policy_without_rerank,
    "user_metrics": per_user,
    "ab_comparison": comparison,
    "ab_bootstrap": intervals,
    "user_segments": segments_user,
    "item_segments": segments_item,
    "user_segment_sizes": sizes_user,
    "item_segment_sizes": sizes_item,
    "recent_tags": tags_recent,
    "category_popular": tag_lists,
    "category_candidates": category_lists,
    "cold_start_fusion": fused,
    "segment_lift": lift_by_segment,
    "segment_metrics": metrics_by_segment,
    "item_segment_metrics": item_segment_report,
    "enhancement_usage": usage,
}

# ----------------------------------------------------------------- check SQL

_BUCKET = md5_fraction("'2026:' || CAST(user_id AS VARCHAR)")
cte(
    "groups_o",
    ("users_test_o",),
    f"""SELECT user_id, bucket, CASE WHEN bucket < 0.5 THEN 'control' ELSE 'treatment' END AS "group" FROM (SELECT user_id, {_BUCKET} AS bucket FROM users_test_o)""",
)
cte(
    "truth_o",
    ("test_o",),
    'SELECT user_id, video_id, max(is_positive) AS is_pos, max(long_watch) AS is_long, max("like") AS is_like, max(is_click) AS is_click FROM test_o GROUP BY 1, 2',
)
cte("imp_o", ("test_o",), "SELECT user_id, count(*) AS impressions FROM test_o GROUP BY 1")
for _k in (50, 100):
    cte(
        f"pol_pop{_k}_o",
        ("users_test_o", "popular_o", "seen_o"),
        f"""
SELECT user_id, video_id, pos, score, 'popular' AS source FROM (
SELECT u.user_id, p.video_id, CAST(p.source_score AS DOUBLE) AS score, row_number() OVER (PARTITION BY u.user_id ORDER BY p.popular_rank, p.video_id) AS pos
FROM users_test_o u CROSS JOIN popular_o p
WHERE NOT EXISTS (SELECT 1 FROM seen_o s WHERE s.user_id = u.user_id AND s.video_id = p.video_id)) WHERE pos <= {_k}""",
    )
    cte(
        f"pol_cf{_k}_o",
        ("cf_cand_o",),
        f"SELECT user_id, video_id, source_rank AS pos, source_score AS score, 'itemcf' AS source FROM cf_cand_o WHERE source_rank <= {_k}",
    )
_LIST_SQL = "SELECT user_id, video_id, pos, round(score, {d}) + 0.0 AS score, source FROM {t}"


def _user_metric_ctes(name: str, lists: str) -> None:
    """Per-user metric rows of a list relation, for every test user."""
    cols = []
    for k in (10, 50):
        inside = f"l.pos <= {k}"
        cols += [
            f"sum(CASE WHEN {inside} THEN 1 ELSE 0 END) AS n_{k}",
            f"coalesce(sum(CASE WHEN {inside} THEN t.is_pos END), 0) AS pos_{k}",
            f"coalesce(sum(CASE WHEN {inside} THEN t.is_long END), 0) AS long_{k}",
            f"coalesce(sum(CASE WHEN {inside} THEN t.is_like END), 0) AS like_{k}",
            f"coalesce(sum(CASE WHEN {inside} AND t.is_pos = 1 THEN 1.0 / log2(l.pos + 1.0) END), 0) AS dcg_{k}",
            f"count(DISTINCT CASE WHEN {inside} THEN i.tag END) AS tags_{k}",
        ]
    cte(
        f"got_{name}",
        (lists, "truth_o", "items_o"),
        f"""
SELECT l.user_id, sum(l.score) AS score_sum, count(l.score) AS score_n, {', '.join(cols)} FROM {lists} l
LEFT JOIN truth_o t ON l.user_id = t.user_id AND l.video_id = t.video_id LEFT JOIN items_o i ON l.video_id = i.video_id GROUP BY 1""",
    )
    out = []
    for k in (10, 50):
        ideal = ideal_sql("coalesce(npos, 0)", k)
        out += [
            f'CASE WHEN pos_{k} > 0 THEN 1.0 ELSE 0.0 END AS "hit_rate@{k}"',
            f'CASE WHEN npos > 0 THEN coalesce(pos_{k}, 0) / CAST(npos AS DOUBLE) ELSE 0 END AS "recall@{k}"',
            f'CASE WHEN {ideal} > 0 THEN coalesce(dcg_{k}, 0) / {ideal} ELSE 0 END AS "ndcg@{k}"',
            f'coalesce(pos_{k}, 0) / {k}.0 AS "precision@{k}"',
            f'coalesce(long_{k}, 0) / {k}.0 AS "long_view_rate@{k}"',
            f'coalesce(like_{k}, 0) / {k}.0 AS "like_rate@{k}"',
            f'CASE WHEN n_{k} > 0 THEN tags_{k} / CAST(n_{k} AS DOUBLE) ELSE 0 END AS "category_diversity@{k}"',
        ]
    cte(
        f"um_{name}",
        (f"got_{name}", "users_test_o", "truth_o"),
        f"""
SELECT u.user_id, coalesce(score_sum, 0) AS score_sum, coalesce(score_n, 0) AS score_n, {', '.join(out)}
FROM users_test_o u LEFT JOIN (SELECT user_id, sum(is_pos) AS npos FROM truth_o GROUP BY 1) n ON u.user_id = n.user_id
LEFT JOIN got_{name} g ON u.user_id = g.user_id""",
    )


_METRICS = [f"{m}@{k}" for k in (10, 50) for m in PER_USER]


def _group_metrics(um: str, lists: str, group: str) -> str:
    """(group, metric, value) union over a (user_id, group) relation."""
    join = f'{um} m JOIN {group} g ON m.user_id = g.user_id'
    parts = [
        f'SELECT g."group", \'users\' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {join} GROUP BY 1',
        f'SELECT g."group", \'impressions\', CAST(sum(i.impressions) AS DOUBLE) FROM {join} JOIN imp_o i ON m.user_id = i.user_id GROUP BY 1',
        f'SELECT g."group", \'average_score\', sum(score_sum) / nullif(sum(score_n), 0) FROM {join} GROUP BY 1',
    ]
    parts += [f'SELECT g."group", \'{c}\', avg(m."{c}") FROM {join} GROUP BY 1' for c in _METRICS]
    parts += [
        f"""SELECT x."group", 'coverage@{k}', coalesce(c, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM items_o) FROM (SELECT DISTINCT "group" FROM {group}) x
LEFT JOIN (SELECT g."group", count(DISTINCT l.video_id) AS c FROM {lists} l JOIN {group} g ON l.user_id = g.user_id WHERE l.pos <= {k} GROUP BY 1) y ON x."group" = y."group" """
        for k in (10, 50)
    ]
    return " UNION ALL ".join(parts)


cte(
    "arms_o",
    ("groups_o", "pol_pop50_o", "pol_cf50_o"),
    """
SELECT l.* FROM pol_pop50_o l JOIN groups_o g ON l.user_id = g.user_id WHERE g."group" = 'control'
UNION ALL SELECT l.* FROM pol_cf50_o l JOIN groups_o g ON l.user_id = g.user_id WHERE g."group" = 'treatment'""",
)
_user_metric_ctes("pop", "pol_pop50_o")
_user_metric_ctes("arms", "arms_o")

import math as _math  # noqa: E402

_acc, _poisson = 0.0, "12"
_bounds = []
for _i in range(12):
    _acc += _math.exp(-1.0) / _math.factorial(_i)
    _bounds.append(_acc)
_poisson = "CASE " + " ".join(f"WHEN u < {b!r} THEN {i}" for i, b in enumerate(_bounds)) + " ELSE 12 END"

cte(
    "reps_o",
    ("um_arms", "groups_o"),
    f"""
SELECT replicate, "group", {fixed('value * w')} / nullif(sum(w), 0) AS mean FROM (
SELECT block * 4 + i AS replicate, "group", value, {_poisson} AS w FROM (
SELECT block, i, "group", value, CAST(CAST(('0x' || substr(h, CAST(1 + 8 * i AS INTEGER), 8)) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u FROM (
SELECT b.block, g."group", m."recall@50" AS value, md5('2026:' || CAST(b.block AS VARCHAR) || ':' || CAST(m.user_id AS VARCHAR)) AS h
FROM um_arms m JOIN groups_o g ON m.user_id = g.user_id CROSS JOIN (SELECT unnest(range(125)) AS block) b) CROSS JOIN (SELECT unnest(range(4)) AS i))) GROUP BY 1, 2""",
)
cte(
    "rep_pairs_o",
    ("reps_o",),
    """
SELECT c, t, t - c AS d, CASE WHEN abs(c) >= 1e-12 THEN (t - c) / c END AS l FROM (SELECT replicate,
max(CASE WHEN "group" = 'control' THEN mean END) AS c, max(CASE WHEN "group" = 'treatment' THEN mean END) AS t FROM reps_o GROUP BY 1)""",
)

cte(
    "useg_o",
    ("users_test_o", "train_o"),
    """
SELECT u.user_id, coalesce(p, 0) AS positives, CASE WHEN coalesce(p, 0) <= 0 THEN 'new_user' WHEN p <= 8 THEN 'low_active_user'
  WHEN p <= 16 THEN 'medium_active_user' ELSE 'high_active_user' END AS segment
FROM users_test_o u LEFT JOIN (SELECT user_id, CAST(sum(is_positive) AS BIGINT) AS p FROM train_o GROUP BY 1) t ON u.user_id = t.user_id""",
)
cte("ugrp_o", ("useg_o",), 'SELECT user_id, segment AS "group" FROM useg_o')
cte(
    "iseg_o",
    ("items_o", "train_o"),
    """
SELECT i.video_id, coalesce(e, 0) AS exposures, coalesce(p, 0) AS positives, CASE WHEN coalesce(e, 0) <= 0 OR coalesce(p, 0) <= 0 THEN 'new_item'
  WHEN e <= 20 THEN 'low_exposure_item' WHEN e <= 25 THEN 'medium_exposure_item' ELSE 'popular_item' END AS segment
FROM items_o i LEFT JOIN (SELECT video_id, count(*) AS e, CAST(sum(is_positive) AS BIGINT) AS p FROM train_o GROUP BY 1) t ON i.video_id = t.video_id""",
)
cte("useg_names", (), "SELECT unnest(['new_user', 'low_active_user', 'medium_active_user', 'high_active_user']) AS segment")
cte("iseg_names", (), "SELECT unnest(['new_item', 'low_exposure_item', 'medium_exposure_item', 'popular_item']) AS segment")
cte(
    "isize_o",
    ("iseg_o", "iseg_names"),
    """
SELECT n.segment, count(i.video_id) AS item_count, CAST(coalesce(sum(exposures), 0) AS BIGINT) AS train_exposure_count,
  CAST(coalesce(sum(positives), 0) AS BIGINT) AS train_positive_count FROM iseg_names n LEFT JOIN iseg_o i ON n.segment = i.segment GROUP BY 1""",
)
cte(
    "ptags_o",
    ("train_o",),
    "SELECT user_id, tag, max(time_ms) AS t FROM train_o WHERE is_positive > 0 GROUP BY 1, 2",
)
cte(
    "tags_o",
    ("ptags_o", "watch_rows_o", "items_o"),
    """
SELECT user_id, tag, tag_rank FROM (SELECT user_id, tag, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, tag) AS tag_rank FROM ptags_o) WHERE tag_rank <= 3
UNION ALL SELECT user_id, tag, tag_rank FROM (
SELECT user_id, tag, row_number() OVER (PARTITION BY user_id ORDER BY b, tag) AS tag_rank FROM (
SELECT w.user_id, i.tag, min(w.back) AS b FROM watch_rows_o w JOIN items_o i ON w.video_id = i.video_id
WHERE w.user_id NOT IN (SELECT user_id FROM ptags_o) GROUP BY 1, 2)) WHERE tag_rank <= 3""",
)
cte(
    "catpop_o",
    ("train_o",),
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, video_id) AS item_rank FROM (
SELECT tag, video_id, CAST(sum(is_click) + 6.0 * sum("like") + 3.0 * sum(long_watch) + 2.0 * sum(finish) AS DOUBLE) AS score FROM train_o GROUP BY 1, 2))
WHERE item_rank <= 100""",
)
cte(
    "catcand_o",
    ("tags_o", "catpop_o", "users_test_o", "seen_o"),
    f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, video_id) AS pos FROM (
SELECT t.user_id, c.video_id, {fixed('(1.0 / log2(t.tag_rank + 1.0)) / log2(c.item_rank + 1.0)', '1e12')} AS score
FROM tags_o t JOIN catpop_o c ON t.tag = c.tag WHERE t.user_id IN (SELECT user_id FROM users_test_o)
AND NOT EXISTS (SELECT 1 FROM seen_o s WHERE s.user_id = t.user_id AND s.video_id = c.video_id) GROUP BY 1, 2)""",
)


def _weight(values: tuple) -> str:
    return "CASE segment " + " ".join(
        f"WHEN '{n}' THEN {w}" for n, w in zip(("new_user", "low_active_user", "medium_active_user", "high_active_user"), values)
    ) + " END"


cte(
    "fused_o",
    ("pol_cf100_o", "catcand_o", "pol_pop100_o", "useg_o", "iseg_o"),
    f"""
SELECT user_id, video_id, pos, score, reason FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 12) DESC, coalesce(bp, 1000000000), video_id) AS pos FROM (
SELECT p.user_id, p.video_id, bp, s + CASE WHEN bp IS NULL THEN 0 WHEN coalesce(i.segment, 'new_item') = 'new_item' THEN 0.05
  WHEN i.segment = 'low_exposure_item' THEN 0.03 ELSE 0 END AS score,
  concat_ws('|', CASE WHEN bp IS NOT NULL THEN 'baseline' END,
    CASE WHEN bp IS NOT NULL AND coalesce(i.segment, 'new_item') = 'new_item' THEN 'freshness:new_item' WHEN bp IS NOT NULL AND i.segment = 'low_exposure_item' THEN 'freshness:low_exposure' END,
    CASE WHEN hc > 0 THEN 'category_popular' END, CASE WHEN hg > 0 THEN 'global_popular' END) AS reason
FROM (SELECT user_id, video_id, {fixed('w / log2(pos + 1.0)', '1e12')} AS s, min(CASE WHEN o = 0 THEN pos END) AS bp,
  max(CASE WHEN o = 1 THEN 1 ELSE 0 END) AS hc, max(CASE WHEN o = 2 THEN 1 ELSE 0 END) AS hg FROM (
SELECT l.user_id, video_id, pos, 0 AS o, {_weight((0.45, 0.70, 1.0, 1.0))} AS w FROM pol_cf100_o l JOIN useg_o g ON l.user_id = g.user_id
UNION ALL SELECT l.user_id, video_id, pos, 1, {_weight((1.15, 0.70, 0.15, 0.05))} FROM catcand_o l JOIN useg_o g ON l.user_id = g.user_id
UNION ALL SELECT l.user_id, video_id, pos, 2, {_weight((0.95, 0.45, 0.05, 0.0))} FROM pol_pop100_o l JOIN useg_o g ON l.user_id = g.user_id)
GROUP BY 1, 2) p LEFT JOIN iseg_o i ON p.video_id = i.video_id)) WHERE pos <= 100""",
)
cte("fused_list_o", ("fused_o",), "SELECT user_id, video_id, pos, score FROM fused_o")
_user_metric_ctes("base", "pol_cf100_o")
_user_metric_ctes("fused", "fused_list_o")


def _segment_rows(um: str, lists: str, keep: list[str] | None = None) -> str:
    every = ["users", "impressions", *_METRICS, "coverage@10", "coverage@50", "average_score"]
    names = keep or every
    body = _group_metrics(um, lists, "ugrp_o")
    zero = "CASE WHEN n.metric = 'average_score' THEN NULL ELSE 0 END"
    listed = ", ".join(f"'{m}'" for m in names)
    return f"""
SELECT s.segment AS "group", n.metric, CASE WHEN n.metric = 'average_score' THEN x.value ELSE coalesce(x.value, {zero}) END AS value
FROM useg_names s CROSS JOIN (SELECT unnest([{listed}]) AS metric) n LEFT JOIN ({body}) x ON x."group" = s.segment AND x.metric = n.metric"""


_KEEP = ["hit_rate@10", "recall@50", "long_view_rate@10", "coverage@10"]

ORACLES = {
    "ab_groups": sql('SELECT user_id, round(bucket, 9) AS bucket, "group" FROM groups_o', "groups_o"),
    "ground_truth": sql("SELECT * FROM truth_o", "truth_o"),
    "policy_popular": sql(_LIST_SQL.format(t="pol_pop50_o", d=4), "pol_pop50_o"),
    "policy_itemcf": sql(_LIST_SQL.format(t="pol_cf50_o", d=6), "pol_cf50_o"),
    "policy_embedding": sql(
        """
SELECT user_id, video_id, pos, round(s, 4) + 0.0 AS score, 'twotower_faiss' AS source FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, video_id) AS pos FROM (
SELECT p.user_id, e.id AS video_id, round(list_dot_product(p.v, CAST(e.v AS DOUBLE[])), 9) AS s FROM prof_e p CROSS JOIN vec e
WHERE p.user_id IN (SELECT user_id FROM users_test_e) AND e.id IN (SELECT video_id FROM items_e)
AND NOT EXISTS (SELECT 1 FROM seen_e x WHERE x.user_id = p.user_id AND x.video_id = e.id))) WHERE pos <= 20""",
        "prof_e",
        "vec",
        "items_e",
        "users_test_e",
        "seen_e",
    ),
    "policy_full": sql(
        """
SELECT user_id, video_id, pos, round(score, 4) + 0.0 AS score, source FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY st, p, video_id) AS pos FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, video_id ORDER BY st, p) AS r FROM (
SELECT user_id, video_id, final_rank AS p, rerank_score AS score, 'rerank' AS source, 0 AS st FROM final_o
UNION ALL SELECT user_id, video_id, rank_position, CAST(rank_score AS DOUBLE), 'rank', 1 FROM ranked_o WHERE rank_position <= 25
UNION ALL SELECT user_id, video_id, coarse_rank, CAST(coarse_score AS DOUBLE), 'prerank', 2 FROM cut_o WHERE coarse_rank <= 30
UNION ALL SELECT user_id, video_id, merged_rank, CAST(merged_score AS DOUBLE), 'recall_candidates', 3 FROM merged_o WHERE merged_rank <= 50)) WHERE r = 1) WHERE pos <= 50""",
        "final_o",
        "ranked_o",
        "cut_o",
        "merged_o",
    ),
    "policy_without_rerank": sql(
        """
SELECT user_id, video_id, pos, round(score, 4) + 0.0 AS score, source FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY st, p, video_id) AS pos FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, video_id ORDER BY st, p) AS r FROM (
SELECT user_id, video_id, rank_position AS p, CAST(rank_score AS DOUBLE) AS score, 'rank' AS source, 0 AS st FROM ranked_o WHERE rank_position <= 25
UNION ALL SELECT user_id, video_id, coarse_rank, CAST(coarse_score AS DOUBLE), 'prerank', 1 FROM cut_o WHERE coarse_rank <= 30
UNION ALL SELECT user_id, video_id, merged_rank, CAST(merged_score AS DOUBLE), 'recall_candidates', 2 FROM merged_o WHERE merged_rank <= 50)) WHERE r = 1) WHERE pos <= 50""",
        "ranked_o",
        "cut_o",
        "merged_o",
    ),
    "user_metrics": sql(
        "SELECT user_id, " + ", ".join(f'round(CAST("{c}" AS DOUBLE), 5) AS "{c}"' for c in _METRICS) + " FROM um_pop", "um_pop"
    ),
    "ab_comparison": sql(
        f"""
SELECT metric, round(c, 6) AS control, round(t, 6) AS treatment, round(CASE WHEN abs(c) >= 1e-12 THEN (t - c) / c END, 6) AS relative_lift FROM (
SELECT metric, max(CASE WHEN "group" = 'control' THEN value END) AS c, max(CASE WHEN "group" = 'treatment' THEN value END) AS t
FROM ({_group_metrics('um_arms', 'arms_o', 'groups_o')}) GROUP BY 1)""",
        "um_arms",
        "arms_o",
        "groups_o",
        "imp_o",
        "items_o",
    ),
    "ab_bootstrap": sql(
        """
SELECT cu AS control_users, tu AS treatment_users, 0 AS skipped, round(co, 5) AS observed_control, round(tr, 5) AS observed_treatment,
  round(tr - co, 5) AS observed_delta, round((tr - co) / co, 5) AS observed_relative_lift,
  (SELECT round(quantile_cont(d, 0.025), 5) FROM rep_pairs_o) AS delta_low, (SELECT round(quantile_cont(d, 0.975), 5) FROM rep_pairs_o) AS delta_high,
  (SELECT round(quantile_cont(l, 0.025), 5) FROM rep_pairs_o) AS lift_low, (SELECT round(quantile_cont(l, 0.975), 5) FROM rep_pairs_o) AS lift_high
FROM (SELECT count(*) FILTER ("group" = 'control') AS cu, count(*) FILTER ("group" = 'treatment') AS tu, avg("recall@50") FILTER ("group" = 'control') AS co,
  avg("recall@50") FILTER ("group" = 'treatment') AS tr FROM um_arms m JOIN groups_o g ON m.user_id = g.user_id)""",
        "um_arms",
        "groups_o",
        "rep_pairs_o",
    ),
    "user_segments": sql("SELECT user_id, segment, positives FROM useg_o", "useg_o"),
    "item_segments": sql("SELECT video_id, segment, exposures, positives FROM iseg_o", "iseg_o"),
    "user_segment_sizes": sql(
        """
SELECT n.segment, count(u.user_id) AS user_count, CAST(coalesce(sum(i.impressions), 0) AS BIGINT) AS impression_count
FROM useg_names n LEFT JOIN useg_o u ON n.segment = u.segment LEFT JOIN imp_o i ON u.user_id = i.user_id GROUP BY 1""",
        "useg_names",
        "useg_o",
        "imp_o",
    ),
    "item_segment_sizes": sql("SELECT * FROM isize_o", "isize_o"),
    "recent_tags": sql("SELECT * FROM tags_o", "tags_o"),
    "category_popular": sql("SELECT tag, video_id, score, item_rank FROM catpop_o", "catpop_o"),
    "category_candidates": sql("SELECT user_id, video_id, round(score, 6) AS score, pos FROM catcand_o", "catcand_o"),
    "cold_start_fusion": sql("SELECT user_id, video_id, pos, round(score, 5) AS score, reason FROM fused_o", "fused_o"),
    "segment_lift": sql(
        f"""
SELECT b."group" AS segment, b.metric, round(b.value, 6) AS baseline, round(e.value, 6) AS enhanced,
  round(CASE WHEN abs(b.value) >= 1e-12 THEN (e.value - b.value) / b.value END, 6) AS lift
FROM ({_segment_rows('um_base', 'pol_cf100_o', _KEEP)}) b JOIN ({_segment_rows('um_fused', 'fused_list_o', _KEEP)}) e ON b."group" = e."group" AND b.metric = e.metric""",
        "useg_names",
        "ugrp_o",
        "um_base",
        "um_fused",
        "pol_cf100_o",
        "fused_list_o",
        "imp_o",
        "items_o",
    ),
    "segment_metrics": sql(
        f'SELECT "group", metric, round(value, 6) AS value FROM ({_segment_rows("um_pop", "pol_pop50_o")})',
        "useg_names",
        "ugrp_o",
        "um_pop",
        "pol_pop50_o",
        "imp_o",
        "items_o",
    ),
    "item_segment_metrics": sql(
        """
SELECT k, s.segment, s.item_count, s.train_exposure_count AS exposure_count, coalesce(r, 0) AS recommendation_count, coalesce(h, 0) AS hit_count,
  round(CASE WHEN coalesce(r, 0) > 0 THEN h / CAST(r AS DOUBLE) ELSE 0 END, 6) AS hit_rate,
  round(coalesce(r, 0) / CAST(tr AS DOUBLE), 6) AS share_of_recommendations, round(CASE WHEN th > 0 THEN coalesce(h, 0) / CAST(th AS DOUBLE) ELSE 0 END, 6) AS share_of_hits
FROM isize_o s CROSS JOIN (SELECT unnest([10, 50]) AS k) ks
LEFT JOIN (SELECT kk, segment, CAST(count(*) AS BIGINT) AS r, CAST(sum(hit) AS BIGINT) AS h FROM (
  SELECT kk, coalesce(i.segment, 'new_item') AS segment, CASE WHEN t.is_pos = 1 THEN 1 ELSE 0 END AS hit
  FROM pol_pop50_o l CROSS JOIN (SELECT unnest([10, 50]) AS kk) LEFT JOIN iseg_o i ON l.video_id = i.video_id
  LEFT JOIN truth_o t ON l.user_id = t.user_id AND l.video_id = t.video_id WHERE l.pos <= kk) GROUP BY 1, 2) x ON x.kk = k AND x.segment = s.segment
JOIN (SELECT kk, count(*) AS tr, sum(CASE WHEN t.is_pos = 1 THEN 1 ELSE 0 END) AS th FROM pol_pop50_o l CROSS JOIN (SELECT unnest([10, 50]) AS kk)
  LEFT JOIN truth_o t ON l.user_id = t.user_id AND l.video_id = t.video_id WHERE l.pos <= kk GROUP BY 1) y ON y.kk = k""",
        "isize_o",
        "pol_pop50_o",
        "iseg_o",
        "truth_o",
    ),
    "enhancement_usage": sql(
        """
SELECT CAST(sum(CASE WHEN segment IN ('new_user', 'low_active_user') THEN 1 ELSE 0 END) AS BIGINT) AS global_popular_users,
  CAST(sum(CASE WHEN user_id IN (SELECT user_id FROM catcand_o) THEN 1 ELSE 0 END) AS BIGINT) AS category_popular_users, count(*) AS freshness_boost_users FROM useg_o""",
        "useg_o",
        "catcand_o",
    ),
}
