"""Checks of the recall stage: co-occurrence, graph, walks, vectors, merge, metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from feedloom.catalog.inputs import events, orders, rounded
from feedloom.catalog.sql import cte, fixed, md5_fraction, sql
from feedloom.config import GraphRules, ItemCfRules, MergeRules, VectorRules
from feedloom.operators.itemcf import item_graph, itemcf_candidates, itemcf_neighbors
from feedloom.operators.labels import positive_pairs
from feedloom.operators.merge import drop_seen, merge_candidates, supplement
from feedloom.operators.popular import popular_candidates, popular_items
from feedloom.operators.recall_eval import hit_metrics, source_overlap
from feedloom.operators.sequences import positive_sequences
from feedloom.operators.user_lists import channel_arrays, hit_rows, merged_lists, user_rows
from feedloom.operators.vector_search import (
    exact_topk,
    mean_vector,
    overlap,
    overlap_summary,
    recency_profiles,
    vector_candidates,
    with_similarity,
)
from feedloom.operators.ann import bucket_search, cell_search
from feedloom.operators.node_embeddings import graph_vectors
from feedloom.operators.walks import random_walks, skipgram_pairs
from feedloom.session import stage
from feedloom.sources import adapters as A

SPARSE = ItemCfRules(min_cooccurrence=0.5, shrinkage=1.0)
SHORT_WALKS = GraphRules(walk_length=4, walks_per_node=2, context_window=2)
CELLS = VectorRules(cells=16, probes=4)


# ------------------------------------------------------------- neighbours


def neighbors(kind, rules):
    def run(spark, sf):
        return rounded(itemcf_neighbors(kind(spark, sf).train, rules), "similarity", "cooccurrence")

    return run


def cf_candidates(kind, rules):
    def run(spark, sf):
        x = kind(spark, sf).staged()
        mine = x.sequences.join(x.test.select("user_id").distinct(), "user_id", "left_semi")
        return rounded(itemcf_candidates(mine, itemcf_neighbors(x.train, rules), rules), "source_score")

    return run


def graph(kind, rules=GraphRules()):
    def run(spark, sf):
        return rounded(item_graph(kind(spark, sf).train, rules), "edge_weight")

    return run


def walks(spark, sf):
    edges = stage(item_graph(events(spark, sf).train), "graph")
    out = random_walks(edges, SHORT_WALKS)
    return out.select("walk_no", "start", F.array_join(F.transform("walk", lambda x: x.cast("string")), ",").alias("walk"))


def pairs(spark, sf):
    edges = stage(item_graph(events(spark, sf).train), "graph")
    out = skipgram_pairs(stage(random_walks(edges, SHORT_WALKS), "walks"), SHORT_WALKS)
    return out.groupBy("center", "context").agg(F.count("*").alias("n"))


def walk_vectors(spark, sf):
    edges = stage(item_graph(orders(spark, sf).train), "graph")
    return graph_vectors(stage(random_walks(edges), "walks")).select(
        "id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2")
    )


# ---------------------------------------------------------------- vectors


def _all_vectors(spark, sf):
    return A.vectors(spark, sf).select("id", "vector")


def _self_pairs(v):
    return v.select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))


def exact(similarity):
    def run(spark, sf):
        v = stage(with_similarity(_all_vectors(spark, sf), similarity), "vectors")
        out = exact_topk(v, v, 20, CELLS, _self_pairs(v))
        return rounded(out.select("query_id", "item_id", "score", "rank"), "score", digits=5)

    return run


def query_vectors(v):
    """The stated query set of the approximate searches: every 50th id, against all rows."""
    return v.where("id % 50 = 0")


def near(search):
    def run(spark, sf):
        v = stage(_all_vectors(spark, sf), "vectors")
        q = query_vectors(v)
        return search(q, v, 20, exclude=_self_pairs(q))

    return run


def search_overlap(spark, sf):
    v = stage(_all_vectors(spark, sf), "vectors")
    q = query_vectors(v)
    best = stage(exact_topk(q, v, 20, CELLS), "exact")
    return overlap_summary(overlap(best, cell_search(q, v, 20), 20))


def full_probe_overlap(spark, sf):
    """Probing every cell must find everything: a check of the cell path itself."""
    v = stage(_all_vectors(spark, sf), "vectors")
    best = stage(exact_topk(v, v, 10, CELLS), "exact")
    return overlap_summary(overlap(best, cell_search(v, v, 10, probes=1 << 30), 10))


def label_profiles(spark, sf):
    v = A.vectors(spark, sf)
    lists = v.groupBy(F.col("label").cast("bigint").alias("user_id")).agg(F.array_sort(F.collect_list("id")).alias("seq"))
    out = recency_profiles(lists, v.select("id", "vector"))
    return out.select("id", F.posexplode("vector").alias("dim", "x")).select("id", "dim", F.round(F.col("x").cast("double"), 4).alias("x"))


def vector_mean(spark, sf):
    m = mean_vector(_all_vectors(spark, sf))
    return m.select(F.posexplode("vector").alias("dim", "x")).select("dim", F.round("x", 6).alias("x"))


# ------------------------------------------------------------------ merge


def _profiles(x):
    return stage(recency_profiles(positive_sequences(x.train), x.item_vectors), "profiles")


def channels(x, split="test"):
    """The recall channels of the event adapter, each staged once."""
    users = x.splits[split].select("user_id").distinct()
    mine = x.sequences.join(users, "user_id", "left_semi")
    prof = _profiles(x).join(users.select(F.col("user_id").alias("id")), "id", "left_semi")
    return {
        "popular": stage(popular_candidates(users, popular_items(x.train), 300, x.train), "c-popular"),
        "itemcf": stage(itemcf_candidates(mine, itemcf_neighbors(x.train)), "c-itemcf"),
        "graph_emb": stage(vector_candidates(prof, x.all_vectors, 300, "graph_emb", x.train, CELLS), "c-graph"),
    }


def profile_candidates(spark, sf):
    x = events(spark, sf).staged()
    users = x.test.select(F.col("user_id").alias("id")).distinct()
    prof = _profiles(x).join(users, "id", "left_semi")
    out = vector_candidates(prof, x.item_vectors, 300, "graph_emb", x.train, CELLS)
    return rounded(out, "source_score", digits=4)


MERGED = ["user_id", "video_id", "recall_source", "source_score", "source_rank", "merged_score", "source_count", "merged_rank",
          "popular_score", "popular_rank", "itemcf_score", "itemcf_rank"]


def _two_channels(x, split="test"):
    """popular and itemcf of the sparse adapter for the users of a split."""
    users = x.splits[split].select("user_id").distinct()
    mine = x.sequences.join(users, "user_id", "left_semi")
    return {
        "popular": popular_candidates(users, popular_items(x.train), 300, x.train),
        "itemcf": itemcf_candidates(mine, itemcf_neighbors(x.train, SPARSE), SPARSE),
    }


def merged(kind):
    def run(spark, sf):
        x = kind(spark, sf).staged()
        if kind is orders:
            frames = _two_channels(x)
        else:
            users = x.test.select("user_id").distinct()
            mine = x.sequences.join(users, "user_id", "left_semi")
            frames = {
                "popular": popular_candidates(users, popular_items(x.train), 300, x.train),
                "itemcf": itemcf_candidates(mine, itemcf_neighbors(x.train)),
            }
        out = merge_candidates([stage(f, "channel") for f in frames.values()], MergeRules(final_topk=50 if kind is events else 500))
        return rounded(out.select(*MERGED), "source_score", "merged_score", "popular_score", "itemcf_score", digits=4)

    return run


def merged_all(spark, sf):
    out = merge_candidates(list(channels(events(spark, sf)).values()))
    return out.select("user_id", "video_id", "recall_source", "merged_rank")


def metrics(spark, sf):
    x = orders(spark, sf).staged()
    users, popular = x.test.select("user_id").distinct(), stage(popular_items(x.train), "popular")
    mine = x.sequences.join(users, "user_id", "left_semi")
    found = itemcf_candidates(mine, itemcf_neighbors(x.train, SPARSE), SPARSE)
    lists = merged_lists(channel_arrays(user_rows(users, popular, x.train, found, x.test), popular))
    return rounded(hit_metrics(hit_rows(lists), positive_pairs(x.test), x.items), "value", digits=5)


def channel_overlap(spark, sf):
    x = orders(spark, sf).staged()
    return rounded(source_overlap(_two_channels(x)), "jaccard")


def seen_filter(spark, sf):
    x = events(spark, sf).staged()
    users = x.test.select("user_id").distinct()
    pool = popular_candidates(users, popular_items(x.train), 300, None, False)
    return drop_seen(pool, x.train, 20).select("user_id", "video_id", "source_rank")


def supplemented(spark, sf):
    x = events(spark, sf).staged()
    users = x.test.select("user_id").distinct()
    mine = x.sequences.join(users, "user_id", "left_semi")
    few = itemcf_candidates(mine, itemcf_neighbors(x.train), replace(ItemCfRules(), topk=10))
    pool = popular_candidates(users, popular_items(x.train), 300, x.train)
    return rounded(supplement(few, pool, 20), "source_score", digits=4)


def train_candidates(spark, sf):
    """Train users keep their own items in the pool (no history is removed)."""
    x = events(spark, sf).staged()
    out = popular_candidates(x.train.select("user_id"), popular_items(x.train), 300, None, False)
    return out.select("user_id", "video_id", "source_rank")


QUERIES = {
    "itemcf_neighbors": neighbors(events, ItemCfRules()),
    "itemcf_neighbors_sparse": neighbors(orders, SPARSE),
    "itemcf_candidates": cf_candidates(events, ItemCfRules()),
    "itemcf_candidates_sparse": cf_candidates(orders, SPARSE),
    "item_graph": graph(events),
    "item_graph_sparse": graph(orders),
    "random_walks": walks,
    "skipgram_pairs": pairs,
    "node_vectors": walk_vectors,
    "vector_topk_cosine": exact("cosine"),
    "vector_topk_inner": exact("inner_product"),
    "cell_topk": near(cell_search),
    "hash_topk": near(bucket_search),
    "ann_overlap": search_overlap,
    "ann_overlap_full_probe": full_probe_overlap,
    "recency_profiles": label_profiles,
    "mean_vector": vector_mean,
    "profile_candidates": profile_candidates,
    "merge_candidates": merged(orders),
    "merge_candidates_events": merged(events),
    "merge_all_channels": merged_all,
    "recall_metrics": metrics,
    "source_overlap": channel_overlap,
    "seen_filter": seen_filter,
    "supplement": supplemented,
    "train_candidates": train_candidates,
}

# ----------------------------------------------------------------- check SQL


def _cf_ctes(s: str, tag: str, minimum: float, shrink: float) -> None:
    cte(f"freq_{s}", (f"pos_seq_{s}",), f"SELECT video_id, count(*) AS freq FROM pos_seq_{s} GROUP BY 1")
    cte(
        f"cooc_{s}",
        (f"pos_seq_{s}",),
        f"""
SELECT a.video_id AS i, b.video_id AS j, {fixed('1.0 / log2(2.0 + a.n)')} AS c
FROM pos_seq_{s} a JOIN pos_seq_{s} b ON a.user_id = b.user_id AND a.video_id <> b.video_id WHERE a.n >= 2 GROUP BY 1, 2""",
    )
    cte(
        f"nb_{tag}",
        (f"cooc_{s}", f"freq_{s}"),
        f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY similarity DESC, cooccurrence DESC, neighbor_video_id) AS neighbor_rank
FROM (SELECT i AS video_id, j AS neighbor_video_id, c / (sqrt(CAST(fi.freq AS DOUBLE) * fj.freq) + {shrink}) AS similarity, c AS cooccurrence,
  fi.freq AS item_freq, fj.freq AS neighbor_freq
FROM cooc_{s} JOIN freq_{s} fi ON i = fi.video_id JOIN freq_{s} fj ON j = fj.video_id WHERE c >= {minimum})) WHERE neighbor_rank <= 200""",
    )
    cte(
        f"cf_cand_{tag}",
        (f"nb_{tag}", f"watch_rows_{s}", f"seen_{s}", f"users_test_{s}"),
        f"""
SELECT user_id, video_id, 'itemcf' AS recall_source, score AS source_score, source_rank FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, video_id) AS source_rank FROM (
SELECT h.user_id, n.neighbor_video_id AS video_id, {fixed('n.similarity * h.w', '1e12')} AS score
FROM (SELECT user_id, video_id, {fixed('pow(0.92, back)', '1e12')} AS w FROM watch_rows_{s}
      WHERE user_id IN (SELECT user_id FROM users_test_{s}) GROUP BY 1, 2) h
JOIN nb_{tag} n ON h.video_id = n.video_id
WHERE NOT EXISTS (SELECT 1 FROM seen_{s} x WHERE x.user_id = h.user_id AND x.video_id = n.neighbor_video_id)
GROUP BY 1, 2)) WHERE source_rank <= 300""",
    )
    cte(
        f"graph_{s}",
        (f"pos_seq_{s}",),
        f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY edge_weight DESC, neighbor_video_id) AS neighbor_rank FROM (
SELECT a.video_id AS video_id, b.video_id AS neighbor_video_id, {fixed('1.0 / log2(2.0 + a.n) / abs(a.i - b.i)')} AS edge_weight
FROM pos_seq_{s} a JOIN pos_seq_{s} b ON a.user_id = b.user_id AND a.i <> b.i AND abs(a.i - b.i) <= 5 GROUP BY 1, 2)
WHERE edge_weight >= 0.1) WHERE neighbor_rank <= 200""",
    )


_cf_ctes("e", "e", 2.0, 10.0)
_cf_ctes("o", "o", 0.5, 1.0)

_NB = ("SELECT video_id, neighbor_video_id, round(similarity, 6) AS similarity, round(cooccurrence, 6) AS cooccurrence, item_freq, "
       "neighbor_freq, neighbor_rank FROM {t}")
_CF = "SELECT user_id, video_id, recall_source, round(source_score, 6) AS source_score, source_rank FROM {t}"
_GR = "SELECT video_id, neighbor_video_id, round(edge_weight, 6) AS edge_weight, neighbor_rank FROM {t}"

cte(
    "moves",
    ("graph_e",),
    """
SELECT video_id AS head, neighbor_video_id AS nxt, w,
  CAST(sum(w) OVER (PARTITION BY video_id ORDER BY neighbor_video_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
  CAST(sum(w) OVER (PARTITION BY video_id) AS BIGINT) AS total
FROM (SELECT *, CAST(round(edge_weight * 1e9) AS BIGINT) AS w FROM graph_e)""",
)
cte(
    "walk0",
    ("graph_e",),
    """
SELECT w AS walk_no, node AS start, node AS head, CAST(node AS VARCHAR) AS walk FROM
(SELECT video_id AS node FROM graph_e UNION SELECT neighbor_video_id FROM graph_e), (SELECT unnest([0, 1]) AS w)""",
)
for _i in range(1, 4):
    cte(
        f"walk{_i}",
        (f"walk{_i - 1}", "moves"),
        f"""
SELECT p.walk_no, p.start, m.nxt AS head, p.walk || ',' || CAST(m.nxt AS VARCHAR) AS walk
FROM (SELECT *, {md5_fraction(f"'2026:' || CAST(walk_no AS VARCHAR) || ':' || CAST(start AS VARCHAR) || ':{_i}'")} AS u FROM walk{_i - 1}) p
JOIN moves m ON p.head = m.head AND m.upto > p.u * m.total AND m.upto - m.w <= p.u * m.total""",
    )

cte("vec", (), "SELECT vec_id AS id, embedding AS v, label FROM embeddings")
_UNIT = "list_transform(v, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(v, lambda y: CAST(y AS DOUBLE) * y))), 1e-12))"
cte("unit_cosine", ("vec",), f"SELECT id, CAST({_UNIT} AS FLOAT[]) AS v FROM vec")
cte("unit_inner", ("vec",), "SELECT id, v FROM vec")


def _topk_sql(table: str) -> str:
    return sql(
        f"""
SELECT query_id, item_id, round(s, 5) + 0.0 AS score, rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM (
SELECT a.id AS query_id, b.id AS item_id, round(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 9) AS s
FROM {table} a JOIN {table} b ON a.id <> b.id)) WHERE rank <= 20""",
        table,
    )


def _profile_sql(history: str) -> str:
    """history: (user_id, id, back) with back = 0 for the newest known item."""
    return f"""
SELECT user_id, dim, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY user_id)), 1e-12) AS x FROM (
SELECT user_id, dim, sum(x * w) / sum(w) AS x FROM (
SELECT h.user_id, pow(0.92, h.back) AS w, unnest(range(len(e.v))) AS dim, unnest(e.v) AS x
FROM ({history}) h JOIN vec e ON h.id = e.id) GROUP BY 1, 2)"""


cte(
    "known_e",
    ("pos_seq_e", "vec", "items_e"),
    """
SELECT user_id, video_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) - 1 AS back
FROM pos_seq_e WHERE video_id IN (SELECT id FROM vec) AND video_id IN (SELECT video_id FROM items_e)""",
)
cte("prof_long_e", ("known_e", "vec"), _profile_sql("SELECT * FROM known_e"))
cte("prof_e", ("prof_long_e",), "SELECT user_id, CAST(list(CAST(x AS FLOAT) ORDER BY dim) AS DOUBLE[]) AS v FROM prof_long_e GROUP BY 1")
cte(
    "prof_cand_e",
    ("prof_e", "vec", "items_e", "train_e", "users_test_e"),
    """
SELECT user_id, video_id, 'graph_emb' AS recall_source, s AS source_score, source_rank FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, video_id) AS source_rank FROM (
SELECT p.user_id, e.id AS video_id, round(list_dot_product(p.v, CAST(e.v AS DOUBLE[])), 9) AS s
FROM prof_e p CROSS JOIN vec e
WHERE p.user_id IN (SELECT user_id FROM users_test_e) AND e.id IN (SELECT video_id FROM items_e)
AND NOT EXISTS (SELECT 1 FROM train_e t WHERE t.user_id = p.user_id AND t.video_id = e.id))) WHERE source_rank <= 300""",
)


def _merge_ctes(s: str, k: int) -> None:
    cte(
        f"raw_{s}",
        (f"pop_cand_test_{s}", f"cf_cand_{s}"),
        f"SELECT * FROM pop_cand_test_{s} UNION ALL SELECT * FROM cf_cand_{s}",
    )
    cte(
        f"normed_{s}",
        (f"raw_{s}",),
        f"""
SELECT *, CAST(CASE WHEN hi > lo THEN (source_score - lo) / (hi - lo) ELSE 1.0 / log2(source_rank + 1.0) END AS FLOAT) AS ns FROM (
SELECT *, min(source_score) OVER (PARTITION BY recall_source) AS lo, max(source_score) OVER (PARTITION BY recall_source) AS hi FROM raw_{s})""",
    )
    cte(
        f"merged_{s}",
        (f"normed_{s}",),
        f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY merged_score DESC, source_count DESC, source_rank, video_id) AS merged_rank
FROM (SELECT user_id, video_id, string_agg(recall_source, '|' ORDER BY recall_source) AS recall_source, max(source_score) AS source_score,
  min(source_rank) AS source_rank,
  CAST({fixed("CAST(ns AS DOUBLE) * CASE WHEN recall_source = 'popular' THEN 0.15 ELSE 0.25 END", '1e12')} AS FLOAT) AS merged_score,
  count(*) AS source_count,
  max(CASE WHEN recall_source = 'popular' THEN source_score END) AS popular_score, min(CASE WHEN recall_source = 'popular' THEN source_rank END) AS popular_rank,
  max(CASE WHEN recall_source = 'itemcf' THEN source_score END) AS itemcf_score, min(CASE WHEN recall_source = 'itemcf' THEN source_rank END) AS itemcf_rank
FROM normed_{s} GROUP BY 1, 2)) WHERE merged_rank <= {k}""",
    )


_merge_ctes("o", 500)
_merge_ctes("e", 50)
_MERGED_SQL = ", ".join(
    f"round(CAST({c} AS DOUBLE), 4) AS {c}" if c in ("source_score", "merged_score", "popular_score", "itemcf_score") else c for c in MERGED
)

cte(
    "lists_o",
    ("merged_o", "pop_cand_test_o", "cf_cand_o"),
    """
SELECT *, row_number() OVER (PARTITION BY list, user_id ORDER BY s DESC, r, video_id) AS pos FROM (
SELECT 'overall' AS list, user_id, video_id, CAST(merged_score AS DOUBLE) AS s, merged_rank AS r FROM merged_o
UNION ALL SELECT 'popular', user_id, video_id, source_score, source_rank FROM pop_cand_test_o
UNION ALL SELECT 'itemcf', user_id, video_id, source_score, source_rank FROM cf_cand_o)""",
)
cte(
    "hits_o",
    ("lists_o", "pairs_test_o"),
    """
SELECT l.*, CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END AS hit FROM lists_o l
LEFT JOIN pairs_test_o p ON l.user_id = p.user_id AND l.video_id = p.video_id""",
)
cte("npos_o", ("pairs_test_o",), "SELECT user_id, count(*) AS npos FROM pairs_test_o GROUP BY 1")


def _recall_sql() -> str:
    parts = [
        "SELECT list, 'candidate_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM hits_o GROUP BY 1",
        "SELECT list, 'num_users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM hits_o GROUP BY 1",
        "SELECT list, 'coverage_all', count(DISTINCT video_id) / CAST((SELECT count(*) FROM items_o) AS DOUBLE) FROM hits_o GROUP BY 1",
    ]
    for k in (50, 100, 200):
        ideal = f"list_sum(list_transform(range(1, least(n.npos, {k}) + 1), lambda i: 1.0 / log2(i + 1.0)))"
        parts += [
            f"SELECT list, 'recall@{k}', sum(CASE WHEN pos <= {k} THEN hit ELSE 0 END) / CAST((SELECT count(*) FROM pairs_test_o) AS DOUBLE) FROM hits_o GROUP BY 1",
            f"SELECT list, 'coverage@{k}', count(DISTINCT CASE WHEN pos <= {k} THEN video_id END) / CAST((SELECT count(*) FROM items_o) AS DOUBLE) FROM hits_o GROUP BY 1",
            f"""SELECT list, 'ndcg@{k}', sum(dcg / ideal) / (SELECT count(*) FROM npos_o) FROM (
SELECT h.list, h.user_id, sum(CASE WHEN pos <= {k} THEN hit / log2(pos + 1.0) ELSE 0 END) AS dcg, max({ideal}) AS ideal
FROM hits_o h JOIN npos_o n ON h.user_id = n.user_id GROUP BY 1, 2) GROUP BY 1""",
        ]
    body = " UNION ALL ".join(parts)
    return sql(f"SELECT list, metric, round(value, 5) AS value FROM ({body})", "hits_o", "npos_o", "items_o", "pairs_test_o")


cte(
    "short_cf_e",
    ("cf_cand_e",),
    "SELECT * FROM cf_cand_e WHERE source_rank <= 10",
)

ORACLES = {
    "itemcf_neighbors": sql(_NB.format(t="nb_e"), "nb_e"),
    "itemcf_neighbors_sparse": sql(_NB.format(t="nb_o"), "nb_o"),
    "itemcf_candidates": sql(_CF.format(t="cf_cand_e"), "cf_cand_e"),
    "itemcf_candidates_sparse": sql(_CF.format(t="cf_cand_o"), "cf_cand_o"),
    "item_graph": sql(_GR.format(t="graph_e"), "graph_e"),
    "item_graph_sparse": sql(_GR.format(t="graph_o"), "graph_o"),
    "random_walks": sql("SELECT walk_no, start, walk FROM walk3", "walk3"),
    "skipgram_pairs": sql(
        """
SELECT center, context, count(*) AS n FROM (
SELECT CAST(a.x AS BIGINT) AS center, CAST(b.x AS BIGINT) AS context FROM
(SELECT walk_no, start, unnest(string_split(walk, ',')) AS x, unnest(range(4)) AS i FROM walk3) a JOIN
(SELECT walk_no, start, unnest(string_split(walk, ',')) AS x, unnest(range(4)) AS i FROM walk3) b
ON a.walk_no = b.walk_no AND a.start = b.start AND a.i <> b.i AND abs(a.i - b.i) <= 2) GROUP BY 1, 2""",
        "walk3",
    ),
    "vector_topk_cosine": _topk_sql("unit_cosine"),
    "vector_topk_inner": _topk_sql("unit_inner"),
    "ann_overlap_full_probe": "SELECT count(*) AS queries, CAST(1.0 AS DOUBLE) AS overlap_mean, CAST(1.0 AS DOUBLE) AS overlap_p50, CAST(1.0 AS DOUBLE) AS overlap_p95, "
    "CAST(1.0 AS DOUBLE) AS overlap_min, CAST(1.0 AS DOUBLE) AS overlap_max FROM embeddings",
    "recency_profiles": sql(
        "SELECT user_id AS id, dim, round(x, 4) + 0.0 AS x FROM ("
        + _profile_sql("SELECT CAST(label AS BIGINT) AS user_id, id, row_number() OVER (PARTITION BY label ORDER BY id DESC) - 1 AS back FROM vec")
        + ")",
        "vec",
    ),
    "mean_vector": sql(
        "SELECT dim, round(avg(x), 6) + 0.0 AS x FROM (SELECT unnest(range(len(v))) AS dim, unnest(CAST(v AS DOUBLE[])) AS x FROM vec) GROUP BY 1", "vec"
    ),
    "profile_candidates": sql(
        "SELECT user_id, video_id, recall_source, round(source_score, 4) + 0.0 AS source_score, source_rank FROM prof_cand_e", "prof_cand_e"
    ),
    "merge_candidates": sql(f"SELECT {_MERGED_SQL} FROM merged_o", "merged_o"),
    "merge_candidates_events": sql(f"SELECT {_MERGED_SQL} FROM merged_e", "merged_e"),
    "recall_metrics": _recall_sql(),
    "source_overlap": sql(
        """
SELECT 'itemcf' AS left_source, 'popular' AS right_source, CAST(sum(a * b) AS BIGINT) AS "intersection", CAST(sum(greatest(a, b)) AS BIGINT) AS "union",
  round(sum(a * b) / CAST(sum(greatest(a, b)) AS DOUBLE), 6) AS jaccard
FROM (SELECT user_id, video_id, max(CASE WHEN recall_source = 'itemcf' THEN 1 ELSE 0 END) AS a, max(CASE WHEN recall_source = 'popular' THEN 1 ELSE 0 END) AS b
FROM raw_o GROUP BY 1, 2)""",
        "raw_o",
    ),
    "seen_filter": sql(
        """
SELECT user_id, video_id, popular_rank AS source_rank FROM (
SELECT u.user_id, p.video_id, p.popular_rank, row_number() OVER (PARTITION BY u.user_id ORDER BY p.popular_rank) AS rn
FROM users_test_e u CROSS JOIN popular_e p
WHERE NOT EXISTS (SELECT 1 FROM train_e t WHERE t.user_id = u.user_id AND t.video_id = p.video_id)) WHERE rn <= 20""",
        "users_test_e",
        "popular_e",
        "train_e",
    ),
    "supplement": sql(
        """
SELECT user_id, video_id, recall_source, round(source_score, 4) AS source_score, source_rank FROM (
SELECT * FROM short_cf_e UNION ALL
SELECT p.* FROM pop_cand_test_e p WHERE NOT EXISTS (SELECT 1 FROM short_cf_e c WHERE c.user_id = p.user_id AND c.video_id = p.video_id)
AND coalesce((SELECT count(*) FROM short_cf_e c WHERE c.user_id = p.user_id), 0) < 20)""",
        "short_cf_e",
        "pop_cand_test_e",
    ),
    "train_candidates": sql(
        "SELECT user_id, video_id, popular_rank AS source_rank FROM users_train_e CROSS JOIN popular_e", "users_train_e", "popular_e"
    ),
}
