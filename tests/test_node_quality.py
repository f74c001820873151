"""The check of node vectors asks the stated queries."""

import numpy as np

from feedloom.catalog import vectors as checks
from feedloom.operators import vector_search


def test_quality_asks_the_stated_queries(spark, monkeypatch):
    """Every 50th id against all nodes; all nodes were asked before."""
    rng = np.random.default_rng(1)
    made = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(120)], "id long, vector array<float>")
    edges = spark.createDataFrame([(i, (i + 1) % 120) for i in range(120)], "video_id long, neighbor_video_id long")
    asked = []
    search = checks.blocked_topk
    monkeypatch.setattr(checks, "_graph", lambda *a: edges)
    monkeypatch.setattr(checks, "random_walks", lambda e: e)
    monkeypatch.setattr(checks, "graph_vectors", lambda w: made)
    monkeypatch.setattr(checks, "blocked_topk", lambda q, v, *a, **b: asked.append((q, v)) or search(q, v, *a, **b))
    assert checks.embedding_quality(spark, "").first().nodes == 120
    (q, v), = asked
    assert {r.id for r in q.collect()} == {0, 50, 100} and v.count() == 120


def _made(spark, ids, dim=4):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in zip(ids, rng.standard_normal((len(ids), dim)), strict=True)], "id long, vector array<float>")


def test_quality_is_of_all_nodes(spark, monkeypatch):
    """Neighbours of every node decide; before, only every 50th id was asked, here none of them has a near neighbour."""
    made = _made(spark, range(1, 250)).where("id % 50 <> 0").localCheckpoint()
    m = {r.id: np.array(r.vector) for r in made.collect()}
    nearest = {i: max((j for j in m if j != i), key=lambda j: m[i] @ m[j]) for i in m}
    edges = spark.createDataFrame(list(nearest.items()), "video_id long, neighbor_video_id long")
    monkeypatch.setattr(checks, "_graph", lambda *a: edges)
    monkeypatch.setattr(checks, "random_walks", lambda e: e)
    monkeypatch.setattr(checks, "graph_vectors", lambda w: made)
    row = checks.embedding_quality(spark, "").first()
    assert row.nodes == len(m) and row.beats_chance_twofold == 1


def test_waves_give_the_same_lists(spark):
    items = _made(spark, range(300)).localCheckpoint()
    skip = items.selectExpr("id AS query_id", "id AS item_id")
    whole = {tuple(r) for r in vector_search.blocked_topk(items, items, 5, exclude=skip).collect()}
    waves = vector_search.waved_topk(items, items, 5, exclude=skip, most_sent=600, most_rows=40)
    assert {tuple(r) for r in waves.collect()} == whole and len(whole) == 1500
