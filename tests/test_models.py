"""Attention parts, cross-fitted category rates and the shared network against plain versions."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from feedloom.operators import multitask, scoring
from feedloom.operators.encoders import add_target_stats, fit_target_stats, fold_of


def plain_interest(history, target, own):
    rows = [(v, x) for v, x in history if v != own]
    if not rows:
        return 0.0
    logits = np.array([x @ target for _, x in rows])
    w = np.exp(logits - logits.max())
    return float((w / w.sum() * logits).sum())


def test_attention_of_long_histories_is_merged_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 7)
    monkeypatch.setattr(scoring, "MERGED", 3)
    rng = np.random.default_rng(8)
    vec = {i: (4 * rng.standard_normal(5)).astype("float32") for i in range(60)}
    hist = {1: [int(x) for x in rng.integers(0, 70, 500)], 2: [3], 3: [65, 66], 4: []}
    cand = [(u, v) for u in (1, 2, 3, 4, 5) for v in (3, 4, 59, 69)] + [(1, 3)]
    v = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in vec.items()], "id long, vector array<float>")
    h = spark.createDataFrame(list(hist.items()), "user_id long, seq array<long>")
    c = spark.createDataFrame(cand, "user_id long, video_id long")
    for most in (None, 50):
        got = {(r[0], r[1]): r[2] for r in scoring.interest_scores(c, h, v, most).collect()}
        assert set(got) == {(u, i) for u, i in cand if i in vec}
        for (u, i), x in got.items():
            seq = hist.get(u, [])[-(most or 10**9) :]
            assert abs(x - plain_interest([(j, vec[j].astype(float)) for j in seq if j in vec], vec[i].astype(float), i)) < 1e-9


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), k, ["a", "b", None, "c"][int(rng.integers(0, 4))], int(rng.integers(0, 3)) if k % 7 else None, int(rng.random() < 0.4)) for k, u in enumerate(rng.integers(0, 40, 600))]
    return spark.createDataFrame(rows + [(1, 9999, "rare", 77, 1)], "user_id long, video_id long, tag string, author_id long, label int").cache()


def test_no_row_sees_its_own_label(labelled):
    """The rate of a row is made of other folds only; turning all labels of a fold leaves that fold's rates."""
    keys, cols = ["user_id", "video_id"], ["tag", "author_id", "user_id"]
    rates = lambda df: {(r.user_id, r.video_id): tuple(round(r[f"ts_{c}"], 12) for c in cols) for r in add_target_stats(df, fit_target_stats(df, cols, "label", keys, 3), cols, keys, 3).collect()}
    folds = {(r.user_id, r.video_id): (r.f, r.tag, r.label) for r in labelled.withColumn("f", fold_of(keys, 3)).collect()}
    got = rates(labelled)
    base = sum(y for _, _, y in folds.values()) / len(folds)
    sums = defaultdict(lambda: [0, 0])
    for f, tag, y in folds.values():
        sums[f, tag][0] += y
        sums[f, tag][1] += 1
    for k, (f, tag, _) in folds.items():
        y, n = (sum(sums[g, tag][j] for g in range(3) if g != f) for j in (0, 1))
        assert abs(got[k][0] - (y + 20 * base) / (n + 20)) < 1e-9
    assert abs(got[1, 9999][0] - base) < 1e-9  # its category is in no other fold


def test_rates_when_scoring(labelled, spark):
    cols = ["tag", "author_id"]
    stats = fit_target_stats(labelled, cols, "label", ["user_id", "video_id"])
    new = spark.createDataFrame([(1, "a", 0), (2, None, None), (3, "unseen", 5)], "id long, tag string, author_id long")
    got = {r.id: r for r in add_target_stats(new, stats, cols).collect()}
    rows = labelled.collect()
    base = sum(r.label for r in rows) / len(rows)
    rate = lambda p: (sum(r.label for r in rows if p(r)) + 20 * base) / (sum(map(p, rows)) + 20)
    assert abs(got[1].ts_tag - rate(lambda r: r.tag == "a")) < 1e-9 and abs(got[2].ts_author_id - rate(lambda r: r.author_id is None)) < 1e-9
    assert abs(got[3].ts_tag - base) < 1e-9 and abs(got[2].ts_tag - rate(lambda r: r.tag is None)) < 1e-9


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    layers = multitask._start([4, 6, 5, 3], 1)
    x, y, w = rng.standard_normal((9, 4)), rng.integers(0, 2, (9, 3)).astype(float), np.array([1.0, 0.5, 2.0])
    g, _ = multitask.gradient(layers, x, y, w)
    flat = multitask._flat(layers)
    for k in rng.choice(len(flat), 40, replace=False):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        slope = (multitask.gradient(multitask._shaped(flat + step, layers), x, y, w)[1] - multitask.gradient(multitask._shaped(flat - step, layers), x, y, w)[1]) / 2e-6
        assert abs(slope - g[k]) < 1e-4


def test_network_learns_three_tasks_and_stops(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 4))
    y = np.stack([x[:, 0] * x[:, 1] > 0, x[:, 2] > 0.3, x[:, 0] + x[:, 3] > 0], 1).astype(int)
    df = spark.createDataFrame([(*map(float, a), *map(int, b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, d double, long_watch int, finish int, like int").repartition(3)
    train, held = df.where("abs(a) > 0.1"), df.where("abs(a) <= 0.1")
    net = multitask.fit_network(train, held, ["a", "b", "c", "d", "absent"], rules=multitask.NetworkRules(hidden=(24, 12), rounds=120, rate=0.03))
    assert net.history[-1][0] <= 120 and min(h[2] for h in net.history) < 0.6 * net.history[0][2]
    out = multitask.score_tasks(df.withColumn("e", F.lit(None)), net)
    rows = out.collect()
    for t in ("long_watch", "finish", "like"):
        assert sum((r[f"{t}_score"] > 0.5) == r[t] for r in rows) > 0.85 * len(rows)
    assert multitask.score_tasks(df.limit(0), net).count() == 0


def test_attention_rows_hold_ids_and_blocks_of_vectors_meet(spark, monkeypatch):
    """A row sent to Python is short whatever the length of the vectors, and several blocks of vectors give the same scores."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    sent = []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(Classic, name, lambda df, *a, _f=getattr(Classic, name), **k: (sent.append(df), _f(df, *a, **k))[1])
    rng = np.random.default_rng(4)
    vec = {i: rng.standard_normal(32).astype("float32") for i in range(150)}
    v = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in vec.items()], "id long, vector array<float>")
    h = spark.createDataFrame([(1, list(range(40))), (2, list(range(100, 170)))], "user_id long, seq array<long>")
    c = spark.createDataFrame([(u, i) for u in (1, 2, 3) for i in range(160)], "user_id long, video_id long")
    numbers = lambda x: sum(map(numbers, x)) if isinstance(x, (list, tuple)) else 1
    first = {(r[0], r[1]): r[2] for r in scoring.interest_scores(c, h, v).collect()}
    assert max(numbers(tuple(r)) for r in sent[-1].collect()) < 1000
    for (u, i), x in first.items():
        seq = {1: range(40), 2: range(120, 170)}.get(u, [])
        assert abs(x - plain_interest([(j, vec[j].astype(float)) for j in seq if j in vec], vec[i].astype(float), i)) < 1e-9
    monkeypatch.setattr(scoring, "VECTORS", 60, raising=False)
    again = {(r[0], r[1]): r[2] for r in scoring.interest_scores(c, h, v).collect()}
    assert first.keys() == again.keys() == {(u, i) for u in (1, 2, 3) for i in range(150)}
    assert max(abs(first[k] - again[k]) for k in first) < 1e-9


def test_perceptron_batches_equal_the_model(spark):
    rng = np.random.default_rng(5)
    rows = [(*map(float, x), int(x[0] + x[1] * x[2] > 0)) for x in rng.standard_normal((300, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int")
    cols = ["a", "b", "c"]
    model = scoring.fit_mlp(df, cols, hidden=(6, 4), rounds=15)
    x = np.array([r[:3] for r in rows])
    want = [r.probability[1] for r in model.transform(scoring.assemble(df, cols)).select("a", "probability").orderBy("a").collect()]
    got = [r.s for r in scoring.predict(df, model, cols, "s").orderBy("a").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-6
    assert np.abs(scoring.mlp_probabilities(x, list(model.getLayers()), model.weights.toArray())[np.argsort(x[:, 0])] - want).max() < 1e-9


def test_trees_walk_in_batches(spark):
    """Boosted trees score Arrow batches with the values of the model; every row went through a vector and two udfs before."""
    from feedloom.operators.scoring import fit_trees, forest, predict

    rng = np.random.default_rng(7)
    rows = [(int(i), float(a), float(b), None if i % 9 == 0 else float(c), int(a + b * c > 0)) for i, (a, b, c) in enumerate(rng.standard_normal((600, 3)))]
    data = spark.createDataFrame(rows, "i int, a double, b double, c double, label int").repartition(2, "i").localCheckpoint()
    model = fit_trees(data.withColumn("gone", F.lit(0.0)), ["a", "b", "c", "gone"], rounds=6)
    trees = forest(model.toDebugString)
    x = np.vstack([rng.standard_normal((300, 4)), [[np.nan, 0, np.nan, 0]]])
    want = [model.predictProbability(Vectors.dense(v))[1] for v in x]
    assert np.allclose(trees.probabilities(x), want, rtol=0, atol=1e-12) and len(trees.roots) == 6
    out = predict(data, model, ["a", "b", "c", "gone"], "p")
    assert out.columns == ["i", "a", "b", "c", "label", "p"]
    assert "VectorAssembler" not in out._jdf.queryExecution().toString() and "ArrowEvalPython" in out._jdf.queryExecution().toString()
    for r in out.collect():
        assert abs(r.p - model.predictProbability(Vectors.dense([r.a, r.b, 0.0 if r.c is None else r.c, 0.0]))[1]) < 1e-6
