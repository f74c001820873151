"""Which items the registered queries search, and of which split their candidates are."""

from feedloom.catalog import ranking, recall, serving
from feedloom.catalog.inputs import events, orders


def test_searches_look_through_all_vectors(spark, small):
    x = events(spark, small)
    logged = {r.video_id for r in x.items.collect()}
    vectors = {r.id for r in x.all_vectors.collect()}
    assert len(vectors) > len(logged)
    merged = recall.merged_all(spark, small).filter("recall_source LIKE '%graph_emb%'").select("video_id").distinct().collect()
    assert {r.video_id for r in merged} - logged and {r.video_id for r in merged} <= vectors
    shown = {r.video_id for r in serving.serve(spark, small).select("video_id").collect()}
    assert shown - logged and shown <= vectors | logged


def test_models_fit_and_score_on_merged_candidates_of_their_split(spark, small):
    x = orders(spark, small).staged()
    for frame, split in zip(ranking._model_frames(x)[:2], ("val", "test"), strict=True):
        rows = frame.select("user_id", "video_id", "label", "has_itemcf", "has_popular").collect()
        truth = {(r.user_id, r.video_id) for r in x.splits[split].filter("is_positive = 1").select("user_id", "video_id").collect()}
        assert rows and {r.user_id for r in rows} <= {r.user_id for r in x.splits[split].select("user_id").collect()}
        assert all((r.label > 0) == ((r.user_id, r.video_id) in truth) for r in rows)
        assert any(r.has_itemcf for r in rows) and any(r.has_popular for r in rows)


def test_a_policy_merges_the_candidates_once_from_staged_interactions(spark, small, monkeypatch):
    """The lists of the first stage and those of the later ones each merged all candidates, from unstaged interactions."""
    from feedloom.catalog import experiment, inputs, ranking

    merged, staged = [], []
    merge, keep = ranking.merge_candidates, inputs.Inputs.staged
    monkeypatch.setattr(ranking, "merge_candidates", lambda frames: merged.append(1) or merge(frames))
    monkeypatch.setattr(inputs.Inputs, "staged", lambda x: staged.append(1) or keep(x))
    experiment.policy_full(spark, small)
    assert len(merged) == len(staged) == 1


def test_rates_travel_with_users_and_items(spark, small, monkeypatch):
    """The score frame equals the one whose candidates are joined with the rates, and only users and items are."""
    from feedloom.operators.encoders import add_target_stats, fit_target_stats

    rated = []
    monkeypatch.setattr(ranking, "add_target_stats", lambda d, *a: rated.append((d.columns, len(a) > 2)) or add_target_stats(d, *a))
    x = orders(spark, small).staged()
    fit, score, cols = ranking._model_frames(x)
    cat, _ = ranking.coarse_columns(fit, ranking.ORDER_FEATURES)
    rates = fit_target_stats(fit, cat, "label", ["user_id", "video_id"])
    plain = add_target_stats(ranking.coarse_rows(x, "test"), rates, cat)
    seen = [{(r.user_id, r.video_id): [r[c] for c in cols] for r in d.select("user_id", "video_id", *cols).collect()} for d in (plain, score)]
    assert seen[0].keys() == seen[1].keys() and len(seen[0]) > 10_000
    assert all(a == b or abs(a - b) < 1e-9 for k in seen[0] for a, b in zip(seen[0][k], seen[1][k], strict=True) if a is not None or b is not None)
    assert rated and all(not {"user_id", "video_id"} <= set(columns) for columns, fitting in rated if not fitting), "candidates are joined with rates"
