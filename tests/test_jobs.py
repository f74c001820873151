"""The whole chain of jobs over the smallest tables."""

from feedloom.config import ExperimentRules, GraphRules, ItemCfRules, VectorRules
from feedloom.operators.multitask import NetworkRules
from feedloom.plans import jobs as J
from feedloom.sources import adapters as A


def test_chain(spark, small, tmp_path):
    rules = J.Rules(
        dates=A.ORDER_SPLIT,
        features=A.ORDER_FEATURES,
        rerank=A.ORDER_RERANK,
        itemcf=ItemCfRules(min_cooccurrence=0.3, shrinkage=1.0),
        graph=GraphRules(walk_length=4, walks_per_node=1, dim=8, epochs=1),
        vectors=VectorRules(cells=8, probes=2),
        experiment=ExperimentRules(bootstrap_samples=40),
        factor_iterations=2,
        tree_rounds=1,
        network=NetworkRules(hidden=(8,), rounds=2),
    )
    ws = J.Workspace(spark, str(tmp_path / "ws"), rules)
    summary = J.preprocess(ws, A.orders_log(spark, small), A.orders_users(spark, small), A.orders_items(spark, small), items_ready=True, by_date=False)
    assert {r["split"] for r in summary.collect()} == {"train", "val", "test"}
    # the vector channels have their own tests; the chain runs on the two table channels
    J.recall_fit(ws, with_graph=False, with_factors=False)
    J.recall_generate(ws, with_graph=False, with_factors=False)
    seen = ws.split("train").select("user_id", "video_id")
    test = ws.load("candidates-test")
    # co-occurrence drops only the recent views, the other channels the whole train history
    plain = test.filter("recall_source not like '%itemcf%'")
    assert plain.join(seen, ["user_id", "video_id"], "left_semi").count() == 0
    assert test.groupBy("user_id").count().agg({"count": "max"}).first()[0] <= 500
    J.coarse_fit(ws)
    J.coarse_infer(ws)
    J.fine_fit(ws)
    J.fine_infer(ws)
    J.rerank(ws)
    final = ws.load("final-test")
    per = final.groupBy("user_id").count().agg({"count": "max"}).first()[0]
    assert per == 20 and final.count() > 0
    rows = J.report(ws).collect()
    assert {r["split"] for r in rows} >= {"val", "test"} and any(r["rerank"] is not None for r in rows)
    # the comparison goes on with what earlier stages left when one is missing
    late = J.Workspace(spark, ws.folder, rules)
    late.path = lambda name: ws.path(name) + ("-gone" if name.startswith("final") else "")
    lists = J.policy_lists(late, "full_pipeline", "test", 50)
    assert {r["source"] for r in lists.select("source").distinct().collect()} <= {"rank", "prerank", "recall_candidates"} and lists.count() > 0
    lift, ci = J.compare_policies(ws)
    assert lift.filter("metric = 'recall@50'").count() == 1 and ci.count() == 1
    out = J.cold_start(ws)
    assert out["user_segments"].count() == 4 and out["lift"].count() == 76
