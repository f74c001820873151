"""The jobs, stage by stage.  Each reads and writes parquet tables under one folder.

    ws = Workspace(spark, "/shared/feed")
    preprocess(ws, logs, users, items)
    recall_fit(ws); recall_generate(ws)
    coarse_fit(ws); coarse_infer(ws)
    fine_fit(ws); fine_infer(ws)
    rerank(ws); report(ws)
    compare_policies(ws); cold_start(ws)

Tables written: interactions, users, items, sequences, popular, itemcf, graph,
graph_vectors, user_factors, item_factors, candidates-<split>, channel-<name>-<split>,
coarse-<split>, ranked-<split>, final-<split>, metrics and the reports.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import config as K
from feedloom.operators import cold_start as C
from feedloom.operators import experiments as E
from feedloom.operators import policies as P
from feedloom.operators.ann import cell_search
from feedloom.operators.encoders import add_target_stats, fit_target_stats, numeric_profile, zscore
from feedloom.operators.features import coarse_columns, coarse_frame, fine_columns, fine_frame, item_stats, task_labels, user_stats
from feedloom.operators.itemcf import item_graph, itemcf_candidates, itemcf_neighbors
from feedloom.operators.labels import attach_label, prepare_interactions, prepare_items, prepare_users, split_by_date, split_summary
from feedloom.operators.list_eval import before_after
from feedloom.operators.merge import merge_candidates
from feedloom.operators.multitask import NetworkRules, fit_network, network_from, network_rows, score_tasks
from feedloom.operators.node_embeddings import graph_vectors
from feedloom.operators.popular import popular_candidates, popular_items
from feedloom.operators.rank_metrics import coarse_metrics, coarse_topk, ranked_metrics
from feedloom.operators.recall_eval import recall_metrics, source_overlap
from feedloom.operators.rerank import greedy_rerank, with_item_meta
from feedloom.operators.sampling import sample_negatives
from feedloom.operators.scoring import fit_mlp, fit_trees, interest_scores, latent_factors, predict, rank_score, ranked_candidates
from feedloom.operators.sequences import positive_sequences, user_sequences
from feedloom.operators.vector_search import exact_topk, overlap, overlap_summary, recency_profiles, vector_candidates
from feedloom.operators.walks import random_walks
from feedloom.session import stage
from feedloom.sources.tables import pipeline_report, read_metrics, write_metrics, write_parquet


@dataclass
class Rules:
    labels: K.LabelRules = K.LabelRules()
    dates: K.SplitDates = K.SplitDates()
    sequences: K.SequenceRules = K.SequenceRules()
    popular: K.PopularRules = K.PopularRules()
    itemcf: K.ItemCfRules = K.ItemCfRules()
    graph: K.GraphRules = K.GraphRules()
    vectors: K.VectorRules = K.VectorRules()
    merge: K.MergeRules = field(default_factory=K.MergeRules)
    features: K.FeatureRules = field(default_factory=K.FeatureRules)
    scores: K.ScoreRules = field(default_factory=K.ScoreRules)
    rerank: K.RerankRules = field(default_factory=K.RerankRules)
    experiment: K.ExperimentRules = field(default_factory=K.ExperimentRules)
    cold: K.ColdStartRules = K.ColdStartRules()
    factor_iterations: int = 10
    tree_rounds: int = 350
    tree_rate: float = 0.05
    network: NetworkRules = NetworkRules()


@dataclass
class Workspace:
    spark: SparkSession
    folder: str
    rules: Rules = field(default_factory=Rules)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def save(self, name: str, df: DataFrame, **kw) -> DataFrame:
        write_parquet(df, self.path(name), **kw)
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def has(self, name: str) -> bool:
        """Is there a readable table of this name?"""
        try:
            self.load(name)
        except AnalysisException:
            return False
        return True

    def split(self, name: str) -> DataFrame:
        return split_by_date(self.load("interactions"), self.rules.dates)[name]

    def add_metrics(self, stage_name: str, split: str, metrics: DataFrame) -> None:
        long = metrics.select(F.lit(stage_name).alias("stage"), F.lit(split).alias("split"), "metric", "value")
        write_metrics(long, self.path("metrics"))


def preprocess(ws: Workspace, logs: DataFrame, users: DataFrame, items: DataFrame, items_ready: bool = False, by_date: bool = True) -> DataFrame:
    """Interactions, side tables and train-only sequences; returns the split summary.

    With ``by_date`` the interactions are partitioned by date, so a split reads only
    its days.  The rebalance hint merges small days and divides a crowded one.
    """
    items = items if items_ready else prepare_items(items)
    ws.save("items", items)
    ws.save("users", prepare_users(users))
    rows = prepare_interactions(logs, ws.load("items"), ws.rules.labels)
    if by_date:
        ws.save("interactions", rows.hint("rebalance", "date"), partition_by=["date"])
    else:
        ws.save("interactions", rows)
    ws.save("sequences", user_sequences(ws.split("train"), ws.rules.sequences))
    return split_summary({s: ws.split(s) for s in K.SPLITS})


def recall_fit(ws: Workspace, with_graph: bool = True, with_factors: bool = True) -> None:
    train, r = ws.split("train"), ws.rules
    ws.save("popular", popular_items(train, r.popular))
    ws.save("itemcf", itemcf_neighbors(train, r.itemcf))
    if with_factors:
        users, items = latent_factors(train, r.graph.dim, r.factor_iterations)
        ws.save("user_factors", users)
        ws.save("item_factors", items)
    if with_graph:
        edges = ws.save("graph", item_graph(train, r.graph))
        ws.save("graph_vectors", graph_vectors(stage(random_walks(edges, r.graph), "walks"), r.graph))


def channels_for(ws: Workspace, split: str, with_graph: bool = True, with_factors: bool = True, approximate: bool = False) -> dict[str, DataFrame]:
    """Recall channels of a split.  Train keeps the users' own items; val and test drop what train saw."""
    r, users, train = ws.rules, ws.split(split).select("user_id").distinct(), ws.split("train")
    own = split == "train"
    history = None if own else train
    mine = ws.load("sequences").join(users, "user_id", "left_semi")
    out = {
        "popular": popular_candidates(users, ws.load("popular"), r.popular.candidate_topk, history, not own),
        "itemcf": itemcf_candidates(mine, ws.load("itemcf"), replace(r.itemcf, exclude_seen=not own)),
    }
    ids = users.select(F.col("user_id").alias("id"))
    if with_factors:
        name = "twotower_faiss" if approximate else "twotower"
        vec = ws.load("user_factors").join(ids, "id", "left_semi")
        out[name] = vector_candidates(vec, ws.load("item_factors"), 300, name, history, r.vectors, not approximate)
    if with_graph:
        known = positive_sequences(train, r.graph.max_history).join(users, "user_id", "left_semi")
        prof = stage(recency_profiles(known, ws.load("graph_vectors"), r.graph.recency), "profiles")
        out["graph_emb"] = vector_candidates(prof, ws.load("graph_vectors"), r.graph.candidate_topk, "graph_emb", history, r.vectors)
    return out


def recall_generate(ws: Workspace, splits: tuple = K.SPLITS, **kw) -> None:
    for split in splits:
        made = {n: ws.save(f"channel-{n}-{split}", d) for n, d in channels_for(ws, split, **kw).items()}
        labelled = attach_label(merge_candidates(list(made.values()), ws.rules.merge), ws.split(split))
        merged = ws.save(f"candidates-{split}", labelled)
        m = recall_metrics(merged, made, ws.split(split), ws.load("items")).select(
            F.concat_ws("/", "list", "metric").alias("metric"), "value"
        )
        ws.add_metrics("recall", split, m)
        ws.save(f"overlap-{split}", source_overlap(made))


def _coarse(ws: Workspace, cand: DataFrame, split: str) -> DataFrame:
    train = ws.split("train")
    return coarse_frame(cand, ws.load("users"), ws.load("items"), ws.load("sequences"), user_stats(train), item_stats(train), split, ws.rules.features)


PAIR = ["user_id", "video_id"]


def _with_rates(ws: Workspace, frames: dict[str, DataFrame], cat: list[str], label: str, name: str) -> dict[str, DataFrame]:
    """Label rates of the categorical columns: cross-fitted on train, whole rates elsewhere."""
    rates = ws.save(name, fit_target_stats(frames["train"], cat, label, PAIR))
    return {s: stage(add_target_stats(f, rates, cat, PAIR if s == "train" else None), f"{name}-{s}") for s, f in frames.items()}


def _rated(ws: Workspace, frame: DataFrame, cols: list[str], name: str) -> DataFrame:
    return add_target_stats(frame, ws.load(name), [c[3:] for c in cols if c.startswith("ts_")])


def coarse_fit(ws: Workspace, model: str = "trees") -> None:
    """Fit on the sampled train candidates, stopping early on the sampled val candidates."""
    frames = {
        s: stage(_coarse(ws, sample_negatives(ws.load(f"candidates-{s}"), s, K.PRERANK_SAMPLING), s), f"coarse-{s}")
        for s in ("train", "val")
    }
    cat, cols = coarse_columns(frames["train"], ws.rules.features)
    frames = _with_rates(ws, frames, cat, "label", "coarse-rates")
    cols = cols + [f"ts_{c}" for c in cat]
    if model == "trees":
        fitted = fit_trees(frames["train"], cols, validation=frames["val"], rounds=ws.rules.tree_rounds, rate=ws.rules.tree_rate)
    elif model == "mlp":
        prof = ws.save("coarse-profile", numeric_profile(frames["train"], cols))
        fitted = fit_mlp(zscore(frames["train"], prof, cols), cols)
    else:
        raise ValueError(f"unsupported coarse model: {model}")
    fitted.write().overwrite().save(ws.path(f"model-coarse-{model}"))
    ws.save("coarse-columns", ws.spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "i int, name string"))


def _columns(ws: Workspace, name: str) -> list[str]:
    return [r["name"] for r in ws.load(name).orderBy("i").collect()]  # one row per feature


def coarse_infer(ws: Workspace, splits: tuple = K.SPLITS, model: str = "trees") -> None:
    cols = _columns(ws, "coarse-columns")
    loader = GBTClassificationModel if model == "trees" else MultilayerPerceptronClassificationModel
    fitted = loader.load(ws.path(f"model-coarse-{model}"))
    for split in splits:
        cand = ws.load(f"candidates-{split}")
        # the candidate's own columns travel with the features, so no join brings the scores back
        own = [F.col(c).alias(f"own_{c}") for c in cand.columns if c not in PAIR]
        frame = _rated(ws, _coarse(ws, cand.select("*", *own), split), cols, "coarse-rates")
        if model == "mlp":
            frame = zscore(frame, ws.load("coarse-profile"), cols)
        scored = predict(frame, fitted, cols, "coarse_score")
        scored = scored.select(*[c if c in PAIR else F.col(f"own_{c}").alias(c) for c in cand.columns], "coarse_score")
        top = ws.save(f"coarse-{split}", coarse_topk(scored, ws.rules.scores.prerank_topk))
        ws.add_metrics("prerank", split, coarse_metrics(cand, top, ws.rules.scores))


def _fine(ws: Workspace, split: str) -> DataFrame:
    frame = fine_frame(
        ws.load(f"coarse-{split}"), task_labels(ws.split(split)), ws.load("users"), ws.load("items"), ws.split("train"), split, ws.rules.features
    )
    vectors = next((ws.load(t) for t in ("item_factors", "graph_vectors") if ws.has(t)), None)
    if vectors is None:
        return frame.withColumn("interest_score", F.lit(0.0))
    r = ws.rules.features
    known = interest_scores(frame, positive_sequences(ws.split("train"), 3 * r.history_len), vectors, r.history_len)
    return frame.join(known, PAIR, "left").withColumn("interest_score", F.coalesce("interest_score", F.lit(0.0)))


def fine_fit(ws: Workspace) -> None:
    """Fit the shared network on the sampled train candidates, stopping by the sampled val candidates."""
    frames = {s: stage(sample_negatives(_fine(ws, s), s, K.RANK_SAMPLING, "rank_label"), f"fine-{s}") for s in ("train", "val")}
    cat, cols = fine_columns(frames["train"], ws.rules.features)
    frames = _with_rates(ws, frames, cat, "rank_label", "fine-rates")
    cols = [*cols, "interest_score", *[f"ts_{c}" for c in cat]]
    ws.save("model-fine", network_rows(ws.spark, fit_network(frames["train"], frames["val"], cols, K.TASKS, ws.rules.network)))


def fine_infer(ws: Workspace, splits: tuple = ("val", "test")) -> None:
    network = network_from(ws.load("model-fine"))
    keep = ["user_id", "video_id", "recall_source", "merged_score", "source_count", "merged_rank", "coarse_score", "coarse_rank", "label",
            "rank_label", *K.TASKS, *[f"{t}_score" for t in K.TASKS], "rank_score"]
    for split in splits:
        scored = score_tasks(_rated(ws, _fine(ws, split), network.columns, "fine-rates"), network)
        scored = scored.withColumn("rank_score", rank_score(ws.rules.scores.task_weights))
        ranked = ws.save(f"ranked-{split}", ranked_candidates(scored.select(*[c for c in keep if c in scored.columns])))
        ws.add_metrics("rank", split, ranked_metrics(ranked, ws.rules.scores))


def rerank(ws: Workspace, splits: tuple = ("val", "test")) -> None:
    for split in splits:
        full = stage(with_item_meta(ws.load(f"ranked-{split}"), ws.load("items"), split, ws.rules.rerank), "ranked-meta")
        final = ws.save(f"final-{split}", greedy_rerank(full, ws.rules.rerank))
        both = before_after(full, final, ws.rules.rerank).unpivot(["metric"], ["before", "after", "delta"], "side", "value")
        ws.add_metrics("rerank", split, both.select(F.concat_ws("/", "side", "metric").alias("metric"), "value"))


def report(ws: Workspace) -> DataFrame:
    """Metrics of all stages side by side."""
    return pipeline_report(read_metrics(ws.spark, ws.path("metrics")))


def compare_search(ws: Workspace, k: int = 500) -> DataFrame:
    """Overlap of nearest-cell search with exact search over the factor tables."""
    users, items = ws.load("user_factors"), ws.load("item_factors")
    best = stage(exact_topk(users, items, k, ws.rules.vectors), "exact")
    return overlap_summary(overlap(best, cell_search(users, items, k), k))


def policy_lists(ws: Workspace, kind: str, split: str, k: int) -> DataFrame:
    users, seqs = ws.split(split).select("user_id").distinct(), ws.load("sequences")
    if kind == "popular":
        return P.popular_policy(users, ws.load("popular"), seqs, k)
    if kind == "itemcf":
        return P.itemcf_policy(users, ws.load("itemcf"), seqs, k, ws.rules.itemcf)
    if kind == "twotower_faiss":
        return P.embedding_policy(users, ws.load("user_factors"), ws.load("item_factors"), seqs, k, ws.rules.vectors)
    if kind in ("full_pipeline", "full_pipeline_without_rerank"):
        stages = {"recall_candidates": f"candidates-{split}", "prerank": f"coarse-{split}", "rank": f"ranked-{split}", "rerank": f"final-{split}"}
        lists, _ = P.stored_policy(ws.spark, {n: ws.path(t) for n, t in stages.items()}, k, kind == "full_pipeline")
        return lists
    raise ValueError(f"unsupported policy: {kind}")


def compare_policies(ws: Workspace, control: str = "popular", treatment: str = "full_pipeline", split: str = "test") -> tuple[DataFrame, DataFrame]:
    """(lift table, bootstrap row) of two policies on hash-split users."""
    r, data = ws.rules.experiment, ws.split(split)
    groups = stage(E.assign_groups(data, r).select("user_id", "group"), "groups")
    arms = [
        P.only_users(policy_lists(ws, kind, split, max(r.topk)), groups.filter(F.col("group") == name))
        for name, kind in (("control", control), ("treatment", treatment))
    ]
    lists, truth, items = stage(arms[0].unionByName(arms[1]), "arms"), stage(E.ground_truth(data), "truth"), ws.load("items")
    lift = E.lift_table(E.group_metrics(lists, groups, truth, items, E.impressions(data), r.topk))
    values = stage(E.primary_values(E.user_metrics(lists, groups, truth, items, r.topk), groups, r.primary), "values")
    return lift, E.bootstrap(values, r)


def cold_start(ws: Workspace, split: str = "test") -> dict[str, DataFrame]:
    """Segment sizes, baseline and enhanced metrics, lift, item-segment report and strategy usage."""
    r, train, data, items = ws.rules.cold, ws.split("train"), ws.split(split), ws.load("items")
    seqs, counts = ws.load("sequences"), E.impressions(data)
    seg = stage(C.user_segments(data, train, seqs, r), "segments")
    item_seg = stage(C.item_segments(items, train, r), "item-segments")
    tags = C.recent_tags(train, seqs, items, r).join(seg.select("user_id"), "user_id", "left_semi")
    category = stage(C.category_candidates(tags, C.category_popular(train, r), seqs, r), "category")
    base = stage(policy_lists(ws, "full_pipeline", split, r.pool), "baseline")
    pop = policy_lists(ws, "popular", split, r.pool)
    better = stage(C.fuse_lists(base, category, pop, seg, item_seg, r), "enhanced")
    truth = stage(E.ground_truth(data), "truth")
    b, e = (stage(C.segment_metrics(x, seg, truth, items, counts, r), "segment-metrics") for x in (base, better))
    return {
        "user_segments": C.user_segment_sizes(seg, counts, r),
        "item_segments": C.item_segment_sizes(item_seg, r),
        "baseline": b,
        "enhanced": e,
        "lift": C.segment_lift(b, e),
        "baseline_items": C.item_segment_metrics(base, item_seg, truth, r),
        "enhanced_items": C.item_segment_metrics(better, item_seg, truth, r),
        "usage": C.enhancement_usage(seg, category, r),
    }
