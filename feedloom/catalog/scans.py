"""Checks of the scans and sinks: CSV tables, pruned and bucketed tables, embeddings, event logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.catalog.data import INTER, INTER_SQL
from feedloom.catalog.inputs import joined, orders, rounded
from feedloom.catalog.ranking import ORACLES as RANKING
from feedloom.catalog.serving import ORACLES as SERVING
from feedloom.catalog.sql import sql
from feedloom.operators.features import user_stats
from feedloom.operators.labels import in_time_order, prepare_users
from feedloom.session import stage_path
from feedloom.sources import adapters as A
from feedloom.sources.schemas import ITEM_COLUMNS, ITEM_STAT_COLUMNS, LOGGED_FEEDBACK_SCHEMA, USER_COLUMNS
from feedloom.sources.tables import keep_columns, load_embeddings, read_columns, read_items, read_json_log, read_users, save_embeddings, write_parquet, write_user_bucketed
from feedloom.streaming.feedback import fold_feedback, normalise_feedback
from feedloom.streaming.jobs import append_event_log, read_parquet_stream


def _full(df, columns):
    return df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit("0")).alias(c) for c in columns], F.lit("x").alias("extra"))


def _written(spark, df, label):
    path = stage_path(spark, label)
    df.write.csv(path, header=True)
    return path


def users_from_csv(spark, sf):
    """Customers as two CSV tables whose columns stand in different order, numbers written in three ways."""
    c = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("user_active_degree"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat("c_nationkey", F.lit(".0"))).when(F.col("c_custkey") % 3 == 1, F.col("c_nationkey").cast("string")).otherwise(F.lit("none")).alias("follow_user_num"),
        F.col("c_acctbal").alias("onehot_feat0"),
    )
    full = _full(c, USER_COLUMNS)
    odd = F.col("user_id").cast("long") % 2 == 1
    paths = [_written(spark, full.where(odd), "users-a"), _written(spark, full.where(~odd).select(*full.columns[::-1]), "users-b")]
    return prepare_users(read_users(spark, paths)).select("user_id", "user_active_degree", "follow_user_num", F.round("onehot_feat0", 2).alias("onehot_feat0"), "register_days")


def items_from_csv(spark, sf):
    """Parts and their sales as the two item CSV tables, joined one to one."""
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("video_id"), F.regexp_replace("p_brand", "^Brand#", "").alias("author_id"), F.col("p_type").alias("tag"), F.col("p_size").alias("video_duration"))
    sold = A.table(spark, sf, "lineitem").where("l_partkey % 10 <> 0").groupBy(F.col("l_partkey").alias("video_id")).agg(F.count("*").alias("show_cnt"), F.sum(F.col("l_quantity").cast("long")).alias("play_cnt"))
    basic, stat = _written(spark, _full(p, ITEM_COLUMNS), "items"), _written(spark, _full(sold, ITEM_STAT_COLUMNS), "item-stats")
    return read_items(spark, basic, stat).select("video_id", "author_id", "tag", "video_duration", "show_cnt", "play_cnt", "like_cnt")


def pruned(spark, sf):
    """A scan of named columns, then a projection of wanted ones of which one is missing."""
    df = read_columns(spark, f"{sf.rstrip('/')}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
    return keep_columns(df, ["o_custkey", "no_such_column", "o_orderstatus", "o_custkey"], ["o_orderkey"])


def embeddings_kept(spark, sf):
    """The embedding table saved, loaded with its checks, and summed up by dimension."""
    path = save_embeddings(A.vectors(spark, sf).select("id", "vector"), stage_path(spark, "embeddings"))
    back = load_embeddings(spark, path)
    return rounded(back.select("id", F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.avg(F.col("x").cast("double")).alias("mean")), "mean")


def bucketed_stats(spark, sf):
    """Train statistics of users from a table bucketed by user."""
    name = write_user_bucketed(orders(spark, sf).train, f"train_by_user_{uuid.uuid4().hex}", 8)
    return rounded(user_stats(spark.table(name)), "user_train_positive_rate")


def ordered_interactions(spark, sf):
    """Interactions written in time order and read back."""
    path = write_parquet(in_time_order(orders(spark, sf).interactions), stage_path(spark, "in-time-order"))
    return rounded(spark.read.parquet(path).select(*INTER), "watch_ratio")


def event_log(spark, sf):
    """The event stream appended to a JSON log, which is then read and folded."""
    out = stage_path(spark, "event-log")
    raw = read_parquet_stream(spark, sf, "events").select(*A.feedback_columns())
    append_event_log(raw, out, f"{out}-progress").awaitTermination()
    states = fold_feedback(normalise_feedback(read_json_log(spark, out, LOGGED_FEEDBACK_SCHEMA)))
    return states.select("user_id", joined("recent_viewed"), "feedback_count", "skip_count")


QUERIES = {
    "user_csv_scan": users_from_csv,
    "item_csv_scan": items_from_csv,
    "pruned_scan": pruned,
    "embedding_table": embeddings_kept,
    "bucketed_user_stats": bucketed_stats,
    "interactions_in_time_order": ordered_interactions,
    "event_log_stream": event_log,
}

ORACLES = {
    "user_csv_scan": """
SELECT c_custkey AS user_id, c_mktsegment AS user_active_degree, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS follow_user_num,
  round(CAST(c_acctbal AS DOUBLE), 2) AS onehot_feat0, CAST(0 AS BIGINT) AS register_days FROM customer""",
    "item_csv_scan": """
SELECT p_partkey AS video_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS author_id, p_type AS tag, CAST(p_size AS DOUBLE) AS video_duration,
  CAST(n AS DOUBLE) AS show_cnt, CAST(q AS DOUBLE) AS play_cnt, CASE WHEN n IS NOT NULL THEN 0.0 END AS like_cnt
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(CAST(trunc(l_quantity) AS BIGINT)) AS q FROM lineitem WHERE l_partkey % 10 <> 0 GROUP BY 1) ON l_partkey = p_partkey""",
    "pruned_scan": "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders",
    "embedding_table": """
SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n, count(DISTINCT id) AS ids, round(avg(x), 6) + 0.0 AS mean FROM (
SELECT vec_id AS id, unnest(range(len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1""",
    "bucketed_user_stats": RANKING["train_user_stats"],
    "interactions_in_time_order": sql(f"SELECT {INTER_SQL} FROM inter_o", "inter_o"),
    "event_log_stream": SERVING["feedback_json_replay"],
}
