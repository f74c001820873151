"""Views of the order, event and embedding tables in the shapes the stages read.

``orders_*``: sparse histories (customer = user, part = item).
``events_*``: dense histories, also used as the feedback and request streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.config import FeatureRules, LabelRules, RerankRules, SplitDates
from feedloom.functions.columns import date_to_ymd
from feedloom.operators.labels import prepare_interactions, prepare_items

ORDER_SPLIT = SplitDates(19991231, 20000101, 20001231, 20010101)
EVENT_SPLIT = SplitDates(20240120, 20240121, 20240125, 20240126)
ORDER_REFERENCE = {"train": 19991231, "val": 20001231, "test": 20011231}
ORDER_FEATURES = FeatureRules(
    reference_dates=ORDER_REFERENCE,
    user_categorical=("user_active_degree",),
    user_numeric=("follow_user_num", "register_days"),
    item_categorical=("author_id", "tag"),
    item_numeric=("video_duration",),
)
ORDER_RERANK = RerankRules(reference_dates={"val": 20001231, "test": 20011231})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Scan of fewer splits than cores (one small file) spread by key; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def wall_millis(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, ts.cast("timestamp_ntz"))


def ymd(ts: Column) -> Column:
    return date_to_ymd(ts.cast("timestamp_ntz").cast("date"))


# ----------------------------------------------------------------- orders


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag"
    )
    li = spread(li, "l_orderkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("video_id"),
        ymd(F.col("o_orderdate")).alias("date"),
        F.lit(0).alias("hourmin"),
        wall_millis(F.col("o_orderdate")).alias("time_ms"),
        F.when(F.col("l_returnflag") != "N", 1).otherwise(0).alias("is_click"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("is_like"),
        F.when(F.col("l_quantity") >= 35, 1).otherwise(0).alias("long_view"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("play_time_ms"),
        F.lit(50000).cast("bigint").alias("duration_ms"),
    )


def orders_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item side: part attributes plus the first ship date as the upload date."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    first = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.min("l_shipdate").alias("first_ship"))
    )
    raw = part.join(first, part.p_partkey == first.l_partkey, "left").select(
        F.col("p_partkey").alias("video_id"),
        F.regexp_replace("p_brand", "^Brand#", "").alias("author_id"),
        F.col("p_type").alias("tag"),
        F.date_format(F.col("first_ship").cast("timestamp_ntz").cast("date"), "yyyy-MM-dd").alias("upload_dt"),
        F.col("p_size").cast("double").alias("video_duration"),
    )
    return prepare_items(raw)


def orders_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("user_active_degree"),
        F.col("c_nationkey").alias("follow_user_num"),
        F.col("c_acctbal").alias("register_days"),
    )


def orders_interactions(spark: SparkSession, sf_dir: str, rules: LabelRules = LabelRules()) -> DataFrame:
    return prepare_interactions(orders_log(spark, sf_dir), orders_items(spark, sf_dir), rules)


# ----------------------------------------------------------------- events


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"), "event_id")
    return ev.select(
        "user_id",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("video_id"),
        ymd(F.col("ts")).alias("date"),
        F.date_format(F.col("ts").cast("timestamp"), "HHmm").cast("int").alias("hourmin"),
        wall_millis(F.col("ts")).alias("time_ms"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("is_click"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("is_like"),
        F.when(F.col("value") >= 42, 1).otherwise(0).alias("long_view"),
        F.round(F.col("value") * 1000).cast("bigint").alias("play_time_ms"),
        F.lit(60000).cast("bigint").alias("duration_ms"),
    )


def events_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the event log: the key itself, ten authors, seven tags."""
    k = table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").try_cast("bigint").alias("video_id")
    ).filter("video_id is not null").distinct()
    return _made_items(k)


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event items and every item that has a vector, with the same made authors and tags."""
    k = vectors(spark, sf_dir).select(F.col("id").cast("bigint").alias("video_id")).filter("video_id is not null")
    return _made_items(k.unionByName(events_items(spark, sf_dir).select("video_id")).distinct())


def _made_items(k: DataFrame) -> DataFrame:
    return prepare_items(
        k.select(
            "video_id",
            (F.col("video_id") % 10).cast("string").alias("author_id"),
            F.concat(F.lit("t"), (F.col("video_id") % 7).cast("string")).alias("tag"),
            F.lit(None).cast("string").alias("upload_dt"),
            F.lit(60.0).alias("video_duration"),
        )
    )


def events_interactions(spark: SparkSession, sf_dir: str, rules: LabelRules = LabelRules()) -> DataFrame:
    return prepare_interactions(events_log(spark, sf_dir), events_items(spark, sf_dir), rules)


def feedback_columns() -> list[Column]:
    """Projection of the event table (batch or stream) to the feedback contract."""
    return [
        F.col("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("video_id"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")).alias("watch_time"),
        F.lit(60.0).alias("duration"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("click"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("like"),
        wall_millis(F.col("ts")).cast("string").alias("timestamp"),
    ]


def events_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*feedback_columns())


def request_columns() -> list[Column]:
    """Projection of the event table to the request-log contract."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type").isin("click", "purchase"), "feedback")
        .when(F.col("event_type") == "signup", "health")
        .otherwise("recommend")
    )
    return [
        F.col("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        kind.alias("event"),
        wall_millis(F.col("ts")).alias("time_ms"),
        (k % 20 + 1).alias("top_k"),
        (k % 20).alias("returned_items"),
        (k % 5 == 0).alias("cache_hit"),
        (k % 7 == 0).alias("degraded_mode"),
        (F.col("value") * 10).alias("total_latency_ms"),
        F.col("value").alias("recall_latency_ms"),
        (F.col("value") * 4).alias("prerank_latency_ms"),
        (F.col("value") * 3).alias("rank_latency_ms"),
        (F.col("value") * 2).alias("rerank_latency_ms"),
    ]


def events_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*request_columns())


# ------------------------------------------------------------- embeddings


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
