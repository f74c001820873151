"""Sums, lists and reads that must hold for any size and any file layout."""

from pyspark.sql import functions as F

from feedloom.functions.columns import fixed_sum
from feedloom.operators.policies import popular_policy
from feedloom.sources.schemas import LOG_COLUMNS
from feedloom.sources.tables import read_logs


def test_sum_of_unknown_ages_does_not_overflow(spark):
    assert spark.range(10_000_000).select(fixed_sum(F.lit(9999.0)).alias("s")).first().s == 9999.0 * 10_000_000


def test_popular_list_outlasts_a_long_history(spark):
    items = spark.range(1, 201).selectExpr("id AS video_id", "CAST(201 - id AS double) AS source_score", "CAST(id AS int) AS popular_rank")
    sequences = spark.createDataFrame([(1, list(range(1, 81))), (2, [])], "user_id long, watch_seq array<long>")
    got = popular_policy(spark.createDataFrame([(1,), (2,)], "user_id long"), items, sequences, 20)
    lists = {u: [r.video_id for r in got.where(F.col("user_id") == u).orderBy("pos").collect()] for u in (1, 2)}
    assert lists == {1: list(range(81, 101)), 2: list(range(1, 21))}


def test_logs_are_read_by_name(spark, tmp_path):
    names = list(LOG_COLUMNS)
    values = {n: str(k + 1) for k, n in enumerate(names)}
    paths = []
    for k, order in enumerate((names, names[::-1])):
        path = tmp_path / f"log{k}.csv"
        path.write_text(",".join(order) + "\n" + ",".join(values[n] for n in order) + "\n")
        paths.append(str(path))
    rows = read_logs(spark, paths).drop("source_file").collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].user_id == int(values["user_id"])


def test_no_table_of_users_is_broadcast(spark):
    """The staged groups and lists pack to a few megabytes of parquet, which Spark broadcast as millions of rows."""
    from pyspark.sql import functions as F

    from feedloom.operators.experiments import group_metrics
    from feedloom.operators.policies import only_users
    from feedloom.session import stage

    groups = stage(spark.range(40).select(F.col("id").alias("user_id"), F.lit("control").alias("group")), "groups")
    lists = stage(groups.select("user_id", F.lit(1).cast("long").alias("video_id"), F.lit(1).alias("pos"), F.lit(0.5).alias("score")), "lists")
    truth = groups.select("user_id", F.lit(1).cast("long").alias("video_id"), *[F.lit(1).alias(c) for c in ("is_pos", "is_long", "is_like", "is_click")])
    items = spark.createDataFrame([(1, "a")], "video_id long, tag string")
    counts = stage(groups.select("user_id", F.lit(1).alias("impressions")), "counts")
    for df in (only_users(lists, groups), group_metrics(lists, groups, truth, items, counts)):
        keys = [line.split("[", 1)[1] for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        assert not [k for k in keys if k.startswith("user_id")]
    got = {r.metric: r.value for r in group_metrics(lists, groups, truth, items, counts).collect()}
    assert got["users"] == 40 and got["hit_rate@10"] == 1 and got["impressions"] == 40
