"""Serving streams that are broken off and started again, and states that expire."""

import pytest
from pyspark.sql import functions as F

from feedloom.config import FeedbackRules
from feedloom.operators.features import user_stats
from feedloom.sources.tables import write_user_bucketed
from feedloom.streaming.feedback import expiring_states, normalise_feedback
from feedloom.streaming.jobs import run_available, use_rocksdb
from feedloom.streaming.serve import Assets, recommend_batch, serving_sink

EVENT = "event_id long, user_id string, video_id string, watch_time double, duration double, click int, like int, timestamp string"


def _assets(spark):
    popular = spark.range(1, 31).selectExpr("id AS video_id", "CAST(31 - id AS float) AS source_score", "CAST(id AS int) AS popular_rank")
    items = spark.range(1, 31).selectExpr("id AS video_id", "id % 4 AS author_id", "CAST(id % 3 AS string) AS tag", "20220501 AS upload_date")
    return Assets(items=items, popular=popular)


@pytest.mark.parametrize("rerank", [True, False])
def test_a_batch_that_broke_off_after_its_write_is_written_over(spark, tmp_path, rerank):
    options = {} if rerank else {"rerank": None}
    states = spark.createDataFrame([(u, [1, 2, u + 3]) for u in range(6)], "user_id long, recent_viewed array<long>")
    asked = spark.createDataFrame([(u, 5) for u in range(6)], "user_id long, top_k int")
    folder, out = str(tmp_path / "requests"), str(tmp_path / "served")
    for k in range(3):
        asked.where(F.col("user_id") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    broken = []

    def failing(path):
        write = serving_sink(lambda: states, _assets(spark), **options)(path)

        def once(batch, number):
            write(batch, number)
            if number == 1 and not broken:
                broken.append(number)
                raise RuntimeError("lost after the write")

        return once

    stream = lambda: spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with pytest.raises(Exception, match="lost after the write"):
        run_available(stream(), "served", "append", failing, out)
    got = run_available(stream(), "served", "append", failing, out)
    want = recommend_batch(asked, states, _assets(spark), **options)
    shape = lambda df: sorted(tuple(r) for r in df.select("user_id", "final_rank", "video_id").collect())
    assert broken and shape(got) == shape(want) and len(shape(want)) == 30


def test_inactive_users_expire_and_start_anew(spark, tmp_path):
    use_rocksdb(spark)
    day = 86_400_000
    parts = [[(1, "1", 0), (2, "1", 1000), (3, "2", 2000)], [(4, "2", 9 * day)], [(5, "1", 10 * day)]]
    src = str(tmp_path / "events")
    rules = FeedbackRules(state_ttl_seconds=7 * 86_400)
    out = str(tmp_path / "states")
    for part in parts:
        rows = [(i, u, str(i), 5.0, 10.0, 1, 0, str(1_700_000_000_000 + ms)) for i, u, ms in part]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(src)
        raw = spark.readStream.schema(EVENT).parquet(src)
        got = run_available(expiring_states(normalise_feedback(raw), rules, "1 second"), "expiry", out=out, event_time=True)
    rows = [(r.user_id, r.expired, r.feedback_count) for r in got.orderBy("batch", "expired", "user_id").collect()]
    assert (1, True, 2) in rows and rows[-1] == (1, False, 1)  # forgotten, then counted from one
    assert not any(u == 2 and gone for u, gone, _ in rows) and (2, False, 2) in rows


def test_bucketed_tables_need_no_shuffle_by_user(spark):
    rows = spark.range(500).selectExpr("id % 37 AS user_id", "id AS video_id", "1 AS is_positive", "1 AS `like`", "0 AS finish", "0 AS long_watch")
    name = write_user_bucketed(rows, "bucketed_rows", 4)
    try:
        plan = spark.table(name).groupBy("user_id").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert user_stats(spark.table(name)).count() == 37
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_queries_of_one_session_leave_the_feedback_schema_alone(spark, small):
    """Both read a log with event ids; the second failed on a column that the first had added to the shared schema."""
    from feedloom.catalog.scans import event_log
    from feedloom.catalog.serving import json_log

    replayed = {tuple(r) for r in json_log(spark, small).collect()}
    assert replayed and {tuple(r) for r in event_log(spark, small).collect()} == replayed
