"""Checks of feedback state, request monitoring and micro-batch serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog.inputs import events, joined, orders, rounded
from feedloom.catalog.recall import CELLS
from feedloom.catalog.sql import cte, sql
from feedloom.config import FeedbackRules
from feedloom.operators.monitoring import latency_summary, request_counters, windowed_requests
from feedloom.operators.popular import popular_items
from feedloom.operators.sequences import positive_sequences
from feedloom.operators.vector_search import recency_profiles
from feedloom.session import stage, stage_path
from feedloom.sources import adapters as A
from feedloom.sources.schemas import LOGGED_FEEDBACK_SCHEMA
from feedloom.sources.tables import append_json
from feedloom.streaming.feedback import (
    expiring_states,
    feedback_states,
    fold_feedback,
    latest_states,
    normalise_feedback,
    refresh_users,
    state_features,
    states_from_sequences,
)
from feedloom.streaming.jobs import read_parquet_stream, run_available, use_rocksdb, windowed_stream
from feedloom.streaming.serve import Assets, newest_lists, recommend_batch, refreshing_sink, serving_sink

STATE = ["user_id", "recent_viewed", "recent_positive", "recent_liked", "recent_long", "recent_categories", "skip_count", "like_count",
         "long_view_count", "feedback_count", "last_active_ms"]


def _shape(states):
    out = states.select(*STATE)
    for c in STATE[1:6]:
        out = out.withColumn(c, joined(c))
    return out.join(rounded(state_features(states).select("user_id", "realtime_avg_watch_time"), "realtime_avg_watch_time", digits=5), "user_id")


def _batch_events(spark, sf):
    return normalise_feedback(A.events_feedback(spark, sf), A.events_items(spark, sf))


def state_batch(spark, sf):
    return _shape(fold_feedback(_batch_events(spark, sf)))


def enriched(spark, sf):
    out = _batch_events(spark, sf)
    flags = {c: F.col(c).cast("int") for c in ("viewed", "positive", "liked", "long", "skip")}
    return out.withColumns(flags).select("event_id", "user_id", "video_id", "ms", "viewed", "positive", "liked", "long", "skip", "category")


def state_stream(spark, sf):
    """The event table read as a stream through the stateful operator."""
    use_rocksdb(spark)
    raw = read_parquet_stream(spark, sf, "events").select(*A.feedback_columns())
    ev = normalise_feedback(raw, stage(A.events_items(spark, sf), "items"))
    history = run_available(feedback_states(ev), "feedback")
    return _shape(latest_states(history))


def state_stream_seeded(spark, sf):
    """Test-period feedback on top of states built from the train sequences."""
    use_rocksdb(spark)
    x = events(spark, sf).staged()
    raw = read_parquet_stream(spark, sf, "events").filter("ts >= timestamp_ntz'2024-01-26 00:00:00'").select(*A.feedback_columns())
    seed = stage(states_from_sequences(x.sequences), "seed")
    ev = normalise_feedback(raw, stage(x.items, "items"))
    states = latest_states(run_available(feedback_states(ev, initial=seed), "seeded"))
    return states.select("user_id", joined("recent_viewed"), "feedback_count", "like_count", "skip_count", "last_active_ms")


def json_log(spark, sf):
    """Feedback appended as JSON lines in two parts, replayed as a stream, folded."""
    ev = A.events_feedback(spark, sf)
    path = stage_path(spark, "feedback-log")
    append_json(ev.filter("event_id % 2 = 0"), path)
    append_json(ev.filter("event_id % 2 = 1"), path)
    raw = spark.readStream.schema(LOGGED_FEEDBACK_SCHEMA).json(path)
    use_rocksdb(spark)
    states = latest_states(run_available(feedback_states(normalise_feedback(raw)), "replay"))
    return states.select("user_id", joined("recent_viewed"), "feedback_count", "skip_count")


def stale_users(spark, sf):
    return refresh_users(_batch_events(spark, sf))


def counters(spark, sf):
    return rounded(request_counters(A.events_requests(spark, sf)), "cache_hit_rate")


def latencies(spark, sf):
    return rounded(latency_summary(A.events_requests(spark, sf)), "mean", "p50", "p95", "p99", digits=4)


WINDOW = ["window_start", "event", "requests", "cache_hits", "degraded", "latency_sum", "latency_max"]


def _window_shape(df):
    out = rounded(df, "latency_sum", "latency_max", digits=4)
    return out.withColumn("window_start", F.unix_seconds(F.col("window_start").cast("timestamp"))).select(*WINDOW)


def windows(spark, sf):
    return _window_shape(windowed_requests(A.events_requests(spark, sf), "1 hour"))


def windows_stream(spark, sf):
    """The same windows from a stream with a watermark; the newest update of a window counts."""
    raw = read_parquet_stream(spark, sf, "events").select(*A.request_columns())
    history = run_available(windowed_stream(raw, "1 hour"), "windows")
    last = history.groupBy("window_start", "event").agg(F.max_by(F.struct(*WINDOW[2:]), "batch").alias("x"))
    return _window_shape(last.select("window_start", "event", "x.*"))


def serve(spark, sf):
    """Every user of the event log asks for a list, with the state their feedback left."""
    x = events(spark, sf).staged()
    ev = _batch_events(spark, sf)
    states = stage(fold_feedback(ev), "states")
    prof = stage(recency_profiles(positive_sequences(x.train), x.item_vectors), "profiles")
    assets = Assets(items=A.vector_items(spark, sf), popular=popular_items(x.train), item_vectors=x.all_vectors, user_vectors=prof)
    requests = ev.groupBy("user_id").agg(F.lit(10).alias("top_k"))
    out = recommend_batch(requests, states, assets, vectors=CELLS)
    return rounded(out.select("user_id", "video_id", "final_rank", "rerank_score"), "rerank_score", digits=4)


def serve_popular(spark, sf):
    """No vectors at hand: the popular fallback, recent views removed."""
    x = events(spark, sf).staged()
    ev = _batch_events(spark, sf)
    states = stage(fold_feedback(ev), "states")
    requests = ev.groupBy("user_id").agg(F.lit(10).alias("top_k"))
    out = recommend_batch(requests, states, Assets(items=x.items, popular=popular_items(x.train)))
    return rounded(out.select("user_id", "video_id", "final_rank", "rerank_score"), "rerank_score", digits=4)


def _shown(lists):
    return rounded(lists.select("user_id", "video_id", "final_rank", "rerank_score"), "rerank_score", digits=4)


def _popular_assets(x):
    return Assets(items=x.items, popular=stage(popular_items(x.train), "popular"))


def served_stream(spark, sf):
    """Requests of all users as a stream that stops and is started again, joined with the stored feedback states."""
    x = events(spark, sf).staged()
    states = stage(fold_feedback(_batch_events(spark, sf)), "states")
    folder, out = stage_path(spark, "requests"), stage_path(spark, "served")
    asked = states.select("user_id", F.lit(10).alias("top_k"))
    sink = serving_sink(lambda: states, _popular_assets(x), rerank=None)
    for part in range(2):  # the second run goes on where the first has stopped
        asked.where(F.pmod(F.xxhash64("user_id"), F.lit(2)) == part).repartition(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        lists = run_available(stream, "served", "append", sink, out)
    return _shown(lists)


def refreshed_stream(spark, sf):
    """Lists that follow the change feed of the feedback stream: the newest of each user."""
    use_rocksdb(spark)
    x = events(spark, sf).staged()
    raw = read_parquet_stream(spark, sf, "events").select(*A.feedback_columns())
    feed = feedback_states(normalise_feedback(raw, stage(x.items, "items")))
    return _shown(newest_lists(run_available(feed, "refreshed", sink=refreshing_sink(_popular_assets(x), 10, rerank=None))))


SHORT_LIFE = FeedbackRules(state_ttl_seconds=43_200)


def expired_users(spark, sf):
    """Users without feedback for half a day before the last event: emitted by their timers."""
    use_rocksdb(spark)
    raw = read_parquet_stream(spark, sf, "events").select(*A.feedback_columns())
    feed = expiring_states(normalise_feedback(raw), SHORT_LIFE, "1 second")
    gone = run_available(feed, "expiry", event_time=True).where("expired")
    return gone.select("user_id", joined("recent_viewed"), "feedback_count", "last_active_ms")


QUERIES = {
    "serve_stream_restarted": served_stream,
    "refresh_lists_stream": refreshed_stream,
    "feedback_expiry_stream": expired_users,
    "feedback_events": enriched,
    "feedback_state": state_batch,
    "feedback_state_stream": state_stream,
    "feedback_state_seeded": state_stream_seeded,
    "feedback_json_replay": json_log,
    "refresh_users": stale_users,
    "request_counters": counters,
    "request_latency": latencies,
    "request_windows": windows,
    "request_windows_stream": windows_stream,
    "serve_batch": serve,
    "serve_popular_fallback": serve_popular,
}

cte(
    "fb",
    (),
    """
SELECT *, (click > 0 OR w > 0) AS viewed, (click > 0 OR lk > 0 OR lg) AS positive, lk > 0 AS liked,
  ((click <= 0 AND w <= 0) OR w / 60.0 < 0.2) AS skip FROM (
SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS video_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS w, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS click,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS lk,
  (CASE WHEN event_type = 'error' THEN 0.0 ELSE value END > 0 AND CASE WHEN event_type = 'error' THEN 0.0 ELSE value END / 60.0 >= 0.7) AS lg FROM events)""",
)


def _last(cond: str, value: str) -> str:
    return f"""(SELECT user_id, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY ms, event_id) AS q, avg(w) AS aw FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS r FROM fb WHERE {cond}) WHERE r <= 50 GROUP BY 1)"""


_STATE_SQL = sql(
    f"""
SELECT t.*, coalesce(v.q, '') AS recent_viewed, coalesce(p.q, '') AS recent_positive, coalesce(l.q, '') AS recent_liked, coalesce(g.q, '') AS recent_long,
  coalesce(c.q, '') AS recent_categories, round(coalesce(v.aw, 0), 5) AS realtime_avg_watch_time
FROM (SELECT user_id, CAST(sum(CASE WHEN skip THEN 1 ELSE 0 END) AS BIGINT) AS skip_count, CAST(sum(lk) AS BIGINT) AS like_count,
  CAST(sum(CASE WHEN lg THEN 1 ELSE 0 END) AS BIGINT) AS long_view_count, count(*) AS feedback_count, max(ms) AS last_active_ms FROM fb GROUP BY 1) t
LEFT JOIN {_last('viewed', 'video_id')} v ON t.user_id = v.user_id LEFT JOIN {_last('positive', 'video_id')} p ON t.user_id = p.user_id
LEFT JOIN {_last('liked', 'video_id')} l ON t.user_id = l.user_id LEFT JOIN {_last('lg', 'video_id')} g ON t.user_id = g.user_id
LEFT JOIN {_last('TRUE', "'t' || CAST(video_id % 7 AS VARCHAR)")} c ON t.user_id = c.user_id""",
    "fb",
)

cte(
    "req",
    (),
    """
SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('click', 'purchase') THEN 'feedback' WHEN event_type = 'signup' THEN 'health'
  ELSE 'recommend' END AS event, k % 20 AS returned_items, k % 5 = 0 AS hit, k % 7 = 0 AS degraded, value AS v
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
_WINDOW_SQL = sql(
    """
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, event, count(*) AS requests,
  CAST(sum(CASE WHEN event = 'recommend' AND hit THEN 1 ELSE 0 END) AS BIGINT) AS cache_hits, CAST(sum(CASE WHEN degraded THEN 1 ELSE 0 END) AS BIGINT) AS degraded,
  round(sum(v * 10), 4) AS latency_sum, round(max(v * 10), 4) AS latency_max FROM req GROUP BY 1, 2""",
    "req",
)

# the popular fallback: unseen among the newest 50 views, best score first
_SERVED_SQL = sql(
    """
SELECT user_id, video_id, final_rank, round(CAST(source_score AS DOUBLE), 4) + 0.0 AS rerank_score FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_score DESC, video_id) AS final_rank FROM (
SELECT u.user_id, p.video_id, p.source_score FROM (SELECT DISTINCT user_id FROM fb) u CROSS JOIN (SELECT * FROM popular_e ORDER BY popular_rank LIMIT 200) p
WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, video_id, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS r FROM fb WHERE viewed) v
  WHERE v.r <= 50 AND v.user_id = u.user_id AND v.video_id = p.video_id))) WHERE final_rank <= 10""",
    "fb",
    "popular_e",
)

ORACLES = {
    "serve_stream_restarted": _SERVED_SQL,
    "refresh_lists_stream": _SERVED_SQL,
    "feedback_expiry_stream": sql(
        f"""
SELECT t.user_id, coalesce(v.q, '') AS recent_viewed, t.feedback_count, t.last_active_ms FROM (SELECT user_id, count(*) AS feedback_count, max(ms) AS last_active_ms FROM fb GROUP BY 1) t
LEFT JOIN {_last('viewed', 'video_id')} v ON t.user_id = v.user_id WHERE t.last_active_ms + 43200000 <= (SELECT max(ms) FROM fb) - 1000""",
        "fb",
    ),
    "feedback_events": sql(
        """
SELECT event_id, user_id, video_id, ms, CAST(viewed AS INTEGER) AS viewed, CAST(positive AS INTEGER) AS positive, CAST(liked AS INTEGER) AS liked,
  CAST(lg AS INTEGER) AS long, CAST(skip AS INTEGER) AS skip, 't' || CAST(video_id % 7 AS VARCHAR) AS category FROM fb""",
        "fb",
    ),
    "feedback_state": _STATE_SQL,
    "feedback_state_stream": _STATE_SQL,
    "feedback_state_seeded": sql(
        """
SELECT t.user_id, q AS recent_viewed, t.feedback_count, t.lk + coalesce(l.n, 0) AS like_count, t.skip_count, t.last_active_ms
FROM (SELECT user_id, count(*) AS feedback_count, CAST(sum(lk) AS BIGINT) AS lk, CAST(sum(CASE WHEN skip THEN 1 ELSE 0 END) AS BIGINT) AS skip_count, max(ms) AS last_active_ms
  FROM fb WHERE ms >= 1706227200000 GROUP BY 1) t
LEFT JOIN (SELECT user_id, count(*) AS n FROM like_rows_e GROUP BY 1) l ON t.user_id = l.user_id
JOIN (SELECT user_id, string_agg(CAST(video_id AS VARCHAR), ',' ORDER BY o DESC) AS q FROM (
  SELECT user_id, video_id, row_number() OVER (PARTITION BY user_id ORDER BY late DESC, ms DESC, event_id DESC) AS o FROM (
    SELECT user_id, video_id, 1 AS late, ms, event_id FROM fb WHERE viewed AND ms >= 1706227200000
    UNION ALL SELECT user_id, video_id, 0, -back, 0 FROM watch_rows_e)) WHERE o <= 50 GROUP BY 1) v ON t.user_id = v.user_id""",
        "fb",
        "like_rows_e",
        "watch_rows_e",
    ),
    "feedback_json_replay": sql(
        f"""
SELECT t.user_id, coalesce(q, '') AS recent_viewed, feedback_count, skip_count FROM (SELECT user_id, count(*) AS feedback_count,
CAST(sum(CASE WHEN skip THEN 1 ELSE 0 END) AS BIGINT) AS skip_count FROM fb GROUP BY 1) t LEFT JOIN {_last('viewed', 'video_id')} v ON t.user_id = v.user_id""",
        "fb",
    ),
    "refresh_users": sql("SELECT user_id, count(*) AS events, max(ms) AS last_ms FROM fb GROUP BY 1", "fb"),
    "request_counters": sql(
        """
SELECT count(*) AS request_count, count(*) FILTER (event = 'recommend') AS recommend_request_count, count(*) FILTER (event = 'feedback') AS feedback_request_count,
  count(*) FILTER (event = 'health') AS health_request_count, count(*) FILTER (event = 'error') AS error_count,
  count(*) FILTER (event = 'recommend' AND degraded) AS degraded_mode_count, count(*) FILTER (event = 'recommend' AND hit) AS cache_hit_count,
  round(count(*) FILTER (event = 'recommend' AND hit) / CAST(count(*) FILTER (event = 'recommend') AS DOUBLE), 6) AS cache_hit_rate,
  CAST(sum(returned_items) FILTER (event = 'recommend') AS BIGINT) AS recommended_items_count FROM req""",
        "req",
    ),
    "request_latency": sql(
        " UNION ALL ".join(
            f"SELECT '{s}' AS series, count(*) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.95), 4) AS p95, "
            f"round(quantile_cont(x, 0.99), 4) AS p99 FROM (SELECT v * {f} AS x FROM req WHERE event = 'recommend' ORDER BY ts DESC, event_id DESC LIMIT 5000)"
            for s, f in (("total", 10), ("recall", 1), ("prerank", 4), ("rank", 3), ("rerank", 2))
        ),
        "req",
    ),
    "request_windows": _WINDOW_SQL,
    "request_windows_stream": _WINDOW_SQL,
}
