"""Checks of the data stages: scans, labels, splits, sequences, popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog.inputs import events, joined, orders, rounded
from feedloom.catalog.sql import sql
from feedloom.config import LabelRules
from feedloom.functions.columns import event_millis, stable_id, user_key
from feedloom.operators.labels import add_labels, add_positive, attach_label, split_summary
from feedloom.operators.popular import linear_popular_items, popular_candidates, popular_items
from feedloom.operators.sequences import positive_sequences
from feedloom.session import stage_path
from feedloom.sources import adapters as A
from feedloom.sources.schemas import LOG_COLUMNS
from feedloom.sources.tables import metric_rows, pipeline_report, read_logs, read_metrics, smoke_rows, write_metrics

INTER = ["user_id", "video_id", "date", "hourmin", "time_ms", "is_click", "watch_ratio", "finish", "like", "long_watch",
         "is_positive", "author_id", "tag", "upload_date", "video_duration", "freshness_days"]
INTER_SQL = ('user_id, video_id, date, hourmin, time_ms, is_click, round(CAST(watch_ratio AS DOUBLE), 6) AS watch_ratio, finish, '
             '"like", long_watch, is_positive, author_id, tag, upload_date, video_duration, freshness_days')


def interactions(kind):
    def run(spark, sf):
        return rounded(kind(spark, sf).interactions.select(*INTER), "watch_ratio")

    return run


def labels_fallback(spark, sf):
    log = A.orders_log(spark, sf).drop("long_view")
    out = add_positive(add_labels(log, LabelRules()))
    return rounded(
        out.select("user_id", "video_id", "time_ms", "watch_ratio", "finish", "like", "long_watch", "is_positive"), "watch_ratio"
    )


def item_table(spark, sf):
    return orders(spark, sf).items.select("video_id", "author_id", "tag", "upload_dt", "upload_date", "video_duration")


def summary(spark, sf):
    return split_summary(orders(spark, sf).splits)


def csv_log_scan(spark, sf):
    """The order log written as two CSV files, then read back through the log scan."""
    log = A.orders_log(spark, sf)
    full = log.select(*[(F.col(c) if c in log.columns else F.lit(0)).alias(c) for c in LOG_COLUMNS], F.lit("x").alias("extra"))
    paths = []
    for label, part in (("early", full.filter("date < 19980101")), ("late", full.filter("date >= 19980101"))):
        path = stage_path(spark, f"log-{label}")
        part.write.csv(path, header=True)
        paths.append(path)
    back = read_logs(spark, paths)
    return back.groupBy("date").agg(
        F.count("*").alias("n"),
        F.countDistinct("user_id").alias("users"),
        F.sum("play_time_ms").alias("play_ms"),
        F.sum("is_like").alias("likes"),
        F.sum("tab").alias("tab"),
    )


def sequences(kind):
    def run(spark, sf):
        s = kind(spark, sf).sequences
        return s.select("user_id", joined("watch_seq"), joined("like_seq"), joined("long_watch_seq"), "history_len", "last_time_ms")

    return run


def positives(kind):
    def run(spark, sf):
        return positive_sequences(kind(spark, sf).train).select("user_id", joined("seq"))

    return run


POP = ["video_id", "exposure_count", "play_count", "like_count", "long_watch_count", "finish_count", "unique_user_count",
       "last_time_ms", "source_score", "popular_rank"]


def popular(kind):
    def run(spark, sf):
        return rounded(popular_items(kind(spark, sf).train).select(*POP), "source_score", digits=4)

    return run


def popular_lists(kind):
    def run(spark, sf):
        x = kind(spark, sf).staged()
        out = popular_candidates(x.test.select("user_id"), popular_items(x.train), 300, x.train)
        return rounded(out, "source_score", digits=4)

    return run


def linear_popular(spark, sf):
    return orders(spark, sf).train.transform(linear_popular_items)


def labelled_candidates(spark, sf):
    x = events(spark, sf)
    cand = popular_candidates(x.test.select("user_id"), popular_items(x.train), 300, x.train)
    return attach_label(cand, x.test).select("user_id", "video_id", "source_rank", "label")


def metric_sink(spark, sf):
    """Split sizes written as stage metrics, one stage overwritten, then read back as a report."""
    s = split_summary(orders(spark, sf).splits)
    path = stage_path(spark, "metrics")
    for stage, factor in (("recall", 1), ("rank", 1), ("rank", 2)):
        for split in ("train", "val", "test"):
            row = s.filter(F.col("split") == split).select((F.col("rows") * factor).alias("rows"), (F.col("users") * factor).alias("users"))
            write_metrics(metric_rows(row, stage, split), path)
    return pipeline_report(read_metrics(spark, path)).select("split", "metric", "recall", "rank")


def identity_keys(spark, sf):
    """Ids and event times of the event log in the spellings clients send."""
    ev = A.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("guest-"), F.col("user_id").cast("string"))).otherwise(
        F.col("user_id").cast("string")
    )
    ms = A.wall_millis(F.col("ts"))
    wall = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("event_type") == "view", F.concat(wall, F.lit("Z")))
        .when(F.col("event_type") == "click", wall)
        .when(F.col("event_type") == "error", F.lit("not a time"))
        .when(F.col("event_type") == "signup", F.floor(ms / 1000).cast("string"))
        .otherwise(ms.cast("string"))
    )
    return ev.select(
        "event_id",
        stable_id("user", raw).alias("internal_id"),
        user_key(raw).alias("user_key"),
        event_millis(text, F.lit(42)).alias("event_ms"),
    )


def first_rows(spark, sf):
    """Row-limited read by key, as trial runs use it (a sampling feature, not a check shortcut)."""
    return smoke_rows(A.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000)


QUERIES = {
    "interactions_orders": interactions(orders),
    "interactions_events": interactions(events),
    "labels_fallback": labels_fallback,
    "item_table": item_table,
    "split_summary": summary,
    "csv_log_scan": csv_log_scan,
    "user_sequences": sequences(orders),
    "user_sequences_events": sequences(events),
    "positive_sequences": positives(orders),
    "positive_sequences_events": positives(events),
    "popular_items": popular(orders),
    "popular_items_events": popular(events),
    "popular_candidates": popular_lists(orders),
    "popular_candidates_events": popular_lists(events),
    "linear_popular": linear_popular,
    "labelled_candidates": labelled_candidates,
    "metric_sink": metric_sink,
    "identity_keys": identity_keys,
    "first_rows": first_rows,
}


def _seq_sql(s: str) -> str:
    lst = lambda t: f"(SELECT user_id, string_agg(CAST(video_id AS VARCHAR), ',' ORDER BY back DESC) AS q FROM {t}_rows_{s} GROUP BY 1)"
    return sql(
        f"""
SELECT h.user_id, w.q AS watch_seq, coalesce(l.q, '') AS like_seq, coalesce(g.q, '') AS long_watch_seq, h.history_len, h.last_time_ms
FROM (SELECT user_id, count(*) AS history_len, max(time_ms) AS last_time_ms FROM train_{s} GROUP BY 1) h
LEFT JOIN {lst('watch')} w ON h.user_id = w.user_id
LEFT JOIN {lst('like')} l ON h.user_id = l.user_id
LEFT JOIN {lst('long')} g ON h.user_id = g.user_id""",
        f"train_{s}",
        f"watch_rows_{s}",
        f"like_rows_{s}",
        f"long_rows_{s}",
    )


def _pos_sql(s: str) -> str:
    return sql(
        f"SELECT user_id, string_agg(CAST(video_id AS VARCHAR), ',' ORDER BY i) AS seq FROM pos_seq_{s} GROUP BY 1", f"pos_seq_{s}"
    )


def _popular_sql(s: str) -> str:
    cols = ", ".join(c for c in POP if c != "source_score")
    return sql(f"SELECT {cols}, round(CAST(source_score AS DOUBLE), 4) AS source_score FROM popular_{s}", f"popular_{s}")


def _popular_cand_sql(s: str) -> str:
    return sql(
        f"SELECT user_id, video_id, recall_source, round(source_score, 4) AS source_score, source_rank FROM pop_cand_test_{s}",
        f"pop_cand_test_{s}",
    )


_MD5 = "CAST(('0x' || substr(md5('user:' || raw), 1, 12)) AS UBIGINT)"

ORACLES = {
    "interactions_orders": sql(f"SELECT {INTER_SQL} FROM inter_o", "inter_o"),
    "interactions_events": sql(f"SELECT {INTER_SQL} FROM inter_e", "inter_e"),
    "labels_fallback": sql(
        'SELECT user_id, video_id, time_ms, round(CAST(watch_ratio AS DOUBLE), 6) AS watch_ratio, finish, "like", long_watch, is_positive '
        "FROM lab_fallback_o",
        "lab_fallback_o",
    ),
    "item_table": sql("SELECT video_id, author_id, tag, upload_dt, upload_date, video_duration FROM items_o", "items_o"),
    "split_summary": sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS split, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT video_id) AS items, "
            f"min(date) AS first_date, max(date) AS last_date FROM {n}_o"
            for n in ("train", "val", "test")
        ),
        "train_o",
        "val_o",
        "test_o",
    ),
    "csv_log_scan": sql(
        "SELECT CAST(date AS BIGINT) AS date, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(play_time_ms) AS BIGINT) AS play_ms, "
        "CAST(sum(is_like) AS BIGINT) AS likes, CAST(0 AS BIGINT) AS tab FROM log_o GROUP BY 1",
        "log_o",
    ),
    "user_sequences": _seq_sql("o"),
    "user_sequences_events": _seq_sql("e"),
    "positive_sequences": _pos_sql("o"),
    "positive_sequences_events": _pos_sql("e"),
    "popular_items": _popular_sql("o"),
    "popular_items_events": _popular_sql("e"),
    "popular_candidates": _popular_cand_sql("o"),
    "popular_candidates_events": _popular_cand_sql("e"),
    "linear_popular": sql(
        'SELECT video_id, CAST(sum(is_click) + 6.0 * sum("like") + 3.0 * sum(long_watch) + 2.0 * sum(finish) AS DOUBLE) AS source_score '
        "FROM train_o GROUP BY 1",
        "train_o",
    ),
    "labelled_candidates": sql(
        "SELECT c.user_id, c.video_id, c.source_rank, CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END AS label FROM pop_cand_test_e c "
        "LEFT JOIN pairs_test_e p ON c.user_id = p.user_id AND c.video_id = p.video_id",
        "pop_cand_test_e",
        "pairs_test_e",
    ),
    "metric_sink": sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS split, '{m}' AS metric, CAST({e} AS DOUBLE) AS recall, CAST(2 * {e} AS DOUBLE) AS rank FROM {n}_o"
            for n in ("train", "val", "test")
            for m, e in (("rows", "count(*)"), ("users", "count(DISTINCT user_id)"))
        ),
        "train_o",
        "val_o",
        "test_o",
    ),
    "identity_keys": f"""
SELECT event_id, CASE WHEN event_type = 'view' THEN CAST({_MD5} % 1000000000 AS BIGINT) + 1000000000 ELSE user_id END AS internal_id,
  CASE WHEN event_type = 'view' THEN 'anon:' || raw ELSE raw END AS user_key,
  CAST(CASE WHEN event_type IN ('view', 'click', 'signup') THEN floor(ms / 1000) * 1000 WHEN event_type = 'error' THEN 42 ELSE ms END AS BIGINT) AS event_ms
FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'guest-' || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS raw,
  floor(epoch_us(ts) / 1000) AS ms FROM events)""",
    "first_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000",
}
