"""Feedback events folded into bounded per-user state: batch and stream.

Every list keeps the newest ``max_history`` entries by (event time, event id) and
every counter is a sum, so the fold gives the same state in any arrival order and
can be done in parts.  The stream uses that: rows are reduced inside each Arrow
batch before the shuffle, so a user who sends a third of all events reaches the
stateful task as a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from feedloom.config import FeedbackRules
from feedloom.functions.columns import event_millis, num, stable_id, user_key
from feedloom.functions.ordering import top_per

# list name -> state column; each entry of a list is one event
LISTS = {
    "viewed": "recent_viewed",
    "positive": "recent_positive",
    "liked": "recent_liked",
    "long": "recent_long",
    "category": "recent_categories",
}
COUNTERS = ("skip_count", "like_count", "long_view_count", "feedback_count")


def normalise_feedback(events: DataFrame, items: DataFrame | None = None, rules: FeedbackRules = FeedbackRules(),
                       received_ms=None) -> DataFrame:
    """Typed events with their flags and item category.

    Works on a stream as well: the item table is joined as a static side.
    """
    now = received_ms if received_ms is not None else F.unix_millis(F.current_timestamp())
    watch, dur = num("watch_time"), num("duration")
    click, like = num("click").cast("int"), num("like").cast("int")
    is_long = (watch > 0) & (dur > 0) & (watch / F.greatest(dur, F.lit(1e-6)) >= rules.long_ratio)
    ratio = F.when(dur > 0, watch / F.greatest(dur, F.lit(1e-6))).otherwise(0.0)
    is_skip = ((click <= 0) & (watch <= 0)) | ((dur > 0) & (ratio < min(rules.skip_ratio, rules.long_ratio)))
    out = events.select(
        stable_id("user", "user_id").alias("user_id"),
        user_key("user_id").alias("user_key"),
        stable_id("video", "video_id").alias("video_id"),
        F.col("event_id").cast("bigint").alias("event_id"),
        event_millis("timestamp", now).alias("ms"),
        watch.alias("watch_time"),
        ((click > 0) | (watch > 0)).alias("viewed"),
        ((click > 0) | (like > 0) | is_long).alias("positive"),
        (like > 0).alias("liked"),
        is_long.alias("long"),
        is_skip.alias("skip"),
    )
    if items is None:
        return out.withColumn("category", F.lit(None).cast("string"))
    have = set(items.columns)
    parts = [F.col(c).cast("string") for c in ("category", "tag", "author_id") if c in have]
    side = items.select("video_id", F.coalesce(*parts).alias("category")).dropDuplicates(["video_id"])
    return out.join(side, "video_id", "left")


# ------------------------------------------------------------------- batch


def fold_feedback(events: DataFrame, rules: FeedbackRules = FeedbackRules()) -> DataFrame:
    """Final state per user from all (normalised) events."""
    flags = F.array(
        *[F.when(F.col(k), F.lit(k)) for k in ("viewed", "positive", "liked", "long")],
        F.when(F.col("category").isNotNull(), F.lit("category")),
    )
    rows = events.select(
        "user_id", "ms", "event_id", "video_id", "watch_time", "category", F.explode(F.array_compact(flags)).alias("kind")
    )
    order = [F.col("ms").desc(), F.col("event_id").desc()]
    newest = top_per(rows, ["user_id", "kind"], order, rules.max_history, "_r")
    entry = F.struct("ms", "event_id", "video_id", "watch_time", "category")
    ordered = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry)))
    lists = newest.groupBy("user_id").agg(*[ordered(k).alias(k) for k in LISTS])
    count = lambda c: F.sum(F.col(c).cast("int"))
    totals = events.groupBy("user_id").agg(
        count("skip").alias("skip_count"),
        count("liked").alias("like_count"),
        count("long").alias("long_view_count"),
        F.count("*").alias("feedback_count"),
        F.max("ms").alias("last_active_ms"),
    )
    ids = lambda k: F.transform(F.coalesce(k, F.array().cast(dict(lists.dtypes)[k])), lambda x: x["video_id"])
    return totals.join(lists, "user_id", "left").select(
        "user_id",
        ids("viewed").alias("recent_viewed"),
        ids("positive").alias("recent_positive"),
        ids("liked").alias("recent_liked"),
        ids("long").alias("recent_long"),
        F.transform("category", lambda x: x["category"]).alias("recent_categories"),
        F.transform("viewed", lambda x: x["watch_time"]).alias("recent_watch_times"),
        *COUNTERS,
        "last_active_ms",
    )


def state_features(states: DataFrame) -> DataFrame:
    """Sizes of the recent lists, mean watch time and skips."""
    times = F.coalesce("recent_watch_times", F.array().cast("array<double>"))
    total = F.aggregate(times, F.lit(0.0), lambda a, x: a + x)
    return states.select(
        "user_id",
        F.size("recent_viewed").alias("realtime_recent_view_count"),
        F.size("recent_positive").alias("realtime_recent_positive_count"),
        F.size("recent_liked").alias("realtime_recent_like_count"),
        F.size("recent_long").alias("realtime_recent_long_view_count"),
        F.when(F.size(times) > 0, total / F.size(times)).otherwise(0.0).alias("realtime_avg_watch_time"),
        F.col("skip_count").alias("realtime_skip_count"),
    )


def states_from_sequences(sequences: DataFrame) -> DataFrame:
    """Starting state of users who have batch sequences but no feedback yet."""
    none = F.array()
    return sequences.select(
        "user_id",
        F.col("watch_seq").alias("recent_viewed"),
        F.col("long_watch_seq").alias("recent_positive"),
        F.col("like_seq").alias("recent_liked"),
        F.col("long_watch_seq").alias("recent_long"),
        none.cast("array<string>").alias("recent_categories"),
        none.cast("array<double>").alias("recent_watch_times"),
        F.lit(0).cast("bigint").alias("skip_count"),
        F.size("like_seq").cast("bigint").alias("like_count"),
        F.size("long_watch_seq").cast("bigint").alias("long_view_count"),
        F.lit(0).cast("bigint").alias("feedback_count"),
        F.col("last_time_ms").alias("last_active_ms"),
    )


# ------------------------------------------------------------------ stream

_REDUCED = (
    "user_id bigint, kind string, ms bigint, event_id bigint, video_id bigint, watch_time double, "
    "category string, skips bigint, likes bigint, longs bigint, events bigint"
)
_LIST_FIELDS = {
    "viewed": ("ms", "event_id", "video_id", "watch_time"),
    "positive": ("ms", "event_id", "video_id"),
    "liked": ("ms", "event_id", "video_id"),
    "long": ("ms", "event_id", "video_id"),
    "category": ("ms", "event_id", "category"),
}
_FIELD_TYPES = {"ms": "bigint", "event_id": "bigint", "video_id": "bigint", "watch_time": "double", "category": "string"}
_STATE_FIELDS = [(f"{k}_{f}", _FIELD_TYPES[f]) for k, fs in _LIST_FIELDS.items() for f in fs]
STATE_SCHEMA = ", ".join([f"{n} array<{t}>" for n, t in _STATE_FIELDS] + [
    "skips bigint", "likes bigint", "longs bigint", "events bigint", "last_ms bigint"])
OUTPUT_SCHEMA = (
    "user_id bigint, recent_viewed array<bigint>, recent_positive array<bigint>, recent_liked array<bigint>, "
    "recent_long array<bigint>, recent_categories array<string>, recent_watch_times array<double>, "
    "skip_count bigint, like_count bigint, long_view_count bigint, feedback_count bigint, last_active_ms bigint"
)


def _reduce_batch(max_history: int):
    """Per Arrow batch: newest entries of every (user, list) plus one counter row per user."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.sort_values(["user_id", "ms", "event_id"])
            parts = []
            for kind in LISTS:
                mask = pdf["category"].notna() if kind == "category" else pdf[kind].astype(bool)
                keep = pdf[mask].groupby("user_id", sort=False).tail(max_history)
                part = keep[["user_id", "ms", "event_id", "video_id", "watch_time", "category"]].copy()
                part["kind"] = kind
                parts.append(part)
            g = pdf.groupby("user_id", sort=False)
            totals = pd.DataFrame(
                {
                    "ms": g["ms"].max(),
                    "skips": g["skip"].sum(),
                    "likes": g["liked"].sum(),
                    "longs": g["long"].sum(),
                    "events": g.size(),
                }
            ).reset_index()
            totals["kind"] = "total"
            out = pd.concat([*parts, totals], ignore_index=True)
            for c in ("skips", "likes", "longs", "events", "event_id", "video_id"):
                out[c] = out[c].astype("Int64")
            out["watch_time"] = out["watch_time"].astype(float)
            yield out[[c.split()[0] for c in _REDUCED.split(", ")]]

    return run


class FeedbackState(StatefulProcessor):
    """Bounded lists and counters of one user, with a time-to-live."""

    def __init__(self, rules: FeedbackRules):
        self.rules = rules

    def init(self, handle) -> None:
        self.state = handle.getValueState("user", STATE_SCHEMA, self.rules.state_ttl_seconds * 1000)

    def _read(self) -> dict:
        if self.state.exists():
            values = self.state.get()
            names = [n for n, _ in _STATE_FIELDS] + ["skips", "likes", "longs", "events", "last_ms"]
            return {n: (list(v) if isinstance(v, (list, tuple, np.ndarray)) else v) for n, v in zip(names, values)}
        empty = {n: [] for n, _ in _STATE_FIELDS}
        return {**empty, "skips": 0, "likes": 0, "longs": 0, "events": 0, "last_ms": 0}

    def _write(self, s: dict) -> None:
        self.state.update(tuple(s[n] for n, _ in _STATE_FIELDS) + (s["skips"], s["likes"], s["longs"], s["events"], s["last_ms"]))

    def _merge(self, s: dict, kind: str, rows: pd.DataFrame) -> None:
        fields = _LIST_FIELDS[kind]
        old = list(zip(*[s[f"{kind}_{f}"] for f in fields]))
        cast = {"bigint": int, "double": float, "string": str}
        new = [tuple(cast[_FIELD_TYPES[f]](v) for f, v in zip(fields, r)) for r in rows[list(fields)].itertuples(index=False)]
        kept = sorted(old + new, key=lambda e: (e[0], e[1]))[-self.rules.max_history :]
        for i, f in enumerate(fields):
            s[f"{kind}_{f}"] = [e[i] for e in kept]

    def handleInputRows(self, key, rows, timerValues):
        s = self._read()
        for pdf in rows:
            for kind, part in pdf.groupby("kind", sort=False):
                if kind == "total":
                    for c in ("skips", "likes", "longs", "events"):
                        s[c] += int(part[c].sum())
                    s["last_ms"] = max(s["last_ms"], int(part["ms"].max()))
                else:
                    self._merge(s, kind, part)
        self._write(s)
        yield self._output(key, s)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        s = self._read()
        row = initialState.iloc[0]
        n = self.rules.max_history
        for kind, column in LISTS.items():
            if kind == "category":
                continue
            values = row[column]
            ids = [int(v) for v in (values if values is not None else [])][-n:]
            s[f"{kind}_video_id"] = ids
            # batch sequences carry no event times: they precede every event
            s[f"{kind}_ms"] = [i - len(ids) for i in range(len(ids))]
            s[f"{kind}_event_id"] = [0] * len(ids)
        s["viewed_watch_time"] = [float("nan")] * len(s["viewed_ms"])
        s["likes"], s["longs"] = len(s["liked_ms"]), len(s["long_ms"])
        s["last_ms"] = int(row["last_active_ms"])
        self._write(s)

    def _output(self, key, s: dict) -> pd.DataFrame:
        times = [t for t in s["viewed_watch_time"] if t == t]
        return pd.DataFrame(
            {
                "user_id": [int(key[0])],
                "recent_viewed": [s["viewed_video_id"]],
                "recent_positive": [s["positive_video_id"]],
                "recent_liked": [s["liked_video_id"]],
                "recent_long": [s["long_video_id"]],
                "recent_categories": [s["category_category"]],
                "recent_watch_times": [times],
                "skip_count": [s["skips"]],
                "like_count": [s["likes"]],
                "long_view_count": [s["longs"]],
                "feedback_count": [s["events"]],
                "last_active_ms": [s["last_ms"]],
            }
        )

    def close(self) -> None:
        pass


def feedback_states(events: DataFrame, rules: FeedbackRules = FeedbackRules(), initial: DataFrame | None = None) -> DataFrame:
    """Streaming: normalised events to one updated state row per user and micro-batch.

    ``initial`` (from ``states_from_sequences``) seeds users the stream has not seen.
    """
    reduced = events.mapInPandas(_reduce_batch(rules.max_history), _REDUCED)
    return reduced.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=FeedbackState(rules),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Update",
        timeMode="ProcessingTime",
        initialState=None if initial is None else initial.groupBy("user_id"),
    )


class ExpiringFeedbackState(FeedbackState):
    """State with an event-time timer: a user without events for the time-to-live is emitted as expired and forgotten."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("user", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for out in super().handleInputRows(key, rows, timerValues):
            self.handle.registerTimer(int(out["last_active_ms"].iloc[0]) + self.rules.state_ttl_seconds * 1000)
            yield out.assign(expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            last = self._output(key, self._read())
            self.state.clear()
            yield last.assign(expired=True)


def expiring_states(events: DataFrame, rules: FeedbackRules = FeedbackRules(), late: str = "1 day") -> DataFrame:
    """Streaming: ``feedback_states`` with ``expired``; users go ``state_ttl_seconds`` after their last event.

    Time is event time: it follows the newest event less ``late``, by which events may arrive out of
    order.  A user's last row before they are forgotten carries their last state and ``expired`` true;
    the next event of such a user starts a new state.
    """
    reduced = events.mapInPandas(_reduce_batch(rules.max_history), _REDUCED)
    return (
        reduced.withColumn("ts", F.timestamp_millis("ms"))
        .withWatermark("ts", late)
        .groupBy("user_id")
        .transformWithStateInPandas(statefulProcessor=ExpiringFeedbackState(rules), outputStructType=OUTPUT_SCHEMA + ", expired boolean", outputMode="Update", timeMode="EventTime")
    )


def latest_states(history: DataFrame) -> DataFrame:
    """Newest state row per user from the written micro-batches."""
    return top_per(history, "user_id", [F.col("batch").desc()], 1, "_r").drop("_r", "batch")


def refresh_users(batch: DataFrame) -> DataFrame:
    """Users whose lists are stale after a micro-batch of feedback."""
    return batch.groupBy("user_id").agg(F.count("*").alias("events"), F.max("ms").alias("last_ms"))
