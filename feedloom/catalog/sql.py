"""Shared pieces of the check SQL: named CTEs that queries pull in by name."""

from __future__ import annotations


def fixed(expr: str, scale: str = "1e9") -> str:
    """Order-independent sum: rounded terms added as integers."""
    return f"(CAST(sum(CAST(round(({expr}) * {scale}) AS BIGINT)) AS DOUBLE) / {scale})"


def md5_fraction(text: str, start: int = 1, digits: int = 16) -> str:
    return f"(CAST(CAST(('0x' || substr(md5({text}), {start}, {digits})) AS UBIGINT) AS DOUBLE) / {float(16 ** digits)!r})"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body.strip())


def sql(body: str, *needs: str) -> str:
    """SELECT with exactly the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return (f"WITH {head}\n" if head else "") + body.strip()


# ----------------------------------------------------------- orders, events

cte(
    "log_o",
    (),
    """
SELECT o_custkey AS user_id, l_partkey AS video_id,
  CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date, 0 AS hourmin,
  CAST(epoch_ms(o_orderdate) AS BIGINT) AS time_ms,
  CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS is_click,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_like,
  CASE WHEN l_quantity >= 35 THEN 1 ELSE 0 END AS long_view,
  CAST(l_quantity * 1000 AS BIGINT) AS play_time_ms, CAST(50000 AS BIGINT) AS duration_ms
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
cte(
    "items_o",
    (),
    """
SELECT p_partkey AS video_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS author_id, p_type AS tag,
  strftime(first_ship, '%Y-%m-%d') AS upload_dt,
  CAST(strftime(first_ship, '%Y%m%d') AS INTEGER) AS upload_date,
  CAST(first_ship AS DATE) AS upload_day,
  CAST(p_size AS DOUBLE) AS video_duration
FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""",
)
cte(
    "log_e",
    (),
    """
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS video_id,
  CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date, CAST(strftime(ts, '%H%M') AS INTEGER) AS hourmin,
  CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS time_ms,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_like,
  CASE WHEN value >= 42 THEN 1 ELSE 0 END AS long_view,
  CAST(round(value * 1000) AS BIGINT) AS play_time_ms, CAST(60000 AS BIGINT) AS duration_ms
FROM events""",
)
cte(
    "items_e",
    (),
    """
SELECT DISTINCT k AS video_id, k % 10 AS author_id, 't' || CAST(k % 7 AS VARCHAR) AS tag,
  CAST(NULL AS VARCHAR) AS upload_dt, CAST(NULL AS INTEGER) AS upload_date, CAST(NULL AS DATE) AS upload_day,
  CAST(60.0 AS DOUBLE) AS video_duration
FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)

_LABELLED = """
SELECT *, CASE WHEN long_watch > 0 OR finish > 0 OR "like" > 0 THEN 1 ELSE 0 END AS is_positive FROM (
  SELECT *, CASE WHEN watch_ratio >= CAST(0.95 AS FLOAT) THEN 1 ELSE 0 END AS finish,
    is_like AS "like", CASE WHEN {long} THEN 1 ELSE 0 END AS long_watch
  FROM (SELECT *, CAST(least(CASE WHEN duration_ms > 0 THEN greatest(play_time_ms, 0) / CAST(duration_ms AS DOUBLE)
          ELSE 0 END, 5.0) AS FLOAT) AS watch_ratio FROM {log}))"""

for s in ("o", "e"):
    cte(f"lab_{s}", (f"log_{s}",), _LABELLED.format(log=f"log_{s}", long="long_view > 0"))
    cte(
        f"inter_{s}",
        (f"lab_{s}", f"items_{s}"),
        f"""
SELECT l.*, coalesce(i.author_id, -1) AS author_id, coalesce(i.tag, 'unknown') AS tag, i.upload_date,
  i.video_duration,
  CASE WHEN i.upload_day IS NOT NULL THEN
    greatest(date_diff('day', i.upload_day, CAST(strptime(CAST(l.date AS VARCHAR), '%Y%m%d') AS DATE)), 0) END AS freshness_days
FROM lab_{s} l LEFT JOIN items_{s} i ON l.video_id = i.video_id""",
    )
cte("lab_fallback_o", ("log_o",), _LABELLED.format(
    log="log_o", long="watch_ratio >= CAST(0.70 AS FLOAT) OR greatest(play_time_ms, 0) >= 18000"))

_BOUNDS = {"o": (19991231, 20000101, 20001231, 20010101), "e": (20240120, 20240121, 20240125, 20240126)}
for s, (a, b, c, d) in _BOUNDS.items():
    cte(f"train_{s}", (f"inter_{s}",), f"SELECT * FROM inter_{s} WHERE date <= {a}")
    cte(f"val_{s}", (f"inter_{s}",), f"SELECT * FROM inter_{s} WHERE date BETWEEN {b} AND {c}")
    cte(f"test_{s}", (f"inter_{s}",), f"SELECT * FROM inter_{s} WHERE date >= {d}")
    for split in ("train", "val", "test"):
        cte(f"pairs_{split}_{s}", (f"{split}_{s}",), f"SELECT DISTINCT user_id, video_id FROM {split}_{s} WHERE is_positive > 0")
        cte(f"users_{split}_{s}", (f"{split}_{s}",), f"SELECT DISTINCT user_id FROM {split}_{s}")

    # behaviour sequences: place 0 is the newest
    for name, cond in (("watch", "TRUE"), ("like", '"like" > 0'), ("long", "long_watch > 0")):
        cte(
            f"{name}_rows_{s}",
            (f"train_{s}",),
            f"""
SELECT user_id, video_id, time_ms, rn - 1 AS back FROM (
  SELECT user_id, video_id, time_ms,
    row_number() OVER (PARTITION BY user_id ORDER BY time_ms DESC, video_id DESC) AS rn
  FROM train_{s} WHERE {cond}) WHERE rn <= 50""",
        )
    cte(
        f"seen_{s}", (f"watch_rows_{s}",), f"SELECT DISTINCT user_id, video_id FROM watch_rows_{s}"
    )
    cte(
        f"pos_rows_{s}",
        (f"train_{s}",),
        f"""
SELECT user_id, video_id, min(100 - rn) AS p FROM (
  SELECT user_id, video_id, row_number() OVER (PARTITION BY user_id ORDER BY time_ms DESC, video_id DESC) AS rn
  FROM train_{s} WHERE is_positive > 0) WHERE rn <= 100 GROUP BY 1, 2""",
    )
    cte(
        f"pos_seq_{s}",
        (f"pos_rows_{s}",),
        f"""
SELECT user_id, video_id, row_number() OVER (PARTITION BY user_id ORDER BY p) - 1 AS i,
  count(*) OVER (PARTITION BY user_id) AS n FROM pos_rows_{s}""",
    )
    # popularity
    cte(
        f"pop_counts_{s}",
        (f"train_{s}",),
        f"""
SELECT video_id, count(*) AS exposure_count, CAST(sum(CASE WHEN play_time_ms > 0 THEN 1 ELSE 0 END) AS BIGINT) AS play_count,
  CAST(sum("like") AS BIGINT) AS like_count, CAST(sum(long_watch) AS BIGINT) AS long_watch_count,
  CAST(sum(finish) AS BIGINT) AS finish_count, count(DISTINCT user_id) AS unique_user_count, max(time_ms) AS last_time_ms
FROM train_{s} GROUP BY 1""",
    )
    cte(
        f"popular_{s}",
        (f"pop_counts_{s}",),
        f"""
SELECT *, row_number() OVER (ORDER BY source_score DESC, long_watch_count DESC, like_count DESC, play_count DESC, video_id) AS popular_rank
FROM (SELECT *, CAST(1.0 * ln(2.0 + play_count) + 6.0 * ln(2.0 + like_count) + 3.0 * ln(2.0 + long_watch_count)
  + 2.0 * ln(2.0 + finish_count) + 0.05 * ln(1.0 + exposure_count) AS FLOAT) AS source_score FROM pop_counts_{s})
ORDER BY popular_rank LIMIT 300""",
    )
    for split in ("val", "test"):
        cte(
            f"pop_cand_{split}_{s}",
            (f"popular_{s}", f"train_{s}", f"users_{split}_{s}"),
            f"""
SELECT user_id, video_id, 'popular' AS recall_source, CAST(source_score AS DOUBLE) AS source_score, popular_rank AS source_rank
FROM (SELECT u.user_id, p.*, row_number() OVER (PARTITION BY u.user_id ORDER BY popular_rank) AS rn
  FROM users_{split}_{s} u CROSS JOIN popular_{s} p
  WHERE NOT EXISTS (SELECT 1 FROM train_{s} t WHERE t.user_id = u.user_id AND t.video_id = p.video_id))
WHERE rn <= 300""",
        )
