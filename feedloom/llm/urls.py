"""URL filters by temporal list join.

A list's dated entries (a key put on it or taken off it) become validity intervals per key.  Every
capture looks up its host, every domain above it and its host with every beginning of its path, as
far as the list has such keys; an as-of join keeps the entries active at the fetch time.  The most
specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import stage


def host_of(url: Column) -> Column:
    """Lower-case host: what stands after the scheme and any user, up to a port, path, query or fragment."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """``key, category, start, end`` from dated entries ``key, category, action, day``.

    ``add`` opens an interval that the key's next entry closes; the end is not part of it.  Of several
    entries of a key on one day ``remove`` wins, then the first category by name.  Rows with a null
    key or day are no entries; repeated rows count once.
    """
    known = entries.where("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "day").agg(F.max("action").alias("action"), F.min(F.when(F.col("action") == "add", F.coalesce("category", F.lit("")))).alias("category"))
    nxt = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return known.select("key", F.coalesce("category", F.lit("")).alias("category"), "action", F.col("day").alias("start"), nxt.alias("end")).where("action = 'add'").drop("action")


def lookups(captures: DataFrame, url_col: str, labels: int, depth: int) -> DataFrame:
    """The keys of each capture with their rank: longer before shorter paths, then longer before shorter domains.

    ``labels`` and ``depth``: the most labels and path parts that any key of the list has.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    names, parts = F.split("__host", r"\."), F.split("__path", "/")
    upto = lambda size, most: F.when(F.least(size, F.lit(most)) >= 1, F.sequence(F.lit(1), F.least(size, F.lit(most)))).otherwise(F.array().cast("array<int>"))
    domains = F.transform(upto(F.size(names), labels), lambda k: F.struct((F.size(names) - k + 1).alias("rank"), F.array_join(F.slice(names, F.size(names) - k + 1, k), ".").alias("key")))
    sections = F.transform(upto(F.size(parts) - 1, depth), lambda k: F.struct((-k).alias("rank"), F.concat("__host", F.lit("/"), F.array_join(F.slice(parts, 2, k), "/")).alias("key")))
    return captures.withColumns({"__host": host, "__path": path}).withColumn("__keys", F.when(F.col("__host") != "", F.concat(domains, sections)))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``page_id, url, day, host, blocked, key, category``: one row for each capture.

    A null or broken url, or a null day: not blocked, no key.  Ties: an entry's key is unique at a
    time, and keys of a capture have different ranks.  Repeated captures are judged once each.
    Distinct (url, day) pairs are looked up, so a hot page costs one row.  Empty tables: no rows, or
    nothing blocked.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("date").alias("day"))
    pairs = rows.groupBy("url", "day").agg(F.count(F.lit(1)).alias("n"))
    top = F.split("key", "/")
    deepest = entries.agg(F.max(F.size(F.split(top[0], r"\."))).alias("labels"), F.max(F.size(top) - 1).alias("depth")).first()
    keyed = lookups(pairs.select("url", "day"), "url", deepest.labels or 0, deepest.depth or 0).select("url", "day", F.explode("__keys").alias("k")).select("url", "day", "k.rank", "k.key")
    active = keyed.join(intervals(entries), "key").where((F.col("start") <= F.col("day")) & (F.col("end").isNull() | (F.col("day") < F.col("end"))))
    best = stage(active.groupBy(F.col("url").alias("u"), F.col("day").alias("d")).agg(F.min(F.struct("rank", "key", "category")).alias("hit")), "urlhits")
    found = rows.join(best, (F.col("url") == F.col("u")) & (F.col("day") == F.col("d")), "left")
    return found.select("page_id", "url", "day", host_of(F.col("url")).alias("host"), F.col("hit").isNotNull().alias("blocked"), F.col("hit.key").alias("key"), F.col("hit.category").alias("category"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The table has no fetch time: the day is derived from the page id."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', CAST(page_id % 365 AS int))").alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages' own hosts, since the tables hold none.

    With c the first six hex digits of a key's md5: hosts with c mod 3 = 0 are added on a day, taken
    off 90 days later and, if c is even, put back 60 days after that; parent domains with c mod 50 = 0
    and first path parts with c mod 11 = 0 are added for good.
    """
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("host"), F.concat(host, F.lit("/"), F.split(path_of(F.col("url")), "/")[1]).alias("section"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain")).where("host <> ''")

    def keys(name: str, cond: str) -> DataFrame:
        found = hosts.select(F.col(name).alias("key")).distinct().where("key <> ''")
        return found.withColumn("c", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")).where(cond)

    def entry(df: DataFrame, category: str, action: str, days: int) -> DataFrame:
        return df.select("key", F.lit(category).alias("category"), F.lit(action).alias("action"), F.expr(f"date_add(date'2024-01-01', CAST(c % 200 AS int) + {days})").alias("day"))

    h = keys("host", "c % 3 = 0")
    out = entry(h, "host", "add", 0).unionByName(entry(h, "host", "remove", 90)).unionByName(entry(h.where("c % 2 = 0"), "again", "add", 150))
    return out.unionByName(entry(keys("domain", "c % 50 = 0"), "domain", "add", 0)).unionByName(entry(keys("section", "c % 11 = 0"), "section", "add", 0))


SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS day,
         lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), q AS (
  SELECT *, string_split(host, '.') AS parts, CASE WHEN path <> '' THEN host || '/' || string_split(path, '/')[2] END AS section,
         regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain
  FROM p
), k AS (
  SELECT DISTINCT *, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS c
  FROM (SELECT host AS key, 'host' AS kind FROM q UNION ALL SELECT domain, 'domain' FROM q UNION ALL SELECT section, 'section' FROM q WHERE host <> '')
  WHERE key <> ''
), raw AS (
  SELECT key, kind AS category, 'add' AS action, c % 200 AS n FROM k WHERE (kind = 'host' AND c % 3 = 0) OR (kind = 'domain' AND c % 50 = 0) OR (kind = 'section' AND c % 11 = 0)
  UNION ALL SELECT key, 'host', 'remove', c % 200 + 90 FROM k WHERE kind = 'host' AND c % 3 = 0
  UNION ALL SELECT key, 'again', 'add', c % 200 + 150 FROM k WHERE kind = 'host' AND c % 6 = 0
), entries AS (
  SELECT key, n, max(action) AS action, coalesce(min(category) FILTER (WHERE action = 'add'), '') AS category FROM raw GROUP BY key, n
), intervals AS (
  SELECT * FROM (SELECT key, category, action, n, lead(n) OVER (PARTITION BY key ORDER BY n) AS until FROM entries) WHERE action = 'add'
), keyed AS (
  SELECT page_id, page_id % 365 AS n, -m AS rank, host || '/' || array_to_string(steps[2 : m + 1], '/') AS key
  FROM (SELECT *, string_split(path, '/') AS steps, unnest(range(1, len(string_split(path, '/')))) AS m FROM q WHERE host <> '')
  UNION ALL SELECT page_id, page_id % 365, len(parts) - m + 1, array_to_string(parts[len(parts) - m + 1 :], '.')
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS m FROM q WHERE host <> '')
), hits AS (
  SELECT page_id, min(ROW(rank, key, category)) AS hit FROM keyed JOIN intervals USING (key)
  WHERE keyed.n >= intervals.n AND (until IS NULL OR keyed.n < until) GROUP BY page_id
)
SELECT q.page_id, url, day, host, hit IS NOT NULL AS blocked, hit[2] AS key, hit[3] AS category FROM q LEFT JOIN hits USING (page_id)
"""
