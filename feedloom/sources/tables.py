"""Scans and sinks: CSV, parquet, embeddings, JSON lines and stage metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from feedloom.functions.ordering import top_per
from feedloom.sources.schemas import (
    ITEM_COLUMNS,
    ITEM_SCHEMA,
    ITEM_STAT_COLUMNS,
    ITEM_STAT_SCHEMA,
    LOG_SCHEMA,
    USER_COLUMNS,
    USER_SCHEMA,
    missing_columns,
    require_columns,
)

# ------------------------------------------------------------------- CSV


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to the declared types; text that does not parse becomes null."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.LongType):
            # '3.0' is how nullable integers are often written
            c = F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))
        elif not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def _by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Paths by their header line: one read takes all its files by one header.  A folder has one layout."""
    out: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        out.setdefault(tuple(spark.read.csv(p, header=True, inferSchema=False).columns), []).append(p)
    return out


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, table: str, source: bool = False) -> DataFrame:
    """Header CSV projected to ``schema`` by column name; extra columns are dropped.

    Several paths may order their columns differently.  Headers are read once for the column check; values
    are parsed with the declared types, so no inference pass runs over the data.  ``source`` adds the
    name of each row's file as ``source_file``.
    """
    parts = []
    for header, same in _by_header(spark, [path] if isinstance(path, str) else list(path)).items():
        require_columns(list(header), schema.fieldNames(), table)
        raw = spark.read.csv(same, header=True, inferSchema=False)
        if source:
            raw = raw.select("*", F.col("_metadata.file_name").alias("source_file"))
        fields = schema.fields + ([T.StructField("source_file", T.StringType())] if source else [])
        parts.append(_typed(raw, T.StructType(fields)))
    return reduce(DataFrame.unionByName, parts)


def read_logs(
    spark: SparkSession,
    paths: list[str],
    random_paths: list[str] | None = None,
    include_random: bool = False,
) -> DataFrame:
    """Union of the log files, each row tagged with its ``source_file``."""
    files = list(paths) + (list(random_paths or []) if include_random else [])
    if not files:
        raise ValueError("no log files configured")
    return read_csv(spark, files, LOG_SCHEMA, "log", source=True)


def read_users(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, USER_SCHEMA, "user_features")


def assert_unique(df: DataFrame, keys: list[str], table: str) -> None:
    """Raise when a key repeats; the check is one aggregation that stops at the first hit."""
    hit = df.groupBy(*keys).count().filter("count > 1").take(1)
    if hit:
        raise ValueError(f"{table} has duplicate keys {keys}: {hit[0].asDict()}")


def read_items(spark: SparkSession, basic_path: str | list[str], stat_path: str | list[str]) -> DataFrame:
    basic = read_csv(spark, basic_path, ITEM_SCHEMA, "item_basic")
    stat = read_csv(spark, stat_path, ITEM_STAT_SCHEMA, "item_stat")
    return join_item_tables(basic, stat)


def join_item_tables(basic: DataFrame, stat: DataFrame) -> DataFrame:
    """basic left join stat on video_id, one-to-one or an error."""
    require_columns(basic.columns, ITEM_COLUMNS, "item_basic")
    require_columns(stat.columns, ITEM_STAT_COLUMNS, "item_stat")
    assert_unique(basic, ["video_id"], "item_basic")
    assert_unique(stat, ["video_id"], "item_stat")
    return basic.select(*ITEM_COLUMNS).join(stat.select(*ITEM_STAT_COLUMNS), "video_id", "left")


# --------------------------------------------------------------- parquet


def write_parquet(
    df: DataFrame,
    path: str,
    compression: str = "snappy",
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> str:
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def write_user_bucketed(df: DataFrame, table: str, buckets: int = 64, key: str = "user_id") -> str:
    """Table bucketed and sorted on the user key, so later per-user stages read it without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return table


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet scan limited to the named columns."""
    df = spark.read.parquet(path)
    require_columns(df.columns, columns, path)
    return df.select(*columns)


def keep_columns(df: DataFrame, wanted: list[str], forced: list[str] | None = None) -> DataFrame:
    """The wanted columns that exist, in order, followed by forced ones not yet listed."""
    names = [c for c in dict.fromkeys(list(wanted) + list(forced or [])) if c in df.columns]
    return df.select(*names)


def existing(df: DataFrame, key: str, *groups) -> DataFrame:
    """Key plus configured columns that exist, one row per key."""
    names = [key] + [c for g in groups for c in g if c in df.columns and c != key]
    return df.select(*dict.fromkeys(names)).dropDuplicates([key])


def smoke_rows(df: DataFrame, key: list[str], n: int | None) -> DataFrame:
    """First n rows by key for a trial run; None keeps everything."""
    return df if n is None else df.orderBy(*key).limit(n)


# ------------------------------------------------------------ embeddings


def check_embeddings(df: DataFrame) -> DataFrame:
    """Validate (id, vector): unique ids, no empty vector, one dimension."""
    require_columns(df.columns, ["id", "vector"], "embeddings")
    stats = df.agg(
        F.min(F.size("vector")).alias("lo"),
        F.max(F.size("vector")).alias("hi"),
        F.count("*").alias("n"),
        F.count("id").alias("ids"),
    ).first()
    if stats["n"] and (stats["lo"] != stats["hi"] or stats["lo"] <= 0):
        raise ValueError(f"embedding rows differ in size: {stats['lo']}..{stats['hi']}")
    if stats["ids"] != stats["n"]:
        raise ValueError("embedding ids contain nulls")
    assert_unique(df, ["id"], "embeddings")
    return df


def save_embeddings(df: DataFrame, path: str) -> str:
    out = df.select(F.col("id").cast("bigint"), F.col("vector").cast("array<float>"))
    return write_parquet(check_embeddings(out), path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return check_embeddings(read_columns(spark, path, ["id", "vector"]))


# -------------------------------------------------- tolerant list artifact


def read_ranked_lists(
    spark: SparkSession,
    path: str,
    label: str,
    rank_col: str,
    score_cols: list[str],
    max_topk: int,
) -> tuple[DataFrame, dict]:
    """Per-user lists from a stage output that may be missing or unreadable.

    Returns ``(lists, status)``; an unusable file gives an empty frame and a
    status row saying why.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:
        kind = "file not found" if "PATH_NOT_FOUND" in str(exc) else "unreadable parquet"
        return empty_lists(spark), {"label": label, "path": path, "available": False, "detail": kind}
    except Exception as exc:  # a pointer or half-written file fails while the footer is read
        detail = f"unreadable parquet: {type(exc).__name__}"
        return empty_lists(spark), {"label": label, "path": path, "available": False, "detail": detail}
    lost = missing_columns(df.columns, ["user_id", "video_id", rank_col])
    if lost:
        detail = f"required columns missing: {lost}"
        return empty_lists(spark), {"label": label, "path": path, "available": False, "detail": detail}
    lists = ranked_lists(df, label, rank_col, score_cols, max_topk)
    return lists, {"label": label, "path": path, "available": True, "detail": "loaded"}


LIST_SCHEMA = "user_id bigint, video_id bigint, pos int, score double, source string, reason string"


def empty_lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LIST_SCHEMA)


def ranked_lists(df: DataFrame, label: str, rank_col: str, score_cols: list[str], max_topk: int) -> DataFrame:
    score = next((c for c in score_cols if c in df.columns), None)
    rows = df.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("video_id").cast("bigint").alias("video_id"),
        F.col(rank_col).try_cast("double").alias("_rank"),
        (F.col(score).cast("double") if score else F.lit(None).cast("double")).alias("score"),
    ).filter(F.col("_rank").isNotNull() & ~F.isnan("_rank"))
    return top_per(rows, "user_id", [F.col("_rank"), F.col("video_id")], max_topk, "pos").select(
        "user_id", "video_id", "pos", "score", F.lit(label).alias("source"), F.lit(label).alias("reason")
    )


# ------------------------------------------------------- JSON and metrics


def append_json(df: DataFrame, path: str) -> str:
    df.write.mode("append").json(path)
    return path


def read_json_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


METRIC_SCHEMA = "stage string, split string, metric string, value double"


def metric_rows(df: DataFrame, stage: str, split: str) -> DataFrame:
    """One-row wide metrics to the long (stage, split, metric, value) table."""
    names = df.columns
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return wide.unpivot([], names, "metric", "value").select(
        F.lit(stage).alias("stage"), F.lit(split).alias("split"), "metric", "value"
    )


def write_metrics(long: DataFrame, path: str) -> str:
    """Replace the (stage, split) partitions present in ``long`` and keep the others."""
    (
        long.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stage", "split")
        .json(path)
    )
    return path


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)


def pipeline_report(metrics: DataFrame) -> DataFrame:
    """Stage metrics side by side: one row per split and metric, one column per stage."""
    stages = ["recall", "prerank", "rank", "rerank"]
    return metrics.groupBy("split", "metric").pivot("stage", stages).agg(F.first("value"))
