"""Adapter tables as the queries use them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.labels import split_by_date
from feedloom.operators.sequences import user_sequences
from feedloom.session import stage
from feedloom.sources import adapters as A


@dataclass
class Inputs:
    """One adapter (``orders`` or ``events``) over one data folder; every table is lazy."""

    spark: SparkSession
    sf_dir: str
    kind: str
    kept: dict[str, DataFrame] = field(default_factory=dict)  # stages that several steps of a query read

    @cached_property
    def items(self) -> DataFrame:
        return (A.orders_items if self.kind == "orders" else A.events_items)(self.spark, self.sf_dir)

    @cached_property
    def interactions(self) -> DataFrame:
        return (A.orders_interactions if self.kind == "orders" else A.events_interactions)(self.spark, self.sf_dir)

    def staged(self) -> "Inputs":
        """Write the interactions once, for queries that read them several times."""
        self.interactions = stage(self.interactions, f"interactions-{self.kind}")
        return self

    @cached_property
    def splits(self) -> dict[str, DataFrame]:
        return split_by_date(self.interactions, A.ORDER_SPLIT if self.kind == "orders" else A.EVENT_SPLIT)

    @property
    def train(self) -> DataFrame:
        return self.splits["train"]

    @property
    def val(self) -> DataFrame:
        return self.splits["val"]

    @property
    def test(self) -> DataFrame:
        return self.splits["test"]

    @cached_property
    def sequences(self) -> DataFrame:
        return user_sequences(self.train)

    @cached_property
    def users(self) -> DataFrame:
        return A.orders_users(self.spark, self.sf_dir)

    @cached_property
    def item_vectors(self) -> DataFrame:
        """Embedding rows of the logged items, for profiles; ``all_vectors`` is what a search looks through."""
        v = A.vectors(self.spark, self.sf_dir).select("id", "vector")
        return v.join(self.items.select(F.col("video_id").alias("id")), "id", "left_semi")

    @cached_property
    def all_vectors(self) -> DataFrame:
        return A.vectors(self.spark, self.sf_dir).select("id", "vector")


def orders(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(spark, sf_dir, "orders")


def events(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(spark, sf_dir, "events")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Float columns rounded for comparison across engines."""
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), digits) for c in columns})


def joined(c: str, sep: str = ","):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep).alias(c)
