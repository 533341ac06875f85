"""Windowed item counts and baskets over streams; late rows beyond the watermark are dropped by Spark, and state is bounded by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.association import exploded_pairs


def item_counts(stream: DataFrame, time: str, item: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, item, n) per tumbling window."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(item).alias("item"))
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "item", "n")


def baskets(stream: DataFrame, time: str, basket: str, item: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, basket_id, items) per tumbling window: the same baskets that the batch form builds per day."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(basket).alias("basket_id"))
    return w.agg(F.sort_array(F.collect_set(item)).alias("items")).select(F.col("window.start").alias("start"), "basket_id", "items")


def basket_pairs(stream: DataFrame, **columns) -> DataFrame:
    """(start, basket_id, item_a, item_b) of finished baskets, to be appended to a table of pair rows."""
    return exploded_pairs(baskets(stream, **columns), "start", "basket_id")
