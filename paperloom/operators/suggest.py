"""Title suggestions for a typed prefix, from a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.config import SearchConfig
from paperloom.functions.text import starts


def suggestion_table(docs: DataFrame) -> DataFrame:
    """``(title_lower, title, shard_id, doc_ord)``. An index stores it sorted, so that a prefix filter reaches the scan and skips row groups."""
    return docs.where("title <> ''").select(F.lower("title").alias("title_lower"), "title", "shard_id", "doc_ord")


def suggest(table: DataFrame, prefix: str, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(place, title)``: the first titles of the corpus with the prefix, repeated ones kept; none for an empty prefix."""
    p = prefix.lower()
    if len(p) < max(1, config.min_prefix_length):
        return table.sparkSession.createDataFrame([], "place int, title string")
    found = table.where(F.col("title_lower").startswith(p)).orderBy(F.col("shard_id").cast("string"), "doc_ord").limit(config.suggestions)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.col("shard_id").cast("string"), "doc_ord"))).select("place", "title")  # of a few rows


def suggest_many(table: DataFrame, prefixes: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(prefix, place, title)`` for a table of distinct lower-cased prefixes.

    Titles are cut to the lengths that occur among the prefixes, so this is an equality join, not a prefix scan.
    """
    wanted = prefixes.select("prefix").where(F.length("prefix") >= max(1, config.min_prefix_length)).distinct()
    lengths = wanted.agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths"))
    cut = table.join(F.broadcast(lengths)).select("title", "shard_id", "doc_ord", F.explode(starts(F.col("title_lower"), F.col("lengths"))).alias("prefix"))  # one row
    first = Window.partitionBy("prefix").orderBy(F.col("shard_id").cast("string"), "doc_ord")
    return cut.join(wanted, "prefix").withColumn("place", F.row_number().over(first)).where(F.col("place") <= config.suggestions).select("prefix", "place", "title")
