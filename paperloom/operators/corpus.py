"""The corpus as a table: line numbers, contiguous shards, positions within shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import strip


def shard_of(line_no: Column, total: Column | int, shards: int) -> Column:
    """Contiguous ranges of ``ceil(total / shards)`` lines; the last shards may stay empty."""
    total = total if isinstance(total, Column) else F.lit(total)
    return F.floor(line_no / F.ceil(total / F.lit(shards))).cast("int")


def shard_order(shard_id: Column) -> Column:
    """Shards are visited in the order of their names, so 10 comes before 2."""
    return shard_id.cast("string")


def dense_positions(df: DataFrame, group: str, order: str, name: str, block: int = 65_536) -> DataFrame:
    """Numbers each group's rows from 0 by ``order`` (a bigint), in parallel within a group.

    Rows are counted by blocks of ``order``; only the blocks' counts are summed up in one window per group.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    per = cut.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order)) - 1
    joined = cut.withColumn("_at", within).join(before.select(group, "_block", F.coalesce("_before", F.lit(0)).alias("_before")), [group, "_block"])
    return joined.withColumn(name, (F.col("_at") + F.col("_before")).cast("int")).drop("_block", "_at", "_before")


def authors_list(authors: Column) -> Column:
    """A list stays a list, a single value becomes a list of one, null an empty list."""
    trimmed = strip(authors)
    listed = F.from_json(trimmed, "array<string>", {"allowSingleQuotes": "false"})
    return F.when(authors.isNull(), F.array().cast("array<string>")).when(trimmed.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(authors))


def shard_corpus(papers: DataFrame, shards: int = 8, max_docs: int = 0, lines: int | None = None) -> DataFrame:
    """``(shard_id, doc_ord, line_no, id, title, abstract, authors, pdf_url, categories)``, nulls in texts made empty.

    Shard bounds follow from the number of ``lines``, those without a record included, as ``read_corpus`` counts them; where
    it is not given, the last record is taken for the last line. ``max_docs`` caps lines, 0 takes all.
    """
    if max_docs > 0:
        papers, lines = papers.where(F.col("line_no") < max_docs), None if lines is None else min(lines, max_docs)
    if lines is None:
        total = papers.agg((F.max("line_no") + 1).alias("_total"))
        placed = papers.join(F.broadcast(total)).withColumn("shard_id", shard_of(F.col("line_no"), F.col("_total"), shards)).drop("_total")  # one row
    else:
        placed = papers.withColumn("shard_id", shard_of(F.col("line_no"), max(1, lines), shards))
    numbered = dense_positions(placed, "shard_id", "line_no", "doc_ord")
    return numbered.select(
        "shard_id",
        "doc_ord",
        "line_no",
        F.col("id").cast("string").alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        authors_list(F.col("authors")).alias("authors"),
        "pdf_url",
        "categories",
    )
