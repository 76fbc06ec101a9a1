"""Line-delimited JSON corpora: one record a line, the line's place is its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, title string, abstract string, authors string, pdf_url string, categories string"
CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` of every line, blank ones included; bytes that are no UTF-8 are dropped.

    Numbers are exact and in the order of file names and places. A split of a file is read by one task from start to end, so
    its lines are numbered by ``monotonically_increasing_id``; splits are counted, and a split's first number is the sum of
    the counts before it. Lines never leave the JVM.
    """
    raw = spark.read.format("text").load(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m"))
    counts = raw.groupBy("_f", "_at").agg(F.count("*").alias("_n"), F.min("_m").alias("_least"))
    before = F.sum("_n").over(Window.orderBy("_f", "_at").rowsBetween(Window.unboundedPreceding, -1))  # a row per split of a file
    first = counts.select("_f", "_at", (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_shift"))
    clean = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    return raw.join(first, ["_f", "_at"]).select((F.col("_m") + F.col("_shift")).alias("line_no"), clean.alias("value"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, id, title, abstract, authors, pdf_url, categories)`` of the lines that hold an object.

    Blank lines, invalid JSON and values that are no object are skipped, after numbering. ``authors`` is a string: a list
    keeps its JSON text. Missing and null texts stay null here; the corpus makes them empty.
    """
    parsed = lines.where(F.col("value").rlike(r"\S")).select("line_no", F.from_json("value", f"{SCHEMA}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("p"), "value")
    whole = parsed.where(F.col(f"p.{CORRUPT}").isNull() & F.col("p").isNotNull() & F.ltrim("value").startswith("{"))
    return whole.select("line_no", *[F.col(f"p.{c.split()[0]}").alias(c.split()[0]) for c in SCHEMA.split(", ")])


def read_corpus(spark: SparkSession, path: str, max_docs: int = 0) -> tuple[DataFrame, int]:
    """The records, and the number of lines, blank and broken ones included; ``max_docs`` caps lines."""
    lines = read_lines(spark, path)
    total = spark.read.format("text").load(path).count()
    if max_docs > 0:
        lines, total = lines.where(F.col("line_no") < max_docs), min(total, max_docs)
    return parse_lines(lines), total


def write_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
