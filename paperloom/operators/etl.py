"""Preparing a corpus: cleaning, category filters and caps, display columns."""

from __future__ import annotations

from collections.abc import Sequence
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions.text import latex_to_words, squeeze, strip
from paperloom.operators.corpus import authors_list


@F.pandas_udf(StringType())
def nfkd_ascii(text: pd.Series) -> pd.Series:
    """Compatibility decomposition with everything beyond ASCII dropped; there is no built-in for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def clean_text(text: Column) -> Column:
    """LaTeX to words, then ASCII, then single spaces."""
    return squeeze(nfkd_ascii(latex_to_words(text)))


def has_category(categories: Column, prefix: str = "cs.") -> Column:
    return F.coalesce(F.contains(categories, F.lit(prefix)), F.lit(False))


def in_categories(categories: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(categories, " "), F.array(*map(F.lit, allowed))), F.lit(False))


def cap_categories(papers: DataFrame, caps: DataFrame) -> DataFrame:
    """The first ``cap`` papers of each main category by line number; papers of other categories drop out.

    ``caps`` is a parameter table of ``(category, cap)``. Rows beyond a cap are dropped before the sort where their group allows
    (window group limit), so one crowded category does not sort as a whole.
    """
    most = caps.agg(F.max("cap")).first()[0] or 0
    named = papers.withColumn("category", F.split("categories", " ")[0])
    first = F.row_number().over(Window.partitionBy("category").orderBy("line_no"))
    best = named.join(F.broadcast(caps.select("category")), "category", "left_semi").withColumn("in_category", first).where(F.col("in_category") <= most)
    return best.join(F.broadcast(caps), "category").where(F.col("in_category") <= F.col("cap")).drop("cap")


def display(docs: DataFrame) -> DataFrame:
    """What a result list shows, with words for what is missing."""
    names = F.array_join(F.filter(authors_list(F.col("authors")), lambda a: strip(a) != ""), ", ")
    shown = lambda c, other: F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(other))
    return docs.select(
        "line_no",
        F.col("id").cast("string").alias("id"),
        shown(F.col("title"), "Untitled").alias("title"),
        shown(F.col("abstract"), "No abstract available").alias("abstractText"),
        shown(names, "Unknown authors").alias("authors"),
        pdf_link(F.col("id")).alias("pdf_url"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updateDate"),
    )


def pdf_link(paper_id: Column, base: str = "https://arxiv.org/pdf/") -> Column:
    return F.concat(F.lit(base), paper_id, F.lit(".pdf"))


def prepare(raw: DataFrame, caps: DataFrame, prefix: str = "cs.") -> DataFrame:
    """Extract, clean and cap: papers of the wanted area, texts cleaned, authors flattened, links built."""
    chosen = raw.where(has_category(F.col("categories"), prefix))
    cleaned = chosen.select(
        "line_no",
        "id",
        clean_text(F.coalesce("title", F.lit(""))).alias("title"),
        clean_text(F.coalesce("abstract", F.lit(""))).alias("abstract"),
        F.array_join(authors_list(F.col("authors")), ", ").alias("authors"),
        F.coalesce("pdf_url", pdf_link(F.col("id"))).alias("pdf_url"),
        "categories",
    )
    return cap_categories(cleaned, caps)
