"""A persisted index: parquet tables under one folder, partitioned by shard."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import SearchConfig
from paperloom.functions.text import title_and_abstract
from paperloom.operators.bm25 import Bm25Tables, bm25_tables, impacts_of, postings_of
from paperloom.operators.search import Index
from paperloom.operators.spelling import shortened
from paperloom.operators.suggest import suggestion_table
from paperloom.operators.vectors import Embedder, HashingEmbedder, embed

TABLES = ("docs", "postings", "terms", "fields", "impacts", "vectors", "dictionary", "shortened", "titles")


def write_index(docs: DataFrame, path: str, config: SearchConfig = SearchConfig(), vectors: DataFrame | None = None, embedder: Embedder | None = None) -> Index:
    """Writes all tables of ``docs`` (see ``shard_corpus``), each from the stored ones before it, so texts are cut into words once.

    Inverted lists are sorted by term within files, so a query's words prune row groups; titles are sorted as a whole, so
    prefixes do. ``vectors (shard_id, doc_ord, vector)`` are embeddings of the texts where they are not given.
    """
    spark = docs.sparkSession

    def put(name: str, df: DataFrame, *keys: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    docs = put("docs", docs.repartition("shard_id").sortWithinPartitions("shard_id", "doc_ord"), "shard_id")
    # the list of a frequent word is cut by document ranges, else one task would write it all
    cut = F.pmod(F.xxhash64("term", F.floor(F.col("doc_ord") / 1_000_000)), F.lit(16))

    def embedded() -> DataFrame:
        text = docs.select("shard_id", "doc_ord", title_and_abstract(F.col("title"), F.col("abstract")).alias("text"))
        found = embed(text, "text", "vector", embedder or HashingEmbedder(config.dim)) if vectors is None else vectors
        return put("vectors", found.repartition("shard_id").sortWithinPartitions("shard_id", "doc_ord"), "shard_id")

    def listed() -> tuple[Bm25Tables, DataFrame]:
        made = bm25_tables(docs, config, postings)
        with ThreadPoolExecutor(2) as both:
            fields = both.submit(put, "fields", made.fields.coalesce(1), "shard_id")
            terms = put("terms", made.terms.repartition("shard_id").sortWithinPartitions("shard_id", "field", "term"), "shard_id")
        tables = Bm25Tables(postings, terms, fields.result())
        return tables, put("impacts", impacts_of(tables, config).repartition("shard_id", cut).sortWithinPartitions("shard_id", "term", "doc_ord"), "shard_id")

    def spelled() -> tuple[DataFrame, DataFrame]:
        words = put("dictionary", postings.where("field = 'title'").groupBy(F.col("term").alias("word")).agg(F.sum("tf").alias("freq")))
        return words, put("shortened", shortened(words, config.max_edit_distance).repartitionByRange("short").sortWithinPartitions("short"))

    # tables that do not need each other are written side by side, for each alone has stages of few tasks
    with ThreadPoolExecutor(4) as jobs:
        embeddings = jobs.submit(embedded)
        titles = jobs.submit(lambda: put("titles", suggestion_table(docs).repartitionByRange("title_lower").sortWithinPartitions("title_lower")))
        postings = put("postings", postings_of(docs).repartition("shard_id", cut).sortWithinPartitions("shard_id", "field", "term", "doc_ord"), "shard_id")
        words = jobs.submit(spelled)
        tables, impacts = listed()
        return Index(docs, tables, embeddings.result(), None, impacts, *words.result(), titles.result())


def shards_of(spark: SparkSession, path: str) -> list[int]:
    """The shards found, in the order of their names; an index without shards is an error."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/docs")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
    found = sorted(n.split("=")[1] for n in names if n.startswith("shard_id="))
    if not found:
        raise RuntimeError(f"no shards found in {path}")
    return [int(x) for x in found]


def read_index(spark: SparkSession, path: str) -> Index:
    shards_of(spark, path)
    part: dict[str, DataFrame] = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    tables = Bm25Tables(part["postings"], part["terms"], part["fields"])
    return Index(part["docs"], tables, part["vectors"], None, part["impacts"], part["dictionary"], part["shortened"], part["titles"])
