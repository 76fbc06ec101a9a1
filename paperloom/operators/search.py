"""Hybrid search over a table of queries: BM25 and vectors per shard, fused, reranked and paged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.config import SearchConfig
from paperloom.functions.text import strip, title_and_abstract, words
from paperloom.operators.blocks import fuse_blocks, hybrid_in_blocks
from paperloom.operators.bm25 import Bm25Tables, impacts_of
from paperloom.operators.corpus import shard_order
from paperloom.operators.vectors import CellIndex, Embedder, embed, nearest_per_shard
from paperloom.runtime import settle

Reranker = Callable[[Column, Column, Column], Column]
#: Rows of a shortlist that may be broadcast to the documents: some 40 bytes each.
BROADCAST_ROWS = 500_000


@dataclass
class Index:
    """All tables of a searchable corpus; ``vectors`` are ``(shard_id, doc_ord, vector)`` of length one.

    ``impacts`` are inverted lists of ready weights, ``dictionary`` and ``shortened`` serve spelling, ``titles`` suggestions.
    """

    docs: DataFrame
    bm25: Bm25Tables | None
    vectors: DataFrame
    cells: CellIndex | None = None
    impacts: DataFrame | None = None
    dictionary: DataFrame | None = None
    shortened: DataFrame | None = None
    titles: DataFrame | None = None
    _sizes: list[tuple[int, int]] | None = None

    def sizes(self) -> list[tuple[int, int]]:
        """The shards with their numbers of documents."""
        if self._sizes is None:
            self._sizes = [(r.shard_id, r.n_docs) for r in self.bm25.fields.where("field = 'title'").select("shard_id", "n_docs").orderBy("shard_id").collect()]  # a row per shard
        return self._sizes

    def nearest(self, queries: DataFrame, k: int, config: SearchConfig) -> DataFrame:
        """Exact, or by the cells where the configuration allows it and the index has them."""
        if self.cells is not None and not config.exact_vectors:
            return self.cells.search_many(queries, k, config.probes)
        return nearest_per_shard(self.vectors, queries, k, config.query_block, config.doc_block)


class LexicalReranker:
    """A stand-in for a neural model: the share of distinct query words in the text, and half of that in the title.

    A reranker is any function of query, title and abstract. One that has a part for the document alone, as this has, may name
    it ``document``, so that a table of queries has it computed once for each document.
    """

    def document(self, title: Column, abstract: Column) -> Column:
        return F.struct(F.array_distinct(words(title)).alias("title"), F.array_distinct(words(strip(title_and_abstract(title, abstract)))).alias("text"))

    def score(self, query: Column, document: Column) -> Column:
        asked = F.array_distinct(words(query))
        n = F.greatest(F.size(asked), F.lit(1))
        return F.size(F.array_intersect(asked, document["text"])) / n + 0.5 * F.size(F.array_intersect(asked, document["title"])) / n

    def __call__(self, query: Column, title: Column, abstract: Column) -> Column:
        return self.score(query, self.document(title, abstract))


lexical_reranker = LexicalReranker()


def fuse(index: Index, queries: DataFrame, query_vectors: DataFrame, config: SearchConfig = SearchConfig(), complete: bool = True) -> DataFrame:
    """``(query_id, place, shard_id, doc_ord, bm25, similarity, fused)`` of every candidate, or of each query's shortlist.

    Candidates are the union of each shard's best by BM25 and by distance. The BM25 part counts for all of them,
    the vector part only for those among the nearest.
    """
    asked = queries.select("query_id", words(F.col("query")).alias("terms")).join(query_vectors.select("query_id", "vector"), "query_id", "left")
    asked = settle(asked, "asked")
    near = index.nearest(asked, config.vectors_per_shard, config) if index.cells is not None and not config.exact_vectors else None
    impacts = index.impacts if index.impacts is not None else impacts_of(index.bm25, config)
    found = hybrid_in_blocks(impacts, index.sizes(), asked, config.bm25_per_shard, config.vectors_per_shard, config.doc_block, config.query_block, index.vectors, near)
    return fuse_blocks(found, config.bm25_per_shard, config.vectors_per_shard, config.vector_weight, None if complete else config.shortlist)


def best_by_words(index: Index, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(query_id, shard_id, doc_ord, bm25, place)``: each shard's best by BM25, documents without a query word included."""
    asked = queries.select("query_id", words(F.col("query")).alias("terms"), F.lit(None).cast("array<double>").alias("vector"))
    found = hybrid_in_blocks(index.impacts, index.sizes(), asked, config.bm25_per_shard, 0, config.doc_block, config.query_block)
    order = Window.partitionBy("query_id", "shard_id").orderBy(F.desc(F.round("bm25", 9)), "doc_ord")
    return fuse_blocks(found, config.bm25_per_shard, 0, 0.0, None).select("query_id", "shard_id", "doc_ord", "bm25", F.row_number().over(order).alias("place"))


def shortlist(fused: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The best of all shards; ties go by shard order and position."""
    return fused.where(F.col("place") <= config.shortlist)


def rerank(short: DataFrame, queries: DataFrame, docs: DataFrame, reranker: Reranker = lexical_reranker, small: bool = False) -> DataFrame:
    """``(query_id, rank, shard_id, doc_ord, score)``: the reranker's score replaces the fused one, ties keep their order.

    Texts are read for the shortlist only and given up as soon as they are scored. A ``small`` shortlist is broadcast.
    """
    key = ["shard_id", "doc_ord"]
    texts = docs.select(*key, "title", "abstract")
    asked = queries.select("query_id", "query")
    if small or not hasattr(reranker, "document"):
        asked = short.select("query_id", "place", *key).join(F.broadcast(asked) if small else asked, "query_id")
        full = texts.join(F.broadcast(asked) if small else asked, key)
        score = reranker(F.col("query"), F.col("title"), F.col("abstract"))
    else:
        asked = short.select("query_id", "place", *key).join(asked, "query_id")
        full = texts.repartition(*key).select(*key, reranker.document(F.col("title"), F.col("abstract")).alias("document")).join(asked, key)
        score = reranker.score(F.col("query"), F.col("document"))
    scored = full.select("query_id", "place", *key, score.cast("double").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "place")
    return scored.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "shard_id", "doc_ord", "score")


def page_bounds(page: Column, size: Column, config: SearchConfig = SearchConfig()) -> tuple[Column, Column]:
    """``(page, size)`` as used: a missing page is the first, pages are clamped, a missing or non-positive size is the default."""
    page = F.greatest(F.lit(1), F.least(F.lit(config.max_pages), F.coalesce(page, F.lit(1))))
    return page, F.when(F.coalesce(size, F.lit(0)) <= 0, config.page_size).otherwise(size)


def cut_page(ranked: DataFrame, requests: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The rows of ``ranked`` on each request's page; ``requests`` has ``request_id, query_id, page, size``."""
    page, size = page_bounds(F.col("page"), F.col("size"), config)
    asked = requests.select("request_id", "query_id", page.alias("_page"), size.alias("_size"))
    first = (F.col("_page") - 1) * F.col("_size")
    return ranked.join(asked, "query_id").where((F.col("rank") > first) & (F.col("rank") <= first + F.col("_size"))).drop("_page", "_size")


def similar(index: Index, wanted: DataFrame, config: SearchConfig = SearchConfig(), embedder: Embedder | None = None) -> DataFrame:
    """``(query_id, place, id, distance, shard_id, doc_ord)`` for ``wanted (query_id, paper_id, k)``: the nearest papers, by the stored vector.

    Of several papers of one id the first by shard order is the target; all of that id are left out. Each shard gives
    its k + 1 nearest. A missing or zero k is the default; a negative one and an unknown id have no rows. A target without
    a stored vector gets one of its text by ``embedder``; without that, it has no rows.
    """
    key = ["shard_id", "doc_ord"]
    wanted = wanted.withColumn("k", F.when(F.coalesce("k", F.lit(0)) == 0, config.default_top_k).otherwise(F.col("k")).cast("int"))
    asked = wanted.where("paper_id is not null and k > 0").groupBy("paper_id").agg(F.max("k").alias("most"))
    place = F.struct(shard_order(F.col("shard_id")).alias("s"), "doc_ord")
    named = index.docs.select(*key, "id", *(["title", "abstract"] if embedder else [])).join(asked.select(F.col("paper_id").alias("id")), "id")
    held = named.join(index.vectors.select(*key, "vector").where("vector is not null"), key, "left" if embedder else "inner")
    first = F.struct("vector", title_and_abstract(F.col("title"), F.col("abstract")).alias("text")) if embedder else F.struct("vector")
    target = settle(held.groupBy(F.col("id").alias("query_id")).agg(F.min_by(first, place).alias("t")).select("query_id", "t.*"), "targets")
    if embedder:
        target = target.where("vector is not null").select("query_id", "vector").unionByName(embed(target.where("vector is null").select("query_id", "text"), "text", "vector", embedder))
    most = asked.agg(F.max("most")).first()[0] or 0
    near = index.nearest(target.select("query_id", "vector"), most + 1, config)
    named = near.join(index.docs.select(*key, "id"), key).where("id is distinct from query_id")
    per = wanted.where("k > 0").select("query_id", F.col("paper_id").alias("target"), "k")
    own = named.withColumnRenamed("query_id", "target").join(per, "target").where(F.col("place") <= F.col("k") + 1)
    order = Window.partitionBy("query_id").orderBy("distance", shard_order(F.col("shard_id")), "doc_ord")
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("k")).select("query_id", "place", "id", "distance", *key)
