"""Okapi BM25 per field and shard (Robertson and Zaragoza, 2009), for one query or a table of them.

Statistics are those of a shard: its document count, average length and inverse document frequencies, the negative ones
replaced by a share of the shard's mean. Documents without any query word score zero and may still be
candidates; ``paperloom.operators.blocks`` finds a shard's best among all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.config import SearchConfig
from paperloom.functions.text import words
from paperloom.operators.blocks import asked_only

FIELDS = ("title", "abstract")


@dataclass
class Bm25Tables:
    """``postings``, ``terms`` and ``fields`` as in an inverted index."""

    postings: DataFrame
    terms: DataFrame
    fields: DataFrame


def field_tokens(docs: DataFrame) -> DataFrame:
    """``(shard_id, doc_ord, field, tokens)``, empty fields included."""
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("tokens")) for f in FIELDS]))
    return docs.select("shard_id", "doc_ord", stacked.alias("x")).select("shard_id", "doc_ord", "x.field", "x.tokens")


def postings_of(docs: DataFrame) -> DataFrame:
    """``(shard_id, field, term, doc_ord, tf, doc_len)``: counts within a document are complete before any shuffle, so no word is a hot key."""
    sorted_ = field_tokens(docs).select("shard_id", "doc_ord", "field", F.size("tokens").alias("doc_len"), F.sort_array("tokens").alias("ts"))
    # of sorted tokens, a term's count is the distance from its first place to the next term's
    ends = F.filter(F.sequence(F.lit(1), F.col("doc_len")), lambda i: (i == F.col("doc_len")) | (F.get("ts", i) != F.get("ts", i - 1)))
    runs = sorted_.where("doc_len > 0").select("shard_id", "field", "doc_ord", "doc_len", "ts", ends.alias("ends"))
    each = F.transform("ends", lambda e, i: F.struct(F.get("ts", e - 1).alias("term"), (e - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("bigint").alias("tf")))
    return runs.select("shard_id", "field", "doc_ord", "doc_len", F.explode(each).alias("x")).select("shard_id", "field", "x.term", "doc_ord", "x.tf", "doc_len")


def bm25_tables(docs: DataFrame, config: SearchConfig = SearchConfig(), postings: DataFrame | None = None) -> Bm25Tables:
    """From the documents, or from stored ``postings`` of them, which saves reading their texts again."""
    postings = postings_of(docs) if postings is None else postings
    every = docs.groupBy("shard_id").agg(F.count("*").alias("n_docs")).withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    lengths = postings.groupBy("shard_id", "field").agg(F.sum("tf").alias("tokens"))
    fields = every.join(lengths, ["shard_id", "field"], "left").select("shard_id", "field", "n_docs", (F.coalesce("tokens", F.lit(0)) / F.col("n_docs")).alias("avgdl"))
    seen = postings.groupBy("shard_id", "field", "term").agg(F.count("*").alias("df"))
    raw = seen.join(F.broadcast(fields), ["shard_id", "field"]).withColumn("raw", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # two rows a shard
    mean = raw.groupBy("shard_id", "field").agg(F.avg("raw").alias("mean_idf"))
    fields = fields.join(mean, ["shard_id", "field"], "left")
    terms = raw.join(F.broadcast(mean), ["shard_id", "field"]).select("shard_id", "field", "term", "df", F.when(F.col("raw") < 0, config.epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Tables(postings, terms, fields)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, times)``: a repeated word counts as often as it is typed."""
    return queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _contributions(tables: Bm25Tables, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """``(query_id, shard_id, doc_ord, field, part)``: what each query word adds to a document's field."""
    asked = query_terms(queries)
    # the words asked for prune the scan of the lists and of the statistics before these meet
    lists, terms = asked_only(queries.select(words(F.col("query")).alias("terms")), tables.postings, tables.terms)
    found = lists.join(terms, ["shard_id", "field", "term"]).join(F.broadcast(tables.fields.select("shard_id", "field", "avgdl")), ["shard_id", "field"])  # two rows a shard
    return found.withColumn("w", _weight(config)).join(asked, "term").select("query_id", "shard_id", "doc_ord", "field", (F.col("times") * F.col("w")).alias("part"))


def bm25_hits(tables: Bm25Tables, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(query_id, shard_id, doc_ord, field, score)`` of documents with a query word in the field."""
    return _contributions(tables, queries, config).groupBy("query_id", "shard_id", "doc_ord", "field").agg(F.sum("part").alias("score"))


def impacts_of(tables: Bm25Tables, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(shard_id, term, doc_ord, w)``: inverted lists with what an occurrence of the term in a query adds to the document's weighted score."""
    weight = F.when(F.col("field") == "title", config.title_weight).otherwise(config.abstract_weight)
    found = tables.postings.join(tables.terms, ["shard_id", "field", "term"]).join(F.broadcast(tables.fields.select("shard_id", "field", "avgdl")), ["shard_id", "field"])  # two rows a shard
    return found.select("shard_id", "term", "doc_ord", (weight * _weight(config)).alias("w"))


def _weight(config: SearchConfig) -> Column:
    relative = F.coalesce(F.try_divide(F.col("doc_len").cast("double"), F.col("avgdl")), F.lit(0.0))
    return F.col("idf") * F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * relative))


def bm25_weighted(hits: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(query_id, shard_id, doc_ord, raw)``: the fields' weighted sum."""
    weight = F.when(F.col("field") == "title", config.title_weight).otherwise(config.abstract_weight)
    return hits.groupBy("query_id", "shard_id", "doc_ord").agg(F.sum(weight * F.col("score")).alias("raw"))


def bm25_normalized(weighted: DataFrame, fields: DataFrame) -> DataFrame:
    """``(query_id, shard_id, doc_ord, bm25)`` of scored documents: scores divided by their shard's greatest plus 1e-9, in which a
    document without a score counts as zero."""
    shards = fields.where("field = 'title'").select("shard_id", "n_docs")
    seen = weighted.groupBy("query_id", "shard_id").agg(F.max("raw").alias("most"), F.count("*").alias("scored")).join(F.broadcast(shards), "shard_id")  # a row per shard
    tops = seen.select("query_id", "shard_id", F.greatest(F.when(F.col("scored") < F.col("n_docs"), F.lit(0.0)), "most").alias("top"))
    return weighted.join(tops, ["query_id", "shard_id"]).select("query_id", "shard_id", "doc_ord", (F.col("raw") / (F.col("top") + 1e-9)).alias("bm25"))
