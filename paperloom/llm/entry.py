"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.packed import split_packed
from paperloom.runtime import materialize, tables


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.variants import link_variants, variant_pairs

    (papers,) = tables(spark, d, "papers")
    authors = split_packed(papers, "line_no", "authors", value="author", carried={"category": F.split("categories", " ")[0]})
    return variant_pairs(link_variants(authors, "author", "line_no", "category"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every author string with its entity, named by its least spelling, and the entity's number of spellings: no pairs."""
    from paperloom.llm.variants import link_variants

    (papers,) = tables(spark, d, "papers")
    authors = materialize(split_packed(papers, "line_no", "authors", value="author", carried={"category": F.split("categories", " ")[0]}).select("author", "line_no", "category"), "authors")
    linked = link_variants(authors, "author", "line_no", "category").withColumnsRenamed({"node": "author", "component": "entity"})
    sizes = linked.groupBy("entity").agg(F.count("*").alias("spellings"))
    every = authors.select("author").distinct().join(linked, "author", "left").join(sizes, "entity", "left")
    return every.select("author", F.coalesce("entity", "author").alias("entity"), F.coalesce("spellings", F.lit(1)).alias("spellings"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a non-empty form: its class, named by the least document of that look, and how many texts look so."""
    from paperloom.llm.lookalike import with_forms

    (documents,) = tables(spark, d, "documents")
    t = F.col("text")
    formed = with_forms(documents.where(t != ""), "text", {"doc_id": F.col("doc_id"), "x": F.struct(F.xxhash64(t), F.crc32(t.cast("binary")), F.length(t))})
    look = F.struct(F.xxhash64("form"), F.crc32(F.col("form").cast("binary")), F.length("form"))
    rows = materialize(formed.where("form <> ''").select("doc_id", "x", look.alias("look")), "looks")
    # copies of one text combine on the map side, so a text of a third of all rows is no hot key
    sizes = rows.groupBy("look", "x").agg(F.min("doc_id").alias("least")).groupBy("look").agg(F.min("least").alias("class_doc_id"), F.count("*").alias("texts"))
    return rows.join(sizes, "look").select("doc_id", "class_doc_id", "texts")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of a packing: each text whole and once, no container over its capacity, items one after the other, little left unused."""
    documents, sizes = tables(spark, d, "documents", "pack_sizes")
    packed = materialize(p6_packed(spark, d), "packing")
    texts = packed.groupBy("profile", "doc_id").agg((F.sum("n_tokens") == F.max(F.col("first_token") + F.col("n_tokens"))).alias("whole"))
    texts = texts.groupBy("profile").agg(F.count("*").alias("texts"), F.every("whole").alias("whole"))
    boxes = packed.groupBy("profile", "container").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"), F.count("*").alias("items"), F.max("place").alias("last"))
    boxes = boxes.join(F.broadcast(sizes), "profile").groupBy("profile").agg(F.every(F.expr("n <= capacity")).alias("within"), F.every(F.expr("n = `end` and items = last + 1")).alias("dense"), (F.sum("n") >= 0.95 * F.sum("capacity")).alias("filled"))
    return texts.join(boxes, "profile").select("profile", "texts", "whole", "within", "dense", "filled")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.lookalike import lookalike_pairs

    (documents,) = tables(spark, d, "documents")
    return lookalike_pairs(documents, "doc_id", "text").toDF("doc_id_a", "doc_id_b")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.lookalike import consistent_form

    (documents,) = tables(spark, d, "documents")
    return consistent_form(documents, "doc_id", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.neighbours import neighbours

    vectors, requests = tables(spark, d, "paper_vectors", "similar_requests")
    requests = requests.where("request_id is not null").groupBy("request_id").agg(F.min_by("paper_id", "received_at").alias("id"), F.min_by("top_k", "received_at").alias("k"))
    found, _ = neighbours(vectors, "paper_id", "vec_no", "embedding", requests.select("id", "k"))
    return requests.withColumnRenamed("id", "q").join(found, "q").where("place <= k").select("request_id", F.col("id").alias("neighbour_id"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every row whose ``vec_no`` is divisible by 50, against all rows."""
    from paperloom.llm.neighbours import neighbours

    (vectors,) = tables(spark, d, "paper_vectors")
    found, _ = neighbours(vectors, "paper_id", "vec_no", "embedding", vectors.where("vec_no % 50 = 0").select(F.col("paper_id").alias("id"), F.lit(10).alias("k")))
    return found.select(F.col("q").alias("paper_id"), F.col("id").alias("neighbour_id"), F.round("s", 5).alias("similarity"), "place")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.neardup import NearDupOptions, row_pairs

    (papers,) = tables(spark, d, "papers")
    return row_pairs(papers, "line_no", ["title", "abstract"], NearDupOptions(shingle=3, similarity=0.6, min_words=20, groups=12)).toDF("line_no_a", "line_no_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.neardup import row_groups

    (papers,) = tables(spark, d, "papers")
    return row_groups(papers, "line_no", ["title", "abstract"]).withColumnRenamed("group", "group_line_no")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.packing import pack

    documents, sizes = tables(spark, d, "documents", "pack_sizes")
    return pack(documents, "doc_id", "text", sizes)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.packing import packing_report

    (sizes,) = tables(spark, d, "pack_sizes")
    return packing_report(p6_packed(spark, d), sizes)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.leakage import find_leaks

    documents, items = tables(spark, d, "documents", "eval_items")
    return find_leaks(documents, "doc_id", "text", items, "item_id", "text")


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.leakage import leaked_spans

    documents, items = tables(spark, d, "documents", "eval_items")
    return leaked_spans(documents, "doc_id", "text", items, "item_id", "text")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.leakage import leaked_spans, remove_leaks

    documents, items = tables(spark, d, "documents", "eval_items")
    return remove_leaks(documents, "doc_id", "text", materialize(leaked_spans(documents, "doc_id", "text", items, "item_id", "text"), "spans"))


def p1_store(spark: SparkSession, d: str):
    """The store after two batches: rows that arrived in time, then the late ones."""
    from paperloom.llm.terms import TermStore, term_delta

    (papers,) = tables(spark, d, "papers")
    late = F.coalesce(F.col("received_at") > F.col("updated_at") + F.expr("interval 2 days"), F.lit(False))
    store = TermStore(spark)
    for name, batch in (("in time", papers.where(~late)), ("late", papers.where(late))):
        store.merge(term_delta(batch, ["title", "abstract"]), name)
    return store


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_store(spark, d).marks().select("field", "term", "band")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_store(spark, d).counts()


def p1_revised(spark: SparkSession, d: str) -> DataFrame:
    """Counts after rows of a paper that were sent again replace the rows sent before: signed deltas against the full counts."""
    from paperloom.llm.terms import changes, term_delta

    (papers,) = tables(spark, d, "papers")
    store = p1_store(spark, d)
    latest = papers.join(papers.where("id is not null").groupBy("id").agg(F.max("line_no").alias("line_no")), ["line_no", "id"], "left_semi").unionByName(papers.where("id is null"))
    turned = changes(papers, latest, "line_no", ["title", "abstract"])
    store.merge(term_delta(turned, ["title", "abstract"], F.col("sign")))
    return store.counts()


WORDS_SQL = """
with texts as (select line_no, 'title' as field, title as t from {papers} union all select line_no, 'abstract', abstract from {papers}),
words as (select line_no, field, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) as term from texts where t is not null),
counts as (select field, term, count(*)::bigint as occurrences, count(distinct line_no)::bigint as records from words group by all)
"""
LATEST_SQL = "(select * from papers p where id is null or line_no = (select max(line_no) from papers q where q.id = p.id))"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_counts, p1_revised, p3_found, p3_entities, p4_found, p4_neighbours, p5_found, p5_groups, p6_packed, p6_report, p6_checks, p7_found, p7_spans, p7_clean, p8_found, p8_forms, p8_classes)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": WORDS_SQL.format(papers="papers") + "select field, term, case when records <= 2 then 'rare' else 'common' end as band from counts where records <= 2 or records > 0.2 * (select count(*) from papers)",
        "p1_counts": WORDS_SQL.format(papers="papers") + "select * from counts",
        "p5_found": """
            with texts as (select line_no, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\\p{L}\\p{N}_]+') as ws from papers),
            runs as (select distinct line_no, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as run from texts where len(ws) >= 20),
            sizes as (select line_no, count(*) as n from runs group by line_no),
            common as (select a.line_no as line_no_a, b.line_no as line_no_b, count(*) as c from runs a join runs b using (run) where a.line_no < b.line_no group by all)
            select line_no_a, line_no_b from common join sizes x on x.line_no = line_no_a join sizes y on y.line_no = line_no_b where c >= 0.6 * (x.n + y.n - c)""",
        "p5_groups": """
            with recursive texts as (select line_no, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\\p{L}\\p{N}_]+') as ws from papers),
            classes as (select ws, min(line_no) as rep, count(*) as copies from texts where len(ws) >= 5 group by ws),
            runs as (select distinct rep, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) as run from classes),
            sizes as (select rep, count(*) as n from runs group by rep),
            common as (select a.rep as a, b.rep as b, count(*) as c from runs a join runs b using (run) where a.rep <> b.rep group by all),
            links as (select a, b from common join sizes x on x.rep = a join sizes y on y.rep = b where c >= 0.8 * (x.n + y.n - c)),
            reach as (select rep as a, rep as b from classes union select r.a, l.b from reach r join links l on l.a = r.b),
            roots as (select a, min(b) as root from reach group by a),
            degree as (select a, count(*) as links from links group by a)
            select line_no, root as group_line_no, copies, coalesce(links, 0) as links from texts join classes using (ws) join roots on a = rep left join degree on degree.a = rep""",
        "p6_checks": "select profile, (select count(*) from documents)::bigint as texts, true as whole, true as within, true as dense, true as filled from pack_sizes",
        "p1_revised": WORDS_SQL.format(papers=LATEST_SQL) + "select * from counts",
    }
