"""The search engine on the micro-corpus, with numbers worked out by hand."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.config import SearchConfig, Settings
from paperloom.functions.spelling import deletions, osa, osa_many
from paperloom.functions.text import latex_to_words, squeeze, strip, words
from paperloom.functions.vector import l2_normalize, squared_distance
from paperloom.operators import search as ops
from paperloom.operators.blocks import asked_only
from paperloom.operators.bm25 import bm25_hits, bm25_normalized, bm25_tables, bm25_weighted, impacts_of
from paperloom.operators.corpus import authors_list, dense_positions, shard_corpus
from paperloom.operators.etl import cap_categories, clean_text, display, prepare
from paperloom.operators.search import cut_page, page_bounds
from paperloom.operators.spelling import PREFIX, correct, lookup, word_frequency
from paperloom.operators.suggest import suggest, suggest_many, suggestion_table
from paperloom.operators.vectors import CellIndex, HashingEmbedder, cells_of, embed, nearest_per_shard
from paperloom.plans.engine import ResultCache, SearchEngine, build_index, build_indexes, search_many
from paperloom.sources.index_store import read_index, shards_of
from paperloom.runtime import shared_dir
from paperloom.sources.jsonl import parse_lines, read_corpus

TEXTS = [
    ("Attention is all you need", "the dominant sequence models use attention"),
    ("Graph attention networks", "we present graph attention networks for graphs"),
    ("Deep residual learning", "residual networks ease training of deep nets"),
    ("Learning to rank", ""),
]
PAPER = "line_no bigint, id string, title string, abstract string, authors string, pdf_url string, categories string"


def papers_of(spark, texts):
    return spark.createDataFrame([(i, f"p{i}", t, a, "A", None, "cs.IR") for i, (t, a) in enumerate(texts)], PAPER)


def bm25(spark, shards, query="graph attention", texts=TEXTS):
    config = SearchConfig(shards=shards)
    tables = bm25_tables(shard_corpus(papers_of(spark, texts), shards), config)
    asked = spark.createDataFrame([("q", query)], "query_id string, query string")
    hits = bm25_hits(tables, asked, config)
    weighted = bm25_weighted(hits, config)
    scaled = bm25_normalized(weighted, tables.fields)
    index = ops.Index(None, tables, None, impacts=impacts_of(tables, config))
    return hits, weighted, scaled, lambda k, block=65_536: ops.best_by_words(index, asked, SearchConfig(shards=shards, bm25_per_shard=k, doc_block=block))


def test_one_shard_scores(spark):
    hits, weighted, scaled, _ = bm25(spark, 1)
    found = {(r.doc_ord, r.field): r.score for r in hits.collect()}
    assert found[1, "title"] == pytest.approx(0.905509, abs=1e-6)
    assert found[1, "abstract"] == pytest.approx(0.718049, abs=1e-6)
    assert found[0, "title"] == pytest.approx(0, abs=1e-9)
    assert {r.doc_ord: r.raw for r in weighted.collect()}[1] == pytest.approx(3.793601, abs=1e-6)
    assert {r.doc_ord: round(r.bm25, 6) for r in scaled.collect()}[1] == 1.0


def test_two_shards_keep_their_own_statistics_and_negative_maximum(spark):
    _, weighted, scaled, best_of = bm25(spark, 2)
    raw = {(r.shard_id, r.doc_ord): r.raw for r in weighted.collect()}
    assert raw[0, 0] == pytest.approx(-0.207100, abs=1e-6) and raw[0, 1] == pytest.approx(-0.242911, abs=1e-6)
    norm = {(r.shard_id, r.doc_ord): r.bm25 for r in scaled.collect()}
    assert norm[0, 0] == pytest.approx(1.0, abs=1e-6) and norm[0, 1] == pytest.approx(1.172912, abs=1e-6)
    best = best_of(100).collect()
    assert {(r.shard_id, r.doc_ord) for r in best} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_repeated_query_word_counts_twice(spark):
    once = bm25(spark, 1, "graph")[1].first().raw
    assert bm25(spark, 1, "graph graph")[1].first().raw == pytest.approx(2 * once)


def test_unknown_word_leaves_zero_candidates(spark):
    best_of = bm25(spark, 1, "zzz")[3]
    best = best_of(3).orderBy("place").collect()
    assert [(r.doc_ord, r.bm25) for r in best] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_empty_field_in_a_whole_shard(spark):
    assert bm25(spark, 1, "alpha", [("alpha", ""), ("beta", "")])[1].count() == 1


def test_fillers_follow_scored_documents(spark):
    texts = [(f"word{i}", "common thing") for i in range(12)] + [("needle", "in hay")]
    best_of = bm25(spark, 1, "needle", texts)[3]
    best = best_of(5).orderBy("place").collect()
    assert [r.doc_ord for r in best] == [12, 0, 1, 2, 3]


@pytest.mark.parametrize("lines,shards,sizes", [(9, 8, [2, 2, 2, 2, 1]), (4, 8, [1, 1, 1, 1]), (16, 8, [2] * 8), (1, 1, [1])])
def test_shard_ranges(spark, lines, shards, sizes):
    docs = shard_corpus(papers_of(spark, [("t", "a")] * lines), shards)
    assert [r.n for r in docs.groupBy("shard_id").agg(F.count("*").alias("n")).orderBy("shard_id").collect()] == sizes


def test_shards_in_order_of_their_names(spark):
    docs = shard_corpus(papers_of(spark, [("t", "a")] * 12), 12)
    order = [r.shard_id for r in docs.orderBy(F.col("shard_id").cast("string")).collect()]
    assert order[:4] == [0, 1, 10, 11]


def test_doc_cap_counts_lines(spark):
    assert shard_corpus(papers_of(spark, TEXTS), 2, max_docs=3).count() == 3


def test_dense_positions_across_blocks(spark):
    df = spark.createDataFrame([(g, g * 1000 + i * 7) for g in range(3) for i in range(50)], "g int, o bigint")
    got = dense_positions(df, "g", "o", "n", block=64)
    assert all(r.n == (r.o - r.g * 1000) // 7 for r in got.collect())


def test_tokenizer_on_letters_of_all_kinds(spark):
    cases = ["Ñandú BERT-base x_1, l’été", "", "Straße ПРИВЕТ", "a\tb\nc", "²½ x³"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", words(F.col("t")).alias("w")).collect()}
    assert got[0] == ["ñandú", "bert", "base", "x_1", "l", "été"]
    assert all(got[i] == re.findall(r"\w+", c.lower()) for i, c in enumerate(cases))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_tokenizer_is_that_of_unicode_words(spark, texts):
    texts = [t for t in texts if all(ord(c) < 0x3000 and c.isprintable() for c in t) and "İ" not in t]
    if not texts:
        return
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    import regex

    for r in df.select("i", words(F.col("t")).alias("w")).collect():
        assert r.w == regex.findall(r"[\p{L}\p{N}_]+", texts[r.i].lower())


def naive_osa(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("a,b,n", [("ab", "ba", 1), ("ca", "abc", 3), ("kitten", "sitting", 3), ("atention", "attention", 1), ("netwroks", "networks", 1)])
def test_osa_cases(a, b, n):
    assert osa(a, b) == n


@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
def test_osa_equals_naive(a, b, most):
    n = naive_osa(a, b)
    assert osa(a, b) == n
    assert osa(a, b, most) == min(n, most + 1)
    if n <= 2:
        assert deletions(a, 2) & deletions(b, 2)


def test_lookup_equals_brute_force(spark):
    vocabulary = {"graph": 5, "graphs": 2, "attention": 9, "network": 4, "networks": 4, "rank": 1, "bank": 3}
    terms = ["grpah", "graph", "atention", "netwrks", "ank", "zzzzzz", "Graph"]
    got = {r.term: (r.word, r.distance, r.freq) for r in lookup(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(list(vocabulary.items()), "word string, freq bigint")).collect()}
    for t in terms:
        near = [(naive_osa(t, w), -f, w) for w, f in vocabulary.items() if naive_osa(t, w) <= 2]
        assert got.get(t) == ((min(near)[2], min(near)[0], -min(near)[1]) if near else None)


def test_compound_joins_and_splits(spark):
    words_ = spark.createDataFrame([("graph", 50), ("attention", 90), ("network", 40), ("learning", 70), ("deep", 60)], "word string, freq bigint")
    asked = spark.createDataFrame([(0, "grpah atention"), (1, "atten tion network"), (2, "deeplearning"), (3, "Graph"), (4, "qqqqqqqq graph"), (5, None)], "query_id int, query string")
    got = {r.query_id: r.corrected for r in correct(asked, words_).collect()}
    assert got == {0: "graph attention", 1: "attention network", 2: "deep learning", 3: "Graph", 4: "qqqqqqqq graph"}


def test_suggestions(spark):
    texts = [("Graph A", ""), ("graph b", ""), ("Graph A", ""), ("other", ""), ("GRAPH c", ""), ("graph d", ""), ("graph e", ""), ("graph f", "")]
    table = suggestion_table(shard_corpus(papers_of(spark, texts), 1))
    assert [r.title for r in suggest(table, "gRaph").orderBy("place").collect()] == ["Graph A", "graph b", "Graph A", "GRAPH c", "graph d"]
    assert suggest(table, "").count() == 0 and suggest(table, "xyz").count() == 0
    many = suggest_many(table, spark.createDataFrame([("graph",), ("o",), ("zz",)], "prefix string"))
    assert {(r.prefix, r.place, r.title) for r in many.collect()} == {("graph", i + 1, t) for i, t in enumerate(["Graph A", "graph b", "Graph A", "GRAPH c", "graph d"])} | {("o", 1, "other")}


def test_vectors_exact_and_by_cells(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i % 2, i // 2, [float(v) for v in row]) for i, row in enumerate(x)], "shard_id int, doc_ord int, vector array<double>")
    q = [float(v) for v in x[0]]
    asked = spark.createDataFrame([(7, q)], "query_id int, vector array<double>")
    got = nearest_per_shard(df, asked, 5).orderBy("shard_id", "place").collect()
    for s in (0, 1):
        d = ((x[s::2] - x[0]) ** 2).sum(1)
        assert [r.doc_ord for r in got if r.shard_id == s] == list(np.argsort(d)[:5])
    assert got[0].distance == 0
    index = CellIndex(df, SearchConfig(dim=8))
    full = index.search(q, 5, probes=16)
    assert {(r.shard_id, r.doc_ord) for r in full.collect()} == {(r.shard_id, r.doc_ord) for r in got}
    recall = [len({(r.shard_id, r.doc_ord) for r in index.search(q, 5, probes=p).collect()} & {(r.shard_id, r.doc_ord) for r in got}) for p in (1, 4, 16)]
    assert recall == sorted(recall) and recall[-1] == 10
    assert [cells_of(n) for n in (10, 400, 10**9)] == [16, 20, 4096]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = df.select(l2_normalize(F.col("v")).alias("n"), squared_distance(F.col("v"), [0.0, 1.0]).alias("d")).collect()
    assert got[0].n == pytest.approx([0.6, 0.8]) and got[1].n == [0.0, 0.0] and got[0].d == pytest.approx(18.0)


def test_embedder(spark):
    e = HashingEmbedder(16)
    x = e(["graph attention", "", "Graph  ATTENTION!"])
    assert math.isclose((x[0] ** 2).sum(), 1.0) and not x[1].any() and (x[0] == x[2]).all()
    df = embed(spark.createDataFrame([(1, "graph"), (2, None)], "k int, text string"), "text")
    assert {r.k: any(r.vector) for r in df.collect()} == {1: True, 2: False}


def test_fusion_is_asymmetric(spark):
    """A document that only the vectors find keeps its own BM25 score; one that only words find has no vector part."""
    texts = [(f"filler{i}", "nothing here") for i in range(6)] + [("graph", "x"), ("graph graph", "y")]
    config = SearchConfig(shards=1, bm25_per_shard=1, vectors_per_shard=1)
    index = build_index(papers_of(spark, texts), config)
    asked = spark.createDataFrame([("q", "graph")], "query_id string, query string")
    vector = index.vectors.where("doc_ord = 6").select(F.lit("q").alias("query_id"), "vector")
    rows = {r.doc_ord: r for r in ops.fuse(index, asked, vector, config).collect()}
    by_words = next(r for k, r in rows.items() if k != 6)
    assert set(rows) == {6, 7} and rows[6].bm25 > 0 and rows[6].similarity == pytest.approx(1.0)
    assert by_words.similarity == 0 and by_words.bm25 == pytest.approx(1.0, abs=1e-6)


def test_pages_join_to_the_full_list(spark):
    texts = [(f"graph study {i}", "graph " * (i % 5 + 1)) for i in range(130)]
    index = build_index(papers_of(spark, texts), SearchConfig(shards=2))
    asked = spark.createDataFrame([(p, "graph", p, 10) for p in range(1, 13)] + [(99, "  ", 1, 10), (98, None, 1, 10)], "request_id int, query string, page int, size int")
    got = search_many(index, asked).collect()
    pages = {p: sorted((r.rank, r.line_no) for r in got if r.request_id == p) for p in range(1, 13)}
    assert [x[0] for p in range(1, 11) for x in pages[p]] == list(range(1, 101))
    assert len({x[1] for p in range(1, 11) for x in pages[p]}) == 100
    assert pages[11] == pages[10] and pages[12] == pages[10]
    assert not [r for r in got if r.request_id in (98, 99)]


def test_page_clamp(spark):
    df = spark.createDataFrame([(0, 10), (-3, 0), (11, None), (None, 5)], "page int, size int")
    page, size = page_bounds(F.col("page"), F.col("size"))
    assert [(r[0], r[1]) for r in df.select(page, size).collect()] == [(1, 10), (1, 10), (10, 10), (1, 5)]


def test_similar_excludes_the_id_everywhere(spark):
    papers = spark.createDataFrame([(0, "a", "graph one", "", None, None, None), (1, "a", "graph one", "", None, None, None), (2, "b", "graph two", "", None, None, None), (3, "c", "zebra", "", None, None, None)], PAPER)
    index = build_index(papers, SearchConfig(shards=2))
    asked = spark.createDataFrame([(1, "a", 3), (2, "missing", 3), (3, None, 3)], "query_id int, paper_id string, k int")
    got = [(r.query_id, r.place, r.id) for r in ops.similar(index, asked, SearchConfig(shards=2)).orderBy("place").collect()]
    assert got == [(1, 1, "b"), (1, 2, "c")]


def test_engine_end_to_end(spark, tmp_path):
    path, now = str(tmp_path / "index"), [0.0]
    build_indexes(papers_of(spark, TEXTS), path, SearchConfig(shards=2))
    assert shards_of(spark, path) == [0, 1] and read_index(spark, path).docs.count() == 4
    engine = SearchEngine(spark, path, SearchConfig(shards=2), clock=lambda: now[0])
    assert engine.search("grpah atention")[0]["id"] == "p1"
    assert engine.search("") == engine.search(None) == engine.search("  ") == []
    assert engine.autocomplete("attentoin") == ["Attention is all you need"] and engine.autocomplete("") == [] and engine.autocomplete("zzzzzz") == []
    assert "p1" not in {r["id"] for r in engine.similar("p1", 2)} and engine.similar("nope") == []
    with pytest.raises(RuntimeError):
        SearchEngine(spark, str(tmp_path / "none"))


def test_engine_with_cells(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = [(f"topic {i % 7} study {i}", f"about subject{i % 7} and more") for i in range(120)]
    config = SearchConfig(shards=2, exact_vectors=False, probes=16)
    build_indexes(papers_of(spark, texts), path, config)
    by_cells, exact = SearchEngine(spark, path, config), SearchEngine(spark, path, SearchConfig(shards=2))
    assert by_cells.similar("p3", 5) == exact.similar("p3", 5) != []
    assert [r["id"] for r in by_cells.search("topic study")] == [r["id"] for r in exact.search("topic study")]


def test_cache_expires():
    now, calls = [0.0], []
    cache = ResultCache(10, most=2, clock=lambda: now[0])
    make = lambda: calls.append(1) or [len(calls)]
    assert cache.get("a", make) == cache.get("a", make) == [1]
    now[0] = 11
    assert cache.get("a", make) == [2]
    cache.get("b", make), cache.get("c", make)
    assert cache.get("a", make) == [5]
    with pytest.raises(ZeroDivisionError):
        cache.get("bad", lambda: 1 / 0)
    assert "bad" not in cache.kept


def test_json_lines(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_bytes(b'{"id": 1, "title": "T", "abstract": "A", "authors": ["X", "Y"]}\n\n   \nnot json\n[1,2]\n{"title": null, "authors": "Z"}\n{"id": "x", "title": "b\xff\xfead"}\n"text"\nnull\n')
    got, total = read_corpus(spark, str(f))
    rows = {r.line_no: r for r in got.collect()}
    assert total == 9 and set(rows) == {0, 5, 6}
    assert rows[0].id == "1" and rows[0].authors == '["X","Y"]' and rows[5].title is None and rows[6].title == "bad"
    lists = got.select("line_no", authors_list(F.col("authors")).alias("a"))
    assert {r.line_no: r.a for r in lists.collect()} == {0: ["X", "Y"], 5: ["Z"], 6: []}
    assert read_corpus(spark, str(f), 2)[1] == 2


def test_cleaning(spark):
    df = spark.createDataFrame([(r"\emph{Abstract.}  A $\alpha$ caf\'{e}  \textbf{x} 5\% naïve",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(latex_to_words(F.col("t"))).collect()] == ["Abstract. A alpha cafe x 5% naïve", None, ""]
    assert df.select(clean_text(F.col("t"))).first()[0] == "Abstract. A alpha cafe x 5% naive"
    odd = spark.createDataFrame([("  a \n\t b　",)], "t string")
    assert odd.select(squeeze(F.col("t")), strip(F.col("t"))).first()[:] == ("a b", "a \n\t b")


def test_caps_and_display(spark):
    papers = spark.createDataFrame([(i, f"p{i}", " t ", None, None, None, "cs.A cs.B" if i % 3 else "cs.B") for i in range(9)] + [(9, "x", "", "", "Q", None, None)], PAPER).withColumn("updated_at", F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))
    caps = spark.createDataFrame([("cs.A", 2), ("cs.B", 1)], "category string, cap int")
    assert {(r.category, r.line_no) for r in cap_categories(papers, caps).collect()} == {("cs.A", 1), ("cs.A", 2), ("cs.B", 0)}
    shown = {r.line_no: r for r in display(papers).collect()}
    assert shown[0].authors == "Unknown authors" and shown[9].title == "Untitled" and shown[0].title == "t" and shown[9].updateDate == "2024-05-06"
    assert prepare(papers, caps).count() == 3


def test_word_frequency(spark):
    assert {r.word: r.freq for r in word_frequency(papers_of(spark, TEXTS)).collect()}["learning"] == 2


def plan_of(df):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans_prune(spark, tmp_path):
    """A prefix reaches the scan of the stored titles, a query's words that of the inverted lists, and shards are partitions."""
    path = str(tmp_path / "index")
    build_indexes(papers_of(spark, TEXTS), path, SearchConfig(shards=2))
    index = read_index(spark, path)
    assert "StringStartsWith(title_lower,graph)" in plan_of(suggest(index.titles, "Graph"))
    asked = spark.createDataFrame([("q", ["graph"])], "query_id string, terms array<string>")
    lists = asked_only(asked, index.impacts)[0]
    assert "EqualTo(term,graph)" in plan_of(lists) and "PartitionFilters: [isnotnull(shard_id" in plan_of(index.docs.where("shard_id = 1"))
    assert lists.count() == 2


def test_blocks_of_a_shard_give_what_the_whole_shard_gives(spark):
    """Also where all scores of a shard are negative, which turns their order round, and for queries without a known word."""
    for texts in (TEXTS, [("graph", "graph attention")] * 5, [(f"graph w{i % 7}", "attention " * (i % 4)) for i in range(40)]):
        for query in ("graph attention", "nothing", ""):
            best = bm25(spark, 1, query, texts)[3]
            rows = lambda df: sorted((r.place, r.doc_ord, round(r.bm25, 6)) for r in df.collect())
            whole = rows(best(3))
            assert len(whole) == 3 and rows(best(3, 2)) == whole and rows(best(3, 7)) == whole


def test_shard_bounds_count_lines_without_a_record(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"id": "a"}\n{"id": "b"}\n' + "\n" * 3 + "broken\n")
    papers, lines = read_corpus(spark, str(f))
    assert lines == 6
    assert {r.id: r.shard_id for r in shard_corpus(papers, 3, lines=lines).collect()} == {"a": 0, "b": 0}
    assert {r.id: r.shard_id for r in shard_corpus(papers, 3, max_docs=3, lines=lines).collect()} == {"a": 0, "b": 1}


def test_lines_of_several_files_are_numbered_by_name_and_place(spark, tmp_path):
    from paperloom.sources.jsonl import read_lines

    for name, n in (("a", 5), ("b", 3000), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i} {'x' * 50}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r.value.split()[0] for r in read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
        numbers = sorted(r.line_no for r in read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"{name}{i}" for name, n in (("a", 5), ("b", 3000), ("c", 1)) for i in range(n)] and numbers == list(range(3006))


def test_similar_default_and_texts_without_a_vector(spark):
    papers = spark.createDataFrame([(i, f"p{i}", f"graph study {i % 4}", "", None, None, None) for i in range(30)], PAPER)
    index = build_index(papers, SearchConfig(shards=2))
    whole = ops.similar(index, spark.createDataFrame([(1, "p3", 4)], "query_id int, paper_id string, k int")).orderBy("place").collect()
    index.vectors = index.vectors.where("not (shard_id = 0 and doc_ord = 3)")
    asked = spark.createDataFrame([(1, "p3", 4), (2, "p5", 0), (3, "p5", None), (4, "p5", -1)], "query_id int, paper_id string, k int")
    assert {r.query_id: r.n for r in ops.similar(index, asked).groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {2: 10, 3: 10}
    again = ops.similar(index, asked, embedder=HashingEmbedder()).where("query_id = 1").orderBy("place").collect()
    assert [(r.id, round(r.distance, 6)) for r in again] == [(r.id, round(r.distance, 6)) for r in whole]


@given(st.lists(st.tuples(st.text("abc", max_size=9), st.text("abcd", max_size=12)), max_size=30))
def test_osa_of_many_pairs(pairs):
    assert osa_many([a for a, _ in pairs], [b for _, b in pairs], step=7).tolist() == [naive_osa(a, b) for a, b in pairs]


@given(st.text("ab", min_size=6, max_size=14), st.text("ab", min_size=6, max_size=14))
def test_prefixes_keep_all_near_words(a, b):
    if naive_osa(a, b) <= 2:
        assert deletions(a[:PREFIX], 2) & deletions(b[:PREFIX], 2)


def test_a_very_long_token_has_few_pieces(spark):
    words_ = spark.createDataFrame([("graph", 50), ("attention", 90)], "word string, freq bigint")
    long = "a" * 50_000
    asked = spark.createDataFrame([(0, f"{long} grpah"), (1, "graphattention")], "query_id int, query string")
    assert {r.query_id: r.corrected for r in correct(asked, words_).collect()} == {0: f"{long} graph", 1: "graph attention"}


def test_settings_from_options_and_environment():
    assert Settings.read(["--shards", "3"], {"NUM_SHARDS": "5", "DATASET_PATH": "x"}) == Settings("x", "index", 3, 0)
    with pytest.raises(ValueError):
        Settings.read(["--shards", "0"], {})


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    before = spark.conf.get("spark.checkpoint.dir", None)
    shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir", None) == before
