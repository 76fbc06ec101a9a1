"""Streamed search of many queries gives what the search in shuffled blocks gives, and shuffles no candidates."""

import random

import pytest

from paperloom.config import SearchConfig
from paperloom.operators.spelling import word_frequency
from paperloom.operators.streamed import write_lists
from paperloom.plans import catalog
from paperloom.plans.engine import build_index, search_batches, search_many

WORDS = "graph attention network learning rank deep model sparse index query über naïve 3d x_y of the".split()


def corpus(spark, n, rng):
    text = lambda most: " ".join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.randint(0, most))).title()
    # every fifth line is missing, so places in a shard are not its lines; some texts are equal, some empty
    rows = [(5 * (i // 4) + i % 4, f"p{i}", text(4) if i % 7 else None, text(12) if i % 9 else "the graph", None, None, None) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "line_no bigint, id string, title string, abstract string, authors string, pdf_url string, categories string").repartition(3)


@pytest.mark.parametrize("n, shards, doc_block, k", [(9, 3, 2, 5), (260, 2, 40, 2), (300, 1, 300, 3), (3, 1, 2, 2)])
def test_streamed_equals_blocks(spark, tmp_path, n, shards, doc_block, k):
    rng = random.Random(n)
    papers = corpus(spark, n, rng)
    config = SearchConfig(shards=shards, bm25_per_shard=k, vectors_per_shard=k, shortlist=4 * k, doc_block=doc_block, query_block=16)
    typed = [" ".join(rng.choices([*WORDS, "unknown", "Graph"], k=rng.randint(1, 4))) for _ in range(40)] + ["the the of", "!!", " ", None, "GRAPH the", "the graph"]
    asked = spark.createDataFrame([(i, q, i % 4, (0, 3, 100, -1)[i % 4] if i % 3 else None) for i, q in enumerate(typed)], "request_id int, query string, page int, size int")
    found = search_batches(write_lists(papers, f"file://{tmp_path}/lists", config), asked)
    row = lambda r: (r.request_id, r.rank, r.line_no, round(r.score, 9))
    wanted = sorted(map(row, search_many(build_index(papers, config), asked, config).collect()))
    assert sorted(map(row, found.collect())) == wanted and wanted


def test_dictionary_of_lists(spark, tmp_path):
    papers = corpus(spark, 30, random.Random(5))
    lists = write_lists(papers, str(tmp_path / "lists"), SearchConfig(shards=2, doc_block=7))
    assert sorted(lists.dictionary().collect()) == sorted(word_frequency(papers).collect())


@pytest.mark.parametrize("name", ["search_batch", "search_corrected"])
def test_many_requests_shuffle_no_candidates(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan and "MapInArrow" in plan
