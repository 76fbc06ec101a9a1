import re
from collections import Counter

from pyspark.sql import functions as F

from paperloom.llm.terms import TermStore, changes, term_delta

SCHEMA = "k bigint, title string, abstract string, term string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, a, "clash") for k, t, a in rows], SCHEMA)


def brute(rows):
    occ, rec = Counter(), Counter()
    for _, t, a in rows:
        for f, x in (("title", t), ("abstract", a)):
            ws = re.findall(r"\w+", (x or "").lower())
            occ.update((f, w) for w in ws)
            rec.update((f, w) for w in set(ws))
    return {(f, w, n, rec[f, w]) for (f, w), n in occ.items()}


def state(store):
    return {tuple(r) for r in store.counts().collect()}


ROWS = [(1, "Graph graph", "a b"), (2, None, "b"), (3, "", None), (4, "Graph", "b " * 3000), (4, "Graph", "c")]


def test_counts_and_marks(spark):
    store = TermStore(spark)
    store.merge(term_delta(table(spark, ROWS), ["title", "abstract"]))
    assert state(store) == brute(ROWS) and store.total() == 5
    marks = {(r.field, r.term): r.band for r in store.marks(1, 0.5).collect()}
    assert marks == {("title", "graph"): "common", ("abstract", "a"): "rare", ("abstract", "b"): "common", ("abstract", "c"): "rare"}
    assert {r.term for r in store.marks(0, 0.6).collect()} == set()  # exactly at the limit is not too common


def test_signed_deltas_equal_a_recount(spark):
    store = TermStore(spark)
    old = [(1, "a b", "x"), (2, "b c", None), (3, "gone", "gone gone")]
    new = [(1, "a b", "x"), (2, "b d", "y"), (4, "a", "")]
    store.merge(term_delta(table(spark, old), ["title", "abstract"]))
    turned = changes(table(spark, old), table(spark, new), "k", ["title", "abstract"])
    assert {(r.sign, r.title) for r in turned.collect()} == {(-1, "b c"), (1, "b d"), (-1, "gone"), (1, "a")}
    store.merge(term_delta(turned, ["title", "abstract"], F.col("sign")))
    assert state(store) == brute(new) and store.total() == 3


def test_everything_deleted_and_empty_batches(spark):
    store = TermStore(spark)
    store.merge(term_delta(table(spark, ROWS), ["title", "abstract"]))
    store.merge(term_delta(table(spark, []), ["title", "abstract"]))
    assert state(store) == brute(ROWS)
    store.merge(term_delta(table(spark, ROWS), ["title", "abstract"], -1))
    assert state(store) == set() and store.total() == 0
    empty = TermStore(spark)
    empty.merge(term_delta(table(spark, []), ["title"]))
    assert state(empty) == set() and empty.marks().count() == 0


def test_a_merge_that_dies_changes_nothing_and_a_batch_counts_once(spark, monkeypatch):
    store = TermStore(spark, bucket_terms=1)
    assert store.merge(term_delta(table(spark, ROWS[:3]), ["title", "abstract"]), "one")
    late = term_delta(table(spark, ROWS[3:]), ["title", "abstract"])
    monkeypatch.setattr(TermStore, "_commit", lambda self, manifest: 1 / 0)  # all buckets are written, the manifest is not
    try:
        store.merge(late, "two")
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert state(store) == state(TermStore(spark, store.path)) == brute(ROWS[:3])
    again = TermStore(spark, store.path)
    assert again.merge(late, "two") and not again.merge(late, "two") and not again.merge(late, "one")
    assert state(again) == brute(ROWS) and again.total() == 5
    assert again.drop_old() > 0 and state(TermStore(spark, store.path)) == brute(ROWS)
