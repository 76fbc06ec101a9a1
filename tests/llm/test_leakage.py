import random

from paperloom.llm.leakage import Automaton, find_leaks, leaked_spans, remove_leaks, words_at, words_of


def test_automaton_equals_brute_force():
    r = random.Random(3)
    for _ in range(150):
        letters, run = "abcdef"[: r.randint(2, 6)], r.randint(2, 5)
        items = [(k, [r.choice(letters) for _ in range(r.randint(0, 9))]) for k in range(r.randint(0, 6))]
        a = Automaton(items, run)
        for _ in range(5):
            doc = [r.choice(letters + "z") for _ in range(r.randint(0, 40))]
            grams = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
            expected = {k for k, ws in items if ws and grams(ws, min(run, len(ws))) & grams(doc, min(run, len(ws)))}
            covered = {j + x for _, ws in items if ws for j in range(len(doc)) if tuple(doc[j : j + min(run, len(ws))]) in grams(ws, min(run, len(ws))) for x in range(min(run, len(ws)))}
            got, spans = a.spans(doc)
            assert got == expected
            assert {x for s, e in spans for x in range(s, e)} == covered
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def frames(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "Short ITEM", "x"), (3, None, "x"), (4, "", "x"), (5, "...", "x"), (6, ITEM, "x")], "item_id bigint, text string, form string")
    words = ITEM.split()
    docs = [
        (10, "intro, " + ITEM.upper().replace(" ", " - ") + "! outro"),
        (11, " ".join(words[:11])),
        (12, "x " + " ".join(words[:12])),
        (13, "a ｓhort​ item here"),
        (14, None),
        (15, ""),
        (16, "short shorter item"),
        (17, "lorem ipsum " * 40_000 + " ".join(words[1:]) + " end" * 5),
        (10, "again " + ITEM),
    ]
    return spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, form string"), items


def test_leaks(spark):
    docs, items = frames(spark)
    got = sorted((r.doc_id, r.item_id) for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(10, 1), (10, 1), (10, 6), (10, 6), (12, 1), (12, 6), (13, 2), (17, 1), (17, 6)]
    parts = sorted((r.doc_id, r.item_id) for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text", max_item_words=5).collect())
    assert parts == got


def test_spans_and_removal(spark):
    docs, items = frames(spark)
    one = docs.where("doc_id <> 10")
    spans = leaked_spans(one, "doc_id", "text", items, "item_id", "text")
    assert {(r.doc_id, r.first_word, r.last_word, r.doc_words) for r in spans.collect()} == {(12, 1, 12, 13), (13, 1, 2, 4), (17, 80_000, 80_011, 80_017)}
    clean = {r.doc_id: (r.clean, r.dropped) for r in remove_leaks(one, "doc_id", "text", spans).collect()}
    assert clean[12] == ("", True) and clean[13] == ("a  here", False) and clean[14] == (None, False) and clean[15] == ("", False) and clean[16][0] == "short shorter item"
    assert clean[17][0].endswith("ipsum  end end end end end")


def test_empty(spark):
    docs, items = frames(spark)
    assert find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_letters_whose_lower_case_is_longer(spark):
    """A dotted capital I becomes two characters, so places in the lowered text are not places in the text."""
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"İstanbul İİ. {ITEM} tail words here stay " + "more " * 30)], "doc_id bigint, text string")
    spans = leaked_spans(docs, "doc_id", "text", items, "item_id", "text")
    got = remove_leaks(docs, "doc_id", "text", spans).first()
    assert got.clean == "İstanbul İİ.  tail words here stay " + "more " * 30 and not got.dropped
    for text in ("İstanbul x", "abc İ", "ẞ Straße", ""):
        ws, at = words_at(text)
        assert ws == words_of(text) and len(ws) == len(at) and all(text[a:b].lower()[:1] == w.lower()[:1] for (a, b), w in zip(at, ws, strict=True))


def test_overlapping_spans_of_several_parts_count_once(spark):
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(8)]
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[8:] + b))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(a + b) + " y" * 40)], "doc_id bigint, text string")
    for most in (200_000, 20):
        spans = leaked_spans(docs, "doc_id", "text", items, "item_id", "text", max_item_words=most)
        assert remove_leaks(docs, "doc_id", "text", spans).first()[1:] == ("x " + " y" * 40, False)
