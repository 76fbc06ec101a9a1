import random
import unicodedata

from pyspark.sql import functions as F

from paperloom.llm.lookalike import _tables, cluster_forms, consistent_form, lookalike_pairs


def reference(s):
    made_of = dict(_tables()[0])
    return unicodedata.normalize("NFC", "".join("".join(made_of.get(c, [c])) for c in s))


def test_clusters_equal_a_plain_normalisation(spark):
    r = random.Random(5)
    letters = "aeouAxсоеν" + "̧̨̣́̀̈̄̂ͅ" + "éüắΆ각ﬁＡ​ᅡᄀᆨ 𝐀ｶﾞ"
    cases = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(1500)})
    got = {x.cluster: x.form for x in cluster_forms(spark.createDataFrame([(s,) for s in cases], "cluster string")).collect()}
    assert [s for s in cases if got[s] != reference(s)] == []


def forms(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k bigint, t string, form string")
    return {r.k: r.f for r in consistent_form(df, "k", "t", "f", **more).collect()}


SAME = ["Café ﬁne A1 - x", "Café fine​ Ａ１ ‐ x", "Саfé fi­ne Α１ - х"]
APART = ["l", "1", "I", "O", "0", "é", "e", "E", "ß", "ss", "²", "2", "½", "1/2", "я", "α", "a", "“", '"', "–", "-", "\n", " ", "", "ł"]


def test_same_and_apart(spark):
    got = forms(spark, [*SAME, *APART, None, SAME[0]])
    assert {got[i] for i in range(3)} == {"Café fine A1 - x"} and got[len(SAME) + len(APART)] is None
    assert len({got[3 + i] for i in range(len(APART))}) == len(APART)


def test_both_ways_to_replace_agree(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abc \nе́éｘ​ﬁ각") for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", "plain", "é" * 50_000 + "́"]
    a, b = forms(spark, texts), forms(spark, texts, broadcast_bytes=-1)
    assert a == b and all(a[i] == (None if t is None else reference(t)) for i, t in enumerate(texts))


def test_pairs(spark):
    texts = [*SAME, SAME[0], "Cafe fine A1 - x", None, "", "​", "other", "other"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k bigint, t string, a string")
    assert {(r.a, r.b) for r in lookalike_pairs(df, "k", "t").collect()} == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}


def test_empty(spark):
    df = spark.createDataFrame([], "k bigint, t string")
    assert consistent_form(df, "k", "t").count() == 0 and lookalike_pairs(df, "k", "t").count() == 0


def test_no_number_bounds_the_marks_of_a_letter(spark):
    """By the plan, as a letter with over a million marks takes more memory than tests have; and some thousand marks stay whole."""
    n = 3000
    got = cluster_forms(spark.createDataFrame([("a" + "\u0301" * n,)], "cluster string"))
    assert "1000000" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.select(F.length("form"), F.substring("form", 1, 1)).first()[:] == (n, "\u00e1")
