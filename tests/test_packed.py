import json

from paperloom.operators.packed import Parser, PackedOptions, form, learn_codes, skeleton, split_packed

NAMES = ["Ada Lumen", "Bo K. Varda", "Cy van Dorn", "Dee Orlo", "Eli Q. Marn", "Fay Toller", "Gus Weir", "Hal Y. Inger", "Ida Jarvis", "Jo de la Kest"]


def packed(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "k bigint, a string")


def corpus():
    out = []
    for i in range(0, 400):
        a, b, c = (NAMES[(i * m + 1) % 10] for m in (1, 3, 7))
        out += [f"{a}, {b}, {c}", f"{a}; {b}; {c}", f"{a} and {b}", f"{a}, {b} and {c}", json.dumps([a, b]), f"{a} | {b}", f'"{a}","{b}"', a]
        last, first = b.split()[-1], b.split()[0]
        if i % 4 == 0:
            out += [f"{last}, {first}; {a}", f"{a}; {b}, Jr.", "Solva Laboratory for Data and Nets; " + a, f"{last}, {first}"]
    return out


def split(spark, rows):
    df = packed(spark, corpus() + rows)
    n = len(corpus())
    got = {}
    for r in split_packed(df, "k", "a").where(f"k >= {n}").collect():
        got.setdefault(r.k - n, []).append((r.pos, r.value))
    return [[v for _, v in sorted(got.get(i, []))] for i in range(len(rows))]


def test_dialects(spark):
    cases = {
        "Ada Lumen, Bo K. Varda,Gus Weir": ["Ada Lumen", "Bo K. Varda", "Gus Weir"],
        "Ada Lumen; ; Bo K. Varda;": ["Ada Lumen", "Bo K. Varda"],
        "Lumen, Ada; Bo K. Varda": ["Lumen, Ada", "Bo K. Varda"],
        "Lumen, Ada": ["Lumen, Ada"],
        "Ada Lumen, Jr., Bo K. Varda": ["Ada Lumen, Jr.", "Bo K. Varda"],
        "['Ada Lumen', \"Bo O'Varda\"]": ["Ada Lumen", "Bo O'Varda"],
        '["D\\u00e9e Orlo", "Fay Toller"]': ["Dée Orlo", "Fay Toller"],
        "Ada Lumen  and Bo K. Varda, et al.": ["Ada Lumen", "Bo K. Varda"],
        "Ada Lumen (1; 2), Bo K. Varda (Dept. of X, Y)": ["Ada Lumen", "Bo K. Varda"],
        '"Lumen, Ada","Fay Toller"': ["Lumen, Ada", "Fay Toller"],
        'Ada "Addy" Lumen, Fay Toller': ['Ada "Addy" Lumen', "Fay Toller"],
        "Ada Lumen and Solva Laboratory for Data and Nets": ["Ada Lumen", "Solva Laboratory for Data and Nets"],
        "Ada Lumen\r\nBo K.  Varda": ["Ada Lumen", "Bo K. Varda"],
        "Ada Lumen, Fay Toller; Gus Weir and Dee Orlo": ["Ada Lumen", "Fay Toller", "Gus Weir", "Dee Orlo"],
    }
    assert split(spark, list(cases)) == list(cases.values())


def test_fields_without_values(spark):
    assert split(spark, ["", "   ", None, "[]", '[""]', "et al.", ";;", "(note)"]) == [[]] * 8


def test_long_field_and_ties(spark):
    rows = ["; ".join(NAMES * 2000), "Ada Lumen, Ada Lumen"]
    long, same = split(spark, rows)
    assert long == NAMES * 2000 and same == ["Ada Lumen", "Ada Lumen"]


def test_empty_table_null_key_and_clashing_columns(spark):
    assert split_packed(packed(spark, []), "k", "a").count() == 0
    df = spark.createDataFrame([(None, "Ada Lumen, Fay Toller", 1, "z")], "k string, value string, pos int, field string")
    got = split_packed(df, "k", "value")
    assert [(r.k, r.pos, r.value) for r in got.orderBy("pos").collect()] == [(None, 1, "Ada Lumen"), (None, 2, "Fay Toller")]


def test_skeletons_have_the_same_parse(spark):
    parser = learn_codes(packed(spark, corpus()), "a", PackedOptions())
    for f in corpus()[:300]:
        cheapest = min(parser.scored(f), key=lambda x: x[0])
        assert parser.best(f) == (cheapest[1], cheapest[2])
        assert [form(v) for v in parser.best(f)[1]] == [form(v) for v in Parser.best(parser, skeleton(f))[1]]


def test_carried_columns(spark):
    from pyspark.sql import functions as F

    got = split_packed(packed(spark, ["Ada Lumen; Fay Toller"]), "k", "a", carried={"twice": F.col("k") * 2 + 1})
    assert [(r.value, r.twice) for r in got.orderBy("pos").collect()] == [("Ada Lumen", 1), ("Fay Toller", 1)]


def test_a_value_of_many_pieces(spark):
    long = "Institute for Data, Nets, Graphs, Trees and Words, Solva"
    parser = learn_codes(packed(spark, corpus() + [f"{long}; {NAMES[i % 10]}" for i in range(400)]), "a", PackedOptions())
    assert parser.best(f"Ada Lumen, {long}, Fay Toller")[1] == ["Ada Lumen", long, "Fay Toller"]
    assert parser.best(", ".join(NAMES * 500))[1] == NAMES * 500
