import random

from paperloom.llm.graph import components
from paperloom.llm.names import damerau, damerau_many, encode, parts
from paperloom.llm.variants import VariantOptions, link_variants, radius_join, variant_pairs


def words(n, seed=1, letters="abcd", most=7):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(1, most))) for _ in range(n)})


def test_metric():
    xs = words(120)
    codes, lengths = encode(xs)
    for x in xs[:40]:
        assert damerau_many(x, codes, lengths).tolist() == [damerau(x, y) for y in xs]
    r = random.Random(2)
    for _ in range(3000):
        a, b, c = r.choice(xs), r.choice(xs), r.choice(xs)
        assert damerau(a, c) <= damerau(a, b) + damerau(b, c)
    assert damerau("ca", "abc") == 2 and damerau("ab", "ba") == 1 and damerau("", "abc") == 3


def test_radius_join_is_exact(spark):
    for seed, options in ((1, VariantOptions(objects_per_pivot=20, block=30)), (2, VariantOptions(radius=2, objects_per_pivot=50, block=10_000)), (3, VariantOptions())):
        xs = words(250, seed, "abcdefgh", 8)
        got = {(r.a, r.b, r.d) for r in radius_join(spark.createDataFrame([(x,) for x in [*xs, xs[0], None, ""]], "x string"), "x", options).collect()}
        assert got == {(a, b, damerau(a, b)) for i, a in enumerate(xs) for b in xs[i + 1 :] if damerau(a, b) <= options.radius}
    assert radius_join(spark.createDataFrame([], "x string"), "x").count() == 0


def test_parts():
    assert parts("de la Hora, R.")[:3] == ("p", "de la hora", "r")
    assert parts("Jean-Luc Krama, Jr.")[1:5] == ("krama", "jean luc", "", "jr")
    assert parts("Ana van Holm")[:3] == ("p", "van holm", "ana")
    assert parts("The Solva Lab. for Data & Nets")[:3] == parts("Solva, Laboratory for Data and Nets")[:3]
    assert parts("Bill")[0] == "p" and parts("???")[1] == ""


def linked(spark, rows):
    df = spark.createDataFrame([(w, n, c, "x") for w, n, c in rows], "w bigint, n string, c string, name string")
    return {(r.name_a, r.name_b) for r in variant_pairs(link_variants(df, "n", "w", "c")).collect()}


def test_variants_follow_context(spark):
    rows = []
    for w, (name, mates, cat) in enumerate(
        [
            ("Robert Lumen", ["Ada Vardo", "Cy Dorn"], "db"),
            ("Lumen, Robert", ["Ada Vardo"], "db"),
            ("R. Lumen", ["Cy Dorn", "Ada Vardo"], "db"),
            ("Bob Lumen", ["Cy Dorn"], "db"),
            ("Robert Lumne", ["Ada Vardo", "Cy Dorn"], "db"),
            ("ROBERT LUMEN", ["Ada Vardo"], "db"),
            ("Rita Lumen", ["Fay Toller", "Gus Weir"], "ai"),
            ("Lumen Rita", ["Fay Toller"], "ai"),
            ("Robert Lumeg", ["Hal Inger", "Ida Jarvis"], "se"),
            ("Solva Laboratory for Data and Nets", ["Hal Inger"], "se"),
            ("Solva Lab for Data & Nets", ["Hal Inger"], "se"),
        ]
    ):
        for n in [name, *mates]:
            rows += [(w, n, cat)] * 2
    rows += [(100, None, "db"), (101, "  ", None), (None, "Nobody Here", "db")]
    rows += [(200 + i, f"Rita {x}", "zz") for i, x in enumerate(("Kolm", "Barsk", "Zent"))]
    got = linked(spark, rows)
    robert = {"Robert Lumen", "Lumen, Robert", "R. Lumen", "Bob Lumen", "Robert Lumne", "ROBERT LUMEN"}
    expected = {(a, b) for a in robert for b in robert if a < b} | {("Lumen Rita", "Rita Lumen"), ("Solva Lab for Data & Nets", "Solva Laboratory for Data and Nets")}
    assert got == expected


def test_empty(spark):
    assert linked(spark, []) == set()


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 1), (5, 5)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    least = {}
    for x in list(parent):
        least[find(x)] = min(x, least.get(find(x), x))
    got = {row.node: row.component for row in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: least[find(x)] for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_pairs_do_not_depend_on_the_number_of_pivots(spark):
    xs = spark.createDataFrame([(x,) for x in words(300, 7, "abcdefg", 9)], "x string")
    got = [{tuple(r) for r in radius_join(xs, "x", VariantOptions(least_pivots=n)).collect()} for n in (1, 4, 23)]
    assert got[0] == got[1] == got[2] and got[0]
