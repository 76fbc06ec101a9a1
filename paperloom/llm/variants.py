"""Variant spellings of names typed by people: a metric-space join, then evidence, then components.

1. Each distinct name is parsed (``names.parts``). Two words in unclear order are ordered by how often the
   corpus uses each of them as family or given name where the order is clear.
2. *Metric-space partitioning.* Distinct family names (for organisations the proper name) are objects of the
   metric space of the unrestricted Damerau-Levenshtein distance. Every object goes to its nearest pivot; since
   ``d(y, p) <= d(y, home(y)) + 2r`` holds for every partner ``y`` within radius ``r`` of an object of
   pivot ``p``, exactly the objects on that side of the boundary are replicated to ``p``'s cell. An exact
   radius join runs inside each cell; a cell's own objects are cut into blocks, which bounds a task's index;
   all objects of the cell are looked up in each block. There are at least ``least_pivots`` cells, whatever the size.
3. Names whose families are partners and whose given names agree (equal, initial, nickname or one edit) are
   candidates. They are linked if they share people they write with, or if those people write with each
   other, or, where a name stands nearly alone, if they work in the same category. A name with initials only
   follows its strongest partner.
4. The links' components are the entities.

Pivots are fitted on a sample of at most ``pivot_sample`` distinct objects; everything else covers all
rows. Nicknames come from the corpus (``Michael "Mike" Name``) and from a short fixed list.

Edge cases: null and blank names are ignored; a co-author counts once however often a row is repeated; an empty table gives an empty
result; names without letters have no parts and match only themselves; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from paperloom.llm.graph import components
from paperloom.llm.names import damerau, damerau_many, encode, parts
from paperloom.runtime import materialize

#: Common short forms of given names (short form, name). Where a form stands for several names, the corpus decides.
NICKNAMES = (
    ("abe", "abraham"), ("al", "albert"), ("alex", "alexander"), ("andy", "andrew"), ("becky", "rebecca"), ("ben", "benjamin"),
    ("beppe", "giuseppe"), ("bert", "albert"), ("beth", "elizabeth"), ("betty", "elizabeth"), ("bill", "william"), ("bob", "robert"),
    ("cathy", "catherine"), ("cathy", "katherine"), ("cathy", "katharina"), ("charlie", "charles"), ("chris", "christopher"), ("chuck", "charles"), ("dan", "daniel"), ("dave", "david"),
    ("debbie", "deborah"), ("dick", "richard"), ("dima", "dmitri"), ("dora", "dorothea"), ("dora", "theodora"), ("ed", "edward"), ("eddie", "edward"),
    ("fred", "frederick"), ("fred", "alfred"), ("fred", "frederik"), ("fritz", "friedrich"), ("greg", "gregory"), ("hank", "henry"), ("hannes", "johannes"), ("hans", "johannes"),
    ("harry", "henry"), ("jack", "john"), ("jan", "johannes"), ("jeff", "jeffrey"), ("jim", "james"), ("joe", "joseph"),
    ("kate", "katherine"), ("kate", "catherine"), ("kate", "katharina"), ("kathi", "katharina"), ("katja", "katharina"), ("katya", "ekaterina"), ("ken", "kenneth"), ("kit", "christopher"),
    ("larry", "lawrence"), ("lena", "magdalena"), ("leni", "magdalena"), ("liz", "elizabeth"), ("maggie", "margaret"), ("magda", "magdalena"), ("matt", "matthew"),
    ("meg", "margaret"), ("micha", "michael"), ("mick", "michael"), ("mike", "michael"), ("ned", "edward"), ("nick", "nicholas"), ("paco", "francisco"),
    ("pancho", "francisco"), ("pat", "patricia"), ("peggy", "margaret"), ("pepe", "jose"), ("pete", "peter"), ("rich", "richard"), ("rick", "richard"), ("rik", "richard"), ("rik", "hendrik"), ("rik", "frederik"),
    ("rob", "robert"), ("sam", "samuel"), ("sam", "samantha"), ("sanne", "susanne"), ("sasha", "alexander"), ("sepp", "joseph"), ("steve", "steven"),
    ("sue", "susanne"), ("susi", "susanne"), ("ted", "edward"), ("theo", "theodore"), ("theo", "theodor"), ("theo", "theodora"), ("tim", "timothy"), ("tom", "thomas"), ("tony", "anthony"),
    ("vicky", "victoria"), ("will", "william"),
)


@dataclass(frozen=True)
class VariantOptions:
    radius: int = 1
    objects_per_pivot: int = 5000
    least_pivots: int = 4
    max_pivots: int = 512
    pivot_sample: int = 4000
    block: int = 20_000
    hop_share: float = 0.15
    alone: int = 3


def _pivots(objects: list[str], count: int) -> list[str]:
    """Farthest-first over a bounded sample, from the least object."""
    if not objects:
        return []
    codes, lengths = encode(objects)
    chosen = [0]
    nearest = damerau_many(objects[0], codes, lengths)
    while len(chosen) < min(count, len(objects)):
        k = int(np.argmax(nearest))
        if nearest[k] == 0:
            break
        chosen.append(k)
        nearest = np.minimum(nearest, damerau_many(objects[k], codes, lengths))
    return [objects[k] for k in chosen]


def _shortened(x: str, r: int) -> set[str]:
    """``x`` with up to ``r`` letters left out: strings within distance ``r`` have one of these in common."""
    found = level = {x}
    for _ in range(r):
        level = {y[:i] + y[i + 1 :] for y in level for i in range(len(y))}
        found = found | level
    return found


def radius_join(objects: DataFrame, column: str, options: VariantOptions = VariantOptions()) -> DataFrame:
    """All pairs ``(a, b, d)``, ``a < b``, of distinct non-null values within the radius, by pivots and cells."""
    r = options.radius
    values = materialize(objects.select(F.col(column).alias("x")).where("x is not null and x <> ''").distinct(), "metric-objects")
    n = values.count()
    sample = [row.x for row in values.orderBy(F.xxhash64("x"), "x").limit(options.pivot_sample).collect()]
    pivots = _pivots(sorted(sample), max(options.least_pivots, min(options.max_pivots, n // options.objects_per_pivot)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xs = f["x"].tolist()
            codes, lengths = encode(xs)
            d = np.stack([damerau_many(p, codes, lengths) for p in pivots], 1) if xs else np.zeros((0, len(pivots)), np.int32)
            home = d.argmin(1)
            near = d <= d.min(1, keepdims=True) + 2 * r
            row, cell = np.nonzero(near)
            yield pd.DataFrame({"cell": cell, "x": [xs[i] for i in row], "own": home[row] == cell})

    placed = materialize(values.mapInPandas(assign, "cell int, x string, own boolean"), "metric-cells")
    blocks = placed.groupBy("cell").agg(F.sum(F.col("own").cast("long")).alias("owned")).where("owned > 0").select("cell", F.ceil(F.col("owned") / options.block).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(blocks), "cell")  # one row a pivot: at most max_pivots
    everyone = placed.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "x", F.when(F.col("own"), F.pmod(F.xxhash64("x"), F.col("blocks"))).alias("home"))

    def join(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        # the cell's own objects are indexed; every object of the cell looks for them
        index: dict[str, list[str]] = {}
        for x in f["x"][f["home"] == key[1]]:
            for v in _shortened(x, r):
                index.setdefault(v, []).append(x)
        out: list[tuple[str, str, int]] = []
        for y in f["x"]:
            for x in {x for v in _shortened(y, r) for x in index.get(v, ())} - {y}:
                if (d := damerau(x, y)) <= r:
                    out.append((min(x, y), max(x, y), d))
        return pd.DataFrame(out, columns=["a", "b", "d"])

    return everyone.groupBy("cell", "block").applyInPandas(join, "a string, b string, d int").distinct()


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [parts(x) for x in f["name"]]
        yield pd.DataFrame([(n, *p) for n, p in zip(f["name"], rows, strict=True)], columns=["name", "kind", "family", "given", "middle", "suffix", "nick"])


def parse_names(names: DataFrame) -> DataFrame:
    """``(name, kind, family, given, middle, canon, initials)`` of each distinct name, order and nicknames resolved."""
    parsed = materialize(names.mapInPandas(_parse, "name string, kind string, family string, given string, middle string, suffix string, nick string"), "names")
    clear, unclear = F.col("kind") == "p", F.col("kind") == "u"
    uses = parsed.select(
        F.explode(
            F.array(
                F.struct(F.col("given").alias("token"), (clear & (F.length("given") > 1)).cast("double").alias("g"), F.lit(0.0).alias("f"), unclear.cast("double").alias("ug"), F.lit(0.0).alias("uf")),
                F.struct(F.col("family").alias("token"), F.lit(0.0).alias("g"), clear.cast("double").alias("f"), F.lit(0.0).alias("ug"), unclear.cast("double").alias("uf")),
            )
        ).alias("u")
    ).select("u.*")
    roles = uses.where("token <> ''").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("g", "f", "ug", "uf")]).select("token", F.ln((F.col("g") + 0.2 * F.col("ug") + 0.1) / (F.col("f") + 0.2 * F.col("uf") + 0.1)).alias("as_given"))
    known = parsed.join(roles.select(F.col("token").alias("given"), F.col("as_given").alias("gg")), "given", "left").join(roles.select(F.col("token").alias("family"), F.col("as_given").alias("fg")), "family", "left")
    flip = unclear & (F.col("fg") > F.col("gg")) & (F.col("nick") == "") & (F.col("suffix") == "")
    ordered = known.select(
        "name",
        F.when(unclear, "p").otherwise(F.col("kind")).alias("kind"),
        F.when(flip, F.col("given")).otherwise(F.col("family")).alias("family"),
        F.when(flip, F.col("family")).otherwise(F.col("given")).alias("given"),
        "middle",
        "nick",
    )
    # of a form's names the one that the corpus spells out most often; one that it never does may still stand alone
    spelled = ordered.where("length(given) > 1").groupBy(F.col("given").alias("full")).agg(F.count("*").alias("used"))
    fixed = F.broadcast(names.sparkSession.createDataFrame(list(NICKNAMES), "nick string, full string")).join(spelled, "full", "left")  # a fixed list
    fixed = fixed.groupBy("nick").agg(F.max_by("full", F.struct(F.coalesce("used", F.lit(0)), "full")).alias("full")).withColumn("n", F.lit(1))
    heard = ordered.where("nick <> '' and length(given) > 1").groupBy("nick", F.col("given").alias("full")).agg((F.count("*") + 1).cast("int").alias("n"))
    short = fixed.unionByName(heard).groupBy("nick").agg(F.max_by("full", F.struct("n", "full")).alias("full"))
    return ordered.drop("nick").join(short.withColumnRenamed("nick", "given"), "given", "left").withColumn("canon", F.coalesce("full", "given")).withColumn("initials", F.array_distinct(F.array(F.substring("given", 1, 1), F.substring("canon", 1, 1)))).drop("full")


@F.pandas_udf(BooleanType())
def _given_agree(a: pd.Series, ca: pd.Series, b: pd.Series, cb: pd.Series) -> pd.Series:
    def one(x: str, cx: str, y: str, cy: str) -> bool:
        if x == y or cx == cy:
            return True
        if not x or not y:
            return False
        px, py = x.split(), y.split()
        if all(len(t) == 1 for t in px) or all(len(t) == 1 for t in py):
            ix, iy = [t[0] for t in px], [t[0] for t in py]
            return ix == iy or (len(ix) == 1 or len(iy) == 1) and ix[0] == iy[0] or cx[0] == cy[0] and (len(x) == 1 or len(y) == 1)
        return x[0] == y[0] and min(len(x), len(y)) >= 2 and damerau(x, y) <= 1

    return pd.Series([one(*t) for t in zip(a, ca, b, cb, strict=True)], dtype="boolean")


def link_variants(authors: DataFrame, name: str, work: str, category: str, options: VariantOptions = VariantOptions()) -> DataFrame:
    """``(node, component)``: each spelling that has a variant, with its entity's least spelling.

    ``authors`` has one row per author ``name`` of a ``work`` in a ``category`` (may be null).
    """
    # evidence is kept by 64-bit hashes of names, families and categories
    rows = authors.select(F.col(f"`{name}`").alias("name"), F.col(f"`{work}`").alias("work"), F.col(f"`{category}`").alias("c")).where("trim(name) <> '' and work is not null")
    rows = materialize(rows.select("name", F.xxhash64("name").alias("nid"), "work", F.when(F.col("c") != "", F.xxhash64("c")).alias("category")), "author-rows")
    known = materialize(parse_names(rows.select("name").distinct()).withColumn("nid", F.xxhash64("name")), "parsed-names")
    pairs = materialize(radius_join(known, "family", options), "family-pairs")
    families = known.select(F.col("family").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("d"))
    near = families.unionByName(pairs).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).where("a <> ''")

    own = lambda s: known.select(*[F.col(c).alias(c + s) for c in ("name", "kind", "family", "given", "middle", "canon", "initials")], F.explode("initials").alias("initial" + s))
    found = own("_a").join(near.withColumnsRenamed({"a": "family_a", "b": "family_b"}), "family_a").join(own("_b"), "family_b")
    middle = (F.col("middle_a") == "") | (F.col("middle_b") == "") | (F.substring("middle_a", 1, 1) == F.substring("middle_b", 1, 1))
    # a pair with two initials in common meets at the lesser one only
    first = F.array_min(F.array_intersect("initials_a", "initials_b"))
    found = found.where("name_a < name_b and kind_a = kind_b and initial_a = initial_b").where(middle).where(F.col("initial_a") == first)
    # compared before the UDF, for it has to see few rows
    found = found.where(_given_agree("given_a", "canon_a", "given_b", "canon_b"))
    found = materialize(found.select("name_a", "name_b", "family_a", "family_b", "given_a", "given_b", "canon_a", "canon_b", "d"), "name-candidates")

    member = rows.select("nid", "work").join(known.where("family <> ''").select("nid", F.xxhash64("family").alias("family")), "nid").select("work", F.col("nid").alias("name"), "family")
    met = member.join(member.select("work", F.col("family").alias("other")).distinct(), "work").where("family <> other").select("name", "family", "other").distinct()
    met = materialize(met, "met")
    sizes = met.groupBy("name").agg(F.count("*").alias("n_met"))
    worked = rows.where("category is not null").groupBy(F.col("nid").alias("name"), "category").agg(F.count("*").alias("n")).groupBy("name").agg(F.max(F.struct("n", "category")).alias("m")).select("name", F.col("m.category").alias("main"))
    context = materialize(known.select(F.col("nid").alias("name")).join(sizes, "name", "left").join(worked, "name", "left").fillna({"n_met": 0}), "contexts")

    met_a, met_b = met.select(F.col("name").alias("name_a"), F.col("other").alias("x")), met.select(F.col("name").alias("name_b"), F.col("other").alias("y"))
    found = found.withColumnsRenamed({"name_a": "text_a", "name_b": "text_b"}).withColumns({f"name_{s}": F.xxhash64(f"text_{s}") for s in "ab"}).withColumn("family_b", F.xxhash64("family_b"))
    shared = found.select("name_a", "name_b").join(met_a, "name_a").join(met_b, [F.col("x") == F.col("y"), found["name_b"] == met_b["name_b"]]).groupBy(found["name_a"], found["name_b"]).agg(F.count("*").alias("shared"))
    judged = found.join(shared, ["name_a", "name_b"], "left").fillna({"shared": 0})
    for s in "ab":
        judged = judged.join(context.select(F.col("name").alias(f"name_{s}"), F.col("n_met").alias(f"met_{s}"), F.col("main").alias(f"main_{s}")), f"name_{s}")
    judged = materialize(judged.withColumn("same", F.coalesce(F.col("main_a") == F.col("main_b"), F.lit(False))), "judged")
    hop = met.select(F.col("family").alias("x"), F.col("other").alias("y")).distinct()
    open_pairs = judged.where("(shared = 0 or shared = 1 and not same) and met_a > 0 and met_b > 0").select("name_a", "name_b", "family_b")
    hops = open_pairs.join(met_a, "name_a").where("x <> family_b").join(hop, "x").join(met_b, ["name_b", "y"]).groupBy("name_a", "name_b").agg(F.count("*").alias("hops"))
    judged = judged.join(hops, ["name_a", "name_b"], "left").fillna({"hops": 0})
    share = F.col("hops") / F.greatest(F.lit(1), F.col("met_a") * F.col("met_b"))
    alike = (F.col("d") == 0) & (F.col("canon_a") == F.col("canon_b")) & (F.length("given_a") > 1) & (F.length("given_b") > 1)
    accepted = (
        ((F.col("shared") >= 1) & (F.col("same") | alike | (F.col("shared") >= 2) | (F.least("met_a", "met_b") <= options.alone) | (share >= options.hop_share * 4 / 3)))
        | (alike & F.col("same"))
        | ((share >= options.hop_share) & F.col("same"))
        | (share >= 2 * options.hop_share)
        | (F.col("same") & (F.least("met_a", "met_b") <= 1) & (F.col("met_a") * F.col("met_b") <= options.alone))
    )
    score = F.col("shared") * 2.0 + share + F.col("same").cast("double") - 0.25 * F.col("d")
    links = materialize(judged.where(accepted).select(F.col("text_a").alias("name_a"), F.col("text_b").alias("name_b"), "given_a", "given_b", "canon_a", "canon_b", score.alias("score")), "judged-links")
    # a name of initials only keeps the partners whose given name agrees with that of its strongest partner
    brief = lambda c: F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) <= F.size(F.split(F.col(c), " "))
    spelled = links.where(brief("given_a") & ~brief("given_b")).select(F.col("name_a").alias("name"), F.col("canon_b").alias("canon"), "score")
    spelled = spelled.unionByName(links.where(brief("given_b") & ~brief("given_a")).select(F.col("name_b").alias("name"), F.col("canon_a").alias("canon"), "score"))
    best = spelled.groupBy("name").agg(F.max_by("canon", F.struct("score", "canon")).alias("best"))
    links = links.join(best.withColumnsRenamed({"name": "name_a", "best": "best_a"}), "name_a", "left").join(best.withColumnsRenamed({"name": "name_b", "best": "best_b"}), "name_b", "left")
    side_a = brief("given_b") | F.col("best_a").isNull() | (F.levenshtein(F.col("best_a"), F.col("canon_b"), 1) >= 0)
    side_b = brief("given_a") | F.col("best_b").isNull() | (F.levenshtein(F.col("best_b"), F.col("canon_a"), 1) >= 0)
    both = ~(brief("given_a") & brief("given_b")) | F.col("best_a").isNull() | F.col("best_b").isNull() | (F.levenshtein(F.col("best_a"), F.col("best_b"), 1) >= 0)
    return components(links.where(side_a & side_b & both), "name_a", "name_b")


def variant_pairs(entities: DataFrame) -> DataFrame:
    """Each pair ``(name_a, name_b)`` of spellings of one entity, ``name_a < name_b``."""
    left = entities.select("component", F.col("node").alias("name_a"))
    return left.join(entities.select("component", F.col("node").alias("name_b")), "component").where("name_a < name_b").select("name_a", "name_b")
