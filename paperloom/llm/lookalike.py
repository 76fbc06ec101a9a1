"""Visually identical text with different characters: one consistent form for all.

The form of a text drops invisible characters, makes every space of the line a plain space, full-width and half-width forms,
presentation ligatures and no-break forms their plain characters, and letters of other scripts that look the same
their Latin twins, and composes each base letter with its ordered accents. Case, accents, digits, signs and line
breaks stay, as do characters that merely resemble each other (``l``/``1``, ``O``/``0``, superscripts, fractions).

ASCII text is its own form. Of all other texts, the *clusters* (a character with the marks and invisible characters that
follow it, where any of them is beyond ASCII) are the only parts that can change. The distinct clusters of the whole corpus are exploded to
positioned code points; decomposition, combining class and look-alike tables are broadcast to them (they hold some 13,000
code points, fixed by the Unicode version); combining marks are ordered by class within their base; bases and marks are
recomposed pair by pair; and the clusters are rebuilt. Texts then replace each cluster by its form: where the
distinct changed clusters take less than ``broadcast_bytes``, by a broadcast mapping and without a shuffle, otherwise
by exploding the texts' pieces, joining and rebuilding.

Edge cases: a null text has a null form and an empty one an empty form; repeated rows repeat; an empty table gives an
empty result; a lone combining mark stays a mark of whatever precedes it; a text of any length is processed whole;
other columns are kept only if asked for.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.runtime import materialize

#: Letters that look like a Latin letter in common fonts (letter of another script, Latin twin).
TWINS = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ҮY ԌG ԚQ ԜW ӀI аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv ѴV ҽe ԍG "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϹC ϳj ͿJ "
    "օo ոn սu հh ցg զq ՕO ՍU ՏS ᎪA ᏴB ᏟC ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    "ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ ꓮA ɡg ‐- ‑- ˗- ﹣-"
).split()
#: Invisible characters beyond those of the general category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Compatibility characters that look like their decomposition: ligatures, dot leaders, Roman numerals, digraphs.
SAME_LOOK = [*range(0xFB00, 0xFB07), *range(0x2024, 0x2027), *range(0x2160, 0x2180), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)]


@lru_cache(1)
def _tables() -> tuple[list[tuple[str, list[str]]], list[tuple[str, int]], list[tuple[str, str, str]]]:
    """Mappings of single characters to what they are made of, combining classes, and pairs that compose."""
    twins = {w[0]: w[1] for w in TWINS}

    def take_apart(c: str) -> str:
        d = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs":
            return " "
        if not d:
            return c
        tag, _, rest = d.rpartition("> ") if d.startswith("<") else ("", "", d)
        if tag and not (tag[1:] in ("wide", "narrow", "noBreak") or ord(c) in SAME_LOOK):
            return c
        return "".join(take_apart(chr(int(x, 16))) for x in rest.split())

    made_of, classes, pairs = [], [], []
    for k in range(0x80, sys.maxunicode + 1):
        c = chr(k)
        cat = unicodedata.category(c)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cat == "Cf" and not (0x600 <= k <= 0x6DD or k in (0x70F, 0x8E2, 0x110BD)) or c in INVISIBLE:
            made_of.append((c, []))
            continue
        if 0xAC00 <= k <= 0xD7A3:
            parts = list(unicodedata.normalize("NFD", c))
        else:
            parts = [twins.get(x, x) for x in take_apart(c)]
        if parts != [c]:
            made_of.append((c, parts))
        # Korean vowels and finals follow their initial as marks of class 0 would
        ccc = unicodedata.combining(c) or (-1 if 0x1161 <= k <= 0x1175 or 0x11A8 <= k <= 0x11C2 else 0)
        if ccc:
            classes.append((c, ccc))
        d = unicodedata.decomposition(c)
        if 0xAC00 <= k <= 0xD7A3:
            whole = unicodedata.normalize("NFD", c)
            pairs.append((whole[0], whole[1], c) if len(whole) == 2 else (unicodedata.normalize("NFC", whole[:2]), whole[2], c))
        elif d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", c) == c:
            a, b = (chr(int(x, 16)) for x in d.split())
            pairs.append((a, b, c))
    # a twin's accented letters compose as the Latin ones, so pairs of twins are not needed
    return made_of, classes, pairs


@lru_cache(1)
def _followers() -> str:
    """All that belongs to the character before it: marks, invisible characters, Korean vowels and finals."""
    made_of, classes, _ = _tables()
    joined = {c for c, _ in classes}
    joined |= {c for c, parts in made_of if not parts or parts[0] in joined}
    joined |= {chr(k) for k in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(k)) in ("Mn", "Mc", "Me", "Cf")}
    return "".join(sorted(joined))


class _Clusters:
    """Finds and replaces clusters. Texts without any follower, most of them, have single characters only."""

    def __init__(self, followers: str):
        self.followers = frozenset(followers)
        ranges: list[list[int]] = []
        for k in map(ord, followers):
            if ranges and ranges[-1][1] == k - 1:
                ranges[-1][1] = k
            else:
                ranges.append([k, k])
        one = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges) + "]"
        self.cluster = re.compile(rf"[^\x00-\x7F]{one}*|[\x00-\x7F](?=[^\x00-\x7F]){one}+")
        self.run = re.compile(r"[^\x00-\x7F]+")

    def find(self, text: str | None) -> set[str]:
        if text is None or text.isascii():
            return set()
        letters = set(text)
        return {c for c in letters if c > "\x7f"} if self.followers.isdisjoint(letters) else set(self.cluster.findall(text))

    def replace(self, text: str | None, forms: dict[str, str]) -> str | None:
        if text is None or text.isascii():
            return text
        if self.followers.isdisjoint(set(text)):
            return self.run.sub(lambda m: "".join([forms.get(c, c) for c in m[0]]), text)
        return self.cluster.sub(lambda m: forms.get(m[0], m[0]), text)

    def pieces(self, text: str) -> list[str]:
        out, at = [], 0
        for m in self.cluster.finditer(text):
            out += [text[at : m.start()], m[0]] if at < m.start() else [m[0]]
            at = m.end()
        return [*out, text[at:]] if at < len(text) else out


def cluster_forms(clusters: DataFrame) -> DataFrame:
    """``(cluster, form)`` for each distinct string ``cluster``, by relational steps on code points."""
    spark = clusters.sparkSession
    made_of, classes, pairs = _tables()
    # rows carry a number, not the cluster, so that one of any length stays linear
    named = materialize(clusters.select("cluster", F.monotonically_increasing_id().alias("cid")), "clusters")
    parts_of = F.broadcast(spark.createDataFrame(made_of, "cp string, made array<string>"))
    class_of = F.broadcast(spark.createDataFrame(classes, "part string, ccc int"))
    composed = F.broadcast(spark.createDataFrame(pairs, "cur string, mark string, whole string"))
    # text to positioned code points, each replaced by what it is made of
    points = named.select("cid", F.posexplode(F.split("cluster", "")).alias("pos", "cp")).where("cp <> ''")
    points = points.join(parts_of, "cp", "left").select("cid", "pos", F.posexplode(F.coalesce("made", F.array("cp"))).alias("sub", "part"))
    by_place = Window.partitionBy("cid").orderBy("pos", "sub")
    after_jamo = F.coalesce(F.lag("part").over(by_place).between("\u1100", "\u11ff"), F.lit(False))
    points = points.join(class_of, "part", "left").withColumn("ccc", F.when((F.col("ccc") == -1) & ~after_jamo, 0).otherwise(F.coalesce("ccc", F.lit(0))))
    # marks belong to the last base before them; ordered by class, then by place
    points = points.withColumn("base", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(by_place)).withColumn("n", F.row_number().over(by_place))
    letter = F.struct(F.when(F.col("ccc") == 0, -2).otherwise(F.col("ccc")).alias("ccc"), "n", "part")
    bases = materialize(points.groupBy("cid", "base").agg(F.sort_array(F.collect_list(letter)).alias("l")).select("cid", "base", F.transform("l", lambda x: F.struct(x["part"].alias("part"), x["ccc"].alias("ccc"))).alias("l")), "bases")
    # recomposition, one mark at a time, of the distinct sequences that have marks
    todo = bases.where(F.size("l") > 1).select("l").distinct().select("l", F.get("l", F.lit(0))["part"].alias("cur"), F.slice("l", F.lit(2), F.size("l")).alias("marks"))
    rounds = 3  # no composed character holds more than three marks
    for _ in range(rounds):
        # a mark is blocked by an earlier one of the same class that stays
        free = F.filter(F.transform("marks", lambda m, i: F.struct(i.alias("i"), m["part"].alias("mark"), m["ccc"].alias("ccc"), F.coalesce(F.get("marks", i - 1)["ccc"] == m["ccc"], F.lit(False)).alias("blocked"))), lambda m: (~m["blocked"]) | (m["ccc"] == -1) & (m["i"] == 0))
        tried = todo.select("l", "cur", F.explode(free).alias("m")).select("l", "cur", "m.i", "m.mark").join(composed, ["cur", "mark"]).groupBy("l").agg(F.min_by(F.struct("i", "whole"), "i").alias("hit"))
        todo = todo.join(tried, "l", "left").select(
            "l",
            F.coalesce("hit.whole", "cur").alias("cur"),
            F.when(F.col("hit").isNull(), F.col("marks")).otherwise(F.filter("marks", lambda m, i: i != F.col("hit.i"))).alias("marks"),
        )
    done = todo.select("l", F.concat(F.col("cur"), F.array_join(F.transform("marks", lambda m: m["part"]), "")).alias("s"))
    rebuilt = bases.join(done, "l", "left").select("cid", "base", F.coalesce("s", F.array_join(F.transform("l", lambda x: x["part"]), "")).alias("s"))
    forms = rebuilt.groupBy("cid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base", "s"))), lambda x: x["s"]), "").alias("form"))
    return named.join(forms, "cid", "left").select("cluster", F.coalesce("form", F.lit("")).alias("form"))


def with_forms(df: DataFrame, text: str, carried: dict[str, Column], form: str = "form", broadcast_bytes: int = 48 << 20) -> DataFrame:
    """``form`` of every row's text, with the ``carried`` columns by their new names."""
    source = df.select(F.col(f"`{text}`").cast("string").alias(form), *[c.alias(name) for name, c in carried.items()])
    followers = _followers()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, seen = _Clusters(followers), set()
        for batch in batches:
            new = {c for t in batch.column(0).to_pylist() for c in clusters.find(t)} - seen
            seen |= new
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], names=["cluster"])

    other = F.col(form).rlike(r"[^\x00-\x7F]")
    clusters = source.where(other).select(form).mapInArrow(find, "cluster string").distinct()
    forms = materialize(cluster_forms(clusters).where("cluster <> form"), "cluster-forms")
    size = forms.agg(F.count("*").alias("n"), F.sum(F.octet_length("cluster") + F.octet_length("form")).alias("b")).first()
    if (size.b or 0) + 150 * size.n <= broadcast_bytes:
        mapping = {r.cluster: r.form for r in forms.toLocalIterator()}

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clusters = _Clusters(followers)
            for batch in batches:
                texts = [clusters.replace(t, mapping) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=batch.schema.names)

        return source.mapInArrow(replace, source.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = _Clusters(followers)
        for batch in batches:
            lists = [clusters.pieces(t) for t in batch.column(1).to_pylist()]
            rows = pa.array([i for i, x in enumerate(lists) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([i for x in lists for i in range(len(x))], pa.int32()), pa.array([p for x in lists for p in x], pa.string())], names=["_row", "pos", "cluster"])

    numbered = materialize(source.withColumn("_row", F.monotonically_increasing_id()), "form-source")
    pieces = numbered.where(other).select("_row", form).mapInArrow(cut, "_row bigint, pos int, cluster string")
    pieces = pieces.join(forms.withColumnRenamed("form", "_s"), "cluster", "left").select("_row", "pos", F.coalesce("_s", "cluster").alias("s"))
    whole = pieces.groupBy("_row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("_f"))
    return numbered.join(whole, "_row", "left").select(F.when(other, F.col("_f")).otherwise(F.col(form)).alias(form), *carried)


def consistent_form(df: DataFrame, key: str, text: str, form: str = "form", broadcast_bytes: int = 48 << 20) -> DataFrame:
    """``(key, form)`` of every row."""
    return with_forms(df, text, {key: F.col(f"`{key}`")}, form, broadcast_bytes).select(key, form)


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``(a, b)`` of keys, ``a < b``, of non-empty different texts that have the same form.

    Copies of one text are one class: classes are matched by form first, and rows are brought in only for
    classes that have a partner.
    """
    hashed = lambda c: F.struct(F.xxhash64(c), F.crc32(c.cast("binary")), F.length(c))
    t = F.col(f"`{text}`").cast("string")
    formed = with_forms(df.where(t != ""), text, {"k": F.col(f"`{key}`"), "x": hashed(t)})
    rows = materialize(formed.where("form <> ''").select("k", "x", hashed(F.col("form")).alias("h")), "lookalike-rows")
    mixed = rows.groupBy("h").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("h")
    kept = materialize(rows.join(mixed, "h"), "lookalike-mixed")
    # pairs of texts first: rows of one text, be they a third of all, are never paired with each other
    classes = kept.select("h", "x").distinct()
    texts = classes.join(classes.withColumnRenamed("x", "y"), "h").where("x < y")
    both = texts.join(kept.select("h", "x", F.col("k").alias("a")), ["h", "x"]).join(kept.select("h", F.col("x").alias("y"), F.col("k").alias("b")), ["h", "y"])
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
