"""Near-duplicate records with small edits: meet-in-the-middle ball hashing.

A record's *fingerprint* is a short vector of min-hash symbols of its word shingles, one per position; each record
has ``groups`` of them. The distance of two fingerprints is the number of positions in which they differ (Hamming) and the ball's
radius is ``radius``. Every fingerprint emits all variants within half the radius: with up to ``radius / 2`` of its symbols replaced by
a wildcard that stands for any symbol. Two fingerprints whose differences fall in ``radius / 2`` positions have a variant in common, so a
shuffle on variants brings them together. (With binary fingerprints the ball of half the radius needed for a similarity of 0.6 holds
thousands of variants; a wildcard covers all symbols of its position, so with symbols it holds ``width``. It is the ball of the
wildcard's patterns: two fingerprints that differ in up to ``radius`` positions, but in no ``radius / 2`` only, meet in none.)
Variants travel packed by part of the key space, each with its class and a signature of 64 two-bit symbols. Colliding pairs whose signatures
differ by more than ``spread`` standard deviations beyond what pairs of the wanted similarity do (with 5: one such pair in three million)
go no further; ``spread=None`` is the exact way, which lets all collisions through. The others are deduplicated and verified on their full sets of shingles.

A pair at similarity s is found with probability ``1 - (1 - P)^groups``, where P is the chance that at least ``width -
radius/2`` of ``width`` symbols agree, each with probability s: with 4 symbols, radius 2 and 12 groups 0.9996 at s = 0.6, with 6 groups
0.9999 at s = 0.8.

A variant that more than ``crowd`` classes of a task share (texts of one template) is paired outside that task: its classes are cut
into blocks, and every two blocks meet in a task of their own.

Records of the same words are one class: variants are emitted once per class and task, pairs are found between classes, and
rows come back only where a result asks for rows. So a text that holds a third of all rows is one class of at most
one variant set per task.

Edge cases: nulls count as empty text; records with fewer than ``min_words`` words, or fewer words than a
shingle has, are no candidates, but have a group with their exact copies; exact copies have likeness 1; an empty table gives an empty result; texts of any length are
used whole; extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.graph import components
from paperloom.runtime import materialize

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class NearDupOptions:
    shingle: int = 5
    similarity: float = 0.8
    min_words: int = 5
    width: int = 4
    radius: int = 2
    groups: int = 6
    seed: int = 20240
    spread: float | None = 5.0
    crowd: int = 2_000


def _words(parts: Sequence[str | None]) -> list[str]:
    return WORD.findall(" ".join(p for p in parts if p).lower())


def _normal(parts: Sequence[str | None]) -> str:
    return " ".join(_words(parts))


#: Two-bit symbols of a signature.
SYMBOLS = 64
#: Variants that one task groups.
PART = 4_000_000
#: Keys that may be broadcast to filter texts before they are shuffled.
BROADCAST_KEYS = 1_000_000
LOW = np.uint64(0x5555555555555555)


class _Sketcher:
    def __init__(self, o: NearDupOptions):
        self.o = o
        rng = np.random.default_rng(o.seed)
        n = o.width * o.groups + SYMBOLS
        self.mul, self.add, self.mix = (rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1) for _ in range(3))
        self.kept = list(combinations(range(o.width), o.width - o.radius // 2))
        self.step = rng.integers(1, 1 << 63, o.shingle, np.uint64) | np.uint64(1)
        self.hashes: dict[str, int] = {}

    def words(self, texts: list[list[str]]) -> np.ndarray:
        seen = self.hashes
        if len(seen) > 1_000_000:
            seen.clear()
        out = []
        for ws in texts:
            for w in ws:
                h = seen.get(w)
                if h is None:
                    h = seen[w] = xxhash.xxh3_64_intdigest(w)
                out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """A row of variant keys and one of a signature (two words) for each text; all texts have a shingle at least."""
        o = self.o
        h = self.words(texts)
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        shingles = np.zeros(max(0, len(h) - o.shingle + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(o.shingle):
                shingles = (shingles ^ h[j : len(h) - o.shingle + 1 + j]) * self.step[j]
                shingles ^= shingles >> np.uint64(29)
            # shingles across two texts are left out of every minimum
            inside = np.ones(len(shingles), bool)
            for j in range(1, o.shingle):
                edge = starts[1:] - j
                inside[edge[(edge >= 0) & (edge < len(inside))]] = False
            at = np.concatenate(([0], np.cumsum(sizes - o.shingle + 1)))[:-1]
            flat = (shingles[inside] >> np.uint64(32)).astype(np.uint32)
            least = np.empty((len(texts), len(self.mul)), np.uint32)
            for k in range(len(self.mul)):
                x = flat * self.mul[k] + self.add[k]
                x ^= x >> np.uint32(15)
                x *= self.mix[k]
                least[:, k] = np.minimum.reduceat(x, at)
            n = o.groups * o.width
            wide = least[:, :n].astype(np.uint64)
            keys = np.empty((len(texts), o.groups * len(self.kept)), np.uint64)
            c = 0
            for g in range(o.groups):
                for kept in self.kept:
                    key = np.full(len(texts), g * 1_000_003 + sum(1 << i for i in kept), np.uint64)
                    for i in kept:
                        key = (key ^ wide[:, g * o.width + i]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(31)
                    keys[:, c] = key
                    c += 1
            # the low bits of a minimum are those of a small number, so they are mixed before two are kept
            two = least[:, n:] * np.uint32(0x85EBCA6B)
            two = ((two ^ (two >> np.uint32(13))) & np.uint32(3)).astype(np.uint64)
            signature = np.zeros((len(texts), 2), np.uint64)
            for k in range(SYMBOLS):
                signature[:, k // 32] |= two[:, k] << np.uint64(2 * (k % 32))
        return keys, signature


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of symbols in which signatures differ."""
    d = x ^ y
    return np.bitwise_count((d | (d >> np.uint64(1))) & LOW).sum(-1)


def _most_differ(similarity: float, spread: float | None) -> int:
    same = similarity + (1 - similarity) / 4
    return SYMBOLS if spread is None else int(SYMBOLS * (1 - same) + spread * (SYMBOLS * same * (1 - same)) ** 0.5)


def _blob(keys: np.ndarray, signature: np.ndarray, variant: np.ndarray, row: np.ndarray) -> bytes:
    """Variants of one part with the classes they belong to, each class once."""
    used, at = np.unique(row, return_inverse=True)
    return b"".join((np.array([len(used), len(variant)], np.uint32).tobytes(), keys[used].tobytes(), signature[used].tobytes(), variant.tobytes(), at.astype(np.uint16).tobytes()))


def _unblob(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    out: list[list[np.ndarray]] = [[], [], [], []]
    base = 0
    for b in blobs:
        n, m = (int(x) for x in np.frombuffer(b, np.uint32, 2))
        out[0].append(np.frombuffer(b, np.int64, n, 8))
        out[1].append(np.frombuffer(b, np.uint64, 2 * n, 8 + 8 * n).reshape(n, 2))
        out[2].append(np.frombuffer(b, np.uint32, m, 8 + 24 * n))
        out[3].append(np.frombuffer(b, np.uint16, m, 8 + 24 * n + 4 * m).astype(np.int64) + base)
        base += n
    return tuple(np.concatenate(x) for x in out)  # type: ignore[return-value]


def _near(keys: np.ndarray, signature: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Of the pairs of places ``a`` and ``b`` the class pairs whose signatures differ in ``most`` symbols or fewer, the lesser class first."""
    ok = (keys[a] != keys[b]) & (_differ(signature[a], signature[b]) <= most)
    p = np.stack((keys[a[ok]], keys[b[ok]]), 1)
    p.sort(1)
    return p


def _meet(blobs: list[bytes], most: int, crowd: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The pairs of classes that share a variant and may be alike, and the crowds ``(variant, classes, signatures)`` left to others."""
    keys, signature, variant, row = _unblob(blobs)
    order = np.argsort(variant, kind="stable")
    variant, row = variant[order], row[order]
    start = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
    length = np.diff(np.concatenate((start, [len(variant)])))
    found, crowds = [np.zeros((0, 2), np.int64)], []
    for n in np.unique(length[length > 1]):
        runs = start[length == n]
        if n > crowd:
            for s in runs:
                held, first = np.unique(keys[row[s : s + n]], return_index=True)  # a class may come from several tasks
                crowds.append((int(variant[s]), held, signature[row[s : s + n]][first]))
            continue
        i, j = np.triu_indices(int(n), 1)
        step = max(1, 2_000_000 // len(i))
        for k in range(0, len(runs), step):
            r = row[runs[k : k + step, None] + np.arange(n)]
            found.append(_near(keys, signature, r[:, i].ravel(), r[:, j].ravel(), most))
    return np.unique(np.concatenate(found), axis=0), crowds


def _crowd_pairs(members: DataFrame, o: NearDupOptions, most: int) -> DataFrame:
    """The pairs within crowds ``(variant, c, x, y)``: every two blocks of some ``crowd`` classes in a group of their own."""
    sizes = members.groupBy("variant").agg(F.ceil(F.count("*") / o.crowd).cast("int").alias("blocks"))  # crowds are few: each has more than ``crowd`` rows
    own = members.join(sizes, "variant").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = own.select("variant", "c", "x", "y", "own", other.alias("other")).select("variant", "c", "x", "y", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def cross(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        lo = f["own"].to_numpy() == key[1]
        keys, signature = f["c"].to_numpy(), np.stack((f["x"].to_numpy(), f["y"].to_numpy()), 1).view(np.uint64)
        left, right = np.flatnonzero(lo), np.flatnonzero(lo if key[1] == key[2] else ~lo)
        found = [np.zeros((0, 2), np.int64)]
        step = max(1, 2_000_000 // max(1, len(right)))
        for i in range(0, len(left), step):
            part = left[i : i + step]
            found.append(_near(keys, signature, np.repeat(part, len(right)), np.tile(right, len(part)), most))
        p = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})

    return cells.groupBy("variant", "lo", "hi").applyInPandas(cross, "a bigint, b bigint")


def _keys(text: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(text)
    return ((d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63))


def _text_columns(df: DataFrame, columns: Sequence[str]) -> list:
    return [F.col(f"`{c}`").cast("string").alias(f"t{i}") for i, c in enumerate(columns)]


def classes(df: DataFrame, key: str, columns: Sequence[str], o: NearDupOptions, every: bool = False) -> DataFrame:
    """``(k, class, check, n)`` of every row with enough words, or of ``every`` row: 128 bits of its words' hash, and the number of words."""
    key_type = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    least = 0 if every else max(o.min_words, o.shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, parts in enumerate(zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)):
                ws = _words(parts)
                if len(ws) >= least:
                    rows.append((i, *_keys(" ".join(ws)), len(ws)))
            at, hi, lo, n = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int32())], names=["k", "class", "check", "n"])

    return df.select(F.col(f"`{key}`").alias("k"), *_text_columns(df, columns)).mapInArrow(run, f"k {key_type}, class bigint, check bigint, n int")


def class_pairs(df: DataFrame, columns: Sequence[str], o: NearDupOptions) -> DataFrame:
    """``(a, check_a, b, check_b, likeness)`` of each two classes at least ``similarity`` alike, ``a < b``."""
    texts = df.select(*_text_columns(df, columns))
    least = max(o.min_words, o.shingle)

    variants = o.groups * len(list(combinations(range(o.width), o.width - o.radius // 2)))
    parts = max(1, -(-df.count() * variants // PART))
    most = _most_differ(o.similarity, o.spread)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = _Sketcher(o)
        seen: set[int] = set()

        def flush(texts: list[list[str]], keys: list[int]) -> pa.RecordBatch:
            v, signature = sketcher(texts)
            part = ((v >> np.uint64(33)) % np.uint64(parts)).astype(np.int32).ravel()
            order = np.argsort(part, kind="stable")
            row = np.repeat(np.arange(len(texts)), v.shape[1])[order]
            low = v.ravel().astype(np.uint32)[order]
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            held = np.array(keys, np.int64)
            full = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_blob(held, signature, low[bounds[p] : bounds[p + 1]], row[bounds[p] : bounds[p + 1]]) for p in full], pa.binary())], names=["part", "ball"])

        texts_, keys_, size = [], [], 0
        for b in batches:
            for each in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ws = _words(each)
                if len(ws) < least:
                    continue
                hi, _ = _keys(" ".join(ws))
                if hi in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(hi)
                texts_.append(ws)
                keys_.append(hi)
                size += len(ws)
                if size > 1_000_000 or len(texts_) >= 60_000:
                    yield flush(texts_, keys_)
                    texts_, keys_, size = [], [], 0
        if texts_:
            yield flush(texts_, keys_)

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        p, crowds = _meet(f["ball"].tolist(), most, o.crowd)
        out = [pd.DataFrame({"variant": np.full(len(p), -1, np.int64), "a": p[:, 0], "b": p[:, 1], "x": np.int64(0), "y": np.int64(0)})]
        for variant, held, signature in crowds:
            s = signature.view(np.int64)
            out.append(pd.DataFrame({"variant": np.full(len(held), variant * parts + int(f["part"].iloc[0]), np.int64), "a": held, "b": held, "x": s[:, 0], "y": s[:, 1]}))
        return pd.concat(out)

    balls = texts.mapInArrow(emit, "part int, ball binary")
    met = materialize(balls.groupBy("part").applyInPandas(meet, "variant bigint, a bigint, b bigint, x bigint, y bigint"), "neardup-met")
    apart = met.where("variant = -1").select("a", "b")
    crowds = _crowd_pairs(met.where("variant >= 0").select("variant", F.col("a").alias("c"), "x", "y"), o, most)
    pairs = materialize(apart.unionByName(crowds).distinct(), "neardup-pairs")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for parts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ws = _words(parts)
                if len(ws) >= least:
                    t = " ".join(ws)
                    rows.append((*_keys(t), t))
            hi, lo, t = zip(*rows, strict=True) if rows else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(t, pa.string())], names=["c", "check", "t"])

    wanted = materialize(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), "neardup-wanted")
    if wanted.count() <= BROADCAST_KEYS:  # eight bytes each
        wanted = F.broadcast(wanted)
    content = texts.mapInArrow(contents, "c bigint, check bigint, t string").join(wanted, "c", "left_semi").dropDuplicates(["c", "check"])
    content = materialize(content, "neardup-texts")
    left = pairs.join(content.toDF("a", "check_a", "ta"), "a")
    both = left.join(content.toDF("b", "check_b", "tb"), "b").select("a", "check_a", "b", "check_b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(t: str) -> frozenset:
            ws = t.split(" ")
            return frozenset(zip(*[ws[i:] for i in range(o.shingle)], strict=False))

        for b in batches:
            ta, tb = b.column(4).to_pylist(), b.column(5).to_pylist()
            at, like = [], []
            held: tuple[str, frozenset] = ("", frozenset())
            for i, (x, y) in enumerate(zip(ta, tb, strict=True)):
                if held[0] != y:
                    held = (y, shingles(y))
                s = shingles(x)
                common = len(s & held[1])
                j = common / (len(s) + len(held[1]) - common)
                if j >= o.similarity:
                    at.append(i)
                    like.append(j)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(4)), pa.array(like, pa.float64())], names=["a", "check_a", "b", "check_b", "likeness"])

    return both.mapInArrow(verify, "a bigint, check_a bigint, b bigint, check_b bigint, likeness double")


def row_pairs(df: DataFrame, key: str, columns: Sequence[str], o: NearDupOptions) -> DataFrame:
    """Each pair ``(a, b)`` of row keys, ``a < b``, of rows at least ``similarity`` alike, exact copies included."""
    member = materialize(classes(df, key, columns, o).drop("n"), "neardup-classes")
    linked = materialize(class_pairs(df, columns, o).drop("likeness"), "neardup-links")
    one = member.select(F.col("k").alias("a"), F.col("class").alias("ca"), F.col("check").alias("xa"))
    two = member.select(F.col("k").alias("b"), F.col("class").alias("cb"), F.col("check").alias("xb"))
    copies = one.join(two, [one["ca"] == two["cb"], one["xa"] == two["xb"]]).where("a < b").select("a", "b")
    links = linked.toDF("ca", "xa", "cb", "xb")
    across = links.join(one, ["ca", "xa"]).join(two, ["cb", "xb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return copies.unionByName(across)


def row_groups(df: DataFrame, key: str, columns: Sequence[str], o: NearDupOptions = NearDupOptions()) -> DataFrame:
    """``(key, group, copies, links)`` of every row: the least row key of its group, the number of its
    exact copies (itself included) and of the other texts it is linked to. Copies are not expanded into pairs.
    Rows with too few words to be candidates, or none, are grouped with rows of the same words, and have no links."""
    member = materialize(classes(df, key, columns, o, every=True).drop("n"), "neardup-classes")
    linked = materialize(class_pairs(df, columns, o).drop("likeness"), "neardup-links")
    ends = linked.select(F.struct(F.col("a").alias("class"), F.col("check_a").alias("check")).alias("a"), F.struct(F.col("b").alias("class"), F.col("check_b").alias("check")).alias("b"))
    parts = components(ends, "a", "b").select("node.class", "node.check", "component")
    degree = ends.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n.class", "n.check").agg(F.count("*").alias("links"))
    sizes = member.groupBy("class", "check").agg(F.count("*").alias("copies"), F.min("k").alias("least"))
    sizes = sizes.join(parts, ["class", "check"], "left").join(degree, ["class", "check"], "left").withColumn("component", F.coalesce("component", F.struct("class", "check")))
    roots = sizes.groupBy("component").agg(F.min("least").alias("group"))
    full = sizes.join(roots, "component").select("class", "check", "group", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return member.join(full, ["class", "check"]).select(F.col("k").alias(key), "group", "copies", "links")
