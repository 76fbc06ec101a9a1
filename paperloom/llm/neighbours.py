"""Most similar vectors for every vector: a hierarchical k-means tree searched best bin first.

1. *Tree.* On a sample of at most ``sample`` unit vectors the driver fits a tree of k-means splits, down to leaves of
   about ``leaf`` of the collection's vectors. Inner nodes and leaves are at most twice the sample in number, so the
   tree can be broadcast. Every vector of the collection goes to a leaf by descending to the nearest child.
2. *Traversal.* A query keeps a priority queue of nodes by distance to their centroids, always opens the nearest, and
   so lists leaves in the order of their promise.
3. *Calibration.* The exact neighbours of ``calibration`` of the queries are found by a scan in blocks; the leaves to
   visit are widened until the mean recall over them reaches ``recall``. The measured figure is in ``Index.recall``.
4. *Search.* Leaves are laid out in buckets of at most ``bucket`` vectors (a leaf with more, such as one of a vector that a third of
   all rows share, is cut into several buckets by a hash). Queries are sent to the buckets of their leaves, scored by
   matrix products leaf by leaf, and each bucket sends on its best k for each query only. Queries of equal vectors are one search.

Similarity is the dot product of vectors scaled to length one. A vector is usable if it has ``dim`` finite values
that are not all zero. Of an id's usable rows the one of the least order column counts.

Edge cases: null ids and unusable vectors are left out on both sides; queries whose id has no usable vector get
no rows; a query's own id never comes out; ties are broken by the lesser id; k is cut to what the collection holds; null
and non-positive k give no rows; empty tables give an empty result; extra columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.runtime import materialize


@dataclass(frozen=True)
class NeighbourOptions:
    dim: int = 64
    sample: int = 40_000
    branch: int = 8
    leaf: int = 256
    bucket: int = 20_000
    calibration: int = 256
    recall: float = 0.97
    seed: int = 7


class Tree:
    """Centroids of a hierarchy of k-means splits."""

    def __init__(self, sample: np.ndarray, leaf: int, branch: int, seed: int):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = [[]]
        self.centre: list[np.ndarray] = [np.zeros(sample.shape[1], np.float32)]
        self.leaf_of: dict[int, int] = {}
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            parts = self._split(sample[rows], branch, rng) if len(rows) > leaf else []
            if len(parts) < 2:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            for centre, part in parts:
                self.children.append([])
                self.centre.append(centre)
                self.children[node].append(len(self.children) - 1)
                todo.append((len(self.children) - 1, rows[part]))
        self.blocks = [np.stack([self.centre[c] for c in cs]) if cs else None for cs in self.children]

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        label = np.zeros(len(x), np.int64)
        for _ in range(8):
            label = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            centres = np.stack([x[label == k].mean(0) if (label == k).any() else centres[k] for k in range(len(centres))])
        return [(centres[k].astype(np.float32), np.flatnonzero(label == k)) for k in range(len(centres)) if (label == k).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            b = self.blocks[node]
            label = (x[rows] @ b.T - 0.5 * (b**2).sum(1)).argmax(1)
            todo += [(c, rows[label == k]) for k, c in enumerate(self.children[node]) if (label == k).any()]
        return out

    def visit(self, q: np.ndarray, leaves: int, counts: dict[int, int] | None = None, need: int = 0) -> list[int]:
        """The first ``leaves`` leaves, best bin first, and as many more as it takes to hold ``need`` rows by their ``counts``."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        out: list[int] = []
        held = 0
        while queue and (len(out) < leaves or held < need):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf_of[node])
                held += counts.get(out[-1], 0) if counts is not None else 0
                continue
            d = ((self.blocks[node] - q) ** 2).sum(1)
            for k, c in enumerate(self.children[node]):
                heapq.heappush(queue, (float(d[k]), c))
        return out


def _matrix(column: pd.Series | list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def unit_vectors(vectors: DataFrame, key: str, order: str, embedding: str, dim: int) -> DataFrame:
    """``(id, o, v)``: the usable rows, scaled to length one, as packed float32."""
    types = [vectors.select(F.col(f"`{c}`")).schema[0].dataType.simpleString() for c in (key, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(2)
            length = np.diff(e.offsets.to_numpy())
            ok = np.flatnonzero((length == dim) & np.asarray(e.is_valid()) & np.asarray(b.column(0).is_valid()))
            values = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = values[e.offsets.to_numpy()[ok][:, None] + np.arange(dim)] if len(ok) else np.zeros((0, dim))
            norm = np.sqrt((x**2).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            ok, x = ok[good], (x[good] / norm[good, None]).astype(np.float32)
            at = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "o", "v"])

    return vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{order}`").alias("o"), F.col(f"`{embedding}`").cast("array<float>").alias("e")).mapInArrow(run, f"id {types[0]}, o {types[1]}, v binary")


@dataclass
class Index:
    """The collection laid out by leaf, and what calibration found."""

    tree: Tree
    placed: DataFrame
    counts: dict[int, int]
    options: NeighbourOptions
    visits: int = 0
    recall: float = 0.0


def build_index(vectors: DataFrame, key: str, order: str, embedding: str, o: NeighbourOptions = NeighbourOptions()) -> Index:
    units = unit_vectors(vectors, key, order, embedding, o.dim)
    n = units.count()
    share = min(1.0, 1.2 * o.sample / max(1, n))
    picked = units.where(F.pmod(F.xxhash64("id", "o"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else units
    # in the order of their hashes, so that the tree does not depend on the order of rows
    sample = _matrix([r.v for r in picked.orderBy(F.xxhash64("id", "o"), "id", "o").select("v").limit(o.sample).collect()], o.dim)
    tree = Tree(sample, max(2, int(o.leaf * len(sample) / max(1, n))), o.branch, o.seed)
    held = vectors.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = held.value.assign(_matrix(b.column(2).to_pylist(), o.dim)) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["id", "o", "v", "leaf"])

    schema = units.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", leaf int"
    placed = materialize(units.mapInArrow(assign, schema), "vector-leaves")
    counts = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf of the tree
    return Index(tree, placed, counts, o)


def _scan(index: Index, asked: list[tuple], k: int) -> dict:
    """The exact k nearest of a bounded list of ``(id, vector)``, as ``{id: {neighbour: leaf}}``."""
    ids = [a for a, _ in asked]
    q = _matrix([v for _, v in asked], index.options.dim)
    dim = index.options.dim
    held = index.placed.sparkSession.sparkContext.broadcast((ids, q))
    id_type = index.placed.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = held.value
        own = np.array(ids, object)
        best: list[np.ndarray] = []  # similarity, id and leaf of each query's k best so far in this task
        for f in frames:
            f = f.drop_duplicates("id").reset_index(drop=True)
            if not len(f):
                continue
            s = (q @ _matrix(f["v"], dim).T).astype(np.float64)
            s[f["id"].to_numpy()[None, :] == own[:, None]] = -9
            m = min(k, s.shape[1])
            top = np.argpartition(-s, m - 1, 1)[:, :m]
            new = [np.take_along_axis(s, top, 1), f["id"].to_numpy()[top], f["leaf"].to_numpy()[top]]
            if best:
                new = [np.concatenate(x, 1) for x in zip(best, new, strict=True)]
                if new[0].shape[1] > 2 * k:  # an id in two batches takes two places, so more than k are kept
                    keep = np.argpartition(-new[0], 2 * k - 1, 1)[:, : 2 * k]
                    new = [np.take_along_axis(x, keep, 1) for x in new]
            best = new
        if best:
            yield pd.DataFrame({"q": np.repeat(np.arange(len(ids)), best[0].shape[1]), "id": best[1].ravel(), "s": best[0].ravel(), "leaf": best[2].ravel()})

    found = index.placed.mapInPandas(run, f"q int, id {id_type}, s double, leaf int").where("s > -5")
    found = found.groupBy("q", "id").agg(F.max_by("s", "s").alias("s"), F.max_by("leaf", "s").alias("leaf"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).where(F.col("r") <= k)
    out: dict = {}
    for r in best.collect():  # calibration x k rows
        out.setdefault(ids[r.q], {})[r.id] = r.leaf
    return out


def calibrate(index: Index, asked: DataFrame, k: int) -> None:
    """Widens the leaf visits until the mean recall of the sampled queries reaches the target."""
    o = index.options
    some = [(r.id, r.v) for r in asked.orderBy(F.xxhash64("id"), "id").limit(o.calibration).collect()]
    leaves = len(index.tree.leaf_of)
    if not some:
        index.visits, index.recall = leaves, 1.0
        return
    truth = _scan(index, some, k)
    hits = np.zeros(leaves + 1)
    total = 0
    for i, v in some:
        place = {leaf: n for n, leaf in enumerate(index.tree.visit(np.frombuffer(v, np.float32), leaves))}
        for leaf in truth.get(i, {}).values():
            hits[place[leaf] + 1] += 1
            total += 1
    recall = np.cumsum(hits) / max(1, total)
    index.visits = int(np.argmax(recall >= min(o.recall, recall[-1])))
    index.visits = max(1, index.visits)
    index.recall = float(recall[index.visits])


def search(index: Index, asked: DataFrame) -> DataFrame:
    """``(q, id, s, place)`` for ``asked (h, id, k, v)``: the best k ids of the visited leaves, by similarity and id, ``id`` itself (may be null) left out; ``q`` is ``h``."""
    o = index.options
    # buckets: runs of leaves up to the size, or parts of one leaf that exceeds it; the tree bounds their table
    first: dict[int, tuple[int, int]] = {}
    bucket, load = 0, 0
    for leaf, n in sorted(index.counts.items()):
        parts = -(-n // o.bucket)
        if load and (load + n > o.bucket or parts > 1):
            bucket, load = bucket + 1, 0
        first[leaf] = (bucket, parts)
        load += n
        if parts > 1:
            bucket, load = bucket + parts, 0
    spark = asked.sparkSession
    held = spark.sparkContext.broadcast((index.tree, first, index.counts))
    id_type = index.placed.schema["id"].dataType.simpleString()
    layout = F.broadcast(spark.createDataFrame([(leaf, b, p) for leaf, (b, p) in first.items()] or [(-1, 0, 1)], "leaf int, bucket int, parts int"))
    stock = index.placed.join(layout, "leaf").select((F.col("bucket") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("bucket"), "leaf", "id", "o", "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, counts = held.value
        for b in batches:
            rows, buckets, leaves = [], [], []
            for i, (k, v) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                to: dict[int, list[int]] = {}
                # small leaves: as many as hold k others, were each sent twice
                for leaf in tree.visit(np.frombuffer(v, np.float32), index_visits, counts, 2 * (k + 1)):
                    at, parts = first.get(leaf, (0, 0))
                    for p in range(parts):
                        to.setdefault(at + p, []).append(leaf)
                rows += [i] * len(to)
                buckets += list(to)
                leaves += list(to.values())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *(b.column(c).take(at) for c in (0, 3, 1, 2)), pa.array(leaves, pa.list_(pa.int32()))], names=["bucket", "q", "own", "k", "v", "leaves"])

    index_visits = index.visits
    routed = asked.select("h", "k", "v", "id").mapInArrow(route, f"bucket int, q bigint, own {id_type}, k int, v binary, leaves array<int>")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("q", "int64"), ("id", object), ("s", float), ("k", "int32"))})
        if not len(left) or not len(right):
            return empty
        left = left.sort_values(["leaf", "id", "o"]).drop_duplicates(["leaf", "id"]).reset_index(drop=True)
        ids = left["id"].to_numpy()
        x, leaf = _matrix(left["v"], o.dim), left["leaf"].to_numpy()
        starts = {int(k): (int(s), int(e)) for k, s, e in zip(*_runs(leaf), strict=True)}
        q, own, ks, name = _matrix(right["v"], o.dim), right["own"].to_numpy(), right["k"].to_numpy(), right["q"].to_numpy()
        visitors: dict[int, list[int]] = {}
        for i, ls in enumerate(right["leaves"]):
            for v in ls:
                visitors.setdefault(int(v), []).append(i)
        out = []
        for v, who in visitors.items():
            if v not in starts:
                continue
            s, e = starts[v]
            for part in range(0, len(who), 2048):
                w = np.array(who[part : part + 2048])
                sims = q[w] @ x[s:e].T
                sims[ids[s:e][None, :] == own[w][:, None]] = -9
                m = min(int(ks[w].max()), e - s)
                top = np.argpartition(-sims, m - 1, 1)[:, :m] if m < e - s else np.broadcast_to(np.arange(e - s), (len(w), e - s))
                row = np.repeat(np.arange(len(w)), top.shape[1])
                out.append(pd.DataFrame({"q": w[row], "id": s + top.ravel(), "s": sims[row, top.ravel()].astype(np.float64)}))
        if not out:
            return empty
        rows = pd.concat(out)
        rows = rows[rows["s"] > -5]
        order = np.lexsort((rows["id"].to_numpy(), -rows["s"].to_numpy(), rows["q"].to_numpy()))
        rows = rows.iloc[order]
        rows = rows[rows.groupby("q", sort=False).cumcount().to_numpy() < ks[rows["q"].to_numpy()]]
        return pd.DataFrame({"q": name[rows["q"]], "id": ids[rows["id"]], "s": rows["s"].to_numpy(), "k": ks[rows["q"]]})

    scored = stock.groupBy("bucket").cogroup(routed.groupBy("bucket")).applyInPandas(score, f"q bigint, id {id_type}, s double, k int")
    once = scored.groupBy("q", "id", "k").agg(F.max("s").alias("s"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id")))
    return ranked.where("r <= k").select("q", "id", "s", F.col("r").alias("place"))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate(([0], edge))
    return x[starts], starts, np.concatenate((edge, [len(x)]))


def neighbours(vectors: DataFrame, key: str, order: str, embedding: str, wanted: DataFrame, o: NeighbourOptions = NeighbourOptions()) -> tuple[DataFrame, Index]:
    """``(q, id, s, place)`` for the ids and k of ``wanted (id, k)``, and the index used."""
    index = build_index(vectors, key, order, embedding, o)
    ids = wanted.where("id is not null and k > 0").groupBy("id").agg(F.max("k").cast("int").alias("k"))
    asked = index.placed.join(ids, "id").groupBy("id").agg(F.min_by("v", "o").alias("v"), F.max("k").alias("k"))
    asked = materialize(asked.select("id", "k", "v", F.xxhash64("v").alias("h")), "vector-queries")
    most = asked.agg(F.max("k")).first()[0] or 1
    calibrate(index, asked, most)
    # queries of one vector are searched once, for one neighbour more, as each leaves out itself: were a third of all vectors
    # equal, so would be a third of the queries
    alone = asked.groupBy("v").agg(F.min("h").alias("h"), F.min("id").alias("id"), F.count("*").alias("n"), F.max("k").alias("k"))
    alone = materialize(alone.select("h", "v", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") == 1, F.col("k")).otherwise(F.col("k") + 1).cast("int").alias("k")), "vector-searches")
    found = search(index, alone).withColumnsRenamed({"q": "h", "place": "_p"})
    own = found.join(asked.select(F.col("id").alias("q"), "h", "k"), "h").where("id <> q")
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id")))
    return ranked.where("place <= k").select("q", "id", "s", "place"), index
