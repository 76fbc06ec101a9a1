"""Dense vectors: a pluggable embedder, exact nearest neighbours in blocks of queries, and an inverted file of cells."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.config import SearchConfig
from paperloom.operators.blocks import nearest_in_blocks, stack
from paperloom.runtime import materialize

Embedder = Callable[[Sequence[str]], np.ndarray]
WORD = re.compile(r"\w+")


class HashingEmbedder:
    """Signed feature hashing of words (Weinberger et al., 2009), scaled to length one: a stand-in without a model.

    The first two hex digits of a word's MD5 choose one of ``dim`` (at most 256) places, the third its sign.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.known: dict[str, int] = {}

    def _place(self, word: str) -> int:
        h = hashlib.md5(word.encode()).hexdigest()
        return (int(h[:2], 16) % self.dim) * 2 + (h[2] >= "8")

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        found = [WORD.findall((t or "").lower()) for t in texts]
        if len(self.known) > 500_000:
            self.known.clear()
        for w in {w for ws in found for w in ws} - self.known.keys():
            self.known[w] = self._place(w)
        places = np.fromiter((self.known[w] for ws in found for w in ws), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in found]) if len(texts) else np.zeros(0, np.int64)
        counts = np.bincount(row * 2 * self.dim + places, minlength=len(texts) * 2 * self.dim).reshape(len(texts), self.dim, 2)
        out = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
        n = np.sqrt((out**2).sum(1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0)


def embed(df: DataFrame, text: str, name: str = "vector", embedder: Embedder | None = None) -> DataFrame:
    """``df`` with the embedding of ``text`` in place of it, one Arrow batch at a time; null texts embed as empty ones."""
    embedder = embedder or HashingEmbedder()
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(embedder(b.column(len(kept)).to_pylist()), np.float64)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), np.int32) if len(x) else np.zeros(1, np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], lists], names=[*kept, name])

    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return df.select(*kept, text).mapInArrow(run, schema)


def nearest_per_shard(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = 4096, doc_block: int = 65_536) -> DataFrame:
    """``(query_id, shard_id, doc_ord, distance, place)``: each shard's k nearest of ``vectors (shard_id, doc_ord, vector)``
    for ``queries (query_id, vector)``, by squared L2 distance, exact; queries are a stated set, held against all rows in blocks."""
    found = nearest_in_blocks(vectors, queries, k, doc_block, query_block)
    best = Window.partitionBy("query_id", "shard_id").orderBy("distance", "doc_ord")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def cells_of(n: int) -> int:
    """The number of cells of a shard's inverted file: the square root of its size, within 16 and 4096."""
    return max(16, min(4096, int(n**0.5)))


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row, in blocks that bound the matrix of distances."""
    step, half = max(1, (1 << 23) // max(1, len(c))), 0.5 * (c**2).sum(1)
    return np.concatenate([(x[i : i + step] @ c.T - half).argmax(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


class CellIndex:
    """An inverted file per shard: k-means cells on a sample of the shard, and every row with its cell.

    How many cells are probed is measured, unless ``probes`` says it: the exact neighbours of sampled rows (and of further
    queries, if given) are found by a scan, and probes are widened until ``config.recall`` of them are in probed cells.
    ``calibrated`` holds the figures by depth, the number of neighbours wanted; beyond the last depth all cells are probed.
    """

    DEPTHS = (10, 50, 200)

    def __init__(self, vectors: DataFrame, config: SearchConfig = SearchConfig(), seed: int = 1, train_least: int = 50_000, asked: DataFrame | None = None):
        """A shard's cells are fitted on ``train_least`` of its rows, or 40 a cell if that is more; all rows are indexed.
        ``asked (vector)`` are queries unlike the rows that calibration has to serve as well."""
        self.config, self.asked = config, asked
        self.calibrated: dict[int, tuple[int, float]] = {}
        vectors = materialize(vectors.select("shard_id", "doc_ord", "vector").where("vector is not null"), "cell-vectors")
        counts = {r.shard_id: r.n for r in vectors.groupBy("shard_id").agg(F.count("*").alias("n")).collect()}  # a row per shard
        wanted = {s: min(n, max(40 * cells_of(n), train_least)) for s, n in counts.items()}

        def train(f: pd.DataFrame) -> pd.DataFrame:
            s = int(f["shard_id"].iloc[0])
            cells, rng = min(cells_of(counts[s]), counts[s]), np.random.default_rng(seed + s)
            x = np.stack(f.sort_values("doc_ord")["vector"].to_list()).astype(np.float64)
            if len(x) > wanted[s]:
                x = x[np.sort(rng.choice(len(x), wanted[s], replace=False))]
            c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
            for _ in range(10):
                at = _closest(x, c)
                c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            return pd.DataFrame({"shard_id": s, "cell": range(len(c)), "centre": list(c)})

        # a sample by hash, somewhat larger than wanted, bounds the rows of a shard that training sees
        spark, million = vectors.sparkSession, 1_000_000
        shares = spark.createDataFrame([(s, min(million, int(1.1 * million * wanted[s] / n) + 1)) for s, n in counts.items()], "shard_id int, share int")
        some = vectors.join(F.broadcast(shares), "shard_id").where(F.pmod(F.xxhash64("doc_ord"), F.lit(million)) < F.col("share")).select("shard_id", "doc_ord", "vector")
        self.centres: dict[int, np.ndarray] = {}
        for r in some.groupBy("shard_id").applyInPandas(train, "shard_id int, cell int, centre array<double>").orderBy("shard_id", "cell").collect():  # at most 4096 rows a shard
            self.centres.setdefault(r.shard_id, []).append(r.centre)
        self.centres = {s: np.array(c) for s, c in self.centres.items()}
        centres = self.centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shard, cell = b.column(0).to_numpy(), np.zeros(b.num_rows, np.int32)
                if b.num_rows:
                    x = stack(b.column(2))
                    for s in np.unique(shard):
                        cell[shard == s] = _closest(x[shard == s], centres[int(s)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["shard_id", "doc_ord", "vector", "cell"])

        kept = vectors.select("shard_id", "doc_ord", "vector")
        self.rows = materialize(kept.mapInArrow(assign, T.StructType([*kept.schema.fields, T.StructField("cell", T.IntegerType())])), "cell-rows")

    def _nearest_cells(self, q: np.ndarray, shard: int) -> np.ndarray:
        c = self.centres[shard]
        return np.argsort((c**2).sum(1)[None, :] - 2 * q @ c.T, 1, kind="stable")

    def calibrate(self, depths: Sequence[int] = DEPTHS, sample: int = 256) -> None:
        """Measures, for ``sample`` rows and as many of ``asked``, the recall of each number of probes. A row is no neighbour of its own."""
        spark, most = self.rows.sparkSession, max(depths)
        by_hash = F.xxhash64("shard_id", "doc_ord"), "shard_id", "doc_ord"
        queries = [(r.shard_id, r.doc_ord, list(r.vector)) for r in self.rows.drop("cell").orderBy(*by_hash).limit(sample).collect()]
        own = len(queries)
        if self.asked is not None:
            queries += [(None, None, list(r.vector)) for r in self.asked.select("vector").where("vector is not null").orderBy(F.xxhash64("vector")).limit(sample).collect()]
        if not queries:
            self.calibrated |= dict.fromkeys(depths, (1, 1.0))
            return
        held = spark.createDataFrame([(i, *q) for i, q in enumerate(queries)], "query_id int, own_shard int, own_ord int, vector array<double>")
        near = nearest_per_shard(self.rows, held, most + 1, self.config.query_block, self.config.doc_block).join(F.broadcast(held.drop("vector")), "query_id")
        near = near.where(~F.coalesce((F.col("shard_id") == F.col("own_shard")) & (F.col("doc_ord") == F.col("own_ord")), F.lit(False)))
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "shard_id").orderBy("distance", "doc_ord")))
        near = near.select("query_id", "shard_id", "doc_ord", "place").join(self.rows.select("shard_id", "doc_ord", "cell"), ["shard_id", "doc_ord"])
        q = np.array([x[2] for x in queries])
        rank = spark.sparkContext.broadcast({s: np.argsort(self._nearest_cells(q, s), 1).astype(np.int32) for s in self.centres})

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                query, shard, place, cell = (b.column(i).to_numpy() for i in range(4))
                r = np.zeros(b.num_rows, np.int32)
                for s in np.unique(shard):
                    r[shard == s] = rank.value[int(s)][query[shard == s], cell[shard == s]]
                yield pa.RecordBatch.from_arrays([pa.array(query >= own), pa.array(place), pa.array(r)], names=["asked", "place", "rank"])

        hits = near.select("query_id", "shard_id", "place", "cell").mapInArrow(ranked, "asked boolean, place int, rank int")
        counted = hits.groupBy("asked", "place", "rank").agg(F.count("*").alias("n")).collect()  # at most 2 x depth x 4096 rows
        cells = max(len(c) for c in self.centres.values())
        for depth in depths:
            found = []
            for asked in (False, True):
                n = np.bincount([r["rank"] for r in counted if r.asked == asked and r.place <= depth], [r.n for r in counted if r.asked == asked and r.place <= depth], cells)
                if n.sum():
                    recall = np.cumsum(n) / n.sum()
                    least = int(np.argmax(recall >= min(self.config.recall, recall[-1])))
                    found.append((least + 1, float(recall[least])))
            self.calibrated[depth] = (max((p for p, _ in found), default=1), min((r for _, r in found), default=1.0))

    def probes_for(self, k: int) -> int:
        """The probes that reach the wanted recall of ``k`` neighbours; all cells beyond the last depth."""
        depth = next((x for x in self.DEPTHS if x >= k), None)
        if depth is None:
            return max((len(c) for c in self.centres.values()), default=1)
        if depth not in self.calibrated:
            self.calibrate((depth,))
        return self.calibrated[depth][0]

    def search(self, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """``(shard_id, doc_ord, distance, place)`` for one query vector."""
        one = self.rows.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, vector array<double>")
        return self.search_many(one, k, probes).drop("query_id")

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``(query_id, shard_id, doc_ord, distance, place)``: each shard's k nearest in its ``probes`` nearest cells; fewer if those hold fewer.
        Without ``probes`` there and in the configuration, as many as calibration found.

        Queries are a stated set, as in ``nearest_per_shard``: a block of them is broadcast, and only rows of probed cells
        reach the tasks, which hold each cell against its queries as a matrix product and send on their k nearest.
        """
        probes = probes or self.config.probes or self.probes_for(k)
        spark = self.rows.sparkSession
        rows = [(r.query_id, r.vector) for r in queries.select("query_id", "vector").where("vector is not null").toLocalIterator()]
        id_type, id_arrow = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
        parts = []
        for at in range(0, max(1, len(rows)), self.config.query_block):
            block = rows[at : at + self.config.query_block]
            ids, q = [r[0] for r in block], np.array([r[1] for r in block], np.float64).reshape(len(block), len(rows[0][1]) if rows else 0)
            asking: dict[tuple[int, int], np.ndarray] = {}
            for s in self.centres if block else ():
                near = self._nearest_cells(q, s)[:, :probes]
                order = np.argsort(near, axis=None, kind="stable")
                cells, first = np.unique(near.ravel()[order], return_index=True)
                asking |= {(s, int(c)): w.astype(np.int32) for c, w in zip(cells, np.split(order // near.shape[1], first[1:]), strict=True)}
            held = spark.sparkContext.broadcast((q, asking))

            def run(batches: Iterator[pa.RecordBatch], held=held, ids=ids) -> Iterator[pa.RecordBatch]:
                q, asking = held.value
                qq = (q**2).sum(1)
                best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for b in batches:
                    if not b.num_rows:
                        continue
                    x, shard, place, cell = stack(b.column(2)), b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
                    by_cell = np.lexsort((cell, shard))
                    edges = np.flatnonzero((np.diff(shard[by_cell]) != 0) | (np.diff(cell[by_cell]) != 0)) + 1
                    for mine in np.split(by_cell, edges):
                        s = int(shard[mine[0]])
                        if (who := asking.get((s, int(cell[mine[0]])))) is None:
                            continue
                        if s not in best:
                            best[s] = (np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64))
                        d = np.round(np.maximum(0.0, qq[who, None] + (x[mine] ** 2).sum(1)[None, :] - 2 * q[who] @ x[mine].T), 9)
                        d = np.concatenate((best[s][0][who], d), 1)
                        o = np.concatenate((best[s][1][who], np.broadcast_to(place[mine], (len(who), len(mine)))), 1)
                        pick = np.lexsort((o, d), axis=1)[:, :k]
                        best[s][0][who], best[s][1][who] = np.take_along_axis(d, pick, 1), np.take_along_axis(o, pick, 1)
                for s, (d, o) in best.items():
                    row, col = np.nonzero(o >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, id_arrow).take(pa.array(row)), pa.array(np.full(len(row), s, np.int32)), pa.array(o[row, col].astype(np.int32)), pa.array(d[row, col])], names=["query_id", "shard_id", "doc_ord", "distance"])

            probed = F.broadcast(spark.createDataFrame(list(asking), "shard_id int, cell int"))
            parts.append(self.rows.join(probed, ["shard_id", "cell"], "left_semi").select("shard_id", "doc_ord", "vector", "cell").mapInArrow(run, f"query_id {id_type}, shard_id int, doc_ord int, distance double"))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        best = Window.partitionBy("query_id", "shard_id").orderBy("distance", "doc_ord")
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)

    def save(self, path: str) -> None:
        """Centres, calibrated probes and rows as parquet, rows partitioned by shard and sorted by cell, so that a probe reads few row groups."""
        spark = self.rows.sparkSession
        table = [(s, k, [float(x) for x in c]) for s, cs in self.centres.items() for k, c in enumerate(cs)]
        spark.createDataFrame(table, "shard_id int, cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        if not self.config.probes:
            self.calibrate()
        spark.createDataFrame([(d, p, r) for d, (p, r) in self.calibrated.items()], "depth int, probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
        self.rows.repartition("shard_id").sortWithinPartitions("shard_id", "cell", "doc_ord").write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: SearchConfig = SearchConfig()) -> CellIndex:
        self = cls.__new__(cls)
        self.config, self.asked, self.rows, centres = config, None, spark.read.parquet(f"{path}/cells"), {}
        self.calibrated = {r.depth: (r.probes, r.recall) for r in spark.read.parquet(f"{path}/probes").collect()}
        for r in spark.read.parquet(f"{path}/centres").orderBy("shard_id", "cell").collect():  # at most 4096 rows a shard
            centres.setdefault(r.shard_id, []).append(r.centre)
        self.centres = {s: np.array(c) for s, c in centres.items()}
        return self
