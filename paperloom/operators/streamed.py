"""Large tables of queries against all rows: each task holds a block of queries and streams past the whole stored index.

Nothing but a page of results per query is ever shuffled or written, so disk follows the corpus and the queries, not their
product and not the candidates (some 1,200 a query). The work is still every query against every document, as exactness asks for.

The index is inverted lists of at most ``PART`` documents each, made where their texts are read, without a shuffle. Tasks
read them from the shared folder with pyarrow, one block of a shard at a time. Queries of equal words are one query, and
those of equal vectors are held against the vectors once. Within a block, scores of some queries and all its documents
are a matrix; a bound from maxima of groups of columns leaves few documents to sort, and distances in single precision, widened by
their error, leave few to be computed exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import SearchConfig
from paperloom.functions.text import title_and_abstract, words
from paperloom.operators.corpus import shard_of
from paperloom.operators.vectors import WORD, Embedder, HashingEmbedder

#: Documents of an inverted list, and of a block of them in memory.
PART = 32_768
#: Columns of which one maximum is taken, and elements of a matrix of scores.
GROUPS, CELLS = 16, 1 << 20
#: The title's part of a document's counts of query words.
TITLE = 1 << 16
LISTS = "shard_id int, part string, n int, term string, docs binary, tf_title binary, tf_abstract binary, vectors binary, df_title bigint, df_abstract bigint, cf_title bigint"


@dataclass
class Lists:
    """A stored index for ``search_streamed``: ``path`` holds the lists and the statistics."""

    spark: SparkSession
    path: str
    config: SearchConfig

    def dictionary(self) -> DataFrame:
        """``(word, freq)``: the words of the titles."""
        rows = self.spark.read.parquet(f"{self.path}/lists").where("term is not null and cf_title > 0")
        return rows.groupBy(F.col("term").alias("word")).agg(F.sum("cf_title").alias("freq"))


def _inverted(line: np.ndarray, titles: pa.ListArray, abstracts: pa.ListArray, x: np.ndarray, shard: int, part: str) -> Iterator[pa.RecordBatch]:
    """The rows of one part: one without a term for the documents, one for each term. Documents are places in the order of lines."""
    order = np.argsort(line, kind="stable")
    line, x, n = line[order], np.ascontiguousarray(x[order]), len(line)
    titles, abstracts = titles.take(pa.array(order)), abstracts.take(pa.array(order))
    both = pa.concat_arrays([titles.flatten(), abstracts.flatten()]).dictionary_encode()
    code, first = both.indices.to_numpy().astype(np.int64), len(titles.flatten())
    lens = [np.diff(a.offsets.to_numpy()).astype(np.int32) for a in (titles, abstracts)]
    keys, counts = zip(*(np.unique(c * n + np.repeat(np.arange(n), ls), return_counts=True) for c, ls in zip((code[:first], code[first:]), lens, strict=True)), strict=True)
    every = np.union1d(*keys)
    tf = [np.zeros(len(every), np.int32) for _ in keys]
    for t, k, c in zip(tf, keys, counts, strict=True):
        t[np.searchsorted(every, k)] = c
    docs, start = (every % n).astype(np.int32), np.flatnonzero(np.diff(every // n, prepend=-1))
    term = both.dictionary.take(pa.array(every[start] // n))
    bound = np.append(start, len(every))
    total = lambda v: np.add.reduceat(v, start).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    sums = [total(tf[0] > 0), total(tf[1] > 0), total(tf[0])]
    names = [f.split()[0] for f in LISTS.split(", ")]

    def batch(terms: pa.Array, ns: list[int], binary: list[list[bytes | None]], numbers: list[np.ndarray]) -> pa.RecordBatch:
        same = [pa.array([shard] * len(terms), pa.int32()), pa.array([part] * len(terms), pa.string()), pa.array(ns, pa.int32()), terms.cast(pa.string())]
        return pa.RecordBatch.from_arrays([*same, *(pa.array(b, pa.binary()) for b in binary), *(pa.array(v, pa.int64()) for v in numbers)], names=names)

    yield batch(pa.array([None], pa.string()), [n], [[line.tobytes()], [lens[0].tobytes()], [lens[1].tobytes()], [x.tobytes()]], [[int(lens[0].sum())], [int(lens[1].sum())], [0]])
    for i in range(0, len(start), 4096):
        spans = list(zip(bound[i : i + 4096], bound[i + 1 : i + 4097], strict=False))[: len(start) - i]
        cut = slice(i, i + len(spans))
        yield batch(term[i : i + len(spans)], [int(b - a) for a, b in spans], [*([v[a:b].tobytes() for a, b in spans] for v in (docs, *tf)), [None] * len(spans)], [s[cut] for s in sums])


def write_lists(papers: DataFrame, path: str, config: SearchConfig = SearchConfig(), embedder: Embedder | None = None) -> Lists:
    """Stores the lists of ``papers (line_no, title, abstract)`` under ``path``; shards are those of ``shard_corpus``."""
    spark, embedder = papers.sparkSession, embedder or HashingEmbedder(config.dim)
    total = papers.agg((F.max("line_no") + 1).alias("_total"))
    placed = papers.where("line_no is not null").join(F.broadcast(total)).withColumn("shard_id", shard_of(F.col("line_no"), F.col("_total"), config.shards))  # one row
    rows = placed.select("shard_id", F.col("line_no").cast("bigint").alias("line_no"), words(F.col("title")).alias("title"), words(F.col("abstract")).alias("abstract"), title_and_abstract(F.col("title"), F.col("abstract")).alias("text"))
    most = min(PART, config.doc_block)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = uuid.uuid4().hex[:12], 0
        held: dict[int, list[tuple]] = {}

        def flush(s: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            made += 1
            line, titles, abstracts, x = zip(*held.pop(s), strict=True)
            yield from _inverted(np.concatenate(line), pa.concat_arrays(titles), pa.concat_arrays(abstracts), np.concatenate(x), s, f"{task}-{made:06d}")

        for b in batches:
            shard = b.column(0).to_numpy()
            for s in map(int, np.unique(shard)):
                own = b.filter(pa.array(shard == s))
                for i in range(0, own.num_rows, most):
                    piece = own.slice(i, most)
                    if s in held and sum(len(h[0]) for h in held[s]) + piece.num_rows > most:
                        yield from flush(s)
                    x = np.ascontiguousarray(embedder(piece.column(4).to_pylist()), np.float64)
                    held.setdefault(s, []).append((piece.column(1).to_numpy(), piece.column(2), piece.column(3), x))
        for s in list(held):
            yield from flush(s)

    # small row groups, so that a task that wants one shard's lists reads little of the others
    rows.mapInArrow(invert, LISTS).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    sizes = lists.where("term is null").groupBy("shard_id").agg(F.sum("n").alias("n_docs"), F.sum("df_title").alias("title"), F.sum("df_abstract").alias("abstract"))
    sizes = sizes.select("shard_id", "n_docs", (F.col("title") / F.col("n_docs")).alias("avg_title"), (F.col("abstract") / F.col("n_docs")).alias("avg_abstract"))
    seen = lists.where("term is not null").groupBy("shard_id", "term").agg(F.sum("df_title").alias("df_title"), F.sum("df_abstract").alias("df_abstract"))
    raw = lambda df: F.when(F.col(df) > 0, F.ln(F.col("n_docs") - F.col(df) + 0.5) - F.ln(F.col(df) + 0.5))
    scored = seen.join(F.broadcast(sizes), "shard_id").select("shard_id", "term", raw("df_title").alias("raw_title"), raw("df_abstract").alias("raw_abstract"))  # a row per shard
    scored.repartition("shard_id").sortWithinPartitions("shard_id", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("shard_id").parquet(f"{path}/terms")
    means = spark.read.schema("term string, raw_title double, raw_abstract double, shard_id int").parquet(f"{path}/terms").groupBy("shard_id").agg(F.avg("raw_title").alias("mean_title"), F.avg("raw_abstract").alias("mean_abstract"))
    sizes.join(means, "shard_id", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")
    return Lists(spark, path, config)


def _files(fs: pafs.FileSystem, path: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".parquet"))


def _blocks(lists: Lists, most: int) -> dict[int, list[tuple[list[str], list[tuple[str, list[int]]]]]]:
    """Of each shard, in the order of names, its blocks: their parts, and the row groups that hold them. A row for every few thousand documents."""
    parts: dict[int, list[tuple[str, int]]] = {}
    held = lists.spark.read.parquet(f"{lists.path}/lists").where("term is null").select("shard_id", "part", "n", F.hex(F.substring("docs", 1, 8)).alias("line"))
    for r in sorted(held.collect(), key=lambda r: int.from_bytes(bytes.fromhex(r.line), "little")):
        parts.setdefault(r.shard_id, []).append((r.part, r.n))
    fs, root = pafs.FileSystem.from_uri(lists.path)
    groups: list[tuple[str, int, str, str]] = []
    for f in _files(fs, f"{root}/lists"):
        with fs.open_input_file(f) as opened:
            meta = pq.ParquetFile(opened).metadata
            at = meta.schema.names.index("part")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                groups.append((f, g, *((stats.min, stats.max) if stats is not None and stats.has_min_max else ("", "~"))))
    out: dict[int, list] = {}
    for s in sorted(parts, key=str):
        cuts: list[list[str]] = []
        size = most + 1
        for part, n in parts[s]:
            if size + n > most:
                cuts.append([])
                size = 0
            cuts[-1].append(part)
            size += n
        for own in cuts:
            where: dict[str, list[int]] = {}
            for f, g, low, high in groups:
                if any(low <= p <= high for p in own):
                    where.setdefault(f, []).append(g)
            out.setdefault(s, []).append((own, list(where.items())))
    return out


class _Block:
    """A block of a shard's documents, in the order of their lines, with the lists of the words asked for."""

    def __init__(self, fs: pafs.FileSystem, parts: list[str], where: list[tuple[str, list[int]]], asked: pa.Array, idf: dict[str, tuple[float, float]], averages: tuple[float, float], config: SearchConfig):
        heads, rows = [], []
        for f, groups in where:
            with fs.open_input_file(f) as opened:
                t = pq.ParquetFile(opened).read_row_groups(groups, columns=["part", "n", "term", "docs", "tf_title", "tf_abstract", "vectors"])
            t = t.filter(pc.is_in(t["part"], value_set=pa.array(parts)))
            heads.append(t.filter(pc.is_null(t["term"])))
            rows.append(t.filter(pc.is_in(t["term"], value_set=asked)).drop_columns(["vectors"]))
            del t
        head, rows = pa.concat_tables(heads), pa.concat_tables(rows).combine_chunks()
        del heads
        read = lambda c, kind: np.concatenate([np.frombuffer(v, kind) for v in head[c].to_pylist()])
        line = read("docs", np.int64)
        order = np.argsort(line, kind="stable")
        self.n, self.line, place = len(line), line[order], np.empty(len(line), np.int32)
        place[order] = np.arange(len(line), dtype=np.int32)
        self.x = read("vectors", np.float64).reshape(self.n, -1)[order]
        self.xx = (self.x**2).sum(1)
        self.columns, self.norm = np.ascontiguousarray(self.x.T, np.float32), float(np.sqrt(self.xx.max()))
        before = dict(zip(head["part"].to_pylist(), np.cumsum([0, *head["n"].to_pylist()[:-1]]), strict=True))
        flat = lambda c: np.frombuffer(b"".join(rows[c].to_pylist()), np.int32)
        count = rows["n"].to_numpy()
        own = np.array([before[p] for p in rows["part"].to_pylist()], np.int64)
        by_term = rows["term"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        names, code = by_term.dictionary.to_pylist(), by_term.indices.to_numpy()
        docs = place[flat("docs") + np.repeat(own, count)]
        w = np.zeros(len(docs))
        tfs = flat("tf_title"), flat("tf_abstract")
        start, term = np.cumsum(count) - count, np.repeat(code, count)
        for i, (tf, length, weight, average) in enumerate(zip(tfs, ("tf_title", "tf_abstract"), (config.title_weight, config.abstract_weight), averages, strict=True)):
            own_idf = np.array([idf[t][i] for t in names])
            relative = (read(length, np.int32) / average if average else np.zeros(self.n))[order]
            base = config.k1 * (1 - config.b + config.b * relative)
            for a in range(0, len(w), 1 << 17):  # in steps, which bound the arrays in between
                b = slice(a, a + (1 << 17))
                w[b] += weight * own_idf[term[b]] * tf[b] * (config.k1 + 1) / np.where(tf[b] > 0, tf[b] + base[docs[b]], 1)
        hit = (1 + TITLE * (tfs[0] > 0)).astype(np.int32)
        del rows, head, tfs, term
        pa.default_memory_pool().release_unused()
        # rows of one term, of several parts, next to each other; a word of many documents is held as a full row
        self.lists: dict[str, tuple[np.ndarray | None, np.ndarray, np.ndarray]] = {}
        spans: dict[int, list[slice]] = {}
        for c, a, n in zip(code, start, count, strict=True):
            spans.setdefault(int(c), []).append(slice(int(a), int(a + n)))
        for c, own_spans in spans.items():
            d, v, h = (a[own_spans[0]] if len(own_spans) == 1 else np.concatenate([a[s] for s in own_spans]) for a in (docs, w, hit))
            if len(d) > self.n // 4:
                full, marks = np.zeros(self.n), np.zeros(self.n, np.int32)
                full[d], marks[d] = v, h
                d, v, h = None, full, marks
            self.lists[names[c]] = (d, v, h)

    def _picked(self, row: np.ndarray, at: np.ndarray, rank: np.ndarray, rows: int, k: int) -> np.ndarray:
        """The places in ``at`` of the ``k`` least ``rank`` of each row, those of the earlier place first among equal ones. ``row`` is in order."""
        bound, out = np.searchsorted(row, np.arange(rows + 1)), np.zeros((rows, k), np.int64)
        width = np.diff(bound)
        wide = width > 4 * k + 64
        for r in np.flatnonzero(wide):
            out[r] = bound[r] + np.argsort(rank[bound[r] : bound[r + 1]], kind="stable")[:k]
        some = np.flatnonzero(~wide)
        if len(some):
            grid = np.full((rows, int(width[some].max())), np.inf)
            use = ~wide[row]
            grid[row[use], (np.arange(len(row)) - bound[row])[use]] = rank[use]
            out[some] = bound[some, None] + np.argsort(grid[some], 1, kind="stable")[:, :k]
        return at[out]

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(places, distances)`` of the nearest of each query vector, ``min(k, n)`` each, nearest first."""
        k = min(k, self.n)
        place, dist = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
        if not k:
            return place, dist
        m, qq, minus, xx = self.n // GROUPS, (q**2).sum(1), (-2 * q).astype(np.float32), self.xx.astype(np.float32)
        used = [np.flatnonzero(v) for v in minus]
        step = max(1, CELLS // self.n)
        for i in range(0, len(q), step):
            part = slice(i, min(len(q), i + step))
            e = np.empty((part.stop - i, self.n), np.float32)
            for j, r in enumerate(range(i, part.stop)):  # typed queries have few words, so few places of their vectors count
                np.dot(minus[r, used[r]], self.columns[used[r]], out=e[j])
                e[j] += xx
            if m > k:
                bound = np.partition(e[:, : GROUPS * m].reshape(len(e), GROUPS, m).min(1), k - 1, 1)[:, k - 1]
                error = 4e-5 * (1 + np.sqrt(qq[part]) * self.norm + self.norm**2)
                flat = np.flatnonzero(e <= (bound + error).astype(np.float32)[:, None])
            else:
                flat = np.arange(e.size)
            row, at = flat // self.n, flat % self.n
            d = np.empty(len(at))
            for a in range(0, len(at), 1 << 16):
                b = slice(a, a + (1 << 16))
                d[b] = np.round(np.maximum(0.0, qq[part][row[b]] + self.xx[at[b]] - 2 * np.einsum("ij,ij->i", q[part][row[b]], self.x[at[b]])), 9)
            best = self._picked(row, np.arange(len(at)), d, len(e), k)
            place[part], dist[part] = at[best], d[best]
        return place, dist

    def by_words(self, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(places, top)``: the best of each row of scores, ``min(k, n)`` each, and its greatest score."""
        k, n, top = min(k, self.n), self.n, raw.max(1)
        m, scale = n // GROUPS, top + 1e-9
        if m > k:
            bound = np.partition(raw[:, : GROUPS * m].reshape(len(raw), GROUPS, m).max(1), m - k, 1)[:, m - k]
            sure = bound > 4e-9 * scale
            sure &= top > 0
            least = np.where(sure, bound - 2e-9 * np.abs(scale), np.inf)
            flat = np.flatnonzero(raw >= least[:, None])
            row, at = flat // n, flat % n
        else:
            sure, row, at = np.zeros(len(raw), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.zeros((len(raw), k), np.int64)
        if sure.any():
            number = np.cumsum(sure) - 1
            out[sure] = self._picked(number[row], at, -np.round(raw[row, at] / scale[row], 9), int(sure.sum()), k)
        for r in np.flatnonzero(~sure):
            v = raw[r]
            rows = np.flatnonzero(v)
            if top[r] < 0 or n - len(rows) < k:
                rows = np.arange(n)
            else:  # the first of those without a query word are enough
                rows = np.sort(np.concatenate((rows, np.flatnonzero(v[: k + len(rows)] == 0)[:k])))
            out[r] = rows[np.argsort(-np.round(v[rows] / scale[r], 9), kind="stable")[:k]]
        return out, top


def _search(fs: pafs.FileSystem, root: str, blocks: dict, shards: dict[int, dict], asked: list[list[str]], vectors: np.ndarray, config: SearchConfig) -> tuple[np.ndarray, ...]:
    """``(shard, line, score)`` of each query's reranked shortlist, best first; a line of -1 where there is no more."""
    distinct, vector_of = np.unique(vectors, axis=0, return_inverse=True)
    vector_of, n, kw, kv = vector_of.ravel(), len(asked), config.bm25_per_shard, config.vectors_per_shard
    wanted = pa.array(sorted({t for ts in asked for t in ts}), pa.string())
    times = [{t: ts.count(t) for t in dict.fromkeys(ts)} for ts in asked]
    best = {"fused": np.full((n, 0), -np.inf), "shard": np.zeros((n, 0), np.int32), "line": np.zeros((n, 0), np.int64), "hit": np.zeros((n, 0), np.int32)}
    for s, own in blocks.items():
        stats, idf = shards[s], {}
        for f in _files(fs, f"{root}/terms/shard_id={s}"):
            with fs.open_input_file(f) as opened:
                t = pq.ParquetFile(opened).read()
            t = t.filter(pc.is_in(t["term"], value_set=wanted))
            for term, *raws in zip(*(t[c].to_pylist() for c in ("term", "raw_title", "raw_abstract")), strict=True):
                idf[term] = tuple(0.0 if r is None else config.epsilon * m if r < 0 else r for r, m in zip(raws, (stats["mean_title"], stats["mean_abstract"]), strict=True))
        found: list[tuple] = []
        top = np.full(n, -np.inf)
        near: tuple | None = None
        block = None
        for parts, where in own:
            del block  # before the next one is read
            block = _Block(fs, parts, where, wanted, idf, (stats["avg_title"], stats["avg_abstract"]), config)
            places, dists = block.nearest(distinct, kv)
            k, kn = min(kw, block.n), min(kv, block.n)
            line, score, hit = np.zeros((n, k), np.int64), np.zeros((n, k)), np.zeros((n, k), np.int32)
            n_line, n_score, n_hit, n_dist = np.zeros((n, kn), np.int64), np.zeros((n, kn)), np.zeros((n, kn), np.int32), np.zeros((n, kn))
            more: tuple | None = None
            step = max(1, CELLS // block.n)
            raw, hits = np.zeros((min(step, n), block.n)), np.zeros((min(step, n), block.n), np.int32)
            for i in range(0, n, step):
                part = slice(i, min(n, i + step))
                size = part.stop - i
                raw[:size], hits[:size] = 0, 0
                for j in range(size):
                    r, h = raw[j], hits[j]
                    for t, c in times[i + j].items():
                        if (held := block.lists.get(t)) is not None:
                            d, w, mark = held
                            if d is None:
                                r += w if c == 1 else c * w
                                h += mark
                            else:
                                r[d] += w if c == 1 else c * w
                                h[d] += mark
                at, high = block.by_words(raw[:size], kw)
                each, close = np.arange(size)[:, None], places[vector_of[part]]
                top[part] = np.maximum(top[part], high)
                line[part], score[part], hit[part] = block.line[at], raw[each, at], hits[each, at]
                n_line[part], n_score[part], n_hit[part], n_dist[part] = block.line[close], raw[each, close], hits[each, close], dists[vector_of[part]]
                # a block of several with negative scores only cannot know the order: its best by the other one, too
                for j in np.flatnonzero(high < 0) if len(own) > 1 else ():
                    more = more or (np.full((n, k), -1, np.int64), np.zeros((n, k)), np.zeros((n, k), np.int32))
                    other = np.setdiff1d(np.argsort(-raw[j], kind="stable")[:kw], at[j])
                    for a, v in zip(more, (block.line[other], raw[j, other], hits[j, other]), strict=True):
                        a[i + j, : len(other)] = v
            found += [(line, score, hit), *([more] if more else [])]
            fresh = (n_line, n_dist, n_score, n_hit)
            if near is not None:
                fresh = tuple(np.concatenate(x, 1) for x in zip(near, fresh, strict=True))
                order = np.lexsort((fresh[0], fresh[1]), axis=1)[:, :kv]
                fresh = tuple(np.take_along_axis(x, order, 1) for x in fresh)
            near = fresh
            del raw, hits
            if len(found) > 1:
                found = [_first(found, top, 2 * kw if (top >= 0).all() else None)]
        line, score, hit = _first(found, top, kw) if len(own) > 1 else found[0]
        bm25, at = score / (top + 1e-9)[:, None], [line, near[0]]
        lines, hit = np.concatenate(at, 1), np.concatenate((hit, near[3]), 1)
        fused = np.concatenate((np.where(line < 0, -np.inf, bm25), near[2] / (top + 1e-9)[:, None] + config.vector_weight / (1 + near[1])), 1)
        # one that is found by both counts once, with its vector's part; then in the order of lines
        fused[:, : line.shape[1]][_within(line, near[0])] = -np.inf
        order = np.argsort(lines, 1, kind="stable")
        new = {"fused": fused, "shard": np.full(lines.shape, s, np.int32), "line": lines, "hit": hit}
        joined = {c: np.concatenate((best[c], np.take_along_axis(v, order, 1)), 1) for c, v in new.items()}
        order = np.argsort(-np.round(joined["fused"], 9), 1, kind="stable")[:, : config.shortlist]
        best = {c: np.take_along_axis(v, order, 1) for c, v in joined.items()}
    words_ = np.maximum(1, [len(t) for t in times])[:, None] if n else np.ones((0, 1))
    score = (best["hit"] % TITLE) / words_ + 0.5 * (best["hit"] // TITLE) / words_
    none = np.isneginf(best["fused"])
    order = np.argsort(np.where(none, np.inf, -np.round(score, 9)), 1, kind="stable")
    return tuple(np.take_along_axis(x, order, 1) for x in (best["shard"], np.where(none, -1, best["line"]), score))


def _first(found: list[tuple], top: np.ndarray, k: int | None) -> tuple:
    """The first ``k`` of lists of documents, by their share of the greatest score and by line; those of no line are last."""
    line, score, hit = (np.concatenate(x, 1) for x in zip(*found, strict=True))
    if k is None:
        return line, score, hit
    rank = np.where(line < 0, np.inf, -np.round(score / (top + 1e-9)[:, None], 9))
    order = np.lexsort((line, rank), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (line, score, hit))


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each row of ``a`` has an element of the same row of ``b``; none of less than zero."""
    if not len(a):
        return np.zeros(a.shape, bool)
    low = max(int(a.max(initial=0)), int(b.max(initial=0))) + 1
    row = np.arange(len(a))[:, None] * low
    return np.isin(np.maximum(a, 0) + row, b + row) & (a >= 0)


def search_streamed(lists: Lists, queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``(key, ranked array<struct<shard_id, line_no, score>>)`` for ``queries (key, terms, text, most)``: the first ``most`` of each reranked shortlist.

    ``terms`` are the words, ``text`` what is embedded. Scores are those of ``LexicalReranker``, which needs no text.
    """
    spark, config = lists.spark, lists.config
    embedder = embedder or HashingEmbedder(config.dim)
    blocks, shards = _blocks(lists, min(PART, config.doc_block)), {r.shard_id: r.asDict() for r in spark.read.parquet(f"{lists.path}/shards").collect()}  # a row per shard
    path, n = lists.path, queries.count()
    cores = max(1, spark.sparkContext.defaultParallelism)
    tasks = max(-(-n // config.query_block), min(2 * cores, -(-n // 256)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        held: list[tuple] = []

        def results() -> pa.RecordBatch:
            key, terms, texts, most = zip(*held, strict=True)
            shard, line, score = _search(fs, root, blocks, shards, [list(t or ()) for t in terms], np.ascontiguousarray(embedder(texts), np.float64), config)
            use = (line >= 0) & (np.arange(line.shape[1])[None, :] < np.array(most)[:, None])
            edges = np.concatenate(([0], np.cumsum(use.sum(1)))).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(shard[use]), pa.array(line[use]), pa.array(score[use])], names=["shard_id", "line_no", "score"])
            return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.ListArray.from_arrays(pa.array(edges), rows)], names=["key", "ranked"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                if len(held) == config.query_block:
                    yield results()
                    held.clear()
        if held:
            yield results()

    rows = queries.select("key", "terms", "text", F.col("most").cast("int").alias("most")).repartition(tasks, "key")
    return rows.mapInArrow(run, "key string, ranked array<struct<shard_id:int,line_no:bigint,score:double>>")


def query_keys(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``queries (query_id, query)`` with ``terms`` in order, the ``text`` to embed and a ``key``, equal for queries that have equal results."""
    any_order = embedder is None or isinstance(embedder, HashingEmbedder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted(t) for t in b.column(1).to_pylist()]
            texts = [" ".join(sorted(WORD.findall((q or "").lower()))) if any_order else q or "" for q in b.column(2).to_pylist()]
            keys = [" ".join(t) + "\n" + x for t, x in zip(terms, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(keys, pa.string())], names=["query_id", "terms", "text", "key"])

    return queries.select("query_id", words(F.col("query")).alias("terms"), "query").mapInArrow(run, "query_id string, terms array<string>, text string, key string")
