"""Queries against all rows, in blocks: scores of a block of documents for a block of queries in one task.

A shard is cut into blocks of ``doc_block`` documents and the queries into blocks of ``query_block``. Each pair of blocks meets in
one task, which holds the inverted lists and vectors of its documents as flat arrays, adds up the scores of a query in an array of
the block's documents, and sends on only the block's best for each query. So neither a frequent word nor a popular query
multiplies rows: what is shuffled is every block's documents once for each block of queries, and a short list per query and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words asked for up to which they reach the scan as a filter, and up to which they are broadcast.
LITERAL_WORDS, BROADCAST_WORDS = 1_000, 500_000


def stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def first_of(rank: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` least of ``rank``, those of the lesser place first among equal ones; in no order."""
    if k >= len(rank):
        return np.arange(len(rank))
    edge = np.partition(rank, k - 1)[k - 1]
    sure = np.flatnonzero(rank < edge)
    return np.concatenate((sure, np.flatnonzero(rank == edge)[: k - len(sure)]))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared L2 distances, of nine digits."""
    return np.round(np.maximum(0.0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T), 9)


def in_steps(queries: int, documents: int) -> Iterator[slice]:
    """Slices of the queries that bound a matrix of them and the documents."""
    step = max(1, (1 << 23) // max(1, documents))
    for i in range(0, queries, step):
        yield slice(i, i + step)


def tasks_for(spark, groups: int) -> int:
    """Partitions for ``groups`` keys: enough that two keys seldom share a task, and that all cores work."""
    return max(1, min(4 * groups, max(4 * spark.sparkContext.defaultParallelism, groups)))


def query_blocks(queries: DataFrame, size: int) -> int:
    """The number of blocks of the (materialised) queries."""
    return max(1, -(-queries.count() // size))


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, doc_block: int, query_block: int) -> DataFrame:
    """``(query_id, shard_id, doc_ord, distance)``: the ``k`` nearest documents of every block for every query, by squared L2 distance.

    ``vectors (shard_id, doc_ord, vector)`` and ``queries (query_id, vector)`` should be stored tables, for both are read twice.
    """
    spark = vectors.sparkSession
    # new names, for queries may be rows of the vectors
    queries = queries.select(F.col("query_id").alias("asked"), F.col("vector").alias("wanted")).where("wanted is not null")
    vectors = vectors.select("shard_id", "doc_ord", "vector").where("vector is not null").withColumn("block", F.floor(F.col("doc_ord") / doc_block).cast("int"))
    held = [(r.shard_id, r.block) for r in vectors.select("shard_id", "block").distinct().collect()]  # a row for every doc_block documents
    blocks = spark.createDataFrame(held, "shard_id int, block int")
    n = query_blocks(queries, query_block)
    parts, key = tasks_for(spark, n * len(held)), ["shard_id", "block", "qb"]
    left = vectors.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(parts, *key)
    right = queries.withColumn("qb", F.pmod(F.xxhash64("asked"), F.lit(n)).cast("int")).join(F.broadcast(blocks)).repartition(parts, *key)
    id_type = queries.schema["asked"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        asked, place, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            x, doc, q = stack(left["vector"]), left["doc_ord"].to_numpy(), stack(right["wanted"])
            order = np.argsort(doc, kind="stable")
            x, doc = x[order], doc[order]
            for part in in_steps(len(q), len(x)):
                d = distances(q[part], x)
                for i, row in enumerate(d):
                    best = first_of(row, k)
                    asked.append(np.full(len(best), part.start + i))
                    place.append(doc[best])
                    dist.append(row[best])
        at = np.concatenate(asked)
        shard = left["shard_id"][0].as_py() if left.num_rows else 0
        return pa.table({"query_id": right["asked"].combine_chunks().take(pa.array(at)) if len(at) else right["asked"].combine_chunks().slice(0, 0), "shard_id": pa.array(np.full(len(at), shard, np.int32)), "doc_ord": pa.array(np.concatenate(place).astype(np.int32)), "distance": pa.array(np.concatenate(dist))})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, f"query_id {id_type}, shard_id int, doc_ord int, distance double")


def asked_only(queries: DataFrame, *lists: DataFrame) -> list[DataFrame]:
    """Of ``lists (term, ..)`` the rows of the words in ``queries (.., terms)``: few words reach the scan as a filter, more are joined."""
    few = queries.select("terms").limit(LITERAL_WORDS + 1).collect()
    some = {t for r in few for t in r.terms or ()}
    if len(few) <= LITERAL_WORDS and len(some) <= LITERAL_WORDS:
        return [x.where(F.col("term").isin(sorted(some))) for x in lists]
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    held = F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted
    return [x.join(held, "term", "left_semi") for x in lists]


def hybrid_in_blocks(impacts: DataFrame, sizes: list[tuple[int, int]], queries: DataFrame, by_words: int, by_vector: int, doc_block: int, query_block: int, vectors: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """``(query_id, shard_id, top, docs, raw, distance)``: for every query and block, the candidates by words and by distance.

    ``impacts (shard_id, term, doc_ord, w)`` are inverted lists, ``sizes`` the shards with their numbers of documents, and
    ``queries (query_id, terms, vector)`` a stored table. ``top`` is the block's greatest score, documents without a query word
    (which score zero) included; ``distance`` is null for candidates that are not among the block's nearest. Nearest are those
    of ``vectors (shard_id, doc_ord, vector)``, or what ``near (query_id, shard_id, doc_ord, distance)`` says; without either, words alone count.

    A shard's scores are divided by its greatest one, which turns their order round where that is negative; a block
    of several that has only negative scores cannot know, and sends its best by both orders.
    """
    spark = impacts.sparkSession
    n = query_blocks(queries, query_block)
    blocks = [(s, b, min(doc_block, size - b * doc_block), size) for s, size in sizes for b in range(-(-size // doc_block))]
    table = F.broadcast(spark.createDataFrame(blocks or [(-1, 0, 0, 0)], "shard_id int, block int, n int, n_docs int"))  # a row for every doc_block documents
    parts, key = tasks_for(spark, n * len(blocks)), ["shard_id", "block", "qb"]
    block = F.floor(F.col("doc_ord") / doc_block).cast("int").alias("block")
    # empty lists, not null ones: the JVM's Arrow writer counts null lists anew for every row
    stock = asked_only(queries, impacts)[0].select("shard_id", block, "doc_ord", "term", "w", F.array().cast("array<double>").alias("vector"))
    if vectors is not None and near is None:
        stock = stock.unionByName(vectors.where("vector is not null").select("shard_id", block, "doc_ord", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("w"), "vector"))
    left = stock.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(parts, *key)
    asked = queries.select("query_id", "terms", F.coalesce("vector", F.array().cast("array<double>")).alias("vector"), F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("qb")).join(table)
    if near is not None:
        given = near.groupBy("query_id", "shard_id", block).agg(F.collect_list(F.struct("doc_ord", "distance")).alias("given"))  # by_vector of each at most
        asked = asked.join(given, ["query_id", "shard_id", "block"], "left").withColumns({"near_docs": F.coalesce("given.doc_ord", F.array().cast("array<int>")), "near_dist": F.coalesce("given.distance", F.array().cast("array<double>"))}).drop("given")
    right, by_cells = asked.repartition(parts, *key), near is not None
    id_type = queries.schema["query_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: list[list] = [[], [], [], []]
        shard = 0
        if right.num_rows:
            shard, first, size, whole = (right[c][0].as_py() for c in ("shard_id", "block", "n", "n_docs"))
            first *= doc_block
            lists = left.filter(pc.is_valid(left["term"]))
            coded = pc.dictionary_encode(lists["term"].combine_chunks())
            place = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            doc, w = lists["doc_ord"].to_numpy()[order] - first, lists["w"].to_numpy()[order]
            bound = np.searchsorted(code[order], np.arange(len(place) + 1))
            held = left.filter(pc.greater(pc.list_value_length(left["vector"]), 0))
            x, at = stack(held["vector"]), held["doc_ord"].to_numpy() - first
            order = np.argsort(at, kind="stable")
            x, at = x[order], at[order]
            known = pc.greater(pc.list_value_length(right["vector"]), 0).to_numpy(zero_copy_only=False)
            words, none = right["terms"].to_pylist(), np.zeros(0, np.int64)
            given = list(zip(right["near_docs"].to_pylist(), right["near_dist"].to_pylist(), strict=True)) if by_cells else None
            for part in in_steps(right.num_rows, max(len(x), size)):
                mine = np.flatnonzero(known[part])
                row_of = {int(m): r for r, m in enumerate(mine)}
                d = distances(stack(right["vector"].combine_chunks()[part].take(pa.array(mine))), x) if len(mine) and len(x) else None
                for i, ws in enumerate(words[part]):
                    codes = [c for c in (place.get(t) for t in ws or ()) if c is not None]
                    if codes:
                        raw = np.bincount(np.concatenate([doc[bound[c] : bound[c + 1]] for c in codes]), np.concatenate([w[bound[c] : bound[c + 1]] for c in codes]), size)
                    else:
                        raw = np.zeros(size)
                    top = float(raw.max())
                    found = [first_of(-np.round(raw / (top + 1e-9), 9), by_words)]
                    if top < 0 and size < whole:
                        found.append(first_of(-raw, by_words))
                    if given is not None:
                        docs_, dist_ = given[part.start + i]
                        close, far = (np.array(docs_, np.int64) - first, np.array(dist_)) if docs_ else (none, np.zeros(0))
                    elif d is not None and i in row_of:
                        best = first_of(d[row_of[i]], by_vector)
                        close, far = at[best], d[row_of[i]][best]
                    else:
                        close, far = none, np.zeros(0)
                    docs = np.unique(np.concatenate((*found, close)))
                    dist = np.full(len(docs), np.nan)
                    dist[np.searchsorted(docs, close)] = far
                    for o, v in zip(out, (top, docs + first, raw[docs], dist), strict=True):
                        o.append(v)
        tops, docs, raw, dist = out
        edges = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in docs]))).astype(np.int32))
        flat = lambda xs, t: pa.array(np.concatenate(xs).astype(t) if xs else np.zeros(0, t), from_pandas=True)
        return pa.table({"query_id": right["query_id"], "shard_id": pa.array(np.full(len(tops), shard, np.int32)), "top": pa.array(tops, pa.float64()), "docs": pa.ListArray.from_arrays(edges, flat(docs, np.int32)), "raw": pa.ListArray.from_arrays(edges, flat(raw, np.float64)), "distance": pa.ListArray.from_arrays(edges, flat(dist, np.float64))})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, f"query_id {id_type}, shard_id int, top double, docs array<int>, raw array<double>, distance array<double>")


def fuse_blocks(found: DataFrame, by_words: int, by_vector: int, vector_weight: float, shortlist: int | None) -> DataFrame:
    """``(query_id, place, shard_id, doc_ord, bm25, similarity, fused)`` of every query's candidates, or of its ``shortlist``, best first.

    A task holds one query's lists: ``by_words + by_vector`` documents a block at most. Ties go by shard order and position.
    """
    id_type = found.schema["query_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        count = np.diff(t["docs"].combine_chunks().offsets.to_numpy())
        shard = np.repeat(t["shard_id"].to_numpy(), count)
        flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        doc, raw, dist = flat("docs"), flat("raw"), flat("distance")
        top = np.repeat(t["top"].to_numpy(), count)
        kept, bm25, similarity = np.zeros(len(doc), bool), np.zeros(len(doc)), np.zeros(len(doc))
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            score = raw[own] / (top[own].max() + 1e-9)
            bm25[own] = score
            kept[own[np.lexsort((doc[own], -np.round(score, 9)))[:by_words]]] = True
            near = own[~np.isnan(dist[own])]
            near = near[np.lexsort((doc[near], dist[near]))[:by_vector]]
            similarity[near] = 1 / (1 + dist[near])
            kept[near] = True
        at = np.flatnonzero(kept)
        fused = bm25 + vector_weight * similarity
        name = shard.astype(str)
        at = at[np.lexsort((doc[at], name[at], -np.round(fused[at], 9)))][:shortlist]
        return pa.table({"query_id": t["query_id"].combine_chunks().take(pa.array(np.zeros(len(at), np.int64))), "place": pa.array(np.arange(1, len(at) + 1, dtype=np.int32)), "shard_id": pa.array(shard[at].astype(np.int32)), "doc_ord": pa.array(doc[at].astype(np.int32)), "bm25": pa.array(bm25[at]), "similarity": pa.array(similarity[at]), "fused": pa.array(fused[at])})

    return found.groupBy("query_id").applyInArrow(run, f"query_id {id_type}, place int, shard_id int, doc_ord int, bm25 double, similarity double, fused double")
