"""Spelling correction against the words of the titles, by a join on shortened words.

Two words within edit distance d share a string that is left when up to d letters are deleted from each, and so do their first
``PREFIX`` letters (or one of those and less of the other); so candidates come from an equality join of the deletion
neighbourhoods of prefixes (Bocek et al., 2007), at most 37 a word whatever its length, and the exact distance then decides.
The correction of several words follows the rules of the public symmetric-delete spelling method (SymSpell, W. Garbe, 2012):
words are corrected one by one, joined with their neighbour or split in two, whichever is nearest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.config import SearchConfig
from paperloom.functions.spelling import deletions, osa, osa_distance
from paperloom.functions.text import words
from paperloom.runtime import materialize, settle

#: The corpus size that frequencies of split words are divided by (public word-frequency lists count 2**40 words or so).
SPLIT_SCALE = 1024908267229


def word_frequency(docs: DataFrame, column: str = "title") -> DataFrame:
    """``(word, freq)``: occurrences of every word of a field, over all shards."""
    return docs.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


#: Letters of a word that its deletion neighbourhood is made of.
PREFIX = 8


def _neighbourhood(df: DataFrame, column: str, most: int) -> DataFrame:
    """A row for each shortened form of the first letters of ``column``; words are expanded once each, whatever their number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [sorted(deletions(w[:PREFIX], most)) for w in b.column(0).to_pylist()]
            at = pa.array([i for i, x in enumerate(lists) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([s for x in lists for s in x], pa.string())], names=[column, "short"])

    return df.select(column).where(F.col(column).isNotNull()).distinct().mapInArrow(run, f"{column} string, short string")


def shortened(dictionary: DataFrame, most: int = 2) -> DataFrame:
    """``(word, freq, length, short)``: the dictionary's deletion neighbourhoods, to be stored with an index."""
    return _neighbourhood(dictionary, "word", most).join(dictionary.select("word", "freq"), "word").select("word", "freq", F.length("word").alias("length"), "short")


def lookup(terms: DataFrame, dictionary: DataFrame, most: int = 2, near: DataFrame | None = None) -> DataFrame:
    """``(term, word, distance, freq)``: the best word of each ``term`` that has one within ``most`` edits.

    Best is nearest, then most frequent, then first in order. Terms are taken as they are, not lower-cased. A term that the
    dictionary has is its own best. ``near`` are stored neighbourhoods (``shortened``).
    """
    near = shortened(dictionary, most) if near is None else near
    terms = terms.select("term").where("term is not null").distinct()
    longest = dictionary.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("_longest"))
    held = terms.join(dictionary.select(F.col("word").alias("term"), "freq"), "term", "left")
    known = held.where("freq is not null").select("term", F.col("term").alias("word"), F.lit(0).alias("distance"), "freq")
    # a term that is longer than any word by more than the limit has no partner
    unknown = held.where("freq is null").join(F.broadcast(longest)).where(F.length("term") <= F.col("_longest") + most).select("term")  # one row
    found = _neighbourhood(unknown, "term", most).join(near, "short").where(F.abs(F.length("term") - F.col("length")) <= most)
    # the built-in distance counts a swap twice, so it prunes at twice the limit; a short distance by it is the distance
    plain = F.levenshtein("term", "word", 2 * most)
    found = found.select("term", "word", "freq").distinct().withColumn("plain", plain).where("plain >= 0")
    ranked = found.withColumn("distance", osa_distance("term", "word")).where(F.col("distance") <= most).groupBy("term").agg(F.min(F.struct("distance", (-F.col("freq")).alias("f"), "word")).alias("best"))
    return ranked.select("term", "best.word", "best.distance", (-F.col("best.f")).alias("freq")).unionByName(known)


TERM = re.compile(r"\w+")


def _cuts(word: str) -> list[str]:
    return [p for i in range(1, len(word)) for p in (word[:i], word[i:])]


def compound(query: str, found: dict[str, tuple[str, int, float]], most: int) -> str:
    """A query's words corrected, joined with their neighbour or split, given the lookups of all parts."""
    ws = TERM.findall(query.lower())
    out: list[tuple[str, int, float]] = []
    joined = False
    unknown = lambda w: (w, most + 1, 10 / 10 ** min(300, len(w)))
    for i, w in enumerate(ws):
        own = found.get(w)
        if i and not joined and (both := found.get(ws[i - 1] + w)):
            last, mine = out[-1], own or unknown(w)
            apart = last[1] + mine[1]
            if both[1] + 1 < apart or both[1] + 1 == apart and both[2] > last[2] / SPLIT_SCALE * mine[2]:
                out[-1] = (both[0], both[1] + 1, both[2])
                joined = True
                continue
        joined = False
        if own and (own[1] == 0 or len(w) == 1):
            out.append(own)
            continue
        best = own
        for k in range(1, len(w)):
            a, b = found.get(w[:k]), found.get(w[k:])
            if not a or not b:
                continue
            text = f"{a[0]} {b[0]}"
            d = osa(w, text, most)
            if best is not None and d > best[1]:
                continue
            count = a[2] / SPLIT_SCALE * b[2]
            if best is None or d < best[1] or count > best[2]:
                best = (text, d, count)
        out.append(best or unknown(w))
    return " ".join(x[0] for x in out)


def correct(queries: DataFrame, dictionary: DataFrame, config: SearchConfig = SearchConfig(), near: DataFrame | None = None) -> DataFrame:
    """``(query_id, query, corrected)``: the query to run; the query as typed where correction only repeats it in lower case.

    All words and joined neighbours of all queries, and the splits of words that the dictionary lacks, are looked up in one join.
    Pieces that are longer than any word by more than the limit are never made.
    """
    most = config.max_edit_distance
    typed = queries.select("query_id", "query").where("query is not null")
    asked = settle(typed.select("query").distinct(), "spelled-queries")
    longest = (dictionary.agg(F.max(F.length("word"))).first()[0] or 0) + most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, terms, alone = [], [], []
            for i, q in enumerate(b.column(0).to_pylist()):
                ws = TERM.findall(q.lower())
                for t, one in [*((w, True) for w in dict.fromkeys(ws)), *((a + b_, False) for a, b_ in dict.fromkeys(zip(ws, ws[1:], strict=False)))]:
                    rows.append(i)
                    terms.append(t)
                    alone.append(one)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(alone, pa.bool_())], names=["query", "term", "alone"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[p for p in _cuts(t) if len(p) <= longest] if len(t) <= 2 * longest else [] for t in b.column(1).to_pylist()]
            at = pa.array([i for i, x in enumerate(lists) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([p for x in lists for p in x], pa.string())], names=["query", "term"])

    words_ = materialize(asked.mapInArrow(split, "query string, term string, alone boolean"), "spelled-words")
    unknown = words_.where("alone").join(dictionary.select(F.col("word").alias("term")), "term", "left_anti").select("query", "term")
    parts = materialize(words_.select("query", "term").unionByName(unknown.mapInArrow(cut, "query string, term string")).distinct(), "spelled-parts")
    best = lookup(parts.select("term"), dictionary, most, near)
    gathered = parts.join(best, "term").groupBy("query").agg(F.collect_list(F.struct("term", "word", "distance", "freq")).alias("found"))
    texts = asked.join(gathered, "query", "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                known = {x["term"]: (x["word"], x["distance"], float(x["freq"])) for x in found or ()}
                c = compound(q, known, most)
                out.append(c if c and c != q.lower() else q)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["query", "corrected"])

    chosen = texts.select("query", "found").mapInArrow(choose, "query string, corrected string")
    return typed.join(chosen, "query").select("query_id", "query", "corrected")
