"""Evaluation texts leaking into a corpus: a generalised suffix automaton over the test items.

All items, as words of their consistent form, are put into one suffix automaton (Blumer et al., 1985, extended to
several strings). Corpus documents stream through it word by word; the automaton's state gives, at each word, the longest run
ending there that occurs in some item, and from its length and the suffix links follow the items whose ``run_words``
consecutive words are complete (all words of an item that has fewer).

The automaton is broadcast: it has at most two states a word of the items, some 400 bytes each as measured, so ``max_item_words``
bounds it (200,000 words: 160 MB a worker). Larger sets are cut into several automata. They are built one after the other, and the
corpus streams past each in a pass of its own, so no task ever holds two. A document is held against the automaton only
where its words can match at all: where consecutive pairs of words all occur in items. That filter is exact, for
a run of ``n`` words holds ``n - 1`` such pairs.

Edge cases: null and empty texts and items leak nothing; an item without words matches nothing; repeated items
and documents each give their own rows once; empty tables give an empty result; texts of any length are streamed whole;
extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.lookalike import consistent_form
from paperloom.runtime import materialize

WORD = re.compile(r"\w+")


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The lower-cased words and where they are in ``text`` itself; a letter whose lower case is longer, with a mark, counts as it stands."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    return [m[0] for m in WORD.finditer(low)], [m.span() for m in WORD.finditer(low)]


def words_of(text: str) -> list[str]:
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else words_at(text)[0]


class Automaton:
    """The suffix automaton of several word lists, with the items complete at each state."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int):
        self.run = run
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        coded = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for k, ws in items if ws]
        for _, ws in coded:
            last, path = 0, []
            for w in ws:
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        # items at a state: those with an end there or below it in the tree of suffix links
        owners: list[set[int]] = [set() for _ in self.link]
        whole: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for (k, ws), _ in zip(coded, ends, strict=True):
            state = 0
            for w in ws:  # states may have been split since, so the item is read again
                state = self.next[state][w]
                up = state
                while up > 0 and k not in owners[up]:
                    owners[up].add(k)
                    up = self.link[up]
            if len(ws) < run:
                whole[state].append((k, len(ws)))
        #: for runs of at least ``run`` words: the ancestor whose runs include the last ``run`` words
        self.items_of_run: list[tuple[int, ...]] = []
        self.whole_items: list[tuple[tuple[int, int], ...]] = []
        for v in range(len(self.link)):
            up = v
            while up > 0 and self.length[self.link[up]] >= run:
                up = self.link[up]
            self.items_of_run.append(tuple(sorted(owners[up])) if self.length[up] >= run else ())
            short, up = [], v
            while up > 0:
                short += whole[up]
                up = self.link[up]
            self.whole_items.append(tuple(short))
        self.shortest = min([run, *(len(ws) for _, ws in coded)])
        pairs = {(a << 32) | b for _, ws in coded for a, b in zip(ws, ws[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def spans(self, words: list[str]) -> tuple[set[int], list[tuple[int, int]]]:
        """The items that leak, and the maximal matching spans ``(start, end)`` of at least the required words."""
        items: set[int] = set()
        spans: list[tuple[int, int]] = []
        if len(words) < self.shortest or not self.vocabulary:
            return items, spans
        ids = np.fromiter([self.vocabulary.get(w, -1) for w in words], np.int64, len(words))
        if self.shortest > 1:
            pair = (ids[:-1] << 32) | ids[1:]
            at = np.searchsorted(self.pairs, pair)
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair if len(self.pairs) else False)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.astype(np.int8), [0]))))
            runs = [(s, e + 1) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s + 1 >= self.shortest]
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
            runs = list(zip(edge[::2], edge[1::2], strict=True))
        nxt, link, length, run = self.next, self.link, self.length, self.run
        for start, end in runs:
            state = matched = 0
            for i in range(start, end):
                w = int(ids[i])
                while state and w not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    matched += 1
                found = 0
                if matched >= run:
                    items.update(self.items_of_run[state])
                    found = matched
                for k, n in self.whole_items[state]:
                    if n <= matched:
                        items.add(k)
                        found = max(found, n)
                if found:
                    s = i + 1 - found
                    while spans and spans[-1][1] >= s and spans[-1][0] >= s:
                        spans.pop()
                    if spans and spans[-1][1] >= s:
                        s = spans.pop()[0]
                    spans.append((int(s), int(i + 1)))
        return items, spans


def _parts_of_items(items: DataFrame, item_key: str, item_text: str, max_item_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items with their words, in parts of at most ``max_item_words`` (one item at least); one part is in memory at a time."""
    formed = consistent_form(items, item_key, item_text, "form").where("form <> ''")
    part, size = [], 0
    for r in formed.toLocalIterator():
        ws = words_of(r.form)
        if part and size + len(ws) > max_item_words:
            yield part
            part, size = [], 0
        part.append((r[0], ws))
        size += len(ws)
    yield part


def _stream(corpus: DataFrame, doc_key: str, doc_text: str, parts: Iterator[list], run_words: int, schema: str, row: object) -> DataFrame:
    """A pass over the corpus for each part of the items; where there are several, texts are brought to their form once for all."""
    formed = consistent_form(corpus, doc_key, doc_text, "form").where("form <> ''")
    spark, names = corpus.sparkSession, [x.split()[0] for x in schema.split(", ")]

    def scan_with(held: object) -> object:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                keys, lists = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for r in row(own, words_of(text)):
                        keys.append(i)
                        lists.append(r)
                fields = list(zip(*lists, strict=True)) if lists else [[] for _ in names[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(f, pa.int64()) for f in fields)], names=names)

        return scan

    found, first = [], next(parts)
    second = next(parts, None)
    if second is not None:
        formed = materialize(formed, "leak-forms")
    for part in (first, second, *parts) if second is not None else (first,):
        held = spark.sparkContext.broadcast(Automaton(part, run_words))
        passed = formed.mapInArrow(scan_with(held), schema)
        if second is not None:  # each pass ends before the next automaton is made
            passed = materialize(passed, "leaks")
            held.destroy()
        found.append(passed)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def find_leaks(corpus: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, run_words: int = 12, max_item_words: int = 200_000) -> DataFrame:
    """``(doc_key, item_key)``: each document with each item of which it holds ``run_words`` words in a row.

    Keys are bigint. ``items`` is read to the driver in parts of ``max_item_words``: it has to be a test set, not a corpus.
    """
    parts = _parts_of_items(items, item_key, item_text, max_item_words)
    return _stream(corpus, doc_key, doc_text, parts, run_words, f"{doc_key} bigint, {item_key} bigint", lambda a, ws: [(k,) for k in sorted(a.spans(ws)[0])])


def leaked_spans(corpus: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, run_words: int = 12, max_item_words: int = 200_000) -> DataFrame:
    """``(doc_key, first_word, last_word, doc_words)``: the spans to remove, words of the consistent form counted from 0.

    Overlapping matches in items of one part are one span; dividing a document's span lengths by ``doc_words`` gives its coverage.
    """
    parts = _parts_of_items(items, item_key, item_text, max_item_words)
    schema = f"{doc_key} bigint, first_word bigint, last_word bigint, doc_words bigint"
    return _stream(corpus, doc_key, doc_text, parts, run_words, schema, lambda a, ws: [(s, e - 1, len(ws)) for s, e in a.spans(ws)[1]])


def remove_leaks(corpus: DataFrame, doc_key: str, doc_text: str, spans: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """``(doc_key, clean, dropped)``: the consistent form without the leaked spans; a document covered by more than ``max_coverage`` is dropped."""
    formed = consistent_form(corpus, doc_key, doc_text, "form")
    cuts = spans.groupBy(doc_key).agg(F.sort_array(F.collect_list(F.struct("first_word", "last_word"))).alias("cuts"), F.max("doc_words").alias("doc_words"))
    # words that several spans cover count once: each span adds what lies beyond the end of those before it
    reach = F.aggregate("cuts", F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")), lambda acc, c: F.struct(F.greatest(acc["end"], c["last_word"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), c["last_word"] - F.greatest(acc["end"], c["first_word"] - 1))).alias("n")))
    cuts = cuts.withColumn("covered", reach["n"])
    joined = formed.join(cuts, doc_key, "left").select(F.col(doc_key).alias("k"), "form", "cuts", (F.coalesce(F.col("covered") / F.col("doc_words"), F.lit(0.0)) > max_coverage).alias("dropped"))
    key_type = joined.schema["k"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for form, cuts_, dropped in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if dropped or form is None:
                    out.append(None if form is None else "")
                elif not cuts_:
                    out.append(form)
                else:
                    places = words_at(form)[1]  # the same cut into words as the spans'
                    parts, at = [], 0
                    for c in cuts_:
                        if places[c["last_word"]][1] > at:  # spans of several parts of the items may overlap
                            parts.append(form[at : max(at, places[c["first_word"]][0])])
                            at = places[c["last_word"]][1]
                    out.append("".join([*parts, form[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3)], names=[doc_key, "clean", "dropped"])

    return joined.mapInArrow(cut, f"{doc_key} {key_type}, clean string, dropped boolean")
