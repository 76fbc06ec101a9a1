"""Several values packed in one field: split by the dialect of least description length.

A *dialect* says how a field was packed: a quoting style (``list`` for a bracketed list literal, ``quoted``
for values in double quotes, ``plain``), the strong delimiters that separate values, and what commas and
joining words do (``keep``: part of a value, ``split``: always separate, ``join``: only the words separate,
``mixed``: decided at each occurrence by the cheapest choice, each that is kept paying for its place).

1. Every field is parsed with every dialect that its characters allow. The values' *forms* (the sequence of
   word, initial, particle and sign classes) are counted over the whole table, each parse weighing
   one share of its field: a distributed aggregation with a map-side combine. Counting is repeated with
   the posterior weights of the parses.
2. The counts give each form a code length. A parse costs the code lengths of its values plus those of its
   dialect. Every field is then parsed with its cheapest dialect.

The code table sent to the executors has at most ``max_forms`` forms (the most frequent ones) and all dialects; other forms, whose
number is ``Parser.escaped``, count in the totals and share an escape code priced by length, so no field is left unparsed, and
the codes of frequent forms do not depend on the bound.

Edge cases: null, blank and value-free fields give no rows; null keys are kept; repeated rows give repeated
output; an empty table gives an empty result; extra columns are never read. A field of any length is parsed
whole, in time linear in its length.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.runtime import materialize

STRONG = {";": ";", "|": r"\|+", "/": "/", "·": "·", "•": "•", "\n": r"[\r\n]+", "\t": r"\t+", " - ": r"\s[-–—]\s"}
#: Fixed words of names: particles, suffixes, function words and generic parts of organisation names.
PARTICLES = frozenset("of for and the de la van von der den del di da du le".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md".split())
ORGANISATION = frozenset("university univ institute inst laboratory laboratories lab labs centre center ctr department dept college school collaboration consortium group team academy tech technology".split())
CLOSING = re.compile(r"(?:^|[\s,;&])(?:and\s+|&\s*)?(?:et\.?\s+al\.?|others|u\.\s?a\.)$", re.IGNORECASE)
JOINING = re.compile(r"^(?:and\b|&|with\b)\s*|\s+(?:and|&)$")
NOTE = re.compile(r"\s*\([^()]*\)")
WEAK = re.compile(r"\s*,(?:\s*(?:and|&)(?=\s))?\s*|\s+(?:and|&)\s+")
QUOTED = re.compile(r'"((?:[^"]|"")*)"')
BEFORE = re.compile(r"(?:^|[,;|/·•\n\t&]|\sand|\s[-–—])\s*$")
AFTER = re.compile(r"\s*(?:$|[,;|/·•\n\t&(]|and\s|[-–—]\s|et al)")
#: Bits to spell one token of a form. HOLD marks the place of a value that was taken out with its quotes; a character of the private use area.
TOKEN_BITS = 4.0
HOLD = "\ue000"
TOKEN = re.compile(r"\"[^\"]*\"|[^\W_][\w'’.\-]*|[\t\r\n]+|\S")
JOINS = re.compile(r"\s*,?\s+(?:and|&)\s+")


@dataclass(frozen=True)
class PackedOptions:
    max_forms: int = 20_000
    rounds: int = 3


@lru_cache(200_000)
def form(value: str) -> str:
    """The classes of a value's tokens, for instance ``W I W`` or ``W , W``."""
    out = []
    for t in TOKEN.findall(value):
        word = t.rstrip(".").lower()
        if t[0] == '"' and len(t) > 1:
            out.append("N")
        elif word in PARTICLES or word in SUFFIXES:
            out.append(word)
        elif word in ORGANISATION:
            out.append("O")
        elif not (t[0].isalnum()):
            out.append(t if t.strip() else "\\n")
        elif len(word) == 1:
            out.append("I" if word.isalpha() else "9")
        elif re.fullmatch(r"(?:\w\.-?)+", t):
            out.append("I")
        else:
            out.append("W" if word[0].isalpha() else "9")
    return " ".join(out)


#: Words that the parser looks at; all others count by their class only.
LITERAL = PARTICLES | SUFFIXES | ORGANISATION | {"et", "al", "others", "with"}
SPELLED = {"W": "Xx", "I": "X.", "9": "9"}
PLAIN_WORD = re.compile(r"[^\W_][\w'’.\-]*")


@lru_cache(200_000)
def _stand_in(word: str) -> str:
    return word if word.rstrip(".").lower() in LITERAL else SPELLED.get(form(word), word)


def skeleton(field: str) -> str:
    """The field with each word replaced by one that stands for its class: fields of one skeleton have the same parses."""
    s = field.strip()
    if (values := _as_list(s)) is not None:
        return json.dumps([skeleton(v) for v in values])
    return PLAIN_WORD.sub(lambda m: _stand_in(m[0]), s)


@lru_cache(200_000)
def _clean_value(piece: str) -> str:
    v = " ".join(piece.split()).strip(" ,;")
    while True:
        w = JOINING.sub("", CLOSING.sub("", v)).strip(" ,;")
        if w == v:
            return v
        v = w


def _as_list(s: str) -> list[str] | None:
    if not (s.startswith("[") and s.endswith("]")):
        return None
    for load in (json.loads, ast.literal_eval):
        try:
            found = load(s)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(found, list):
            return ["" if x is None else str(x) for x in found]
    return None


def _mask(s: str) -> tuple[str, list[str]]:
    """Replaces values in packing quotes by placeholders of the private use area."""
    kept: list[str] = []

    def one(m: re.Match) -> str:
        if BEFORE.search(s[max(0, m.start() - 8) : m.start()]) and AFTER.match(s, m.end()):
            kept.append(m[1].replace('""', '"'))
            return HOLD + chr(0xF0000 + len(kept) - 1)
        return m[0]

    return QUOTED.sub(one, s), kept


def _restore(value: str, kept: list[str]) -> str:
    if HOLD not in value:
        return value
    return re.sub(f"{HOLD}(.)", lambda m: kept[ord(m[1]) - 0xF0000], value)


def _finish(pieces: Iterable[str], kept: list[str]) -> list[str]:
    out = []
    for p in pieces:
        v = _clean_value(p)
        if kept and v:
            v = _clean_value(NOTE.sub("", _restore(v, kept)))
        if v:
            out.append(v)
    return out


class Parser:
    """Enumerates the parses of a field; with code lengths, picks the cheapest."""

    def __init__(self, codes: dict[str, float] | None, escape: float, dialects: dict[str, float] | None):
        self.codes, self.escape, self.dialects = codes, escape, dialects or {}
        self._chosen: dict[str, str | None] = {}
        #: Forms of the table that have no entry of their own.
        self.escaped = 0

    def cost(self, value: str) -> float:
        f = form(value)
        if f in SUFFIXES:
            return 4.0 * self.escape
        found = self.codes.get(f) if self.codes is not None else None
        return found if found is not None else self.escape + TOKEN_BITS * (1 + f.count(" "))

    def _mixed(self, segment: str, kept: list[str]) -> list[str]:
        """The cheapest choice of separating commas and joining words in one segment; a value may join any number of pieces."""
        cuts = list(WEAK.finditer(segment))
        starts = [0, *(m.end() for m in cuts)]
        ends = [*(m.start() for m in cuts), len(segment)]
        best: list[tuple[float, int, list[str]]] = [(0.0, -1, [])]
        each = 1.0 + math.log2(len(starts))
        least = [0.0]  # of any start up to this one, the cost before it less the glue saved by starting no earlier
        for j in range(1, len(starts) + 1):
            found: tuple[float, int, list[str]] = (math.inf, -1, [])
            for i in range(j - 1, -1, -1):
                if least[i] + (j - 1) * each >= found[0]:
                    break  # for all starts from here on, glue and what comes before cost too much
                before = best[i][0] + (j - 1 - i) * each
                if before < found[0]:
                    values = _finish([segment[starts[i] : ends[j - 1]]], kept)
                    if (cost := before + sum(map(self.cost, values))) < found[0]:
                        found = (cost, i, values)
            best.append(found)
            least.append(min(least[-1], found[0] - j * each))
        out: list[list[str]] = []
        j = len(starts)
        while j > 0:
            out.append(best[j][2])
            j = best[j][1]
        return [v for part in reversed(out) for v in part]

    def parses(self, field: str, only: str | None = None) -> Iterator[tuple[str, list[str]]]:
        """``(dialect, values)`` of every dialect the field allows, or of one of them."""
        s = field.strip()
        if not s:
            return
        if (values := _as_list(s)) is not None:
            yield "list", _finish((NOTE.sub("", v) for v in values), [])
            return
        text, kept = _mask(s) if '"' in s else (s, [])
        text = NOTE.sub("", text) if "(" in text else text
        quote = "quoted" if kept else "plain"
        present = [d for d in STRONG if d in text or (d == " - " and re.search(STRONG[d], text))]
        for chosen in [(), *((d,) for d in present), *([tuple(present)] if len(present) > 1 else [])]:
            name = f"{quote} {''.join(chosen)!r}"
            if only and not only.startswith(f"{name} "):
                continue
            segments = re.split("|".join(STRONG[d] for d in chosen), text) if chosen else [text]
            mode = only and only[len(name) + 1 :]
            if mode in (None, "keep"):
                yield f"{name} keep", _finish(segments, kept)
            if only is None and not any(WEAK.search(x) for x in segments):
                continue
            if mode in (None, "split"):
                apart = _finish((p for x in segments for p in WEAK.split(x)), kept)
                yield f"{name} split", apart
            if mode in (None, "join") and any(JOINS.search(x) for x in segments):
                yield f"{name} join", _finish((p for x in segments for p in JOINS.split(x)), kept)
            if mode == "mixed" or mode is None and self.codes is not None and not self._settled(name, apart):
                yield f"{name} mixed", [v for x in segments for v in self._mixed(x, kept)]

    def _code(self, name: str) -> float:
        return self.dialects.get(name) or (self.dialects.get(name[:-5] + "split", 12.0) + 2.0 if name.endswith("mixed") else 14.0)

    def _settled(self, name: str, apart: list[str]) -> bool:
        """Whether no mixed parse can be cheaper than the split one: each has to pay for one kept delimiter at least."""
        return sum(map(self.cost, apart)) + self._code(f"{name} split") <= self._code(f"{name} mixed") + 2.0

    def scored(self, field: str) -> list[tuple[float, str, list[str]]]:
        # a line break or tab inside a value is lost when white space is collapsed, so it is paid for here
        breaks = {repr(d)[1:-1]: 2 * TOKEN_BITS * field.strip().count(d) for d in "\n\t" if d in field.strip()}
        hidden = lambda name: sum(n for d, n in breaks.items() if d not in name)
        return [(sum(map(self.cost, values)) + self._code(name) + hidden(name), name, values) for name, values in self.parses(field)]

    def best(self, field: str | None) -> tuple[str | None, list[str]]:
        """The cheapest dialect, which is the same for all fields of a skeleton, and the field's values in it."""
        if not isinstance(field, str):
            return None, []
        kind = skeleton(field)
        if kind not in self._chosen:
            if len(self._chosen) > 100_000:
                self._chosen.clear()
            self._chosen[kind] = min(self.scored(kind), key=lambda x: x[0], default=(0.0, None, []))[1]
        name = self._chosen[kind]
        return next(((n, v) for n, v in self.parses(field, name) if n == name), (None, []))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(skeleton(x) for x in batch.column(0).to_pylist())
        counts.pop("", None)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["field", "n"])


def _count(batches: Iterator[pa.RecordBatch], parser: Parser) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for field, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if parser.codes is None:
                found = [(1.0, *x) for x in parser.parses(field)]
                weights = [1.0] * len(found)
            else:
                found = parser.scored(field)
                least = min((x[0] for x in found), default=0.0)
                weights = [2.0 ** max(-60.0, least - x[0]) for x in found]
            total = sum(weights)
            for w, (_, name, values) in zip(weights, found, strict=True):
                if w < 1e-6 * total:
                    continue
                counts["d", name] += n * w / total
                for v in values:
                    counts["f", form(v)] += n * w / total
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([c for _, c in counts], pa.string()), pa.array(list(counts.values()), pa.float64())], names=["kind", "code", "n"])


def learn_codes(df: DataFrame, column: str, options: PackedOptions = PackedOptions()) -> Parser:
    """The code lengths of all forms and dialects of ``column``, counted over the whole table.

    Rows are first counted by skeleton, so each round parses a skeleton once, whatever its rows.
    """
    parser = Parser(None, 0.0, None)
    fields = df.select(F.col(f"`{column}`").cast("string").alias("field")).where("field is not null")
    kinds = fields.mapInArrow(_skeletons, "field string, n bigint").groupBy("field").agg(F.sum("n").alias("n"))
    # as many files as cores, for a round of parsing is work, however small the table
    kinds = materialize(kinds.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "field"), "field-skeletons")
    for _ in range(options.rounds):
        counted = kinds.mapInArrow(lambda it, p=parser: _count(it, p), "kind string, code string, n double").groupBy("kind", "code").agg(F.sum("n").alias("n"))
        counted = materialize(counted, "field-codes")
        total = {r.kind: (r.n, r.codes) for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("codes")).collect()}  # two rows
        # dialects are few by their making and never cut
        rows = counted.where("kind = 'd'").unionByName(counted.where("kind = 'f'").orderBy(F.desc("n"), "code").limit(options.max_forms)).collect()
        parser = _parser_of([(r.kind, r.code, r.n) for r in rows], {k: n for k, (n, _) in total.items()})
        parser.escaped = max(0, total.get("f", (0.0, 0))[1] - options.max_forms)
    return parser


def _parser_of(rows: list[tuple[str, str, float]], counted: dict[str, float]) -> Parser:
    """Code lengths from the counts of ``rows``; ``counted`` are the totals of all forms and dialects, those without an entry included."""
    total = {k: counted.get(k, 0.0) + 1.0 for k in "fd"}
    lengths = {k: {code: -math.log2(n / total[k]) for kind, code, n in rows if kind == k} for k in "fd"}
    for kind, f, n in rows:
        if kind == "f":  # a form's own entry costs its tokens, shared by its uses
            spelled = TOKEN_BITS * (1 + f.count(" "))
            lengths["f"][f] = min(lengths["f"][f] + spelled / n, math.log2(total["f"]) + spelled)
    return Parser(lengths["f"], math.log2(total["f"]), lengths["d"])


def split_packed(df: DataFrame, key: str, column: str, options: PackedOptions = PackedOptions(), value: str = "value", carried: dict[str, Column] | None = None) -> DataFrame:
    """One row ``(key, pos, value, dialect)`` for each value of ``column``; ``pos`` counts from 1. ``carried`` columns follow by their names."""
    parser = learn_codes(df, column, options)
    carried = carried or {}
    source = df.select(F.col(f"`{column}`").cast("string").alias("_field"), F.col(f"`{key}`").alias(key), *[c.alias(n) for n, c in carried.items()]).where("_field is not null")
    key_type, names = source.schema[1].dataType, [key, "pos", value, "dialect", *carried]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parser.best(x) for x in batch.column(0).to_pylist()]
            rows = pa.array([i for i, (_, v) in enumerate(parsed) for _ in v], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(rows),
                    pa.array([i for _, v in parsed for i in range(1, len(v) + 1)], pa.int32()),
                    pa.array([x for _, v in parsed for x in v], pa.string()),
                    pa.array([d for d, v in parsed for _ in v], pa.string()),
                    *(c.take(rows) for c in batch.columns[2:]),
                ],
                names=names,
            )

    schema = T.StructType([T.StructField(key, key_type), T.StructField("pos", T.IntegerType()), T.StructField(value, T.StringType()), T.StructField("dialect", T.StringType()), *source.schema.fields[2:]])
    return source.mapInArrow(parse, schema)
