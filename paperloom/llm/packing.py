"""Filling fixed-capacity containers with texts, measured in tokens of a public tokenizer.

Bounded-space online packing: every task keeps at most ``windows`` open containers per capacity. A text goes to the
open container that it leaves fullest (best fit); if it fits nowhere and all windows are open, the fullest is emitted
and a new one opened. So memory is fixed whatever the input, and texts are neither sorted nor shuffled. What a
task has left open at its end is merged afterwards, whole windows at a time, by best fit in decreasing order, in groups
of at most ``merge_group`` windows, so no task gathers all of them.

A text is split only if it alone exceeds the capacity: into full containers and one remainder that is packed like any
other text.

Edge cases: a null or empty text, or one that the tokenizer drops, takes a place of no tokens; repeated rows are packed
each; an empty table or no valid capacity gives an empty result; null and non-positive capacities are ignored; of equally
full windows the one opened first is taken; extra columns are never read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import materialize

#: How byte-level vocabularies of ranks split text before merging (public GPT-2 pattern).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class PackingOptions:
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    windows: int = 64
    merge_group: int = 20_000


def token_counter(name: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """Counts tokens with the vocabulary in ``data``; the library follows from the file's suffix."""
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode())
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    raise ValueError(f"no tokenizer library for {name}")


@dataclass
class _Windows:
    """The open containers of one capacity in one task."""

    capacity: int
    limit: int
    first: int
    opened: int = 0
    free: list[tuple[int, int]] = field(default_factory=list)
    items: dict[int, int] = field(default_factory=dict)

    def _open(self) -> int:
        self.opened += 1
        return self.first + self.opened - 1

    def place(self, n: int) -> tuple[int, int, int]:
        """The container, place and offset of an item of ``n`` tokens."""
        k = bisect_left(self.free, (n, -1))
        if k < len(self.free):
            left, container = self.free.pop(k)
        else:
            if len(self.free) >= self.limit:
                self.items.pop(self.free.pop(0)[1])
            left, container = self.capacity, self._open()
        at = self.items.get(container, 0)
        if left - n:
            self.items[container] = at + 1
            insort(self.free, (left - n, container))
        else:
            self.items.pop(container, None)
        return container, at, self.capacity - left

    def alone(self) -> int:
        return self._open()


def pack(texts: DataFrame, key: str, text: str, sizes: DataFrame, options: PackingOptions = PackingOptions(), profile: str = "profile", capacity: str = "capacity") -> DataFrame:
    """``(profile, key, piece, first_token, n_tokens, container, place, offset)``: where every text or piece of a text goes.

    ``place`` counts a container's items from 0, ``offset`` its tokens before the item. ``sizes`` is a parameter
    table of ``(profile, capacity)``.
    """
    spark = texts.sparkSession
    profiles = [(r[0], int(r[1])) for r in sizes.select(profile, capacity).where(F.col(capacity) > 0).distinct().orderBy(profile, capacity).collect()]  # a parameter table
    source = texts.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    key_type = source.schema["k"].dataType.simpleString()
    vocabulary = spark.sparkContext.broadcast(Path(options.tokenizer).read_bytes())
    out = f"kind int, profile string, capacity int, k {key_type}, piece int, first_token bigint, n_tokens int, container bigint, place int, offset int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(options.tokenizer, vocabulary.value)
        task = TaskContext.get().partitionId()
        windows = [_Windows(c, options.windows, task << 36) for _, c in profiles]
        key_kind = None
        names = [x.split()[0] for x in out.split(", ")]

        def batch_of(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            kind, which, piece, first, n, container, place, offset = zip(*rows, strict=True) if rows else ([],) * 8
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array([profiles[i][0] for i in which], pa.string()), pa.array([profiles[i][1] for i in which], pa.int32()), keys, pa.array(piece, pa.int32())]
                + [pa.array(x, t) for x, t in ((first, pa.int64()), (n, pa.int32()), (container, pa.int64()), (place, pa.int32()), (offset, pa.int32()))],
                names=names,
            )

        for batch in batches:
            key_kind = batch.column(0).type
            at, rows = [], []
            for i, n in enumerate(count([t or "" for t in batch.column(1).to_pylist()])):
                for which, w in enumerate(windows):
                    whole = (n - 1) // w.capacity if n > w.capacity else 0
                    for piece in range(whole):
                        rows.append((0, which, piece, piece * w.capacity, w.capacity, w.alone(), 0, 0))
                    rest = n - whole * w.capacity
                    rows.append((0, which, whole, whole * w.capacity, rest, *w.place(rest)))
                    at += [i] * (whole + 1)
            yield batch_of(batch.column(0).take(pa.array(at, pa.int64())), rows)
        if key_kind is not None:
            rows = [(1, which, 0, 0, w.capacity - left, container, w.items[container], 0) for which, w in enumerate(windows) for left, container in w.free]
            yield batch_of(pa.nulls(len(rows), key_kind), rows)

    placed = materialize(source.mapInArrow(run, out), "packed")
    left = placed.where("kind = 1").select("profile", "capacity", "container", F.col("n_tokens").alias("filled"), F.col("place").alias("items"))
    groups = left.groupBy("profile", "capacity").agg(F.ceil(F.count("*") / options.merge_group).cast("int").alias("groups"))
    salted = left.join(F.broadcast(groups), ["profile", "capacity"]).withColumn("salt", F.pmod(F.xxhash64("container"), F.col("groups")))  # a row per profile

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        cap = int(f["capacity"].iloc[0])
        free: list[tuple[int, int]] = []
        used: dict[int, int] = {}
        rows = []
        for filled, container, items in f.sort_values(["filled", "container"], ascending=[False, True])[["filled", "container", "items"]].itertuples(index=False):
            k = bisect_left(free, (filled, -1))
            room, into = free.pop(k) if k < len(free) else (cap, container)
            rows.append((f["profile"].iloc[0], container, into, used.get(into, 0), cap - room))
            used[into] = used.get(into, 0) + items
            if room - filled:
                insort(free, (room - filled, into))
        return pd.DataFrame(rows, columns=["profile", "container", "into", "place_shift", "offset_shift"])

    moves = salted.groupBy("profile", "capacity", "salt").applyInPandas(merge, "profile string, container bigint, into bigint, place_shift int, offset_shift int")
    moves = materialize(moves, "packed-moves")
    joined = placed.where("kind = 0").join(moves, ["profile", "container"], "left")
    return joined.select(
        F.col("profile"),
        F.col("k").alias(key),
        "piece",
        "first_token",
        "n_tokens",
        F.coalesce("into", "container").alias("container"),
        (F.col("place") + F.coalesce("place_shift", F.lit(0))).alias("place"),
        (F.col("offset") + F.coalesce("offset_shift", F.lit(0))).alias("offset"),
    )


def packing_report(packed: DataFrame, sizes: DataFrame, profile: str = "profile", capacity: str = "capacity") -> DataFrame:
    """``(profile, capacity, tokens, containers, least_containers, filled)`` of each profile; no packing needs fewer than ``least_containers``."""
    used = packed.groupBy(F.col(profile), "container").agg(F.sum("n_tokens").alias("n")).groupBy(profile).agg(F.sum("n").alias("tokens"), F.count("*").alias("containers"))
    least = F.ceil(F.col("tokens") / F.col(capacity))
    return used.join(sizes.select(profile, capacity), profile).select(profile, capacity, "tokens", "containers", least.alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col(capacity))).alias("filled"))
