"""Frequency of every distinct term, kept up to date by signed deltas.

The store holds, for each field and term, the number of occurrences and of records that hold it, in parquet
folders by a hash of the term (buckets), and the number of records. A *manifest* names the folder of every bucket and the batches merged so far. A batch of changes becomes a *delta*:
records added count +1, records deleted -1, changed records -1 with their old and +1 with their new text.
Only those records are tokenised; their counts are combined on the map side and shuffled once by term. A merge
reads the buckets that the delta touches, writes them anew beside the old ones without terms whose counts fell to zero, and commits by
writing a new manifest; every other bucket stays as it is. So a merge that dies half way leaves the counts as they were, and a
batch that is merged again, by its name, changes nothing.

A term is a longest run of letters, digits and underscores, lower-cased. A term that occurs in a third of all
rows is one partial count per map task, whatever the rows.

Edge cases: null and empty texts have no terms but count as records; a repeated record counts as often as it is
added; an empty batch changes nothing; a delta that deletes what was never added raises no error and leaves negative
counts, which ``counts`` shows; extra columns are never read, and a record's columns may be named ``term`` or ``field``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import words
from paperloom.runtime import materialize, table_path

SCHEMA = "field string, term string, occurrences bigint, records bigint"


def term_delta(records: DataFrame, fields: Sequence[str], sign: int | Column = 1) -> DataFrame:
    """``(field, term, occurrences, records)``: the signed counts of a batch, one row per field and term.

    The row with a null term holds the number of records.
    """
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    kept = records.select(sign.cast("bigint").alias("s"), *[F.sort_array(words(F.col(f"`{f}`"))).alias(f"w{i}") for i, f in enumerate(fields)])
    runs = []
    for i, f in enumerate(fields):
        flat = kept.select("s", F.col(f"w{i}").alias("ws"), F.posexplode(f"w{i}").alias("i", "term"))
        first = (F.col("i") == 0) | (F.get("ws", F.col("i") - 1) != F.col("term"))
        runs.append(flat.select(F.lit(f).alias("field"), "term", F.col("s").alias("o"), F.when(first, F.col("s")).otherwise(F.lit(0)).alias("r")))
    total = kept.select(F.lit("").alias("field"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("o"), F.col("s").alias("r"))
    union = total
    for run in runs:
        union = union.unionByName(run)
    return union.groupBy("field", "term").agg(F.sum("o").alias("occurrences"), F.sum("r").alias("records"))


def changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``(sign, fields...)``: what turns ``old`` into ``new``, by a key unique in each; unchanged records drop out."""
    k = F.col(f"`{key}`")
    row = lambda df, side: df.select(k.alias("k"), F.struct(*[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)]).alias(side))
    joined = row(old, "old").join(row(new, "new"), "k", "full").where("not (old <=> new)")
    signed = joined.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("v")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("v")))).alias("e")).where("e.v is not null")
    return signed.select("e.sign", *[F.col(f"e.v.f{i}").alias(f) for i, f in enumerate(fields)])


class TermStore:
    """Persistent counts under ``path``; an existing store is opened. The first batch decides the number of buckets, one for each
    ``bucket_terms`` of its terms, as more batches mostly bring terms again."""

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_terms: int = 500_000):
        self.spark, self.path, self.bucket_terms = spark, path or table_path(spark, "term-store"), bucket_terms
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._load()

    def _load(self) -> dict:
        """The newest manifest; a folder without one is an empty store."""
        folder = self._jpath(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        versions = [int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return {"version": 0, "buckets": 0, "batches": [], "folders": {}}
        stream = self._fs.open(self._jpath(f"{self.path}/manifest-{max(versions)}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Written aside and renamed, which is one step: a reader finds the whole manifest or the one before."""
        aside, final = self._jpath(f"{self.path}/manifest-{manifest['version']}.tmp"), self._jpath(f"{self.path}/manifest-{manifest['version']}.json")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(aside, final):
            raise RuntimeError(f"version {manifest['version']} of the counts was written by another merge")
        self.manifest = manifest

    def _read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        folders = self.manifest["folders"]
        paths = [f"{self.path}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def merge(self, delta: DataFrame, batch: str | None = None) -> bool:
        """Adds a delta and returns whether it did: a ``batch`` of a name that is in already is left out. The delta is computed once."""
        old = self.manifest
        if batch is not None and batch in old["batches"]:
            return False
        delta = materialize(delta.select("field", "term", "occurrences", "records"), "term-delta")
        buckets = old["buckets"] or max(16, -(-delta.count() // self.bucket_terms))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        delta = delta.withColumn("bucket", bucket)
        touched = sorted(r.bucket for r in delta.select("bucket").distinct().collect())  # a number for each bucket
        before = self._read(touched).withColumn("bucket", bucket)
        merged = before.unionByName(delta).groupBy("bucket", "field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences <> 0 or records <> 0")
        version = old["version"] + 1
        rows = merged.repartition(min(len(touched), 2_000) or 1, "bucket").sortWithinPartitions("bucket", "field", "term")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        written = {s.getPath().getName() for s in self._fs.listStatus(self._jpath(f"{self.path}/v{version}"))}
        folders = {b: f for b, f in old["folders"].items() if int(b) not in touched} | {str(b): f"v{version}/bucket={b}" for b in touched if f"bucket={b}" in written}
        self._commit({"version": version, "buckets": buckets, "batches": [*old["batches"], *([batch] if batch is not None else [])], "folders": folders})
        return True

    def drop_old(self) -> int:
        """Removes folders that the manifest no longer names; results that read them must have been used."""
        kept = set(self.manifest["folders"].values())
        gone = 0
        for version in range(1, self.manifest["version"] + 1):
            folder = self._jpath(f"{self.path}/v{version}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                name = s.getPath().getName()
                if name.startswith("bucket=") and f"v{version}/{name}" not in kept:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone

    def counts(self) -> DataFrame:
        """``(field, term, occurrences, records)`` of every term."""
        return self._read().where("term is not null").select("field", "term", "occurrences", "records")

    def total(self) -> int:
        """The number of records."""
        return self._read().where("term is null").agg(F.sum("records")).first()[0] or 0

    def marks(self, rare: int = 2, common: float = 0.2) -> DataFrame:
        """The terms too rare (in at most ``rare`` records) or too common (in more than a share of all) to be useful."""
        limit = common * self.total()
        band = F.when(F.col("records") <= rare, "rare").when(F.col("records") > limit, "common")
        return self.counts().withColumn("band", band).where("band is not null")
