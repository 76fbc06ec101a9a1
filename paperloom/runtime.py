"""Session helpers shared by all operators: durable intermediate tables and size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_PRIVATE: list[str] = []
_SHIPPED: set[str] = set()
#: Intermediate tables of this process, with their path and settings in the JVM. They may be needed until the results that read them
#: are, so only ``clean`` or the end of the process removes them.
_MADE: list[tuple[str, tuple]] = []
#: Tables that later calls use again, by what they were made of.
_KEPT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: what the session names in spark.checkpoint.dir.

    Where the setting is absent, a single machine gets a private folder; a cluster, whose executors could not read it, an error.
    The session's settings stay as they are.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _PRIVATE:
        _PRIVATE.append(tempfile.mkdtemp(prefix="paperloom-"))
    return f"file://{_PRIVATE[0]}"


@atexit.register
def _clean() -> None:
    for path, (held, conf) in _MADE:
        if path.startswith("file:///"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        else:
            try:  # as long as the session lives
                held.getFileSystem(conf).delete(held, True)
            except Exception:  # noqa: BLE001 - a stopped JVM cannot be asked any more
                pass
    for path in [*_LOCAL, *_PRIVATE]:
        shutil.rmtree(path, ignore_errors=True)


def clean(spark: SparkSession) -> int:
    """Deletes the intermediate tables made so far, on any file system; returns their number. Results that read them must have been used."""
    made, _MADE[:] = list(_MADE), []
    _KEPT.clear()
    for path, _ in made:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(made)


def ship(spark: SparkSession) -> None:
    """Sends this package to all executors, once per application, so that Python workers need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="paperloom-code-")
    _LOCAL.append(folder)
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{folder}/paperloom.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(f"{folder}/paperloom.zip")
    _SHIPPED.add(context.applicationId)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table; no two calls share one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((path, (spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())))
    return path


def kept(spark: SparkSession, name: str, source: str, make: Callable[[str], None]) -> str:
    """The path of a table made once per application by ``make(path)`` of the file or folder ``source``, and again when that has changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status, size = fs.getFileStatus(p), fs.getContentSummary(p).getLength()
    key = (spark.sparkContext.applicationId, name, source, size, status.getModificationTime())
    if key not in _KEPT:
        path = table_path(spark, name)
        make(path)
        _KEPT[key] = path
    return _KEPT[key]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, most: int = 1_000) -> DataFrame:
    """``df``, computed once: up to ``most`` rows travel with the plan, more are written as ``materialize`` does. For tables of typed queries."""
    rows = df.limit(most + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= most else materialize(df, name)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(os.path.join(sf_dir, f"{n}.parquet")) for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
