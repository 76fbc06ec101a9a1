"""The inverted file of cells against an exact scan."""

import pytest
from pyspark.sql import functions as F

from paperloom.config import SearchConfig
from paperloom.operators.vectors import CellIndex, nearest_per_shard
from paperloom.plans import catalog


def recall_of(got, true):
    keys = ["query_id", "shard_id", "doc_ord"]
    return got.select(*keys).intersect(true.select(*keys)).count() / true.count()


def test_probes_reach_the_recall_by_default(spark, tmp_path):
    """Vectors without clusters, where few probes lose most neighbours; the persisted index knows its probes, too."""
    import numpy as np

    x = np.random.default_rng(3).normal(size=(4000, 16))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    df = spark.createDataFrame([(i % 2, i // 2, [float(v) for v in r]) for i, r in enumerate(x)], "shard_id int, doc_ord int, vector array<double>")
    asked = df.where("doc_ord % 20 = 7").select((F.col("doc_ord") * 2 + F.col("shard_id")).alias("query_id"), "vector")
    index = CellIndex(df, SearchConfig(dim=16))
    for k in (10, 50):
        true = nearest_per_shard(df, asked, k)
        assert recall_of(index.search_many(asked, k), true) >= 0.9 > recall_of(index.search_many(asked, k, probes=4), true)
    index.save(str(tmp_path))
    loaded = CellIndex.load(spark, str(tmp_path), SearchConfig(dim=16))
    assert loaded.calibrated == index.calibrated and set(index.calibrated) == {10, 50, 200}
    assert loaded.probes_for(10) == index.probes_for(10) < 44 == loaded.probes_for(201)


def test_registered_batch(spark):
    d = "/root/testdata/sf0.01"
    asked, vectors = catalog._asked_vectors(spark, d), catalog._vectors(spark, d)
    got = catalog.queries()["ivf_batch_topk"](spark, d)
    true = nearest_per_shard(vectors, asked, 10)
    assert asked.count() >= 30 and {r[0] for r in got.select("vec_no").distinct().collect()} == {r[0] for r in asked.select("query_id").collect()}
    assert recall_of(got.withColumnRenamed("vec_no", "query_id"), true) >= 0.9
    assert got.groupBy("vec_no", "shard_id").count().agg(F.max("count")).first()[0] == pytest.approx(10)
