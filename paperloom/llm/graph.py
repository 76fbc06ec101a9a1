"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import materialize


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """One row ``(node, component)`` per linked node; ``component`` is the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014); every round is written to the shared folder, so lineage stays short and no executor's
    loss repeats earlier rounds. Rounds grow with the logarithm of the longest chain. Null ends and self-links are
    ignored; an empty table gives an empty result.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = materialize(edges, "links")
    last = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: of every node's lesser neighbours, all point to the least
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "links")
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"the components did not settle within {max_rounds} rounds")
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rooted.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
