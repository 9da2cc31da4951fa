"""Connected components of an edge table, by joins-free star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def components(edges: DataFrame, folder: str, most_rounds: int = 50) -> DataFrame:
    """(node, label): every node of `edges` (columns a, b of one type) with the smallest node that it can reach.

    Alternates large-star and small-star contraction until the edges stay the same; each round is written to `folder` in the
    shared storage, so lineage stays short and a lost executor costs one round. Only two numbers a round reach the driver.
    Null ends, loops and repeated edges add nothing; an empty table gives an empty result.
    """
    star = Window.partitionBy("a")
    now = edges.select("a", "b").filter("a <> b").distinct()
    last = None
    for k in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least(F.min("b").over(star), F.col("a"))).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).withColumn("m", F.min("b").over(star))
        small = down.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = common.saved(small.filter("a <> b").distinct(), f"{folder}/round{k}")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
