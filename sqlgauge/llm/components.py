"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is one minimum per node (summed up before the shuffle) and a join back to the links;
links are stored after each round, which cuts the lineage. Nodes with very many links need no
task of their own: the minimum is pre-aggregated and the join splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Links are long ids in columns ``a`` and ``b``; direction, repeats and self-links do not
    matter. Null ends are no link. Nodes without a link are not in the result.
    """
    larger, smaller = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = store(now.select(larger, smaller).distinct(), "links")
    before = _state(now)
    while before[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = _least(large)
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = store(small, "links")
        after = _state(now)
        if after == before:
            break
        before = after
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionAll(roots)
