"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``a``, ``b``): the smallest node
    that it reaches.

    Alternating stars: each node hands its smallest neighbour to its larger neighbours, then
    each larger end of an edge hands the smallest one to the others, until every edge is
    (node, smallest).  Rounds grow with the logarithm of the longest path; each is a written
    table, and only two numbers of it reach the driver.
    """
    plain = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        found = plain.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not found[0] or (found[0], found[1]) == state:
            return plain.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (found[0], found[1])
        both = plain.union(plain.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        plain = written(small.union(low.select("u", F.col("low").alias("v"))).distinct(), "edges")
