"""Connected components of a link table that no machine could hold.

Links are contracted by a union-find inside each task, then by alternating rounds that hang every
node's larger neighbours, and then its smaller ones, on the smallest node around it, until every
component is a star. Rounds are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import stored

LINK = "u long, v long"


def find(parent: dict[int, int], x: int) -> int:
    """The root of x; the path to it is halved on the way."""
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = parent[x]
    return x


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent, u), find(parent, v)
            parent.setdefault(u, a)
            parent.setdefault(v, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(parent, x) != x]
    roots = [find(parent, x) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that is not the smallest of its component.

    ``links`` has two long columns. Null ends and links of a node with itself say nothing; repeated
    links and links in both directions count once. No links give no rows.
    """
    u, v = links.columns
    # A link with a null end is null in the comparison and goes as well.
    whole = links.where(F.col(u) != F.col(v))
    edges = whole.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = stored(edges.mapInArrow(_forest, LINK), "links")
    while True:
        # Stars: every node hangs on one other, and nothing hangs on a node that hangs.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
        if ends.where("ups > 1 or ups = 1 and low = 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Larger neighbours hang on the smallest node around u.
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Smaller neighbours, and u itself, hang on the smallest.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("v"), "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        edges = stored(small.mapInArrow(_forest, LINK), "links")
