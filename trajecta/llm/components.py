"""Connected components of a table of links, by contraction on the cluster.

Each round maps every node to the smallest node among itself and its neighbours, rewrites
the links by that map and drops loops and repeats. An edge (v, f(v)) becomes (f(v), f(f(v))),
so nothing that was connected comes apart, and at least every other node vanishes from each
component. Maps are written to the shared folder; in the end they are chained. Hubs are met
by partial aggregation (minimum) and by joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root) for every node that has a link; root is the smallest node
    of its component in the order of the column's type. No links: no rows."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(links.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        step = saved(both(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "map")
        maps.append(step)
        moved = edges.join(step.toDF("a", "fa"), "a").join(step.toDF("b", "fb"), "b")
        edges = saved(moved.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).where("a <> b").distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].toDF("node", "root")
    for step in maps[1:]:
        out = out.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return saved(out, "roots")
