"""Connected components by alternating star operations (Kiveris et al., 2014).

Edges are first reduced to forests within tasks. Then each round links, for every node, its larger neighbours to
the smallest one (large star) and its smaller ones to the smallest one (small star), until nothing changes. Every
round is written to the shared folder. Hubs don't gather in one task: minima are aggregated before the shuffle,
and the joins are ones whose large partitions Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component; by repeated minima over edges and pointer jumps."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        if (root == before).all():
            break
    return nodes, nodes[root]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes, root = roots(batch["a"].to_numpy(), batch["b"].to_numpy())
        keep = nodes != root
        yield pd.DataFrame({"a": nodes[keep], "b": root[keep]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b); component: the smallest node that links reach."""
    star = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(_forest, "a long, b long").distinct(), "edges")
    state = None
    while True:
        both = star.select("a", "b").union(star.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Every edge now runs from a larger to a smaller node.
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = large.join(small, large["a"] == small["n"])
        star = stored(joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    own = star.select("b").distinct().select("b", F.col("b").alias("c"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)
