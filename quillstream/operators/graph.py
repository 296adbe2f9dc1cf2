"""Connected components of links, on the executors.

Links are dealt by range of both ends, so a node with very many links lies in many parts, and each part is contracted where it lies to
stars: a row for each of its nodes. Nodes that several parts hold link the roots of these parts, and those links, far fewer where links
are local, are solved in the same way. Where contraction does not thin them out, large-star and small-star rounds (Kiveris et al.,
2014) hang every node onto its smallest neighbour until nothing changes: logarithmically many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.lineage import cut

#: Links that one task contracts at a time.
BLOCK = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and the smallest node that each one reaches: labels sink along links, then along labels."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def _stars(batches):
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if parts:
        node, root = least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """links (a, b): long ids without nulls; they may repeat, and stand in either order. Returns (node, component) of every node that is linked with
    another, component being the smallest id reachable."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    n = links.count()
    parts = max(1, -(-n // block))
    if parts == 1:
        return cut(links.coalesce(1).mapInArrow(_stars, "node long, root long")).toDF("node", "component")
    stars = cut(links.repartitionByRange(parts, "a", "b").mapInArrow(_stars, "node long, root long"))
    own = stars.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    up = cut(stars.join(own.where("least < most"), "node").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct())
    if up.count() > n // 2:
        return _rounds(links)
    solved = components(up, block).toDF("root", "component")
    out = own.select("node", F.col("least").alias("root")).join(solved, "root", "left")
    return cut(out.select("node", F.coalesce("component", "root").alias("component")))


def _rounds(edges: DataFrame) -> DataFrame:
    """edges (a, b) with a > b, each once, to (node, component)."""
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        edges = cut(small.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return cut(edges.toDF("node", "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
        before = state
