"""Connected components over an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidy


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: each node is left with one edge, to the smallest node it reaches here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(parent)]
    pairs = np.array([p for p in pairs if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)
    yield pa.record_batch({"src": pa.array(pairs[:, 0]), "dst": pa.array(pairs[:, 1])})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Minima are aggregated before the shuffle, and the join may be split where a node has many edges."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    met = both.join(low, "src")
    if large:
        out = met.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = met.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
    return out.where("src > dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (src long, dst long) in either direction → (node, root): every node with an edge, root the smallest it reaches.

    Null ends and loops are left out; an empty table gives an empty one. Rounds end when a round changes nothing;
    every round is written to the shared folder, so the plan stays short and lost executors cost one round at most.
    """
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst")
    now = materialise(edges.mapInArrow(tidy(_local_stars), "src long, dst long").distinct())
    # Stars: every src has one edge, and no dst is a src. Where that holds already, no round is needed.
    for _ in range(max_rounds):
        ends = now.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not ends and not now.join(now.select(F.col("src").alias("dst")), "dst", "left_semi").limit(1).count():
            break
        then = materialise(_star(_star(now, large=True), large=False))
        discard(now)
        now = then
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
