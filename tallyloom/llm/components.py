"""Connected components by alternating large-star and small-star rounds.

Links stay in DataFrames; nothing of the graph goes to the driver but a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes that aren't the least, of the links given."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, up := root[root]):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """As few links as connect what the links of each block of a partition connect."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            a, b = forest(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

        for batch in rows:
            us.append(batch.column("u").to_numpy(zero_copy_only=False))
            vs.append(batch.column("v").to_numpy(zero_copy_only=False))
            if sum(map(len, us)) > most:
                yield out()
                us, vs = [], []
        if us:
            yield out()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round: each node hands its larger (large) or smaller (small) neighbours its least one."""
    away = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = links.select("u", "v").unionByName(away) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = around.join(least.withColumnRenamed("u", "of"), F.col("u") == F.col("of"))
    if large:
        made = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root (the least node it is linked with, over any path) for each node with a link, roots excepted.

    ``edges`` has long columns u and v. Each round is written, so a lost executor costs one round.
    """
    links = written(contracted(edges).filter("u != v").distinct(), "components")
    for _ in range(rounds):
        state = links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        links = written(_star(_star(links, True), False), "components")
        if state == links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first():
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
