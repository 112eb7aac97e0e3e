"""Connected components of an edge list, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, collected, fitted, materialise, release, tasks, with_group


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for the nodes of ``edges(a, b)``.

    Every partition first draws its own edges together to stars, and after these are written, and laid in
    as few partitions as they fill, once more. If they fill one, that is all; else large-star and
    small-star steps alternate: each node hands its neighbours to the smallest one it knows, so that the
    number of rounds follows the logarithm of a component's length. A node's smallest neighbour comes
    from ``with_group``, so that a node with very many neighbours is no hot key. Each step is written
    out, and the one before it deleted. The result is one of the written steps: the caller may
    release it."""
    apart = materialise(_drawn(edges.where("a <> b").select("a", "b")), "edges")
    n = apart.count()
    now = materialise(_drawn(fitted(apart, n)), "edges")
    release(apart)
    while tasks(n) > 1 and not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = with_group(both, ["a"], {"m": F.min("b")}, 2 * now.count()).withColumn("m", F.least("a", "m"))
        # large star: neighbours that are larger than the node go to its smallest neighbour
        large = materialise(low.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        release(now)
        # small star: the smaller neighbours and the node go to the smallest of them
        small = with_group(large, ["a"], {"m": F.min("b")}, large.count()).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = materialise(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        release(large)
    stars = fitted(now)
    out = materialise(stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    release(now)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every node that points to another one points to one root only."""
    if collected(edges.groupBy("a").count().where("count > 1").limit(1)):
        return False
    return not collected(edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1))


def _drawn(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars: (a, b) for each of its nodes a and the smallest one, b, that it
    reaches by them, if that is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for b in batches:
            joins(root, b.column(0).to_pylist(), b.column(1).to_pylist())
        for x in root:
            up = x
            while root.get(up, up) != up:
                up = root[up]
            root[x] = up
        nodes = [x for x, up in root.items() if x != up]
        for k in range(0, len(nodes), ROWS):
            part = nodes[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root[x] for x in part], pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def joins(root: dict, a: list, b: list) -> list[bool]:
    """For each edge, in order, whether it joins what is not joined yet; ``root`` keeps the state."""

    def find(x):
        at = x
        while (up := root.get(at, at)) != at:
            at = up
        while root.get(x, x) != at:
            root[x], x = at, root[x]
        return at

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        out.append(p != q)
        root[max(p, q)] = min(p, q)
    return out
