"""Connected components of a link table, as joins and minimum aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import tasks, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links (a, b): for every node but the roots, the smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = np.array(list(parent), np.int64)
    return nodes, np.array([root(x) for x in nodes.tolist()], np.int64)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of the links (a, b): component is the smallest id that links lead to.

    Each task first shrinks its links to a forest by union-find; then every node hooks its larger neighbours, and after
    that itself and its smaller ones, to the smallest of them, until there are only stars: no node hooks to two others, or to one that hooks itself. The joins have the node on
    both sides and a written minimum per node on one, so a node with very many links is split like any skewed key.
    """
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = forest(np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()]))
            while len(a) > 2_000_000:  # let go of what a task holds; the rounds join it again
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(shrink, "a long, b long").distinct()
    now = written(links, "links")
    for _ in range(max_rounds):
        n = now.count()
        ends = now.select(F.col("a").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(now.select(F.col("b").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        crossed = ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where(F.col("leaf") + F.col("root") > 1)
        if not tasks(crossed, n).count():  # nothing but stars
            break
        cut = lambda df, name: written(tasks(df, n), name)  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(cut(least, "least"), "a").where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        hooked = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
