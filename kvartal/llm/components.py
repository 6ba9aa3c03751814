"""Connected components of an edge list, without one task ever holding a component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.operators.joins import lookup_join
from kvartal.session import materialise


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' components under the links ``a[i]``-``b[i]``."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # Hook both ends' present roots to the lower one, then shorten all paths.
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node.

    Alternates large and small stars: every node links its larger neighbours, then its smaller
    ones, to the smallest node it sees. Each step is an aggregate and a join, so a hub with any
    share of the edges is combined before its shuffle and its join partition can be split.
    Every step is written, which cuts the lineage and survives a lost executor.
    """

    def starred(links: DataFrame) -> DataFrame:
        return lookup_join(links, links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_low")), ["a"])

    def state(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = materialise(edges.where("a != b").select("a", "b").distinct(), "edges")
    last = None
    while (now := state(links)) != last:
        last = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = starred(both).where("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct()
        small = starred(large)
        links = materialise(
            small.select(F.col("b").alias("a"), F.col("_low").alias("b"))
            .unionByName(small.select("a", F.col("_low").alias("b")))
            .where("a != b").distinct(),
            "edges",
        )
    found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
