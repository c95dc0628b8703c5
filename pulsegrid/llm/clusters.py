"""Connected components of a link table, by alternating large and small stars.

Links within a task are first reduced to a spanning forest. Then each round joins every node to the smallest neighbour
it knows, until all links form stars. The neighbours of a node are dealt out to parts, whose minima are united, so no task
holds all neighbours of a node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy, with_totals


class Forest:
    """Union-find over ids; the smallest id of a tree is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> pd.DataFrame:
        """(node, root) of every node that isn't a root."""
        found = [(x, self.root(x)) for x in list(self.up)]
        return pd.DataFrame(np.array([p for p in found if p[0] != p[1]], np.int64).reshape(-1, 2), columns=["a", "b"])


def forest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the links (a, b) of one task."""
    own = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            own.join(a, b)
    yield own.edges()


def _with_least(e: DataFrame) -> DataFrame:
    return with_totals(e, ["u"], "v", {"m": (F.min("v"), F.min)})


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a")).toDF("u", "v")
    return _with_least(both).where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    moved = _with_least(down).select("u", "v", "m")
    return moved.select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, or is such a smaller one: then each star is a component."""
    ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node of the links (a, b): longs, either order, repeats and loops allowed.

    component_id is the smallest id that can be reached. Nodes that are their own component's smallest are left out,
    and so are nodes without links. No links: an empty table.
    """
    tidy(links.sparkSession)
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = table(links.mapInPandas(forest, "a long, b long"))
    while not _stars(e):
        e = table(_small(_large(e)))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
