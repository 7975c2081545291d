"""Connected components by parallel hooking and shortcutting over parent tables.

``components(edges)`` takes pairs of node ids and returns one row per node with the smallest node id of its component.
Every round hooks each root to its smallest neighbour, shortcuts the parent table by pointer jumping until it is flat,
relabels the edges with their roots and drops the loops and doubles that arise, so the edge table shrinks
geometrically. Once no more edges between different nodes are left than one task may hold, one task ends the work by
union and find. All other steps are joins and map-side-combined aggregates on tables; nothing but row counts reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from glyphmill.operators.lineage import cut

#: Edges that one task may hold; with other ends each they are twice as many nodes, some 500 MB.
FEW_EDGES = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(x, p)`` of edges ``(u, v)``: each node that is not the smallest of its component, with the one that is."""
    at: dict = {}
    names: list = []
    up: list[int] = []
    kind = None

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def number(name) -> int:
        i = at.setdefault(name, len(up))
        if i == len(up):
            names.append(name)
            up.append(i)
        return i

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            i, j = root(number(u)), root(number(v))
            if i != j:
                low, high = (i, j) if names[i] < names[j] else (j, i)
                up[high] = low
    n = 10_000
    for k in range(0, len(up), n):
        some = [(i, r) for i in range(k, min(k + n, len(up))) if (r := root(i)) != i]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in some], kind), pa.array([names[r] for _, r in some], kind)], ["x", "p"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """``(node, component)`` for every node that occurs in ``edges``.

    Nulls: an edge with a null end is ignored (a node known only from it does not appear). Loops keep their node.
    Repeated edges and either direction count once. An empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct()
    e = cut(e)
    label = cut(e.select("u").union(e.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component")))
    e = e.where("u <> v")
    for _ in range(max_rounds):
        if e.count() <= few:
            kind = e.schema["u"].dataType
            up = e.coalesce(1).mapInArrow(_united, StructType([StructField("x", kind), StructField("p", kind)]))
            return cut(label.join(up, label.component == up.x, "left").select("node", F.coalesce("p", "component").alias("component")))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("p"))
        parent = cut(parent)
        while True:  # shortcut: p <- p(p) until the forest is flat
            up = parent.select(F.col("x").alias("y"), F.col("p").alias("pp"))
            jumped = parent.join(up, parent.p == up.y, "left").select("x", "p", F.coalesce("pp", "p").alias("q"))
            jumped = cut(jumped)
            changed = not jumped.where("q <> p").isEmpty()
            parent = jumped.select("x", F.col("q").alias("p"))
            if not changed:
                break
        up = parent.select(F.col("x").alias("y"), F.col("p").alias("pp"))
        label = cut(label.join(up, label.component == up.y, "left").select("node", F.coalesce("pp", "component").alias("component")))
        e = e.join(up, e.u == up.y, "left").select(F.coalesce("pp", "u").alias("u"), "v")
        e = e.join(up, e.v == up.y, "left").select("u", F.coalesce("pp", "v").alias("v"))
        e = cut(e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    raise RuntimeError("components did not converge")
