"""Groups that share content, folds that keep groups whole, and leakage audits."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.components import components
from glyphmill.operators.lineage import cut
from glyphmill.operators.ranking import rank_in_groups


def shared_groups(items: DataFrame, node: str, region: str, key: str) -> DataFrame:
    """``(region, node, group_id)``: nodes of a region that share a key, directly or through others.

    Each key links its nodes to the smallest of them, a star instead of all pairs. Nodes without a usable key stay
    alone; a key in two regions connects nothing across them.
    """
    i = items.select(region, node, key).where(F.col(node).isNotNull()).distinct()
    held = i.where(F.col(key).isNotNull())
    rep = held.groupBy(region, key).agg(F.min(node).alias("_m"))
    sep = "\u0001"
    edges = held.join(rep, [region, key]).where(F.col(node) != F.col("_m")).select(F.concat_ws(sep, region, node).alias("a"), F.concat_ws(sep, region, "_m").alias("b"))
    c = components(edges).select(F.col("node").alias("_n"), F.split_part("component", F.lit(sep), F.lit(2)).alias("_c"))
    n = items.select(region, node).where(F.col(node).isNotNull()).distinct().withColumn("_id", F.concat_ws(sep, region, node))
    return n.join(c, F.col("_id") == F.col("_n"), "left").select(region, node, F.coalesce("_c", node).alias("group_id"))


def level(sizes: dict[int, int], k: int) -> list[tuple[int, int, int, int]]:
    """``(size, first_rank, n, fold)`` that give the largest groups first to the least loaded fold, runs of equal size at once."""
    loads = [(0, f) for f in range(k)]
    heapq.heapify(loads)
    out = []
    for size in sorted(sizes, reverse=True):
        rank, left = 1, sizes[size]
        while left:
            load, fold = heapq.heappop(loads)
            n = min(left, max(1, (loads[0][0] - load) // size)) if loads else left
            if loads and loads[0][0] - load < size and left >= 2 * k:  # level: deal the rest of the class evenly
                each = left // k
                loads.append((load, fold))
                loads = [(x + each * size, f) for x, f in loads]
                heapq.heapify(loads)
                for f in range(k):
                    out.append((size, rank, each, f))
                    rank, left = rank + each, left - each
                continue
            out.append((size, rank, n, fold))
            rank, left = rank + n, left - n
            heapq.heappush(loads, (load + n * size, fold))
    return out


def assign_folds(groups: DataFrame, region: str, k: int) -> DataFrame:
    """``(region, node.., group_id, fold)``: whole groups to ``k`` folds per region, big ones first to the least loaded."""
    groups = cut(groups)
    n = cut(groups.groupBy(region, "group_id").agg(F.count(F.lit(1)).alias("size")))
    rows = []
    hist: dict[str, dict[int, int]] = {}
    for r in n.groupBy(region, "size").agg(F.count(F.lit(1)).alias("n")).collect():
        hist.setdefault(r[region], {})[r["size"]] = r["n"]
    for reg, h in hist.items():
        rows += [(reg, *x) for x in level(h, k)]
    plan = groups.sparkSession.createDataFrame(rows, f"{region} string, size long, first long, n long, fold int")
    ranked = rank_in_groups(n, [region, "size"], [F.xxhash64("group_id"), F.col("group_id")], "r")
    placed = ranked.join(plan, [region, "size"]).where((F.col("r") >= F.col("first")) & (F.col("r") < F.col("first") + F.col("n"))).select(region, "group_id", "fold")
    return groups.join(placed, [region, "group_id"])


def leaks(df: DataFrame, content: str, split: str) -> DataFrame:
    """``(content, splits)``: content that stands in more than one split."""
    return df.where(F.col(content).isNotNull()).groupBy(content).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
