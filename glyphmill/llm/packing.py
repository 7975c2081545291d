"""Problem 7: fill containers of fixed capacity with documents, best fit in bulk."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ranking import rank_in_groups
from glyphmill.llm.tokens import token_counts
from glyphmill.operators.lineage import cut

#: Ranks of one size are joined with their moves in blocks of 2 to this power.
RANK_BLOCK = 10


def best_fit(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(moves, containers)`` for a histogram of item sizes, all at most ``capacity``.

    Items and gaps are sorted by size; equal sizes form classes. A round takes the largest class left, finds its
    successor among the gap classes (the smallest gap that is large enough), gives the items with the lowest ranks to
    the containers with that gap, first come by number, updates the gaps and repeats until the class is placed; only
    when no gap is large enough are containers opened. A move ``(size, first_rank, first_container, n)`` puts the items
    with the ranks ``first_rank .. first_rank + n - 1`` into as many consecutive containers. There are at most
    ``capacity`` classes of items and of gaps, whatever the number of items.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    moves: list[tuple[int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        runs = gaps[gap]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + n)
        else:
            runs.append((first, n))

    for size in sorted((s for s in sizes if s > 0), reverse=True):
        rank, left = 1, sizes[size]
        while left:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                n = -(-left // (capacity // size))
                put(capacity, opened, n)
                opened += n
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            take = min(n, left)
            if n > take:
                put(gap, first + take, n - take)
            moves.append((size, rank, first, take))
            put(gap - size, first, take)
            rank, left = rank + take, left - take
    return moves, opened


def pack(documents: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(container, bin, key, piece, first_token, tokens)``: for every row of ``containers`` all documents, packed.

    A document longer than the capacity is cut into pieces of the full capacity and a rest, numbered from 0; no other
    is cut. Documents without tokens (null or empty text) lie in some container with 0 tokens. Each document counts
    once however often its row is repeated with the same size; a null key is left out, as is a container with a null
    capacity or one under 1. The size histogram of a container, at most ``capacity`` entries, is all that reaches the
    driver; documents get their container by their rank among those of the same size, ranked in two levels.
    """
    spark = documents.sparkSession
    sized = cut(token_counts(documents.where(F.col(key).isNotNull()), [key], text, path).groupBy(key).agg(F.max("tokens").alias("tokens")))
    found = None
    wanted = containers.select("container", F.col("capacity_tokens").cast("int").alias("cap")).where("cap >= 1").distinct().orderBy("container")
    for row in wanted.collect():
        cap = row["cap"]
        cuts = F.when(F.col("tokens") > cap, F.transform(F.sequence(F.lit(0), ((F.col("tokens") - 1) / cap).cast("int")), lambda i: i)).otherwise(F.array(F.lit(0)))
        items = sized.select(key, "tokens", F.explode(cuts).alias("piece"))
        items = items.select(key, "piece", (F.col("piece").cast("long") * cap).alias("first_token"), F.least(F.col("tokens") - F.col("piece").cast("long") * cap, F.lit(cap)).alias("tokens"))
        hist = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
        moves, opened = best_fit(hist, cap)
        plan = spark.createDataFrame(moves, "size long, first_rank long, first_bin long, n long") if moves else spark.createDataFrame([], "size long, first_rank long, first_bin long, n long")
        ranked = rank_in_groups(items.where("tokens > 0"), ["tokens"], [F.xxhash64(key, "piece"), F.col(key), F.col("piece")], "_rank")
        # a move holds a span of the ranks of its size; spans and documents meet in blocks of ranks, so a size that many
        # documents share is spread over its blocks and each document sees only the moves of its own
        block = lambda c: F.shiftright(c, RANK_BLOCK)
        spans = plan.withColumn("_block", F.explode(F.sequence(block(F.col("first_rank")), block(F.col("first_rank") + F.col("n") - 1))))
        own = ranked.withColumn("_block", block(F.col("_rank"))).join(spans.withColumnRenamed("size", "tokens"), ["tokens", "_block"])
        own = own.where((F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("n")))
        own = own.select(key, "piece", "first_token", "tokens", (F.col("first_bin") + F.col("_rank") - F.col("first_rank")).alias("bin"))
        none = items.where("tokens = 0").withColumn("bin", F.pmod(F.xxhash64(key), F.lit(max(opened, 1))))
        both = own.unionByName(none).select(F.lit(row["container"]).alias("container"), (F.col("bin") + 1).alias("bin"), key, "piece", "first_token", "tokens")
        found = both if found is None else found.unionByName(both)
    if found is None:
        found = spark.createDataFrame([], f"container string, bin long, {key} {dict(documents.dtypes)[key]}, piece int, first_token long, tokens long")
    return found


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container, capacity_tokens, bins, least_bins, tokens, unused_share)``; ``least_bins``: what no packing can beat."""
    bins = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("t"))
    n = bins.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"))
    c = containers.select("container", "capacity_tokens").distinct()
    return c.join(n, "container").select("container", "capacity_tokens", "bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), "tokens", (1 - F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("unused_share"))
