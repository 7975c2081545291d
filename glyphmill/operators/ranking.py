"""Exact ranks inside large groups without one task per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_groups(df: DataFrame, groups: list[str], order: list[Column], out: str, bits: int = 8) -> DataFrame:
    """``df`` with the 1-based rank of each row in its group, by ``order``, whose first column must be a 64-bit hash.

    The hash range is cut into ``2**bits`` equal spans; rows are ranked inside ``(group, span)`` and the counts of the
    lower spans are added. A group that holds all rows is thereby ranked by ``2**bits`` tasks. The count table has at
    most ``groups x 2**bits`` rows and is joined, not collected.
    """
    keyed = df.withColumn("_h", order[0]).withColumn("_b", F.shiftright("_h", 64 - bits))
    rest = [F.col("_h"), *order[1:]]
    keyed = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*rest)))
    n = keyed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    names = {g: f"_g{i}" for i, g in enumerate(groups)}
    n = n.select(*[F.col(g).alias(x) for g, x in names.items()], F.col("_b").alias("_b2"), "_before")
    on = reduce(lambda p, q: p & q, [keyed[g].eqNullSafe(n[x]) for g, x in names.items()], keyed["_b"] == n["_b2"])
    return keyed.join(n, on).withColumn(out, F.col("_r") + F.col("_before")).drop("_h", "_b", "_b2", "_r", "_before", *names.values())


def rank_by_span(df: DataFrame, groups: list[str], span: Column, order: list[Column], out: str) -> DataFrame:
    """``df`` with the 1-based rank of each row in its group by ``span`` and then ``order``.

    ``span`` is a whole number that never falls along the order wanted, such as a score in steps; rows are ranked inside
    ``(group, span)`` and the counts of the lower spans are added, so a group with very many rows is many tasks.
    """
    keyed = df.withColumn("_b", span).withColumn("_r", F.row_number().over(Window.partitionBy(*groups, span).orderBy(*order)))
    n = keyed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = {g: f"_g{i}" for i, g in enumerate(groups)}
    n = n.withColumn("_before", before).select(*[F.col(g).alias(x) for g, x in names.items()], F.col("_b").alias("_b2"), "_before")
    on = reduce(lambda p, q: p & q, [keyed[g].eqNullSafe(n[x]) for g, x in names.items()], keyed["_b"] == n["_b2"])
    return keyed.join(n, on).withColumn(out, (F.col("_r") + F.col("_before")).cast("int")).drop("_b", "_b2", "_r", "_before", *names.values())
