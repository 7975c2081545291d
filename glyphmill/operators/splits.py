"""Seeded splits and folds by source, and equal samples per group; ranks come from a hash, so no shuffle is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ranking import rank_in_groups


def seeded(c: Column, seed: int) -> Column:
    """A 60-bit number per value and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 15), 16, 10).cast("bigint")


def ranked(df: DataFrame, groups: list[str], key: str, seed: int) -> DataFrame:
    """``df`` (one row per key) with ``r``, the seeded rank from 1 in its group."""
    one = df.withColumn("_all", F.lit(1))
    return rank_in_groups(one, [*groups, "_all"], [seeded(F.col(key), seed), F.col(key)], "r", bits=12).drop("_all")


def source_split(sources: DataFrame, key: str, val: float, test: float, seed: int) -> DataFrame:
    """``(key, split)``: each source in test, val or train; shares of the sources rounded half to even, at least one each."""
    s = sources.select(key).where(F.col(key).isNotNull()).distinct()
    n = s.agg(F.count(F.lit(1)).alias("_n"))
    at = ranked(s, [], key, seed).crossJoin(F.broadcast(n))
    k = lambda share: F.greatest(F.lit(1), F.bround(F.col("_n") * share)).cast("long")
    return at.select(key, F.when(F.col("r") <= k(test), "test").when(F.col("r") <= k(test) + k(val), "val").otherwise("train").alias("split"))


def k_folds(sources: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``(key, fold)``: sources dealt round to ``k`` folds in seeded order."""
    s = sources.select(key).where(F.col(key).isNotNull()).distinct()
    return ranked(s, [], key, seed).select(key, F.pmod(F.col("r") - 1, F.lit(k)).cast("int").alias("fold"))


def halves(sources: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """``(group, key, half)``: the sources of each group in seeded order, the first half ``val``, the rest ``test``."""
    s = sources.select(group, key).where(F.col(key).isNotNull()).distinct()
    n = s.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked(s, [group], key, seed)
    return r.join(n, r[group].eqNullSafe(n["_g"])).select(group, key, F.when(F.col("r") * 2 <= F.col("_n"), "val").otherwise("test").alias("half"))


def sample_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows per group, those with the lowest seeded ranks; one row per key."""
    return ranked(rows, [group], key, seed).where(F.col("r") <= n).drop("r")


def torn(df: DataFrame, key: str, part: str) -> DataFrame:
    """``(key, parts)``: keys that stand in more than one part; a split that keeps sources whole leaves none."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(part).alias("parts")).where("parts > 1")
