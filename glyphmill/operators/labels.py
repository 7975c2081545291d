"""Append-only label logs: latest state, counts, decisions, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(marks: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row per key by ``ordinal``, whatever the order of arrival; null keys are left out."""
    rest = [c for c in marks.columns if c != key]
    m = marks.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_m"))
    return m.select(key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def apply_decisions(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``rows`` with tag and evaluation flag replaced by ``decisions (key, new_tag, new_eval)``; null: unchanged."""
    j = rows.join(decisions, key, "left")
    out = j.withColumns({"_tag": F.coalesce("new_tag", "tag"), "_eval": F.coalesce("new_eval", "eval_tag")})
    changed = ~F.col("_tag").eqNullSafe(F.col("tag")) | ~F.col("_eval").eqNullSafe(F.col("eval_tag"))
    return out.withColumn("changed", changed).drop("tag", "eval_tag", "new_tag", "new_eval").withColumnsRenamed({"_tag": "tag", "_eval": "eval_tag"})


def undecided(suspects: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Suspects without a decision; while there are any, decisions are not to be applied."""
    return suspects.join(decisions, key, "left_anti")


def apply_checked(rows: DataFrame, suspects: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``apply_decisions``, refused with an error while a suspect has no decision."""
    if not undecided(suspects, decisions, key).isEmpty():
        raise ValueError("a suspect has no decision yet")
    return apply_decisions(rows, decisions, key)


def scored(df: DataFrame, rules: list[tuple[str, int, Column]]) -> DataFrame:
    """``df`` with ``suspicion`` and the ``reasons`` of the rules ``(name, points, condition)`` that hold."""
    points = [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for _, n, c in rules]
    why = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, _, c in rules]))
    return df.withColumn("suspicion", sum(points[1:], points[0])).withColumn("reasons", why)


def admitted(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``reason``: the first rule whose condition holds or is unknown, ``ok`` if none."""
    out = F.lit("ok")
    for name, bad in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(True)), name).otherwise(out)
    return df.withColumn("reason", out)
