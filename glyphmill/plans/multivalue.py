"""Queries over fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.multivalue import separator_scores, split_values
from glyphmill.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_name, pos, value)`` for every cell of sign text that holds two or more values."""
    gt = table(spark, sf_dir, "ocr_gangnam_gt")
    out = split_values(gt, ["image_name"], "gt_text", F.substring_index("image_name", "__", 1))
    return out.where("n_values > 1").select("image_name", "pos", "value")


def p4_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, mark, pieces, consistency, regularity, recurrence, score, accepted)`` of every candidate separator."""
    gt = table(spark, sf_dir, "ocr_gangnam_gt")
    return separator_scores(gt, "gt_text", F.substring_index("image_name", "__", 1)).select("source", "mark", "pieces", *[F.round(c, 6).alias(c) for c in ("consistency", "regularity", "recurrence", "score")], "accepted")


QUERIES = {"p4_found": p4_found, "p4_separators": p4_separators}
ORACLES: dict[str, str] = {}
