"""Queries of the training-data operators and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import canonical_values, cross_split, grouped_splits, lookalikes, mixing, name_variants, packing, template_residue
from glyphmill.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.torn_photos(table(spark, sf_dir, "crop_manifest"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = grouped_splits.assign_splits(table(spark, sf_dir, "crop_manifest"), table(spark, sf_dir, "split_targets"))
    return a.select("annotation_id", "group_id", "split", "new_split")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "split_targets")
    return grouped_splits.split_shares(grouped_splits.assign_splits(table(spark, sf_dir, "crop_manifest"), targets), targets)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tagging_gt_v1").where("eval_name = '1'")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.same_business_pairs(_named(spark, sf_dir))


def p2_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.businesses(_named(spark, sf_dir))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = table(spark, sf_dir, "ocr_gangnam_gt").select(F.lit("ocr_gangnam_gt").alias("table_name"), "image_name", F.col("gt_text").alias("text"))
    tags = table(spark, sf_dir, "tagging_gt_v1").select(F.lit("tagging_gt_v1").alias("table_name"), "image_name", F.col("name").alias("text"))
    rows = gt.unionByName(tags)
    return rows.withColumn("form", lookalikes.consistent(F.col("text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).where("form <> text").select("table_name", "image_name").distinct()


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).select("table_name", "image_name", "text", "form")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cross_split.overlaps(table(spark, sf_dir, "crop_manifest"))
    return o.select(F.least("train_record", "eval_record").alias("annotation_id_a"), F.greatest("train_record", "eval_record").alias("annotation_id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, sf_dir, "crop_manifest"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values.mapped_records(table(spark, sf_dir, "tagging_gt_v1"), table(spark, sf_dir, "tag_vocabulary"))


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values.unmatched_values(table(spark, sf_dir, "tagging_gt_v1"), table(spark, sf_dir, "tag_vocabulary"))


def p7_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = table(spark, sf_dir, "containers")
    return packing.fill_report(packing.pack(table(spark, sf_dir, "documents"), containers), containers)


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a mix as large as the corpus: the targets do not fit the repetition limits, so they are tempered."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total="corpus")[1]


def p8_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a mix as large as the corpus whose shares are the sources' own, flattened to an entropy of 2.2 nats."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total="corpus", target_entropy=2.2)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.residue(table(spark, sf_dir, "documents")).where("found").select("doc_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue; null and empty texts stay."""
    docs = table(spark, sf_dir, "documents")
    bad = template_residue.residue(docs).where("found").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select("doc_id", "source", "n_chars")


QUERIES = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_shares": p1_shares,
    "p2_found": p2_found,
    "p2_businesses": p2_businesses,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_unmatched": p6_unmatched,
    "p7_contents": p7_contents,
    "p7_fill": p7_fill,
    "p8_drawn": p8_drawn,
    "p8_shares": p8_shares,
    "p8_tempered": p8_tempered,
    "p8_entropy": p8_entropy,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
}
