"""Queries over review logs, splits and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import labels, splits
from glyphmill.plans.records import LOG_LATEST, log_latest
from glyphmill.sources.tables import table

#: SQL twin of ``functions.text.split_name``.
SPLIT_SQL = """case when regexp_replace(lower({0}), '[^a-z]', '', 'g') in ('train', 'training', 'trn', 'tr') then 'train' when regexp_replace(lower({0}), '[^a-z]', '', 'g') in ('val', 'valid', 'validation', 'dev', 'vld') then 'val'
  when regexp_replace(lower({0}), '[^a-z]', '', 'g') in ('test', 'testing', 'tst') then 'test' end""".format("split")


def log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log leaves of the truth: rows whose last mark is no "non", with flags for a name and a tag, counted."""
    gone = log_latest(spark, sf_dir).where("verdict = 'non'").select("image_name")
    kept = table(spark, sf_dir, "tagging_gt_v1").distinct().join(gone, "image_name", "left_anti")
    flag = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")).isin("", "unknown"), "0").otherwise("1")
    return kept.groupBy("region", flag("name").alias("has_name"), flag("tag").alias("has_tag")).agg(F.count(F.lit(1)).alias("records"))


LOG_EXPORT = f"""with l as ({LOG_LATEST}), k as (select distinct * from tagging_gt_v1 where image_name is null or image_name not in (select image_name from l where verdict = 'non'))
select region, case when coalesce(trim(name), '') in ('', 'unknown') then '0' else '1' end as has_name, case when coalesce(trim(tag), '') in ('', 'unknown') then '0' else '1' end as has_tag, count(*) as records from k group by 1, 2, 3"""


def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose last mark gives another tag, the surest first: same key of the tag, another key, no tag."""
    truth = table(spark, sf_dir, "tagging_gt_v1").where("eval_tag = '1'").select("image_name", F.col("tag").alias("old")).distinct()
    m = log_latest(spark, sf_dir).select("image_name", F.col("tag").alias("suggest"))
    j = truth.join(m, "image_name").where(~F.col("old").eqNullSafe(F.col("suggest")))
    grade = F.when(F.coalesce(F.trim("suggest"), F.lit("")) == "", 2).when(t.tag_key(F.col("old")) == t.tag_key(F.col("suggest")), 0).otherwise(1)
    return j.select("image_name", "old", "suggest", grade.alias("grade"))


SUSPECTS = f"""with l as ({LOG_LATEST}), t as (select distinct image_name, tag as old from tagging_gt_v1 where eval_tag = '1')
select image_name, old, l.tag as suggest, cast(case when coalesce(trim(l.tag), '') = '' then 2 when split_part(old, '=', 1) = split_part(l.tag, '=', 1) then 0 else 1 end as integer) as grade from t join l using (image_name) where old is distinct from l.tag"""


def draft_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grade from 0 to 4 per sign text: it has a name, more than one line, no don't-care line, a tagged record."""
    gt = table(spark, sf_dir, "ocr_gangnam_gt").where("image_name is not null").groupBy("image_name").agg(F.max("gt_text").alias("text"))
    tags = table(spark, sf_dir, "tagging_gt_v1").where("trim(tag) <> '' and tag <> 'unknown'").select("image_name", F.lit(1).alias("tagged")).distinct()
    lines, plain = t.split_lines(F.coalesce("text", F.lit(""))), t.readable_lines(F.coalesce("text", F.lit("")))
    points = [F.size(plain) > 0, F.size(plain) > 1, (F.size(lines) > 0) & (F.size(lines) == F.size(plain)), F.col("tagged") == 1]
    grade = sum((F.when(p, 1).otherwise(0) for p in points[1:]), F.when(points[0], 1).otherwise(0))
    return gt.join(tags, "image_name", "left").groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("texts"))


DRAFT = r"""
with c as (select image_name, max(gt_text) as gt_text from ocr_gangnam_gt where image_name is not null group by 1),
u as (select image_name, trim(replace(replace(replace(coalesce(gt_text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n', chr(10))) as x from c),
l as (select image_name, list_filter(list_transform(case when contains(x, '|') then string_split(x, '|') else string_split(x, chr(10)) end, lambda s: trim(regexp_replace(s, '^\s+|\s+$', '', 'g'))), lambda s: s <> '') as ls from u),
n as (select image_name, len(ls) as a, len(list_filter(ls, lambda s: s <> '###')) as b from l)
select cast((b > 0)::int + (b > 1)::int + (a > 0 and a = b)::int + (image_name in (select image_name from tagging_gt_v1 where trim(tag) <> '' and tag <> 'unknown' and image_name is not null))::int as integer) as grade, count(*) as texts from n group by 1
"""


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "crop_manifest").select("annotation_id", "source_image", "source_image_id", "text", "split").distinct()
    return c.withColumn("split", t.split_name(F.col("split")))


def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded split of the source photos, its sizes, and photos it would tear apart (none)."""
    s = splits.source_split(_crops(spark, sf_dir), "source_image", 0.1, 0.1, 7)
    c = _crops(spark, sf_dir).drop("split").join(s, "source_image")
    torn = splits.torn(c, "source_image", "split").agg(F.count(F.lit(1)).alias("torn"))
    return c.groupBy("split").agg(F.count_distinct("source_image").alias("photos"), F.count(F.lit(1)).alias("crops")).crossJoin(F.broadcast(torn))


RANKED = "row_number() over (partition by {0} order by ('0x' || substr(md5('{2}:' || {1}), 1, 15))::bigint, {1})"
SOURCE_SPLIT = f"""with p as (select distinct source_image from crop_manifest where source_image is not null), r as (select *, {RANKED.format("1", "source_image", 7)} as r, count(*) over () as n from p),
s as (select source_image, case when r <= greatest(1, round_even(n * 0.1, 0)) then 'test' when r <= greatest(1, round_even(n * 0.1, 0)) * 2 then 'val' else 'train' end as split from r),
c as (select distinct annotation_id, source_image, source_image_id, text, {SPLIT_SQL} as old from crop_manifest)
select split, count(distinct source_image) as photos, count(*) as crops, cast(0 as bigint) as torn from c join s using (source_image) group by 1"""


def k_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of the source photos dealt round in seeded order."""
    return splits.k_folds(_crops(spark, sf_dir), "source_image", 5, 7).select("source_image", "fold")


K_FOLDS = f"select source_image, cast(({RANKED.format('1', 'source_image', 7)} - 1) % 5 as integer) as fold from (select distinct source_image from crop_manifest where source_image is not null)"


def region_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged photos of each region in two halves."""
    p = table(spark, sf_dir, "tagging_gt_v1").select("region", F.regexp_replace("image_name", "__crop_[0-9]+$", "").alias("photo")).distinct()
    return splits.halves(p, "region", "photo", 3).groupBy("region", "half").agg(F.count(F.lit(1)).alias("photos"), F.min("photo").alias("first"))


HALVES = f"""with p as (select distinct region, regexp_replace(image_name, '__crop_[0-9]+$', '') as photo from tagging_gt_v1 where image_name is not null), r as (select *, {RANKED.format("region", "photo", 3)} as r, count(*) over (partition by region) as n from p)
select region, case when r * 2 <= n then 'val' else 'test' end as half, count(*) as photos, min(photo) as first from r group by 1, 2"""


def region_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty tagged records per region, the same for a seed however the rows are stored."""
    d = table(spark, sf_dir, "tagging_gt_v1").select("region", "image_name").where("image_name is not null").distinct()
    return splits.sample_per_group(d, "region", "image_name", 20, 5).select("region", "image_name")


SAMPLE = f"select region, image_name from (select *, {RANKED.format('region', 'image_name', 5)} as r from (select distinct region, image_name from tagging_gt_v1 where image_name is not null)) where r <= 20"


def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in more than one split: photo ids, photo files, records and texts, and whether that is allowed."""
    c = _crops(spark, sf_dir).where("split is not null")
    out = None
    for what, key in (("photo id", "source_image_id"), ("photo file", "source_image"), ("record", "annotation_id"), ("text", "text")):
        n = splits.torn(c, key, "split").agg(F.count(F.lit(1)).alias("torn"), F.max("parts").alias("most")).select(F.lit(what).alias("what"), "torn", F.coalesce("most", F.lit(1)).alias("most"))
        out = n if out is None else out.unionByName(n)
    return out.withColumn("passed", F.col("torn") == 0)


LEAKS = f"with c as (select distinct annotation_id, source_image, source_image_id, text, {SPLIT_SQL} as s from crop_manifest), v as (select * from c where s is not null)\n" + " union all ".join(f"select '{w}' as what, count(*) as torn, coalesce(max(parts), 1) as most, count(*) = 0 as passed from (select count(distinct s) as parts from v where {k} is not null group by {k} having count(distinct s) > 1)" for w, k in (("photo id", "source_image_id"), ("photo file", "source_image"), ("record", "annotation_id"), ("text", "text")))


def inherited_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a split take that of their photo if it is one; else it stays open."""
    c = _crops(spark, sf_dir)
    one = c.where("source_image is not null and split is not null").groupBy("source_image").agg(F.min("split").alias("s"), F.count_distinct("split").alias("n"))
    j = c.where("split is null").join(one, "source_image", "left")
    return j.groupBy(F.when(F.col("n") == 1, F.col("s")).when(F.col("n") > 1, "torn").otherwise("none").alias("split")).agg(F.count(F.lit(1)).alias("records"))


INHERITED = f"""with c as (select distinct annotation_id, source_image, source_image_id, text, {SPLIT_SQL} as s from crop_manifest), o as (select source_image, min(s) as s, count(distinct s) as n from c where source_image is not null and s is not null group by 1)
select case when n = 1 then o.s when n > 1 then 'torn' else 'none' end as split, count(*) as records from c left join o using (source_image) where c.s is null group by 1"""


def crop_photos_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged crops whose photo is in the match table, and those whose photo is not, per region."""
    photos = table(spark, sf_dir, "e2e_match_gangnam").select(F.col("photo"), F.lit(True).alias("in")).where("photo is not null").distinct()
    d = table(spark, sf_dir, "tagging_gt_v1").select("region", "image_name", F.regexp_replace("image_name", "__crop_[0-9]+$", "").alias("photo")).distinct()
    return d.join(photos, "photo", "left").groupBy("region", F.coalesce("in", F.lit(False)).alias("matched")).agg(F.count(F.lit(1)).alias("crops"))


KEPT = "select region, coalesce(regexp_replace(image_name, '__crop_[0-9]+$', '') in (select photo from e2e_match_gangnam where photo is not null), false) as matched, count(*) as crops from (select distinct region, image_name from tagging_gt_v1) group by 1, 2"


def sized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks with the size of the sign text of their crop, 0 where it is not known."""
    size = table(spark, sf_dir, "ocr_gangnam_gt").where("image_name is not null").groupBy("image_name").agg(F.max(F.length("gt_text")).alias("n"))
    m = table(spark, sf_dir, "tagging_marks").select("mark_id", "image_name")
    return m.join(size, "image_name", "left").select("mark_id", F.coalesce("n", F.lit(0)).alias("letters"))


SIZED = "select mark_id, coalesce(n, 0) as letters from tagging_marks left join (select image_name, cast(max(length(gt_text)) as integer) as n from ocr_gangnam_gt where image_name is not null group by 1) using (image_name)"

QUERIES = {f.__name__: f for f in (log_export, suspects, draft_confidence, source_split, k_folds, region_halves, region_sample, leak_audit, inherited_split, crop_photos_kept, sized_rows)}
ORACLES = {"log_export": LOG_EXPORT, "suspects": SUSPECTS, "draft_confidence": DRAFT, "source_split": SOURCE_SPLIT, "k_folds": K_FOLDS, "region_halves": HALVES, "region_sample": SAMPLE, "leak_audit": LEAKS, "inherited_split": INHERITED, "crop_photos_kept": KEPT, "sized_rows": SIZED}
