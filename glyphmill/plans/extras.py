"""Queries over pooled hints, coverage, legacy matching, dataset scans and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import matching, metrics, retrieval, scoring, splits
from glyphmill.operators.ranking import rank_by_span
from glyphmill.plans.boxes import _boxed, ap_sql
from glyphmill.plans.detection import GREEDY, GREEDY_MATCH
from glyphmill.plans.records import ASKED, _asked, _entries
from glyphmill.sources.tables import table


def pooled_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of a sign of several lines: three per line, the first of a key, the five most alike; a tag shows only if a line
    names the same business."""
    lines = _asked(spark, sf_dir).where("length(query) >= 2").withColumn("sign", F.length("query") % 7)
    r = retrieval.lexical_topk(_entries(spark, sf_dir), lines, k=3).join(lines, "query")
    same = t.contains_or_similar(F.col("key"), F.col("query"), 0.9)
    per = r.groupBy("sign", "key").agg(F.max("sim").alias("sim"), F.min_by(F.struct("entry_id", "name", "tag"), F.struct(-F.col("sim"), "entry_id")).alias("e"), F.max(same).alias("same"))
    rank = F.row_number().over(Window.partitionBy("sign").orderBy(F.col("sim").desc(), "e.entry_id"))
    top = per.withColumn("rank", rank).where("rank <= 5")
    line = F.concat(F.lit("- "), F.col("e.name"), F.when(F.col("same") & (F.coalesce("e.tag", F.lit("")) != ""), F.concat(F.lit(" ("), F.col("e.tag"), F.lit(")"))).otherwise(""))
    return top.groupBy("sign").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("hint"))


POOLED = ASKED + """, l as (select f.*, length(query) % 7 as sign, (length(key) >= 3 and contains(query, key)) or (length(query) >= 3 and contains(key, query)) or 1.0 - levenshtein(query, key)::double / greatest(length(query), length(key)) >= 0.9 as same from f where rank <= 3),
b as (select sign, key, max(sim) as sim, first(name order by sim desc, entry_id) as name, first(tag order by sim desc, entry_id) as tag, first(entry_id order by sim desc, entry_id) as entry_id, bool_or(same) as same from l group by 1, 2),
r2 as (select *, row_number() over (partition by sign order by sim desc, entry_id) as rn from b)
select cast(sign as integer) as sign, string_agg('- ' || name || case when same and coalesce(tag, '') <> '' then ' (' || tag || ')' else '' end, chr(10) order by rn) as hint from r2 where rn <= 5 group by 1"""


def coverage_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines asked for: those the dictionary holds to the letter, and those with any, or a close, hit in the first five."""
    q = _asked(spark, sf_dir).where("length(query) >= 2")
    r = retrieval.lexical_topk(_entries(spark, sf_dir), q, k=5).groupBy("query").agg(F.max("sim").alias("sim"))
    j = q.join(r, "query", "left")
    return j.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("sim") == 1).alias("exact"), F.count_if(F.col("sim") >= 0.9).alias("close"), F.count("sim").alias("any_hit"), F.round(metrics.ratio(F.count("sim"), F.count(F.lit(1))), 6).alias("share"))


COVER5 = ASKED + ", r2 as (select qk.query, max(f.sim) as sim from qk left join (select * from f where rank <= 5) f using (query) group by 1) select count(*) as lines, count(*) filter (sim = 1) as exact, count(*) filter (sim >= 0.9) as close, count(sim) as any_hit, round(count(sim) / count(*), 6) as share from r2"


def legacy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching in the order of the file, here of the record ids, not of the confidence."""
    c = _boxed(spark, sf_dir)
    pred = c.where("class = 'word'").select("source_image_id", F.col("annotation_id").alias("a"), "box", (-F.col("annotation_id").cast("bigint")).cast("double").alias("conf"))
    truth = c.where("class = 'line'").select("source_image_id", F.col("annotation_id").alias("b"), "box")
    return matching.match_boxes(pred, truth, "source_image_id", 0.1).groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("iou"), 4).alias("iou"))


BY_ID = GREEDY_MATCH.replace("cast(a.w as bigint) * a.h as conf", "-cast(a.annotation_id as bigint) as conf").replace("cast(w as bigint) * h as conf", "-cast(annotation_id as bigint) as conf").replace("round(iou, 6) as iou", "iou").replace("round(iou, 6)", "iou")
LEGACY = "select status, count(*) as rows, round(sum(iou), 4) as iou from (" + BY_ID + ") group by 1"

MATCH_AP = GREEDY.replace("with c", "with recursive c").rstrip() + """,
m as (select a, conf / 1e8 as conf, 'TP' as status from tp union all select a, conf / 1e8, 'FP' from fp union all select b, null, 'FN' from q where not exists (select 1 from tp where tp.g = q.g and tp.b = q.b)),
hh as (select 'all' as grp, conf, status = 'TP' as hit, a as det_crop from m where status <> 'FN'), nn as (select 'all' as grp, count(*) as total from m where status <> 'FP'),
""" + ap_sql("hh", "grp").replace("c as (select", "c9 as (select", 1).replace(" from c)", " from c9)", 1).replace("e join n using", "e join nn using").replace("from n where", "from nn where").replace("from n left join", "from nn left join").replace("select n.grp", "select nn.grp").replace("\nt as (", "\nt9 as (").replace("left join t using", "left join t9 using") + """
select round(ap_all, 6) as ap_all, round(ap_101, 6) as ap_101, total, (select count(*) from m where status = 'TP') as tp, (select count(*) from m where status = 'FP') as fp, (select count(*) from m where status = 'FN') as fn from ap"""


def dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops per split that training would spoil: too many letters, words the corpus has once, squashed, tiny."""
    c = table(spark, sf_dir, "crop_manifest").withColumn("split", t.split_name(F.col("split"))).where("text is not null and split is not null").select("annotation_id", "text", "split", "w", "h").distinct()
    words = c.select("annotation_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    rare = words.join(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), "word", "left_semi").select("annotation_id", F.lit(1).alias("rare")).distinct()
    j = c.join(rare, "annotation_id", "left")
    return j.groupBy("split").agg(
        F.count(F.lit(1)).alias("crops"), F.count_if(F.length("text") > 25).alias("long"), F.count("rare").alias("rare_word"),
        F.count_if(F.length("text") * F.col("h") * 0.5 > 1.5 * F.col("w")).alias("squashed"), F.count_if(F.least("w", "h") < 12).alias("tiny"),
    )


SCAN = """with c as (select distinct annotation_id, text, w, h, case when regexp_replace(lower(split), '[^a-z]', '', 'g') in ('train', 'training', 'trn', 'tr') then 'train' when regexp_replace(lower(split), '[^a-z]', '', 'g') in ('val', 'valid', 'validation', 'dev', 'vld') then 'val'
  when regexp_replace(lower(split), '[^a-z]', '', 'g') in ('test', 'testing', 'tst') then 'test' end as split from crop_manifest where text is not null), v as (select * from c where split is not null),
d as (select annotation_id, unnest(list_distinct(string_split(text, ' '))) as word from v), r as (select distinct annotation_id from d where word in (select word from d group by 1 having count(*) = 1))
select split, count(*) as crops, count(*) filter (length(text) > 25) as long, count(*) filter (annotation_id in (select annotation_id from r)) as rare_word, count(*) filter (length(text) * h * 0.5 > 1.5 * w) as squashed, count(*) filter (least(w, h) < 12) as tiny from v group by 1"""


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest value of the column whose name holds "tax", per return flag."""
    return metrics.best_value(table(spark, sf_dir, "lineitem"), "tax", ["l_returnflag"])


BEST = "select l_returnflag, 'l_tax' as metric, max(l_tax) as best from lineitem group by 1"


def photo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerators and denominators per photo of recall, precision, F1, mean overlap, sure hits and misses, one row each."""
    m = table(spark, sf_dir, "e2e_match_gangnam").distinct()
    n = lambda c: F.count_if(F.expr(c)).cast("double")
    p = m.groupBy("photo").agg(n("status = 'TP'").alias("tp"), n("status = 'FP'").alias("fp"), n("status = 'FN'").alias("fn"), F.coalesce(F.sum(F.when(F.col("status") == "TP", F.col("iou"))), F.lit(0.0)).alias("iou"), n("status = 'TP' and conf >= 0.5").alias("sure"))
    pair = lambda name, a, b: F.struct(F.lit(name).alias("metric"), F.round(a, 6).alias("num"), F.round(b, 6).alias("den"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = F.array(pair("recall", tp, tp + fn), pair("precision", tp, tp + fp), pair("f1", 2 * tp, 2 * tp + fp + fn), pair("overlap", F.col("iou"), tp), pair("sure", F.col("sure"), tp + fn), pair("missed", fn, tp + fn))
    return p.select("photo", F.explode(rows).alias("r")).select("photo", "r.*")


PHOTO_METRICS = """with p as (select photo, count(*) filter (status = 'TP')::double as tp, count(*) filter (status = 'FP')::double as fp, count(*) filter (status = 'FN')::double as fn, coalesce(sum(iou) filter (status = 'TP'), 0) as iou, count(*) filter (status = 'TP' and conf >= 0.5)::double as sure from (select distinct * from e2e_match_gangnam) group by 1)
select photo, 'recall' as metric, tp as num, tp + fn as den from p union all select photo, 'precision', tp, tp + fp from p union all select photo, 'f1', 2 * tp, 2 * tp + fp + fn from p
union all select photo, 'overlap', round(iou, 6), tp from p union all select photo, 'sure', sure, tp + fn from p union all select photo, 'missed', fn, tp + fn from p"""


def sample_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred source photos by seed, dealt to five folds."""
    s = table(spark, sf_dir, "crop_manifest").select("source_image").where("source_image is not null").distinct()
    r = splits.ranked(s, [], "source_image", 13).where("r <= 500")
    return r.select("source_image", F.pmod(F.col("r") - 1, F.lit(5)).cast("int").alias("fold"))


SAMPLE_FOLDS = "select source_image, cast((r - 1) % 5 as integer) as fold from (select *, row_number() over (order by ('0x' || substr(md5('13:' || source_image), 1, 15))::bigint, source_image) as r from (select distinct source_image from crop_manifest where source_image is not null)) where r <= 500"


def photo_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True signs of a photo numbered in the order of the file."""
    m = table(spark, sf_dir, "e2e_match_gangnam").where("gt_index is not null and photo is not null").select("photo", "gt_index").distinct()
    return rank_by_span(m, ["photo"], F.shiftright("gt_index", 6), [F.col("gt_index")], "n").select("photo", "gt_index", "n")


NUMBERS = "select photo, gt_index, cast(row_number() over (partition by photo order by gt_index) as integer) as n from (select distinct photo, gt_index from e2e_match_gangnam where gt_index is not null and photo is not null)"


def next_photo_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a photo and that with the next number in its region name a sign in common."""
    d = table(spark, sf_dir, "tagging_gt_v1").where("trim(name) <> '' and image_name is not null").select("region", F.regexp_replace("image_name", "__crop_[0-9]+$", "").alias("photo"), "name").distinct()
    d = d.withColumn("n", t.trailing_number(F.col("photo")))
    then = d.select("region", (F.col("n") - 1).alias("n"), "name", F.lit(1).alias("shares")).distinct()
    both = d.select("region", "photo", "n").distinct().join(then.select("region", "n").distinct(), ["region", "n"])
    shared = d.join(then, ["region", "n", "name"], "left_semi").select("region", "photo", F.lit(True).alias("shares")).distinct()
    return both.join(shared, ["region", "photo"], "left").select("region", "photo", F.coalesce("shares", F.lit(False)).alias("shares"))


NEXT = """with p as (select region, regexp_replace(image_name, '__crop_[0-9]+$', '') as photo, list(distinct name) as names from tagging_gt_v1 where trim(name) <> '' and image_name is not null group by 1, 2),
q as (select *, cast(regexp_extract(photo, '([0-9]+)[^0-9]*$', 1) as bigint) as n from p where regexp_matches(photo, '[0-9]')), r as (select region, n, list_distinct(flatten(list(names))) as names from q group by 1, 2)
select a.region, a.photo, list_has_any(a.names, b.names) as shares from q a join r b on a.region = b.region and b.n = a.n + 1"""


def cascade_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line scores over three denominators: all true signs, the found ones, and all with the missed ones read as nothing."""
    gt = table(spark, sf_dir, "ocr_gangnam_gt").where("image_name is not null").groupBy("image_name").agg(F.max("gt_text").alias("text"))
    read = gt.select("image_name", F.translate("text", "eo이", "c0미").alias("text"))
    m = table(spark, sf_dir, "e2e_match_gangnam").where("gt_index is not null").select(F.format_string("%s__crop_%03d", "photo", "gt_index").alias("image_name"), (F.col("status") == "TP").alias("hit")).groupBy("image_name").agg(F.max("hit").alias("hit"))
    seen = gt.join(m, "image_name")
    kept = read.join(m.where("hit"), "image_name", "left_semi")
    parts = [("truth", seen.select("image_name", "text"), read), ("found", seen.where("hit").select("image_name", "text"), kept), ("with misses", seen.select("image_name", "text"), kept)]
    out = None
    for name, truth, pred in parts:
        c = scoring.add_up(scoring.crop_counters(truth, pred, "image_name").withColumn("row", F.lit(name)), ["row"])
        out = c if out is None else out.unionByName(c)
    return out.select("row", "crops", "empty", "lines", "letters", "edits", "exact", F.round("cer", 6).alias("cer"), F.round("exact_rate", 6).alias("exact_rate"))


QUERIES = {f.__name__: f for f in (pooled_hints, coverage_top5, legacy_match, dataset_scan, best_epoch, photo_metrics, sample_folds, photo_numbers, next_photo_overlap, cascade_scores)}
ORACLES = {"pooled_hints": POOLED, "coverage_top5": COVER5, "legacy_match": LEGACY, "match_then_ap": MATCH_AP, "dataset_scan": SCAN, "best_epoch": BEST, "photo_metrics": PHOTO_METRICS, "sample_folds": SAMPLE_FOLDS, "photo_numbers": NUMBERS, "next_photo_overlap": NEXT}
