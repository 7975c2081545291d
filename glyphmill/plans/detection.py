"""Queries over detections: matching into average precision, folds, clusters of proposals, crop names, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import geometry as g
from glyphmill.functions import text as t
from glyphmill.operators import matching, metrics
from glyphmill.operators.lineage import cut
from glyphmill.operators.ranking import rank_by_span
from glyphmill.plans.boxes import CROPS, HEIGHT, WIDTH, _boxed, _crops, ap_sql
from glyphmill.sources.tables import table

FOLDS = 5


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "e2e_match_gangnam").distinct()
    return m.withColumns({"region": F.split_part("photo", F.lit("__"), F.lit(1)), "fold": F.pmod(t.trailing_number(F.col("photo")), F.lit(FOLDS)).cast("int")})


def _ap_by(m: DataFrame, group: str) -> DataFrame:
    hits = m.where("status <> 'FN'").select(group, "conf", (F.col("status") == "TP").alias("hit"), "det_crop")
    totals = m.where("status <> 'FP'").groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return metrics.average_precision(hits.where(F.col(group).isNotNull()), group, "conf", "hit", "det_crop", totals.where(F.col(group).isNotNull()))


def fold_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision per fold, their plain and truth-weighted mean, and that of all folds pooled."""
    m = _matches(spark, sf_dir).withColumn("fold", F.col("fold").cast("string"))
    per = cut(_ap_by(m, "fold"))
    pooled = _ap_by(m.where("fold is not null").withColumn("fold", F.lit("pooled")), "fold")
    mean = per.agg(F.lit("mean").alias("fold"), *[F.avg(c).alias(c) for c in ("ap_all", "ap_step", "ap_101")], F.sum("total").alias("total"))
    heavy = per.agg(F.lit("weighted").alias("fold"), *[(F.sum(F.col(c) * F.col("total")) / F.sum("total")).alias(c) for c in ("ap_all", "ap_step", "ap_101")], F.sum("total").alias("total"))
    return per.unionByName(pooled).unionByName(mean).unionByName(heavy).select("fold", *[F.round(c, 6).alias(c) for c in ("ap_all", "ap_step", "ap_101")], "total")


FOLD_AP = "with m as (select distinct * from e2e_match_gangnam), f as (select *, cast(cast(regexp_extract(photo, '([0-9]+)[^0-9]*$', 1) as bigint) % 5 as varchar) as fold from m where regexp_matches(photo, '[0-9]')), u as (select * from f union all select * replace ('pooled' as fold) from f), h as (select fold, conf, status = 'TP' as hit, det_crop from u where status <> 'FN'), n as (select fold, count(*) as total from u where status <> 'FP' group by 1),\n" + ap_sql("h", "fold") + """
select fold, round(ap_all, 6) as ap_all, round(ap_step, 6) as ap_step, round(ap_101, 6) as ap_101, total from ap
union all select 'mean', round(avg(ap_all), 6), round(avg(ap_step), 6), round(avg(ap_101), 6), cast(sum(total) as bigint) from ap where fold <> 'pooled'
union all select 'weighted', round(sum(ap_all * total) / sum(total), 6), round(sum(ap_step * total) / sum(total), 6), round(sum(ap_101 * total) / sum(total), 6), cast(sum(total) as bigint) from ap where fold <> 'pooled'
"""


def match_then_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to matches to average precision: word boxes as predictions, line boxes as truth, per photo and over all."""
    c = _boxed(spark, sf_dir)
    pred = c.where("class = 'word'").select("source_image_id", F.col("annotation_id").alias("a"), "box", (F.col("w") * F.col("h") / 1e8).cast("double").alias("conf"))
    truth = c.where("class = 'line'").select("source_image_id", F.col("annotation_id").alias("b"), "box")
    m = cut(matching.match_boxes(pred, truth, "source_image_id", 0.1).select("a", "conf", "status")).withColumn("all", F.lit("all"))
    hits = m.where("status <> 'FN'").select("all", "conf", (F.col("status") == "TP").alias("hit"), F.col("a").alias("det_crop"))
    totals = m.where("status <> 'FP'").groupBy("all").agg(F.count(F.lit(1)).alias("total"))
    ap = metrics.average_precision(hits, "all", "conf", "hit", "det_crop", totals)
    n = m.groupBy("all").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("TP", "FP", "FN")])
    return ap.join(n, "all").select(F.round("ap_all", 6).alias("ap_all"), F.round("ap_101", 6).alias("ap_101"), "total", "tp", "fp", "fn")


#: Greedy matching as a recursion over the overlapping pairs of a photo in order: taken ends are kept in lists.
GREEDY = CROPS + """, o as (
  select a.source_image_id as g, a.annotation_id as a, b.annotation_id as b, cast(a.w as bigint) * a.h as conf, a.w * a.h as aa, b.w * b.h as bb,
    (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as i
  from c a join c b on a.source_image_id = b.source_image_id and a.class = 'word' and b.class = 'line' and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h),
j as (select g, a, b, conf, i / (aa + bb - i) as iou from o),
s as (select *, row_number() over (partition by g order by conf desc, a, iou desc, b) as n from j where iou >= 0.1),
r as (select g, 0 as n, cast([] as varchar[]) as ua, cast([] as varchar[]) as ub from (select distinct g from s)
  union all select r.g, s.n, case when list_contains(ua, s.a) or list_contains(ub, s.b) then ua else list_append(ua, s.a) end,
    case when list_contains(ua, s.a) or list_contains(ub, s.b) then ub else list_append(ub, s.b) end from r join s on s.g = r.g and s.n = r.n + 1),
l as (select g, ua, ub from r qualify row_number() over (partition by g order by n desc) = 1),
k as (select g, unnest(ua) as a, unnest(ub) as b from l),
tp as (select k.g, k.a, k.b, j.iou, j.conf from k join j on j.g = k.g and j.a = k.a and j.b = k.b),
p as (select source_image_id as g, annotation_id as a, cast(w as bigint) * h as conf from c where class = 'word' and source_image_id is not null),
q as (select source_image_id as g, annotation_id as b from c where class = 'line' and source_image_id is not null),
fp as (select p.g, p.a, p.conf, coalesce(max(j.iou) filter (t.b is null or p.conf < t.conf is false and (p.conf > t.conf or p.a < t.a)), 0) as iou
  from p left join j on j.g = p.g and j.a = p.a left join tp t on t.g = j.g and t.b = j.b where not exists (select 1 from tp where tp.g = p.g and tp.a = p.a) group by 1, 2, 3)
"""
GREEDY_MATCH = GREEDY.replace("with c", "with recursive c") + """
select g as source_image_id, a, b, round(iou, 6) as iou, cast(conf as double) as conf, 'TP' as status from tp
union all select g, a, null, round(iou, 6), cast(conf as double), 'FP' from fp
union all select q.g, null, q.b, 0.0, null, 'FN' from q where not exists (select 1 from tp where tp.g = q.g and tp.b = q.b)
"""
NMS = CROPS.replace("with c", "with recursive c") + """, b as (select * from c where source_image_id is not null),
o as (select a.source_image_id as g, a.annotation_id as hi, z.annotation_id as lo, cast(a.w as bigint) * a.h as size, cast(a.w as bigint) * a.h as aa, cast(z.w as bigint) * z.h as bb,
    (least(a.x + a.w, z.x + z.w) - greatest(a.x, z.x)) * (least(a.y + a.h, z.y + z.h) - greatest(a.y, z.y)) as i
  from b a join b z on a.source_image_id = z.source_image_id and (cast(a.w as bigint) * a.h > cast(z.w as bigint) * z.h or (cast(a.w as bigint) * a.h = cast(z.w as bigint) * z.h and a.annotation_id < z.annotation_id))
    and a.x < z.x + z.w and z.x < a.x + a.w and a.y < z.y + z.h and z.y < a.y + a.h),
s as (select *, row_number() over (partition by g order by size desc, hi, lo) as n from o where i / (aa + bb - i) > 0.3),
r as (select g, 0 as n, cast([] as varchar[]) as gone from (select distinct g from s)
  union all select r.g, s.n, case when list_contains(gone, s.hi) then gone else list_append(gone, s.lo) end from r join s on s.g = r.g and s.n = r.n + 1),
l as (select g, unnest(gone) as id from (select * from r qualify row_number() over (partition by g order by n desc) = 1))
select class, count(*) as boxes from b where not exists (select 1 from l where l.g = b.source_image_id and l.id = b.annotation_id) group by 1
"""


def box_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for one photo merged into clusters, by how many classes of boxes agree on them."""
    c = _boxed(spark, sf_dir).withColumn("id", F.col("annotation_id")).where("class is not null")
    m = matching.merge_boxes(c.select("source_image_id", "id", "box", "class"), "source_image_id", [-g.area(F.col("box"))], 0.3, "class")
    return m.groupBy(F.size("by").alias("models"), F.array_join("by", "+").alias("names")).agg(F.count(F.lit(1)).alias("clusters"))


def det_crop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a photo numbered by falling confidence, and the name of their crop."""
    m = table(spark, sf_dir, "e2e_match_gangnam").where("det_crop is not null and photo is not null").select("photo", "det_crop", "conf").distinct()
    steps = F.coalesce(-F.floor(F.col("conf") * 256), F.lit(1)).cast("int")
    return rank_by_span(m, ["photo"], steps, [F.col("conf").desc_nulls_last(), F.col("det_crop")], "n").select("photo", "det_crop", "n", t.crop_name(F.col("photo"), F.col("n")).alias("crop"))


DET_CROPS = "select photo, det_crop, cast(n as integer) as n, photo || '__crop_' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as crop from (select *, row_number() over (partition by photo order by conf desc nulls last, det_crop) as n from (select distinct photo, det_crop, conf from e2e_match_gangnam where det_crop is not null and photo is not null))"


def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per size; an unknown side is -1."""
    c = table(spark, sf_dir, "crop_manifest").select("annotation_id", "w", "h").distinct()
    return c.groupBy(F.coalesce("w", F.lit(-1)).alias("w"), F.coalesce("h", F.lit(-1)).alias("h")).agg(F.count(F.lit(1)).alias("boxes"))


SIZES = "select coalesce(w, -1) as w, coalesce(h, -1) as h, count(*) as boxes from (select distinct annotation_id, w, h from crop_manifest) group by 1, 2"


def line_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why crops of lines are turned away (too many letters, too low, too long for their height), and words that may join."""
    from glyphmill.operators.labels import admitted

    c = table(spark, sf_dir, "crop_manifest").select("annotation_id", "class", "text", "w", "h").distinct()
    c = c.withColumn("joins", F.coalesce((F.col("class") == "word") & (F.trim("text") != "") & ~F.contains(F.trim("text"), F.lit(" ")) & (F.col("w") > 0) & (F.col("h") > 0), F.lit(False)))
    rules = [("letters", F.length(F.trim("text")) > 25), ("low", F.col("h") < 12), ("long", F.col("w") / F.nullif(F.col("h"), F.lit(0)) > 12.0)]
    return admitted(c, rules).groupBy("joins", "reason").agg(F.count(F.lit(1)).alias("crops"))


LINE_ADMISSION = """with c as (select distinct annotation_id, class, text, w, h from crop_manifest)
select coalesce(class = 'word' and trim(text) <> '' and not contains(trim(text), ' ') and w > 0 and h > 0, false) as joins,
  case when coalesce(length(trim(text)) > 25, true) then 'letters' when coalesce(h < 12, true) then 'low' when coalesce(w / nullif(h, 0) > 12.0, true) then 'long' else 'ok' end as reason, count(*) as crops from c group by 1, 2"""


def new_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes that no line box of the photo overlaps by 0.3 or holds by 0.7, and photos without a line are counted apart."""
    c = _boxed(spark, sf_dir)
    a = c.where("class = 'word'").select("source_image_id", F.col("annotation_id").alias("a"), "box")
    b = c.where("class = 'line'").select("source_image_id", F.col("annotation_id").alias("b"), "box")
    boxes = lambda df, i: df.select("source_image_id", i, F.struct("box", i).alias("_"))
    near = matching.overlap_join(a, b, "source_image_id").join(a.select("source_image_id", "a", F.col("box").alias("ba")), ["source_image_id", "a"]).join(b.select("source_image_id", "b", F.col("box").alias("bb")), ["source_image_id", "b"])
    taken = near.where((F.col("iou") >= 0.3) | (g.inside(F.col("ba"), F.col("bb")) >= 0.7)).select("source_image_id", "a").distinct()
    new = a.join(taken, ["source_image_id", "a"], "left_anti")
    seen = b.select("source_image_id", F.lit(True).alias("lined")).distinct()
    return new.join(seen, "source_image_id", "left").groupBy(F.coalesce("lined", F.lit(False)).alias("lined")).agg(F.count(F.lit(1)).alias("boxes"), F.count_distinct("source_image_id").alias("photos"))


NEW_BOXES = CROPS + """, a as (select * from c where class = 'word' and source_image_id is not null), b as (select * from c where class = 'line' and source_image_id is not null),
t as (select distinct a.source_image_id as g, a.annotation_id as id from (select a, b, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as i
  from a join b on a.source_image_id = b.source_image_id and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h) where i / (a.w * a.h + b.w * b.h - i) >= 0.3 or i / (a.w * a.h) >= 0.7)
select source_image_id in (select source_image_id from b) as lined, count(*) as boxes, count(distinct source_image_id) as photos from a where not exists (select 1 from t where t.g = a.source_image_id and t.id = a.annotation_id) group by 1"""


def photo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a crop taken back to its photo: padded crop, scale, offset and back again."""
    c = _crops(spark, sf_dir)
    box = g.xywh_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    pad = g.crop_strip(F.array(box), 0.04, F.lit(WIDTH), F.lit(HEIGHT))
    s = g.crop_scale(F.col("w"), F.col("h"))
    inner = g.box(F.lit(0.0), F.lit(0.0), F.col("w") * s, F.col("h") * s)
    back = g.to_photo(inner, pad["x0"], pad["y0"], s)
    return c.select("annotation_id", "x", "y", pad["x0"].alias("px0"), pad["y1"].alias("py1"), F.round(back["x1"], 6).alias("bx1"), F.round(back["y1"], 6).alias("by1"))


PHOTO_BOXES = CROPS + f"""select annotation_id, x, y, cast(trunc(greatest(x - w * 0.04, 0)) as double) as px0, cast(trunc(least(y + h + h * 0.04, {HEIGHT})) as double) as py1,
  round(trunc(greatest(x - w * 0.04, 0)) + w, 6) as bx1, round(trunc(greatest(y - h * 0.04, 0)) + h, 6) as by1 from c"""

QUERIES = {f.__name__: f for f in (fold_ap, match_then_ap, box_clusters, det_crop_names, size_histogram, line_admission, new_boxes, photo_boxes)}
ORACLES = {"fold_ap": FOLD_AP, "greedy_box_match": GREEDY_MATCH, "nms": NMS, "det_crop_names": DET_CROPS, "size_histogram": SIZES, "line_admission": LINE_ADMISSION, "new_boxes": NEW_BOXES, "photo_boxes": PHOTO_BOXES}
