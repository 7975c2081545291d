"""Queries over boxes: filters, coordinates, overlap, matching, suppression, average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import geometry as g
from glyphmill.operators import matching, metrics
from glyphmill.sources.tables import table


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop boxes with area, each record once."""
    c = table(spark, sf_dir, "crop_manifest").select("annotation_id", "source_image_id", "class", "x", "y", "w", "h").distinct()
    return c.where("w > 0 and h > 0 and x is not null and y is not null")


CROPS = "with c as (select distinct annotation_id, source_image_id, class, x, y, w, h from crop_manifest where w > 0 and h > 0 and x is not null and y is not null)\n"
WIDTH, HEIGHT = 4096, 3072


def box_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that pass the area, size and watermark rules."""
    c = _crops(spark, sf_dir)
    plausible = F.col("w") * F.col("h") >= WIDTH * HEIGHT * 0.0001
    not_all = (F.col("w") <= 0.95 * WIDTH) & (F.col("h") <= 0.95 * HEIGHT)
    mark = (F.col("x") > 0.8 * WIDTH) & (F.col("y") > 0.8 * HEIGHT)
    return c.groupBy("class", plausible.alias("plausible"), not_all.alias("not_all"), mark.alias("mark")).agg(F.count(F.lit(1)).alias("boxes"))


BOX_FILTERS = CROPS + f"select class, w * h >= {WIDTH * HEIGHT * 0.0001} as plausible, (w <= {0.95 * WIDTH} and h <= {0.95 * HEIGHT}) as not_all, (x > {0.8 * WIDTH} and y > {0.8 * HEIGHT}) as mark, count(*) as boxes from c group by 1, 2, 3, 4"


def box_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _crops(spark, sf_dir)
    b = g.xywh_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    half = g.rescale(b, F.lit(WIDTH), F.lit(HEIGHT), F.lit(WIDTH / 2), F.lit(HEIGHT / 2))
    y = g.to_yolo(b, F.lit(WIDTH), F.lit(HEIGHT))
    pad = g.pad_clip(b, 0.06, F.lit(float(WIDTH)), F.lit(float(HEIGHT)))
    lb = g.letterbox(b, F.lit(float(WIDTH)), F.lit(float(HEIGHT)), 512)
    r = lambda x: F.round(x, 6)
    return c.select("annotation_id", r(half["x1"]).alias("half_x1"), r(y["xc"]).alias("xc"), r(y["h"]).alias("yh"), pad["x0"].alias("pad_x0"), pad["y1"].alias("pad_y1"), r(lb["y0"]).alias("lb_y0"), r(g.crop_scale(F.col("w"), F.col("h"))).alias("scale"))


BOX_COORDS = CROPS + f"""
select annotation_id, round((x + w) * 0.5, 6) as half_x1, round((x + x + w) / 2.0 / {WIDTH}, 6) as xc, round(h / {HEIGHT}, 6) as yh,
  case when least(ceil(x + w + w * 0.06), {WIDTH}) > greatest(floor(x - w * 0.06), 0) and least(ceil(y + h + h * 0.06), {HEIGHT}) > greatest(floor(y - h * 0.06), 0) then cast(greatest(floor(x - w * 0.06), 0) as double) end as pad_x0,
  case when least(ceil(x + w + w * 0.06), {WIDTH}) > greatest(floor(x - w * 0.06), 0) and least(ceil(y + h + h * 0.06), {HEIGHT}) > greatest(floor(y - h * 0.06), 0) then cast(least(ceil(y + h + h * 0.06), {HEIGHT}) as double) end as pad_y1,
  round(y * {512 / WIDTH} + {(512 - HEIGHT * 512 / WIDTH) / 2}, 6) as lb_y0, round(least(4.0, 1400.0 / greatest(w, h)), 6) as scale
from c
"""


def box_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _crops(spark, sf_dir)
    s = c.select("annotation_id", F.posexplode(g.stripes(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).alias("part", "s"))
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("stripes"), F.round(F.sum(F.col("s.w") * F.col("s.h")), 3).alias("area"))


BOX_STRIPES = CROPS + """, n as (select *, case when greatest(w, h) >= 80 then 3 when greatest(w, h) >= 40 then 2 else 1 end as n from c),
s as (select annotation_id, w, h, n, case when w >= h then w / n else w end as sw, case when w >= h then h else h / n end as sh from n),
k as (select annotation_id, sw, sh, unnest(range(0, n)) as part from s where sw >= 4 and sh >= 4 union all select annotation_id, w, h, 0 from s where not (sw >= 4 and sh >= 4))
select cast(part as integer) as part, count(*) as stripes, round(sum(sw * sh), 3) as area from k group by 1
"""


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _crops(spark, sf_dir).where("source_image_id is not null")
    return c.withColumn("box", g.xywh_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def iou_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line boxes of a photo that overlap."""
    c = _boxed(spark, sf_dir)
    a = c.where("class = 'word'").select("source_image_id", F.col("annotation_id").alias("a"), "box")
    b = c.where("class = 'line'").select("source_image_id", F.col("annotation_id").alias("b"), "box")
    return matching.overlap_join(a, b, "source_image_id").select("a", "b", F.round("iou", 6).alias("iou"))


IOU_JOIN = CROPS + """
select a.annotation_id as a, b.annotation_id as b, round(i / (a.w * a.h + b.w * b.h - i), 6) as iou from (
  select a, b, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as i
  from c a join c b on a.source_image_id = b.source_image_id and a.class = 'word' and b.class = 'line' and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)
"""


def greedy_box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes as predictions, confidence by their size, against line boxes."""
    c = _boxed(spark, sf_dir)
    pred = c.where("class = 'word'").select("source_image_id", F.col("annotation_id").alias("a"), "box", (F.col("w") * F.col("h")).cast("double").alias("conf"))
    truth = c.where("class = 'line'").select("source_image_id", F.col("annotation_id").alias("b"), "box")
    m = matching.match_boxes(pred, truth, "source_image_id", 0.1)
    return m.select("source_image_id", "a", "b", F.round("iou", 6).alias("iou"), "conf", "status")


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per class that survive suppression, largest first."""
    c = _boxed(spark, sf_dir).withColumn("id", F.col("annotation_id"))
    kept = matching.suppress(c.select("source_image_id", "id", "box", "class"), "source_image_id", [-g.area(F.col("box"))], 0.3)
    return kept.groupBy("class").agg(F.count(F.lit(1)).alias("boxes"))


def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word boxes that lie on a line box, grouped into rows within 0.6 of their mean height, in reading order."""
    c = _boxed(spark, sf_dir)
    words = c.where("class = 'word' and annotation_id is not null").select("source_image_id", F.col("annotation_id").cast("bigint").alias("id"), "box")
    lines = c.where("class = 'line'").select("source_image_id", F.col("annotation_id").alias("b"), "box")
    return matching.word_rows(words, lines, "source_image_id", 0.6)


#: Rows as a recursion over the words of a line box by centre: each joins the first row whose mean is near, else starts one.
LINE_GROUPING = CROPS.replace("with c", "with recursive c") + """, o as (select a.source_image_id, b.annotation_id as b, a.annotation_id as a, a.y + a.h / 2 as y, a.x as x, a.h as h
  from c a join c b on a.source_image_id = b.source_image_id and a.class = 'word' and b.class = 'line' and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h),
s as (select *, row_number() over (partition by source_image_id, b order by y, x, a::bigint) as n, avg(h) over (partition by source_image_id, b) * 0.6 as tol from o),
r as (select source_image_id, b, 0::bigint as n, cast([] as double[]) as m, cast([] as bigint[]) as k, cast([] as integer[]) as sq from (select distinct source_image_id, b from s)
  union all select source_image_id, b, n, case when hit > len(m) then list_append(m, y) else list_transform(m, lambda v, i: case when i = hit then (v * k[i] + y) / (k[i] + 1) else v end) end,
    case when hit > len(m) then list_append(k, 1) else list_transform(k, lambda v, i: case when i = hit then v + 1 else v end) end, list_append(sq, hit)
  from (select r.source_image_id, r.b, s.n, r.m, r.k, r.sq, s.y, coalesce(list_position(list_transform(r.m, lambda v: abs(v - s.y) <= s.tol), true), len(r.m) + 1)::integer as hit
    from r join s on s.source_image_id = r.source_image_id and s.b = r.b and s.n = r.n + 1)),
l as (select * from r qualify row_number() over (partition by source_image_id, b order by n desc) = 1),
w as (select s.source_image_id, s.b, s.a, s.x, l.sq[s.n] as rw, l.m[l.sq[s.n]] as mean, len(l.m) as rows from s join l on l.source_image_id = s.source_image_id and l.b = s.b)
select source_image_id, b, cast(any_value(rows) as integer) as rows, count(*) as words, string_agg(a::bigint::varchar, ' ' order by mean, rw, x, a::bigint) as "order" from w group by 1, 2
"""


def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", F.lit("1970-01-01")).alias("d"))
    s = matching.gap_segments(li, ["l_orderkey"], "d", "d", ["l_linenumber"], 14)
    return s.groupBy("l_orderkey").agg((F.max("segment") + 1).alias("segments"), F.count(F.lit(1)).alias("lines"))


GAP_SEGMENTS = """
with d as (select l_orderkey, l_linenumber, datediff('day', date '1970-01-01', cast(l_shipdate as date)) as d from lineitem),
g as (select l_orderkey, case when d - max(d) over (partition by l_orderkey order by d, l_linenumber rows between unbounded preceding and 1 preceding) > 14 then 1 else 0 end as n from d)
select l_orderkey, cast(sum(n) + 1 as bigint) as segments, count(*) as lines from g group by 1
"""


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf_dir, "e2e_match_gangnam").distinct().withColumn("region", F.split_part("photo", F.lit("__"), F.lit(1)))
    hits = m.where("status <> 'FN'").select("region", "conf", (F.col("status") == "TP").alias("hit"), "det_crop")
    return hits, m.where("status <> 'FP'").groupBy("region").agg(F.count(F.lit(1)).alias("total"))


HITS = """with m as (select distinct * from e2e_match_gangnam), h as (select split_part(photo, '__', 1) as region, conf, status = 'TP' as hit, det_crop from m where status <> 'FN'),
n as (select split_part(photo, '__', 1) as region, count(*) as total from m where status <> 'FP' group by 1),
c as (select *, count(*) over w as cn, count(*) filter (hit) over w as ct from h window w as (partition by region order by coalesce(conf, -1) desc, det_crop rows unbounded preceding)),
e as (select *, ct / cn as p, max(ct / cn) over (partition by region order by coalesce(conf, -1) desc, det_crop rows between current row and unbounded following) as env from c)
"""


def ap_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, totals = _hits(spark, sf_dir)
    a = metrics.average_precision(hits, "region", "conf", "hit", "det_crop", totals)
    return a.select("region", *[F.round(c, 6).alias(c) for c in ("ap_all", "ap_step", "ap_101")], "total")


def ap_sql(source: str, group: str) -> str:
    """SQL of the three average precisions over ``source`` rows ``(group, conf, hit, det_crop)`` and ``n (group, total)``."""
    return f"""c as (select *, count(*) over w as cn, count(*) filter (hit) over w as ct from {source} window w as (partition by {group} order by coalesce(conf, -1) desc, det_crop rows unbounded preceding)),
e as (select *, ct / cn as p, max(ct / cn) over (partition by {group} order by coalesce(conf, -1) desc, det_crop rows between current row and unbounded following) as env from c),
pt as (select {group}, total, ct as k, max(env) as top, min(env) as low from e join n using ({group}) group by 1, 2, 3),
p0 as (select {group}, total, k, top, low from pt union all select {group}, total, 0, greatest(1, max(top)), null from pt group by 1, 2),
p1 as (select {group}, total, k, max(top) as top, coalesce(min(low), max(top)) as low, max(k) over (partition by {group}) as last from p0 group by 1, 2, 3),
x as (select {group}, unnest(range(0, 101)) as i from n where {group} in (select {group} from pt)),
y as (select x.{group}, x.i, a.k, a.low, a.last, a.total, b.top as nxt, row_number() over (partition by x.{group}, x.i order by a.k desc) as rn
  from x join p1 a on a.{group} = x.{group} and round(a.k * 100.0 / a.total, 9) <= x.i left join p1 b on b.{group} = a.{group} and b.k = a.k + 1),
z as (select {group}, i, case when k = total then 0.0 when k = last then low - low * (i / 100.0 - k / total) / (1 - k / total) else low + (nxt - low) * (i / 100.0 - k / total) * total end as v from y where rn = 1),
t as (select {group}, sum(v * case when i in (0, 100) then 0.5 else 1 end) / 100 as ap_101 from z group by 1),
ap as (select n.{group}, coalesce(sum(env / total) filter (hit), 0) as ap_all, coalesce(sum(p / total) filter (hit), 0) as ap_step, coalesce(any_value(ap_101), 0) as ap_101, total
  from n left join e using ({group}) left join t using ({group}) group by 1, total)
"""


AP_CURVES = "with m as (select distinct * from e2e_match_gangnam), h as (select split_part(photo, '__', 1) as region, conf, status = 'TP' as hit, det_crop from m where status <> 'FN'), n as (select split_part(photo, '__', 1) as region, count(*) as total from m where status <> 'FP' group by 1),\n" + ap_sql("h", "region") + "select region, round(ap_all, 6) as ap_all, round(ap_step, 6) as ap_step, round(ap_101, 6) as ap_101, total from ap"


def pr_at_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, totals = _hits(spark, sf_dir)
    s = hits.where("conf >= 0.25").groupBy("region").agg(F.count(F.lit(1)).alias("preds"), F.count_if("hit").alias("tp")).join(totals, "region")
    p, r = metrics.ratio(F.col("tp"), F.col("preds")), metrics.ratio(F.col("tp"), F.col("total"))
    return s.select("region", "preds", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(metrics.ratio(2 * p * r, p + r), 6).alias("f1"))


PR_AT_CONF = HITS + """
select region, count(*) as preds, count(*) filter (hit) as tp, round(count(*) filter (hit) / count(*), 6) as precision, round(count(*) filter (hit) / total, 6) as recall,
  round(2 * count(*) filter (hit) / (count(*) + total), 6) as f1
from h join n using (region) where conf >= 0.25 group by region, total
"""

QUERIES = {f.__name__: f for f in (box_filters, box_coords, box_stripes, iou_join, greedy_box_match, nms, line_grouping, gap_segments, ap_curves, pr_at_conf)}
ORACLES = {"box_filters": BOX_FILTERS, "box_coords": BOX_COORDS, "box_stripes": BOX_STRIPES, "iou_join": IOU_JOIN, "line_grouping": LINE_GROUPING, "gap_segments": GAP_SEGMENTS, "ap_curves": AP_CURVES, "pr_at_conf": PR_AT_CONF}
