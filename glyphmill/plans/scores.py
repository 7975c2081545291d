"""Queries that score read text, composed readings, retrieval and the tagging cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import labels, metrics, retrieval, scoring
from glyphmill.plans.records import ASKED, COS, LOG_LATEST, _asked, _entries, log_latest
from glyphmill.plans.texts import ENGINES, _engines
from glyphmill.sources.tables import table


def base_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring forms of part names with phone numbers and plain numbers behind them."""
    p = table(spark, sf_dir, "part")
    n = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    tail = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" 1588-"), n)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" +82-10-1234-"), n)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit(" 12345"), n)).otherwise(F.concat(F.lit(" 718.387."), n, F.lit("7")))
    text = F.concat(F.upper("p_name"), tail, F.lit(" #2F"))
    return p.select("p_partkey", t.base_norm(text).alias("form"), t.norm_cer(text).alias("letters"), F.size(t.norm_words(text)).alias("words"), t.norm_cer(text, phones=False).alias("with_phone"), t.clean_text(text).alias("clean"))


BASE_NORM = r"""
with p as (select p_partkey, upper(p_name) || case p_partkey % 4 when 0 then ' 1588-' || lpad((p_partkey % 10000)::varchar, 4, '0') when 1 then ' +82-10-1234-' || lpad((p_partkey % 10000)::varchar, 4, '0')
  when 2 then ' 12345' || lpad((p_partkey % 10000)::varchar, 4, '0') else ' 718.387.' || lpad((p_partkey % 10000)::varchar, 4, '0') || '7' end || ' #2F' as text from part),
b as (select *, regexp_replace(regexp_replace(lower(text), '(\+\d{1,3}[-.)\s]?)?\d{2,4}[-.)\s]\s?(\d{3,4}[-.\s]\s?)?\d{4}([^\d]|$)', ' \3', 'g'), '[^0-9a-z가-힣\s]', '', 'g') as form from p)
select p_partkey, form, regexp_replace(form, '\s+', '', 'g') as letters, cast(len(list_filter(regexp_split_to_array(form, '\s+'), lambda w: w <> '')) as integer) as words,
  regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g') as with_phone, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean from b
"""


def eval_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of every sign text, the tagged name and a damaged copy, scored by region, and over all regions."""
    gt = table(spark, sf_dir, "ocr_gangnam_gt").select("image_name", F.col("gt_text").alias("text"))
    gt = gt.where("image_name is not null").groupBy("image_name").agg(F.max("text").alias("text"))
    names = table(spark, sf_dir, "tagging_gt_v1").where("image_name is not null").groupBy("image_name").agg(F.max("name").alias("text"))
    damaged = gt.select("image_name", F.translate("text", "eo이", "c0미").alias("text"))
    each = [scoring.crop_counters(gt, p, "image_name").withColumn("engine", F.lit(n)) for n, p in (("names", names), ("damaged", damaged))]
    c = each[0].unionByName(each[1]).withColumn("region", F.substring_index("image_name", "__", 1))
    c = c.unionByName(c.withColumn("region", F.lit("ALL")))
    s = scoring.add_up(c, ["engine", "region"])
    return s.select("engine", "region", *scoring.COUNTERS, *[F.round(x, 6).alias(x) for x in ("cer", "war", "wer", "exact_rate", "recall", "contain_rate")])


def compose_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One engine's reading and behind it the other's where it is not like it."""
    r = _engines(spark, sf_dir)
    one = lambda e: r.where(F.col("engine") == e).select("p_partkey", F.col("pred").alias("text"))
    return scoring.compose(one("e1"), one("e3").withColumn("text", F.when(F.col("p_partkey") % 11 == 0, F.reverse("text")).otherwise(F.col("text"))), "p_partkey").select("p_partkey", "text")


COMPOSE = ENGINES + r""", a as (select p_partkey, pred as x, regexp_replace(lower(pred), '[^0-9a-z]', '', 'g') as k from r where engine = 'e1'),
b as (select p_partkey, y, regexp_replace(lower(y), '[^0-9a-z]', '', 'g') as l from (select p_partkey, case when p_partkey % 11 = 0 then reverse(pred) else pred end as y from r where engine = 'e3'))
select p_partkey, trim(x) || case when length(l) >= 2 and not (length(k) > 0 and (contains(k, l) or contains(l, k) or (abs(length(k) - length(l)) * 2 <= greatest(length(k), length(l)) and levenshtein(k, l) <= greatest(1, floor(least(length(k), length(l)) * 0.3)))))
  then chr(10) || trim(y) else '' end as text from a join b using (p_partkey)
"""


def nearest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each reading of the first engine the nearest of the others, if near enough."""
    r = _engines(spark, sf_dir)
    a = r.where("engine = 'e1'").select("p_partkey", F.lit(0).alias("i"), F.col("pred").alias("line"))
    b = r.where("engine <> 'e1'").select("p_partkey", "engine", F.lit(0).alias("j"), F.col("pred").alias("line"))
    return scoring.nearest_lines(a, b, ["p_partkey"], "engine").select("p_partkey", "engine", "line", "edits")


NEAREST = ENGINES + "select b.p_partkey, b.engine, b.pred as line, cast(levenshtein(a.pred, b.pred) as integer) as edits from r a join r b on a.p_partkey = b.p_partkey and a.engine = 'e1' and b.engine <> 'e1' where levenshtein(a.pred, b.pred) <= greatest(2, floor(length(a.pred) / 2))"


def sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per engine and size of part, as of a sweep over two parameters, and the best engine of each size."""
    r = _engines(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    s = metrics.line_scores(r, ["engine", "p_size"])
    best = F.row_number().over(Window.partitionBy("p_size").orderBy("cer", "engine")) == 1
    return s.select("engine", "p_size", "lines", F.round("cer", 6).alias("cer"), F.round("exact_rate", 6).alias("exact_rate"), best.alias("best"))


SWEEP = ENGINES + """, s as (select engine, p_size, count(*) as lines, sum(levenshtein(truth, pred)) / sum(length(truth)) as cer, count(*) filter (truth = pred and truth <> '') / count(*) as exact_rate from r join part using (p_partkey) group by 1, 2)
select engine, p_size, lines, round(cer, 6) as cer, round(exact_rate, 6) as exact_rate, row_number() over (partition by p_size order by cer, engine) = 1 as best from s"""


def _hybrid(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """``(query, entry_id, score, rank)``: lexical and dense rankings fused, pools of ``max(3 k, 30)``, one entry per key."""
    pool = max(3 * k, 30)
    e = _entries(spark, sf_dir)
    lex = retrieval.lexical_topk(e, _asked(spark, sf_dir), k=pool).select("query", "entry_id", "rank")
    v = table(spark, sf_dir, "embeddings").join(e.select(F.col("entry_id").alias("vec_id")), "vec_id", "left_semi")
    own = e.select(F.expr("substr(key, 2)").alias("query"), "entry_id").groupBy("query").agg(F.min("entry_id").alias("query_id"))
    near = retrieval.dense_topk(v, v, pool).join(own, "query_id").where("length(query) >= 2").select("query", F.col("vec_id").alias("entry_id"), "rank")
    fused = retrieval.fuse(lex.unionByName(near), "query", "entry_id", 3 * k).join(e.select("entry_id", "key"), "entry_id")
    first = F.row_number().over(Window.partitionBy("query", "key").orderBy("rank"))
    fused = fused.withColumn("_n", first).where("_n = 1")
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("rank") <= k).select("query", "entry_id", "score", "rank")


HYBRID = ASKED + ", v as (select embeddings.* from embeddings where vec_id in (select entry_id from e)), w as (select substr(key, 2) as query, min(entry_id) as query_id from e group by 1), d as (select query_id, vec_id, row_number() over (partition by query_id order by c desc, vec_id) as rank from (select q.vec_id as query_id, v.vec_id, round(" + COS.format("q.embedding", "v.embedding") + """, 9) as c from v q, v where q.vec_id <> v.vec_id)),
u as (select query, entry_id, rank from f where rank <= 30 union all select query, vec_id, rank from d join w using (query_id) where rank <= 30 and length(query) >= 2),
g as (select query, entry_id, sum(1.0::double / (10 + rank)) as score from u group by 1, 2),
h as (select *, row_number() over (partition by query order by round(score, 12) desc, entry_id) as rank from g),
i as (select h.*, row_number() over (partition by query, key order by rank) as n from h join e using (entry_id) where rank <= 15),
y as (select query, entry_id, score, row_number() over (partition by query order by rank) as rank from i where n = 1)
"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query", "entry_id", F.round("score", 6).alias("score"), "rank")


RRF = HYBRID + "select query, entry_id, round(score, 6) as score, cast(rank as integer) as rank from y where rank <= 5"


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the entry asked for stands among the first k of the lexical, and of the fused ranking."""
    own = _entries(spark, sf_dir).select(F.expr("substr(key, 2)").alias("query"), F.col("entry_id").alias("gold")).groupBy("query").agg(F.min("gold").alias("gold"))
    out = None
    for name, r in (("lexical", retrieval.lexical_topk(_entries(spark, sf_dir), _asked(spark, sf_dir), k=10)), ("fused", _hybrid(spark, sf_dir, 10))):
        h = retrieval.hit_at(r.select("query", "entry_id", "rank").join(own, "query").withColumn("good", F.col("entry_id") == F.col("gold")), "query", "good").withColumn("ranker", F.lit(name))
        out = h if out is None else out.unionByName(h)
    return out.select("ranker", "k", "queries", "hits")


HIT = HYBRID.replace("where rank <= 15", "where rank <= 30") + """, o2 as (select 'lexical' as ranker, query, entry_id, rank from f where rank <= 10 union all select 'fused', query, entry_id, rank from y where rank <= 10),
t as (select ranker, query, min(rank) filter (entry_id = query_id) as first from o2 join w using (query) group by 1, 2)
select ranker, k, count(*) as queries, count(*) filter (first <= k) as hits from t, (values (1), (3), (5), (10)) k(k) group by 1, 2"""


def retrieval_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of entry: queries, share with a hit of the same kind first, median similarity of first hits."""
    r = retrieval.lexical_topk(_entries(spark, sf_dir), _asked(spark, sf_dir), k=5)
    own = _entries(spark, sf_dir).select(F.expr("substr(key, 2)").alias("query"), "entry_id", F.col("tag").alias("gold"), F.col("key").alias("gk")).groupBy("query").agg(F.min_by("gold", "entry_id").alias("gold"), F.min_by("gk", "entry_id").alias("gk"))
    j = own.join(r.select("query", "tag", "key", "sim", "rank"), "query", "left")
    per = j.groupBy("query", "gold").agg(F.max((F.col("key") == F.col("gk")).cast("int")).alias("found"), F.max(F.when(F.col("rank") == 1, F.col("tag"))).alias("t1"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("s1"))
    return per.groupBy("gold").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("found") == 1).alias("found"), F.count_if((F.col("t1") != F.col("gold")) & (F.coalesce("found", F.lit(0)) == 0)).alias("misled"), F.round(F.median("s1"), 6).alias("median_sim"))


AUDIT = ASKED + """, o2 as (select substr(key, 2) as query, arg_min(tag, entry_id) as gold, arg_min(key, entry_id) as gk from e group by 1),
p2 as (select o2.query, gold, max((f.key = gk)::int) as found, max(f.tag) filter (rank = 1) as t1, max(f.sim) filter (rank = 1) as s1 from o2 left join (select * from f where rank <= 5) f on f.query = o2.query group by 1, 2)
select gold, count(*) as queries, count(*) filter (found = 1) as found, count(*) filter (t1 <> gold and coalesce(found, 0) = 0) as misled, round(median(s1), 6) as median_sim from p2 group by 1"""


def cascade_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags carried through detection: right on found signs and on all true ones, abstained, and false entries, per region."""
    m = table(spark, sf_dir, "e2e_match_gangnam").distinct().withColumn("image_name", F.format_string("%s__crop_%03d", "photo", "gt_index"))
    truth = labels.latest(table(spark, sf_dir, "tagging_gt_v1").withColumn("o", F.struct("tag", "verdict", "name")), "image_name", "o").select("image_name", "tag", "eval_tag")
    pred = log_latest(spark, sf_dir).select("image_name", F.col("tag").alias("pred"))
    j = m.join(truth, "image_name", "left").join(pred, "image_name", "left").withColumn("pred", F.when(F.col("status") == "FP", F.when(F.col("conf") >= 0.5, "shop=books").otherwise("unknown")).otherwise(F.col("pred")))
    on = lambda s: (F.col("status") == s) & (F.col("eval_tag") == "1")
    none = F.coalesce(F.trim("pred"), F.lit("")).isin("", "unknown")
    s = j.groupBy(F.split_part("photo", F.lit("__"), F.lit(1)).alias("region")).agg(
        F.count_if(on("TP")).alias("tp"), F.count_if(on("TP") & (F.col("pred") == F.col("tag"))).alias("tp_right"), F.count_if(on("TP") & none & ~F.coalesce(F.col("pred") == F.col("tag"), F.lit(False))).alias("tp_abstained"),
        F.count_if(on("FN")).alias("fn"), F.count_if(F.col("status") == "FP").alias("fp"), F.count_if((F.col("status") == "FP") & ~none).alias("fp_tagged"),
    )
    r = lambda a, b: F.round(metrics.ratio(a, b), 6)
    return s.withColumns({"recall": r(F.col("tp_right"), F.col("tp") + F.col("fn")), "on_found": r(F.col("tp_right"), F.col("tp")), "false_entries": r(F.col("fp_tagged"), F.col("fp"))})


CASCADE_TAGS = f"""with l as ({LOG_LATEST}), t as (select * from (select image_name, tag, eval_tag, row_number() over (partition by image_name order by tag desc nulls last, verdict desc nulls last, name desc nulls last) as rn from tagging_gt_v1) where rn = 1),
j as (select m.*, t.tag, t.eval_tag, case when status = 'FP' then case when conf >= 0.5 then 'shop=books' else 'unknown' end else l.tag end as pred
  from (select distinct * from e2e_match_gangnam) m left join t on t.image_name = m.photo || '__crop_' || lpad(cast(m.gt_index as varchar), 3, '0') left join l on l.image_name = m.photo || '__crop_' || lpad(cast(m.gt_index as varchar), 3, '0')),
s as (select split_part(photo, '__', 1) as region, count(*) filter (status = 'TP' and eval_tag = '1') as tp, count(*) filter (status = 'TP' and eval_tag = '1' and pred = tag) as tp_right,
  count(*) filter (status = 'TP' and eval_tag = '1' and coalesce(trim(pred), '') in ('', 'unknown') and coalesce(pred = tag, false) = false) as tp_abstained,
  count(*) filter (status = 'FN' and eval_tag = '1') as fn, count(*) filter (status = 'FP') as fp, count(*) filter (status = 'FP' and coalesce(trim(pred), '') not in ('', 'unknown')) as fp_tagged from j group by 1)
select *, round(case when tp + fn > 0 then tp_right / (tp + fn) else 0 end, 6) as recall, round(case when tp > 0 then tp_right / tp else 0 end, 6) as on_found, round(case when fp > 0 then fp_tagged / fp else 0 end, 6) as false_entries from s"""


def unmapped_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest tags that the list does not hold."""
    tags = table(spark, sf_dir, "tagging_gt_v1").where("trim(tag) <> ''").join(table(spark, sf_dir, "tag_vocabulary").select("tag"), "tag", "left_anti")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("records")).orderBy(F.col("records").desc(), "tag").limit(10)


UNMAPPED = "select tag, count(*) as records from tagging_gt_v1 where trim(tag) <> '' and tag not in (select tag from tag_vocabulary) group by 1 order by 2 desc, 1 limit 10"

QUERIES = {f.__name__: f for f in (base_norm, eval_engine, compose_readings, nearest_reading, sweep_scores, rrf_fusion, hit_at_k, retrieval_audit, cascade_tagging, unmapped_top)}
ORACLES = {"base_norm": BASE_NORM, "compose_readings": COMPOSE, "nearest_reading": NEAREST, "sweep_scores": SWEEP, "rrf_fusion": RRF, "hit_at_k": HIT, "retrieval_audit": AUDIT, "cascade_tagging": CASCADE_TAGS, "unmapped_top": UNMAPPED}
