"""Queries over dictionaries, searches, folds, label logs and end-to-end counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import folds, labels, metrics, retrieval, stats
from glyphmill.sources.tables import table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = t.norm_key(F.col("p_name"), ascii_only=True)
    return p.groupBy(F.col("p_name").alias("name"), k.alias("key")).agg(F.min("p_partkey").alias("entry_id"), F.min_by("p_type", "p_partkey").alias("tag"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return e.select(F.expr("substr(key, 2)").alias("query")).distinct()


ASKED = """with e as (select p_name as name, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') as key, min(p_partkey) as entry_id, arg_min(p_type, p_partkey) as tag from part group by 1, 2),
q as (select distinct substr(key, 2) as query from e),
ek as (select * from e where length(key) >= 2), qk as (select * from q where length(query) >= 2),
eg as (select entry_id, unnest(list_distinct(list_transform(range(1, length(key)), lambda i: substr(key, i, 2)))) as gram from ek),
qg as (select query, unnest(list_distinct(list_transform(range(1, length(query)), lambda i: substr(query, i, 2)))) as gram from qk),
s as (select query, entry_id, count(*) as shared from qg join eg using (gram) group by 1, 2),
p as (select *, row_number() over (partition by query order by shared desc, entry_id) as r from s),
m as (select query, e.*, 1.0 - levenshtein(query, key)::double / greatest(length(query), length(key)) as sim from p join ek e using (entry_id) where r <= 200 and abs(length(query) - length(key)) * 2 <= greatest(length(query), length(key))),
o as (select *, row_number() over (partition by query, key order by sim desc, coalesce(tag, '') = '', length(name), entry_id) as rk from m where sim >= 0.55),
f as (select *, row_number() over (partition by query order by sim desc, coalesce(tag, '') = '', length(name), entry_id) as rank from o where rk = 1)
"""


def retrieve_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieval.lexical_topk(_entries(spark, sf_dir), _asked(spark, sf_dir))
    return r.select("query", "entry_id", "name", F.round("sim", 6).alias("sim"), "rank")


RETRIEVE = ASKED + "select query, entry_id, name, round(sim, 6) as sim, cast(rank as integer) as rank from f where rank <= 5"


def hint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints in rank order; tags only of two kinds and from a similarity of 0.9 on."""
    return retrieval.hints(retrieval.lexical_topk(_entries(spark, sf_dir), _asked(spark, sf_dir), k=3), ["PROMO", "STANDARD"], 0.9)


HINTS = ASKED + "select query, string_agg('- ' || name || case when tag in ('PROMO', 'STANDARD') and sim >= 0.9 then ' (' || tag || ')' else '' end, chr(10) order by rank) as hint from f where rank <= 3 group by 1"


def dict_merge_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part, supplier and customer names as three layers of falling rank."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("tag"), F.lit("part").alias("source"), F.lit(2).alias("source_rank"), F.col("p_partkey").alias("ord"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("").alias("tag"), F.lit("supplier").alias("source"), F.lit(3).alias("source_rank"), F.col("s_suppkey").alias("ord"))
    c = table(spark, sf_dir, "customer").select(F.regexp_replace("c_name", "Customer", "Supplier").alias("name"), F.col("c_mktsegment").alias("tag"), F.lit("customer").alias("source"), F.lit(1).alias("source_rank"), F.col("c_custkey").alias("ord"))
    e = p.unionByName(s).unionByName(c)
    return retrieval.merge_layers(e.withColumn("key", t.norm_key(F.col("name"), ascii_only=True))).select("key", "name", "tag", "source", "ord")


DICT_MERGE = """
with e as (select p_name as name, p_type as tag, 'part' as source, 2 as sr, p_partkey as ord from part union all select s_name, '', 'supplier', 3, s_suppkey from supplier
  union all select regexp_replace(c_name, 'Customer', 'Supplier', 'g'), c_mktsegment, 'customer', 1, c_custkey from customer),
k as (select *, regexp_replace(lower(name), '[^0-9a-z]', '', 'g') as key from e),
r as (select *, row_number() over (partition by key order by sr desc, coalesce(tag, '') = '', ord) as rn from k where length(key) >= 2)
select key, name, tag, source, ord from r where rn = 1
"""


def vocab_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all part names with at least three uses."""
    d = table(spark, sf_dir, "part")
    w = d.select(F.explode(F.split("p_name", r"\s+")).alias("word")).select("word", F.regexp_replace(F.lower("word"), "[^0-9a-z]", "").alias("key"))
    return retrieval.vocabulary(w, 3)


VOCAB = r"""
with w as (select unnest(regexp_split_to_array(p_name, '\s+')) as word from part),
n as (select regexp_replace(lower(word), '[^0-9a-z]', '', 'g') as key, word, count(*) as n from w group by 1, 2),
r as (select *, row_number() over (partition by key order by n desc, word) as rn, sum(n) over (partition by key) as freq from n where length(key) >= 2)
select key, word, cast(freq as bigint) as freq from r where rn = 1 and freq >= 3
"""


def vocab_min_freq_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents in any script with at least three uses; SQL has no NFKC, so there is no oracle."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    return retrieval.vocabulary(w.select("word", t.norm_key(F.col("word")).alias("key")), 3)


def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of supplier and customer keys found in the dictionary of part names or of each other."""
    keys = lambda n, c: table(spark, sf_dir, n).select(F.lit(n).alias("source"), t.norm_key(F.col(c), ascii_only=True).alias("key")).where("length(key) >= 2").distinct()
    every = keys("part", "p_name").unionByName(keys("supplier", "s_name")).unionByName(keys("customer", "c_name"))
    known = keys("part", "p_name").select("key", F.lit(1).alias("hit"))
    return every.join(known, "key", "left").groupBy("source").agg(F.count(F.lit(1)).alias("keys"), F.count("hit").alias("found"))


COVERAGE = "with k as (" + " union all ".join(f"select distinct '{n}' as source, regexp_replace(lower({c}), '[^0-9a-z]', '', 'g') as key from {n}" for n, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"))) + ") select source, count(*) as keys, count(*) filter (key in (select key from k where source = 'part')) as found from k where length(key) >= 2 group by 1"


def _asking(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 100 = 0")


def retrieve_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(v, _asking(v), 10).select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"), "rank")


COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform({0}, lambda z: z::double * z::double)) * list_sum(list_transform({1}, lambda z: z::double * z::double)))"
DENSE = "select query_id, vec_id, round(c, 5) as cosine, cast(rn as integer) as rank from (select *, row_number() over (partition by query_id order by round(c, 9) desc, vec_id) as rn from (select q.vec_id as query_id, v.vec_id, " + COS.format("q.embedding", "v.embedding") + " as c from embeddings q, embeddings v where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)) where rn <= 10"


def log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current mark of every image: the last click, by time and then arrival, however late it came."""
    m = table(spark, sf_dir, "tagging_marks").withColumn("ordinal", F.struct("ts", "mark_id"))
    return labels.latest(m, "image_name", "ordinal").select("image_name", "mark_id", "tag", "verdict")


LOG_LATEST = "select image_name, mark_id, tag, verdict from (select *, row_number() over (partition by image_name order by ts desc nulls last, mark_id desc) as rn from tagging_marks where image_name is not null) where rn = 1"


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_latest(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("tag").isNotNull() & (F.trim("tag") != "")).alias("tagged"))


REVIEW = f"select verdict, count(*) as images, count(*) filter (tag is not null and trim(tag) <> '') as tagged from ({LOG_LATEST}) group by 1"


def decisions_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth rows with the tags of the current marks put in, and what that changes."""
    truth = table(spark, sf_dir, "tagging_gt_v1").select("image_name", "tag", "eval_tag").distinct()
    d = log_latest(spark, sf_dir).select("image_name", F.when(F.trim("tag") != "", F.col("tag")).alias("new_tag"), F.when(F.col("verdict") == "non", "0").alias("new_eval"))
    return labels.apply_decisions(truth, d, "image_name").groupBy("eval_tag", "changed").agg(F.count(F.lit(1)).alias("records"))


DECISIONS = f"with l as ({LOG_LATEST}), t as (select distinct image_name, tag, eval_tag from tagging_gt_v1), j as (select t.tag, t.eval_tag, coalesce(case when trim(l.tag) <> '' then l.tag end, t.tag) as nt, coalesce(case when verdict = 'non' then '0' end, t.eval_tag) as ne from t left join l using (image_name)) select ne as eval_tag, (nt is distinct from tag or ne is distinct from eval_tag) as changed, count(*) as records from j group by 1, 2"


def suspicion_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "crop_manifest").select("annotation_id", "text", "w", "h").distinct()
    rules = [("thin", 2, F.col("w") < F.col("h") / 4), ("odd", 3, F.col("text").rlike("[^0-9A-Za-z가-힣 .,&-]")), ("long", 1, F.length("text") > 20), ("no box", 4, F.col("w").isNull() | F.col("h").isNull())]
    s = labels.scored(c, rules).where("suspicion > 0")
    return s.select("annotation_id", "suspicion", F.array_join("reasons", ",").alias("reasons"))


SUSPICION = r"""with c as (select distinct annotation_id, text, w, h from crop_manifest), s as (select annotation_id, coalesce(w < h / 4, false) as a, coalesce(regexp_matches(text, '[^0-9A-Za-z가-힣 .,&-]'), false) as b, coalesce(length(text) > 20, false) as c, (w is null or h is null) as d from c)
select annotation_id, cast(2 * a::int + 3 * b::int + c::int + 4 * d::int as integer) as suspicion, concat_ws(',', case when a then 'thin' end, case when b then 'odd' end, case when c then 'long' end, case when d then 'no box' end) as reasons from s where a or b or c or d
"""


def manifest_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged images nobody has marked yet, per region."""
    done = table(spark, sf_dir, "tagging_marks").select("image_name").where("image_name is not null").distinct()
    todo = table(spark, sf_dir, "tagging_gt_v1").select("image_name", "region").distinct()
    return todo.join(done, "image_name", "left_anti").groupBy("region").agg(F.count(F.lit(1)).alias("images"))


ANTI = "select region, count(*) as images from (select distinct image_name, region from tagging_gt_v1) t where not exists (select 1 from tagging_marks m where m.image_name = t.image_name) group by 1"


def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections joined to the tag truth of the sign they hit: found, missed and false, and how many carry a usable tag."""
    m = table(spark, sf_dir, "e2e_match_gangnam").distinct().withColumn("image_name", F.format_string("%s__crop_%03d", "photo", "gt_index"))
    tags = labels.latest(table(spark, sf_dir, "tagging_gt_v1").withColumn("o", F.struct("tag", "verdict", "name")), "image_name", "o").select("image_name", "tag", "eval_tag")
    j = m.join(tags, "image_name", "left")
    return j.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.count("tag").alias("with_tag"), F.count_if(F.col("eval_tag") == "1").alias("evaluated"), F.count_if(F.col("tag") == "unknown").alias("abstained"))


CASCADE = "with t as (select image_name, tag, eval_tag, row_number() over (partition by image_name order by tag desc nulls last, verdict desc nulls last, name desc nulls last) as rn from tagging_gt_v1), m as (select distinct * from e2e_match_gangnam) select status, count(*) as rows, count(tag) as with_tag, count(*) filter (eval_tag = '1') as evaluated, count(*) filter (tag = 'unknown') as abstained from m left join t on t.rn = 1 and t.image_name = m.photo || '__crop_' || lpad(cast(m.gt_index as varchar), 3, '0') group by 1"


def tag_eval_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current marks as predictions against the tag truth, by whether the true tag is in the list."""
    voc = table(spark, sf_dir, "tag_vocabulary").select(F.col("tag").alias("v"))
    truth = table(spark, sf_dir, "tagging_gt_v1").where("eval_tag = '1'").select("image_name", "tag").distinct()
    p = log_latest(spark, sf_dir).select("image_name", F.col("tag").alias("pred"))
    j = truth.join(p, "image_name", "left").join(voc, F.col("tag") == F.col("v"), "left")
    return j.groupBy(F.col("v").isNotNull().alias("in_list")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("pred") == F.col("tag")).alias("exact"),
        F.count_if(t.tag_key(F.col("pred")) == t.tag_key(F.col("tag"))).alias("same_key"),
        F.count_if(F.col("pred").isNull() | (F.col("pred") == "unknown")).alias("abstained"),
    )


TAG_EVAL = f"with l as ({LOG_LATEST}), t as (select distinct image_name, tag from tagging_gt_v1 where eval_tag = '1') select (v.tag is not null) as in_list, count(*) as records, count(*) filter (l.tag = t.tag) as exact, count(*) filter (split_part(l.tag, '=', 1) = split_part(t.tag, '=', 1)) as same_key, count(*) filter (l.tag is null or l.tag = 'unknown') as abstained from t left join l using (image_name) left join tag_vocabulary v on v.tag = t.tag group by 1"


def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each image from the log, its first and its last mark."""
    m = table(spark, sf_dir, "tagging_marks").where("image_name is not null")
    r = m.groupBy("image_name").agg(F.min_by("tag", "mark_id").alias("a"), F.max_by("tag", "mark_id").alias("b"))
    return r.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("identical"), F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("gained"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("lost"))


REPEAT = "with r as (select image_name, first(tag order by mark_id) as a, last(tag order by mark_id) as b from tagging_marks where image_name is not null group by 1) select count(*) as images, count(*) filter (a is not distinct from b) as identical, count(*) filter (a is null and b is not null) as gained, count(*) filter (a is not null and b is null) as lost from r"


def _split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "crop_manifest").withColumn("split", t.split_name(F.col("split")))
    return c.where("text is not null and split is not null").select("annotation_id", "text", "split").distinct()


def split_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand in more than one split, by the splits they stand in."""
    s = _split_texts(spark, sf_dir).groupBy("text").agg(F.array_join(F.sort_array(F.collect_set("split")), "+").alias("splits"))
    return s.groupBy("splits").agg(F.count(F.lit(1)).alias("texts"))


_NAME = "regexp_replace(lower(split), '[^a-z]', '', 'g')"
SPLIT_TEXTS = f"""with c as (select distinct annotation_id, text, case when {_NAME} in ('train', 'training', 'trn', 'tr') then 'train' when {_NAME} in ('val', 'valid', 'validation', 'dev', 'vld') then 'val' when {_NAME} in ('test', 'testing', 'tst') then 'test' end as split
  from crop_manifest where text is not null), v as (select * from c where split is not null)
"""
SPLITS = SPLIT_TEXTS + "select splits, count(*) as texts from (select text, string_agg(split, '+' order by split) as splits from (select distinct text, split from v) group by 1) group by 1"


def seen_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation crops by whether their text stands verbatim in training."""
    c = _split_texts(spark, sf_dir)
    seen = c.where("split = 'train'").select("text", F.lit(True).alias("seen")).distinct()
    e = c.where("split <> 'train'").join(seen, "text", "left")
    return e.groupBy("split", F.coalesce("seen", F.lit(False)).alias("seen")).agg(F.count(F.lit(1)).alias("crops"), F.count_distinct("text").alias("texts"))


SEEN = SPLIT_TEXTS + "select split, (text in (select text from v where split = 'train')) as seen, count(*) as crops, count(distinct text) as texts from v where split <> 'train' group by 1, 2"


def share_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged photos of a region that name the same sign, in groups."""
    d = table(spark, sf_dir, "tagging_gt_v1").where("region is not null and eval_name = '1'").select("region", F.regexp_replace("image_name", "__crop_[0-9]+$", "").alias("photo"), F.nullif(F.trim("name"), F.lit("")).alias("name"))
    return folds.shared_groups(d, "photo", "region", "name").select("region", "photo", "group_id")


SHARE = """with recursive d as (select distinct region, regexp_replace(image_name, '__crop_[0-9]+$', '') as photo, nullif(trim(name), '') as name from tagging_gt_v1 where region is not null and eval_name = '1' and image_name is not null),
e as (select distinct a.region, a.photo as a, b.photo as b from d a join d b on a.region = b.region and a.name = b.name),
r as (select region, photo as node, photo as reach from d union select r.region, r.node, e.b from r join e on e.region = r.region and e.a = r.reach)
select region, node as photo, min(reach) as group_id from r group by 1, 2
"""


def fold_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of the groups above: sizes, and names that would leak between folds (none)."""
    g = folds.assign_folds(share_components(spark, sf_dir), "region", 5)
    d = table(spark, sf_dir, "tagging_gt_v1").where("region is not null and eval_name = '1' and trim(name) <> ''").select("region", F.regexp_replace("image_name", "__crop_[0-9]+$", "").alias("photo"), F.trim("name").alias("name"))
    named = d.join(g, ["region", "photo"]).withColumn("content", F.concat_ws("\u0001", "region", "name"))
    leaked = folds.leaks(named, "content", "fold").select(F.split_part("content", F.lit("\u0001"), F.lit(1)).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("leaks"))
    per = g.groupBy("region", "fold").agg(F.count(F.lit(1)).alias("photos"), F.count_distinct("group_id").alias("groups"))
    return per.join(leaked, "region", "left").withColumn("leaks", F.coalesce("leaks", F.lit(0)))


def per_photo_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found and true signs per photo."""
    m = table(spark, sf_dir, "e2e_match_gangnam").distinct()
    p = m.groupBy("photo").agg(F.count_if(F.expr("status = 'TP'")).alias("tp"), F.count_if(F.expr("status <> 'FP'")).alias("truth"), F.count_if(F.expr("status = 'FP'")).alias("fp"))
    return p.select("photo", "tp", "truth", "fp", F.round(metrics.ratio(F.col("tp"), F.col("truth")), 6).alias("recall"))


PER_PHOTO = "select photo, count(*) filter (status = 'TP') as tp, count(*) filter (status <> 'FP') as truth, count(*) filter (status = 'FP') as fp, round(case when count(*) filter (status <> 'FP') > 0 then count(*) filter (status = 'TP') / count(*) filter (status <> 'FP') else 0 end, 6) as recall from (select distinct * from e2e_match_gangnam) group by 1"


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against precision over photos, with an interval."""
    p = per_photo_ratios(spark, sf_dir)
    return stats.paired_bootstrap(p.select("photo", F.col("tp").alias("num_a"), F.col("truth").alias("den_a"), F.col("tp").alias("num_b"), (F.col("tp") + F.col("fp")).alias("den_b")), "photo")


QUERIES = {f.__name__: f for f in (retrieve_lexical_topk, hint_lines, dict_merge_ranked, vocab_min_freq, vocab_min_freq_all, coverage_by_source, retrieve_dense_topk, log_latest, review_counts, decisions_apply, suspicion_queue, manifest_antijoin, cascade_counts, tag_eval_strata, repeatability, split_intersections, seen_unseen, share_components, fold_leak_audit, per_photo_ratios, bootstrap_ci)}
ORACLES = {
    "retrieve_lexical_topk": RETRIEVE, "hint_lines": HINTS, "dict_merge_ranked": DICT_MERGE, "vocab_min_freq": VOCAB, "coverage_by_source": COVERAGE, "retrieve_dense_topk": DENSE,
    "log_latest": LOG_LATEST, "review_counts": REVIEW, "decisions_apply": DECISIONS, "suspicion_queue": SUSPICION, "manifest_antijoin": ANTI,
    "cascade_counts": CASCADE, "tag_eval_strata": TAG_EVAL, "repeatability": REPEAT, "split_intersections": SPLITS, "seen_unseen": SEEN, "share_components": SHARE, "per_photo_ratios": PER_PHOTO,
}
