"""Queries over text: lines, keys, distances, rules, votes, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import matching, metrics
from glyphmill.sources.tables import table

#: Keyword rules, first match wins, and tag synonyms.
RULES = [("steel", "material=steel"), ("copper", "material=copper"), ("green", "colour=green"), ("blue", "colour=blue"), ("large", "size=large"), ("small", "size=small")]
SYNONYMS = {"click": "action=press", "view": "action=look", "signup": "action=join"}


def split_lines_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = table(spark, sf_dir, "ocr_gangnam_gt").where("gt_text is not null").distinct()
    lines = t.split_lines(F.col("gt_text"))
    d = gt.select(F.size(lines).alias("lines"), F.size(t.readable_lines(F.col("gt_text"))).alias("readable"))
    return d.groupBy("lines", "readable").agg(F.count(F.lit(1)).alias("cells"))


SPLIT_LINES_STATS = r"""
with c as (select distinct image_name, gt_text from ocr_gangnam_gt where gt_text is not null),
u as (select image_name, gt_text, trim(replace(replace(replace(gt_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n', chr(10))) as x from c),
l as (select image_name, gt_text, list_filter(list_transform(case when contains(x, '|') then string_split(x, '|') else string_split(x, chr(10)) end, lambda s: trim(regexp_replace(s, '^\s+|\s+$', '', 'g'))), lambda s: s <> '') as ls from u)
select cast(len(ls) as integer) as lines, cast(len(list_filter(ls, lambda s: s <> '###')) as integer) as readable, count(*) as cells from l group by 1, 2
"""


def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all part, supplier and customer names and how many 2-grams they have."""
    names = [table(spark, sf_dir, n).select(F.lit(n).alias("source"), t.norm_key(F.col(c)).alias("key")) for n, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"))]
    d = names[0].unionByName(names[1]).unionByName(names[2])
    return d.select("source", "key", F.size(t.bigrams(F.col("key"))).alias("grams")).groupBy("source", "key", "grams").agg(F.count(F.lit(1)).alias("records"))


NORM_KEYS = "with k as (" + " union all ".join(f"select '{n}' as source, regexp_replace(lower({c}), '[^0-9a-z가-힣]', '', 'g') as key from {n}" for n, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"))) + """)
select source, key, cast(case when length(key) >= 2 then len(list_distinct(list_transform(range(1, length(key)), lambda i: substr(key, i, 2)))) else length(key) end as integer) as grams, count(*) as records
from k group by 1, 2, 3
"""


def norm_keys_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all tagged names, in any script; SQL has no NFKC, so there is no oracle."""
    k = t.norm_key(F.col("name"))
    d = table(spark, sf_dir, "tagging_gt_v1").where("name is not null").select("region", k.alias("key"))
    return d.select("region", "key", F.size(t.bigrams(F.col("key"))).alias("grams")).groupBy("region", "key", "grams").agg(F.count(F.lit(1)).alias("records"))


def _engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as lines read by three engines with fixed corruptions."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("truth"))
    k = F.col("p_partkey")
    a = F.when(k % 3 == 0, F.regexp_replace("truth", "e", "c")).otherwise(F.col("truth"))
    b = F.when(k % 5 == 0, F.substring("truth", 2, 100)).otherwise(F.col("truth"))
    c = F.when(k % 7 < 3, F.upper("truth")).when(k % 7 == 3, F.regexp_replace("truth", "[aeiou]", "")).otherwise(F.col("truth"))
    return p.select("p_partkey", "truth", F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), x.alias("pred")) for n, x in (("e1", a), ("e2", b), ("e3", c))])).alias("r")).select("p_partkey", "truth", "r.engine", "r.pred")


ENGINES = """
with p as (select p_partkey, p_name as truth from part),
r as (
  select p_partkey, truth, 'e1' as engine, case when p_partkey % 3 = 0 then replace(truth, 'e', 'c') else truth end as pred from p
  union all select p_partkey, truth, 'e2', case when p_partkey % 5 = 0 then substr(truth, 2, 100) else truth end from p
  union all select p_partkey, truth, 'e3', case when p_partkey % 7 < 3 then upper(truth) when p_partkey % 7 = 3 then regexp_replace(truth, '[aeiou]', '', 'g') else truth end from p)
"""


def oracle_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_engine(_engines(spark, sf_dir), ["p_partkey"]).groupBy("engine").agg(F.count(F.lit(1)).alias("lines"), F.sum("edits").alias("edits"))


ORACLE_ENGINE = ENGINES + """, m as (select p_partkey, engine, levenshtein(truth, pred) as e, row_number() over (partition by p_partkey order by levenshtein(truth, pred) / greatest(length(truth), 1), engine) as rn from r)
select engine, count(*) as lines, cast(sum(e) as bigint) as edits from m where rn = 1 group by 1
"""


def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = matching.majority(_engines(spark, sf_dir), ["p_partkey"], "pred", t.norm_key(F.col("pred"), ascii_only=True), "engine")
    return v.select("p_partkey", "text", "votes")


VOTE_MAJORITY = ENGINES + """, n as (select *, regexp_replace(lower(pred), '[^0-9a-z]', '', 'g') as k from r),
g as (select p_partkey, k, count(*) as votes, min(engine) as e, arg_min(pred, engine) as text from n group by 1, 2),
o as (select *, row_number() over (partition by p_partkey order by case when k <> '' and votes >= 2 then votes else 0 end desc, e) as rn from g)
select p_partkey, text, votes from o where rn = 1
"""


def pairs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.line_scores(_engines(spark, sf_dir), ["engine"])
    return s.select("engine", "lines", "exact", "letters", "edits", "letters_1", F.round("cer", 6).alias("cer"), F.round("exact_rate", 6).alias("exact_rate"))


PAIRS_SCORE = ENGINES + """
select engine, count(*) as lines, cast(count(*) filter (truth = pred and truth <> '') as bigint) as exact, cast(sum(length(truth)) as bigint) as letters,
  cast(sum(levenshtein(truth, pred)) as bigint) as edits, cast(sum(greatest(length(truth), 1)) as bigint) as letters_1,
  round(sum(levenshtein(truth, pred)) / sum(length(truth)), 6) as cer, round(count(*) filter (truth = pred and truth <> '') / count(*), 6) as exact_rate
from r group by 1
"""


def cer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error per engine and brand and over all brands, by grouping sets."""
    r = _engines(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    r = r.withColumn("e", F.levenshtein("truth", "pred")).withColumn("n", F.length("truth"))
    r = r.groupingSets([["engine", "p_brand"], ["engine"]], "engine", "p_brand").agg(F.sum("e").alias("edits"), F.sum("n").alias("letters"))
    return r.select("engine", F.coalesce("p_brand", F.lit("ALL")).alias("brand"), "edits", "letters", F.round(metrics.ratio(F.col("edits"), F.col("letters")), 6).alias("cer"))


CER_ROLLUP = ENGINES + """
select engine, coalesce(p_brand, 'ALL') as brand, cast(sum(levenshtein(truth, pred)) as bigint) as edits, cast(sum(length(truth)) as bigint) as letters,
  round(sum(levenshtein(truth, pred)) / sum(length(truth)), 6) as cer
from r join part using (p_partkey) group by grouping sets ((engine, p_brand), (engine))
"""


def infix_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("kind")).distinct().where("length(kind) > 0")
    truth = F.lower("kind")
    return p.select("text", truth.alias("truth"), t.lev_infix(F.lower("text"), truth).alias("edits"))


INFIX_DISTANCE = """
with p as (select distinct p_name as text, lower(p_type) as truth, p_type from part where length(p_type) > 0),
s as (select text, truth, p_type, unnest(list_concat([''], flatten(list_transform(range(1, length(text) + 1), lambda i: list_transform(range(1, length(text) - i + 2), lambda n: substr(lower(text), i, n)))))) as sub from p)
select text, truth, cast(min(levenshtein(sub, truth)) as integer) as edits from s group by text, truth, p_type
"""


def lcs_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in order that the sign text and the tagged name of a crop share, and the word edits between them."""
    gt = table(spark, sf_dir, "ocr_gangnam_gt").where("gt_text is not null").distinct()
    tags = table(spark, sf_dir, "tagging_gt_v1").where("name is not null").select("image_name", "name").distinct()
    j = gt.join(tags, "image_name").select("image_name", t.norm_words(F.col("gt_text")).alias("a"), t.norm_words(F.col("name")).alias("b"))
    return j.select("image_name", t.lcs_len(F.col("a"), F.col("b")).alias("common"), t.lev_tokens(F.col("a"), F.col("b")).alias("word_edits"))


def line_exact_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sign texts that also stand in the tagged name of the crop."""
    gt = table(spark, sf_dir, "ocr_gangnam_gt").distinct().select("image_name", F.explode(t.split_lines(F.col("gt_text"))).alias("text"))
    tags = table(spark, sf_dir, "tagging_gt_v1").select("image_name", F.trim("name").alias("text")).where("text <> ''").distinct()
    return matching.match_exact(gt, tags, "image_name").groupBy("image_name").agg(F.sum("n").alias("equal_lines"))


LINE_EXACT = r"""
with c as (select distinct image_name, gt_text from ocr_gangnam_gt where gt_text is not null),
u as (select image_name, trim(replace(replace(replace(gt_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n', chr(10))) as x from c),
l as (select image_name, unnest(list_filter(list_transform(case when contains(x, '|') then string_split(x, '|') else string_split(x, chr(10)) end, lambda s: trim(regexp_replace(s, '^\s+|\s+$', '', 'g'))), lambda s: s <> '')) as text from u),
a as (select image_name, text, count(*) as n from l group by 1, 2),
b as (select distinct image_name, trim(name) as text from tagging_gt_v1 where trim(name) <> '')
select image_name, cast(sum(least(a.n, 1)) as bigint) as equal_lines from a join b using (image_name, text) group by 1
"""


def rule_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(t.map_tag(F.col("p_name"), RULES, lower=True).alias("tag"), t.matched_word(F.col("p_name"), RULES).alias("word")).groupBy("tag", "word").agg(F.count(F.lit(1)).alias("parts"))


RULE_TAG = "select tag, word, count(*) as parts from (select case " + " ".join(f"when contains(lower(p_name), '{w}') then '{g}'" for w, g in RULES) + " else '' end as tag, case " + " ".join(f"when contains(lower(p_name), '{w}') then '{w}'" for w, g in RULES) + " else '' end as word from part) group by 1, 2"


def canon_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(t.canon(F.col("event_type"), SYNONYMS).alias("tag"))
    return e.groupBy("tag", t.tag_key(F.col("tag")).alias("tag_key")).agg(F.count(F.lit(1)).alias("events"))


CANON_TAG = "select tag, split_part(tag, '=', 1) as tag_key, count(*) as events from (select case " + " ".join(f"when event_type = '{a}' then '{b}'" for a, b in SYNONYMS.items()) + " else lower(replace(event_type, ' ', '')) end as tag from events) group by 1, 2"


def json_parse_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with prose around the object; every seventh is broken."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("sorry "), F.substring("props", 1, 4))).otherwise(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done"))).alias("reply"))
    return e.select("event_id", F.coalesce(t.json_object(F.col("reply"), "k int")["k"], F.lit(-1)).alias("k"))


JSON_PARSE = "select event_id, case when event_id % 7 = 0 then -1 else cast(json_extract(props, '$.k') as integer) end as k from events"


def charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of crop texts with the number of texts that hold them."""
    c = table(spark, sf_dir, "crop_manifest").select(F.explode(F.array_distinct(F.filter(F.split("text", ""), lambda x: x != ""))).alias("letter"))
    return c.groupBy("letter").agg(F.count(F.lit(1)).alias("texts"))


CHARSET = "select letter, count(*) as texts from (select unnest(list_distinct(string_split(text, ''))) as letter from crop_manifest) where letter <> '' group by 1"


def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why crops are turned away, the first reason that holds."""
    from glyphmill.operators.labels import admitted

    c = table(spark, sf_dir, "crop_manifest")
    rules = [
        ("no class", F.col("class").isNull()),
        ("empty text", F.length(F.trim("text")) == 0),
        ("too long", F.length(F.trim("text")) > 25),
        ("bad box", (F.col("w") <= 0) | (F.col("h") <= 0)),
        ("too small", F.least("w", "h") < 12),
    ]
    return admitted(c, rules).groupBy("reason").agg(F.count(F.lit(1)).alias("crops"))


ADMISSION = """
select case when class is null then 'no class' when coalesce(length(trim(text)) = 0, true) then 'empty text' when length(trim(text)) > 25 then 'too long'
  when coalesce(w <= 0 or h <= 0, true) then 'bad box' when least(w, h) < 12 then 'too small' else 'ok' end as reason, count(*) as crops from crop_manifest group by 1
"""


def crop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop keys in natural order: photo, running number, and the name made again from both."""
    d = table(spark, sf_dir, "tagging_gt_v1").select("image_name").distinct()
    n = t.trailing_number(F.col("image_name"))
    photo = F.regexp_replace("image_name", "__crop_[0-9]+$", "")
    return d.select("image_name", photo.alias("photo"), n.alias("crop"), t.crop_name(photo, n).alias("again"), t.safe_stem(F.col("image_name")).alias("stem"))


CROP_KEYS = r"""
select image_name, regexp_replace(image_name, '__crop_[0-9]+$', '') as photo, cast(regexp_extract(image_name, '([0-9]+)$', 1) as bigint) as crop,
  regexp_replace(image_name, '__crop_[0-9]+$', '') || '__crop_' || lpad(regexp_extract(image_name, '([0-9]+)$', 1), 3, '0') as again, substr(image_name, 1, 32) as stem
from (select distinct image_name from tagging_gt_v1)
"""

QUERIES = {f.__name__: f for f in (split_lines_stats, norm_keys, norm_keys_all, oracle_engine, vote_majority, pairs_score, cer_rollup, infix_distance, lcs_words, line_exact_multiset, rule_tag, canon_tag, json_parse_fallback, charset, admission_reasons, crop_keys)}
ORACLES = {
    "split_lines_stats": SPLIT_LINES_STATS, "norm_keys": NORM_KEYS, "oracle_engine": ORACLE_ENGINE, "vote_majority": VOTE_MAJORITY, "pairs_score": PAIRS_SCORE,
    "cer_rollup": CER_ROLLUP, "infix_distance": INFIX_DISTANCE, "line_exact_multiset": LINE_EXACT, "rule_tag": RULE_TAG, "canon_tag": CANON_TAG,
    "json_parse_fallback": JSON_PARSE, "charset": CHARSET, "admission_reasons": ADMISSION, "crop_keys": CROP_KEYS,
}
