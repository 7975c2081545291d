"""Problem 6: map freely typed values to a reference list by a partition-based pigeonhole join. SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glyphmill.operators.lineage import cut

#: Lengths from which one and two slips are let pass; shorter words must match in full.
ONE_SLIP, TWO_SLIPS = 4, 6
#: A word of a name stands for a tag if it occurs with known tags at least LEAST_WORD times, SURE_WORD of them with this tag.
LEAST_WORD, SURE_WORD = 5, 0.6
#: A value stands for a tag if at least LEAST_VOTES of its records have names that do, and SURE_VOTES of all that vote.
LEAST_VOTES, SURE_VOTES = 4, 0.5

#: The distinct typed values and how each may be read: whole, behind the key, without an article, without "shop"; squeezed,
#: and without a plural s. ``own`` is the reading behind the key.
_READINGS = r"""
with typed as (
  select raw, plain,
         regexp_extract(plain, concat('^(?:', keys, ') ?(?:[^\\p{{L}}\\p{{N}}]+)(.*)$'), 1) as value_part
  from (
    select raw, regexp_replace(regexp_replace(translate(lower(raw), '＝_', '= '), '\\s+', ' '), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '') as plain
    from (select distinct {value} as raw from {records} where {value} is not null and trim({value}) <> '')
  ) cross join (select coalesce(array_join(collect_set(substring_index(tag, '=', 1)), '|'), '') as keys from {vocabulary})
)
select raw, translate(if(value_part <> '', value_part, plain), ' _-.''', '') as own,
  array_distinct(filter(flatten(transform(array(plain, value_part,
      regexp_replace(plain, '^(an?|the) ', ''), regexp_replace(value_part, '^(an?|the) ', ''),
      regexp_replace(plain, ' (shop|store)$', ''), regexp_replace(value_part, ' (shop|store)$', '')),
    s -> array(translate(s, ' _-.''', ''), regexp_replace(translate(s, ' _-.''', ''), '(?<=[a-z]{{3}})s$', '')))), s -> s <> '')) as readings
from typed
"""

#: The reference strings of the list: the value of the tag and its labels.
_LISTED = r"""
select distinct tag, translate(lower(r), ' _-.''', '') as r
from (select tag, explode(array(substring_index(tag, '=', -1), label, label_ko)) as r from {vocabulary} where tag is not null)
where length(translate(lower(r), ' _-.''', '')) > 0
"""

#: Other words for tags, learned from all records: the words of a name that go with one known tag vote for it, and a value
#: the list does not spell takes the tag that the names of its records vote for.
_LEARNED = r"""
with known as (
  select raw, min_by(tag, struct(-length(r), tag)) as tag from (select raw, explode(readings) as s from {readings}) join {listed} on s = r group by raw
), word as (
  select {key} as id, {value} as raw, explode(array_distinct(regexp_extract_all(lower({name}), '([\\p{{L}}\\p{{N}}]{{2,}})', 1))) as w
  from (select distinct {key}, {value}, {name} from {records} where trim({value}) <> '' and {name} is not null)
), uses as (
  select w, tag, count(*) as n from word join known using (raw) group by w, tag
), telling as (
  select w, max_by(tag, struct(n, tag)) as tag from uses group by w having max(n) >= {least_word} and max(n) >= {sure_word} * sum(n)
), vote as (
  select distinct id, own, tag from word join telling using (w) join {readings} using (raw) left anti join known using (raw)
)
select max_by(tag, struct(n, tag)) as tag, own as r from (select own, tag, count(*) as n from vote where own <> '' group by own, tag)
group by own having max(n) >= {least_votes} and max(n) > {sure_votes} * sum(n)
"""

_MAP = r"""
with ref as (
  select tag, r, length(r) as n, case when length(r) >= {two} then 4 when length(r) >= {one} then 2 else 0 end as k from {refs}
), segment as (  -- k + 1 pieces of even length: k single-character edits leave one of them whole, at most k places off
  select tag, r, k, explode(sequence(greatest(at - k, 1), at + k)) as at, n, seg from (
    select tag, r, k, at, explode(sequence(n - k, n + k)) as n, seg from (
      select tag, r, n, k, div(i * n, k + 1) + 1 as at, substring(r, div(i * n, k + 1) + 1, div((i + 1) * n, k + 1) - div(i * n, k + 1)) as seg
      from ref lateral view explode(sequence(0, k)) as i))
), reading as (
  select raw, explode(readings) as s from {readings}
), named as (  -- readings that are a reference string to the letter need no search
  select raw, min_by(tag, struct(-length(s), tag)) as tag from reading join ref on s = r group by raw
), spoken as (
  select /*+ REPARTITION({tasks}, s) */ raw, s from reading left anti join named using (raw)
), probe as (
  select s, length(s) as n, at, substring(s, at, w) as seg
  from (select distinct s from spoken where length(s) <= (select coalesce(max(n + k), 0) from ref)) x
  join (select distinct length(seg) as w from segment) on length(s) >= w
  lateral view explode(sequence(1, length(s) - w + 1)) as at
), candidate as (
  select distinct s, tag, r, k from probe join segment using (seg, at, n)
), measured as (  -- bag: letters that one side has more of than the other, so a swapped pair costs 2 edits and no letter
  select s, tag, k, edits, greatest(
    aggregate(array_distinct(split(s, '')), 0, (a, c) -> a + greatest(length(s) - length(replace(s, c, '')) - length(r) + length(replace(r, c, '')), 0)),
    aggregate(array_distinct(split(r, '')), 0, (a, c) -> a + greatest(length(r) - length(replace(r, c, '')) - length(s) + length(replace(s, c, '')), 0))) as bag
  from (select s, tag, r, k, levenshtein(s, r, k) as edits from candidate) where edits >= 0
), kept as (
  select s, tag, edits from measured
  where edits <= k div 2 or (edits <= k div 2 + 1 and bag <= k div 2 - 1) or (edits <= k and bag <= k div 2 - 2)
), mapped as (
  select raw, min_by(tag, struct(edits, -length(s), tag)) as tag from spoken join kept using (s) group by raw
  union all select raw, tag from named
), literal as (
  select raw, raw as tag from {readings} left semi join {vocabulary} v on raw = v.tag
)
select raw as typed_value, tag as mapped_tag from literal
union all select raw, tag from mapped left anti join literal using (raw)
union all select raw, 'unmatched' from {readings} left anti join mapped using (raw) left anti join literal using (raw)
"""


def value_map(records: DataFrame, vocabulary: DataFrame, value: str = "tag", key: str = "image_name", name: str = "name") -> DataFrame:
    """``(typed_value, mapped_tag)``: one row per distinct non-blank value of ``value``.

    A value is mapped to the entry of ``vocabulary (tag, label, label_ko)`` whose value or label it spells, letter case,
    blanks, brackets, articles and key set aside, with at most one slip from four characters on and two from six on (a
    slip: a character added, lost, replaced, or two neighbours swapped). The reference strings are cut into k+1 segments
    that are joined for equality with the positional substrings of the typed values (segment, place and length are the
    key); candidates are verified with ``levenshtein``. What the anti-join leaves is ``unmatched``. On a tie the fewest
    edits, then the longest reading, then the first tag win. Null and blank values are left out; an empty vocabulary
    leaves all unmatched.

    If the records have a ``name``, other words for a tag are learned from them: the words of a name that go with one
    known tag vote for it, and a value of at least LEAST_VOTES voting records takes the tag that most of them name. A word
    learned so is a reference string like the others, slips of it included. Only distinct values are compared, so a value
    held by a third of all rows costs one comparison.
    """
    spark = records.sparkSession
    named = lambda text: text.replace("{value}", f"`{value}`").replace("{key}", f"`{key}`").replace("{name}", f"`{name}`")
    readings = cut(spark.sql(named(_READINGS), records=records, vocabulary=vocabulary))
    listed = cut(spark.sql(_LISTED, vocabulary=vocabulary))
    refs = listed
    if {key, name} <= set(records.columns):
        more = spark.sql(named(_LEARNED), records=records, readings=readings, listed=listed, least_word=LEAST_WORD, sure_word=SURE_WORD, least_votes=LEAST_VOTES, sure_votes=SURE_VOTES)
        refs = cut(listed.unionByName(more).distinct())
    return spark.sql(_MAP, vocabulary=vocabulary, refs=refs, readings=readings, one=ONE_SLIP, two=TWO_SLIPS, tasks=max(8, spark.sparkContext.defaultParallelism))


def mapped_records(records: DataFrame, vocabulary: DataFrame, key: str = "image_name", value: str = "tag") -> DataFrame:
    """``(key, mapped_tag)`` for records whose value is not null, blank, ``unknown`` or literally in the list; each once."""
    sql = """
    select distinct r.`{key}`, m.mapped_tag
    from {records} r join {m} m on r.`{value}` = m.typed_value
    left anti join {vocabulary} v on r.`{value}` = v.tag
    where r.`{value}` <> 'unknown'
    """
    sql = sql.replace("{key}", key).replace("{value}", value)
    return records.sparkSession.sql(sql, records=records, m=value_map(records, vocabulary, value, key), vocabulary=vocabulary)


def unmatched_values(records: DataFrame, vocabulary: DataFrame, value: str = "tag") -> DataFrame:
    """``(typed_value, records)``: the values that no entry takes and how many records hold each."""
    sql = """
    select m.typed_value, count(*) as records from {records} r join {m} m on r.`{value}` = m.typed_value
    where m.mapped_tag = 'unmatched' and m.typed_value <> 'unknown' group by m.typed_value
    """.replace("{value}", value)
    return records.sparkSession.sql(sql, records=records, m=value_map(records, vocabulary, value))
