"""ANSI SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from glyphmill.llm.lookalikes import LOOKALIKE_FROM

KEYED = r"""
with recursive k as (
  select distinct annotation_id, lower(trim(split)) as s,
    try_cast(regexp_extract(regexp_replace(replace(trim(source_image_id), ',', ''), '\.0*$', ''), '0*([0-9]+)$', 1) as bigint) as id,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(source_image, '\', '/')), '\?.*$', ''), '^.*/', ''), '\.(jpe?g|png)$', ''), '(_copy| \([0-9]+\))+$', '') as f
  from crop_manifest),
e as (select distinct id, nullif(f, '') as f from k where id is not null),
n as (select distinct a.id as a, b.id as b from e a join e b using (f)),
r as (select id as node, id as reach from e union select r.node, n.b from r join n on n.a = r.reach),
c as (select node, min(reach) as comp from r group by 1),
fc as (select e.f, min(c.comp) as comp from e join c on c.node = e.id where e.f is not null group by 1),
g as (select coalesce(c.comp, fc.comp) as comp, k.s from k left join c on c.node = k.id left join fc on fc.f = k.f),
t as (select comp from g where s in ('train', 'training', 'trn', 'val', 'valid', 'validation', 'test', 'testing', 'tst') and comp is not null
      group by 1 having count(distinct case when s like 'v%' then 'v' when s like 'tr%' then 'tr' else 'te' end) > 1)
"""

P1_FOUND = KEYED + "select node as source_image_id from c where comp in (select comp from t)"

ODD = "[\\x{00A0}\\x{00AD}\\x{0300}-\\x{036F}\\x{1100}-\\x{11FF}\\x{2000}-\\x{200F}\\x{202F}\\x{205F}-\\x{2064}\\x{212A}\\x{24B6}-\\x{24E9}\\x{3000}\\x{FB00}-\\x{FB06}\\x{FEFF}\\x{FF01}-\\x{FFEE}]"
ALIKE = f"[{LOOKALIKE_FROM}]"
MIXED = f"{ODD}|\\p{{Latin}}[\\p{{L}}\\p{{M}}]*{ALIKE}|{ALIKE}[\\p{{L}}\\p{{M}}]*\\p{{Latin}}"
P3_FOUND = f"""
select distinct 'ocr_gangnam_gt' as table_name, image_name from ocr_gangnam_gt where regexp_matches(replace(gt_text, '\\n', ' '), '{MIXED}')
union all select distinct 'tagging_gt_v1', image_name from tagging_gt_v1 where regexp_matches(name, '{MIXED}')
"""

ORACLES = {"p1_found": P1_FOUND, "p3_found": P3_FOUND}
