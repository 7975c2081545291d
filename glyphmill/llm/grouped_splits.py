"""Problem 1: splits that keep all records of one source photo together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.components import components
from glyphmill.operators.ranking import rank_in_groups
from glyphmill.operators.lineage import cut

#: Spellings of the three splits.
SPLIT_NAMES = {
    "train": "train", "training": "train", "trn": "train", "tr": "train",
    "val": "val", "valid": "val", "validation": "val", "dev": "val", "vld": "val",
    "test": "test", "testing": "test", "tst": "test",
}

#: Records up to which a subset-sum table covers all of them, and over that the records it may be asked to close.
TABLE_BITS = 1 << 22
GAP = TABLE_BITS // 8


def photo_number(c: Column) -> Column:
    """The number a photo id means: prefix, sign marks, thousands marks, leading zeros and a zero fraction set aside."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[\s,']", "")
    return F.regexp_extract(F.regexp_replace(t, r"\.0*$", ""), r"(?:^|[^0-9])0*([0-9]{1,18})$", 1).try_cast("bigint")


def photo_file(c: Column) -> Column:
    """The file a name means: folder, letter case, ending, query string and marks of a copy set aside; blank is null."""
    t = F.lower(F.trim(F.regexp_replace(c, r"\\", "/")))
    t = F.regexp_replace(t, r"[?#].*$", "")
    t = F.regexp_replace(t, r"^.*/", "")
    t = F.regexp_replace(t, r"\.(jpe?g|png|webp|bmp|tiff?|gif)$", "")
    t = F.regexp_replace(t, r"([ _-]*\(\d+\)|[ _-]+copy([ _-]*\(?\d+\)?)?|[ _-]+사본)+$", "")
    return F.nullif(F.trim(t), F.lit(""))


def split_name(c: Column) -> Column:
    """``train``, ``val`` or ``test`` for any of their spellings, else null."""
    key = F.regexp_replace(F.lower(c), r"[^a-z]", "")
    return F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])[key]


def photo_groups(records: DataFrame, id_col: str = "source_image_id", file_col: str = "source_image") -> tuple[DataFrame, DataFrame]:
    """``(keyed, groups)``: the records with ``_id``, ``_file`` and ``_node``, and ``(node, component)`` over all nodes.

    The graph has a node per photo number and one per file; a record that names both is an edge. Records that name
    neither have a null ``_node``: nothing ties them to another record, each is a group of its own.
    """
    keyed = records.withColumns({"_id": photo_number(F.col(id_col)), "_file": photo_file(F.col(file_col))})
    i, f = F.concat(F.lit("i"), F.col("_id").cast("string")), F.concat(F.lit("f"), F.col("_file"))
    keyed = keyed.withColumn("_node", F.coalesce(i, f))
    edges = keyed.select(F.coalesce(i, f).alias("a"), F.coalesce(f, i).alias("b")).where("a is not null").distinct()
    return keyed, components(edges)


def torn_photos(records: DataFrame, split_col: str = "split", id_col: str = "source_image_id", file_col: str = "source_image") -> DataFrame:
    """``(source_image_id)``: photo ids in groups whose records stand in two or three splits; null splits do not count."""
    raw = records.select(F.col(id_col), F.col(file_col), F.col(split_col)).distinct()  # spellings are few next to records
    keyed, groups = photo_groups(cut(raw), id_col, file_col)
    here = keyed.select("_node", "_id", split_name(F.col(split_col)).alias("s")).where("_node is not null").distinct()
    here = cut(here.join(groups, here._node == groups.node).select("component", "_id", "s"))
    torn = here.groupBy("component").agg(F.count_distinct("s").alias("n")).where("n > 1").select("component")
    return here.where("_id is not null").join(torn, "component", "left_semi").select(F.col("_id").alias("source_image_id")).distinct()


def _closest(sizes: dict[int, int], goal: int, unit: int = 1, over: bool = True) -> dict[int, int]:
    """How many groups of each size make up the reachable total closest to ``goal`` records, the smaller one on a tie.

    A bitset holds the totals reachable with some of the sizes (multiplicities in binary chunks), traced back from the
    chosen one. Sizes are rounded up to whole units; without ``over`` no total over the goal is taken.
    """
    goal //= unit
    room = (1 << (2 * goal + 2)) - 1
    items = []
    for size in sorted(sizes, reverse=True):
        n, k = sizes[size], 1
        while n > 0:
            take = min(k, n)
            items.append((size, take))
            n, k = n - take, k * 2
    reach = [1]
    for size, take in items:
        w = -(-size // unit) * take
        reach.append(reach[-1] if w > 2 * goal + 1 else (reach[-1] | (reach[-1] << w)) & room)
    last = reach[-1]
    at = (last & ((1 << (goal + 1)) - 1)).bit_length() - 1
    high = last >> goal
    if over and high:
        above = goal + (high & -high).bit_length() - 1
        at = at if goal - at <= above - goal else above
    chosen: dict[int, int] = {}
    for j in range(len(items) - 1, -1, -1):
        size, take = items[j]
        if reach[j] >> at & 1:
            continue
        chosen[size] = chosen.get(size, 0) + take
        at -= -(-size // unit) * take
    return chosen


def choose_counts(sizes: dict[int, int], targets: list[tuple[str, float]]) -> dict[str, dict[int, int]]:
    """How many groups of each size every split gets, by subset sums over the size multiplicities.

    ``sizes`` maps a group size to the number of such groups. The splits but the largest are filled in order of their
    share with the reachable total closest to the target; the largest split takes the rest. With ``total <= TABLE_BITS``
    the choice of each split is exact given the earlier ones. Over that, groups of many records are placed first in
    coarse units, never over the target, then smaller ones down to a gap of GAP records, which is closed by record.
    """
    if not targets:
        return {}
    total = sum(s * n for s, n in sizes.items())
    order = sorted(targets, key=lambda t: (-t[1], t[0]))
    rest, out = dict(sizes), {}
    for name, share in sorted(order[1:], key=lambda t: (t[1], t[0])):
        gap = round(share * total)
        chosen: dict[int, int] = {}

        def place(got: dict[int, int], chosen: dict[int, int] = chosen) -> int:
            for size, n in got.items():
                chosen[size] = chosen.get(size, 0) + n
                rest[size] -= n
            return sum(size * n for size, n in got.items())

        most = TABLE_BITS if total <= TABLE_BITS else GAP
        while gap > most:
            unit = -(-gap // GAP)
            taken = place(_closest({s: n for s, n in rest.items() if s >= 8 * unit}, gap, unit, over=False))
            gap -= taken
            if not taken:
                break
        for size in sorted(rest, reverse=True):
            if gap > most:
                gap -= place({size: min(rest[size], (gap - most // 2) // size)})
        place(_closest(rest, gap, max(1, -(-gap // most))))
        out[name] = {s: n for s, n in chosen.items() if n}
    out[order[0][0]] = {s: n for s, n in rest.items() if n}
    return out


def assign_splits(records: DataFrame, targets: DataFrame, id_col: str = "source_image_id", file_col: str = "source_image", record_col: str = "annotation_id", keep: tuple[str, ...] = ("split",)) -> DataFrame:
    """``(record_col, id_col, file_col, *keep, group_id, new_split)`` of every distinct record; a photo group has one split.

    ``targets`` is ``(split, share)``; without any, no record has a split and none is returned. Columns outside ``keep``
    are ignored. A record that names no photo groups with the rows of the same ``record_col`` (a
    null record id with no photo: with the equal rows). The size histogram that reaches the driver has at most
    ``sqrt(2 * records)`` entries. Groups of one size are interchangeable; they are told apart by a hash of their id,
    ranked in two levels so that no task holds all groups of a common size.
    """
    records = records.select(record_col, id_col, file_col, *[c for c in keep if c in records.columns])
    keyed, groups = photo_groups(records, id_col, file_col)
    keyed = keyed.distinct()
    lone = F.concat(F.lit("r"), F.coalesce(F.col(record_col).cast("string"), F.to_json(F.struct(*records.columns))))
    grouped = cut(
        keyed.join(groups, keyed._node == groups.node, "left")
        .withColumn("group_id", F.coalesce("component", lone))
        .drop("_id", "_file", "_node", "node", "component")
    )
    counted = cut(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("_size")))
    hist = {r["_size"]: r["n"] for r in counted.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    goal = [(r["split"], float(r["share"] or 0)) for r in targets.select("split", "share").where("split is not null").distinct().collect()]
    plan = choose_counts(hist, goal)
    ranked = rank_in_groups(counted, ["_size"], [F.xxhash64("group_id"), F.col("group_id")], "_rank")
    spans, spark = [], records.sparkSession
    for size in hist:
        start = 0
        for name, _ in goal:
            n = plan[name].get(size, 0)
            if n:
                spans.append((size, start, start + n, name))
            start += n
    span = spark.createDataFrame(spans, "s long, lo long, hi long, new_split string")
    chosen = ranked.join(span, (ranked._size == span.s) & (ranked._rank > span.lo) & (ranked._rank <= span.hi)).select("group_id", "new_split")
    return grouped.join(chosen, "group_id")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``(split, target_share, records, groups, share)`` for every split named in ``targets``."""
    n = assigned.groupBy("new_split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("group_id").alias("groups"))
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    t = targets.select("split", F.col("share").alias("target_share"))
    return (
        t.join(n, t.split == n.new_split, "left").crossJoin(F.broadcast(total))
        .select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"), F.when(F.col("total") > 0, F.coalesce("records", F.lit(0)) / F.col("total")).alias("share"))
    )
