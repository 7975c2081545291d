"""Greedy assignment, suppression, grouping and voting as rounds of joins. Only boxes are matched and words put in rows with
whole photos in a task, up to a number of boxes that is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from glyphmill.functions import geometry as g
from glyphmill.functions.text import lev_infix
from glyphmill.operators import whole
from glyphmill.operators.lineage import cut, release

#: Boxes of a photo that one task may hold, some 850 MB.
FEW_BOXES = 1 << 20
#: Largest side of the predictions in the smallest tiles of a larger photo, which are four times as wide; further sizes double.
SIDE = 128.0


def overlap_join(a: DataFrame, b: DataFrame, key: str, cell: float = 256.0) -> DataFrame:
    """``(key, a, b, iou)`` of the overlapping boxes of ``a (key, a, box)`` and ``b (key, b, box)``.

    Boxes meet in the grid cells that both cover and a pair is kept in the cell of the upper left corner of its
    intersection, so a photo with very many boxes is spread over its cells and no pair comes twice. Boxes without area
    or with a null meet none.
    """

    def cells(df: DataFrame, i: str) -> DataFrame:
        d = df.select(key, i, F.col("box").alias(f"_{i}")).where(g.area(F.col("box")) > 0)
        c = F.col(f"_{i}")
        span = lambda lo, hi: F.sequence(F.floor(c[lo] / cell), F.floor(c[hi] / cell))
        return d.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))

    j = cells(a, "a").join(cells(b, "b"), [key, "_cx", "_cy"])
    here = (F.floor(F.greatest(F.col("_a.x0"), F.col("_b.x0")) / cell) == F.col("_cx")) & (F.floor(F.greatest(F.col("_a.y0"), F.col("_b.y0")) / cell) == F.col("_cy"))
    return j.where(here & (g.intersection(F.col("_a"), F.col("_b")) > 0)).select(key, "a", "b", g.iou(F.col("_a"), F.col("_b")).alias("iou"))


def greedy_match(pairs: DataFrame, key: list[str], order: list[Column], most_rounds: int = 1000) -> DataFrame:
    """The rows of ``pairs (*key, a, b, ..)`` that greedy assignment in ``order`` takes; each a and b of a key once.

    A round takes the pairs that come first for both their ends and drops what those ends still have; this yields the
    same set as one pass over all pairs in order, for any total order (ties are broken by a, then b). Pairs that are alone
    at both ends are taken before the first round. More than ``most_rounds`` rounds raise an error.
    """
    rank = F.struct(*order, F.col("a"), F.col("b"))
    left = pairs.withColumn("_o", rank)
    taken = None
    for _ in range(most_rounds):
        first_a = left.groupBy(*key, "a").agg(F.min("_o").alias("_fa"))
        first_b = left.groupBy(*key, "b").agg(F.min("_o").alias("_fb"))
        both = left.join(first_a, [*key, "a"]).join(first_b, [*key, "b"])
        both = cut(both.withColumn("_got", (F.col("_o") == F.col("_fa")) & (F.col("_o") == F.col("_fb"))).drop("_fa", "_fb"))
        got = both.where("_got").drop("_got")
        if got.isEmpty():
            return (got if taken is None else taken).drop("_o").select(*pairs.columns)
        taken = got if taken is None else taken.unionByName(got)
        left = both.where("not _got").drop("_got").join(got.select(*key, "a"), [*key, "a"], "left_anti").join(got.select(*key, "b"), [*key, "b"], "left_anti")
    raise RuntimeError(f"pairs are left after {most_rounds} rounds")


def suppress(boxes: DataFrame, key: str, order: list[Column], threshold: float, strict: bool = True, most_rounds: int = 1000) -> DataFrame:
    """Boxes ``(key, id, box, ..)`` that survive suppression in ``order``: a box goes if one kept before it overlaps by
    more than ``threshold`` (``strict``) or by at least it. Rounds: a box with no undecided box before it is kept. More
    than ``most_rounds`` rounds raise an error."""
    ranked = boxes.select(key, F.col("id"), "box", F.struct(*order, F.col("id")).alias("o"))
    a, b = ranked.select(key, F.struct("id", "o").alias("a"), "box"), ranked.select(key, F.struct("id", "o").alias("b"), "box")
    over = F.col("iou") > threshold if strict else F.col("iou") >= threshold
    edge = cut(overlap_join(a, b, key).where(over & (F.col("a.o") < F.col("b.o"))).select(key, F.col("a.id").alias("hi"), F.col("b.id").alias("lo")))
    gone = None
    for n in range(most_rounds + 1):
        if edge.isEmpty():
            break
        if n == most_rounds:
            raise RuntimeError(f"boxes are undecided after {most_rounds} rounds")
        kept = edge.select(key, F.col("hi").alias("id")).distinct().join(edge.select(key, F.col("lo").alias("id")).distinct(), [key, "id"], "left_anti")
        dead = cut(edge.join(kept.withColumnRenamed("id", "hi"), [key, "hi"], "left_semi").select(key, F.col("lo").alias("id")).distinct())
        gone = dead if gone is None else gone.unionByName(dead)
        edge = edge.join(dead.withColumnRenamed("id", "lo"), [key, "lo"], "left_anti")
        edge = cut(edge.join(dead.withColumnRenamed("id", "hi"), [key, "hi"], "left_anti"))
    return boxes if gone is None else boxes.join(gone.distinct(), [key, "id"], "left_anti")


def match_boxes(pred: DataFrame, truth: DataFrame, key: str, threshold: float = 0.5, few: int = FEW_BOXES) -> DataFrame:
    """``(key, a, b, iou, conf, status)``: TP, FP and FN rows; predictions by falling ``conf`` take the best free truth.

    ``pred (key, a, box, conf)``, ``truth (key, b, box)``. FP rows have a null ``b`` and the best IoU with a truth that was
    free at their turn, FN rows a null ``a`` and ``conf``. Photos of up to ``few`` boxes are settled whole in Arrow
    batches, larger ones in rounds over tiles; neither writes their pairs.
    """
    kind, known = dict(truth.dtypes)["b"], dict(pred.dtypes)["a"]
    sides = [F.col("box")[c].alias(c) for c in whole.SIDES]
    rows = pred.select(key, "a", F.lit(None).cast(kind).alias("b"), *sides, F.col("conf").cast("double").alias("conf"), F.lit(True).alias("pred"))
    rows = rows.unionByName(truth.select(key, F.lit(None).cast(known).alias("a"), "b", *sides, F.lit(None).cast("double").alias("conf"), F.lit(False).alias("pred")))
    many = cut(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select(key))
    large = not many.isEmpty()
    if large:
        rows = rows.join(many, key, "left_anti")
    out = StructType([StructField(c, rows.schema[c].dataType) for c in (key, "a", "b")] + [StructField("iou", DoubleType()), StructField("conf", DoubleType()), StructField("status", StringType())])
    done = rows.repartition(key).sortWithinPartitions(key).mapInArrow(whole.matcher([key], threshold), out)
    return done.unionByName(_match_in_tiles(pred.join(many, key, "left_semi"), truth.join(many, key, "left_semi"), key, threshold)) if large else done


def _match_in_tiles(pred: DataFrame, truth: DataFrame, key: str, threshold: float, most_rounds: int = 1000) -> DataFrame:
    """``match_boxes`` of photos that no task holds, without a table of their pairs.

    A prediction lies in one tile of its photo, by its size and upper left corner; a truth comes to all tiles with
    predictions that may overlap it. In a round those that have no truth ask for the best one that no earlier turn has
    asked for, in turn inside a tile, and a truth keeps the earliest that asked; who loses it asks again. All truths prefer
    the same turns, so this ends in the one stable assignment, that of one pass in order, whatever asks first. More than
    ``most_rounds`` rounds raise an error.
    """
    pred, truth = cut(pred.withColumn("conf", F.col("conf").cast("double"))), cut(truth)
    kind, known = dict(truth.dtypes)["b"], dict(pred.dtypes)["a"]
    sides = [F.col("box")[c].alias(c) for c in whole.SIDES]
    wide = lambda hi, lo: (F.col(hi) - F.col(lo) > 0) & (F.col(hi) - F.col(lo) < float("inf"))
    usable = wide("x1", "x0") & wide("y1", "y0")
    own = Window.partitionBy(key, "a")  # a prediction with several boxes is in one tile with all of them
    p = pred.where(F.col("a").isNotNull()).select(key, "a", *sides, "conf").where(usable)
    p = p.withColumns({"_l": F.min("x0").over(own), "_t": F.min("y0").over(own), "_r": F.max("x1").over(own), "_d": F.max("y1").over(own)})
    p = p.withColumn("_k", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("_r") - F.col("_l"), F.col("_d") - F.col("_t")) * 1.01 / SIDE)).cast("int")))
    size = F.pow(F.lit(2.0), F.col("_k")) * SIDE
    tile = [key, "_k", "_x", "_y"]
    placed = cut(p.select(key, "_k", F.floor(F.col("_l") / (size * 4)).alias("_x"), F.floor(F.col("_t") / (size * 4)).alias("_y"), "a", *whole.SIDES, "conf"))
    truths = cut(truth.where(F.col("b").isNotNull()).select(key, "b", *sides).where(usable))
    claim = StructType([StructField(key, placed.schema[key].dataType), placed.schema["a"], truths.schema["b"], StructField("iou", DoubleType()), StructField("conf", DoubleType()), StructField("status", StringType())])
    parts = int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tiles(some: DataFrame, held: DataFrame | None, least: float, only: str) -> DataFrame:
        """``greedy`` for ``some`` of the predictions, a tile at a time, with the truths as they are held."""
        span = some.groupBy(key, "_k").agg(*[f(c).alias(f"{c}_{n}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))])
        t = truths.withColumns({"a": F.lit(None).cast(known), "conf": F.lit(None).cast("double")}) if held is None else truths.join(held.select(key, "b", "a", "conf"), [key, "b"], "left")
        t = t.join(F.broadcast(span), key)  # a row for a large photo and size
        for d in ("x", "y"):
            t = t.withColumns({"_lo": F.greatest(F.floor((F.col(f"{d}0") - size) / (size * 4)), F.col(f"_{d}_lo")), "_hi": F.least(F.floor(F.col(f"{d}1") / (size * 4)), F.col(f"_{d}_hi"))})
            t = t.where("_lo <= _hi").withColumn(f"_{d}", F.explode(F.sequence("_lo", "_hi")))
        t = t.join(some.select(tile).distinct(), tile, "left_semi").select(*tile, "a", "b", *whole.SIDES, "conf", F.lit(False).alias("pred"))
        rows = some.select(*tile, "a", F.lit(None).cast(kind).alias("b"), *whole.SIDES, "conf", F.lit(True).alias("pred")).unionByName(t)
        return rows.repartition(parts, *tile).sortWithinPartitions(*tile).mapInArrow(whole.matcher(tile, least, only), claim)

    asking, tp = placed, None
    for _ in range(most_rounds):
        asks = tiles(asking, tp, threshold, "TP")
        turn = F.struct(-F.col("conf"), F.col("a"))
        claims = asks if tp is None else tp.unionByName(asks)
        claims = cut(claims.withColumn("_kept", turn == F.min(turn).over(Window.partitionBy(key, "b"))))
        tp, lost = claims.where("_kept").drop("_kept"), claims.where("not _kept").select(key, "a")
        asking = cut(placed.join(lost, [key, "a"], "left_semi"))
        release(pred.sparkSession)
        if asking.isEmpty():
            break
    else:
        raise RuntimeError(f"boxes are left after {most_rounds} rounds")
    best = tiles(placed.join(tp.select(key, "a"), [key, "a"], "left_anti"), tp, float("inf"), "FP").groupBy(key, "a").agg(F.max("iou").alias("iou"))
    rest = pred.join(tp.select(key, "a"), [key, "a"], "left_anti").select(key, "a", "conf")
    fp = rest.join(best, [key, "a"], "left").select(key, "a", F.lit(None).cast(kind).alias("b"), F.coalesce("iou", F.lit(0.0)).alias("iou"), "conf", F.lit("FP").alias("status"))
    fn = truth.join(tp.select(key, "b"), [key, "b"], "left_anti").select(key, F.lit(None).cast(known).alias("a"), "b", F.lit(0.0).alias("iou"), F.lit(None).cast("double").alias("conf"), F.lit("FN").alias("status"))
    return tp.unionByName(fp).unionByName(fn)


def match_lines(truth: DataFrame, pred: DataFrame, key: str, infix: Column | None = None) -> DataFrame:
    """``(key, t, p, edits, n)``: truth lines with the prediction greedy assignment gives them, smallest edits per letter
    first; a truth line without a partner has a null ``p`` and costs its length. Inputs ``(key, t|p, text)``; where the
    condition ``infix`` over the truth's columns holds, the text around the best part of a prediction costs nothing."""
    a, b = truth.select(key, F.col("t").alias("a"), F.col("text").alias("x"), (F.lit(False) if infix is None else infix).alias("_in")), pred.select(key, F.col("p").alias("b"), F.col("text").alias("y"))
    whole = F.levenshtein("x", "y")
    edits = whole if infix is None else F.when(F.col("_in"), lev_infix(F.col("y"), F.col("x"))).otherwise(whole)
    pairs = a.join(b, key).withColumn("edits", edits).withColumn("ratio", F.col("edits") / F.greatest(F.length("x"), F.lit(1)))
    got = greedy_match(pairs.select(key, "a", "b", "edits", "ratio"), [key], [F.col("ratio")])
    return a.join(got.select(key, "a", "b", "edits"), [key, "a"], "left").select(key, F.col("a").alias("t"), F.col("b").alias("p"), F.coalesce("edits", F.length("x")).alias("edits"), F.length("x").alias("n"))


def match_exact(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Multiset intersection of equal lines per key: ``(key, text, n)``."""
    n = lambda df, c: df.groupBy(key, "text").agg(F.count(F.lit(1)).alias(c))
    return n(truth, "_t").join(n(pred, "_p"), [key, "text"]).select(key, "text", F.least("_t", "_p").alias("n"))


def majority(readings: DataFrame, key: list[str], text: str, norm: Column, rank: str, need: int = 2) -> DataFrame:
    """``(*key, text, votes)``: the reading whose normal form most engines share if ``need`` do, else that of the first
    engine by ``rank``; among sharers the first engine's wording. Empty normal forms do not vote."""
    r = readings.select(*key, F.col(text).alias("_t"), norm.alias("_n"), F.col(rank).alias("_r"))
    per = r.groupBy(*key, "_n").agg(F.count(F.lit(1)).alias("votes"), F.min_by("_t", "_r").alias("_t"), F.min("_r").alias("_r"))
    good = F.when((F.col("_n") != "") & (F.col("votes") >= need), F.col("votes")).otherwise(0)
    best = per.groupBy(*key).agg(F.min_by(F.struct("_t", "votes"), F.struct(-good, "_r")).alias("_b"))
    return best.select(*key, F.col("_b._t").alias("text"), F.col("_b.votes").alias("votes"))


def gap_segments(df: DataFrame, key: list[str], start: str, end: str, order: list[str], gap: float, out: str = "segment") -> DataFrame:
    """``out``: the running number of the segment a row belongs to; a new one begins where ``start`` lies more than
    ``gap`` behind the furthest ``end`` so far."""
    w = Window.partitionBy(*key).orderBy(start, *order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(F.col(start) - before > gap, 1).otherwise(0)).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def group_lines(boxes: Column, tol: Column) -> Column:
    """Lines of an array of ``y, x, id`` structs: by centre ``y`` each joins the first line whose running mean is within
    ``tol``; lines by mean ``y``, ids in a line by ``x``. One array is one crop, a few words."""
    start = F.array().cast("array<struct<m:double,n:int,w:array<struct<x:double,id:bigint>>>>")

    def step(lines: Column, p: Column) -> Column:
        w = F.struct(p["x"].cast("double").alias("x"), p["id"].cast("bigint").alias("id"))
        at = F.array_position(F.transform(lines, lambda line: F.abs(line["m"] - p["y"]) <= tol), F.lit(True))
        joined = F.transform(lines, lambda line, i: F.when(i == at - 1, F.struct(((line["m"] * line["n"] + p["y"]) / (line["n"] + 1)).alias("m"), (line["n"] + 1).alias("n"), F.array_append(line["w"], w).alias("w"))).otherwise(line))
        return F.when(at > 0, joined).otherwise(F.array_append(lines, F.struct(p["y"].cast("double").alias("m"), F.lit(1).alias("n"), F.array(w).alias("w"))))

    lines = F.array_sort(F.aggregate(F.array_sort(boxes), start, step))
    return F.transform(lines, lambda line: F.transform(F.array_sort(line["w"]), lambda s: s["id"]))


def word_rows(words: DataFrame, lines: DataFrame, key: str, tol: float, few: int = 1 << 17) -> DataFrame:
    """``(key, b, rows, words, order)`` of the boxes ``lines (key, b, box)`` that overlap boxes of ``words (key, id, box)``:
    rows as by ``group_lines`` within ``tol`` of the mean height, and the ids in reading order.

    The lines of a photo of more than ``few`` boxes are dealt to several tasks, each with all words of the photo.
    """
    lines = lines.where(F.col("b").isNotNull())
    n = words.select(key).unionByName(lines.select(key)).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / few).cast("int").alias("_n")).where("_n > 1")
    n = F.broadcast(n)  # at most one row for so many boxes
    sides = [F.col("box")[c].alias(c) for c in whole.SIDES]
    slots = F.coalesce("_n", F.lit(1))
    w = words.join(n, key, "left").select(key, F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), F.lit(None).cast(dict(lines.dtypes)["b"]).alias("b"), "id", *sides)
    at = lines.join(n, key, "left").select(key, F.pmod(F.xxhash64("b"), slots).cast("int").alias("slot"), "b", F.lit(None).cast("bigint").alias("id"), *sides)
    rows = w.unionByName(at).where(F.col(key).isNotNull())
    out = StructType([StructField(key, rows.schema[key].dataType), StructField("b", rows.schema["b"].dataType), StructField("rows", IntegerType()), StructField("words", LongType()), StructField("order", StringType())])
    return rows.repartition(key, "slot").sortWithinPartitions(key, "slot").mapInArrow(whole.liner(key, tol), out)


def merge_boxes(boxes: DataFrame, key: str, order: list[Column], threshold: float, by: str) -> DataFrame:
    """``(key, id, box, by)``: boxes that start a cluster, with the sorted names ``by`` of all boxes in it.

    In ``order`` each box joins the first cluster whose box overlaps it by at least ``threshold``, else it starts one.
    The boxes that start clusters are those that suppression keeps; every other joins the first of them before it.
    """
    ranked = boxes.select(key, F.col("id"), "box", F.struct(*order, F.col("id")).alias("o"), F.col(by).alias("_by"))
    kept = cut(suppress(boxes, key, order, threshold, strict=False).join(ranked.select(key, "id", "o"), [key, "id"]).select(key, "id", "box", "o"))
    a, b = ranked.select(key, F.struct("id", "o", "_by").alias("a"), "box"), kept.select(key, F.struct("id", "o").alias("b"), "box")
    near = overlap_join(a, b, key).where((F.col("iou") >= threshold) & (F.col("b.o") < F.col("a.o")) & (F.col("a.id") != F.col("b.id")))
    near = near.join(kept.select(key, F.col("id").alias("_k")), (near[key] == kept[key]) & (F.col("a.id") == F.col("_k")), "left_anti")
    first = near.groupBy(key, F.col("a.id").alias("m"), F.col("a._by").alias("_by")).agg(F.min_by("b.id", "b.o").alias("id")).select(key, "id", "_by")
    names = first.unionByName(kept.join(ranked.select(key, "id", "_by"), [key, "id"]).select(key, "id", "_by"))
    return kept.select(key, "id", "box").join(names.groupBy(key, "id").agg(F.sort_array(F.collect_set("_by")).alias("by")), [key, "id"])
