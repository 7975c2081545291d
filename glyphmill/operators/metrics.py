"""Additive counters, ratios and ranked-curve metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.lineage import cut


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 where the denominator is 0 or null."""
    return F.when(den > 0, num / den).otherwise(0.0)


def same(df: DataFrame, other: DataFrame, names: list[tuple[str, str]]) -> Column:
    return reduce(lambda p, q: p & q, [df[a].eqNullSafe(other[b]) for a, b in names])


def curve(hits: DataFrame, group: str, score: str, hit: str, tie: str, bits: int = 8) -> DataFrame:
    """``hits`` with ``cum_n``, ``cum_tp``, ``precision`` and ``envelope`` (largest precision from here on) by falling score.

    Scores in [0, 1] are cut into ``2**bits`` spans; sums and maxima are taken inside a span and completed with the
    totals of the other spans, so one group with all rows is no single task. Null scores rank last.
    """
    keyed = hits.withColumn("_s", F.coalesce(F.col(score), F.lit(-1.0)))
    keyed = keyed.withColumn("_b", F.greatest(F.floor(F.col("_s") * 2**bits), F.lit(-1)).cast("int"))
    order = [F.col("_s").desc(), F.col(tie)]
    w = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumns({"_n": F.count(F.lit(1)).over(w), "_t": F.sum(F.col(hit).cast("int")).over(w)})
    per = keyed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("int")).alias("t"))
    before = Window.partitionBy(group).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(group).alias("_g"), F.col("_b").alias("_b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_t0"))
    full = keyed.join(per, same(keyed, per, [(group, "_g"), ("_b", "_b2")])).withColumns({"cum_n": F.col("_n") + F.col("_n0"), "cum_tp": F.col("_t") + F.col("_t0")})
    full = full.drop("_g", "_b2", "_n", "_t", "_n0", "_t0").withColumn("precision", F.col("cum_tp") / F.col("cum_n"))
    tops = full.groupBy(group, "_b").agg(F.max("precision").alias("m"))
    after = Window.partitionBy(group).orderBy(F.col("_b").desc()).rowsBetween(1, Window.unboundedFollowing)
    tops = tops.select(F.col(group).alias("_g"), F.col("_b").alias("_b2"), F.coalesce(F.max("m").over(after), F.lit(0.0)).alias("_m0"))
    # from the far end up to here: a frame that grows is added up once, one that shrinks would be read anew for each row
    here = Window.partitionBy(group, "_b").orderBy(F.col("_s"), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = full.withColumn("_m", F.max("precision").over(here)).join(tops, same(full, tops, [(group, "_g"), ("_b", "_b2")]))
    return out.withColumn("envelope", F.greatest("_m", "_m0")).drop("_s", "_b", "_g", "_b2", "_m", "_m0")


def _trapezoid_101(full: DataFrame, group: str, hit: str, totals: DataFrame) -> DataFrame:
    """``(group, ap_101)`` of a curve with ``cum_tp``, ``envelope`` and ``total``.

    At a recall of k hits the curve drops from the highest envelope of its points to the lowest, so a grid point between
    two recalls is read from the lowest of the one before to the highest of the one behind; on a recall it is the lowest,
    as of the last point there. Points are joined to their neighbours by their number of hits, no window is needed.
    """
    p = full.where("total > 0").groupBy(group, "total", F.col("cum_tp").alias("k")).agg(F.max("envelope").alias("top"), F.min("envelope").alias("low"))
    best = p.groupBy(group, "total").agg(F.max("top").alias("top"))
    ends = totals.where("total > 0").join(best.drop("total"), group)
    one = F.greatest(F.lit(1.0), F.coalesce("top", F.lit(0.0)))  # the envelope at recall 0
    start = ends.select(group, "total", F.lit(0).cast("long").alias("k"), one.alias("top"), F.lit(None).cast("double").alias("low"))
    both = p.select(group, "total", "k", "top", "low").unionByName(start).groupBy(group, "total", "k").agg(F.max("top").alias("top"), F.min("low").alias("low"))
    both = both.withColumn("low", F.coalesce("low", "top"))
    last = both.groupBy(group).agg(F.max("k").alias("last"))
    nxt = both.select(F.col(group).alias("_g"), (F.col("k") - 1).alias("_k"), F.col("top").alias("next"))
    seg = both.join(nxt, same(both, nxt, [(group, "_g"), ("k", "_k")]), "left").join(last, group)
    # behind the last recall the curve falls to (1, 0)
    x0 = F.col("k") / F.col("total")
    x1 = F.when(F.col("k") == F.col("last"), F.lit(1.0)).otherwise((F.col("k") + 1) / F.col("total"))
    lo = F.ceil(F.round(x0 * 100, 9)).cast("int")
    hi = F.when(F.col("k") == F.col("last"), F.lit(100)).otherwise(F.ceil(F.round(x1 * 100, 9)).cast("int") - 1)
    grid = seg.withColumns({"x0": x0, "x1": x1, "y1": F.coalesce("next", F.lit(0.0))}).where(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
    x = F.col("i") / 100
    y = F.when(F.col("x1") > F.col("x0"), F.col("low") + (F.col("y1") - F.col("low")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.when(F.col("k") == F.col("total"), F.lit(0.0)).otherwise(F.col("low")))
    weight = F.when(F.col("i").isin(0, 100), 0.5).otherwise(1.0)
    return grid.groupBy(group).agg((F.sum(y * weight) / 100).alias("ap_101"))


def average_precision(hits: DataFrame, group: str, score: str, hit: str, tie: str, totals: DataFrame) -> DataFrame:
    """``(group, ap_all, ap_step, ap_101, total)``: all-point with envelope, step sum without it, and 101-point.

    The last is the trapezoid sum over 101 recalls of the envelope read linearly between the points of the curve, which
    begins at (0, 1) and ends at (1, 0). ``totals (group, total)`` counts the truth; a group without truth or hits has 0.
    """
    full = cut(curve(hits, group, score, hit, tie).join(totals, group).select(group, hit, "cum_tp", "precision", "envelope", "total"))
    c = full.where((F.col("total") > 0) & F.col(hit)).withColumn("recall", F.col("cum_tp") / F.col("total"))
    s = c.groupBy(group).agg(F.sum(F.col("envelope") / F.col("total")).alias("ap_all"), F.sum(F.col("precision") / F.col("total")).alias("ap_step"))
    s = s.join(_trapezoid_101(full, group, hit, totals), group, "full")
    z = F.lit(0.0)
    return totals.join(s, group, "left").select(group, *[F.coalesce(x, z).alias(x) for x in ("ap_all", "ap_step", "ap_101")], "total")


def line_scores(lines: DataFrame, by: list[str]) -> DataFrame:
    """Micro sums and ratios over ``(.., truth, pred)`` rows of normal forms: lines, exact, letters, edits, CER, exact rate,
    and the same per-line with denominators of at least 1."""
    t, p = F.coalesce("truth", F.lit("")), F.coalesce("pred", F.lit(""))
    e = F.levenshtein(t, p)
    sums = [
        F.count(F.lit(1)).alias("lines"),
        F.sum(((t == p) & (t != "")).cast("int")).alias("exact"),
        F.sum(F.length(t)).alias("letters"),
        F.sum(e).alias("edits"),
        F.sum(F.greatest(F.length(t), F.lit(1))).alias("letters_1"),
    ]
    g = lines.groupBy(*by).agg(*sums)
    return g.withColumns({"cer": ratio(F.col("edits"), F.col("letters")), "exact_rate": ratio(F.col("exact"), F.col("lines"))})


def best_engine(readings: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, engine, edits)``: per line the engine with the fewest edits per letter, the first by name on ties."""
    r = readings.withColumn("edits", F.levenshtein("truth", "pred")).withColumn("_r", F.col("edits") / F.greatest(F.length("truth"), F.lit(1)))
    best = r.groupBy(*key).agg(F.min_by(F.struct("engine", "edits"), F.struct("_r", "engine")).alias("_b"))
    return best.select(*key, F.col("_b.engine").alias("engine"), F.col("_b.edits").alias("edits"))


def best_value(df: DataFrame, part: str, by: list[str]) -> DataFrame:
    """``(*by, metric, best)``: the highest value of the first column whose name holds ``part``."""
    name = next((c for c in df.columns if part in c), None)
    if name is None:
        raise ValueError(f"no column holds {part!r}")
    return df.groupBy(*by).agg(F.lit(name).alias("metric"), F.max(name).alias("best"))
