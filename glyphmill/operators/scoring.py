"""Scores of read text against true text: lines, letters and words per crop, added up per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators.lineage import cut
from glyphmill.operators.matching import match_lines
from glyphmill.operators.metrics import ratio

COUNTERS = ("crops", "empty", "lines", "letters", "edits", "extra_edits", "exact", "recalled", "contained", "words", "common_words", "word_edits", "extra_words")


def crop_counters(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """``(key, *COUNTERS)`` for every crop of ``truth (key, text)`` with a readable line; ``pred (key, text)``.

    Lines are matched one to one, fewest edits per letter first. A truth line without a partner costs all its letters and
    words, a predicted line without one adds ``extra_edits`` and ``extra_words``. In a crop with a don't-care line extra
    text costs nothing: lines are compared by their best part and lines over are not counted. An empty normal form is
    never exact. A crop without a prediction is empty; repeated rows count once, a null text is empty.
    """
    g = cut(truth.select(key, F.col("text").alias("_x")).where(F.col(key).isNotNull()).distinct())
    lines = t.readable_lines(F.coalesce("_x", F.lit("")))
    g = g.select(key, lines.alias("_lines"), (F.size(t.split_lines(F.coalesce("_x", F.lit("")))) > F.size(lines)).alias("_open")).where(F.size("_lines") > 0)
    p = pred.select(key, F.coalesce("text", F.lit("")).alias("_y")).groupBy(key).agg(F.max("_y").alias("_y"))
    both = cut(g.join(p, key, "left").withColumn("_y", F.coalesce("_y", F.lit(""))).withColumn("_whole", t.norm_cer(F.col("_y"))))
    gl = both.select(key, "_open", "_whole", F.posexplode("_lines").alias("t", "_line"))
    gl = cut(gl.select(key, "_open", "_whole", "t", t.norm_cer(F.col("_line")).alias("text"), t.norm_words(F.col("_line")).alias("_gw")))
    pl = both.select(key, "_open", F.posexplode(t.split_lines(F.col("_y"))).alias("p", "_line"))
    pl = cut(pl.select(key, "_open", "p", t.norm_cer(F.col("_line")).alias("text"), t.norm_words(F.col("_line")).alias("_pw")))
    m = match_lines(gl.select(key, "t", "text", "_open"), pl.select(key, "p", "text"), key, F.col("_open"))
    full = gl.join(m, [key, "t"]).join(pl.select(key, "p", "_pw"), [key, "p"], "left").withColumn("_pw", F.coalesce("_pw", F.array().cast("array<string>")))
    one = lambda c: F.sum(c.cast("int"))
    per = full.groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("n").alias("letters"), F.sum("edits").alias("edits"),
        one(F.col("p").isNotNull() & (F.col("text") != "") & (F.col("edits") == 0)).alias("exact"), one((F.col("n") > 0) & (F.col("edits") < F.col("n"))).alias("recalled"),
        one((F.col("text") != "") & F.contains("_whole", F.col("text"))).alias("contained"), F.sum(F.size("_gw")).alias("words"),
        F.sum(t.lcs_len(F.col("_pw"), F.col("_gw"))).alias("common_words"), F.sum(t.lev_tokens(F.col("_pw"), F.col("_gw"))).alias("word_edits"),
    )
    over = pl.where("not _open").join(m.where("p is not null").select(key, "p"), [key, "p"], "left_anti").groupBy(key).agg(F.sum(F.length("text")).alias("extra_edits"), F.sum(F.size("_pw")).alias("extra_words"))
    out = both.select(key, F.lit(1).alias("crops"), (F.trim("_y") == "").cast("int").alias("empty")).join(per, key).join(over, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def add_up(counters: DataFrame, by: list[str], keep_extra: bool = True) -> DataFrame:
    """Sums of the counters per group and the ratios cer, war, wer, exact_rate, recall and contain_rate, 0 over nothing."""
    s = counters.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTERS])
    extra = lambda c: F.col(c) if keep_extra else F.lit(0)
    return s.withColumns({
        "cer": ratio(F.col("edits") + extra("extra_edits"), F.col("letters")), "war": ratio(F.col("common_words"), F.col("words")),
        "wer": ratio(F.col("word_edits") + extra("extra_words"), F.col("words")), "exact_rate": ratio(F.col("exact"), F.col("lines")),
        "recall": ratio(F.col("recalled"), F.col("lines")), "contain_rate": ratio(F.col("contained"), F.col("lines")),
    })


def compose(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``(key, text)``: the lines of ``base (key, text)`` and behind them those of ``more`` that are like none of these.

    Keys of either side count (a full outer join). Lines are alike by ``functions.text.similar`` over their keys; lines
    of ``more`` with a key under two letters are left out.
    """
    lines = lambda df: df.select(key, F.posexplode(t.split_lines(F.coalesce("text", F.lit("")))).alias("i", "line"))
    b, m = lines(base), lines(more)
    b = b.select(key, "i", "line", t.norm_key(F.col("line")).alias("k"))
    m = m.select(key, "i", "line", t.norm_key(F.col("line")).alias("k")).where(F.length("k") >= 2)
    known = b.select(F.col(key).alias("_key"), F.col("k").alias("_k"))
    new = m.join(known, (m[key] == known["_key"]) & t.similar(F.col("k"), F.col("_k")), "left_anti")
    every = b.select(key, F.lit(0).alias("s"), "i", "line").unionByName(new.select(key, F.lit(1).alias("s"), "i", "line"))
    text = every.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    keys = base.select(key).join(more.select(key), key, "full").distinct()
    return keys.join(text, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def nearest_lines(base: DataFrame, other: DataFrame, key: list[str], model: str) -> DataFrame:
    """``(*key, i, model, line, edits)``: for each line of ``base (*key, i, line)`` the nearest of each model in ``other
    (*key, model, j, line)``, within ``max(2, half the letters)`` edits; the first on ties."""
    a = base.select(*key, "i", F.col("line").alias("_b"))
    near = a.join(other, key).withColumn("edits", F.levenshtein("_b", "line")).where(F.col("edits") <= F.greatest(F.lit(2), F.floor(F.length("_b") / 2)))
    best = near.groupBy(*key, "i", model).agg(F.min_by(F.struct("line", "edits"), F.struct("edits", "j")).alias("_n"))
    return best.select(*key, "i", model, "_n.line", "_n.edits")
