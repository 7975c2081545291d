"""Several values packed in one field: infer the separators per source, split, and explode with position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.lineage import cut

BLANK = r"[\s\p{Z}]"
INNER_BLANK = r"[^\S\n\r\t]|\p{Z}"

#: Noncharacters of Unicode stand in for marks that need more than one character, or that belong to a value.
LITERAL_NEWLINE, SPACED_DOT, IN_NUMBER, IN_TIME, SPACED_DASH = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4"

#: Candidate separators as they stand after ``_protect``, with the support each has before any evidence.
CANDIDATES = {
    "\n": 1.0, LITERAL_NEWLINE: 1.0, "\t": 1.0, "|": 1.0, ";": 1.0,
    ",": 0.4, "/": 0.4, SPACED_DOT: 0.4,
    SPACED_DASH: 0.0, "&": 0.0, "+": 0.0, ":": 0.0, ".": 0.0, "-": 0.0,
}
#: What each kind of evidence weighs, and the score from which a candidate separates; none depends on the number of rows.
CONSISTENCY, REGULARITY, RECURRENCE, SUPPORT = 0.1, 0.25, 0.45, 0.2
#: A type counts as that of whole values if one in TYPE_SHARE of them has it.
TYPE_SHARE = 500
#: Sources up to which their separators, a few bytes each, are broadcast.
FEW_SOURCES = 10_000
ACCEPT = 0.28


def _protect(c: Column) -> Column:
    """Marks inside numbers and times become noncharacters; marks of several characters become one."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.replace(t, F.lit("\\n"), F.lit(LITERAL_NEWLINE))
    t = F.regexp_replace(t, r"(?<![\d\p{L}.])(\d{1,3}),(?=\d{3}(?!\d))", "$1" + IN_NUMBER)
    t = F.regexp_replace(t, IN_NUMBER + r"(\d{3}),(?=\d{3}(?!\d))", IN_NUMBER + "$1" + IN_NUMBER)
    t = F.regexp_replace(t, r"(?<!\d)(\d{1,2})/(\d{1,2})(?!\d)", "$1" + IN_TIME + "$2")
    t = F.regexp_replace(t, rf"(?<={BLANK})[·・](?={BLANK})", SPACED_DOT)
    return F.regexp_replace(t, rf"(?<={BLANK})[-–](?={BLANK})", SPACED_DASH)


def _restore(c: Column) -> Column:
    for mark, text in ((LITERAL_NEWLINE, "\\n"), (SPACED_DOT, "·"), (IN_NUMBER, ","), (IN_TIME, "/"), (SPACED_DASH, "-")):
        c = F.replace(c, F.lit(mark), F.lit(text))
    return c


def _pieces(protected: Column, marks: Column) -> Column:
    """Fields of a protected text between the separator characters in ``marks`` (a regex class body), quoting undone."""
    quoted = F.concat(F.lit(r"(?<![^"), marks, F.lit(rf'])(?:{INNER_BLANK})*+"[^"]*+(?:""[^"]*+)*+"(?:{INNER_BLANK})*+(?![^'), marks, F.lit("])"))
    fields = F.regexp_extract_all(protected, F.concat(quoted, F.lit("|[^"), marks, F.lit("]++")), F.lit(0))

    def value(x: Column) -> Column:
        t = F.regexp_replace(x, rf"^{BLANK}++|{BLANK}++$", "")
        inner = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))
        whole = t.rlike(r'^"[^"]*+(?:""[^"]*+)*+"$')
        return F.regexp_replace(F.when(whole, inner).otherwise(t), rf"^{BLANK}++|{BLANK}++$", "")

    return F.filter(F.transform(fields, value), lambda x: x != "")


def _class(mark: str) -> str:
    return "\\" + mark if mark in "|.+-&:;/,\n\t" and mark not in "\n\t" else {"\n": r"\n", "\t": r"\t"}.get(mark, mark)


def piece_type(c: Column) -> Column:
    """The type of a value: runs of digits, Hangul and other letters each as one mark, other characters as they are."""
    t = F.regexp_replace(F.trim(c), r"\d+", "9")
    t = F.regexp_replace(F.regexp_replace(t, r"\p{IsHangul}+", "\ufdd5"), r"\p{L}+", "a")
    return F.regexp_replace(t, rf"{BLANK}+", " ")


def separator_scores(df: DataFrame, value: str, source: Column) -> DataFrame:
    """``(source, mark, pieces, consistency, regularity, recurrence, score, accepted)`` for every source and candidate
    separator that occurs in it.

    ``consistency``: the share of the cells with the mark that hold its commonest number of pieces. ``regularity``: the
    share of its pieces whose type (``piece_type``) whole values of the source have, cells without any candidate.
    ``recurrence``: the share of its pieces that also stand as whole values elsewhere in the source, alone in a cell or
    between other candidates; what a hyphen or an ampersand inside names and numbers leaves never does. The three and
    the support in ``CANDIDATES`` are weighed and multiplied by the share of pieces that are not empty. All rows count, a
    piece once per cell; pieces, their types and numbers are pre-aggregated before each shuffle.
    """
    t = df.where(F.col(value).isNotNull()).select(source.alias("source"), _protect(F.col(value)).alias("_t"))
    marks = list(CANDIDATES)
    splits = F.array(*[F.when(F.contains("_t", F.lit(m)), F.struct(F.lit(i).alias("d"), F.transform(_raw(F.col("_t"), m), lambda x: F.trim(x)).alias("p"))) for i, m in enumerate(marks)])
    alone = F.when(~F.col("_t").rlike("[" + "".join(_class(m) for m in marks) + "]"), F.struct(F.lit(len(marks)).alias("d"), F.array(F.trim("_t")).alias("p")))
    cells = t.select("source", F.explode(F.array_compact(F.concat(splits, F.array(alone)))).alias("s")).select("source", "s.d", F.size("s.p").alias("k"), F.array_distinct("s.p").alias("p"))
    # a cell gives its pieces and, as a piece of its own, their number
    each = cells.select("source", "d", F.explode(F.concat(F.transform("p", lambda x: F.struct(x.alias("piece"), F.lit(None).cast("int").alias("k"))), F.array(F.struct(F.lit(None).cast("string").alias("piece"), F.col("k").alias("k"))))).alias("x"))
    n = cut(each.groupBy("source", "x.piece", "x.k", "d").agg(F.count(F.lit(1)).alias("n")))
    by_piece = n.where("piece is not null").groupBy("source", "piece").agg(F.collect_list(F.struct("d", "n")).alias("uses"), F.count(F.lit(1)).alias("kinds"))
    per = by_piece.select("source", F.explode("uses").alias("u"), (F.col("kinds") > 1).alias("elsewhere"), (F.col("piece") != "").alias("filled"), piece_type(F.col("piece")).alias("type"))
    per = cut(per.groupBy("source", F.col("u.d").alias("d"), "type").agg(
        F.sum("u.n").alias("pieces"),
        F.sum(F.when(F.col("elsewhere") & F.col("filled"), F.col("u.n")).otherwise(0)).alias("known"),
        F.sum(F.when(F.col("filled"), F.col("u.n")).otherwise(0)).alias("filled"),
    ))
    whole = per.where(F.col("d") == len(marks)).select("source", "type", F.col("filled").alias("w"))
    whole = whole.join(whole.groupBy("source").agg(F.sum("w").alias("all")), "source").where(F.col("w") * TYPE_SHARE >= F.col("all")).select("source", "type", F.lit(1).alias("usual"))
    got = per.where(F.col("d") < len(marks)).join(whole, ["source", "type"], "left").groupBy("source", "d").agg(
        F.sum("pieces").alias("pieces"), F.sum("known").alias("known"), F.sum("filled").alias("filled"), F.sum(F.when(F.col("usual") == 1, F.col("filled")).otherwise(0)).alias("usual")
    )
    counts = n.where(F.col("k").isNotNull()).groupBy("source", "d").agg((F.max("n") / F.sum("n")).alias("consistency"))
    part = lambda c: F.when(F.col("filled") > 0, F.col(c) / F.col("filled")).otherwise(0.0)
    got = got.join(counts, ["source", "d"]).withColumns({"regularity": part("usual"), "recurrence": part("known")})
    prior = F.element_at(F.array(*[F.lit(p) for p in CANDIDATES.values()]), F.col("d") + 1)
    score = (CONSISTENCY * F.col("consistency") + REGULARITY * F.col("regularity") + RECURRENCE * F.col("recurrence") + SUPPORT * prior) * F.col("filled") / F.col("pieces")
    name = F.element_at(F.array(*[F.lit(m) for m in marks]), F.col("d") + 1)
    got = got.select("source", name.alias("mark"), "pieces", "consistency", "regularity", "recurrence", score.alias("score"))
    return got.withColumn("accepted", F.col("score") >= ACCEPT)


def _raw(c: Column, mark: str) -> Column:
    return F.split(c, _class(mark), -1)


def split_values(df: DataFrame, key: list[str], value: str, source: Column | None = None) -> DataFrame:
    """``(*key, pos, value, n_values)``: one row per value of each distinct cell, positions from 1.

    The separators are those ``separator_scores`` accepts for the row's source (``None``: one source); a source without
    any evidence uses the candidates whose support before evidence is full. A separator inside a quoted field, a
    number, a fraction or a time does not separate. Quoting and blanks around a value are removed, doubled quotes
    inside quoting become one, empty values are dropped and take no position. Null and empty cells give no row; equal
    rows count once, as do rows of one key with equal values; other columns of ``df`` are ignored.
    """
    source = F.lit("all") if source is None else source
    scores = separator_scores(df, value, source).where("accepted")
    names = F.create_map(*[x for m in CANDIDATES for x in (F.lit(m), F.lit(_class(m)))])
    marks = scores.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set(names[F.col("mark")])), "").alias("_marks"))
    default = "".join(_class(m) for m, p in CANDIDATES.items() if p == 1.0)
    cells = df.select(*key, F.col(value).alias("_cell"), source.alias("_source")).where(F.col("_cell").isNotNull())
    marks = cut(marks)
    if marks.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:  # else a join that shuffles cells by source
        marks = F.broadcast(marks)
    joined = cells.join(marks, cells["_source"].eqNullSafe(marks["source"]), "left")
    found = joined.select(*key, _pieces(_protect(F.col("_cell")), F.coalesce("_marks", F.lit(default))).alias("_values")).distinct()
    out = found.select(*key, F.size("_values").alias("n_values"), F.posexplode("_values").alias("pos", "value"))
    return out.select(*key, (F.col("pos") + 1).cast("int").alias("pos"), _restore(F.col("value")).alias("value"), "n_values")
