"""Text scalars: normal forms, line splitting, distances, n-grams, rules. All JVM-side but for NFKC of non-ASCII text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mark of a line nobody must read, and phone numbers.
DONT_CARE = "###"
PHONE = r"(?:\+\d{1,3}[-.)\s]?)?\d{2,4}[-.)\s]\s?(?:\d{3,4}[-.\s]\s?)?\d{4}(?!\d)"
ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC; ASCII text passes without leaving the JVM."""
    return F.when(c.isNull() | c.rlike(ASCII), c).otherwise(_nfkc(F.when(~c.rlike(ASCII), c)))


def norm_key(c: Column, ascii_only: bool = False) -> Column:
    """Lower-case NFKC letters a-z, digits and Hangul syllables; the key that names are compared by."""
    return F.regexp_replace(F.lower(c if ascii_only else nfkc(c)), "[^0-9a-z가-힣]", "")


def split_name(c: Column) -> Column:
    """``train``, ``val`` or ``test`` for any of their spellings, else null."""
    key = F.regexp_replace(F.lower(c), r"[^a-z]", "")
    names = {"train": ("train", "training", "trn", "tr"), "val": ("val", "valid", "validation", "dev", "vld"), "test": ("test", "testing", "tst")}
    return F.coalesce(*[F.when(key.isin(*spellings), F.lit(name)) for name, spellings in names.items()])


def base_norm(c: Column, english_only: bool = False, ascii_only: bool = False, phones: bool = True) -> Column:
    """Scoring form: NFKC, zero-width space dropped, lower case, phones blanked unless ``phones`` is false, only key
    characters and blanks kept. Null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    t = F.lower(F.replace(c if ascii_only else nfkc(c), F.lit("\u200b"), F.lit("")))
    t = F.regexp_replace(t, PHONE, " ") if phones else t
    t = F.regexp_replace(t, "[가-힣]", "") if english_only else t
    return F.regexp_replace(t, r"[^0-9a-z가-힣\s]", "")


def norm_cer(c: Column, **kw) -> Column:
    return F.regexp_replace(base_norm(c, **kw), r"\s+", "")


def norm_words(c: Column, **kw) -> Column:
    return F.filter(F.split(base_norm(c, **kw), r"\s+"), lambda w: w != "")


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_lines(c: Column, bars: bool = True) -> Column:
    """Lines of a cell: CRLF and a literal backslash-n count as a newline; with a bar anywhere the bars split instead."""
    t = F.trim(F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\\n"), F.lit("\n")))
    lines = F.split(t, "\n")
    if bars:
        lines = F.when(F.contains(t, F.lit("|")), F.split(t, r"\|")).otherwise(lines)
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def readable_lines(c: Column) -> Column:
    """Lines without the don't-care mark."""
    return F.filter(split_lines(c), lambda x: x != DONT_CARE)


def bigrams(c: Column) -> Column:
    """The set of 2-grams; a shorter text is its own only gram, the empty text has none."""
    n = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(grams)).when(n == 1, F.array(c)).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """``1 - edits / longer length``; two empty texts are alike."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / n)


def contains_or_similar(a: Column, b: Column, least: float, shortest: int = 3) -> Column:
    """One key of at least ``shortest`` letters inside the other, or similarity of ``least``."""
    inside = (F.length(a) >= shortest) & F.contains(b, a) | (F.length(b) >= shortest) & F.contains(a, b)
    return F.coalesce(inside | (similarity(a, b) >= least), F.lit(False))


def similar(a: Column, b: Column) -> Column:
    """Containment, or lengths within half of the longer and edits within ``max(1, 30 % of the shorter)``."""
    la, lb = F.length(a), F.length(b)
    near = (F.abs(la - lb) * 2 <= F.greatest(la, lb)) & (F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(F.least(la, lb) * 0.3)))
    return (la > 0) & (lb > 0) & (F.contains(a, b) | F.contains(b, a) | near)


def _row(prev: Column, x: Column, other: Column, first: Column) -> Column:
    """Next row of an edit table over ``other``, an array of letters or tokens."""
    pairs = F.transform(other, lambda y, j: F.struct(F.when(y == x, 0).otherwise(1).alias("c"), j.alias("j")))
    return F.aggregate(
        pairs,
        F.array(first),
        lambda acc, p: F.array_append(acc, F.least(F.element_at(acc, -1) + 1, F.element_at(prev, p["j"] + 2) + 1, F.element_at(prev, p["j"] + 1) + p["c"])),
    )


def lev_tokens(a: Column, b: Column) -> Column:
    """Edit distance of two arrays."""
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: i)
    last = F.aggregate(a, start, lambda prev, x: _row(prev, x, b, F.element_at(prev, 1) + 1))
    return F.element_at(last, -1)


def lev_infix(text: Column, truth: Column) -> Column:
    """Least edit distance of ``truth`` to any substring of ``text``: the edit table starts with a row of zeros."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    start = F.transform(F.concat(F.array(F.lit("")), letters(text)), lambda _: F.lit(0))
    last = F.aggregate(letters(truth), start, lambda prev, x: _row(prev, x, letters(text), F.element_at(prev, 1) + 1))
    return F.array_min(last)


def lcs_len(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        pairs = F.transform(b, lambda y, j: F.struct((y == x).alias("e"), j.alias("j")))
        return F.aggregate(pairs, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.when(p["e"], F.element_at(prev, p["j"] + 1) + 1).otherwise(F.greatest(F.element_at(acc, -1), F.element_at(prev, p["j"] + 2)))))

    return F.element_at(F.aggregate(a, start, row), -1)


def map_tag(c: Column, rules: list[tuple[str, str]], lower: bool = False) -> Column:
    """The tag of the first rule whose keyword the text contains, else the empty text."""
    t = F.lower(c) if lower else c
    out = F.lit("")
    for word, tag in reversed(rules):
        out = F.when(F.contains(t, F.lit(word)), tag).otherwise(out)
    return out


def matched_word(c: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit("")
    for word, _ in reversed(rules):
        out = F.when(F.contains(F.lower(c), F.lit(word)), word).otherwise(out)
    return out


def guess_name(lines: Column, generic: str = "^(open|closed|sale|menu|parking|wifi)$") -> Column:
    """The longest line that is no phone number, no generic word and has two key characters; the first on ties."""
    ok = F.filter(lines, lambda x: (~x.rlike(PHONE)) & (~F.lower(x).rlike(generic)) & (F.length(F.regexp_replace(F.lower(x), "[^0-9a-z가-힣]", "")) >= 2))
    return F.coalesce(F.aggregate(ok, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)), F.lit(""))


def canon(tag: Column, synonyms: dict[str, str]) -> Column:
    """Synonym of the lower-case blank-free tag, else of the raw tag, else the lower-case tag."""
    m = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    t = F.regexp_replace(F.lower(tag), r"\s", "")
    return F.coalesce(m[t], m[tag], t)


def tag_key(tag: Column) -> Column:
    return F.substring_index(tag, "=", 1)


def trailing_number(c: Column) -> Column:
    """The last number in a name, for an order that sorts 9 before 10."""
    return F.regexp_extract(c, r"(\d+)(?!.*\d)", 1).try_cast("bigint")


def crop_name(photo: Column, idx: Column) -> Column:
    return F.format_string("%s__crop_%03d", photo, idx)


def safe_stem(c: Column, limit: int = 32) -> Column:
    """A file stem: illegal characters and blanks become underscores, cut to ``limit``; never empty."""
    t = F.substring(F.regexp_replace(c, r'[\\/:*?"<>|\s]+', "_"), 1, limit)
    return F.when(t == "", "empty").otherwise(t)


def json_object(c: Column, schema: str) -> Column:
    """The first ``{...}`` of a reply as a struct; null where there is none or it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*?\})", 1), F.lit("")), schema)


def json_lines(c: Column, fallback: Column) -> Column:
    """The greedy ``[...]`` of a reply as lines; else its non-empty lines; else ``fallback``; also if the count changed."""
    got = F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit("")), "array<string>")
    plain = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    new = F.coalesce(got, F.when(F.size(plain) > 0, plain), fallback)
    return F.when(F.size(new) == F.size(fallback), new).otherwise(fallback)
