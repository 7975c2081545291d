"""Problem 3: one consistent form for text that looks alike but is stored in different characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that look like a Latin letter.
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХҮԁаеѕіјорсухһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳᎪᎫᎬᎳᎷᎻᏃᏒᏙᏚᏞᏟᏢᏦᏴ"
LOOKALIKE_TO__ = "ABESIJKMHOPCTYXYdaesijopcyxhqwABEZHIKMNOPTYXocjAJEWMHZRVSLCPKB"

#: Characters that show as nothing at all.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF]

#: Texts of these characters alone are in their consistent form already; decided in the JVM.
PLAIN = r"^[\x00-\x7F·ㄱ-ㆎ가-힣一-鿿ぁ-ゖァ-ヺ]*$"

_CLUSTER = regex.compile(r"\X")
_PICTURE = regex.compile(r"\p{Extended_Pictographic}")


def rules() -> Iterator[tuple[str, str]]:
    """``(sequence, form)`` from rules: widths, font variants, letters in circles and joined letters, letter symbols, blanks, nothing, accents, Hangul letters."""
    for o in range(0xA0, 0x1F000):
        c = chr(o)
        kind = unicodedata.decomposition(c).split(" ")[0]
        letters = kind == "<circle>" and 0x24B6 <= o <= 0x24E9 or kind == "<compat>" and 0xFB00 <= o <= 0xFB06
        if kind in ("<wide>", "<narrow>", "<font>") or letters or (kind and kind[0] != "<" and len(unicodedata.normalize("NFC", c)) == 1 and unicodedata.normalize("NFC", c) != c):
            yield c, unicodedata.normalize("NFC", unicodedata.normalize("NFKC", c))
        elif unicodedata.category(c) == "Zs":
            yield c, " "
        elif kind and kind[0] != "<" and not 0xAC00 <= o <= 0xD7A3 and unicodedata.normalize("NFC", c) == c:
            yield unicodedata.normalize("NFD", c), c
    for o in INVISIBLE:
        yield chr(o), ""
    for o in range(0xAC00, 0xD7A4):
        parts = unicodedata.normalize("NFD", chr(o))
        yield parts, chr(o)
        if len(parts) == 3:
            yield unicodedata.normalize("NFC", parts[:2]) + parts[2], chr(o)


class Transducer:
    """A longest-match trie over the code points of a grapheme cluster, and a word pass for look-alike letters.

    Building it checks that no sequence has two forms and that every form maps to itself.
    """

    def __init__(self) -> None:
        table: dict[str, str] = {}
        for sequence, form in rules():
            if table.setdefault(sequence, form) != form:
                raise ValueError(f"conflict: {sequence!r} gives {table[sequence]!r} and {form!r}")
        self.trie: dict = {}
        for sequence, form in table.items():
            node = self.trie
            for c in sequence:
                node = node.setdefault(c, {})
            node[""] = form
        for form in set(table.values()):
            if self._walk(form) != form:
                raise ValueError(f"form {form!r} is not stable")
        if len(LOOKALIKE_FROM) != len(LOOKALIKE_TO__) or len(set(LOOKALIKE_FROM)) != len(LOOKALIKE_FROM):
            raise ValueError("look-alike letters conflict")
        self.alike = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO__, strict=True))
        self.known: dict[str, tuple[str, str, int]] = {}

    def _walk(self, cluster: str) -> str:
        out, i = [], 0
        while i < len(cluster):
            node, j, form, end = self.trie, i, None, i
            while j < len(cluster) and cluster[j] in node:
                node, j = node[cluster[j]], j + 1
                if "" in node:
                    form, end = node[""], j
            out.append(cluster[i] if form is None else form)
            i = end if form is not None else i + 1
        return "".join(out)

    def _step(self, cluster: str) -> tuple[str, str, int]:
        """``(form, form if a look-alike, class)``; classes: 0 breaks a word, 1 Latin, 2 look-alike, 3 other letter, 4 neutral."""
        form = cluster if _PICTURE.search(cluster) else unicodedata.normalize("NFC", self._walk(self._walk(cluster)))
        if not form:
            return "", "", 4
        first = form[0]
        if first in self.alike:
            return form, unicodedata.normalize("NFC", self.alike[first] + form[1:]), 2
        kind = unicodedata.category(first)[0]
        if kind == "L":
            return form, form, 1 if unicodedata.name(first, "").startswith("LATIN") else 3
        return form, form, 4 if kind == "M" else 0

    def __call__(self, text: str) -> str:
        out: list[str] = []
        word: list[tuple[str, str, int]] = []

        def flush() -> None:
            seen = [0] * 5
            for step in word:
                seen[step[2]] += 1
            use = 1 if seen[2] and seen[1] and seen[1] >= seen[3] else 0
            out.extend(step[use] for step in word)
            word.clear()

        before = ""
        for cluster in _CLUSTER.findall(text):
            mark = before == "\\" and cluster in ("n", "r", "t")  # a newline written out, not part of the next word
            before = cluster
            if mark:
                out.append(cluster)
                continue
            step = self.known.get(cluster)
            if step is None:
                step = self._step(cluster)
                if len(self.known) < 100_000:
                    self.known[cluster] = step
            if step[2]:
                word.append(step)
            else:
                if word:
                    flush()
                out.append(step[0])
        if word:
            flush()
        return "".join(out)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(T.StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    t = transducer()
    return texts.map(t, na_action="ignore")


def consistent(c: Column) -> Column:
    """The consistent form of a text column.

    Widths, font variants, decomposed accents and Hangul letters, blanks of other widths and invisible characters take
    their plain composed form. A look-alike letter becomes Latin only in a word that has Latin letters and no more
    letters of other scripts than these; a word wholly in another script stays. Null stays null, the empty text empty;
    the form of a form is itself. Plain texts are passed by in the JVM, the rest go through Arrow batches.
    """
    return F.when(c.isNull() | c.rlike(PLAIN), c).otherwise(_consistent(F.when(~c.rlike(PLAIN), c)))


def consistent_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, form, changed)``, a row per row of ``df``; ``changed`` is false for null texts."""
    out = df.select(F.col(key), F.col(text).alias("text")).withColumn("form", consistent(F.col("text")))
    return out.withColumn("changed", F.coalesce(F.col("form") != F.col("text"), F.lit(False)))
