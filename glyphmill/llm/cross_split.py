"""Problem 5: the same or nearly the same line in training and in evaluation splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.grouped_splits import split_name
from glyphmill.operators.lineage import cut, spread

#: Edits within which two texts are the same, and the letters and digits from which a text counts.
EDITS, LEAST = 3, 14

#: Up to SHORT letters a band is one minimum (SHORT_BANDS of them), beyond it two (LONG_BANDS), over SHINGLE letters.
SHINGLE, SHORT, SHORT_BANDS, LONG_BANDS = 3, 23, 20, 14

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_letters(c: Column) -> Column:
    """Letters and digits of a text in lower case; letter case, blanks and punctuation set aside."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]", "")


def _bands_of(texts: pd.Series) -> pd.DataFrame:
    """Band keys and the parity signature of every text (each at least SHINGLE letters)."""
    rows = texts.to_list()
    size = np.array([len(t) for t in rows], dtype=np.int64)
    code = np.frombuffer("".join(rows).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    starts = ends - size
    owner = np.repeat(np.arange(len(rows)), size)
    pair = _mix(code[:-1] * np.uint64(0x1000003) + code[1:] * _MIX) if len(code) > 1 else code[:0]
    inside = owner[:-1] == owner[1:]
    bit = np.where(inside, np.uint64(1) << (pair >> np.uint64(58)), np.uint64(0))
    signature = np.bitwise_xor.reduceat(np.append(bit, np.uint64(0)), starts)
    gram = code.copy()
    for k in range(1, SHINGLE):
        gram[:-k] = _mix(gram[:-k] * _MIX + code[k:] + np.uint64(k))
    last = np.arange(len(code)) > (ends - SHINGLE)[owner]
    top = np.uint64(2**64 - 1)
    salts = np.arange(1, max(SHORT_BANDS, 2 * LONG_BANDS) + 1, dtype=np.uint64) * _MIX
    minima = []
    for i in range(len(salts)):
        h = _mix(gram + salts[i])
        h[last] = top
        minima.append(np.minimum.reduceat(h, starts))
    m = np.stack(minima, axis=1)
    short = _mix(m[:, :SHORT_BANDS] + np.arange(1, SHORT_BANDS + 1, dtype=np.uint64) * _MIX)
    tag = np.arange(101, 101 + LONG_BANDS, dtype=np.uint64) * _MIX
    long = _mix(_mix(m[:, : 2 * LONG_BANDS : 2] + tag) + m[:, 1 : 2 * LONG_BANDS : 2])
    short, long = short.view(np.int64), long.view(np.int64)
    bands = []
    for j, n in enumerate(size):  # a pair around the border has both texts in the lower class
        own = [short[j]] if n <= SHORT + EDITS else []
        bands.append(np.concatenate([*own, long[j]]) if n > SHORT else own[0])
    return pd.DataFrame({"bands": bands, "signature": signature.view(np.int64)})


@F.pandas_udf(T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.LongType())]))
def _bands(texts: pd.Series) -> pd.DataFrame:
    return _bands_of(texts)


def _records(df: DataFrame, record: str, text: str, split: str) -> DataFrame:
    side = split_name(F.col(split))
    r = df.select(F.col(record).alias("record"), plain_letters(F.col(text)).alias("letters"), side.alias("split"), F.col("source_image"))
    return r.where((F.length("letters") >= LEAST) & F.col("split").isNotNull() & F.col("record").isNotNull())


def alike_texts(records: DataFrame) -> DataFrame:
    """``(train_text, eval_text, edits)``: pairs of different texts within EDITS edits, one in train, one in val or test.

    Equal texts are one text. Minwise hashes of letter shingles make band keys; only keys that train and evaluation
    texts share pair them. A pair of edits changes at most four shingle parities each, so the bits in which two 64-bit
    parity signatures differ bound the distance from below; this exact test runs inside the join, before any text is
    fetched. What is left is verified with ``levenshtein`` on the whole texts.
    """
    texts = records.groupBy("letters").agg(F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"))
    texts = cut(spread(texts).select(F.xxhash64("letters").alias("id"), "letters", F.length("letters").alias("n"), "in_train", "in_eval"))
    keyed = texts.select("id", "n", "in_train", "in_eval", _bands("letters").alias("b"))
    rows = keyed.select("id", F.col("n").cast("int").alias("n"), "in_train", "in_eval", F.col("b.signature").alias("sig"), F.explode("b.bands").alias("band"))
    t = rows.where("in_train").select("band", F.col("id").alias("ta"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    e = rows.where("in_eval").select("band", F.col("id").alias("tb"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    near = (F.abs(F.col("na") - F.col("nb")) <= EDITS) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 4 * EDITS)
    found = t.join(e, (t.band == e.band) & near & (F.col("ta") != F.col("tb"))).select("ta", "tb").distinct()
    one = texts.select(F.col("id").alias("ta"), F.col("letters").alias("train_text"))
    two = texts.select(F.col("id").alias("tb"), F.col("letters").alias("eval_text"))
    read = found.join(one, "ta").join(two, "tb")
    read = read.select("train_text", "eval_text", F.levenshtein("train_text", "eval_text", EDITS).alias("edits"))
    return read.where("edits >= 0 and train_text <> eval_text").distinct()


def overlaps(df: DataFrame, record: str = "annotation_id", text: str = "text", split: str = "split") -> DataFrame:
    """``(train_record, eval_record, eval_split, source_image, edits)``: every overlap, each pair of records once.

    ``source_image`` is that of the evaluation record. Records without a known split, a text or an id, and texts under
    LEAST letters and digits do not count. Copies are compared as one text and spread over their records at the end.
    """
    r = cut(_records(df, record, text, split).distinct())
    pairs = alike_texts(r)
    both = r.groupBy("letters").agg(F.max(F.col("split") == "train").alias("t"), F.max(F.col("split") != "train").alias("e")).where("t and e")
    pairs = cut(pairs.unionByName(both.select(F.col("letters").alias("train_text"), F.col("letters").alias("eval_text"), F.lit(0).alias("edits"))))
    t = r.where("split = 'train'").select(F.col("letters").alias("train_text"), F.col("record").alias("train_record")).distinct()
    e = r.where("split <> 'train'").select(F.col("letters").alias("eval_text"), F.col("record").alias("eval_record"), F.col("split").alias("eval_split"), "source_image")
    out = pairs.join(t, "train_text").join(e, "eval_text").where("train_record <> eval_record")
    return out.select("train_record", "eval_record", "eval_split", "source_image", "edits").distinct()


def overlap_report(df: DataFrame) -> DataFrame:
    """``(eval_split, source_image, pairs, exact_pairs, eval_records)``: counts of overlaps per split and source."""
    o = overlaps(df)
    return o.groupBy("eval_split", "source_image").agg(
        F.count_distinct("train_record", "eval_record").alias("pairs"),
        F.count_distinct(F.when(F.col("edits") == 0, F.struct("train_record", "eval_record"))).alias("exact_pairs"),
        F.count_distinct("eval_record").alias("eval_records"),
    )
