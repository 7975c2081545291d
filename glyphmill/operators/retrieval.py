"""Dictionary build, lexical and dense search, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as t


def merge_layers(entries: DataFrame) -> DataFrame:
    """One entry ``(name, key, tag, source, ord)`` per key: highest ``source_rank``, then one with a tag, then first."""
    best = F.min_by(F.struct("name", "tag", "source", "ord"), F.struct(-F.col("source_rank"), (F.coalesce("tag", F.lit("")) == "").cast("int"), "ord"))
    e = entries.where(F.length("key") >= 2).groupBy("key").agg(best.alias("e"))
    return e.select("key", "e.name", "e.tag", "e.source", "e.ord")


def vocabulary(words: DataFrame, least: int) -> DataFrame:
    """``(key, word, freq)``: words by key with at least ``least`` uses and their commonest spelling, the first on ties."""
    n = words.where(F.length("key") >= 2).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("key").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("word"), F.sum("n").alias("freq")).where(F.col("freq") >= least)


def lexical_topk(entries: DataFrame, queries: DataFrame, k: int = 5, min_sim: float = 0.55, pool: int = 200) -> DataFrame:
    """``(query, entry_id, name, key, tag, sim, rank)`` of the ``k`` best entries per query key.

    Entries that share a 2-gram are counted by shared grams; the ``pool`` with the most (then the smallest id) go on,
    less those whose length differs by over half of the longer, to the similarity ``1 - edits / longer``. Final order:
    similarity, tagged first, shorter name, id; one entry per key. Keys under two letters neither ask nor answer.
    """
    e = entries.where(F.length("key") >= 2).select("entry_id", "name", "key", "tag")
    q = queries.where(F.length("query") >= 2).select("query").distinct()
    shared = q.select("query", F.explode(t.bigrams(F.col("query"))).alias("gram")).join(e.select("entry_id", F.explode(t.bigrams(F.col("key"))).alias("gram")), "gram")
    shared = shared.groupBy("query", "entry_id").agg(F.count(F.lit(1)).alias("shared"))
    top = Window.partitionBy("query").orderBy(F.col("shared").desc(), "entry_id")
    cand = shared.withColumn("r", F.row_number().over(top)).where(F.col("r") <= pool).join(e, "entry_id")
    n = F.greatest(F.length("query"), F.length("key"))
    cand = cand.where(F.abs(F.length("query") - F.length("key")) * 2 <= n).withColumn("sim", t.similarity(F.col("query"), F.col("key"))).where(F.col("sim") >= min_sim)
    order = [F.col("sim").desc(), (F.coalesce("tag", F.lit("")) == "").cast("int"), F.length("name"), F.col("entry_id")]
    one = cand.withColumn("r", F.row_number().over(Window.partitionBy("query", "key").orderBy(*order))).where("r = 1")
    out = one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("query", "entry_id", "name", "key", "tag", "sim", "rank")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, dims: slice = slice(None)) -> DataFrame:
    """``(query_id, vec_id, cosine, rank)``: the ``k`` nearest other vectors of each query by cosine, ties by id.

    Queries ``(vec_id, embedding)`` pass over all vectors in blocks of ``block``, the only thing ever sent to the
    tasks; each Arrow batch is one matrix product that keeps its own top k. Zero and null vectors have no neighbours.
    """
    spark, found = vectors.sparkSession, None
    qs = queries.where("embedding is not null").select("vec_id", "embedding").orderBy("vec_id")
    start = None
    while True:
        part = (qs if start is None else qs.where(F.col("vec_id") > start)).limit(block).collect()
        if not part:
            break
        start = part[-1]["vec_id"]
        ids = np.array([r["vec_id"] for r in part])
        m = np.array([r["embedding"] for r in part], dtype=np.float64)[:, dims]
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        held = spark.sparkContext.broadcast((ids[norm[:, 0] > 0], (m / np.where(norm == 0, 1, norm))[norm[:, 0] > 0]))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qi, qm = held.value
            for b in batches:
                b = b[b["embedding"].notna()]
                if not len(b) or not len(qi):
                    continue
                v = np.stack(b["embedding"].to_numpy()).astype(np.float64)[:, dims]
                n = np.linalg.norm(v, axis=1)
                ok = n > 0
                v, vi = v[ok] / n[ok, None], b["vec_id"].to_numpy()[ok]
                s = np.round(qm @ v.T, 9)
                s[qi[:, None] == vi[None, :]] = -2
                order = np.lexsort((np.broadcast_to(vi, s.shape), -s), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(qi)), order.shape[1])
                cols = order.ravel()
                keep = s[rows, cols] > -2
                yield pd.DataFrame({"query_id": qi[rows][keep], "vec_id": vi[cols][keep], "cosine": s[rows, cols][keep]})

        got = vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, cosine double")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, vec_id long, cosine double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(rankings: DataFrame, query: str, entry: str, k: int, constant: int = 10) -> DataFrame:
    """``(query, entry, score, rank)``: reciprocal ranks ``1 / (constant + rank)`` (from 1) summed over rankings, top ``k``."""
    s = rankings.groupBy(query, entry).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    w = Window.partitionBy(query).orderBy(F.round("score", 12).desc(), entry)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hit_at(ranked: DataFrame, query: str, good: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``(k, queries, hits)`` over ``(query, rank, good)`` rows."""
    per = ranked.groupBy(query).agg(F.min(F.when(F.col(good), F.col("rank"))).alias("first"))
    one = per.agg(F.count(F.lit(1)).alias("queries"), *[F.count_if(F.col("first") <= k).alias(f"h{k}") for k in ks])
    return one.select("queries", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("x")).select("x.k", "queries", "x.hits")


def hints(ranked: DataFrame, allowed: list[str], tag_from: float) -> DataFrame:
    """``(query, hint)``: lines ``- name (tag)`` in rank order; a tag shows only if allowed and from ``tag_from`` on."""
    show = F.col("tag").isin(allowed) & (F.col("sim") >= tag_from)
    line = F.concat(F.lit("- "), F.col("name"), F.when(show, F.concat(F.lit(" ("), F.col("tag"), F.lit(")"))).otherwise(""))
    return ranked.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("hint"))
