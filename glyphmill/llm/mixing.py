"""Problem 8: mix sources to target weights under a repetition limit."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.tokens import token_counts
from glyphmill.operators.lineage import cut


def tempered(base: list[float], exponent: float) -> list[float]:
    """Weights proportional to ``base ** exponent``; a weight of 0 stays 0."""
    raised = [math.exp(exponent * math.log(b)) if b > 0 else 0.0 for b in base]
    total = sum(raised)
    return [r / total if total else 0.0 for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def exponent_for_entropy(shares: list[float], target: float, steps: int = 60) -> float:
    """The exponent in [0, 8] that gives ``shares`` the entropy ``target``, bisected; the nearer end if none does."""
    low, high = 0.0, 8.0
    for _ in range(steps):
        mid = (low + high) / 2
        if entropy(tempered(shares, mid)) > target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def weights_within(target: list[float], room: list[float], total: float, steps: int = 60) -> tuple[list[float], float]:
    """``(weights, exponent)``: as near to ``target`` as the repetition limit lets a mix of ``total`` tokens be.

    ``room`` is what each source can give at most. Weights are ``target ** x * room ** (1 - x)``, normalised: at x = 1
    the target, at x = 0 proportional to the room, which any total up to the sum of the room fits. The greatest x that
    keeps every source within its room is bisected. Sources without room or target have weight 0.
    """
    live = [i for i, (t, r) in enumerate(zip(target, room, strict=True)) if t > 0 and r > 0]
    if not live:
        return [0.0] * len(target), 1.0
    total = min(total, sum(room[i] for i in live))

    def at(x: float) -> list[float]:
        logs = [x * math.log(target[i]) + (1 - x) * math.log(room[i]) for i in live]
        top = max(logs)
        raised = [math.exp(v - top) for v in logs]
        return [v / sum(raised) for v in raised]

    def fits(w: list[float]) -> bool:
        return all(v * total <= room[i] * (1 + 1e-12) for v, i in zip(w, live, strict=True))

    low, high = 0.0, 1.0
    if fits(at(1.0)):
        low = 1.0
    else:
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(at(mid)) else (low, mid)
    out = [0.0] * len(target)
    for v, i in zip(at(low), live, strict=True):
        out[i] = v
    return out, low


def running_total(df: DataFrame, groups: list[str], order: list[Column], value: str, out: str, bits: int = 8) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row of its group, by ``order``, a 64-bit hash first.

    As ``rank_in_groups``: sums inside ``2**bits`` blocks of the hash range plus the totals of the blocks before.
    """
    keyed = df.withColumn("_h", order[0]).withColumn("_b", F.shiftright("_h", 64 - bits))
    keyed = keyed.withColumn("_s", F.sum(value).over(Window.partitionBy(*groups, "_b").orderBy(F.col("_h"), *order[1:]).rowsBetween(Window.unboundedPreceding, 0)))
    n = keyed.groupBy(*groups, "_b").agg(F.sum(value).alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    names = {g: f"_g{i}" for i, g in enumerate(groups)}
    n = n.select(*[F.col(g).alias(x) for g, x in names.items()], F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    on = reduce(lambda p, q: p & q, [keyed[g] == n[x] for g, x in names.items()], keyed["_b"] == n["_b2"])
    return keyed.join(n, on).withColumn(out, F.col("_s") + F.col("_before")).drop("_h", "_b", "_b2", "_s", "_before", *names.values())


def mix(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 7, path: str | None = None, target_entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(drawn, shares)``: ``drawn (source, doc_id, tokens, uses)`` and what each source makes up.

    ``targets`` is ``(source, target_share, max_repeats)``. Without ``total`` the mix is as large as the repetition
    limits allow with every source that has text at its exact target share; with it, weights are tempered (see
    ``weights_within``) until ``total`` tokens fit; ``"corpus"`` stands for the tokens that the wanted sources hold. With
    ``target_entropy`` (in nats) the wanted shares are replaced by the sources' own token shares raised to the exponent
    that gives them this entropy, or the nearest they can have; it is reported instead of the exponent of the limit, which
    then also applies. A source whose share is wanted but that has no tokens gives
    nothing, its share is spread over the others in proportion, and the report shows 0. Whole passes over a source
    come first; the rest of its budget is a prefix of a permutation in hash blocks and the one document whose size comes
    nearest to what the prefix leaves. Documents without tokens and of sources without a target are not drawn; a null
    ``max_repeats`` means 1; repeated rows of a document count once. Only the per-source totals (one row per target)
    reach the driver.
    """
    spark = documents.sparkSession
    sized = token_counts(documents.where("doc_id is not null"), ["doc_id", "source"], "text", path).where("tokens > 0").distinct()
    goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    sized = cut(sized.join(goal.select("source"), "source", "left_semi"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"))
    rows = goal.join(have, "source", "left").orderBy("source").collect()
    share = [float(r["share"]) for r in rows]
    held = [int(r["have"] or 0) for r in rows]
    heat = None
    if target_entropy is not None and sum(held):
        own = [h / sum(held) for h in held]
        heat = exponent_for_entropy(own, target_entropy)
        share = tempered(own, heat)
    if total == "corpus":
        total = float(sum(held))
    room = [h * max(int(r["most"]), 0) for h, r in zip(held, rows, strict=True)]
    live = sum(s for s, r in zip(share, room, strict=True) if r > 0)
    most = min((r * live / s for s, r in zip(share, room, strict=True) if r > 0), default=0.0)
    weights, exponent = weights_within(share, room, most if total is None else total)
    size = min(most if total is None else total, float(sum(room)))
    exponent = exponent if heat is None else heat
    plan = []
    for r, w, h, top in zip(rows, weights, held, room, strict=True):
        budget = min(w * size, float(top))
        passes = int(budget // h) if h else 0
        plan.append((r["source"], passes, budget - passes * h, int(r["most"])))
    plan = spark.createDataFrame(plan, "source string, passes int, rest double, most int")
    placed = running_total(sized, ["source"], [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")], "tokens", "_sum")
    placed = cut(placed.join(plan, "source").withColumn("_in", F.col("_sum") <= F.col("rest")))
    gap = placed.groupBy("source").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("_in"), F.col("_sum"))), F.lit(0))).alias("gap"))
    off = F.abs(F.col("tokens") - F.col("gap"))
    fill = placed.where(~F.col("_in") & (F.col("passes") < F.col("most"))).join(gap, "source").where(off < F.col("gap"))
    fill = fill.groupBy("source").agg(F.min_by("doc_id", F.struct(off, "_sum")).alias("_fill"))
    uses = F.col("passes") + F.when(F.col("_in") | (F.col("doc_id") == F.col("_fill")), 1).otherwise(0)
    drawn = placed.join(fill, "source", "left").select("source", "doc_id", "tokens", F.least(uses, "most").cast("int").alias("uses")).where("uses > 0")
    drawn = cut(drawn)
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("draws"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    whole = drawn.agg(F.sum(F.col("tokens") * F.col("uses")).alias("all_tokens"))
    wanted = spark.createDataFrame([(r["source"], s, w, exponent) for r, s, w in zip(rows, share, weights, strict=True)], "source string, target_share double, weight double, exponent double")
    shares = wanted.join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "weight", "exponent",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "draws", "tokens", "most_uses")],
        F.when(F.col("all_tokens") > 0, F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).otherwise(0.0).alias("share"),
    )
    return drawn, shares
