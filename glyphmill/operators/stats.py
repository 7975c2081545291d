"""Paired bootstrap over photos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_bootstrap(per: DataFrame, unit: str, resamples: int = 2000, seed: int = 11) -> DataFrame:
    """``(diff, lo, hi, units)`` of ``sum(num_a)/sum(den_a) - sum(num_b)/sum(den_b)`` with a 95 % percentile interval.

    Every unit gets a Poisson(1) weight per resample from a hash of its id, the same for both sides, so resamples need
    no shuffle of units: tasks add up weighted sums and only ``resamples`` rows per task are combined.
    """
    cols = ["num_a", "den_a", "num_b", "den_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((resamples, 4))
        for b in batches:
            v = b[cols].to_numpy(dtype=float)
            for row, h in zip(v, b["_h"].to_numpy(), strict=True):
                total += np.random.default_rng([seed, int(h) & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, resamples)[:, None] * row
        yield pd.DataFrame(np.column_stack([np.arange(resamples), total]), columns=["b", *cols])

    sums = per.select(F.xxhash64(unit).alias("_h"), *[F.col(c).cast("double").alias(c) for c in cols])
    s = sums.mapInPandas(run, "b double, num_a double, den_a double, num_b double, den_b double").groupBy("b").agg(*[F.sum(c).alias(c) for c in cols])
    r = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    d = s.select((r("num_a", "den_a") - r("num_b", "den_b")).alias("d")).agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"))
    p = per.agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("units")).select((r("num_a", "den_a") - r("num_b", "den_b")).alias("diff"), "units")
    return p.crossJoin(F.broadcast(d)).select("diff", "lo", "hi", "units")
