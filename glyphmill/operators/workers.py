"""Calls of an outside recogniser or model inside Arrow batches: retry, call budget, abort, no item ever dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_worker(items: DataFrame, key: str, path: str, make: Callable[[], Callable[[str], tuple[str, float]]], tries: int = 3, most_failures: int = 20, budget: int | None = None) -> DataFrame:
    """``(key, text, score)`` for every row of ``items``: what the function that ``make`` builds, once per task, says of ``path``.

    A call that fails is repeated up to ``tries`` times; an item that still fails has the text "" and the score 0. After
    ``most_failures`` items in a row have failed the task, and so the job, ends with an error. With a ``budget`` the items
    are counted first and nothing is called if there are more.
    """
    if budget is not None and items.limit(budget + 1).count() > budget:
        raise ValueError(f"more than {budget} calls would be made")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, failed = make(), 0
        for batch in batches:
            out = []
            for p in batch[path]:
                got = None
                for _ in range(tries):
                    try:
                        got = call(p)
                        break
                    except Exception:  # noqa: BLE001  whatever the recogniser raises
                        continue
                failed = 0 if got is not None else failed + 1
                if failed >= most_failures:
                    raise RuntimeError(f"{failed} items in a row have failed")
                out.append(got or ("", 0.0))
            yield pd.DataFrame({key: batch[key], "text": [t for t, _ in out], "score": [float(s) for _, s in out]})

    return items.select(key, path).mapInPandas(run, f"`{key}` {dict(items.dtypes)[key]}, text string, score double")


def embed(texts: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], chunk: int = 64) -> DataFrame:
    """``(key, embedding)``: vectors of length 1. A chunk that the model refuses is halved until it is taken; a single text
    that is refused, null or empty has a null vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def vectors(part: list[str]) -> list:
            try:
                v = np.asarray(call(part), dtype=float)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                return [x if ok else None for x, ok in zip((v / np.where(n == 0, 1, n)).tolist(), n[:, 0] > 0, strict=True)]
            except ValueError:
                if len(part) == 1:
                    return [None]
                half = len(part) // 2
                return vectors(part[:half]) + vectors(part[half:])

        for batch in batches:
            out: list = [None] * len(batch)
            full = [i for i, t in enumerate(batch[text]) if t]
            for at in range(0, len(full), chunk):
                part = full[at : at + chunk]
                for i, v in zip(part, vectors([batch[text].iloc[i] for i in part]), strict=True):
                    out[i] = v
            yield pd.DataFrame({key: batch[key], "embedding": out})

    return texts.select(key, F.col(text).alias(text)).mapInPandas(run, f"`{key}` {dict(texts.dtypes)[key]}, embedding array<double>")
