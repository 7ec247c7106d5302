"""Balanced partitions of sequences by length, batch by batch."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.scaling import salted_prefix


def largest_differencing(lengths: list[int], k: int) -> list[int]:
    """Part numbers by the largest differencing method: the two most uneven partial solutions are merged, heaviest part with lightest."""
    if not lengths:
        return []
    heap = []
    for i, n in enumerate(lengths):
        parts = [(0, [])] * (k - 1) + [(n, [i])]
        heapq.heappush(heap, (-(n if k > 1 else 0), i, parts))
    count = len(lengths)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: t[0])
        heapq.heappush(heap, (-(both[-1][0] - both[0][0]), count, both))
        count += 1
    out = [0] * len(lengths)
    for part, (_, members) in enumerate(heap[0][2]):
        for i in members:
            out[i] = part
    return out


def equal_sized(lengths: list[int], k: int) -> list[int]:
    """Part numbers by largest differencing with as many sequences in every part; ``k`` must divide their number.

    The sequences start as layers of ``k`` neighbours in length, one for each part, so every merge keeps the numbers even.
    """
    if len(lengths) % k:
        raise ValueError(f"{len(lengths)} sequences can't be cut into {k} parts of equal number")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    heap = []
    for at in range(0, len(order), k):
        layer = [(lengths[i], [i]) for i in order[at : at + k]]
        heapq.heappush(heap, (-(layer[-1][0] - layer[0][0]), at, layer))
    count = len(order)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: t[0])
        heapq.heappush(heap, (-(both[-1][0] - both[0][0]), count, both))
        count += 1
    out = [0] * len(lengths)
    for part, (_, members) in enumerate(heap[0][2] if heap else []):
        for i in members:
            out[i] = part
    return out


def greedy(lengths: list[int], k: int) -> list[int]:
    """Part numbers by putting the longest left into the lightest part."""
    heap, out = [(0, p) for p in range(k)], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        total, p = heapq.heappop(heap)
        out[i] = p
        heapq.heappush(heap, (total + lengths[i], p))
    return out


def balanced(df: DataFrame, key: str, length: str, batch_rows: int, parts: int | None = None, budget: int | None = None) -> DataFrame:
    """``key, length, batch_no, part, part_greedy``: batches of ``batch_rows`` rows, each divided into even parts.

    ``parts`` is given, or follows from a token ``budget`` as ``ceil(sum / budget)``. Batches are cut by a
    salted rank, so none is larger than ``batch_rows``. Null lengths count as 0; an empty table gives none.
    """
    kinds = dict(df.dtypes)
    ranked = salted_prefix(df.select(key, F.coalesce(F.col(length).cast("long"), F.lit(0)).alias(length)), [], [key], F.lit(1), "__rank")
    batched = ranked.select(key, length, F.floor(F.col("__rank") / batch_rows).cast("long").alias("batch_no"))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        n = pdf[length].tolist()
        k = min(len(n), parts or max(1, -(-sum(n) // budget)))
        return pd.DataFrame({key: pdf[key], length: pdf[length], "batch_no": pdf["batch_no"], "part": largest_differencing(n, k), "part_greedy": greedy(n, k)})

    return batched.groupBy("batch_no").applyInPandas(divide, f"`{key}` {kinds[key]}, `{length}` bigint, batch_no bigint, part int, part_greedy int")


def batches_until_full(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of ``size`` rows from an iterator, the last one shorter."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
