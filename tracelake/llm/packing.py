"""P7: shortest-pack-first packing over the histogram of lengths.

The packing works on the histogram alone: at most ``capacity`` lengths with their counts. Lengths are
placed longest first, each into the shortest open pack that has room; equal packs are kept as one pattern
with a count. Documents are then joined to their place by their rank within their length.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.encoding import count_tokens
from tracelake.operators.scaling import salted_prefix
from tracelake.session import materialise, read, require_columns

#: Bits for the rank in the combined key (length, rank).
RANK_BITS = 42


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple, int]]:
    """Patterns ``(used, composition, count)``; composition is ``((length, copies), ...)``, longest first.

    Equals placing the items one by one, longest first, into the shortest pack that has room (a new one if
    none has), but does it for all packs of a pattern at once. At most two patterns come up per length.
    """
    open_packs: list[tuple[int, int, tuple, int]] = []
    made = 0

    def push(used: int, composition: tuple, count: int) -> None:
        nonlocal made
        made += 1
        heapq.heappush(open_packs, (used, made, composition, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        if length > capacity:
            raise ValueError("split items above the capacity first")
        left = histogram[length]
        done: list[tuple[int, tuple, int]] = []
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                used, _, composition, count = heapq.heappop(open_packs)
                take = min(count, left)
                copies = composition[-1][1] if composition[-1][0] == length else 0
                grown = (*composition[:-1], (length, copies + 1)) if copies else (*composition, (length, 1))
                # level by level: equal packs all get one more item before any gets a second
                push(used + length, grown, take)
                if count > take:
                    push(used, composition, count - take)
                left -= take
            else:
                per_pack = capacity // length
                full, rest = divmod(left, per_pack)
                if full:
                    done.append((length * per_pack, ((length, per_pack),), full))
                if rest:
                    done.append((length * rest, ((length, rest),), 1))
                left = 0
        for x in done:
            push(*x)
    return [(used, composition, count) for used, _, composition, count in sorted(open_packs)]


def segments(patterns: list[tuple[int, tuple, int]]) -> np.ndarray:
    """Rows ``(key, copies, first container, offset, length)`` by key = length << RANK_BITS | first rank."""
    rows, next_rank, base = [], {}, 0
    for _, composition, count in patterns:
        offset = 0
        for length, copies in composition:
            start = next_rank.get(length, 0)
            rows.append((length << RANK_BITS | start, copies, base, offset, length))
            next_rank[length] = start + copies * count
            offset += length * copies
        base += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", buckets: int | None = None) -> DataFrame:
    """``doc_id, part, n_tokens, container_id, position``: every item's container and place in it.

    An item above ``capacity`` is split into parts of ``capacity`` and a rest, all others stay whole. Items
    of size 0 or null take no room: they come out with a null container. Equal sizes are told apart by id;
    rows repeated under one id are each placed. Containers are numbered from 0 without gaps. An empty
    table gives an empty result. To the driver goes only the histogram, at most ``capacity`` rows.
    """
    require_columns(sizes, id_col, size_col)
    if not 1 <= capacity < 1 << (63 - RANK_BITS):
        raise ValueError(f"capacity must be at least 1 and below {1 << (63 - RANK_BITS)}")
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    items = (
        sizes.select(F.col(id_col), size.alias("__size"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("__size") / capacity).cast("int") - 1))))
        .select(id_col, "part", F.least(F.col("__size") - F.col("part") * F.lit(capacity).cast("long"), F.lit(capacity).cast("long")).alias("n_tokens"))
    )
    histogram = {r["n_tokens"]: r["count"] for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    table = segments(shortest_pack_first(histogram, capacity))
    shared = sizes.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("container_id bigint, position bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        if not len(t):
            return pd.DataFrame({"container_id": [], "position": []}, dtype="int64")
        key = (length.to_numpy(np.int64) << RANK_BITS) | rank.to_numpy(np.int64)
        row = t[np.searchsorted(t[:, 0], key, side="right") - 1]
        nth = key - row[:, 0]
        return pd.DataFrame({"container_id": row[:, 2] + nth // row[:, 1], "position": row[:, 3] + nth % row[:, 1] * row[:, 4]})

    ranked = salted_prefix(items.where("n_tokens > 0"), ["n_tokens"], [id_col, "part"], F.lit(1), "__rank", buckets)
    placed = ranked.withColumn("__at", place("n_tokens", "__rank")).select(id_col, "part", "n_tokens", "__at.container_id", "__at.position")
    none = items.where("n_tokens <= 0").select(id_col, "part", "n_tokens", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("position"))
    return placed.unionByName(none)


def p7_pack(spark: SparkSession, sf_dir: str, capacity: int = 2048) -> DataFrame:
    """The documents, sized in tokens of byte_bpe_50k, in containers of ``capacity``."""
    return pack(materialise(count_tokens(read(spark, sf_dir, "documents"))), capacity)


def p7_report(spark: SparkSession, sf_dir: str, capacity: int = 2048) -> DataFrame:
    """One row: items, containers, tokens, and the share of the containers' room in use."""
    per = p7_pack(spark, sf_dir, capacity).where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("used"), F.max("n_tokens").alias("largest"))
    return per.agg(
        F.sum("n").alias("items"), F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.lit(float(capacity))), 6).alias("used_share"),
    )
