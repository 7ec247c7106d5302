"""Ranks and running sums that don't put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import materialise


def partitions_of(df: DataFrame) -> int:
    """The shuffle partitions that the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one within ``keys``.

    Rows are ordered by a hash bucket of the ``order`` columns, then by ``order``; with ``value`` = 1 it
    is a rank from 0. A group is cut into ``buckets`` parts (by default at least 256, and four for each shuffle
    partition that the cluster is set to), each summed on its own; the parts' totals,
    ``buckets`` rows a group, give the offsets. So a group with a third of all rows still runs in many
    tasks. Null keys form a group of their own, null values count as 0; ``order`` must be unique
    within ``keys`` for a repeatable result, rows that tie get distinct positions in any order.
    """
    buckets = buckets or max(256, 4 * partitions_of(df))
    bucket, val, base = "__bucket", "__value", "__base"
    salted = df.withColumns({bucket: F.pmod(F.xxhash64(*order), F.lit(buckets)), val: F.coalesce(value.cast("long"), F.lit(0).cast("long"))})
    totals = salted.groupBy(*keys, bucket).agg(F.sum(val).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("__b"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn(out, F.coalesce(F.sum(val).over(within), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col(bucket) == F.col("__b")]
    joined = ranked.join(offsets, on)
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(bucket, val, base, "__b", *[f"__k{i}" for i in range(len(keys))])


def ordered_prefix(df: DataFrame, order: str, values: Sequence[str], buckets: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``<value>_before`` for each of ``values``: its sum over all rows of its ``keys`` with a smaller ``order``.

    A running sum over a whole table, or over groups however large, without one task for it: rows fall into ranges
    of ``order`` (numeric, not null, unique within ``keys``) by its quantiles, each summed by itself on top of the
    ranges before. There are at most ``buckets`` of them, by default 64 or as many as the session has shuffle
    partitions. Only the range bounds come to the driver. Null keys form a group of their own; an empty table gives
    an empty result.
    """
    buckets = buckets or max(64, partitions_of(df))
    steps = [(i + 1) / buckets for i in range(buckets - 1)]
    bounds = df.agg(F.percentile_approx(order, steps, 10_000)).first()[0] or []
    bounds = sorted(set(float(b) for b in bounds))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(order).cast("double"))) if bounds else F.lit(0)
    cut = df.withColumn("__range", bucket)
    totals = cut.groupBy(*keys, "__range").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows a key
    mine = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    offsets = totals.select(*mine, F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values])
    within = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col("__range") == F.col("__r"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    out = cut.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(offsets if keys else F.broadcast(offsets), on)
    return out.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"__o_{v}") for v in values}).drop("__range", "__r", *[f"__o_{v}" for v in values], *[f"__k{i}" for i in range(len(keys))])


def positions(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Adds ``out``: the place from 0 of each row in the whole table's ``order``, without sorting it in one task.

    Rows are spread by ranges of ``order``, written, and numbered within their range on top of the ranges
    before, whose sizes are one row a partition. Rows that tie come in any order.
    """
    ranged = materialise(df.repartitionByRange(partitions_of(df), *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn(out, within).join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__p", "__before")


def frequent(counts: DataFrame, n: str, most: int = 20_000) -> DataFrame:
    """The rows of ``counts`` that hold at least one part in ``most`` of the sum of ``n``: so there are at most ``most``."""
    total = counts.agg(F.sum(n).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col(n) * F.lit(most) >= F.col("__total")).drop("__total")


def join_by_frequency(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``table``, one row per ``key``, whose column ``n`` says how often the key comes up.

    The most frequent keys, of which there are few (:func:`frequent`), are broadcast, so that a key with a third of
    all rows isn't shuffled; the others meet in an equi-join. Null keys match nothing.
    """
    hot = frequent(table, n)
    left = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    extra = [c for c in table.columns if c != key]
    rest = left.where("__hot is null").drop("__hot", *extra).join(table, key)
    return left.where("__hot").drop("__hot").unionByName(rest)
