"""Row selection, padding, column union and batches over tables that have an order but no row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.scaling import positions
from tracelake.session import materialise


def select_rows(df: DataFrame, order: Sequence[Column], indices: DataFrame) -> DataFrame:
    """The rows of ``df`` at the places of ``indices`` (one bigint column ``index``, from 0) in ``order``, with their ``index``.

    An index twice gives its row once; one below 0 or beyond the last row is an error, a null index is left out.
    """
    asked = indices.where("index is not null").select("index").distinct()
    numbered = positions(df, order, "index")
    n = numbered.count()
    ends = asked.agg(F.min("index").alias("lo"), F.max("index").alias("hi")).first()
    if ends["lo"] is not None and (ends["lo"] < 0 or ends["hi"] >= n):
        raise ValueError(f"indices {ends['lo']} to {ends['hi']} for {n} rows")
    return numbered.join(asked, "index", "left_semi")


def pad_to_divisor(df: DataFrame, order: Sequence[Column], divisor: int) -> DataFrame:
    """``df`` with ``position`` and ``is_padding``: the rows, then the first ones again, cycled, until ``divisor`` divides their number.

    An empty table stays empty. ``where("not is_padding")`` takes the padding off again.
    """
    numbered = positions(df, order, "position")
    n = numbered.count()
    pad = -n % divisor if n else 0
    more = F.greatest(F.lit(0), F.ceil((F.lit(pad) - F.col("position")) / F.lit(max(n, 1)))).cast("int")
    again = numbered.where(more > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), more))).withColumn("position", F.col("position") + F.col("__k") * n).drop("__k")
    return numbered.withColumn("is_padding", F.lit(False)).unionByName(again.withColumn("is_padding", F.lit(True)))


def column_union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of both tables, row by row of ``keys``, which must be the same on both sides and unique.

    Columns of both sides must hold the same values (null equals null); a row that differs or has no partner
    fails the query when it is computed.
    """
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    other = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__r_{c}") if c in shared else F.col(c) for c in right.columns if c not in keys], F.lit(True).alias("__right"))
    both = left.withColumn("__left", F.lit(True)).join(other, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "full")
    same = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    checked = both.where(F.when(~same, F.raise_error(F.lit("the tables differ in a row or in a column of both")).cast("boolean")).otherwise(True))
    return checked.select(*left.columns, *[c for c in right.columns if c not in left.columns])


def minibatches(df: DataFrame, key: str, size: int, epochs: int, seed: int | None = None) -> DataFrame:
    """``df`` once per epoch with ``epoch``, ``batch`` and ``place``: batches of ``size`` rows, in an order drawn anew for each epoch.

    The order is that of a hash of seed, epoch and ``key`` (unique), or of ``key`` itself without a seed.
    ``size`` must divide the number of rows.
    """
    n = df.count()
    if n % size:
        raise ValueError(f"{n} rows can't be cut into batches of {size}")
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epoch"), F.col(key))) if seed is not None else F.lit("")
    numbered = positions(each.withColumn("__drawn", drawn), [F.asc("epoch"), F.asc("__drawn"), F.asc(key)], "__at")
    at = F.col("__at") % F.lit(max(n, 1))
    return numbered.withColumns({"batch": F.floor(at / size).cast("long"), "place": (at % size).cast("long")}).drop("__drawn", "__at")


def attach_by_index(rows: DataFrame, weights: DataFrame, group: str, index: str = "idx", weight: str = "weight") -> DataFrame:
    """``rows`` with the ``weight`` of the same ``group`` and ``index``; both must have as many rows in every group.

    A missing or superfluous weight is an error.
    """
    counts = lambda t, n: t.groupBy(group).agg(F.count("*").alias(n))
    a, b = counts(rows, "a"), counts(weights, "b").withColumnRenamed(group, "__g")
    off = a.join(b, F.col(group).eqNullSafe(F.col("__g")), "full").where(~F.col("a").eqNullSafe(F.col("b"))).limit(1).count()
    if off:
        raise ValueError("rows and weights don't match in number")
    other = weights.select(F.col(group).alias("__g"), F.col(index).alias("__i"), F.col(weight))
    joined = rows.join(other, F.col(group).eqNullSafe(F.col("__g")) & (F.col(index) == F.col("__i")), "left").drop("__g", "__i")
    return joined.where(F.when(F.col(weight).isNull(), F.raise_error(F.lit("a row has no weight")).cast("boolean")).otherwise(True))


def folded(df: DataFrame, order: Sequence[Column], parts: int) -> DataFrame:
    """``df`` with ``part`` and ``place``: consecutive rows in ``parts`` equal parts; ``parts`` must divide their number."""
    numbered = materialise(positions(df, order, "__at"))
    n = numbered.count()
    if n % parts:
        raise ValueError(f"{n} rows can't be folded into {parts} parts")
    each = max(1, n // parts)
    return numbered.withColumns({"part": F.floor(F.col("__at") / each).cast("long"), "place": (F.col("__at") % each).cast("long")}).drop("__at")


def preview(df: DataFrame) -> DataFrame:
    """``column, dtype, n, n_null, mean, lo, hi``: one row per column; the numbers are null for columns that aren't numeric."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    parts = []
    for i, (c, kind) in enumerate(df.dtypes):
        v = F.col(f"`{c}`")
        x = v.cast("double") if kind in numeric else F.lit(None).cast("double")
        parts.append(F.struct(F.count("*").alias("n"), F.count(F.when(v.isNull(), 1)).alias("n_null"), F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi")).alias(f"c{i}"))
    one = df.agg(*parts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), f"c{i}.*") for i, (c, kind) in enumerate(df.dtypes)])))
