"""Grouped numerics of policy-gradient batches: sequence rewards per group, and token rows per sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def with_group_stats(df: DataFrame, group: str, aggs: dict[str, Column]) -> DataFrame:
    """``df`` with the groups' aggregates joined on.

    An aggregate with a map-side part and a join instead of a window: a group with a tenth of the rows is
    never sorted in one task. Rows with a null group form one group.
    """
    g = df.groupBy(F.col(group).alias("__g")).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(g, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def group_normalised(df: DataFrame, group: str = "uid", reward: str = "r", by_std: bool = True) -> DataFrame:
    """``(r - mean) / (std + eps)`` with the sample deviation; a group of one has mean 0 and deviation 1."""
    r = F.col(reward)
    s = with_group_stats(df, group, {"__n": F.count(reward), "__m": F.avg(reward), "__s": F.stddev_samp(reward)})
    m, d = F.when(F.col("__n") > 1, F.col("__m")).otherwise(0.0), F.when(F.col("__n") > 1, F.col("__s")).otherwise(1.0)
    return s.withColumn("advantage", (r - m) / (d + EPS) if by_std else r - m).drop("__n", "__m", "__s")


def leave_one_out(df: DataFrame, group: str = "uid", reward: str = "r") -> DataFrame:
    """Reward minus the mean of the others of its group; alone, the reward itself."""
    s = with_group_stats(df, group, {"__n": F.count(reward), "__m": F.avg(reward)})
    n = F.col("__n")
    return s.withColumn("advantage", F.when(n > 1, F.col(reward) * n / (n - 1) - F.col("__m") * n / (n - 1)).otherwise(F.col(reward))).drop("__n", "__m")


def length_weighted(df: DataFrame, group: str = "uid", reward: str = "r", length: str = "len") -> DataFrame:
    """Reward minus the length-weighted mean of its group (0 where all lengths are 0)."""
    s = with_group_stats(df, group, {"__b": F.try_divide(F.sum(F.col(reward) * F.col(length)), F.nullif(F.sum(length).cast("double"), F.lit(0.0)))})
    return s.withColumn("advantage", F.col(reward) - F.coalesce("__b", F.lit(0.0))).drop("__b")


def best_over_second(df: DataFrame, key: str, group: str = "uid", reward: str = "r") -> DataFrame:
    """Only the best of a group gets the lead over the second best; ties go to the smallest ``key``. Groups of one get 0."""
    # the two highest rewards by two map-side maxima: the best row, then the best of the rest
    best = with_group_stats(df, group, {"__best": F.min_by(key, F.struct(-F.col(reward), F.col(key))), "__max": F.max(reward), "__n": F.count(reward)})
    rest = with_group_stats(best, group, {"__second": F.max(F.when(F.col(key) != F.col("__best"), F.col(reward)))})
    return rest.withColumn("advantage", F.when((F.col(key) == F.col("__best")) & (F.col("__n") > 1), F.col("__max") - F.col("__second")).otherwise(0.0)).drop("__best", "__max", "__n", "__second")


def softmean_baseline(df: DataFrame, beta: float, group: str = "uid", reward: str = "r") -> DataFrame:
    """``ln(mean(exp(beta * r))) / beta`` per group, shifted by the maximum; the mean for beta 0."""
    if beta == 0:
        return with_group_stats(df, group, {"baseline": F.avg(reward)})
    s = with_group_stats(df, group, {"__x": F.max(reward)})
    s = with_group_stats(s, group, {"__e": F.avg(F.exp(beta * (F.col(reward) - F.col("__x"))))})
    return s.withColumn("baseline", F.log("__e") / beta + F.col("__x")).drop("__x", "__e")


def returns_to_go(tokens: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted sum of rewards from each token of a sequence to its end, over rows of unmasked tokens."""
    w = Window.partitionBy("seq").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = F.sum(F.col("rew") * F.col("mask") * F.pow(F.lit(gamma), F.col("pos"))).over(w)
    return tokens.withColumn("ret", scaled / F.pow(F.lit(gamma), F.col("pos")))


def gae(tokens: DataFrame, gamma: float, lam: float) -> DataFrame:
    """``seq, pos, advantage, ret``: generalised advantage estimates by a backward fold over each sequence.

    A sequence is an array as long as its answer, folded inside the JVM.
    """
    step = F.struct("pos", "rew", "val")
    seqs = tokens.groupBy("seq").agg(F.sort_array(F.collect_list(step), asc=False).alias("steps"))
    zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("next"), F.array().cast("array<struct<pos:int,advantage:double,ret:double>>").alias("out"))

    def fold(acc, x):
        adv = x["rew"] + gamma * acc["next"] - x["val"] + gamma * lam * acc["last"]
        item = F.struct(x["pos"].cast("int").alias("pos"), adv.alias("advantage"), (adv + x["val"]).alias("ret"))
        return F.struct(adv.alias("last"), x["val"].alias("next"), F.concat(acc["out"], F.array(item)).alias("out"))

    return seqs.select("seq", F.explode(F.aggregate("steps", zero, fold)["out"]).alias("o")).select("seq", "o.*")


def masked_mean(x: Column, mask: Column) -> Column:
    return F.sum(x * mask) / (F.sum(mask) + 1e-8)


def whitened(df: DataFrame, column: str, mask: str = "mask") -> DataFrame:
    """``column`` minus its masked mean over its masked deviation (Bessel's correction)."""
    x, m = F.col(column), F.col(mask)
    mean = masked_mean(x, m)
    one = df.agg(mean.alias("__m"), (masked_mean(x * x, m) - mean * mean).alias("__v"), F.sum(m).alias("__n"))
    v = F.col("__v") * F.col("__n") / (F.col("__n") - 1)
    return df.crossJoin(F.broadcast(one)).withColumn("white", (x - F.col("__m")) / F.sqrt(v + 1e-8)).drop("__m", "__v", "__n")


def kl_estimate(lp: Column, ref: Column, kind: str) -> Column:
    """Per-token estimates of the divergence: k1, abs, k2, k3 (clamped)."""
    if kind == "k1":
        return lp - ref
    if kind == "abs":
        return F.abs(lp - ref)
    if kind == "k2":
        return 0.5 * (lp - ref) * (lp - ref)
    k = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), ref - lp))
    return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(k) - k - 1))


def policy_loss(old: Column, new: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> tuple[Column, Column, Column]:
    """Clipped surrogate loss with dual clipping, and whether the upper and the lower clip took hold."""
    ratio = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), new - old)))
    a, b = -adv * ratio, -adv * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    clipped = F.greatest(a, b)
    least = F.least(-adv * dual, clipped)
    return F.when(adv < 0, least).otherwise(clipped), (b > a).cast("int"), ((clipped > -adv * dual) & (adv < 0)).cast("int")


def value_loss(val: Column, old: Column, ret: Column, clip: float) -> tuple[Column, Column]:
    inside = F.greatest(old - clip, F.least(old + clip, val))
    a, b = (val - ret) * (val - ret), (inside - ret) * (inside - ret)
    return 0.5 * F.greatest(a, b), (b > a).cast("int")


#: Estimators by name; each adds ``advantage`` to rows of sequences.
ESTIMATORS = {"grpo": group_normalised, "rloo": leave_one_out, "opo": length_weighted}


def register(name: str):
    """Adds an estimator under ``name``; taking a name twice is an error."""

    def add(f):
        if name in ESTIMATORS and ESTIMATORS[name] is not f:
            raise ValueError(f"estimator {name} is taken")
        ESTIMATORS[name] = f
        return f

    return add
