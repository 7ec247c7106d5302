"""Ranking metrics of scores against a boolean label, from counts per distinct score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.scaling import ordered_prefix, partitions_of
from tracelake.session import materialise


def finite(score: Column) -> Column:
    """Null, NaN and infinite scores count as 0."""
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(s)


def thresholds(scored: DataFrame, score: str = "score", label: str = "is_member") -> DataFrame:
    """``score, pos, neg, tp, fp``: per distinct score, highest first, what is counted down to it.

    Rows with a null label are left out. An empty table gives an empty result.
    """
    per = scored.where(F.col(label).isNotNull()).groupBy(finite(F.col(score)).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((~F.col(label)).cast("long")).alias("neg")
    )
    # read several times below: the range bounds, the ranges' totals and the running sums
    run = ordered_prefix(materialise(per.withColumn("__down", -F.col("score"))), "__down", ["pos", "neg"])
    return run.select("score", "pos", "neg", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))


def auroc(scored: DataFrame, score: str = "score", label: str = "is_member") -> DataFrame:
    """One row ``n_members, n_nonmembers, auroc``; ties count half, a missing class gives a null auroc."""
    t = thresholds(scored, score, label)
    wins = F.sum(F.col("neg") * (2 * (F.col("tp") - F.col("pos")) + F.col("pos")))
    p, n = F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))
    return t.agg(p.alias("n_members"), n.alias("n_nonmembers"), F.round(F.try_divide(wins.cast("double"), F.nullif((2 * p * n).cast("double"), F.lit(0.0))), 6).alias("auroc"))


def roc_curve(scored: DataFrame, score: str = "score", label: str = "is_member") -> DataFrame:
    """``score, fpr, tpr`` at every distinct score."""
    t = thresholds(scored, score, label)
    total = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.crossJoin(F.broadcast(total)).select("score", F.round(F.col("fp") / F.col("n"), 6).alias("fpr"), F.round(F.col("tp") / F.col("p"), 6).alias("tpr"))


def pr_auc(scored: DataFrame, score: str = "score", label: str = "is_member") -> DataFrame:
    """One row ``pr_auc``: trapezoids under precision over recall, starting from (0, 1)."""
    t = thresholds(scored, score, label)
    prec = lambda tp, fp: F.col(tp) / (F.col(tp) + F.col(fp))
    t = t.withColumns({"tp0": F.col("tp") - F.col("pos"), "fp0": F.col("fp") - F.col("neg")})
    before = F.when(F.col("tp0") + F.col("fp0") == 0, 1.0).otherwise(F.try_divide(F.col("tp0"), F.col("tp0") + F.col("fp0")))
    return t.agg(F.round(F.sum(F.col("pos") * (prec("tp", "fp") + before) / 2) / F.sum("pos"), 6).alias("pr_auc"))


def tpr_at_fpr(scored: DataFrame, bounds: list[float], score: str = "score", label: str = "is_member") -> DataFrame:
    """``bound, tpr``: the highest true positive rate at a false positive rate of at most ``bound``, else 0."""
    t = thresholds(scored, score, label)
    total = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    r = t.crossJoin(F.broadcast(total)).select((F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))
    best = r.agg(*[F.coalesce(F.max(F.when(F.col("fpr") <= b, F.col("tpr"))), F.lit(0.0)).alias(f"b{i}") for i, b in enumerate(bounds)])
    return best.select(F.inline(F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.round(F.col(f"b{i}"), 6).alias("tpr")) for i, b in enumerate(bounds)])))


def bootstrap_auroc(scored: DataFrame, replicates: int = 200, seed: int = 0, score: str = "score", label: str = "is_member", buckets: int | None = None) -> DataFrame:
    """One row ``low, high``: 95 % percentile interval over ``replicates`` Poisson resamples.

    A row drawn with replacement comes up a Poisson number of times; so do the members and non-members of a
    distinct score, together. The draws are made on these counts, range by range of the score; what leaves a
    range is one row per replicate. Rows with a null label are left out; without both classes the ends are null.
    """
    per = scored.where(F.col(label).isNotNull()).groupBy(finite(F.col(score)).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((~F.col(label)).cast("long")).alias("neg")
    )
    per = materialise(per)
    buckets = buckets or max(64, partitions_of(per))
    bounds = per.agg(F.percentile_approx("score", [(i + 1) / buckets for i in range(buckets - 1)], 10_000)).first()[0] or []
    ranged = per.withColumn("part", F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]), lambda b: b < F.col("score"))) if bounds else F.lit(0))
    rows = 4096

    def draw(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("score", ascending=False)
        rng = np.random.default_rng([seed, int(key[0])])
        wins, above, members, others = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        for lo in range(0, len(f), rows):
            pos = rng.poisson(f["pos"].to_numpy()[lo : lo + rows, None], (min(rows, len(f) - lo), replicates)).astype(float)
            neg = rng.poisson(f["neg"].to_numpy()[lo : lo + rows, None], (min(rows, len(f) - lo), replicates)).astype(float)
            before = above + np.cumsum(pos, axis=0) - pos
            wins += (neg * (before + 0.5 * pos)).sum(0)
            above = above + pos.sum(0)
            members, others = above, others + neg.sum(0)
        return pd.DataFrame({"part": int(key[0]), "replicate": np.arange(replicates), "wins": wins, "pos": members, "neg": others})

    parts = ranged.groupBy("part").applyInPandas(draw, "part int, replicate int, wins double, pos double, neg double")
    higher = Window.partitionBy("replicate").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    above = parts.withColumn("above", F.coalesce(F.sum("pos").over(higher), F.lit(0.0)))
    one = above.groupBy("replicate").agg(F.try_divide(F.sum(F.col("wins") + F.col("neg") * F.col("above")), F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("a"))
    return one.agg(F.round(F.percentile("a", 0.025), 6).alias("low"), F.round(F.percentile("a", 0.975), 6).alias("high"))


def minmax(df: DataFrame, columns: list[str], constant: float = 0.0) -> DataFrame:
    """Each of ``columns`` mapped to 0..1 over the whole table; a constant column becomes ``constant``."""
    ends = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])
    both = df.crossJoin(F.broadcast(ends))
    scale = lambda c: F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).when(F.col(c).isNotNull(), F.lit(constant))
    return both.withColumns({c: scale(c) for c in columns}).drop(*[f"__{e}_{c}" for e in ("lo", "hi") for c in columns])


def reweighted(df: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """``df`` with ``weighted_<c>``, the product with ``weight``, for every numeric column but keys and weight."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    columns = [c for c, kind in df.dtypes if kind in numeric and c not in (*keys, weight) and not c.startswith("weighted_")]
    return df.withColumns({f"weighted_{c}": F.round(F.col(c) * F.col(weight), 6) for c in columns})


def paired_scores(members: DataFrame, nonmembers: DataFrame, score: str = "score", higher_is_member: bool = False) -> DataFrame:
    """``score, is_member``: two tables of scores as one; what isn't finite counts as 0, and the sign is turned unless higher means member."""
    value = finite(F.col(score)) if higher_is_member else -finite(F.col(score))
    side = lambda t, m: t.select(value.alias("score"), F.lit(m).alias("is_member"))
    return side(members, True).unionByName(side(nonmembers, False))
