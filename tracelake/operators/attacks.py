"""Membership scores by name: each takes rows ``doc_id, pos, tok, lp`` of scored tokens and gives ``doc_id, score``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_loss(tokens: DataFrame) -> DataFrame:
    """Minus the mean log-probability."""
    return tokens.groupBy("doc_id").agg((-F.avg("lp")).alias("score"))


def lowest_windows(tokens: DataFrame, value: str = "lp", share: float = 0.2, window: int = 1, stride: int = 1) -> DataFrame:
    """Minus the mean of the lowest ``max(1, int(n * share))`` window means of each document.

    Windows of ``window`` tokens begin every ``stride`` tokens; a document shorter than a window has no score. One
    document's tokens are ordered together, never those of several.
    """
    at = Window.partitionBy("doc_id").orderBy("pos")
    ahead = at.rowsBetween(Window.currentRow, window - 1)
    means = tokens.select("doc_id", "pos", F.round(F.avg(value).over(ahead), 9).alias("m"), F.count("*").over(ahead).alias("__n"))
    means = means.where((F.col("__n") == window) & (F.col("pos") % stride == 0))
    ranked = means.select("doc_id", "m", F.row_number().over(Window.partitionBy("doc_id").orderBy("m", "pos")).alias("rn"), F.count("*").over(Window.partitionBy("doc_id")).alias("n"))
    low = ranked.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share))))
    return low.groupBy("doc_id").agg((-F.avg("m")).alias("score"))


def standardised(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """``tokens`` with ``z``: the log-probability in deviations from the mean of ``model`` (``lp`` of every token it knows)."""
    mu = F.sum(F.exp("lp") * F.col("lp"))
    moments = model.agg(mu.alias("__mu"), F.sqrt(F.sum(F.exp("lp") * F.col("lp") * F.col("lp")) - F.pow(mu, F.lit(2))).alias("__sd"))
    return tokens.crossJoin(F.broadcast(moments)).withColumn("z", (F.col("lp") - F.col("__mu")) / (F.col("__sd") + 1e-12)).drop("__mu", "__sd")


# The names that each score goes by.
ALIASES = {
    "loss": ("loss",),
    "ref": ("ref", "reference", "reference_based"),
    "zlib": ("zlib",),
    "min_k": ("min_k", "min-k", "min-k%", "mink"),
    "min_k++": ("min_k++", "min-k++", "mink++"),
    "gradnorm": ("gradnorm", "grad-norm"),
}


def canonical(name: str) -> str:
    """The score that ``name`` stands for; a ValueError for an unknown one."""
    for own, names in ALIASES.items():
        if name.lower() in names:
            return own
    raise ValueError(f"unknown score: {name}")


def attack(name: str, share: float = 0.2, window: int = 1, stride: int = 1) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The score called ``name`` as a function of tokens and model; those that need a model's gradients aren't here."""
    own = canonical(name)
    if own == "loss":
        return lambda tokens, model: mean_loss(tokens)
    if own == "min_k":
        return lambda tokens, model: lowest_windows(tokens, "lp", share, window, stride)
    if own == "min_k++":
        return lambda tokens, model: lowest_windows(standardised(tokens, model), "z", share)
    raise ValueError(f"{own} needs more than token log-probabilities")
