"""The bundle of lexical metrics by name, and rewards by profile name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import reward as W
from tracelake.functions import similarity as X
from tracelake.functions import text as T
from tracelake.functions.kernels import greedy_coverage, lcs, shared_ngrams

#: Name of a metric and how to build it from the token arrays ``rt`` and ``ct``.
BUNDLE = {
    "lexical_token_overlap": lambda: X.jaccard(F.col("rt"), F.col("ct")),
    "lexical_token_overlap_ref": lambda: X.overlap_ref_set(F.col("rt"), F.col("ct")),
    "lexical_lcs_ratio": lambda: X.ratio(lcs("rt", "ct"), F.size("rt")),
    "lexical_lcs_ratio_cand": lambda: X.ratio(lcs("rt", "ct"), F.size("ct")),
    "length_ratio": lambda: X.length_ratio(F.col("rt"), F.col("ct")),
    "lexical_ngram_coverage": lambda: X.ratio(greedy_coverage("rt", "ct")["covered"], F.size("ct")),
    "lexical_ngram_coverage_ref": lambda: X.ratio(greedy_coverage("ct", "rt")["covered"], F.size("rt")),
    "lexical_unique_ngram_coverage": lambda: X.ratio(shared_ngrams("rt", "ct")["both"], shared_ngrams("rt", "ct")["cand"]),
    "lexical_unique_ngram_coverage_ref": lambda: X.ratio(shared_ngrams("rt", "ct")["both"], shared_ngrams("rt", "ct")["ref"]),
}


def lexical_metrics(pairs: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys`` and the metrics of ``names`` over token arrays ``rt`` and ``ct``; what isn't asked for isn't computed."""
    unknown = [n for n in names if n not in BUNDLE]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return pairs.select(*keys, *[F.round(BUNDLE[n](), 6).alias(n) for n in names])


def profiled(name: str) -> Column:
    """The reward of the profile ``name`` over columns ``rt, ct, ref, cand`` and the membership weight ``w``.

    A profile names its metrics, the threshold of its length penalty, and its weighting; a null weight gives a null
    reward where one is used. Adaptive matching, which needs all references of a sample, is :func:`reward.adaptive_match`.
    """
    p = W.profile(name)
    if "adaptive" in p:
        raise ValueError(f"{name} needs all references of a sample")
    full = {m: m if m in BUNDLE else f"lexical_{m}" for m in p["weights"]}
    unknown = [m for m in full.values() if m not in BUNDLE]
    if unknown:
        raise ValueError(f"unknown profile: {name}")
    penalty = W.length_penalty(F.size(T.words(F.col("ref"))), F.size(T.words(F.col("cand"))), p["penalty"], p["threshold"])
    score = W.profile_score({m: BUNDLE[full[m]]() for m in full}, p["weights"], penalty)
    return W.membership_weight(score, F.col("w"), p["weighting"], invert=True) if "weighting" in p else score
