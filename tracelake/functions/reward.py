"""Length penalties, weights and reward profiles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.similarity import length_similarity, ratio

POWERS = {"ratio": 1.0, "sqrt": 0.5, "quadratic": 2.0, "super-quadratic": 2.5, "cubic": 3.0}


def length_penalty(ref_len: Column, cand_len: Column, kind: str = "none", threshold: float = 1.5) -> Column:
    """Factor from 0 to 1: 1 within ``1/threshold..threshold`` of the reference's length, less beyond.

    Two empty texts get 1, an empty reference alone 0. Kinds: none, ratio, sqrt, log, quadratic,
    super-quadratic, cubic, exponential.
    """
    short, long = ratio(cand_len, ref_len), ratio(ref_len, cand_len)
    r = F.least(short, long)
    if kind == "none":
        beyond = F.lit(1.0)
    elif kind == "log":
        beyond = F.log1p(F.least(ref_len, cand_len).cast("double")) / F.log1p(F.greatest(ref_len, cand_len).cast("double"))
    elif kind == "exponential":
        beyond = F.exp(r - 1)
    elif kind in POWERS:
        beyond = F.pow(r, F.lit(POWERS[kind]))
    else:
        raise ValueError(f"unknown length penalty: {kind}")
    inside = (short >= 1 / threshold) & (short <= threshold)
    return F.when(ref_len == 0, F.when(cand_len == 0, 1.0).otherwise(0.0)).when(inside, 1.0).otherwise(F.least(F.lit(1.0), beyond))


def membership_weight(score: Column, weight: Column, mode: str = "linear", invert: bool = False, alpha: float = 0.5) -> Column:
    """``score`` weighted by a membership weight; contrastive subtracts ``alpha`` of the rest, not below -0.1."""
    w = 1 - weight if invert else weight
    if mode == "contrastive":
        return F.greatest(score * w - alpha * score * (1 - w), F.lit(-0.1))
    return score * F.pow(w, F.lit({"linear": 1.0, "quadratic": 2.0, "super-quadratic": 2.5, "cubic": 3.0}[mode]))


def profile_score(metrics: dict[str, Column], weights: dict[str, float], penalty: Column | None = None) -> Column:
    """Weighted mean of ``metrics``; a length ratio counts as its closeness to 1."""
    total = sum(weights.values())
    parts = [(length_similarity(metrics[m]) if m == "length_ratio" else metrics[m]) * F.lit(float(w)) for m, w in weights.items()]
    score = sum(parts[1:], parts[0]) / F.lit(float(total))
    return score * penalty if penalty is not None else score


def adaptive_match(best: Column, mean: Column, mean_distractors: Column, max_distractors: Column, weight: Column, n_refs: Column, variant: str = "standard", mode: str = "linear") -> Column:
    """``p * best + (1 - p) * other``; other is the mean of all, or the mean or best of the distractors if there are any."""
    p = F.pow(weight, F.lit({"linear": 1.0, "quadratic": 2.0}[mode]))
    other = {"standard": mean, "distractor_avg": mean_distractors, "distractor_max": max_distractors}[variant]
    return p * best + (1 - p) * F.when(n_refs < 2, mean).otherwise(other)


#: Profile name: metrics with weights, length penalty and threshold, weighting.
TRIO = {"token_overlap_ref": 1.0, "lcs_ratio": 1.0, "unique_ngram_coverage_ref": 1.0}


def profile(name: str) -> dict:
    """The settings behind a profile name, with the threshold read from the name (such as ``_ratio_2.0``)."""
    import re

    t = re.search(r"(?:ratio|penalty)_(?:penalty_)?(\d+\.\d+)", name)
    out = {"weights": TRIO if "trio" in name or name == "default" else {name.split("_ratio")[0].removeprefix("lexical_"): 1.0}, "penalty": "ratio" if t or name == "default" else "none", "threshold": float(t[1]) if t else 1.5}
    if "adaptive_match" in name:
        out["adaptive"] = {"mode": "quadratic" if "quadratic" in name else "linear", "variant": "distractor_max" if "distractor_max" in name else "distractor_avg" if "distractor_avg" in name else "standard"}
    elif "mia_" in name:
        out["weighting"] = name.rsplit("mia_", 1)[1]
    return out
