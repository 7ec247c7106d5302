"""Answers taken from texts, reference choice, prompts with metrics in them, and scores that never fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The content of a box, with braces nested three deep.
BOXED = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"


def last_boxed(text: Column) -> Column:
    """Content of the last box whose braces close, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(BOXED), 1), F.lit(-1))


def strict_box(answer: Column, truth: Column, tail: int = 100) -> Column:
    """1 if the last box within the last ``tail`` characters holds the truth as it stands, else -1."""
    return F.when(last_boxed(F.substring(answer, -tail, tail)).eqNullSafe(truth) & truth.isNotNull(), 1).otherwise(-1)


def boxed_count(answer: Column, truth: Column) -> Column:
    """1 if the last box holds just the truth, else 0, for missing boxes too."""
    return F.when(last_boxed(answer) == truth, 1).otherwise(0)


def chosen_references(refs: Column, target: Column, prompt: Column, by_prompt: Column, tokens: Callable[[Column], Column]) -> Column:
    """The references a text is held against: ``target`` (an array) if given; else those that hold the prompt's last word, if asked for and there are any; else all."""
    words = F.filter(F.split(F.lower(F.trim(prompt)), r"\s+"), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    near = F.filter(refs, lambda r: F.array_contains(tokens(r), last))
    return F.coalesce(target, F.when(F.coalesce(by_prompt, F.lit(False)) & (F.size(near) > 0), near), refs)


#: Placeholders of a prompt and the metric each stands for.
PLACEHOLDERS = {m.upper(): m for m in ("lexical_token_overlap", "lexical_lcs_ratio", "lexical_lcs_ratio_cand", "length_ratio", "lexical_ngram_coverage", "lexical_ngram_coverage_ref")}

#: Prompts by name, in words of our own.
TEMPLATES = {
    "default": "Problem: {PROBLEM}\nReference: {REFERENCE_SOLUTION}\nCandidate: {CANDIDATE_SOLUTION}\nHow alike are the two solutions? End with a line of the form\nREWARD: <number between 0 and 1>",
    "v1": "Reference: {REFERENCE_SOLUTION}\nCandidate: {CANDIDATE_SOLUTION}\nGive a number between 0 and 100 for how much of the reference the candidate repeats.",
    "v2_1": "Problem: {PROBLEM}\nReference: {REFERENCE_SOLUTION}\nCandidate: {CANDIDATE_SOLUTION}\nShared words: {LEXICAL_TOKEN_OVERLAP}\nREWARD: <number between 0 and 1>",
    "v3": "Reference: {REFERENCE_SOLUTION}\nCandidate: {CANDIDATE_SOLUTION}\nShared words: {LEXICAL_TOKEN_OVERLAP}, length: {LENGTH_RATIO}\nREWARD: <number between 0 and 1>",
}


def template(name: str) -> str:
    if name not in TEMPLATES:
        raise ValueError(f"unknown prompt template: {name}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def score_range(text: str) -> str:
    """The range of scores that a prompt asks for."""
    return "0-100" if "between 0 and 100" in text or "0-100" in text else "0-1"


def filled(text: str, problem: Column, reference: Column, candidate: Column, metrics: dict[str, Column]) -> Column:
    """``text`` with its placeholders filled: only the metrics that it names are computed, to three decimals."""
    import re

    values = {"PROBLEM": F.trim(problem), "REFERENCE_SOLUTION": F.trim(reference), "CANDIDATE_SOLUTION": F.trim(candidate)}
    parts = []
    for piece in re.split(r"(\{[A-Z_]+\})", text):
        name = piece.strip("{}")
        if piece.startswith("{") and name in values:
            parts.append(F.coalesce(values[name], F.lit("")))
        elif piece.startswith("{") and name in PLACEHOLDERS:
            parts.append(F.format_string("%.3f", F.round(metrics[PLACEHOLDERS[name]], 3)))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def or_zero(score: Column) -> Column:
    """A score that failed, or is no number, counts as 0."""
    s = score.try_cast("double")
    return F.when(s.isNull() | F.isnan(s), 0.0).otherwise(s)
