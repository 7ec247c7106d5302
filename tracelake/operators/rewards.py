"""Reward functions by name: registered Column functions, user functions from a file, and a manager that applies them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import similarity as X
from tracelake.functions import text as T
from tracelake.functions.grading import last_boxed, or_zero

Reward = Callable[[Column, Column], Column]

REWARDS: dict[str, Reward] = {}


def register(name: str) -> Callable[[Reward], Reward]:
    """Adds a reward of (reference, candidate) under ``name``; taking a name twice is an error."""

    def add(f: Reward) -> Reward:
        if REWARDS.get(name, f) is not f:
            raise ValueError(f"reward {name} is taken")
        REWARDS[name] = f
        return f

    return add


@register("jaccard")
def jaccard(ref: Column, cand: Column) -> Column:
    return T.let(T.tokens(ref), lambda r: T.let(T.tokens(cand), lambda c: X.jaccard(r, c)))


@register("token_overlap")
def token_overlap(ref: Column, cand: Column) -> Column:
    return T.let(T.tokens(ref), lambda r: T.let(T.tokens(cand), lambda c: X.overlap_ref_set(r, c)))


@register("boxed")
def boxed(ref: Column, cand: Column) -> Column:
    return F.when(last_boxed(cand) == last_boxed(ref), 1.0).otherwise(0.0)


def from_file(path: str, name: str, **settings) -> Reward:
    """The function ``name`` of a user's file, with ``settings`` filled in; it builds a Column from two Columns."""
    import functools
    import importlib.util

    spec = importlib.util.spec_from_file_location("tracelake_user_reward", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    return functools.partial(getattr(module, name), **settings) if settings else getattr(module, name)


def scored(rows: DataFrame, rewards: dict[str, Reward], ref: str = "ref", cand: str = "cand", main: str | None = None) -> DataFrame:
    """``rows`` with ``reward`` and one column per entry of ``rewards``: all in one pass, failures and missing numbers as 0.

    ``reward`` is the entry ``main``, by default the first. Rows stay one for one.
    """
    if not rewards:
        raise ValueError("no rewards")
    columns = {n: or_zero(f(F.col(ref), F.col(cand))) for n, f in rewards.items()}
    return rows.withColumns({**columns, "reward": columns[main or next(iter(columns))]})


def enriched(rows: DataFrame, raw: dict[str, Column], label: str = "Output") -> DataFrame:
    """``rows`` with ``<out>_raw``, ``<out>`` and ``<out>_reasoning`` for each entry of ``raw``: the whole text, what follows the label, and what stands before it."""
    out = {}
    for name, text in raw.items():
        out[f"{name}_raw"] = text
        out[name] = T.labelled_output(text, label)
        out[f"{name}_reasoning"] = F.trim(F.regexp_extract(text, rf"(?is)^(.*?)(?:{label}|output|answer)\s*:", 1))
    return rows.withColumns(out)
