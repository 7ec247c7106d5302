"""The few sequential kernels that built-in functions can't express, as Arrow UDFs."""

from __future__ import annotations

import difflib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as K

LOW, HIGH = 3, 30


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming: one big integer per row."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    masks: dict = defaultdict(int)
    for i, x in enumerate(a):
        masks[x] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def greedy_spans(ref: list, cand: list, low: int = LOW, high: int = HIGH) -> list[tuple[int, int]]:
    """Spans of ``cand`` that stand in ``ref``, longest first at each place, from left to right, of at most ``high`` tokens."""
    places = places_of(tuple(ref), low)
    spans, j = [], 0
    while j <= len(cand) - low:
        best = 0
        for i in places.get(tuple(cand[j : j + low]), ()):
            n = low
            while n < high and i + n < len(ref) and j + n < len(cand) and ref[i + n] == cand[j + n]:
                n += 1
            best = max(best, n)
        if best:
            spans.append((j, j + best))
            j += best
        else:
            j += 1
    return spans


def longest_match(a: list, b: list) -> int:
    """Length of the longest common run, by a rolling row."""
    best, row = 0, {}
    places: dict = defaultdict(list)
    for i, x in enumerate(a):
        places[x].append(i)
    for y in b:
        row = {i: row.get(i - 1, 0) + 1 for i in places.get(y, ())}
        best = max(best, max(row.values(), default=0))
    return best


def boxed_answer(text: str | None) -> str | None:
    """Content of the last ``\\boxed{...}`` with balanced braces, None if there is none."""
    at = (text or "").rfind("\\boxed{")
    if at < 0:
        return None
    depth, start = 0, at + 7
    for i in range(start, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            if depth == 0:
                return text[start:i]
            depth -= 1
    return None


def plain_answer(answer: str | None) -> str:
    """An answer without spacing, units' markup, sizes of brackets and trailing zeros, for comparison."""
    t = (answer or "").strip().rstrip(".").replace("tfrac", "frac").replace("dfrac", "frac")
    t = re.sub(r"\\(?:left|right|!|,|;|quad|displaystyle)|\\text\{[^}]*\}|\\%|%|\$|\^\{?\\circ\}?", "", t)
    t = re.sub(r"\\frac(\d)(\d)", r"\\frac{\1}{\2}", t)
    t = re.sub(r"(\d),(?=\d{3}\b)", r"\1", re.sub(r"\s+", "", t))
    t = re.sub(r"(\.\d*?)0+$", r"\1", t) if re.fullmatch(r"-?\d*\.\d+", t) else t
    t = re.sub(r"^\.", "0.", t.rstrip("."))
    return t.split("=")[-1] if t.count("=") == 1 and len(t.split("=")[0]) <= 2 else t


def suffix_automaton(seq: list) -> tuple[list[dict], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the automaton of all runs of ``seq``."""
    step, link, size, last = [{}], [-1], [0], 0
    for x in seq:
        cur = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and x not in step[p]:
            step[p][x] = cur
            p = link[p]
        if p != -1:
            q = step[p][x]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p != -1 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step, link, size


@lru_cache(maxsize=2)
def automaton_of(ref: tuple) -> tuple[list[dict], list[int], list[int], list[int]]:
    """:func:`suffix_automaton`, and its states from the longest on; the candidates of a reference, which lie side by side, share it."""
    step, link, size = suffix_automaton(list(ref))
    return step, link, size, sorted(range(1, len(step)), key=size.__getitem__, reverse=True)


@lru_cache(maxsize=2)
def places_of(ref: tuple, low: int) -> dict[tuple, list[int]]:
    """Where each run of ``low`` tokens stands in ``ref``; shared by the candidates of a reference."""
    places: dict = defaultdict(list)
    for i in range(len(ref) - low + 1):
        places[ref[i : i + low]].append(i)
    return dict(places)


def ngram_counts(ref: list, cand: list, low: int = LOW, high: int = HIGH) -> tuple[int, int, int]:
    """Distinct n-grams of ``low`` to ``high`` tokens in ``ref``, in ``cand`` and in both, in linear time."""
    step, link, size, order = automaton_of(tuple(ref))

    def within(reach: list[int], links: list[int], sizes: list[int]) -> int:
        return sum(max(0, min(high, reach[i]) - max(low, sizes[links[i]] + 1) + 1) for i in range(1, len(links)))

    reach, state, n = [0] * len(step), 0, 0
    for x in cand:
        while state and x not in step[state]:
            state = link[state]
            n = size[state]
        if x in step[state]:
            state, n = step[state][x], n + 1
        reach[state] = max(reach[state], n)
    for i in order:
        if reach[i] and link[i] > 0:
            reach[link[i]] = size[link[i]]
    other = suffix_automaton(cand)
    return within(size, link, size), within(other[2], other[1], other[2]), within(reach, link, size)


def _ints(*names: str) -> K.StructType:
    return K.StructType([K.StructField(n, K.IntegerType()) for n in names])


_as_list = lambda x: [] if x is None else list(x)


@F.pandas_udf(K.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(_as_list(x), _as_list(y)) for x, y in zip(a, b)])


@F.pandas_udf(_ints("covered", "spans", "longest"))
def greedy_coverage(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """Tokens of the candidate covered by greedy spans, the number of spans, and the longest common run."""
    rows = []
    for r, c in zip(ref, cand):
        r, c = _as_list(r), _as_list(c)
        s = greedy_spans(r, c)
        rows.append((sum(b - a for a, b in s), len(s), longest_match(r, c)))
    return pd.DataFrame(rows, columns=["covered", "spans", "longest"])


@F.pandas_udf(_ints("ref", "cand", "both"))
def shared_ngrams(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """:func:`ngram_counts` of token arrays; null counts as empty."""
    return pd.DataFrame([ngram_counts(_as_list(r), _as_list(c)) for r, c in zip(ref, cand)], columns=["ref", "cand", "both"])


@F.pandas_udf(K.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity without case, very frequent characters of long texts left out of the search; two empty texts are alike."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)])


@F.pandas_udf(K.IntegerType())
def zlib_size(t: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else len(zlib.compress(x.encode())) for x in t], dtype="Int32")


@F.pandas_udf(K.StringType())
def boxed(t: pd.Series) -> pd.Series:
    return pd.Series([boxed_answer(x) for x in t], dtype=object)


@F.pandas_udf(K.BooleanType())
def same_answer(given: pd.Series, truth: pd.Series) -> pd.Series:
    """Whether two answers are equal after :func:`plain_answer`; a missing one equals nothing."""
    return pd.Series([x is not None and y is not None and plain_answer(x) == plain_answer(y) for x, y in zip(given, truth)])
