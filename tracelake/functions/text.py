"""Text functions as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: the white space of str.split, spelled out so that every engine means the same.
SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCTUATION = ".,;:!?"

# Code point ranges of scripts written without spaces, for rewards (first) and for n-grams (second).
UNSPACED = (
    r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{2ceb0}-\x{2ebef}\x{30000}-\x{3134f}\x{f900}-\x{faff}"
    r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}\x{ff65}-\x{ff9f}\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{a960}-\x{a97f}\x{d7b0}-\x{d7ff}"
    r"\x{0e00}-\x{0e7f}\x{0e80}-\x{0eff}\x{1780}-\x{17ff}\x{19e0}-\x{19ff}\x{1000}-\x{109f}\x{aa60}-\x{aa7f}\x{a9e0}-\x{a9ff}\x{0f00}-\x{0fff}\x{a980}-\x{a9df}\x{1b00}-\x{1b7f}\x{1bc0}-\x{1bff}\x{a900}-\x{a92f}\x{1800}-\x{18af}"
)
UNSPACED_NGRAM = (
    r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{f900}-\x{faff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{1100}-\x{11ff}"
    r"\x{0e00}-\x{0e7f}\x{0e80}-\x{0eff}\x{1780}-\x{17ff}\x{1000}-\x{109f}\x{0f00}-\x{0fff}"
)
# Fixed value: LaTeX commands, numbers, identifiers and operators of mathematical text.
MATH_TOKEN = r"\\[a-z]+|\d+(?:\.\d+)?|[a-z_][a-z0-9_]*|[+\-*/^=<>(){}\[\]|]"


def words(text: Column) -> Column:
    """The words between white space; null for null, empty for blank text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case words without outer punctuation; words of punctuation alone are dropped."""
    return F.filter(F.transform(F.split(F.lower(text), SPACE + "+"), lambda w: F.btrim(w, F.lit(PUNCTUATION))), lambda w: w != "")


def script_tokens(text: Column, unspaced: str = UNSPACED) -> Column:
    """Like :func:`tokens`, but every character of a script without spaces is a token of its own."""
    return tokens(F.regexp_replace(text, f"([{unspaced}])", " $1 "))


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)


def math_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({MATH_TOKEN})"), 1)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it comes up."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def without_prefix(text: Column, ratio: float, empty: str = "") -> Column:
    """``text`` without its first ``int(n * ratio)`` words, joined by blanks; ``empty`` for a text without words."""
    rest = lambda w: F.array_join(F.slice(w, F.floor(F.size(w) * F.lit(ratio)).cast("int") + 1, F.size(w)), " ")
    return let(words(text), lambda w: F.when(F.size(w) == 0, F.lit(empty)).otherwise(rest(w)))


def prefix_of(text: Column, ratio: float) -> Column:
    """The first ``max(1, int(n * ratio))`` words."""
    return let(words(text), lambda w: F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(w) * F.lit(ratio)).cast("int"))), " "))


def suffix_of(text: Column, ratio: float) -> Column:
    """What :func:`prefix_of` leaves."""
    return let(words(text), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.floor(F.size(w) * F.lit(ratio)).cast("int")) + 1, F.size(w)), " "))


def within_budget(candidate: Column, reference: Column) -> Column:
    """``candidate`` cut to the word count of ``reference``; a shorter one is kept as it is."""
    cut = lambda w, n: F.when(F.size(w) <= n, candidate).otherwise(F.array_join(F.slice(w, F.lit(1), n), " "))
    return let(words(candidate), lambda w: let(F.size(words(reference)), lambda n: cut(w, n)))


def first_solution(text: Column) -> Column:
    """Up to the first line that starts with a tilde."""
    return F.trim(F.regexp_replace(text, r"(?s)\n\x7E[^\n]+.*$", ""))


def without_image_links(text: Column) -> Column:
    t = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r" {2,}", " "))


# What a paper's text is cut by.
INTRODUCTION = r"(?im)^#{1,6}\s*(?:\d+(?:\.\d+)?|[ivxlcdm]+)\s*\.?\s*introduction\b"
REFERENCES = r"(?im)^#{1,6}\s*(?:references|bibliography|reference)\b"
MACRO = r"(?im)^\s*\\(?:newcommand|renewcommand|def|DeclareMathOperator|newtheorem)\b.*$"


def clean_paper(text: Column) -> Column:
    """A paper from its numbered introduction heading to its references; null without such a heading.

    Line ends become Unix ones; comments of HTML and LaTeX and lines that define macros go.
    """
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^\s*%.*$", ""), MACRO, "")
    t = F.nullif(F.regexp_extract(t, INTRODUCTION + r"[\s\S]*", 0), F.lit(""))
    return F.nullif(F.btrim(F.regexp_replace(t, REFERENCES + r"[\s\S]*", ""), F.lit(" \t\n\r\f")), F.lit(""))


def labelled_output(text: Column, label: str) -> Column:
    """What follows ``label:``, else what follows Output: or Answer:, else the whole; outer quotes dropped."""
    own = F.nullif(F.regexp_extract(text, rf"(?is){label}\s*:\s*(.*)$", 1), F.lit(""))
    general = F.nullif(F.regexp_extract(text, r"(?is)(?:output|answer)\s*:\s*(.*)$", 1), F.lit(""))
    return F.btrim(F.btrim(F.coalesce(own, general, text)), F.lit("\"'"))


def judge_score(text: Column) -> Column:
    """The number after REWARD:, else the last number of the text, of 100 if above 1; within 0 and 1, else 0."""
    said = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)REWARD:\s*([0-9]*\.?[0-9]+)"), 1), F.lit(1)).try_cast("double")
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), F.lit(-1)).try_cast("double")
    v = F.coalesce(said, last, F.lit(0.0))
    v = F.when((v > 1) & (v <= 100), v / 100).otherwise(v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def year_of_url(url: Column, marker: str = "_AIME") -> Column:
    return F.regexp_extract(url, rf"/(\d{{4}}){marker}", 1).try_cast("int")


def last_content(messages: Column, *roles: str) -> Column:
    """Content of the last message of one of ``roles``; null if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"].isin(*roles)), F.lit(-1))["content"]


def spoken_turns(messages: Column) -> Column:
    """User and assistant turns with non-blank content."""
    return F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (F.length(F.trim(F.coalesce(m["content"], F.lit("")))) > 0))


def chat_text(messages: Column, generate: bool = False) -> Column:
    """The plain chat template: ``Role: content`` lines, and an open ``Assistant:`` if an answer is to follow."""
    lines = F.array_join(F.transform(spoken_turns(messages), lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"], F.lit("\n"))), "")
    return F.concat(lines, F.lit("Assistant:")) if generate else lines
