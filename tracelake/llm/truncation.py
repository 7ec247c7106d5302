"""P2: texts that stop before their sentence, word or block does.

A stack automaton reads the whole text once and keeps what is open: code fences, formulas, environments,
tags, brackets and quotations. What is still open at the end, a broken character or escape, or a text of as
many words as its limit without an end mark decides at once; so does a proper end. The rest, texts without
an end mark, are held against the baseline of their source (that of all sources where a source has too few
uses): how often the words they end on end a sentence or line elsewhere, whether texts of their form (running
prose, list, line, single sentence, ellipsis) finish without an end mark there at all, and whether unended texts of the
source pile up at one length, as they do where a field or transfer cuts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import materialise, read, require_columns, spread

#: A word pair ends a sentence if it does so in at least this share of its uses elsewhere.
END_SHARE = 0.12
#: Share of a form's unended texts that look finished, below which none is taken for finished, and above which
#: only known words that end hardly anything, less than the share beside, make a cut.
RARELY, MOSTLY, HARDLY = 0.1, 0.9, 0.03
#: Uses elsewhere from which a pair's own share counts; below, the last word's share does.
ENOUGH = 3
#: Uses within the text's own source from which they count in place of those in all sources.
ENOUGH_OWN = 25
#: A length is a cut length if at least so many unended texts of a source have it, and so many times its neighbours' mean.
SPIKE_COUNT, SPIKE_TIMES, SPIKE_WIDTH = 5, 6.0, 8
#: Words up to which a last line of its own is held against lines that begin and end as it does.
SHORT_LINE = 4
#: Keys that a task counts before it hands them on.
MEMO_ENTRIES = 300_000

_TERMINATORS = ".!?。！？؟।"
_CLOSERS = "\"'”’»›)]}」』）】*_~"
_TAGS = re.compile(r"(?:<\|[\w ]{1,30}\|>|</?[A-Za-z][\w-]{0,15}\s*/?>|\[(?:truncated|\.\.\.|…|cut|continued|more)\]|\((?:truncated|continued|cont\.|\.\.\.|…)\))\s*$", re.I)
_BLANK = " \t\n\r\f\v\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\u200b\u200c\u200d\ufeff\u00ad" + "".join(map(chr, [*range(0x00, 0x20), *range(0x2000, 0x200B)]))
_WRAPPING = re.compile(r"[\"'][\s}\]]*[}\]][,;]?$")
_ELLIPSIS = re.compile(r"\s*(?:…|\.{3,}|⋯)+$")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*|\d+|[^\w\s]")
_SPAN = re.compile(r"```.*?```|\$\$.*?\$\$|\$[^$\n]*\$|\\\[.*?\\\]|`[^`\n]+`|\\[a-zA-Z]+(?:\{[^{}\n]*\})+|https?://\S+", re.S)
_PIECE = re.compile(r"\n|" + _TOKEN.pattern)
_DIGITS = re.compile(r"\d+")
_END_MARK = re.compile(r"[" + re.escape(_TERMINATORS) + r"]+[" + re.escape(_CLOSERS) + r"]*(?=\s|$)|[。！？]+[”」』）]*|…(?=\s|$)|\n+")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([\w*]+)\}")
_LABELLED = re.compile(r"(?:^|\n)\s*(?:[*_]{0,2}[^\W\d_][\w ]{0,20}[*_]{0,2}\s*[:：=]|=|→|⇒)\s*\S{1,24}$")
_BARE = re.compile(r"(?:^|\n)\s*[*_$#]{0,3}[-+]?[\d.,/]+[*_$]{0,3}$")
_SIGNED = re.compile(r"(?:^|\n)[^\n,.!?]{2,40},\s*\n\s*[^\n.!?,]{1,40}$")
_BOXED = re.compile(r"\\boxed\{[^{}\n]*\}\$?$")
_ITEM = re.compile(r"\s*(?:[-*•]|\d+[.)])\s")
_SENTENCE_BEFORE = re.compile(r"[.!?。！？][" + re.escape(_CLOSERS) + r"]*(?:\s+\S|(?<=[。！？])\S)")
_RULE = re.compile(r"(?:^|\n)\s*(?:-{3,}|\*{3,}|_{3,}|={3,})$")
_HALF_ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#x?[0-9a-fA-F]*|am|amp|ap|apo|apos|lt|gt|qu|quo|quot|nb|nbs|nbsp)?|%[0-9A-Fa-f]|%[0-9A-Fa-f]{2}%)$")
_HALF_CHARACTER = re.compile("(?:[\ufffd\ud800-\udfff]|Ã|â€)$")
_PAIRS = {")": "([", "]": "[(", "}": "{", "”": "“„", "»": "«", "」": "「", "』": "『", "）": "（", "】": "【"}
_OPENERS = frozenset("([{“„«「『（【")
# Elements whose end tag may not be left out.
_ELEMENTS = frozenset("a article aside b blockquote body code details div em figure footer form h1 h2 h3 h4 h5 h6 head header html i main nav ol pre script section select span strong style sub summary sup svg table textarea title tt u ul video".split())
_MARK = re.compile(
    r"(?P<skip>```.*?```|``[^\n]+?``|`[^`\n]+`|\$\$.*?\$\$|\$[^$\n]+\$|\\(?!(?:begin|end)\{)[^\W\d_]+|\\[{}$\\\"'`|&%#_,;:! ])"
    r"|(?P<env>\\(?:begin|end)\{[\w*]+\})|(?P<math>\\[\[\]()]|\$\$?)|(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)|(?P<tick>```+|~~~+|`)|(?P<bracket>[()\[\]{}“”„«»「」『』（）【】])|(?P<quote>\")",
    re.S,
)
_SPECIAL = re.compile(r"[`~$\\<()\[\]{}“”„«»「」『』（）【】\"]")
_SMILEY = re.compile(r"(?<![\w])[:;][-^']?$")
_MONEY = re.compile(r"\d[\d.,]*(?:\W|\s|$)")


def stem(text: str) -> str:
    """``text`` without what may trail a cut or an end: blanks, tags, end-of-text marks and ellipses."""
    while True:
        t = text.rstrip(_BLANK)
        if t and t[-1] in ">])}":
            t = _TAGS.sub("", t)
            # the end of a record around the text, which it didn't open
            if (m := _WRAPPING.search(t)) and any(t.count(b) > t.count(a) for a, b in ("{}", "[]") if b in m[0]):
                t = t[: m.start()]
        dots = len(t.rstrip("….⋯"))
        if dots < len(t) and not t.endswith("...."):
            kept = t[:dots] + _ELLIPSIS.sub("", t[dots:])
            if len(kept) < len(t) and kept.rstrip(_BLANK):
                t = kept.rstrip(_BLANK)
        if t == text:
            return t
        text = t


def open_blocks(text: str) -> list[str]:
    """What is still open at the end of ``text``, outermost first: one pass of the automaton over its marks.

    In a code block nothing but its fence counts, in a code line or short formula nothing. A closing mark
    closes the nearest opening one of its kind, with what stands open inside; one without an opening mark
    closes nothing. Round and square brackets close each other (half-open intervals). Straight quotes open
    before a word and close after one, within a paragraph; a lone $ before an amount is money, and one that
    isn't in the last line is a plain character, as is a lone backtick.
    """
    stack: list[str] = []
    first = _SPECIAL.search(text)
    if not first:
        return stack
    last_line = text.rfind("\n") + 1
    last_paragraph = text.rfind("\n\n") + 1
    pos, end = first.start(), len(text)
    while pos < end and (m := _MARK.search(text, pos)):
        kind, mark, at = m.lastgroup, m[0], m.start()
        pos = m.end()
        long = mark[:3] in ("```", "~~~")
        if long and not text[text.rfind("\n", 0, at) + 1 : at].strip():
            # a fence: up to the next one of its kind nothing else counts
            fence = mark[: len(mark) - len(mark.lstrip(mark[0]))]
            close = re.compile(r"\n[ \t]*" + fence + "[" + fence[0] + "]*").search(text, at + len(fence)) or (re.compile(fence).search(text, at + len(fence)) if fence[0] == "`" else None)
            if close is None:
                return [*stack, fence]
            pos = close.end()
            continue
        if kind == "skip":
            continue
        if kind == "env":
            name = mark[mark.index("{") :]
            if mark.startswith("\\begin"):
                stack.append("\\begin" + name)
            elif "\\begin" + name in stack:
                del stack[len(stack) - 1 - stack[::-1].index("\\begin" + name) :]
        elif kind == "math":
            if mark in ("\\[", "\\("):
                stack.append(mark)
            elif mark in ("\\]", "\\)"):
                opening = "\\[" if mark == "\\]" else "\\("
                if opening in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(opening) :]
            elif mark == "$$" or at >= last_line and not _MONEY.match(text, at + 1):
                stack.append(mark)
        elif kind == "tag":
            name = re.match(r"</?(\w+)", mark)[1].lower()
            if name in _ELEMENTS and not mark.endswith("/>"):
                if mark[1] != "/":
                    stack.append("<" + name)
                elif "<" + name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index("<" + name) :]
        elif kind == "tick":
            if mark.startswith("```"):
                return [*stack, mark]
            if at >= last_line and mark == "`":
                stack.append("`")
        elif kind == "bracket":
            if mark in "()[]{}" and text[at - 1 : at] in (":", ";", "-", "^", "'") and _SMILEY.search(text[max(0, at - 3) : at]):
                continue
            if mark == "“" and "„" in stack:
                mark = "”"
            if mark == "»" and "«" not in stack and not text[at - 1 : at].strip():
                stack.append(mark)
            elif mark == "«" and "»" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("»") :]
            elif mark in _OPENERS:
                # a quotation of several paragraphs opens anew in each, and closes once
                if not (mark in "“„«" and mark in stack and text[:at].rstrip(" ").endswith("\n")):
                    stack.append(mark)
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] in _PAIRS[mark]:
                        del stack[k:]
                        break
                    if stack[k][0] in "\\<$" or mark in ")]}" and stack[k] in "“„«":
                        break
        elif kind == "quote":
            before, after = text[at - 1 : at], text[at + 1 : at + 2]
            if '"' in stack and before.strip():
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
            elif at >= last_paragraph and after.strip() and (not before.strip() or before in "([{=:,>—–-"):
                stack.append('"')
    return stack


def tokens_of(sentence: str) -> list[str]:
    return ["0" if t.isdigit() else t for t in _TOKEN.findall(sentence)]


def line_key(tokens: list[str]) -> str:
    return "L " + " ".join(tokens).lower()


def folded(token: str) -> str:
    """``token`` in lower case; a single letter keeps its case, an initial being no word."""
    return token if len(token) == 1 else token.lower()


def keys_of(tokens: list[str]) -> list[str]:
    """Keys of a sentence end: word pair, last word, and the word before if the last is capitalised."""
    last = folded(tokens[-1])
    before = folded(tokens[-2]) if len(tokens) > 1 else "^"
    return [f"2 {before} {last}", f"1 {last}", f"{'N' if tokens[-1][:1].isupper() else 'n'} {before}"]


def plain(text: str) -> str:
    return _SPAN.sub(" § ", text)


def form_of(text: str, t: str) -> str:
    """The form of the end of ``text``, of which ``t`` is the stem."""
    line = t[t.rfind("\n") + 1 :]
    if _ITEM.match(line):
        return "list"
    if text.rstrip(_BLANK).endswith(("…", "...", "⋯")):
        return "ellipsis"
    return "prose" if _SENTENCE_BEFORE.search(line) else "line" if "\n" in t else "single"


def structure(text: str | None, max_words: int | None = None) -> tuple[str, str, list[str]]:
    """``(verdict, reason, keys)``: verdict is blank, done, cut or open; an open text comes with its keys."""
    if text is None or not text.strip("\u200b\ufeff \t\r\n\f\v\u00a0\u3000"):
        return "blank", "blank", []
    t = stem(text)
    if not t:
        return "open", "no end mark, ellipsis", keys_of(["…"])
    if _HALF_CHARACTER.search(t[-2:]) or _HALF_CHARACTER.search(text.rstrip(_BLANK)[-2:]):
        return "cut", "broken character", []
    opened = open_blocks(t)
    if opened and (opened[0][0] in "`~\\$<" or opened[-1][0] in "`~\\$"):
        return "cut", f"open {opened[0]}", []
    lines = t[max(0, t.rfind("\n", 0, max(0, t.rfind("\n")))) :]
    if t.endswith("```") or _BOXED.search(t) or _RULE.search(lines) or _SIGNED.search(t) or _BARE.search(lines):
        return "done", "block", []
    if _HALF_ESCAPE.search(t[-12:]):
        return "cut", "broken escape", []
    core = t.rstrip()
    while core and (core[-1] in _CLOSERS or unicodedata.category(core[-1]) in ("So", "Sk", "Sm", "Mn", "Cf") and core[-1] not in "=+<>|~^" or ord(core[-1]) > 0x1F000):
        core = core[:-1].rstrip()
        core = _ELLIPSIS.sub("", core)
    ended = core[-1:] in _TERMINATORS if core else False
    if ended:
        return ("cut", f"open {opened[-1]}", []) if opened else ("done", "end mark", [])
    symbol = core != t and unicodedata.category(t[-1]) in ("So", "Sk", "Sm", "Cf", "Mn") or ord(t[-1]) > 0x1F000
    if symbol and t[-1] not in "=+<>|~^":
        return "done", "closing symbol", []
    if _LABELLED.search(lines):
        return "done", "label", []
    dangling = re.search(r"[(\[{“«„,，、:;\-–—/&+=<'\"]$", t)
    u = re.sub(r"[\s(\[{“«„,;:\"'<]+$", "", t) if dangling else t
    if max_words and len(text.split()) >= max_words:
        return "cut", "word limit", []
    tail = plain(u)
    tail = re.split(r"(?<=[.!?。！？])\s+|\n+|(?<=[。！？])", tail)[-1]
    tail = re.sub(r"^\s*(?:[-*•]|\d+[.)])\s+", "", tail)
    tokens = tokens_of(tail)
    if re.fullmatch(r"\W*(?:[A-ZА-Я]|\d+)\W*", t):
        return "done", "one letter or number", []
    if not tokens:
        return ("cut", "dangling mark", []) if dangling else ("done", "no words", [])
    if dangling and dangling[0] in "=+<&/,，、":
        return "cut", "dangling mark", []
    if opened and opened[-1] in "([{“«（":
        # something that closes sentences is open: only a text that ends there without closing it is left
        return "cut", f"open {opened[-1]}", []
    keys = keys_of(tokens)
    line = tokens_of(plain(u).rsplit("\n", 1)[-1])
    if "\n" in u and 0 < len(line) <= SHORT_LINE:
        keys[0] = line_key(line)
    return "open", f"{'dangling' if dangling else 'no end'} mark, {form_of(text, t)}", keys


class EndCounts:
    """Uses of words and word pairs in the texts of one source, and their uses at the end of a sentence or line."""

    def __init__(self) -> None:
        self.pairs: Counter = Counter()
        self.capitals: Counter = Counter()
        self.ends: Counter = Counter()
        self.lines: Counter = Counter()
        self.line_ends: Counter = Counter()

    def __len__(self) -> int:
        return len(self.pairs) + len(self.capitals) + len(self.ends) + len(self.lines)

    def add(self, text: str) -> None:
        body = plain(stem(text))
        toks = ["\n", *_PIECE.findall(_DIGITS.sub("0", _END_MARK.sub("\n", body)))]
        low = [t if len(t) == 1 else t.lower() for t in toks]
        self.pairs.update(zip(low, low[1:]))
        self.capitals.update([b for b, t in zip(low, toks[1:]) if t[0].isupper()])
        self.ends.update([(low[i - 2] if i > 1 else "\n", low[i - 1], toks[i - 1][0].isupper()) for i in range(1, len(toks)) if toks[i] == "\n" and toks[i - 1] != "\n"])
        for line in body.split("\n")[1:]:
            first = [m[0] for _, m in zip(range(SHORT_LINE + 1), _TOKEN.finditer(line))]
            first = ["0" if t.isdigit() else t for t in first]
            for n in range(1, min(len(first), SHORT_LINE) + 1):
                self.lines[line_key(first[:n])] += 1
            if 0 < len(first) <= SHORT_LINE:
                self.line_ends[line_key(first)] += 1

    def totals(self) -> dict[str, list[int]]:
        """``[uses, ends]`` by key, for the keys that :func:`keys_of` and :func:`line_key` give."""
        out: dict[str, list[int]] = {}
        for (b, w), n in self.pairs.items():
            if w != "\n":
                out[f"2 {'^' if b == '\n' else b} {w}"] = [n, 0]
                one = out.setdefault(f"1 {w}", [0, 0])
                one[0] += n
        for b, n in self.capitals.items():
            out[f"N {'^' if b == '\n' else b}"] = [n, 0]
        for (b, w, up), n in self.ends.items():
            b = "^" if b == "\n" else b
            out[f"2 {b} {w}"][1] += n
            out[f"1 {w}"][1] += n
            if up:
                out[f"N {b}"][1] += n
        for k, n in self.lines.items():
            out[k] = [n, self.line_ends[k]]
        return out


class Judge:
    """Verdicts of a task's texts, and the counts it has gathered since it last handed them on."""

    def __init__(self) -> None:
        self.counts: dict[str | None, EndCounts] = {}

    def verdict(self, text: str | None, max_words, source: str | None) -> tuple[str, str, list[str]]:
        limit = None if max_words is None or max_words != max_words else int(max_words)
        got = structure(text, limit)
        if got[0] != "blank":
            if source not in self.counts:
                self.counts[source] = EndCounts()
            self.counts[source].add(text)
        return got

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) > MEMO_ENTRIES

    def handed_on(self) -> tuple[list, list, list, list]:
        """Columns source, key, uses and ends; the counts start anew."""
        rows = [(s, k, u, e) for s, c in self.counts.items() for k, (u, e) in c.totals().items()]
        self.counts = {}
        return tuple(map(list, zip(*rows))) if rows else ([], [], [], [])


def judged(texts: DataFrame, ids: list[str], order: str | None = None) -> DataFrame:
    """``ids, source, verdict, reason``: one row per distinct ``ids`` with a text that isn't blank.

    ``texts`` has the columns ``ids``, ``source``, ``max_words`` and ``text``, and ``order`` if rows come
    several times under the same ids; the last one counts then (ties: any). verdict is done or cut. Null and
    blank texts give no row. A null ``max_words`` is no limit, null sources form one source. Counts are taken
    over all texts; a table of one text has no baseline, so there an open end counts as cut unless its last
    word ends another of its sentences.
    """
    require_columns(texts, *ids, "source", "max_words", "text")
    kinds = dict(texts.dtypes)
    order_col = F.col(order).cast("string") if order else F.lit(None).cast("string")
    rows = spread(texts.select(*ids, F.col("source").cast("string").alias("source"), F.col("max_words").cast("int").alias("max_words"), order_col.alias("__order"), "text"))

    own = ("source", "__order", "n_chars", "verdict", "reason", "keys", "key", "uses", "ends")
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()

        def table(n: int, id_columns: list[pa.Array], **out) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*id_columns, *[pa.array(out[c], k) if isinstance(out.get(c), list) else out.get(c, pa.nulls(n, k)) for c, k in zip(own, types)]], names=[*ids, *own])

        def totals(kinds: list[pa.DataType]) -> pa.RecordBatch:
            source, key, uses, ends = judge.handed_on()
            return table(len(key), [pa.nulls(len(key), k) for k in kinds], source=source, key=key, uses=uses, ends=ends)

        kinds = None
        for b in batches:
            kinds = [b.schema.field(i).type for i in range(len(ids))]
            texts = b.column("text").to_pylist()
            found = [judge.verdict(t, n, s) for t, n, s in zip(texts, b.column("max_words").to_pylist(), b.column("source").to_pylist())]
            keep = [i for i, x in enumerate(found) if x[0] != "blank"]
            kept = b.take(pa.array(keep, pa.int32()))
            verdicts = {c: [found[i][k] for i in keep] for k, c in enumerate(("verdict", "reason", "keys"))}
            yield table(len(keep), [kept.column(i) for i in range(len(ids))], source=kept.column("source"), __order=kept.column("__order"), n_chars=[len(texts[i]) for i in keep], **verdicts)
            if judge.full():
                yield totals(kinds)
        if kinds is not None:
            yield totals(kinds)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ids) + ", source string, __order string, n_chars int, verdict string, reason string, keys array<string>, key string, uses bigint, ends bigint"
    both = materialise(rows.mapInArrow(run, schema))
    last = F.max_by(F.struct("source", "n_chars", "verdict", "reason", "keys"), F.coalesce("__order", F.lit("")))
    one = both.where("key is null").groupBy(*ids).agg(last.alias("x")).select(*ids, "x.*")
    return decided(materialise(one), both.where("key is not null").select("source", "key", "uses", "ends"), ids)


def decided(one: DataFrame, counted: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, source, verdict, reason``: the open texts of ``one`` held against the baseline ``counted``.

    ``one`` has a row per text with ``ids, source, n_chars, verdict, reason, keys``, ``counted`` partial counts
    with ``source, key, uses, ends``.
    """
    from pyspark.sql import Window

    # lengths at which the unended texts of a source pile up
    per_length = one.where("verdict in ('open', 'cut')").groupBy("source", "n_chars").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source").orderBy("n_chars").rangeBetween(-SPIKE_WIDTH, SPIKE_WIDTH)
    others = (F.sum("n").over(near) - F.col("n")) / (2.0 * SPIKE_WIDTH)
    spikes = per_length.withColumn("others", others).where((F.col("n") >= SPIKE_COUNT) & (F.col("n") > SPIKE_TIMES * F.col("others"))).select(F.col("source").alias("__s"), F.col("n_chars").alias("__n"), F.lit(True).alias("spike"))

    open_ = one.where("verdict = 'open'")
    # one row per key: the counts of all sources, and those of each by name
    per_source = counted.groupBy("key", F.coalesce("source", F.lit("")).alias("s")).agg(F.sum("uses").alias("uses"), F.sum("ends").alias("ends"))
    baseline = per_source.groupBy("key").agg(F.sum("uses").alias("uses"), F.sum("ends").alias("ends"), F.map_from_entries(F.collect_list(F.struct("s", F.struct("uses", "ends")))).alias("by"))
    asked = open_.select(*ids, "source", F.posexplode("keys").alias("level", "key")).join(baseline, "key", "left")
    asked = asked.withColumn("own", F.try_element_at("by", F.coalesce("source", F.lit(""))))
    # a text's own use of its last words is left out of what it is held against
    alone = F.coalesce(F.col("own.uses") - 1, F.lit(0)) >= ENOUGH_OWN
    asked = asked.select(*ids, "level", F.when(alone, F.col("own.uses")).otherwise(F.col("uses")).alias("uses"), F.when(alone, F.col("own.ends")).otherwise(F.col("ends")).alias("ends"))
    level = lambda k, c: F.max(F.when(F.col("level") == k, F.col(c)))
    stats = asked.groupBy(*ids).agg(*[level(k, c).alias(f"{c}{k}") for k in range(3) for c in ("uses", "ends")])
    use = lambda k: F.coalesce(F.col(f"uses{k}") - 1, F.lit(0))
    end = lambda k: F.coalesce(F.col(f"ends{k}"), F.lit(0))
    share = F.when(use(0) >= ENOUGH, end(0) / use(0)).when(use(1) >= ENOUGH, end(1) / use(1)).when((use(2) >= ENOUGH) & F.element_at("keys", 3).startswith("N"), end(2) / use(2)).otherwise(0.0)
    kept = open_.join(stats, ids, "left").join(spikes, F.col("source").eqNullSafe(F.col("__s")) & (F.col("n_chars") == F.col("__n")), "left")
    form = F.regexp_extract("reason", r"(\w+)$", 1)
    kept = materialise(kept.select(*ids, "source", "reason", form.alias("form"), share.alias("share"), ((use(0) >= ENOUGH) | (use(1) >= ENOUGH)).alias("known"), F.coalesce("spike", F.lit(False)).alias("spike")))
    # how many of a form's unended texts look finished, in the source and in all of them
    looks = ((F.col("share") >= END_SHARE) & ~F.col("spike")).cast("int")
    per_form = kept.groupBy(F.col("source").alias("__s"), F.col("form").alias("__f")).agg(F.count("*").alias("n"), F.sum(looks).alias("done"))
    in_all = per_form.groupBy("__f").agg(F.sum("n").alias("n_all"), F.sum("done").alias("done_all"))
    rates = per_form.join(in_all, "__f").select("__s", "__f", F.when(F.col("n") >= ENOUGH_OWN, F.col("done") / F.col("n")).when(F.col("n_all") >= ENOUGH_OWN, F.col("done_all") / F.col("n_all")).alias("rate"))
    judged_ = kept.join(rates, F.col("source").eqNullSafe(F.col("__s")) & (F.col("form") == F.col("__f")))
    mostly = F.coalesce(F.col("rate") > MOSTLY, F.lit(False))
    finished = F.when(F.col("rate") < RARELY, F.lit(False)).otherwise(F.col("share") >= F.when(mostly & F.col("known"), HARDLY).otherwise(END_SHARE))
    spike = F.col("spike") & ~mostly
    ruled = judged_.select(*ids, "source", F.when(spike, "cut").when(finished, "done").otherwise("cut").alias("verdict"), F.when(spike, "cut length").otherwise(F.col("reason")).alias("reason"))
    return one.where("verdict != 'open'").select(*ids, "source", "verdict", "reason").unionByName(ruled)


def normal_source(c: str) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def response_texts(evaluations: DataFrame, rollouts: DataFrame) -> DataFrame:
    """``table_name, record_id, resp_idx, source, max_words, text, loaded_at`` of every response and assistant turn."""
    a = evaluations.select(F.lit("evaluations").alias("table_name"), F.col("extra_info.id").cast("string").alias("record_id"), F.posexplode("responses").alias("resp_idx", "text"), normal_source("data_source").alias("source"), F.lit(None).cast("int").alias("max_words"), "loaded_at")
    said = F.filter("messages", lambda m: F.lower(F.trim(m["role"])).isin("assistant", "gpt", "model", "bot"))
    b = rollouts.select(F.lit("rollouts").alias("table_name"), F.col("request_id").alias("record_id"), F.posexplode(F.transform(said, lambda m: m["content"])).alias("resp_idx", "text"), normal_source("data_source").alias("source"), F.col("max_response_len").alias("max_words"), "loaded_at")
    return a.unionByName(b).where("record_id is not null")


def p2_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = response_texts(read(spark, sf_dir, "evaluations"), read(spark, sf_dir, "rollouts"))
    return judged(texts, ["table_name", "record_id", "resp_idx"], "loaded_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_judged(spark, sf_dir).where("verdict = 'cut'").select("table_name", "record_id", "resp_idx")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses and the share of cut ones per table and data source."""
    cut = F.sum((F.col("verdict") == "cut").cast("int"))
    return p2_judged(spark, sf_dir).groupBy("table_name", F.col("source").alias("data_source")).agg(F.count("*").alias("n"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("share"))
