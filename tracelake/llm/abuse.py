"""P8: abusive, hateful or sexually explicit content, scored per document.

Words are restored first: invisible characters, look-alike letters, stretched letters, letters spelled out
one by one and digits or signs put for letters. A restored word is then run through the trie of the
lexicon by a Levenshtein automaton, in which a masked character matches any letter; words a few letters
away from a term count for it, swaps of neighbours as one edit, unless they are everyday words. The hits of a
sentence are scored with who is addressed and what is demanded, in it or in the sentence before. Words that
are only quoted or spoken of lose their weight: what stands in quotation marks, which may span sentences, loses
it where the sentence around it or one beside it says that something is quoted or reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.lexicon import CLAIMS, EVERYDAY, PHRASES, REPORTED, TRIGGERS, WEIGHTS, WORDS
from tracelake.session import read, require_columns, spread

#: Score from which a sentence, and with it the document, counts as abusive.
ABUSIVE = 1.5
#: What is left of a sentence's score when it only speaks of the words.
MENTIONED = 0.2
#: Words up to which a sentence takes its addressee from the one before, and the addressee's weight then.
CALLED_OUT, ADDRESSED_BEFORE = 5, 0.8
#: Letters of a word, repeats and joining signs left out, up to which it is restored.
LONGEST = 40
#: Length from which a word may be one edit, and two edits, away from a term.
ONE_EDIT, TWO_EDITS = 5, 11
#: Marks the classes of a word that is a term only but for a slip.
SLIP = "slip"
#: Words whose hits a worker keeps.
MEMO_ENTRIES = 300_000

# Signs and digits put for letters, and letters of other scripts that look like Latin ones.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "€": "e", "+": "t", "|": "l"}
_LOOKALIKES = dict(zip("авсеіјкмнорѕтухԁһԛԝɡɑοα", "abceijkmhopstyxdhqwgaoa"))
_TO_CYRILLIC = {"a": "а", "b": "в", "c": "с", "e": "е", "k": "к", "m": "м", "h": "н", "o": "о", "p": "р", "t": "т", "y": "у", "x": "х"}
_INVISIBLE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb\ufe00-\ufe0f]")
_MASKS = "*%#•_"
_CHUNK = re.compile(r"[\w$@!€+*%#•|][\w$@!€+*%#•|'’-]*")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._\-*·/~]){2,}[^\W\d_](?![^\W_])")
_HAN_GAP = re.compile(r"(?<=[㐀-鿿])[\s\-_.*·~​]+(?=[㐀-鿿])")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)]*\s+|[。！？]|\n+")
_ADDRESS = re.compile(next(p for k, w, p in PHRASES if k == "aim" and w == 1.0))
_LATIN, _CYRILLIC = re.compile(r"[a-z]"), re.compile(r"[а-яё]")
_COMPILED = [(kind, weight, re.compile(p)) for kind, weight, p in PHRASES]
_COPULA = re.compile(r"\b(?:are|is|were|sind|ist|gehört|son|es|sont|sono|são|é|è|а)\b|[—是]")
_QUOTATION = re.compile(r"“[^“”]+”|„[^“”„]+[“”]|«[^«»]+»|「[^「」]+」|\"(?<![\w\"].)[^\"\n]+\"(?!\w)|'(?<![\w'].)[^'\n]{3,}?'(?!\w)")
_REPORTED = re.compile(REPORTED)
_CLAIMS = re.compile(CLAIMS)
_REPEATS = re.compile(r"(.)\1{2,}")
_QUOTED_WORD = re.compile(r"[\"“„«‘'](\w+)[\"”“»’'](?=\s)")


def without_marks(text: str) -> str:
    """Compatibility forms united, invisible characters gone, accents kept where letters have them in words."""
    t = unicodedata.normalize("NFKC", text)
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    return t.casefold().replace("’", "'")


class Trie:
    """Terms as nested dicts; a node's ``""`` holds the term and its classes, ``"*"`` that any ending may follow."""

    def __init__(self, words: dict[str, dict[str, str]]):
        self.root: dict = {}
        for kind, by_language in words.items():
            for terms in by_language.values():
                for term in terms.split():
                    stem, prefix = (term[:-1], True) if term.endswith("*") else (term, False)
                    node = self.root
                    for c in stem:
                        node = node.setdefault(c, {})
                    entry = node.setdefault("", {"term": stem, "kinds": set(), "open": False})
                    entry["kinds"].add(kind)
                    entry["open"] |= prefix

    def search(self, word: str, edits: int) -> tuple[int, dict] | None:
        """The nearest term within ``edits`` of ``word``, by running the automaton of ``word`` over the trie.

        A state is a set of (place in the word, edits so far); a masked character of the word takes any letter.
        With edits to spare, the first letter has to be right, so only its part of the trie is walked.
        """
        best: tuple[int, dict] | None = None
        n = len(word)
        if not edits and "?" not in word:
            node = self.root
            for i, c in enumerate(word):
                node = node.get(c)
                if node is None:
                    break
                entry = node.get("")
                if entry and (entry["open"] or i + 1 == n):
                    best = 0, entry
            return best
        if edits:
            first = self.root.get(word[0])
            stack = [(first, close({(1, 0)}, n, edits))] if first else []
        else:
            stack = [(self.root, {(0, 0)})]
        while stack:
            node, states = stack.pop()
            entry = node.get("")
            if entry:
                costs = [e + (0 if entry["open"] and e == 0 else n - i) for i, e in states]
                cost = min(costs)
                if cost <= edits and (best is None or cost < best[0] or cost == best[0] and len(entry["term"]) > len(best[1]["term"])):
                    best = cost, entry
            for c, child in node.items():
                if c:
                    step = set()
                    for i, e in states:
                        if i < n and (word[i] == c or word[i] == "?"):
                            step.add((i + 1, e))
                        elif e < edits:
                            step.add((i, e + 1))
                            if i < n:
                                step.add((i + 1, e + 1))
                    if step:
                        stack.append((child, close(step, n, edits)))
        return best


    def nearest(self, word: str, edits: int) -> tuple[int, dict] | None:
        """As ``search``, but a swap of neighbours is one edit too, and the first letter may be the wrong one."""
        best = self.search(word, edits)
        if best is not None and best[0] <= 1:
            return best
        swapped = (word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1) if word[i] != word[i + 1])
        first = (x for c in self.root for x in (c + word[1:], c + word))
        for x in (*swapped, word[1:], *first):
            got = self.search(x, 0)
            if got is not None and not got[1]["open"]:
                return 1, got[1]
        return best


def close(states: set[tuple[int, int]], n: int, edits: int) -> set[tuple[int, int]]:
    """``states`` with those reached by leaving out characters of the word; dominated ones dropped."""
    least: dict[int, int] = {}
    for i, e in states:
        while i <= n and e <= edits:
            if least.get(i, edits + 1) <= e:
                break
            least[i] = e
            i, e = i + 1, e + 1
    return set(least.items())


class Scorer:
    def __init__(self) -> None:
        self.trie = Trie(WORDS)
        self.everyday = frozenset(EVERYDAY.split())
        self.memo: dict[str, tuple[str, frozenset[str]]] = {}
        import ahocorasick

        self.triggers = ahocorasick.Automaton()
        for t in TRIGGERS.split():
            self.triggers.add_word(t.replace("·", " "), True)
        self.triggers.make_automaton()

    def restore(self, token: str) -> tuple[str, frozenset[str]]:
        """The lexicon's term for ``token`` with its classes, or the plain token and none."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            got = self.memo[token] = self._restore(token)
        return got

    def _restore(self, token: str) -> tuple[str, frozenset[str]]:
        none: frozenset[str] = frozenset()
        plain = token.strip("!_*'+|-")
        letters = sum(c.isalpha() for c in token)
        if letters < 1 or token.isdigit():
            return plain or token, none
        if len(token) > LONGEST:
            token = _REPEATS.sub(r"\1", token)
            plain = token.strip("!_*'+|-")
            if len(token.replace("-", "").replace("_", "").replace("*", "")) > LONGEST:
                return plain or token, none
        forms = [plain]
        disguised = any(c in LEET or c in _MASKS for c in token.rstrip("!")) or "-" in plain or "_" in plain
        if disguised:
            body = token.rstrip("!") if any(c in LEET or c in _MASKS for c in token.rstrip("!")) else token
            mapped = "".join(LEET.get(c, "?" if c in _MASKS else c) for c in body.strip("'-"))
            forms.append(mapped.replace("-", "").replace("_", ""))
            forms.append(body.translate({ord(c): None for c in "-_*·"}))
            if "1" in body or "!" in body or "|" in body:
                forms.append("".join("l" if c in "1!|" else LEET.get(c, "?" if c in _MASKS else c) for c in body.strip("'-")))
        mixed = bool(_LATIN.search(plain)) and not plain.isascii()
        for f in list(forms):
            if not f.isascii():
                if _CYRILLIC.search(f):
                    forms.append("".join(_LOOKALIKES.get(c, c) for c in f))
                    forms.append("".join(_TO_CYRILLIC.get(c, c) for c in f))
                bare = "".join(c for c in unicodedata.normalize("NFKD", f) if not unicodedata.combining(c))
                forms.append(bare)
        for f in list(forms):
            squeezed = _REPEATS.sub(r"\1", f)
            if squeezed != f:
                disguised = True
                forms += [squeezed, _REPEATS.sub(r"\1\1", f)]
        forms = list(dict.fromkeys(x for x in forms if x))
        for f in forms:
            if f.count("?") * 2 > len(f) + 4 or f.count("?") >= len(f) - 1:
                continue
            hit = self.trie.search(f, 0)
            if hit:
                return hit[1]["term"] if not hit[1]["open"] else plain, frozenset(hit[1]["kinds"])
        for f in forms:
            edits = 2 if len(f) >= TWO_EDITS else 1 if len(f) >= ONE_EDIT else 0
            if edits and "?" not in f:
                # a disguise keeps the first letter; a slip may change any, and isn't an everyday word
                hit = self.trie.search(f, edits) if disguised or mixed else self.trie.nearest(f, edits) if f not in self.everyday else None
                if hit and len(hit[1]["term"]) >= ONE_EDIT:
                    slip = not (disguised or mixed) and not self.dropped(f, hit[1]["term"])
                    return hit[1]["term"], frozenset(hit[1]["kinds"] | ({SLIP} if slip else set()))
        return plain, none

    @staticmethod
    def dropped(word: str, term: str) -> bool:
        """Whether ``word`` is ``term`` with a letter doubled or dropped, and the same first and last letter."""
        if word[0] != term[0] or word[-1] != term[-1] or len(word) == len(term):
            return False
        longer, shorter = (word, term) if len(word) > len(term) else (term, word)
        return any(longer[i] == longer[i - 1] and longer[:i] + longer[i + 1 :] == shorter for i in range(1, len(longer))) or len(word) < len(term) and len(word) >= 6

    def sentence(self, text: str, before: str = "", spans: tuple[tuple[int, int], ...] = (), framed: bool = False) -> tuple[float, set[str]]:
        """Score and classes of one sentence of restored text.

        ``before`` is the sentence before, ``spans`` the parts of this one that stand in quotation marks,
        ``framed`` whether a sentence beside it says that something is quoted.
        """
        restored, kinds, outside = text, [], False
        for m in _CHUNK.finditer(text):
            word, found = self.restore(m[0])
            if found:
                kinds.append(found)
                outside |= not any(a <= m.start() < b for a, b in spans)
                restored = restored.replace(m[0], word, 1)
        if not kinds and next(self.triggers.iter(text), None) is None:
            return 0.0, set()
        bare = "".join(" " if any(a <= i < b for a, b in spans) else c for i, c in enumerate(text)) if spans else text
        hits = [(k, w) for k, w, p in _COMPILED if p.search(restored)]
        if not kinds and not any(k in ("threat", "wish", "call", "act", "noun", "dehum") for k, _ in hits):
            return 0.0, set()
        # a slip could be a name or a word of another language: it needs a sure word or a person spoken to beside it
        if all(SLIP in found for found in kinds) and not any(k in ("adj", "wish", "threat", "call", "act") or k == "aim" and w >= 1.0 or k == "group" and any("dehum" in found for found in kinds) for k, w in hits):
            return 0.0, set()
        total = {k: 0.0 for k in ("noun", "adj", "dehum", "sex")}
        for found in kinds:
            for k in found - {SLIP}:
                total[k] += WEIGHTS[k]
        by: dict[str, float] = {}
        for k, w in hits:
            by[k] = max(by.get(k, 0.0), w) if k in ("aim", "group", "mention") else by.get(k, 0.0) + w
        noun = total["noun"] + by.get("noun", 0.0)
        adj = total["adj"] + by.get("adj", 0.0)
        dehum = total["dehum"] + by.get("dehum", 0.0)
        if len(restored.split()) <= CALLED_OUT and _ADDRESS.search(before):
            by["aim"] = max(by.get("aim", 0.0), ADDRESSED_BEFORE)
        aim, wish, threat = by.get("aim", 0.0), by.get("wish", 0.0), by.get("threat", 0.0)
        scores = {
            "insult": (noun + min(adj, 1.2) + aim if noun else 0.0) + (wish if noun or wish >= 1.5 else 0.0),
            "threat": threat,
            "hate": (by.get("call", 0.0) + dehum + by.get("group", 0.0)) if by.get("call") or dehum and by.get("group") and _COPULA.search(restored) else 0.0,
            "sexual": total["sex"] + by.get("act", 0.0) if total["sex"] or by.get("act", 0.0) >= 1.5 else 0.0,
        }
        if noun and not adj and not wish and not threat and aim < 1.0:
            scores["insult"] = min(scores["insult"], noun + aim - 0.2)
        if spans and not outside and kinds:
            outside = any(p.search(bare) for k, w, p in _COMPILED if k in ("threat", "wish", "call", "act", "noun", "dehum"))
        only_quoted = bool(spans) and not outside
        # a subject merely named doesn't soften what is said to someone's face
        spoken_of = by.get("mention", 0.0) >= 1.0 or bool(_CLAIMS.search(restored)) and (aim < 1.0 or only_quoted)
        quoted = only_quoted and (framed or bool(_REPORTED.search(bare))) or threat == 0 and bool(_QUOTED_WORD.search(text))
        out = {k: v * (MENTIONED if spoken_of or quoted else 1.0) for k, v in scores.items()}
        return max(out.values()), {k for k, v in out.items() if v >= ABUSIVE}

    def document(self, text: str | None) -> tuple[float, list[str]]:
        """The highest score of a sentence within its window, and the classes that reach the threshold."""
        if not text or not text.strip():
            return 0.0, []
        t = _HAN_GAP.sub("", without_marks(text))
        t = _SPELLED.sub(lambda m: re.sub(r"[ ._\-*·/~]", "", m[0]), t)
        places, pos = [], 0
        for m in _SENTENCE.finditer(t):
            places.append((pos, m.start() + (m[0][0] != "\n")))
            pos = m.end()
        places = [(a, b) for a, b in [*places, (pos, len(t))] if t[a:b].strip()]
        quotations = [m.span() for m in _QUOTATION.finditer(t)]
        best, classes, first = 0.0, set(), 0
        for k, (a, b) in enumerate(places):
            while first < len(quotations) and quotations[first][1] <= a:
                first += 1
            spans = []
            for q in range(first, len(quotations)):
                if quotations[q][0] >= b:
                    break
                spans.append((max(0, quotations[q][0] - a), min(b, quotations[q][1]) - a))
            framed = bool(spans) and any(_REPORTED.search(_QUOTATION.sub(" ", t[c:d])) for c, d in (*places[max(0, k - 1) : k], *places[k + 1 : k + 2]))
            score, kinds = self.sentence(t[a:b], t[slice(*places[k - 1])] if k else "", tuple(spans), framed)
            best = max(best, score)
            classes |= kinds
        return round(best, 4), sorted(classes)


def _scorer() -> Scorer:
    """One scorer per Python worker, kept while the worker is reused."""
    if "scorer" not in _scorer.__dict__:
        _scorer.__dict__["scorer"] = Scorer()
    return _scorer.__dict__["scorer"]


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, score, kinds, is_abusive``: one row per input row.

    The score is 0 where nothing was found, for null, empty and blank texts too; from ABUSIVE on a document
    counts as abusive. Whole texts are read. Repeated rows and null ids and sources stay. No shuffle.
    """
    require_columns(docs, id_col, text_col, source_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer()
        for f in frames:
            got = [scorer.document(t) for t in f[text_col]]
            yield pd.DataFrame({id_col: f[id_col], source_col: f[source_col], "score": [g[0] for g in got], "kinds": [g[1] for g in got], "is_abusive": [g[0] >= ABUSIVE for g in got]})

    kinds = dict(docs.dtypes)
    return spread(docs.select(id_col, text_col, source_col)).mapInPandas(run, f"`{id_col}` {kinds[id_col]}, `{source_col}` {kinds[source_col]}, score double, kinds array<string>, is_abusive boolean")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents")).where("is_abusive").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents")).select("doc_id", "score", F.array_join("kinds", ",").alias("kinds"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the share of abusive ones per source."""
    n = F.sum(F.col("is_abusive").cast("int"))
    return scored(read(spark, sf_dir, "documents")).groupBy("source").agg(F.count("*").alias("n"), n.alias("n_abusive"), F.round(n / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
