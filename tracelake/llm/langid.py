"""P1: language of documents and of one-language segments by nearest centroid.

A text is a TF-IDF vector over character n-grams; each language has several centroids, found by spherical
k-means over its samples. The nearest centroid by cosine gives the language. A text too far from all of
them, or about as near to another language, is rejected and gets no language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import read, require_columns, spread

#: Samples per language that the model is fitted on at most, and centroids per language.
MAX_SAMPLES, CENTROIDS, MAX_GRAM = 500, 4, 4
#: Rejection: least cosine to the nearest centroid, least lead over the nearest one of another language.
MIN_COSINE, MIN_LEAD = 0.12, 0.12
#: Lead from which a single sentence shows that its language is there; close relatives lead by less by chance.
SURE_LEAD = 0.42
#: The same over a relative of which the conversation holds more: a single sentence of it may look like the other's.
RELATIVE_LEAD = 0.66
# The languages that are near relatives of each other.
RELATIVES = ("French", "Italian", "Portuguese", "Spanish")
#: Sentences scored in one go.
SCORED_AT_ONCE = 20_000
#: A sentence has at least so many words, or so many Han characters.
MIN_WORDS, MIN_HAN = 4, 6
#: Words whose n-grams a worker keeps; texts outside bring few words twice.
MEMO_ENTRIES = 200_000

# Names and codes of the eight languages.
NAMES = {
    "English": "english en eng",
    "German": "german de deu ger deutsch",
    "Spanish": "spanish es spa español espanol castellano",
    "French": "french fr fra fre français francais",
    "Italian": "italian it ita italiano",
    "Portuguese": "portuguese pt por português portugues",
    "Russian": "russian ru rus русский",
    "Chinese": "chinese zh zho chi 中文 汉语 普通话 mandarin",
}
_BY_NAME = {n: language for language, names in NAMES.items() for n in names.split()}


def named_language(label: str | None) -> str | None:
    """The English name behind a label: code, own name, spelling and region don't matter; None if it names none of the eight."""
    s = unicodedata.normalize("NFC", label or "").strip().casefold()
    return _BY_NAME.get(s) or _BY_NAME.get(re.split(r"[-_ (]", s, maxsplit=1)[0] if s else "")


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*", re.UNICODE)
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_NOT_PROSE = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|\$\$.*?\$\$|\$[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)|\\[a-zA-Z]+(?:\{[^{}\n]*\})*|https?://\S+|<\|?/?[A-Za-z_][^<>\n]{0,60}\|?>",
    re.S,
)
_QUOTED = re.compile(
    r"\[[^\[\]\n]*\]|“[^“”\n]*”|„[^“”„\n]*[“”]|«[^«»\n]*»|‹[^‹›\n]*›|「[^「」\n]*」|『[^『』\n]*』|《[^《》\n]*》|\"(?<![\w\"].)[^\"\n]*\"(?!\w)|'(?<![\w'].)[^'\n]{3,}?'(?!\w)|‘(?<!\w.)[^‘’\n]*’(?!\w)"
)
_BLOCK_QUOTE = re.compile(r"^[ \t]{0,3}>[^\n]*$", re.M)
_CYRILLIC, _LETTERS, _LATIN = re.compile(r"[а-яёіѕјԁ]", re.I), re.compile(r"[^\W\d_]+"), re.compile(r"[A-Za-z]")
# Cyrillic letters that look like Latin ones.
_LOOKALIKES = str.maketrans("авсеѕіјкмнорԛтухһԁАВСЕКМНОРТУХІЈЅ", "abcesijkmhopqtyxhdABCEKMHOPTYXIJS")
_ENDS = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][”」』）]*|\n+|;\s+")


def one_script(text: str) -> str:
    """``text`` with Cyrillic letters of words that hold Latin ones too put back to the Latin letters they look like."""
    if text.isascii() or not _CYRILLIC.search(text) or not _LATIN.search(text):
        return text
    return _LETTERS.sub(lambda m: m[0].translate(_LOOKALIKES) if _LATIN.search(m[0]) else m[0], text)


def prose(text: str, quotes: bool = False) -> str:
    """``text`` without code, formulas, markup and quotations; block quotations stay with ``quotes``."""
    t = _NOT_PROSE.sub(" , ", one_script(text))
    if not quotes and ">" in t:
        t = _BLOCK_QUOTE.sub("", t)
    return _QUOTED.sub(" , ", t)


def sentences(text: str | None, quotes: bool = False) -> list[str]:
    return [s for s in (p.strip() for p in _ENDS.split(prose(text or "", quotes))) if s]


def is_whole(sentence: str) -> bool:
    """Whether there is enough of a sentence to count as one."""
    han = len(_HAN.findall(sentence))
    if han >= MIN_HAN:
        return True
    return len(_WORD.findall(sentence)) >= MIN_WORDS


class LanguageModel(dict):
    """Centroids, and a memo from word to its n-grams and dot products."""

    def __init__(self, grams: dict[str, int], idf: np.ndarray, centroids: np.ndarray, languages: list[str]):
        super().__init__()
        self.grams, self.idf, self.centroids, self.languages = grams, idf, centroids, languages
        self.names = sorted(set(languages))
        self.dots, self.norms, self.ids = np.zeros((4096, len(languages)), np.float32), np.zeros(4096, np.float32), []
        kin = np.array([n in RELATIVES for n in self.names], dtype=bool)
        self.related = kin[:, None] & kin[None, :]
        self.starts = np.array([languages.index(n) for n in self.names], dtype=np.int64)

    @staticmethod
    def words(text: str) -> list[str]:
        plain = _WORD.findall(text.replace("’", "'").lower())
        if not _HAN.search(text):
            return plain
        out = []
        for w in plain:
            if _HAN.search(w):
                out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
            else:
                out.append(w)
        return out

    @staticmethod
    def grams_of(word: str) -> list[str]:
        w = word if _HAN.search(word) else f" {word} "
        return [w[i : i + n] for n in range(1, MAX_GRAM + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], seed: int = 0) -> LanguageModel:
        """From (language, text) pairs; pairs with a null on either side are left out."""
        per: dict[str, list[Counter]] = {}
        for language, text in sorted((a, b) for a, b in samples if a and b and b.strip()):
            if len(own := per.setdefault(language, [])) < MAX_SAMPLES:
                own.append(Counter(g for w in cls.words(text) for g in cls.grams_of(w)))
        docs = [(language, c) for language, own in per.items() for c in own]
        df = Counter(g for _, c in docs for g in c)
        grams = {g: i for i, g in enumerate(sorted(g for g, n in df.items() if n >= 2))}
        # document frequency is taken over languages: an n-gram spread evenly over all of them says nothing
        rate = np.zeros((len(per), len(grams)))
        for r, language in enumerate(sorted(per)):
            for c in per[language]:
                for g in c:
                    if g in grams:
                        rate[r, grams[g]] += 1 / len(per[language])
        rate /= np.maximum(rate.sum(0), 1e-12)
        spread_over = np.exp(-(rate * np.log(np.maximum(rate, 1e-12))).sum(0))
        idf = np.log(1.02 * max(len(per), 2) / np.maximum(spread_over, 1.0)) ** 2 + 0.05
        rng = np.random.default_rng(seed)
        centroids, languages = [], []
        for language in sorted(per):
            x = np.zeros((len(per[language]), len(grams)))
            for r, c in enumerate(per[language]):
                for g, n in c.items():
                    if g in grams:
                        x[r, grams[g]] = n * idf[grams[g]]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            k = min(CENTROIDS, len(x))
            c = x[rng.choice(len(x), k, replace=False)]
            for _ in range(10):
                near = (x @ c.T).argmax(1)
                c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
                # every centroid keeps part of the language's mean, so that small clusters don't lose its common n-grams
                c = 0.5 * c + 0.5 * x.mean(0)
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            centroids += list(c)
            languages += [language] * k
        return cls(grams, idf, np.array(centroids), languages)

    def __missing__(self, word: str) -> int:
        """The row of ``word`` in the tables of dot products and norms, which grow as words come in."""
        if len(self) >= len(self.dots):
            self.dots = np.concatenate([self.dots, np.zeros_like(self.dots)])
            self.norms = np.concatenate([self.norms, np.zeros_like(self.norms)])
        ids = np.array([self.grams[g] for g in self.grams_of(word) if g in self.grams], dtype=np.int64)
        at, n = np.unique(ids, return_counts=True)
        row = len(self)
        self.dots[row] = (self.centroids[:, ids] * self.idf[ids]).sum(1)
        self.norms[row] = np.sqrt(((n * self.idf[at]) ** 2).sum())
        self.ids.append(ids)
        self[word] = row
        return row

    def norm(self, rows: np.ndarray) -> float:
        """Norm of the vector of the words at ``rows``."""
        n = np.bincount(np.concatenate([self.ids[r] for r in rows]), minlength=1)
        at = np.flatnonzero(n)
        return float(np.sqrt(((n[at] * self.idf[at]) ** 2).sum())) if len(at) else 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Per text the cosine to the nearest centroid of each language; a lower bound of it where that passes MIN_COSINE already."""
        out = np.zeros((len(texts), len(self.names)))
        if not self.names:
            return out
        if len(self) > MEMO_ENTRIES:
            self.clear()
            self.ids.clear()
        split = [self.words(t) for t in texts]
        some = [i for i, w in enumerate(split) if w]
        if not some:
            return out
        rows = np.array([self[w] for i in some for w in split[i]], dtype=np.int64)
        starts = np.zeros(len(some), dtype=np.int64)
        np.cumsum([len(split[i]) for i in some[:-1]], out=starts[1:])
        # the norm of a sum is at most the sum of norms
        most = np.maximum(np.add.reduceat(self.norms[rows], starts), 1e-12)
        cos = np.add.reduceat(self.dots[rows], starts) / most[:, None]
        for k in np.flatnonzero(cos.max(1) < MIN_COSINE):
            cos[k] *= most[k] / max(self.norm(rows[starts[k] : starts[k + 1] if k + 1 < len(starts) else None]), 1e-12)
        out[some] = np.maximum.reduceat(cos, self.starts, axis=1)
        return out

    def named(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of ``scores``: the nearest language's place, its lead over the next (0 to 1), and whether it is near enough."""
        if not scores.shape[1]:
            return np.zeros(len(scores), np.int64), np.zeros(len(scores)), np.zeros(len(scores), bool)
        best = scores.max(1)
        second = np.partition(scores, -2, axis=1)[:, -2] if scores.shape[1] > 1 else np.zeros(len(scores))
        lead = np.where(best > 0, (best - second) / np.maximum(best, 1e-12), 0.0)
        return scores.argmax(1), lead, (best >= MIN_COSINE) & (lead >= MIN_LEAD)

    def classify_all(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """Language and confidence (the lead over the next language, from 0 to 1) of each text; None if rejected."""
        if not self.names or not texts:
            return [(None, 0.0)] * len(texts)
        return [(self.names[f] if ok else None, float(x)) for f, x, ok in zip(*self.named(self.scores(texts)))]

    def classify(self, text: str) -> tuple[str | None, float]:
        return self.classify_all([text])[0]

    def score_lists(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The scores of every list's sentences; many lists are scored in one go."""
        out: list[np.ndarray] = []
        at, n = 0, 0
        for i, x in enumerate(lists):
            n += len(x)
            if n >= SCORED_AT_ONCE or i + 1 == len(lists):
                group = lists[at : i + 1]
                all_scores = self.scores([s for part in group for s in part])
                out += np.split(all_scores, np.cumsum([len(part) for part in group])[:-1])
                at, n = i + 1, 0
        return out

    def segments(self, parts: list[list[str]], scores: list[np.ndarray]) -> list[list[tuple[str | None, float, int, bool]]]:
        """Per turn the runs of sentences of one language: language, mean confidence, characters, whether it holds a whole sentence.

        ``parts`` are the sentences of a conversation's turns, ``scores`` those of each. What shows a language for
        sure leads by SURE_LEAD, and over relatives of which the conversation holds more by RELATIVE_LEAD.
        """
        if not parts:
            return []
        all_scores = np.concatenate(scores)
        lengths = [len(s) for turn in parts for s in turn]
        first, lead, near = self.named(all_scores)
        size = np.bincount(first[near], weights=np.asarray(lengths, dtype=float)[near], minlength=max(1, len(self.names)))
        out, k = [], 0
        for turn in parts:
            runs: list[list] = []
            for s in turn:
                language, sure, n = self.names[first[k]] if near[k] else None, float(lead[k]), len(s)
                whole = language is not None and sure >= SURE_LEAD and is_whole(s)
                if whole and (more := self.related[first[k]] & (size > size[first[k]])).any():
                    whole = all_scores[k][more].max() <= (1 - RELATIVE_LEAD) * all_scores[k].max()
                if language is None and runs:
                    runs[-1][2] += n
                elif runs and runs[-1][0] == language:
                    runs[-1][1] += sure * n
                    runs[-1][2] += n
                    runs[-1][3] |= bool(whole)
                else:
                    runs.append([language, sure * n, n, bool(whole)])
                k += 1
            out.append([(a, b / max(n, 1), n, w) for a, b, n, w in runs])
        return out


def fitted(samples: DataFrame) -> LanguageModel:
    """The model of ``samples`` (``language, text``), at most MAX_SAMPLES texts a language, by id order of the text's hash."""
    from pyspark.sql import Window

    require_columns(samples, "language", "text")
    rows = samples.where("language is not null and text is not null").withColumn("__n", F.row_number().over(Window.partitionBy("language").orderBy(F.xxhash64("text"), "text"))).where(F.col("__n") <= MAX_SAMPLES)
    return LanguageModel.fit([(r[0], r[1]) for r in rows.select("language", "text").collect()])


MESSAGES = "array<struct<role:string,content:string>>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conversation_hash, language, turns, full, at``: the conversation, else the turns parsed from ``messages``."""
    require_columns(conversations, "conversation_hash", "language", "conversation", "messages", "loaded_at")
    parsed = F.from_json("messages", MESSAGES)
    return conversations.select(
        "conversation_hash", "language", F.coalesce(F.col("conversation"), F.when(F.col("conversation").isNull(), parsed)).alias("turns"),
        F.col("conversation").isNotNull().alias("full"), F.col("loaded_at").alias("at"),
    ).where("conversation_hash is not null")


def turns_in(column: pa.Array) -> list[list[tuple[str | None, str | None]]]:
    """Per row of an Arrow column of turns its ``(role, content)``; an empty list for null, a null turn has neither."""
    roles, contents = (x.to_pylist() for x in column.values.flatten())
    turns = list(zip(roles, contents))
    offsets = column.offsets.to_pylist()
    return [turns[a:b] if ok else [] for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist())]


def per_conversation(rows: DataFrame, schema: str, kind: pa.DataType, analyse) -> DataFrame:
    """Runs ``analyse(labels, turns of each row)`` on every batch and keeps one row's list of results per conversation.

    ``schema`` and ``kind`` are the fields of a result for Spark and Arrow. Copies of a conversation: the one with a
    ``conversation`` and the latest ``loaded_at`` counts. Results, not texts, are shuffled, and combined before the
    shuffle, so a key with many copies does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = analyse(b.column("language").to_pylist(), turns_in(b.column("turns")))
            yield pa.RecordBatch.from_arrays([b.column("conversation_hash"), b.column("full"), b.column("at"), pa.array(found, pa.list_(kind))], names=["conversation_hash", "full", "at", "found"])

    source = spread(rows.withColumn("at", F.coalesce(F.col("at").cast("string"), F.lit(""))))
    out = source.mapInArrow(run, f"conversation_hash string, full boolean, at string, found array<struct<{schema}>>")
    best = out.groupBy("conversation_hash").agg(F.max_by("found", F.struct("full", "at", F.size("found"))).alias("found"))
    return best.select("conversation_hash", F.explode("found").alias("f")).select("conversation_hash", "f.*")


SEGMENT = pa.struct([("turn_idx", pa.int32()), ("seg_idx", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("n_chars", pa.int32()), ("is_whole", pa.bool_()), ("label", pa.string())])


def conversation_languages(conversations: DataFrame, samples: DataFrame) -> DataFrame:
    """``conversation_hash, turn_idx, seg_idx, language, confidence, n_chars, is_whole, label`` of every segment.

    Turns with null or blank contents have no segments; a segment of text that no language claims has a
    null language. Null keys are left out, copies of a key count once, a conversation with neither field
    gives no row, an empty table none. Without samples every language is null.
    """
    shared = conversations.sparkSession.sparkContext.broadcast(fitted(samples))

    def analyse(labels, all_turns):
        model, out = shared.value, []
        parts = []
        for turns in all_turns:
            own = [sentences(t) for _, t in turns]
            # a conversation of nothing but block quotations is judged by them
            parts.append(own if any(own) else [sentences(t, quotes=True) for _, t in turns])
        flat = model.score_lists([x for own in parts for x in own])
        at = 0
        for label, own in zip(labels, parts):
            segments = model.segments(own, flat[at : at + len(own)])
            at += len(own)
            out.append([{"turn_idx": i, "seg_idx": j, "language": language, "confidence": round(sure, 4), "n_chars": n, "is_whole": whole, "label": label} for i, runs in enumerate(segments) for j, (language, sure, n, whole) in enumerate(runs)])
        return out

    return per_conversation(turns_of(conversations), "turn_idx:int,seg_idx:int,language:string,confidence:double,n_chars:int,is_whole:boolean,label:string", SEGMENT, analyse)


def found_languages(segments: DataFrame) -> DataFrame:
    """``conversation_hash, language``: the whole-sentence languages of the conversations whose label is missing, wrong or not enough."""
    known = F.create_map(*[F.lit(x) for kv in _BY_NAME.items() for x in kv])
    lowered = F.lower(F.trim("label"))
    label = F.coalesce(known[lowered], known[F.regexp_extract(lowered, r"^([^-_ (]*)", 1)])
    per = segments.where("language is not null").groupBy("conversation_hash", "language").agg(F.sum("n_chars").alias("n"), F.max("is_whole").alias("whole"), F.max(label).alias("label"))
    whole = F.collect_set(F.when(F.col("whole"), F.col("language")))
    one = per.groupBy("conversation_hash").agg(whole.alias("languages"), F.max_by("language", F.struct("n", "language")).alias("main"), F.max("label").alias("label"))
    case = F.col("label").isNull() | (F.col("label") != F.col("main")) | (F.size("languages") > 1)
    return one.where(case).select("conversation_hash", F.explode(F.array_union("languages", F.array("main"))).alias("language"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_languages(conversation_languages(read(spark, sf_dir, "wildchat"), read(spark, sf_dir, "lang_samples")))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_languages(read(spark, sf_dir, "wildchat"), read(spark, sf_dir, "lang_samples"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every conversation, its share of the text and the confidence."""
    per = p1_segments(spark, sf_dir).groupBy("conversation_hash", "language").agg(F.sum("n_chars").alias("n"), F.sum(F.col("confidence") * F.col("n_chars")).alias("sure"))
    best = per.where("language is not null").groupBy("conversation_hash").agg(F.max_by(F.struct("language", "n", "sure"), F.struct("n", "language")).alias("b"))
    total = per.groupBy("conversation_hash").agg(F.sum("n").alias("n_all"))
    return total.join(best, "conversation_hash", "left").select("conversation_hash", F.col("b.language").alias("language"), F.round(F.col("b.sure") / F.col("b.n"), 4).alias("confidence"), F.round(F.col("b.n") / F.col("n_all"), 4).alias("share"))
