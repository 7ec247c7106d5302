"""P5: passages of held-out items inside conversations, by greedy string tiling.

The items are few (a held-out set, taken in blocks of bounded size) and are sent to every executor; the
conversations are scanned once where they lie. An item is a candidate wherever the token pairs it shares
with a stretch of text, common ones too, could cover enough of a passage. For each candidate the longest
common runs are found by running Karp-Rabin hashing and marked as tiles, longest first, none overlapping,
until runs fall below the least length. An item has leaked if a passage of it stands in the text word for
word, or if tiles cover enough of some passage, in whatever order they stand, with words of enough weight: a word
of one item only weighs 1, one of all items nothing, so that sentence patterns that many items share show nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.langid import turns_in, turns_of
from tracelake.session import materialise, read, require_columns, spread

#: Least passage in tokens, share of it that tiles must cover, and least weight of what they cover if words are altered.
PASSAGE, COVERED, WEIGHT = 10, 0.8, 2.19
#: Shortest tile, and most tokens of text that an altered passage may reach over.
MIN_TILE, REACH = 2, 3 * PASSAGE
#: Half the length of the stretches of text in which candidates are looked for.
STEP = REACH + 2
#: Items in one block; a larger held-out set is taken block by block.
BLOCK_ITEMS = 20_000
#: Base and modulus of the rolling hash.
BASE, MOD = 1_000_003, (1 << 61) - 1
MEMO_ENTRIES = 200_000

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("авсеѕіјкмнорԛтухһԁԍʏɡɑοαερκνιτυχβηζμ", "abcesijkmhopqtyxhdgygaoaepkvituxbnzm")
_TOKEN = re.compile(r"[^\W_]+", re.UNICODE)
_LATIN = re.compile(r"[a-z]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")


def normal_tokens(text: str | None) -> list[str]:
    """Words of ``text`` without case, accents, markup, punctuation, invisible characters and look-alike letters."""
    if not text:
        return []
    if text.isascii():
        return _TOKEN.findall(text.lower())
    t = unicodedata.normalize("NFKD", text).casefold()
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return [w.translate(_LOOKALIKES) if not w.isascii() and (_LATIN.search(w) or len(w) == 1) else w for w in _TOKEN.findall(t)]


def without_one(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class TileIndex:
    """Items as token ids, the places of all pairs of tokens, and spellings one edit away from a token.

    ``df`` gives for every token of the items the number of items that hold it in the whole held-out set,
    ``n_items`` the size of that set, and ``elsewhere`` has the tokens of other items that are one edit away from one
    of these; so what comes out for an item doesn't depend on which others are in the index.
    """

    def __init__(self, items: list[tuple[int, list[list[str]], list[bool]]], df: dict[str, int], n_items: int, elsewhere: frozenset[str] = frozenset()):
        self.ids: dict[str, int] = {}
        self.elsewhere = elsewhere
        self.items: dict[int, list[int]] = {}
        for key, sentences, stock in items:
            seq: list[int] = []
            for words, is_stock in zip(sentences, stock):
                # a stock sentence leaves a gap that no run can cross
                seq += [-2] if is_stock else [self.ids.setdefault(w, len(self.ids)) for w in words]
            self.items.setdefault(key, []).extend([*seq, -2])
        n = max(n_items, 2)
        self.weight = {i: math.log(n / df.get(w, 1)) / math.log(n) for w, i in self.ids.items()}
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        owner: list[int] = []
        for key, seq in self.items.items():
            for p, (a, b) in enumerate(zip(seq, seq[1:]), len(owner)):
                if a >= 0 and b >= 0:
                    pairs[a, b].append(p)
            owner += [key] * len(seq)
        # places count through all items, one after the other
        self.pairs = {k: np.array(p) for k, p in pairs.items()}
        self.owner = np.array(owner, dtype=np.int64)
        self.near: dict[str, list[int]] = defaultdict(list)
        for w, i in sorted(self.ids.items()):
            if len(w) >= 4 and not w.isdigit():
                for v in set(without_one(w)):
                    self.near[v].append(i)
        self.memo: dict[str, tuple[int, ...]] = {}

    def options(self, word: str) -> tuple[int, ...]:
        """The id of ``word``, or if no item has it, those of all tokens one edit away."""
        got = self.memo.get(word)
        if got is None:
            found: dict[int, None] = {}
            if word in self.ids:
                found[self.ids[word]] = None
            elif len(word) >= 4 and not word.isdigit() and word not in self.elsewhere:
                shorter = without_one(word)
                for v in (word, *shorter):
                    found |= dict.fromkeys(self.near.get(v, ()))
                found |= dict.fromkeys(self.ids[v] for v in shorter if len(v) >= 4 and v in self.ids)
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            got = self.memo[word] = tuple(found)
        return got

    def candidates(self, text: list[tuple[int, ...]]) -> dict[int, list[int]]:
        """Items of which shared pairs could cover a passage, with the starts of the stretches of ``text`` where they do.

        Stretches of twice STEP overlap by half, so whatever reaches over at most STEP tokens lies in one of them.
        """
        found: dict[int, list[int]] = defaultdict(list)
        pairs, least = self.pairs, math.ceil(COVERED * PASSAGE)
        at = [(i, p) for i, (left, right) in enumerate(zip(text, text[1:])) if left and right for a in left for b in right if (p := pairs.get((a, b))) is not None]
        lo = hi = 0
        for start in range(0, len(text), STEP):
            while lo < len(at) and at[lo][0] < start:
                lo += 1
            while hi < len(at) and at[hi][0] < start + 2 * STEP - 1:
                hi += 1
            if 2 * (hi - lo) < least:
                continue
            first = np.concatenate([p for _, p in at[lo:hi]])
            covered = np.unique(np.concatenate((first, first + 1)))
            a, b = covered[: 1 - least], covered[least - 1 :]
            whole = a[(b - a < PASSAGE) & (self.owner[a] == self.owner[b])] if len(covered) >= least else a[:0]
            for key in np.unique(self.owner[whole]).tolist():
                found[key].append(start)
        return found

    def leaked(self, tokens: list[str]) -> list[int]:
        options = self.options
        text = [options(w) for w in tokens]
        out = []
        for key, starts in self.candidates(text).items():
            item = self.items[key]
            exact = [self.ids.get(w, -1) for w in tokens[starts[0] : starts[-1] + 2 * STEP]]
            if verbatim(item, exact):
                out.append(key)
                continue
            own = set(item)
            lo = max(0, starts[0] - len(item))
            # of the tokens a word may stand for, the item's own
            window = [next((t for t in o if t in own), -1) for o in text[lo : starts[-1] + 2 * STEP + len(item)]]
            if self.passage(item, tile(item, window)) or any(self.passage(item, tile(item, window[s - lo : s - lo + 2 * STEP])) for s in starts):
                out.append(key)
        return out

    def passage(self, item: list[int], tiles: list[tuple[int, int, int]]) -> bool:
        """Whether some passage of ``item`` is covered well enough by ``tiles`` lying close together in the text."""
        at: list[int | None] = [None] * len(item)
        for i, j, n in tiles:
            for k in range(n):
                at[i + k] = j + k
        for start in range(len(item) - PASSAGE + 1):
            end = start + PASSAGE
            if -2 in item[start:end]:
                continue
            hit = [p for p in range(start, end) if at[p] is not None]
            if len(hit) < COVERED * PASSAGE:
                continue
            spots = sorted(at[p] for p in hit)
            if spots[-1] - spots[0] > REACH:
                continue
            # the passage may be longer than the least one: take its neighbours along while they are covered
            a, b = start, end
            while a > 0 and at[a - 1] is not None:
                a -= 1
            while b < len(item) and at[b] is not None:
                b += 1
            if sum(self.weight[item[p]] for p in range(a, b) if at[p] is not None) >= WEIGHT:
                return True
        return False


def verbatim(item: list[int], text: list[int]) -> bool:
    """Whether ``PASSAGE`` consecutive tokens of ``item`` stand in ``text`` just as they are."""
    runs = {tuple(item[i : i + PASSAGE]) for i in range(len(item) - PASSAGE + 1)}
    return any(run in runs and min(run) >= 0 for run in zip(*(text[k:] for k in range(PASSAGE))))


def tile(item: list[int], text: list[int]) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in item, place in text, length)``, longest runs first, none overlapping."""
    used_i, used_t = [x < 0 for x in item], [x < 0 for x in text]
    tiles: list[tuple[int, int, int]] = []
    length = longest(item, text, used_i, used_t)
    while length >= MIN_TILE:
        found: list[tuple[int, int, int]] = []
        table = defaultdict(list)
        for i, h in rolling(item, used_i, length):
            table[h].append(i)
        for j, h in rolling(text, used_t, length):
            for i in table.get(h, ()):
                if item[i : i + length] == text[j : j + length]:
                    n = length
                    while i + n < len(item) and j + n < len(text) and not used_i[i + n] and not used_t[j + n] and item[i + n] == text[j + n]:
                        n += 1
                    found.append((n, i, j))
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, i, j in found:
            places[n, i].append(j)
        # of equal runs those with fewest places come first, and of their places the nearest to the tiles around
        for n, i in sorted(places, key=lambda x: (-x[0], len(places[x]), x[1])):
            free = [j for j in places[n, i] if not any(used_t[j : j + n])] if not any(used_i[i : i + n]) else []
            if free:
                j = min(free) if len(free) == 1 or not tiles else min(free, key=lambda j: (off(tiles, i, j), j))
                used_i[i : i + n] = used_t[j : j + n] = [True] * n
                tiles.append((i, j, n))
        length = length // 2 if length > 2 * MIN_TILE else length - 1
    return tiles


def off(tiles: list[tuple[int, int, int]], i: int, j: int) -> int:
    """How far place ``j`` of the text is from where item place ``i`` would stand next to the nearest tile."""
    a, b, _ = min(tiles, key=lambda t: abs(t[0] - i))
    return abs(j - b - (i - a))


def longest(item: list[int], text: list[int], used_i: list[bool], used_t: list[bool]) -> int:
    """A power-of-two length near the longest common run: the first search length."""
    n = MIN_TILE
    while n * 2 <= min(len(item), len(text)):
        have = {h for _, h in rolling(item, used_i, n * 2)}
        if not any(h in have for _, h in rolling(text, used_t, n * 2)):
            break
        n *= 2
    return n


def rolling(seq: list[int], used: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hashes of the runs of ``n`` unused tokens."""
    top = pow(BASE, n - 1, MOD)
    h = run = 0
    for i, x in enumerate(seq):
        if used[i]:
            h = run = 0
            continue
        if run == n:
            h = (h - (seq[i - n] + 7) * top) % MOD
        else:
            run += 1
        h = (h * BASE + x + 7) % MOD
        if run == n:
            yield i - n + 1, h


def held_out_sentences(items: DataFrame) -> DataFrame:
    """``item_id, seq, words, stock``: the sentences of every item; stock ones stand in several items."""
    require_columns(items, "item_id", "reward_model")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, w) for i, t in zip(f["item_id"], f["t"]) for k, w in enumerate(normal_tokens(s) for s in _SENTENCE.split(t)) if w]
            yield pd.DataFrame(rows, columns=["item_id", "seq", "words"])

    rows = items.where("item_id is not null").select("item_id", F.col("reward_model.ground_truth").alias("t")).where("t is not null").mapInPandas(run, "item_id bigint, seq int, words array<string>")
    stock = rows.groupBy("words").agg((F.count_distinct("item_id") > 1).alias("stock"))
    return rows.join(stock, "words")


def _index_of(shared) -> TileIndex:
    """One index per Python worker, kept while the worker is reused."""
    key, index = _index_of.__dict__.get("kept", (None, None))
    if key != shared.value[0]:
        key, index = shared.value[0], TileIndex(*shared.value[1:])
        _index_of.__dict__["kept"] = key, index
    return index


def neighbours(words: DataFrame, those: DataFrame) -> DataFrame:
    """The ``word`` of ``words`` that are one edit away from one of ``those``: both give the same with a letter left out."""
    spellings = F.expr("array_union(array(word), transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1, length(word)))))")
    spelt = lambda t: t.where("length(word) >= 4 and not word rlike '^[0-9]+$'").select("word", F.explode(spellings).alias("spelling"))
    near = spelt(words).join(spelt(those).select("spelling").distinct(), "spelling", "left_semi").select("word").distinct()
    return near.join(those, "word", "left_anti")


def leaks(conversations: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``item_id, conversation_hash``: distinct pairs of an item and a conversation that holds a passage of it.

    Items without ground truth and conversations without key or text take no part; copies of a
    conversation or of an item give one row; a passage must stand within one turn. Stock sentences of
    several items match nothing. Empty tables on either side give an empty result. Texts are taken whole.
    A held-out set of more than ``block_items`` items is taken block by block, each written before the next;
    the rows don't depend on the blocks.
    """
    spark = conversations.sparkSession
    sentences = held_out_sentences(items)
    n = items.where("item_id is not null").select("item_id").distinct().count()
    blocks = max(1, -(-n // block_items))
    if blocks > 1:
        sentences = materialise(sentences)
    frequency = sentences.where("not stock").select("item_id", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("df"))
    turns = spread(turns_of(conversations).select("conversation_hash", "turns"))
    out = None
    for block in range(blocks):
        mine = sentences.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        grouped: dict[int, tuple[list, list]] = {}
        for r in mine.orderBy("item_id", "seq").collect():
            words, stock = grouped.setdefault(r["item_id"], ([], []))
            words.append(r["words"])
            stock.append(r["stock"])
        words_here = mine.where("not stock").select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["df"] for r in frequency.join(words_here, "word").collect()}
        elsewhere = frozenset(r["word"] for r in neighbours(frequency, words_here).collect()) if blocks > 1 else frozenset()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(k, *v) for k, v in grouped.items()], df, n, elsewhere))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index_of(shared)
            for b in batches:
                rows = sorted({(i, h) for h, turns in zip(b.column("conversation_hash").to_pylist(), turns_in(b.column("turns"))) for _, text in turns if text for i in index.leaked(normal_tokens(text))})
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "conversation_hash"])

        part = turns.mapInArrow(run, "item_id bigint, conversation_hash string")
        if blocks > 1:
            part = materialise(part.distinct())
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "wildchat"), read(spark, sf_dir, "heldout"))


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out item with the number of conversations that hold a passage of it."""
    n = p5_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_conversations"))
    return read(spark, sf_dir, "heldout").select("item_id").distinct().join(n, "item_id", "left").withColumn("n_conversations", F.coalesce("n_conversations", F.lit(0).cast("long")))
