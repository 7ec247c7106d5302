"""P6: ids of a public byte-level BPE tokenizer, by forced-boundary splitting.

A pair of neighbouring bytes that lies inside no vocabulary token can't be bridged by a merge: whatever
the merge order, the two bytes end in different tokens. Such pairs mark certain cuts. A pre-token is cut
at all of them, each fragment is encoded on its own and the ids are joined; the result equals encoding
the pre-token as one, and no fragment needs work that grows faster than its own short length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelake.session import require_columns, spread

#: A vocabulary file above this size is refused, since it is sent to every executor.
MAX_VOCAB_BYTES = 32 << 20
#: Bytes above which a fragment's pairs are kept in a heap.
LONG_FRAGMENT = 100
#: Above every rank.
NO_RANK = 1 << 60
#: Pre-tokens kept with their ids in each worker; the memo starts anew when it is full.
MEMO_ENTRIES = 200_000


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The rank file's content and the pre-token pattern; ``path`` defaults to byte_bpe_50k."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        content = f.read(MAX_VOCAB_BYTES + 1)
    if len(content) > MAX_VOCAB_BYTES:
        raise ValueError("the vocabulary file is too large to send to every executor")
    return content, public_tokenizers.PATTERN


class ForcedBoundaryEncoder(dict):
    """A memo from pre-token to ids; a missing pre-token is cut and encoded."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        self.inside = bytearray(1 << 16)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.inside[a << 8 | b] = 1
        self.find = regex.compile(pattern).findall

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut between every two bytes that lie next to each other in no token."""
        cuts = [i for i in range(1, len(piece)) if not self.inside[piece[i - 1] << 8 | piece[i]]]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])]

    def encode_fragment(self, fragment: bytes) -> list[int]:
        """The ids of a fragment: the neighbours of least rank are merged, the first of equal ones, until none has a rank."""
        rank = self.ranks.get
        whole = rank(fragment)
        if whole is not None:
            return [whole]
        if len(fragment) > LONG_FRAGMENT:
            return self.encode_long(fragment)
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        ranked = [rank(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranked and (least := min(ranked)) != NO_RANK:
            i = ranked.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranked[i]
            if i < len(ranked):
                ranked[i] = rank(parts[i] + parts[i + 1], NO_RANK)
            if i:
                ranked[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[p] for p in parts]

    def encode_long(self, fragment: bytes) -> list[int]:
        """As :meth:`encode_fragment`, with the pairs in a heap: time grows as n log n, for runs such as a letter repeated."""
        rank, n = self.ranks.get, len(fragment)
        # a part is its start; its end is the next part's start
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(fragment[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01" * n)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= n or ends[j] != end:
                continue  # one of the two has been merged since
            alive[j] = 0
            ends[i] = end
            if end < n:
                before[end] = i
                if (r := rank(fragment[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := rank(fragment[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return [self.ranks[fragment[i : ends[i]]] for i in range(n) if alive[i]]

    def __missing__(self, piece: str) -> list[int]:
        ids = list(chain.from_iterable(map(self.encode_fragment, self.fragments(piece.encode("utf-8", "replace")))))
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self) > MEMO_ENTRIES:
            self.clear()
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))


def _encoder_of(shared) -> ForcedBoundaryEncoder:
    """One encoder per Python worker, kept while the worker is reused."""
    key = hash(shared)
    if _encoder_of.__dict__.get("key") != key:
        _encoder_of.__dict__.update(key=key, encoder=ForcedBoundaryEncoder(*shared))
    return _encoder_of.__dict__["encoder"]


def encode_documents(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every row's text, one row per input row.

    Special-looking strings are plain text. Null and empty texts get an empty list, blank ones the ids of
    their blanks. Repeated rows and null keys stay, an empty table gives an empty result; other columns
    are never read, whatever their names. No shuffle but the spreading of a scan with fewer splits than cores.
    """
    require_columns(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = _encoder_of(shared.value)
        for batch in batches:
            lists = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens bigint``: like :func:`encode_documents`, but only the number of ids."""
    require_columns(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(shared.value)
        for batch in batches:
            n = [len(encoder.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.session import read

    return encode_documents(read(spark, sf_dir, "documents"))
