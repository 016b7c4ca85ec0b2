"""Encoding of texts with a public byte-level BPE tokenizer.

A word (a piece of the tokenizer's split pattern) is encoded over a contiguous
array of part boundaries with the rank of every adjacent pair beside it: the
smallest rank is found by a scan, its inner boundary is deleted and the two
neighbouring ranks are refreshed, until no pair has a rank. Words of more than
LONG bytes, where repeated scans would cost the square of the length, take the
same merges from a heap of ranks. Encoded words are kept per Python worker in a
dictionary that is emptied when it is full.

Texts are encoded whole, one Arrow batch at a time, and leave as one flat
buffer of ids with offsets. The ranks (50,256 entries, a fixed vocabulary) are
broadcast, so executors need no tokenizer file.

Defined results: null and empty texts give an empty list; a blank text is
encoded as it is; strings of special tokens are ordinary text; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from goldenloom.session import table

LONG = 96
CACHE_WORDS = 300_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


NONE = 1 << 30


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one short word."""
    get = ranks.get
    cuts = list(range(len(word) + 1))
    near = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while near:
        low = min(near)
        if low == NONE:
            break
        i = near.index(low)
        del cuts[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[cuts[i] : cuts[i + 2]], NONE)
        if i:
            near[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: the same merges, in the same order, in n log n."""
    n, get = len(word), ranks.get
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := get(word[i : after[j]])) is not None:
            heapq.heappush(heap, (r, i, after[j]))

    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        j = after[i]
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


@lru_cache(maxsize=2)
def _splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern).findall


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.known = ranks, _splitter(pattern), {}

    def word(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return (merge_scan if len(raw) <= LONG else merge_heap)(raw, self.ranks)

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in self.split(text):
            ids = known.get(w)
            if ids is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                ids = self.word(w)
                if len(w) <= LONG:
                    known[w] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder per Python worker and broadcast vocabulary."""
    key = id(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, pattern)
    return _encoders[key]


def encode_texts(docs: DataFrame, keep: list[str], path: str | None = None, counts_only: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``ids`` of its ``text``, or with their number as ``tokens``."""
    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(path or vocabulary_path()))
    pattern = split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = _encoder(shared, pattern)
        for batch in batches:
            texts = batch.column(len(keep))
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            parts = []
            for i, text in enumerate(texts):
                ids = encoder.encode(t) if (t := text.as_py()) else []
                offsets[i + 1] = offsets[i] + len(ids)
                if not counts_only and ids:
                    parts.append(np.array(ids, np.int32))
            head = [batch.column(i) for i in range(len(keep))]
            if counts_only:
                tail, name = pa.array(np.diff(offsets).astype(np.int64)), "tokens"
            else:
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                tail, name = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "ids"
            yield pa.RecordBatch.from_arrays([*head, tail], [*keep, name])

    source = docs.select(*keep, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    schema = ", ".join([*fields, "tokens bigint" if counts_only else "ids array<int>"])
    return source.mapInArrow(run, schema)


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), ["doc_id"])


QUERIES = {"p8_ids": encoded}
ORACLES: dict[str, str] = {}
