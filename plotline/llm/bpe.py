"""Byte-level BPE encoding and decoding with two tiers of lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token in one probe and one
comparison. Tier two: a pre-token that is not in the vocabulary is merged by rank with a heap of
adjacent pairs over doubly linked bytes, so that a pre-token of n bytes takes n log n steps.

Cases: a null or empty text has no ids and decodes to no bytes; special tokens' strings are ordinary
text; very long pre-tokens are merged whole; repeated rows are encoded alike, row by row; other
columns pass through, but a column already named like an output gives way to it.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import kept
from plotline.llm.units import SPACE, Memo, bound_batches, texts_of


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by id; ids run from 0 without a gap."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    return [tokens[i] for i in range(len(tokens))]


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class PerfectHash:
    """A minimal perfect hash by hash-and-displace: n keys in n slots.

    Keys fall into buckets; each bucket of several keys, largest first, gets the first displacement
    that sends all its keys to free slots; a bucket of one key names its slot outright (as -slot-1).
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        a, b = _hashes(keys)
        order = np.argsort(bucket := a % np.uint64(self.buckets), kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        self.shift = np.zeros(self.buckets, np.int64)
        owner = np.full(self.n, -1, np.int64)
        tries = np.arange(512, dtype=np.uint64)[:, None]
        singles = []
        for group in sorted(groups, key=len, reverse=True):
            at = int(bucket[group[0]])
            if len(group) == 1:
                singles.append((at, group[0]))
                continue
            step, found = np.uint64(0), False
            while not found:
                slots = self._slot(a[group], b[group], tries + step)
                free = (owner[slots] < 0).all(axis=1)
                for k in np.flatnonzero(free):
                    if len(set(slots[k].tolist())) == len(group):
                        owner[slots[k]], self.shift[at], found = group, int(step) + int(k), True
                        break
                step += np.uint64(len(tries))
        for (at, key), slot in zip(singles, np.flatnonzero(owner < 0), strict=False):
            owner[slot], self.shift[at] = key, -int(slot) - 1
        self.owner = owner  # slot -> index of its key, which is the token's id

    def _slot(self, a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return ((b + shift * (a >> np.uint64(17) | np.uint64(1))) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """The only key index that each of ``keys`` can have; whether it has is for the caller to compare."""
        a, b = _hashes(keys)
        shift = self.shift[(a % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._slot(a, b, np.maximum(shift, 0).astype(np.uint64)))
        return self.owner[slot]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))  # linked parts, by their first byte
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if j < 0 or j >= n or after[j] != end:  # one of the two has been merged meanwhile
            continue
        after[i], after[j], before[end] = end, -1, i
        if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
        if end < n and (r := get(word[i : after[end]])) is not None:
            heapq.heappush(heap, (r, i, after[end]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """The two tiers, for lists of units; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash):
        self.tokens, self.table = tokens, table
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)

    def __call__(self, units: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        split = list(map(self.pattern.findall, units))
        fresh = list({x for parts in split for x in parts})
        if fresh:
            words = [x.encode("utf-8", "replace") for x in fresh]
            tokens, ranks = self.tokens, self.ranks
            for text, word, at in zip(fresh, words, self.table.candidates(words).tolist(), strict=True):
                if tokens[at] == word:
                    known[text] = at.to_bytes(4, "little")
                else:
                    ids = merge(word, ranks)
                    known[text] = struct.pack(f"<{len(ids)}I", *ids)
        return [known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts)) for parts in split]


def _memo(model) -> Memo:
    tokens, pattern, table, key = model.value
    memos = kept("bpe")
    if key not in memos:
        memos.clear()
        memos[key] = Memo(Encoder(tokens, pattern, table))
    return memos[key]


def list_column(parts: list[bytes], kind: str = "int32") -> pa.Array:
    """A list column of the joined integers of each part."""
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.type_for_alias(kind), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))


def _encode(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    memo = _memo(model)
    for batch in batches:
        ids = list_column(list(memo.encode_all(texts_of(batch.column(at)))))
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*map(batch.column, rest), ids], [*(batch.schema.names[i] for i in rest), "ids"])


def _round_trip(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    """Encode and decode in one worker, where two steps would keep two for each task."""
    for batch in _encode(batches, model, at):
        yield from _decode(iter([batch]), model, "ids")


def _decode(batches: Iterator[pa.RecordBatch], model, ids: str) -> Iterator[pa.RecordBatch]:
    tokens = model.value[0]
    for batch in batches:
        column = batch.column(ids)
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        valid = column.is_valid().to_pylist()
        decoded = [b"".join(map(tokens.__getitem__, values[a:b].tolist())) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])


def _with_spaces(pattern: str) -> str:
    """The pattern with white space spelt out, since libraries differ on it."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class ByteBPE:
    """An encoder and decoder over DataFrames for one rank file.

    ``path`` and ``pattern`` are parameters; the vocabulary (its file's size, fixed) is broadcast once.
    """

    def __init__(self, spark, path: str, pattern: str):
        tokens = read_ranks(path)
        key = xxhash.xxh3_64_hexdigest(b"\0".join(tokens) + pattern.encode())
        self.model = spark.sparkContext.broadcast((tokens, _with_spaces(pattern), PerfectHash(tokens), key))
        bound_batches(spark)

    def encode(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``ids array<int>`` in place of the text column."""
        docs = docs.drop("ids")
        schema = ", ".join([*_fields(docs, text), "ids array<int>"])
        return docs.mapInArrow(partial(_encode, model=self.model, at=docs.columns.index(text)), schema)

    def round_trip(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``ids array<int>`` and, decoded from them, ``decoded binary`` in place of the text column."""
        docs = docs.drop("ids", "decoded")
        schema = ", ".join([*_fields(docs, text), "ids array<int>", "decoded binary"])
        return docs.mapInArrow(partial(_round_trip, model=self.model, at=docs.columns.index(text)), schema)

    def decode(self, encoded: DataFrame, ids: str = "ids") -> DataFrame:
        """``encoded`` with ``decoded binary`` added."""
        encoded = encoded.drop("decoded")
        schema = ", ".join([*_fields(encoded), "decoded binary"])
        return encoded.mapInArrow(partial(_decode, model=self.model, ids=ids), schema)


def _fields(df: DataFrame, but: str | None = None) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != but]


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows, and columns asked for."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
