"""Benchmark decontamination by pigeonhole edit matching.

A test item may stand in a text with up to e edits, e a share of its length. Cut into e + 1 pieces, an
edited copy keeps at least one piece whole. One Aho-Corasick pass finds all exact pieces in a text;
around each hit, Myers' bit-parallel algorithm computes the least edit distance of the whole item to
any part of the text, and copies within budget count. Case and runs of white space are ignored.

Cases: null and empty texts match nothing; null and empty items match nothing; an item too short for
an error is looked for exactly; of equal items each is reported; an item that stands in a text several
times is reported once, with its least distance; repeated rows are each reported; empty tables on
either side give no matches. A filter keeps all columns, whatever their names.

Items are searched in blocks of bounded size, each broadcast by itself, so any number of them can be
held against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import kept, materialize, shared_dir
from plotline.llm.units import bound_batches

ERROR_RATE = 0.06
BLOCK_BYTES = 16 << 20  # of item text in one broadcast


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their places."""
    cuts = [k * len(item) // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def least_distance(item: str, text: str, budget: int) -> int | None:
    """The least edit distance of ``item`` to any part of ``text``; None beyond ``budget`` (Myers, semi-global)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)  # vertical steps up and down, and the last row's value
    best = score
    for c in text:
        match = masks.get(c, 0)
        vertical = match | minus
        horizontal = (((match & plus) + plus) ^ plus) | match
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full  # no step comes in from below: a match may begin anywhere
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best = score
            if not best:
                break
    return best if best <= budget else None


class Matcher:
    """All items of one block, compiled for search."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items, found = [], {}
        for item_id, text in items:
            if text := normalize(text):
                errors = int(len(text) * error_rate)
                self.items.append((item_id, text, errors))
                for at, piece in pieces(text, errors):
                    found.setdefault(piece, []).append((len(self.items) - 1, at))
        self.search = ahocorasick.Automaton()
        for piece, places in found.items():
            self.search.add_word(piece, (len(piece), places))
        if found:
            self.search.make_automaton()
        self.any = bool(found)

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int]]:
        """``item_id, distance, budget`` of the items that stand in a text."""
        if not self.any or not (text := normalize(text)):
            return []
        best: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (length, places) in self.search.iter(text):
            for k, at in places:
                if best.get(k) == 0:
                    continue
                _, item, errors = self.items[k]
                start = end - length + 1 - at
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                if text.startswith(item, max(start, 0)):
                    distance = 0
                else:
                    distance = least_distance(item, text[max(0, start - errors) : start + len(item) + errors], errors)
                if distance is not None:
                    best[k] = min(distance, best.get(k, distance))
                    if first_only:
                        break
            if first_only and best:
                break
        return [(self.items[k][0], d, self.items[k][2]) for k, d in sorted(best.items())]


def _matcher(block) -> Matcher:
    key, items, error_rate = block.value
    matchers = kept("decontamination")
    if key not in matchers:
        matchers.clear()
        matchers[key] = Matcher(items, error_rate)
    return matchers[key]


def blocks(items: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """``item_id, text`` in broadcast blocks of about ``block_bytes`` of text each, one after the other.

    More than one block: the items are dealt into folders of a table once, and a block is read from its own when its
    turn comes, so that the driver holds one block at a time.
    """
    spark = items.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // block_bytes
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    if n > 1:
        path = shared_dir(spark)
        named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
        dealt = spark.read.schema("item_id long, text string, block long").parquet(path)
    for k in range(n):
        part = named if n == 1 else dealt.where(F.col("block") == k).drop("block")
        rows = [(r.item_id, r.text) for r in part.sort("item_id", "text").collect()]  # a block
        yield spark.sparkContext.broadcast((uuid4().hex, rows, error_rate))


def _match(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(block)
    for batch in batches:
        out = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for m in matcher.matches(t.as_py())]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "budget"])


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, distance, budget`` for every item that stands in a text; nothing is shuffled."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(items, error_rate, block_bytes):
        found = rows.mapInArrow(partial(_match, block=block), "doc_id long, item_id long, distance long, budget long")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(batches: Iterator[pa.RecordBatch], block, at: int) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(block)
    for batch in batches:
        keep = pa.array([not matcher.matches(t.as_py(), first_only=True) for t in batch.column(at)], pa.bool_())
        yield batch.filter(keep)


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in which any item stands; all columns stay.

    Each block of items sees what the one before it left, written in between, so a task runs one matcher at a time.
    """
    bound_batches(docs.sparkSession)
    at, before = docs.columns.index("text"), None
    for block in blocks(items, error_rate, block_bytes):
        docs = docs if before is None else materialize(docs)
        if before is not None:
            before.unpersist()
        docs = docs.mapInArrow(partial(_clean, block=block, at=at), docs.schema)
        before = block
    return docs
