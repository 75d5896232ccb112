"""Splitting texts into units that a byte-level BPE encodes independently, and remembering them.

The pre-token pattern never reaches from a non-space character into the white space after it. So a
text may be cut before each run of white space that follows a non-space character; the pieces, each a
run of white space and a run of other characters, encode alike alone and in their text. Most pieces
of a corpus repeat, and a bounded memo in each Python worker keeps their encodings.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: White space as Unicode has it (fixed value).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_EDGE = re.compile(f"^[{SPACE}]|[{SPACE}]$|^$")
MEMO_ENTRIES = 200_000
_LONG = 200  # longer units are encoded anew each time, so that the memo's size is bounded
_CHUNK = 1 << 20  # characters split at once
_PUNCTUATION = ".,;:!?%$&*#|\"')("  # after letters, a run of these is a pre-token of its own


def _regular(pieces: set[str]) -> bool:
    """No piece is empty, or begins or ends with white space; printable text has none but the space itself."""
    return "" not in pieces and (all(map(str.isprintable, pieces)) or not any(map(_EDGE.search, pieces)))


class Memo:
    """``encode(units)`` remembered by unit. A unit of one space and a word is kept by the word.

    A new unit of letters and punctuation is put together from its two parts, which are far fewer.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = MEMO_ENTRIES):
        self.encode, self.entries = encode, entries
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.parts: dict[str, dict[str, bytes]] = {"": {}, " ": {}}  # by what goes before

    def _learn(self, known: dict[str, bytes], new: set[str], lead: str) -> None:
        led, plain = self.parts[lead], self.parts[""]
        later = []
        for unit in new:
            core = unit.rstrip(_PUNCTUATION)
            if len(core) == len(unit) or not core.isalpha():
                later.append((unit, unit, ""))
                continue
            rest = unit[len(core) :]
            first, second = led.get(core), plain.get(rest)
            if first is None or second is None:
                later.append((unit, core, rest))
            else:
                known[unit] = first + second
        fresh = {core for _, core, _ in later if core not in led}
        led.update(zip(fresh, self.encode([lead + x for x in fresh] if lead else list(fresh)), strict=True))
        rests = {rest for _, _, rest in later if rest and rest not in plain}
        if rests:
            plain.update(zip(rests, self.encode(list(rests)), strict=True))
        for unit, core, rest in later:
            known[unit] = led[core] + plain[rest] if rest else led[core]
        for part, learnt in ((led, fresh), (plain, rests)):
            for x in [x for x in learnt if len(x) > _LONG]:
                part.pop(x, None)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The joined encodings of each text, in order; ``b""`` for an empty one."""
        chunk, size = [], 0
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= _CHUNK:
                yield from self._collected(chunk)
                chunk, size = [], 0
        yield from self._collected(chunk)

    def _collected(self, texts: list[str]) -> list[bytes]:
        """One chunk, without the cycle collector, which would walk millions of short-lived strings."""
        gc.disable()
        try:
            return list(self._chunk(texts))
        finally:
            gc.enable()

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        for known, bound in ((self.words, self.entries), (self.others, self.entries // 5), (self.parts[" "], self.entries), (self.parts[""], self.entries // 5)):
            if len(known) > bound:
                known.clear()
        words, others = self.words, self.others
        split, new, odd = [], set(), {"\n"}
        for text in texts:
            lines, fresh, heads = [], set(), set()
            for line in text.split("\n"):
                pieces = line.split(" ")
                heads.add(head := pieces.pop(0))
                found = list(map(words.get, pieces))
                if None in found:
                    fresh.update(x for x, known in zip(pieces, found, strict=True) if known is None)
                else:
                    pieces = None
                lines.append((head, found, pieces))
            if not (_regular(heads) and _regular(fresh)):  # runs of white space: cut with care
                units = _UNIT.findall(text)
                split.append((units, None))
                odd.update(units)
            else:
                split.append((None, lines))
                new |= fresh
                odd |= heads
        odd.difference_update(others)
        self._learn(words, new, " ")
        self._learn(others, odd, "")
        for units, lines in split:
            if lines is None:
                yield b"".join(map(others.__getitem__, units))
            else:
                whole = []
                for head, found, pieces in lines:
                    if pieces is not None:
                        found = [words[x] if known is None else known for x, known in zip(pieces, found, strict=True)]
                    whole.append(others[head] + b"".join(found))
                yield others["\n"].join(whole)
        for known, learnt in ((words, new), (others, odd)):
            for x in learnt:
                if len(x) > _LONG:
                    known.pop(x, None)


def texts_of(column: pa.Array) -> Iterator[str]:
    """Each text of a string column, null as empty, one Python string at a time."""
    for x in column:
        yield x.as_py() or ""


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep an Arrow batch of whole texts small, however long the texts are."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
