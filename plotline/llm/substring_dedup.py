"""Substring dedup by difference-cover anchors.

A difference cover modulo PERIOD holds two members at every distance. Windows of ``window - PERIOD + 1`` words that
begin at such places (6 of 31) are hashed: two texts that share ``window`` words share one of these anchors at the
same place of the shared passage, wherever the passage stands in each. Anchors are range-sorted by hash, so one that
many texts have is dealt out over many tasks; those with a neighbour of the same hash, but for further copies of a
whole text, are shared. What they name is then extended: every window that holds a shared anchor is hashed (128 bits),
and a second range sort tells which of these windows begin in a document with a smaller id. No pairs are formed; a
passage costs a row for each of its places. Only texts with a shared anchor are looked at again.

A text whose exact copy has a smaller id is a repeat from end to end, and is settled by that. A text is known by its
128-bit hash, or between stages by its 64-bit hash together with its id.

Cases: a null or empty text has no words; a text shorter than the window has no windows and loses nothing; words
repeated within one document, or in documents of the same id, stay; a null id is neither smaller nor larger than
another, so its row loses nothing and takes nothing; repeated rows give repeated results; an empty table gives no
rows. Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import materialize, text_or_empty
from plotline.llm.sorted_runs import with_earlier

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # a difference cover modulo PERIOD: 6 * 5 differences, each one once
_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_ROWS = 1 << 19  # of a record batch


def _hashes(words: list[bytes]) -> np.ndarray:
    """Two columns of 64 bits for each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def _rolled(of_word: np.ndarray, starts: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A polynomial over the hashes of ``length`` words from each start."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(length):
        out = out * base + of_word[starts + j]
    return (out ^ (out >> np.uint64(32))) * base


def anchor_places(n_words: int, window: int) -> np.ndarray:
    places = np.arange(max(0, n_words - (window - PERIOD)))
    return places[np.isin(places % PERIOD, COVER)] if n_words >= window else places[:0]


def candidates(anchors: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Starts of the windows that hold an anchor."""
    starts = (anchors[:, None] - np.arange(PERIOD)).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= n_words - window)])


def _words(x: pa.Scalar) -> list[bytes]:
    return x.as_buffer().to_pybytes().split() if x.is_valid else []


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, kept, whole = [], [], []
        for x in batch.column("text"):
            words = _words(x)
            n.append(len(words))
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            whole.append(xxhash.xxh3_128_digest(x.as_buffer() if x.is_valid else b""))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(whole, pa.binary()), pa.array(n, pa.int64()), pa.array(kept)], ["doc_id", "node", "whole", "n_words", "all_sha256"])


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, size = [], 0
        for doc_id, node, x in zip(batch.column("doc_id").to_pylist(), batch.column("node").to_pylist(), batch.column("text"), strict=True):
            words = _words(x)
            if len(words) < window:
                continue
            at = anchor_places(len(words), window)
            key = _rolled(_hashes(words)[:, 0], at, window - PERIOD + 1, _BASE[0])
            parts.append((key.view(np.int64), np.full(len(at), node), at, np.full(len(at), doc_id)))
            size += len(at)
            if size >= _ROWS:
                yield _batch(parts, ["key", "node", "place", "doc_id"])
                parts, size = [], 0
        if parts:
            yield _batch(parts, ["key", "node", "place", "doc_id"])


def _batch(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, node, place and id, those whose key another node or place has too.

    The first and the last place of a partition may have theirs next door: they are taken for shared, which costs a
    few windows more to hash.
    """
    names = ["node", "doc_id", "place"]
    held, last = None, None  # the last place so far, not yet known to be shared; its key, node and place
    edge = True
    for batch in batches:
        key, node, place, doc_id = (batch.column(c).to_numpy() for c in ("key", "node", "place", "doc_id"))
        if not len(key):
            continue
        first = np.empty(len(key), bool)
        first[0] = (key[0], node[0], place[0]) != last
        first[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (place[1:] != place[:-1])
        last = (key[-1], node[-1], place[-1])
        key, node, place, doc_id = (x[first] for x in (key, node, place, doc_id))
        if held is not None:
            key, node, place, doc_id = (np.concatenate([a, b]) for a, b in zip(held[:4], (key, node, place, doc_id), strict=True))
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        shared = np.r_[held[4] if held is not None else edge, same] | np.r_[same, False]
        edge = False
        held = (key[-1:], node[-1:], place[-1:], doc_id[-1:], bool(shared[-1]))
        out = shared[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][out]) for x in (node, doc_id, place)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[1], held[3], held[2])], names)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["hi", "lo", "own", "r", "place"]
    for batch in batches:
        parts, size = [], 0
        for r, doc_id, x, anchors in zip(*(batch.column(c) for c in ("r", "doc_id", "text", "anchors")), strict=True):
            words = _words(x)
            starts = candidates(anchors.values.to_numpy(), len(words), window)
            of_word = _hashes(words)
            hi, lo = (_rolled(of_word[:, k], starts, window, _BASE[k]).view(np.int64) for k in (0, 1))
            parts.append((hi, lo, np.full(len(starts), doc_id.as_py()), np.full(len(starts), r.as_py()), starts))
            size += len(starts)
            if size >= _ROWS:
                yield _batch(parts, names)
                parts, size = [], 0
        if parts:
            yield _batch(parts, names)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for x, places in zip(batch.column("text"), batch.column("places"), strict=True):
            words, starts = _words(x), places.values.to_numpy()
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + window, -1)
            covered = np.cumsum(edges[:-1]) > 0
            removed.append(int(covered.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered).tolist()]).decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept)], ["node", "doc_id", "n_removed", "kept"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts with repeated windows: ``r, node, doc_id, text`` and, for each, ``r, places``: where those windows start.

    A text stands here once, by its least id.
    """
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id is not null and text is not null").select(F.xxhash64("text").alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    anchors = rows.mapInArrow(partial(_anchors, window=window), "key long, node long, place long, doc_id long")
    order = ["key", "node", "place", "doc_id"]
    shared = anchors.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_shared, "node long, doc_id long, place long")
    found = materialize(shared)
    anchored = found.groupBy("node", "doc_id").agg(F.collect_list("place").alias("anchors"))  # of one text: no more than it has words
    once = rows.groupBy("node", "doc_id").agg(F.first("text").alias("text"))  # rows that repeat id and text
    texts = materialize(once.join(anchored, ["node", "doc_id"]).withColumn("r", F.monotonically_increasing_id()))
    windows = texts.mapInArrow(partial(_windows, window=window), "hi long, lo long, own long, r long, place long")
    repeated = with_earlier(windows, ["hi", "lo"], carried=["r", "place"], partitions=partitions).where("earlier")
    return texts.drop("anchors"), repeated.groupBy("r").agg(F.collect_list("place").alias("places"))


def dedup(docs: DataFrame, window: int = WINDOW, partitions: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row of ``docs``.

    ``kept`` is the text that is left, words joined by one space, where something but not all was removed; else null
    (the words are then all there, or none).
    """
    texts, repeated = repeated_windows(docs, window, partitions)
    cut = texts.join(repeated, "r").select("node", "doc_id", "text", "places").mapInArrow(partial(_cut, window=window), "node long, doc_id long, n_removed long, kept string")
    cut = materialize(cut)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("node"), F.col("text").cast("binary").alias("text"))
    rows = materialize(plain.mapInArrow(_digest, "doc_id long, node long, whole binary, n_words long, all_sha256 string"))
    least = materialize(rows.groupBy("whole").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("whole", "least"))
    copy = (F.col("least") < F.col("doc_id")) & (F.col("n_words") >= window)
    return (
        rows.join(least, "whole", "left")
        .join(cut, ["node", "doc_id"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.sha2("kept", 256), "all_sha256")).alias("kept_sha256"),
            F.when(~F.coalesce(copy, F.lit(False)), F.col("kept")).alias("kept"),
        )
    )


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL over ``documents`` for the rows of :func:`dedup`, without ``kept``."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 w AS (SELECT r, doc_id, ws, len(ws) AS n, unnest(range(len(ws))) AS p FROM d),
 s AS (SELECT r, doc_id, p, ws[p + 1] AS word, CASE WHEN p + {window} <= n THEN array_to_string(ws[p + 1:p + {window}], ' ') END AS piece FROM w),
 l AS (SELECT r, p, word, CASE WHEN piece IS NOT NULL AND min(doc_id) OVER (PARTITION BY piece) < doc_id THEN p END AS gone FROM s),
 c AS (SELECT r, p, word, coalesce(max(gone) OVER (PARTITION BY r ORDER BY p) > p - {window}, false) AS covered FROM l),
 k AS (SELECT r, count(*) AS n_words, count(*) FILTER (covered) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT covered), '') AS kept FROM c GROUP BY r)
 SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
