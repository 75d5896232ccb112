"""SimHash near-duplicates, found by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit halves, fewer than the error budget of three plus one.
Of two fingerprints at three or fewer differing bits, one half then differs by one bit at most, so
the two share a variant of that half in which one bit is wiped out. Variants are joined on equality
and each pair is verified inside the join, where only true links come out.

Cases: a null text counts as empty; a text without words has fingerprint zero and links like any
other; shorter texts than a shingle are one shingle; repeated shingles count each time; equal texts
share a fingerprint and are linked through it rather than pairwise; a repeated or null ``doc_id``
is kept row by row (a null id never becomes a component's name unless all ids of it are null).
Other columns pass through untouched, whatever their names, when asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import materialize, unused_name
from plotline.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
_BLOCK = 1 << 16  # shingles whose bits are counted at once
_digest = partial(xxhash.xxh64_digest, seed=SEED)


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The SimHash of one whole text, as a signed 64-bit integer."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _BLOCK):
        block = np.frombuffer(b"".join(map(_digest, shingles[at : at + _BLOCK])), np.uint8)
        counts += np.unpackbits(block.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big", signed=True)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        fp = pa.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fp], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row, computed in Arrow batches; texts do not leave their task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_batches, "doc_id long, text_hash long, fp long")


def near_pairs(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct fingerprints ``fp`` -> verified links ``(u, v)``, u < v.

    A pair comes out for the variant whose wiped bit is the one that differs, or for bit 0 where the
    halves are equal; so each pair appears twice at most. Spark sizes the variants, 64 for each fingerprint, as
    the fingerprints themselves, so it is told to join by sorting and not to send them to the driver.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("two halves with one wildcard prove completeness for distances up to 3")
    half = F.when(F.col("i") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    wiped = half.bitwiseAND(F.expr("~shiftleft(1L, i % 32)"))
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        "fp", F.expr("shiftleft(cast(i as bigint), 32)").bitwiseOR(wiped).alias("variant")
    )
    a = variants.select("variant", F.col("fp").alias("u"))
    b = variants.select("variant", F.col("fp").alias("v"))
    i = "shiftrightunsigned(a.variant, 32)"
    differing = f"(case when {i} < 32 then (u ^ v) & 4294967295L else shiftrightunsigned(u ^ v, 32) end)"
    bit = f"cast({i} % 32 as int)"
    once = f"({differing} = shiftleft(1L, {bit}) or ({differing} = 0 and {bit} = 0))"
    return (
        a.alias("a")
        .join(b.alias("b").hint("merge"), F.expr(f"a.variant = b.variant and u < v and bit_count(u ^ v) <= {int(max_distance)} and {once}"))
        .select("u", "v")
    )


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root`` for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` reachable over links, the row itself included; ``root`` is the
    component's least fingerprint, which tells components apart even where ids repeat or are null.
    Only distinct fingerprints are joined, so a group of copies of any size costs one fingerprint.
    """
    rows = materialize(fingerprints(docs))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(near_pairs(nodes.select("fp"), max_distance))
    linked = nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(linked.join(names.hint("merge"), "root").select("fp", "component_id", "root"))
    return rows.join(named.hint("merge"), "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Keep of every component the row with the least ``doc_id`` (nulls last), with all its columns."""
    return keep_first(docs, near_duplicates(docs, max_distance))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Keep of every ``root`` in ``rows`` (``doc_id, text_hash, root``) the row of ``docs`` with the least ``doc_id``.

    A row that repeats both id and text of the one kept is dropped too, so one row of each group stays; where
    such rows differ in other columns, any one of them stays.
    """
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    names = [unused_name(docs, n) for n in ("_kept_id", "_kept_hash", "_own_hash")]
    kept = rows.groupBy("root").agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias(names[0]), F.col("k.text_hash").alias(names[1]))
    return (
        docs.withColumn(names[2], F.xxhash64("text"))
        .join(kept, F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.col(names[2]) == F.col(names[1])), "left_semi")
        .dropDuplicates(["doc_id", names[2]])
        .drop(names[2])
    )
