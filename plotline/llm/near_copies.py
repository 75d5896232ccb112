"""The near-duplicate stage's links: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The SimHash operator's own search comes first: fingerprints over 5-word shingles, joined by their wiped
variants (:func:`simhash.near_pairs`), name candidates at three bits or fewer. At a similarity of 0.8 about
ten of 64 bits differ, which no segment of a length that would still tell unrelated texts apart survives;
so what is beyond three bits shares one of BANDS bands of BAND_ROWS least hashes, which a pair at 0.8 misses
once in about 17,000. Every candidate pair is verified on the texts' whole sets of shingles, unless four bits of
each least hash, compared inside the join, show that the similarity is far below (more than SKETCH_DIFFERS of
192 differ, which at 0.8 happens a few times in a million).

A large group is first linked through one member of each node's largest bucket, then through one member of
every bucket; then every pair of a bucket that is still in different components is compared, so that no pair
of a bucket is left out. By then most of a large group is one component; the others' sets, as 32-bit hashes,
are compared inside the join, so that hardly a pair below the bound comes out of it.

Cases: words are lower-cased (A-Z) and parted at ASCII white space; a shorter text than a shingle is one
shingle; null, empty and blank texts are copies of each other; repeated shingles count once; texts
with equal sets are one node, however many rows have them. Ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import materialize
from plotline.llm.components import connected_components
from plotline.llm.simhash import near_pairs
from plotline.llm.units import bound_batches

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 6
SKETCH_BITS, SKETCH_DIFFERS = 4, 62
_BLOCK = 256  # shingles whose least hashes are looked for at once, in a core's cache
_digest = xxhash.xxh3_64_digest
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(7)
_XOR, _ODD = (_rng.integers(1 << 31, size=(BANDS * BAND_ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(k) for k in (0, 1))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, put together from its words' hashes; one at least."""
    words = text.lower().split()
    of_word = np.frombuffer(b"".join(map(_digest, words)), np.uint64)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    out = np.full(n, min(len(words), SHINGLE_WORDS), np.uint64)
    for j in range(min(len(words), SHINGLE_WORDS)):
        out = out * _BASE + of_word[j : j + n]
    return np.unique((out ^ (out >> np.uint64(31))) * _BASE)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of several permutations of 32-bit hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max)
    mixed = np.empty((BANDS * BAND_ROWS, _BLOCK), np.uint32)
    for at in range(0, len(short), _BLOCK):
        part = short[at : at + _BLOCK]
        out = mixed[:, : len(part)]
        np.bitwise_xor(part, _XOR, out=out)
        np.multiply(out, _ODD, out=out)
        np.minimum(least, out.min(axis=1), out=least)
    return least


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band."""
    return _bands(least_hashes(hashes))


def _bands(least: np.ndarray) -> list[int]:
    rows, width = least.tobytes(), 4 * BAND_ROWS
    return [int.from_bytes(xxhash.xxh64_digest(rows[k * width : (k + 1) * width], seed=k), "big", signed=True) for k in range(BANDS)]


def _sketch(least: np.ndarray) -> list[int]:
    """SKETCH_BITS bits of each least hash, bit by bit, a long for 64 of them."""
    bits = [(least >> np.uint32(8 + k) & np.uint32(1)).astype(np.uint8) for k in range(SKETCH_BITS)]
    return np.packbits(np.concatenate(bits)).view(">i8").tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes, signed."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _text(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints, sketches, keys = [], [], [], []
        for t in batch.column("text"):
            hashes = shingles(_text(t))
            least = least_hashes(hashes)
            nodes.append(int.from_bytes(_digest(hashes.tobytes()), "big", signed=True))
            prints.append(fingerprint(hashes))
            sketches.append(_sketch(least))
            keys.append(_bands(least))
        columns = [*(batch.column(c) for c in ("r", "doc_id", "text_hash", "text")), *(pa.array(x, pa.int64()) for x in (nodes, prints)), *(pa.array(x, pa.list_(pa.int64())) for x in (sketches, keys))]
        yield pa.RecordBatch.from_arrays(columns, ["r", "doc_id", "text_hash", "text", "node", "fp", "sketch", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, known = None, None
    for batch in batches:
        u, v, true = batch.column("u"), batch.column("v"), []
        for hub, a, b in zip(u.to_pylist(), batch.column("a"), batch.column("b"), strict=True):
            if hub != last:
                last, known = hub, shingles(_text(a))
            true.append(similarity(known, shingles(_text(b))) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(true, pa.bool_()))


def _alike(a: str, b: str):
    """Whether two sketches leave it open that the similarity reaches the bound."""
    differs = ["bit_count(" + " | ".join(f"({a}[{3 * k + j}] ^ {b}[{3 * k + j}])" for k in range(SKETCH_BITS)) + ")" for j in range(3)]
    return F.expr(f"{' + '.join(differs)} <= {SKETCH_DIFFERS}")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` that are near copies, each asked once."""
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    left, right = texts.select(F.col("node").alias("u"), F.col("text").alias("a")), texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return materialize(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_verify, "u long, v long"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates ``(u, v)``: nodes of one fingerprint, through one of them, and of near fingerprints."""
    hubs = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "sketch")).alias("hub")).select("fp", "hub.*"))
    same = nodes.join(hubs.select("fp", F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch")), "fp").where("node <> hub").where(_alike("sketch", "hub_sketch"))
    near = near_pairs(hubs.select("fp")).withColumnsRenamed({"u": "fp_u", "v": "fp_v"})
    u, v = (hubs.select(F.col("fp").alias(f"fp_{x}"), F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "uv")
    near = near.join(u, "fp_u").join(v, "fp_v").where(_alike("sketch_u", "sketch_v"))
    return same.select(F.col("node").alias("u"), F.col("hub").alias("v")).unionByName(near.select("u", "v"))


def _apart(shared: DataFrame, roots: DataFrame, more_than: int) -> DataFrame:
    """The members, with their roots, of buckets of more than so many nodes that are not yet in one component."""
    named = shared.where(F.col("n") > more_than).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named)
    split = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    return materialize(named.join(materialize(split), "band"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique((shingles(_text(t)) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int32()))], ["node", "shingles"])


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, root`` of every row: rows of one root are linked by near copies."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = materialize(rows.mapInArrow(_describe, "r long, doc_id long, text_hash long, text binary, node long, fp long, sketch array<long>, bands array<long>"))
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("r", "fp", "sketch")).alias("first")).select("node", "first.*"))
    near = materialize(_by_fingerprint(nodes))
    keys = materialize(rows.select("r", "bands").join(nodes.select("node", "r"), "r").select("node", F.explode("bands").alias("band")))
    # each bucket's hub is another member, so that a large group meets many
    buckets = keys.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "band"), "node"))["node"].alias("hub")).where("n > 1")
    shared = materialize(keys.join(materialize(buckets), "band"))
    wanted = shared.select("node").unionByName(near.select(F.col("u").alias("node"))).unionByName(near.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(wanted.join(nodes, "node").select("node", "r", "sketch"))
    texts = materialize(rows.select("r", "text").join(wanted.select("node", "r"), "r").select("node", "text"))
    sketches = wanted.select("node", "sketch")
    links = _verified(near, texts)
    roots = connected_components(links)
    # what fingerprints did not bring together: each node with the hub of its largest bucket, then with all its hubs
    for largest in (True, False):
        members = _apart(shared, roots, 1)
        if largest:
            members = members.groupBy("node").agg(F.max(F.struct("n", "band", "hub", "root")).alias("most")).select("node", "most.*")
        hubs = sketches.join(roots, "node", "left").select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch"), F.coalesce("root", "node").alias("hub_root"))
        to_hub = members.join(sketches, "node").join(hubs, "hub").where(F.col("root") != F.col("hub_root")).where(_alike("sketch", "hub_sketch"))
        links = links.unionByName(_verified(to_hub.select(F.col("node").alias("u"), F.col("hub").alias("v")), texts))
        roots = connected_components(links)
    # buckets of two are settled; of larger ones, what the hubs did not bring together
    members = _apart(shared, roots, 2)
    sets = materialize(members.select("node").distinct().join(texts, "node").select("node", "text").mapInArrow(_sets, "node long, shingles array<int>"))
    members = materialize(members.join(sketches, "node").join(sets, "node"))
    a, b = (members.select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "sketch", "shingles"))) for x in "uv")
    # two more than meet, since two shingles of a text may share a short hash
    reached = F.expr("9 * (size(array_intersect(shingles_u, shingles_v)) + 2) >= 4 * (size(shingles_u) + size(shingles_v))")
    pairs = a.join(b, (a.band == b.band) & F.expr("root_u < root_v") & _alike("sketch_u", "sketch_v") & reached)
    more = _verified(pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")), texts)
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))
    return rows.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
