"""Token ids in binary files of compressed byte planes, with a chunk index.

File: ``MAGIC``, chunks, the zstandard-compressed index, and a footer with the index's place. A chunk
holds a fixed number of ids (the last one fewer), transposed so that each of the four bytes of the
32-bit ids forms a plane of its own, each plane compressed by itself; high planes are almost all zero
and shrink to nothing. The index has the place, id count and plane sizes of each chunk and the id and
length of each document, so any document can be read from the chunks that hold it.

Files are in ascending document order, one or more for each range partition, and named anew by every
attempt of a task; the manifest, written by Spark's own commit, says which ones count, so a retried or
speculative task leaves files that nothing reads.

Cases: a null or empty text is a document of the end id alone; null ids come first; rows with the same
id stand beside each other, in order of a hash of their texts; an empty table writes no files and reads back no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.llm.common import kept, materialize, shared_dir
from plotline.llm.units import Memo, bound_batches, texts_of

MAGIC = b"PLANES01"
CHUNK_IDS = 1 << 16
MEMO_ENTRIES = 500_000  # words remembered in a worker, which runs this operator alone
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20  # the index of a file is held in memory while it is written and read
_FOOTER = struct.Struct("<QQQQ")  # index offset, index bytes, chunks, documents


class PlaneWriter:
    """Writes ids to a binary stream; :meth:`close` adds the index."""

    def __init__(self, out, chunk_ids: int = CHUNK_IDS):
        self.out, self.chunk_ids, self.at = out, chunk_ids, len(MAGIC)
        self.held, self.n_held, self.ids = [], 0, 0
        self.index: list[tuple[int, ...]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.zstd = zstandard.ZstdCompressor(level=1)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        if self.n_held >= self.chunk_ids:
            joined = np.concatenate(self.held)
            whole = len(joined) - len(joined) % self.chunk_ids
            for a in range(0, whole, self.chunk_ids):
                self._chunk(joined[a : a + self.chunk_ids])
            self.held, self.n_held = [joined[whole:]], len(joined) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
        packed = [self.zstd.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
        self.index.append((self.at, len(ids), *map(len, packed)))
        self.out.write(b"".join(packed))
        self.at += sum(map(len, packed))

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        index = self.zstd.compress(np.array(self.index, "<i8").tobytes() + np.array(self.docs, "<i8").tobytes())
        self.out.write(index + _FOOTER.pack(self.at, len(index), len(self.index), len(self.docs)))
        self.out.close()


def read_planes(source) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """``doc_id, start in the file, ids`` of every document of a seekable stream, a chunk at a time."""
    source.seek(source.size() - _FOOTER.size)
    at, size, chunks, docs = _FOOTER.unpack(source.read(_FOOTER.size))
    source.seek(at)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(size)), "<i8")
    index, table = flat[: chunks * 6].reshape(-1, 6), flat[chunks * 6 :].reshape(docs, 3)
    unzip = zstandard.ZstdDecompressor()

    def chunk(entry: np.ndarray) -> np.ndarray:
        source.seek(int(entry[0]))
        planes = [np.frombuffer(unzip.decompress(source.read(int(n))), np.uint8) for n in entry[2:]]
        return np.stack(planes, axis=1).reshape(-1).view("<u4")

    held, n_held, k, start = [], 0, 0, 0
    for doc_id, missing, length in table.tolist():
        while n_held < length:
            held.append(chunk(index[k]))
            n_held += len(held[-1])
            k += 1
        ids = np.concatenate(held) if len(held) > 1 else held[0] if held else np.empty(0, "<u4")
        yield (None if missing else doc_id), start, ids[:length]
        held, n_held, start = [ids[length:]], n_held - length, start + length


def _encoder(path: str):
    """Encode many units by one call: joined by the spaces they begin with, and cut where a token begins with one."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    leads = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        leads[i] = token.startswith("Ġ")  # the byte-level letter for a space

    def encode(units: list[str]) -> list[bytes]:
        simple = [u for u in units if u[:1] == " " and " " not in u[1:]]
        out: dict[str, bytes] = {}
        for a in range(0, len(simple), 4096):
            part = simple[a : a + 4096]
            ids = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(leads[ids]) * 4).tolist()
            if len(cut) != len(part):
                raise ValueError("units and tokens do not line up")
            raw = ids.tobytes()
            out.update(zip(part, [raw[x:y] for x, y in zip(cut, [*cut[1:], len(raw)], strict=True)], strict=True))
        if len(simple) == len(units):
            return list(out.values()) if len(out) == len(units) else [out[u] for u in units]
        rest = [u for u in units if u not in out]
        found = tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        out.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(rest, found, strict=True))
        return [out[u] for u in units]

    return encode


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    memos = kept("token files")
    if tokenizer not in memos:
        memos[tokenizer] = Memo(_encoder(tokenizer), MEMO_ENTRIES)
    memo, part = memos[tokenizer], TaskContext.get().partitionId()
    fs, base = pafs.FileSystem.from_uri(folder)
    done, writer, path, end = [], None, "", np.array([end_id], "<u4").tobytes()

    def finish() -> None:
        writer.close()
        done.append((part, len(done), path, len(writer.docs), writer.ids))

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), memo.encode_all(texts_of(batch.column("text"))), strict=True):
            if writer is None:
                path = f"part-{part:06d}-{len(done):04d}-{uuid4().hex}.planes"
                fs.create_dir(base, recursive=True)
                writer = PlaneWriter(fs.open_output_stream(f"{base}/{path}"))
            writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
            if writer.ids >= FILE_IDS or len(writer.docs) >= FILE_DOCS:
                finish()
                writer = None
    if writer is not None:
        finish()
    columns = list(zip(*done, strict=True)) or [[]] * 5
    types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "seq", "path", "n_docs", "n_ids"])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``doc_id, text`` rows as token files; the manifest ``path, n_docs, n_ids, start`` comes back.

    Texts are dealt out once, by ranges of ``doc_id`` and, so that rows of one id spread, of a hash of the text
    and the row's number, and encoded where they are written. ``start`` is
    a running sum over the manifest, which has a row for each file.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or shared_dir(spark)
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("of_text"), F.monotonically_increasing_id().alias("row")).repartitionByRange("doc_id", "of_text", "row").sortWithinPartitions("doc_id", "of_text", "row").select("doc_id", "text")
    schema = "part int, seq int, path string, n_docs long, n_ids long"
    files = materialize(ordered.mapInArrow(partial(_write, tokenizer=tokenizer, end_id=end_id, folder=folder), schema))
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.select(F.concat(F.lit(folder + "/"), "path").alias("path"), "n_docs", "n_ids", F.coalesce(before, F.lit(0)).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "ids"]
    for batch in batches:
        for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, at = pafs.FileSystem.from_uri(path)
            rows, size = [], 0
            with fs.open_input_file(at) as source:
                for doc_id, start, ids in read_planes(source):
                    rows.append((doc_id, first + start, ids))
                    size += len(ids)
                    if size >= 1 << 20:
                        yield _rows(rows, names)
                        rows, size = [], 0
            if rows:
                yield _rows(rows, names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    doc, start, ids = zip(*rows, strict=True)
    crc = pa.array([zlib.crc32(np.ascontiguousarray(x).tobytes()) for x in ids], pa.int64())
    ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), lists, crc], [*names, "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids, ids_crc32`` of each document, from the files that the manifest names."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(parts).mapInArrow(_read, "doc_id long, start long, ids array<int>, ids_crc32 long")
