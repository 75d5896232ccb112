"""Which rows repeat an earlier row's key: a range sort, predecessors compared in a stream, boundaries settled after.

Rows are range-partitioned by key and id and sorted within each partition, so a key that very many rows share is
dealt out over several partitions by its ids. Each partition is read as a stream; a row is compared with the one
before it, and a run of equal keys is known by the id of its first row, the least there is in that partition. The
runs of a partition's first and last key may go on in the neighbouring partitions: these report their key and least
id, a row or two for each partition, and the rows of a first key wait for the least of all these reports.

Where a text is given, the key is its fingerprint: rows of one fingerprint are then sorted by the whole text, and
runs end where texts differ, so fingerprints that collide do no harm.

Cases: a null id is neither smaller nor larger than another, so its row never repeats an earlier one nor is repeated;
equal ids are not smaller than each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import materialize


def _binary(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _stream(batches: Iterator[pa.RecordBatch], keys: list[str], text: str | None, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows ``*carried, own, earlier, run, partition, *keys, text``; reports have keys and no ``earlier``."""
    at = TaskContext.get().partitionId()
    last: tuple | None = None
    last_text, run, group, least = b"", -1, -1, None
    heads: list[tuple] = []  # (run, key, text, least) of the first key
    tails: list[tuple] = []  # and of the last
    fields = None
    for batch in batches:
        n = batch.num_rows
        fields = fields or [batch.schema.field(c) for c in carried]
        if not n:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        same_key = np.empty(n, bool)
        same_key[0] = tuple(key[:, 0].tolist()) == last
        same_key[1:] = (key[:, 1:] == key[:, :-1]).all(axis=0)
        same = same_key.copy()
        if text:
            column = batch.column(text)
            for i in np.flatnonzero(same_key).tolist():
                same[i] = _binary(column[i]) == (_binary(column[i - 1]) if i else last_text)
            last_text = _binary(column[n - 1])
        ids = batch.column("own")
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy()
        runs, groups = run + np.cumsum(~same), group + np.cumsum(~same_key)
        first = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        known = np.where(first >= 0, valid[first], least is not None)
        leasts = np.where(first >= 0, values[first], least or 0)
        earlier = valid & known & (values > leasts)
        if groups[-1] != group:
            tails = []
        for i in np.flatnonzero(~same & ((groups == 0) | (groups == groups[-1]))).tolist():
            found = (int(runs[i]), tuple(key[:, i].tolist()), _binary(column[i]) if text else None, int(values[i]) if valid[i] else None)
            (heads if groups[i] == 0 else tails).append(found)
        open_run = pa.array(runs, pa.int64(), mask=(groups != 0) | earlier | ~valid)
        none = [pa.nulls(n, pa.int64())] * len(keys) + [pa.nulls(n, pa.binary())]
        columns = [*(batch.column(c) for c in carried), ids, pa.array(earlier), open_run, pa.array(np.full(n, at)), *none]
        yield pa.RecordBatch.from_arrays(columns, _names(keys, carried))
        run, group, last = int(runs[-1]), int(groups[-1]), tuple(key[:, -1].tolist())
        least = int(leasts[-1]) if known[-1] else None
    if ends := heads + tails:
        columns = [*(pa.nulls(len(ends), f.type) for f in fields), pa.array([x[3] for x in ends], pa.int64()), pa.nulls(len(ends), pa.bool_()), pa.array([x[0] for x in ends], pa.int64()), pa.array([at] * len(ends), pa.int64())]
        columns += [pa.array([x[1][k] for x in ends], pa.int64()) for k in range(len(keys))] + [pa.array([x[2] for x in ends], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, _names(keys, carried))


def _names(keys: list[str], carried: list[str]) -> list[str]:
    return [*carried, "own", "earlier", "run", "at", *(f"key_{c}" for c in keys), "whole_text"]


def with_earlier(rows: DataFrame, keys: list[str], text: str | None = None, describe: Callable[[DataFrame], DataFrame] | None = None, carried: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``*carried, own, earlier`` of every row of ``rows`` (``*keys, own``, more): whether its key has a smaller ``own``.

    ``keys`` are longs without nulls, ``own`` is a long, ``text`` a binary column. ``describe`` adds columns after the
    sort, so that what it works out is not worked out again for the sample that range bounds come from. The result is
    a table of its own, in the shared folder.
    """
    spark, carried = rows.sparkSession, carried or []
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.col("own").asc_nulls_last()
    dealt = rows.repartitionByRange(n, *keys, own).sortWithinPartitions(*keys, *([text] if text else []), own)
    dealt = (describe(dealt) if describe else dealt).select(*keys, *([text] if text else []), "own", *carried)
    kinds = [f"{c} {dealt.schema[c].dataType.simpleString()}" for c in carried]
    schema = ", ".join([*kinds, "own long, earlier boolean, run long, at long", *(f"key_{c} long" for c in keys), "whole_text binary"])
    out = materialize(dealt.mapInArrow(partial(_stream, keys=keys, text=text, carried=carried), schema))
    key = [*(f"key_{c}" for c in keys), "whole_text"]
    reports = out.where("earlier is null").select("at", "run", "own", *key)
    least = reports.groupBy(*key).agg(F.min("own").alias("least"))
    same = F.expr(" and ".join(f"r.{c} <=> l.{c}" for c in key))
    opened = reports.alias("r").join(least.alias("l"), same).select(F.col("r.at").alias("of"), F.col("r.run").alias("of_run"), "l.least")
    rows = out.where("earlier is not null")
    settled = rows.where("run is null").select(*carried, "own", "earlier")
    waiting = rows.where("run is not null").join(opened, F.expr("at = of and run = of_run"), "left")
    return settled.unionByName(waiting.select(*carried, "own", F.coalesce(F.col("least") < F.col("own"), F.lit(False)).alias("earlier")))
