"""A trie of conversations' turns, with what sharing each prefix would save.

Conversations are put together as sequences of turn digests, and equal sequences count as one with a weight. They
are hash-partitioned by the digest of the first turn; each partition builds a pointer trie of dictionaries inside
``applyInPandas`` and sums it up from the leaves in an iterative postorder. A first-turn subtrie of more than
``max_turns`` turns is too large for that: the prefix that all of its sequences share becomes nodes at once (the
longest common prefix of the least and the greatest of them, one aggregate), and the sequences are dealt out again
by the turn that comes next, round by round, until every subtrie is small. What the small tries found is then added
up along the prefixes, last round first. Texts do not leave the tasks that read them; digests of 16 bytes do.

Cases: null roles and texts count as empty; turns of one conversation that tie are ordered by their digests; rows that
repeat a turn are turns of their own; rows without a conversation id belong to none; a conversation that ends up
without turns is a member of the root; an empty table gives no rows, not even a root. A conversation's digests
are one row, so a single conversation may have some millions of turns, not more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.llm.common import materialize, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 32  # characters of a digest in a path
MAX_TURNS = 50_000
SHARED_TURNS = 3  # no conversation takes over more
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, split long"


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as digests and numbers of words."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", digest.alias("d"), F.regexp_count(text, F.lit(WORD)).alias("n"))
    ordered = F.sort_array(F.collect_list(turn))
    return conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.transform(ordered, lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, tokens``: the first ``crc32(id) % 4`` turns of conversation ``id - id % 20``, then the own ones after as many.

    ``path`` joins the turns' digests, ``tokens`` are their numbers of words.
    """
    own = materialize(_turns(conversations))
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_TURNS).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    none = F.expr("cast(array() as array<struct<d: string, n: int>>)")
    after = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), after)
    joined = own.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left").select("conv_id", turns.alias("turns"))
    return joined.select("conv_id", F.array_join(F.col("turns.d"), "").alias("path"), F.col("turns.n").alias("tokens"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the ids of each sequence, from rows sorted by sequence and id: a stream, whatever its length."""
    at, h = None, None
    for batch in batches:
        done = []
        for s, conv_id in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if s == at:
                h.update(b",%d" % conv_id)
                continue
            if h:
                done.append((at, h.hexdigest()))
            at, h = s, hashlib.sha256(b"%d" % conv_id)
        yield _ended(done)
    if h:
        yield _ended([(at, h.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["seq", "ends"])


def sequences(convs: DataFrame) -> DataFrame:
    """``path, tokens, n, least, ends`` of every distinct sequence: its conversations' number, least id and hashed ids.

    The hash of all ids in order can't be put together from parts, so the ids of one sequence (not its turns) pass
    one task, as a stream.
    """
    rows = materialize(convs.withColumn("seq", F.md5("path")))
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.select("seq", "conv_id").repartition(n, "seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_ends, "seq string, ends string")
    distinct = rows.groupBy("seq").agg(F.first("path").alias("path"), F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    return materialize(distinct.join(ends, "seq").drop("seq"))


def _trie(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the sequences of one partition, each subtrie below the prefix that has become nodes before.

    A node is a place in lists, its children a dictionary from digest to place. A node is made after its parent, so
    the places backwards are a postorder.
    """
    children, depth, parent, tokens, n, least, ends, split = ([] for _ in range(8))
    tops: dict[tuple, int] = {}
    for path, words, weight, conv_id, sha, start, of in zip(*(group[c].tolist() for c in ("path", "tokens", "n", "least", "ends", "start", "split")), strict=True):
        at = -1
        words = words.tolist()
        for d in range(start, len(words)):
            key = path[d * DIGEST : (d + 1) * DIGEST]
            siblings = tops if at < 0 else children[at]
            name = (of, key) if at < 0 else key
            child = siblings.get(name)
            if child is None:
                child = siblings[name] = len(children)
                for values, value in ((children, {}), (depth, d + 1), (parent, at), (tokens, words[d]), (n, 0), (least, conv_id), (ends, None), (split, of)):
                    values.append(value)
            at = child
            n[at] += weight
            least[at] = min(least[at], conv_id)
        ends[at] = sha
    leaves = [0 if c else 1 for c in children]
    saved = [(k - 1) * w for k, w in zip(n, tokens, strict=True)]
    for at in range(len(children) - 1, -1, -1):
        if parent[at] >= 0:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
    none = hashlib.sha256(b"").hexdigest()
    above = [least[p] if p >= 0 else None for p in parent]
    return pd.DataFrame(
        {
            "conv_id": least, "depth": depth, "parent_conv_id": pd.array(above, "Int64"), "n_convs": n, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved,
            "ends_sha256": [e or none for e in ends], "split": pd.array([s if p < 0 else None for s, p in zip(split, parent, strict=True)], "Int64"),
        }
    )


def _prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many turns the least and the greatest path of a subtrie share: so many do all of them."""
    for batch in batches:
        shared = [len(commonprefix([lo, hi])) // DIGEST for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared, pa.int64())], ["id", "last"])


def _dealt(going: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sequences of small subtries, those of large ones below the nodes that these become, and these nodes."""
    tagged = materialize(going.join(large.select("split", "next", "id"), ["split", "next"], "left"))
    within = tagged.where("id is not null")
    of = within.groupBy("id").agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.min_by("tokens", "path").alias("tokens"), F.sum("n").alias("n"), F.min("least").alias("least"), F.first("split").alias("up"), (F.first("start") + 1).alias("first"))
    of = materialize(of)
    last = materialize(of.select("id", "lo", "hi").mapInArrow(_prefix, "id long, last long"))
    chains = of.join(last, "id").select("id", "up", "first", "last", F.expr("slice(tokens, cast(first as int), cast(last - first + 1 as int))").alias("tokens"), "n", "least")
    below = within.join(last, "id").select("path", "tokens", "n", "least", "ends", F.col("last").alias("start"), F.col("id").alias("split"))
    return tagged.where("id is null").drop("id"), materialize(below), materialize(chains)


def nodes(seqs: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The trie of ``seqs`` (:func:`sequences`), a row for each node; columns as in :func:`sql`."""
    spark = seqs.sparkSession
    total = seqs.agg(F.sum(F.size("tokens"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // max_turns))
    rows = seqs.withColumns({"start": F.lit(0).cast("long"), "split": F.lit(0).cast("long")})
    root = seqs.agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n is not null")
    chains = [root.select(F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.array(F.lit(0)).alias("tokens"), "n", "least")]
    small, ended = [], []
    while True:
        ended.append(rows.where("size(tokens) = start").select(F.col("split").alias("id"), "ends"))
        going = rows.where("size(tokens) > start").withColumn("next", F.expr(f"substring(path, cast(start * {DIGEST} + 1 as int), {DIGEST})"))
        sizes = going.groupBy("split", "next").agg(F.sum(F.size("tokens") - F.col("start")).alias("turns"))
        large = materialize(sizes.where(F.col("turns") > max_turns).withColumn("id", F.monotonically_increasing_id() + F.lit(len(chains) << 56)))
        if large.isEmpty():
            small.append(going)
            break
        rest, rows, chain = _dealt(going, large)
        small.append(rest)
        chains.append(chain)
    dealt = reduce(DataFrame.unionByName, small).withColumn("bucket", F.pmod(F.xxhash64("split", "next"), F.lit(buckets)))
    tries = materialize(dealt.groupBy("bucket").applyInPandas(_trie, _NODES))
    # what is below the nodes of large subtries, the last round's first
    tops, summed = tries.where("split is not null").select("split", "n_leaves", "saved_tokens"), []
    for chain in reversed(chains):
        under = tops.groupBy(F.col("split").alias("id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        none = F.lit(0).cast("long")
        chain = chain.join(under, "id", "left").withColumns({"n_children": F.coalesce("n_children", none), "n_leaves": F.coalesce("n_leaves", none + 1), "below": F.coalesce("below", none)})
        summed.append(materialize(chain))
        own = F.expr("(n - 1) * aggregate(tokens, 0L, (s, x) -> s + x)")
        tops = tops.unionByName(summed[-1].where("up is not null").select(F.col("up").alias("split"), "n_leaves", (F.col("below") + own).alias("saved_tokens")))
    return _all(tries, reduce(DataFrame.unionByName, summed), reduce(DataFrame.unionByName, ended))


def _all(tries: DataFrame, chains: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes of the small tries and those of the large subtries' shared prefixes."""
    parents = chains.select(F.col("id").alias("split"), F.col("least").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = tries.join(parents, "split", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id")).select(columns)
    chained = chains.join(parents.withColumnsRenamed({"split": "up"}), "up", "left").join(ended, "id", "left")
    each = chained.select("*", F.posexplode("tokens").alias("at", "own"))
    after = Window.partitionBy("id").orderBy(F.desc("at"))
    is_last = F.col("first") + F.col("at") == F.col("last")
    upper = each.select(
        F.col("least").alias("conv_id"),
        (F.col("first") + F.col("at")).alias("depth"),
        F.when(F.col("at") == 0, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(is_last, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n") - 1) * F.sum("own").over(after)).alias("saved_tokens"),
        F.when(is_last, F.coalesce("ends", F.sha2(F.lit(""), 256))).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    return inner.unionByName(upper)


def build(conversations: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    return nodes(sequences(rebuilt(conversations)), max_turns)


def sql() -> str:
    """DuckDB SQL over ``conversations`` for the rows of :func:`build`."""
    crc = "4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 t AS (SELECT conv_id, ({crc}) % 4 AS h, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns FROM c GROUP BY conv_id),
 b AS (SELECT t.conv_id, list_concat(coalesce(p.turns, [])[1:t.h], t.turns[t.h + 1:]) AS s FROM t LEFT JOIN t p ON p.conv_id = t.conv_id - t.conv_id % 20),
 m AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM b),
 n AS (SELECT s[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
 k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
 v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.node[depth].text, '{WORD}')) END AS saved FROM n LEFT JOIN k USING (node)),
 u AS (SELECT node[1:up] AS node, n_children, saved FROM (SELECT *, unnest(range(depth + 1)) AS up FROM v)),
 w AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY node)
 SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, w.n_leaves, CAST(w.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
 FROM v JOIN w ON w.node = v.node LEFT JOIN n a ON v.depth > 0 AND a.node = v.node[1:v.depth - 1]"""
