"""How filters of a corpus interact: which documents each one takes in every order, and which only it would take.

Five filters are tried on every document, whatever the others say, so that each document has a mask of failures.
Copies are found by sorting (:mod:`sorted_runs`): range partitions by the text's fingerprint and id, sorted by
fingerprint, whole text and id, each row compared with its predecessor, runs that cross a boundary settled by their
least id. The other filters look at the text as it passes by in that sort. Masks are then counted by part, and the
counters, which add up over any split of the corpus, hold all that an order of filters needs: a document is removed
at the first filter of the order that is in its mask. Texts cross the network once; a part, however large, is
counted in the tasks before it is shuffled.

Cases: a null text counts as empty and a null source as the empty part; a null id is neither smaller nor larger than
another, so its row is no copy and has none; rows that repeat id and text are not copies of each other; a document
is good (toxic) if any of its rows in ``labels`` says so, and labels of no document count for nothing; every part has
a row for each order and step, zeros included; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import materialize, text_or_empty
from plotline.llm.sorted_runs import with_earlier

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
COPY = 1 << FILTERS.index("E")


def _mask(text: Column) -> Column:
    """The failures of filters A to D, a bit for each."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    failed = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, fingerprint: Column | None = None, partitions: int | None = None) -> DataFrame:
    """``own`` (the id), ``part, mask`` of every row of ``docs``: bit k for filter k of FILTERS failed.

    ``fingerprint`` takes the place of the text's XXH64, a long; it need not tell all texts apart.
    """
    fp = F.xxhash64(text_or_empty()) if fingerprint is None else fingerprint
    rows = docs.select(fp.alias("fp"), F.col("doc_id").cast("long").alias("own"), F.coalesce("source", F.lit("")).alias("part"), text_or_empty().alias("text"))
    describe = lambda df: df.withColumn("mask", _mask(F.col("text"))).withColumn("text", F.col("text").cast("binary"))
    found = with_earlier(rows, ["fp"], "text", describe, ["part", "mask"], partitions)
    return found.select("own", "part", F.col("mask").bitwiseOR(F.when(F.col("earlier"), COPY).otherwise(0)).alias("mask"))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: additive counts; at most 32 rows for each part."""
    rows = materialize(masked.groupBy("own", "part", "mask").agg(F.count("*").alias("n")))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("own")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return rows.join(known, "own", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def rules() -> list[tuple]:
    """What becomes of a mask at each step of each order: 32 masks, 120 orders, five steps.

    ``mask, filter_order, step, kept, removed, redundant, unique, share``; ``share`` is the number of the orders in
    which the step's filter is the first of the mask's.
    """
    rows = []
    for order in map("".join, permutations(FILTERS)):
        for step, letter in enumerate(order, 1):
            bit, before = 1 << FILTERS.index(letter), sum(1 << FILTERS.index(x) for x in order[: step - 1])
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                rows.append((mask, order, step, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == bit), 120 // mask.bit_count() if fails else 0))
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step; the counts are named as in the module's :func:`sql`."""
    spark = docs.sparkSession
    rule = spark.createDataFrame(rules(), "mask int, filter_order string, step int, k_kept int, k_removed int, k_redundant int, k_unique int, share int")
    counted = counters(masks(docs), labels)
    of = lambda rule, count="n": F.sum(F.col(rule) * F.col(count))
    return (
        counted.join(F.broadcast(rule), "mask")  # 19,200 rows
        .groupBy("part", "filter_order", "step")
        .agg(
            of("k_kept").alias("kept"),
            of("k_removed").alias("removed"),
            of("k_redundant").alias("redundant"),
            of("k_unique").alias("unique_fails"),
            of("k_removed", "good").alias("good_lost"),
            of("k_removed", "toxic").alias("toxic_lost"),
            of("share").alias("shapley"),
        )
    )


def sql() -> str:
    """DuckDB SQL over ``documents`` and ``labels`` for the rows of :func:`audit`."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
 f AS (SELECT part, doc_id, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(least < doc_id, false) AS e FROM w),
 good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
 m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
  good.doc_id IS NOT NULL AS good, toxic.doc_id IS NOT NULL AS toxic FROM f LEFT JOIN good USING (doc_id) LEFT JOIN toxic USING (doc_id)),
 n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
 s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, filter_order[:step - 1] AS before FROM o, range(1, 6) AS t(step)),
 j AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS failing, translate(fails, before, '') <> fails AS gone, fails = letter AS alone, length(fails) AS width FROM n, s),
 p AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM j GROUP BY part, filter_order, step, letter)
 SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM p"""
