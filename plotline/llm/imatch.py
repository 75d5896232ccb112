"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon is every term whose share of distinct texts lies in a band: terms in too many texts say
nothing, and terms in too few are typos and names that the least edit would change. Copies count once,
so that no group of copies puts its own terms beyond the band. A text's distinct
lexicon terms are sorted and hashed once as a whole and once for each of several random subsets of the
lexicon, from an eighth down to a 256th of it. An edit changes only the subsets that hold a term
it adds or takes away, so the share of equal subset hashes says how alike two texts are.

The lower end of the band bounds the lexicon whatever the corpus: each term in it stands in at least
that share of texts, so there are at most (mean distinct terms of a text) / MIN_SHARE of them. It
is broadcast up to MAX_BROADCAST terms, and joined by a shuffle beyond.

Cases: a null or empty text has no terms, and all such texts share a fingerprint; a text without a
lexicon term is fingerprinted, whole and subsets, by all its terms; equal texts have equal fingerprints whatever their
ids; rows with the same id follow each other in order of their texts' hashes (equal rows in any order); a null id comes after
all others; an empty table gives no rows. Other columns are not carried along.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.llm.common import materialize

MIN_SHARE = 1 / 400
MAX_SHARE = 1 / 20
MAX_BROADCAST = 2_000_000
SUBSETS_PER_RATE = 5
RATE_BITS = (3, 4, 5, 6, 7, 8)  # a subset at b bits holds one term in 2 ** b
_ROWS_PER_RANGE, _MOST_RANGES = 2000, 8192
_LEAST_ID = -(1 << 63)


def terms(text: str) -> Column:
    """Hashes of a text's distinct terms: lower-cased runs of characters other than white space."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[^ \t-\r]+"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """``term`` (hashes) in the band, counted over all distinct texts with map-side sums."""
    rows = docs.where("text is not null and text <> ''").select(F.xxhash64("text").alias("hash"), F.char_length("text").alias("size"), "text")
    n = rows.select("hash", "size").distinct().count()
    texts = rows.groupBy("hash", "size").agg(F.first("text").alias("text"))
    counts = texts.select(F.explode(terms("text")).alias("term")).groupBy("term").count()
    return materialize(counts.where((F.col("count") >= min_share * n) & (F.col("count") <= max(1.0, max_share * n))).select("term"))


def _in_subset(shift: int, mask: int) -> Callable[[Column], Column]:
    return lambda term: F.shiftrightunsigned(term, shift).bitwiseAND(F.lit(mask)) == mask


def _on_side(side: int) -> Callable[[Column], Column]:
    none = F.lit(None).cast("array<bigint>")
    return lambda term: F.struct(F.lit(side).alias("side"), term.alias("term"), none.alias("all_own"), none.alias("all_new"))


def signatures(sorted_terms: Column) -> Column:
    """Hashes of the whole and of each subset; null for a subset without a term of the text."""
    parts = [F.xxhash64(sorted_terms)]
    for r, bits in enumerate(RATE_BITS):
        for k in range(SUBSETS_PER_RATE):
            shift = (11 * (r * SUBSETS_PER_RATE + k) + 5) % 57
            mask = (1 << bits) - 1
            held = F.filter(sorted_terms, _in_subset(shift, mask))
            parts.append(F.when(F.size(held) > 0, F.xxhash64(held, F.lit(r * SUBSETS_PER_RATE + k))))
    return F.array(*parts)


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes as a share of the subsets that hold a term of either text (0 to 1)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    held = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda e: e))
    return same / held


def _as_text(signature: Column) -> Column:
    half = F.transform(signature, lambda s: F.lpad(F.hex(F.coalesce(s.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))), 8, "0"))
    return F.lower(F.array_join(half, ""))


def _ranges(docs: DataFrame) -> tuple[Column, DataFrame]:
    """The range that a row belongs to, and ``range, head, head_hash``: the row that follows each range downwards.

    There are at most _MOST_RANGES ranges, each of nearly as many rows as the next: cuts are quantiles of the
    ids, and an id on which several of them fall has as many ranges, told apart by the hash of the text.
    A row's cut is found in two steps, first among every so-manieth cut and then among those up to the next.
    """
    spark, key, text_hash = docs.sparkSession, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)), F.xxhash64("text")
    n = docs.count()
    ranges = max(64, min(_MOST_RANGES, n // _ROWS_PER_RANGE))
    cuts = sorted(docs.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or [])
    long_array = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    chunk = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[a : a + chunk] for a in range(0, len(cuts), chunk)]
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    of_chunk = below(long_array([c[0] for c in chunks]))
    inside = F.element_at(F.array(*map(long_array, chunks)) if chunks else F.array(F.array().cast("array<bigint>")), F.greatest(of_chunk, F.lit(1)))
    of = F.when(of_chunk > 0, (of_chunk - 1) * chunk + below(inside)).otherwise(0)
    often = {c: k for c, k in Counter(cuts).items() if k > 1}
    if often:
        parts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in often.items() for x in pair)), key), F.lit(1))
        of = of + parts - 1 - F.floor((text_hash.cast("double") / 2.0**64 + 0.5) * 0.999999 * parts).cast("int")
    first = F.max(F.struct(key.alias("head"), F.bitwise_not(text_hash).alias("h"))).alias("first")
    heads = sorted(((r.range, r.first.head, ~r.first.h) for r in docs.groupBy(of.alias("range")).agg(first).collect()), reverse=True)  # a row for each range
    after = [(r, *heads[(k + 1) % len(heads)][1:]) for k, (r, *_) in enumerate(heads)]
    return of, spark.createDataFrame(after, "range int, head long, head_hash long")


def fingerprint_with_neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, signature, edited_signature, next_signature`` of every row.

    The edited text has the last third of its code points replaced by the first as many of the next
    document in descending order of ids. Texts are shuffled once, by ranges of ids; a copy of the row
    that follows a range stands at its end, and all further steps keep that partitioning.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(docs)
    if known.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    of, after = _ranges(docs)
    key = F.coalesce("doc_id", F.lit(_LEAST_ID))
    own = docs.select(of.alias("range"), F.lit(False).alias("guest"), "doc_id", "text")
    guests = docs.withColumns({"head": key, "head_hash": F.xxhash64("text")}).join(F.broadcast(after), ["head", "head_hash"])
    guests = guests.groupBy("range").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("range", F.lit(True).alias("guest"), "doc_id", "text")
    along = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    n = F.char_length("text")
    kept = n - F.floor(n / 3)
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("next", F.lit(1), n - kept))
    rows = (
        own.unionByName(guests)
        .repartition("range")
        .select("range", "guest", "doc_id", "text", F.row_number().over(along).alias("place"), F.lead("text", 1, "").over(along).alias("next"))
        .select("range", "guest", "place", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
        .select("range", "guest", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), terms("text").alias("own"), terms("edited").alias("new"))
    )
    sides = [F.transform("own", _on_side(0)), F.transform("new", _on_side(1))]
    # keeps rows without a lexicon term, and all terms once for each row
    whole = F.array(F.struct(F.lit(-1).alias("side"), F.lit(None).cast("long").alias("term"), F.col("own").alias("all_own"), F.col("new").alias("all_new")))
    group = ["range", "guest", "place", "doc_id", "n_chars", "edited_sha256"]
    hits = (
        rows.select(*group, F.inline(F.concat(whole, *sides)))
        .join(known.withColumn("held", F.lit(True)), "term", "left")
        .where("held or term is null")
    )
    signed = hits.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.col("term")))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.col("term")))).alias("new"),
        F.first("all_own", ignorenulls=True).alias("all_own"),
        F.first("all_new", ignorenulls=True).alias("all_new"),
    )
    or_all = lambda held, every: F.when(F.size(held) > 0, F.col(held)).otherwise(F.sort_array(every)).alias(held)
    signed = signed.select(*group, or_all("own", "all_own"), or_all("new", "all_new"))
    signed = signed.select(*group, signatures(F.col("own")).alias("signature"), signatures(F.col("new")).alias("edited_signature"))
    following = F.lead("signature").over(Window.partitionBy("range").orderBy("place"))
    return signed.withColumn("next_signature", following).where("not guest").drop("range", "guest", "place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    rows = fingerprint_with_neighbours(docs)
    own, new, following = F.col("signature"), F.col("edited_signature"), F.col("next_signature")
    return rows.select("doc_id", "n_chars", "edited_sha256", _as_text(own).alias("fingerprint"), _as_text(new).alias("edited_fingerprint"), likeness(own, new).alias("near_edited"), likeness(own, following).alias("near_next"))
