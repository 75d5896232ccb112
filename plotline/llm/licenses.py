"""License scans by diagonal voting over word k-grams.

Every rolling word k-gram of every text is joined to the positions at which templates have it. A hit
at text word p and template word t lies on the diagonal p - t; a template that stands in a text puts
many hits on one diagonal. Hits, which are few, are dealt out by text in the one shuffle and counted by diagonal; from
each diagonal of a long template on, those that lie within half its length (words more or less in between) are merged;
and such a band counts if the grams matched, which the join compares word by word beside their hashes, cover enough of
the template: every gram of a phrase; of a notice, four fifths of its words, each counted once whichever of the merged
diagonals it is matched on. Of bands that overlap, the best one is the span, so what else stands next to a notice, its
own phrases repeated for instance, does not hide it, and no span is more than half longer than its notice.

Cases: a null or empty text has no words, places or labels and scores 0; a phrase that a line break or
punctuation cuts still stands, since only words count; two labels may tie and are both given; repeated
rows are scanned each by itself; an empty table gives no rows. Other columns are not carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words, in text of which A-Z has been lower-cased (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOTICE_GRAM = 5
NOTICE_COVER = 0.8
NOTICE_STRETCH = 1.5  # a notice's span, against its template


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = True  # stands word for word, or not at all
    base: bool = False


#: Phrases and their labels (fixed values), then phrases and notices of the scan's own.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("agpl", "affero general public license"),
    Template("lgpl", "lesser general public license"),
    Template("bsd", "bsd license"),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0"),
    Template("creative-commons", "creative commons attribution"),
    Template("isc", "isc license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software",
        phrase=False,
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        phrase=False,
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation",
        phrase=False,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        phrase=False,
    ),
)


def _template_grams(templates: tuple[Template, ...]) -> list[tuple]:
    rows = []
    for t, x in enumerate(templates):
        words = x.text.split()
        k = 2 if x.phrase else NOTICE_GRAM
        if len(words) < k:
            raise ValueError(f"a template of fewer than {k} words: {x.text!r}")
        rows += [(" ".join(words[p : p + k]), t, p, len(words) - k + 1) for p in range(len(words) - k + 1)]
    return rows


def _grams(k: int) -> str:
    """SQL of ``array<struct<pos, gram>>`` over the column ``words``."""
    gram = ", ".join(f"words[i + {j}]" for j in range(k))
    return f"if(n_words >= {k}, transform(sequence(0, n_words - {k}), i -> named_struct('pos', i, 'gram', concat_ws(' ', {gram}))), array())"


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each verified span, and one with null ``template`` for each row of ``docs``.

    ``row, doc_id, n_words, template, label, base, first, last_end, cover``. The template table has a
    row for each gram of ``templates``, a fixed list, and is the only thing broadcast. The result is
    dealt out by row, so that it can be summed up without another shuffle.
    """
    spark = docs.sparkSession
    # beside A-Z, lower() changes letters outside ASCII, but makes an ASCII letter only of the Kelvin sign
    words = F.regexp_extract_all(F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u03ba"))), F.lit(WORD), F.lit(0))
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words")).withColumn("n_words", F.size("words"))
    head = "array(named_struct('pos', -1, 'gram', cast(null as string)))"  # keeps rows without a hit
    grams = split.selectExpr("row", "doc_id", "n_words", f"inline(concat({head}, {_grams(2)}, {_grams(NOTICE_GRAM)}))")
    known = spark.createDataFrame(_template_grams(templates), "t_gram string, template int, t_pos int, n_grams int").withColumn("t_hash", F.xxhash64("t_gram"))
    hits = grams.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(known), F.expr("hash = t_hash and gram = t_gram"), "left").where("template is not null or pos < 0")
    votes = (
        hits.repartition("row")
        .groupBy("row", "doc_id", "n_words", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(F.count("template").alias("votes"), F.min("t_pos").alias("lo"), F.max("t_pos").alias("hi"), F.first("n_grams").alias("n_grams"), F.collect_set("t_pos").alias("places"))
    )

    def of_template(values: list) -> Column:
        return F.when(F.col("template").isNotNull(), F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1))

    lengths = [len(x.text.split()) for x in templates]
    bands = [0 if x.phrase else int((NOTICE_STRETCH - 1) * n) for x, n in zip(templates, lengths, strict=True)]
    phrase, band, length = of_template([x.phrase for x in templates]), of_template(bands), of_template(lengths)
    ahead = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, max(bands))
    near = F.filter(F.collect_list(F.struct("diagonal", "lo", "hi", "places")).over(ahead), lambda m: m["diagonal"] <= F.col("diagonal") + F.col("band"))
    words = F.array_distinct(F.flatten(F.transform("near", lambda m: F.flatten(F.transform(m["places"], lambda p: F.sequence(p, p + (NOTICE_GRAM - 1)))))))
    k = F.when(F.col("phrase"), 2).otherwise(NOTICE_GRAM)
    windows = (
        votes.withColumns({"phrase": phrase, "band": band, "length": length})
        .withColumn("near", near)
        .withColumns(
            {
                "cover": F.when(F.col("phrase"), F.least(F.lit(1.0), F.col("votes") / F.col("n_grams"))).otherwise(F.size(words) / F.col("length")),
                "first": F.array_min(F.transform("near", lambda m: m["diagonal"] + m["lo"])),
                "last_end": F.array_max(F.transform("near", lambda m: m["diagonal"] + m["hi"])) + k,
            }
        )
    )
    verified = windows.where(F.col("template").isNull() | F.when(F.col("phrase"), F.col("cover") == 1.0).otherwise(F.col("cover") >= NOTICE_COVER))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(along) > F.col("band")), 1).otherwise(0)
    best = F.max_by(F.struct("first", "last_end", "cover"), F.struct(F.col("cover"), -F.col("diagonal"))).alias("best")
    merged = verified.withColumn("apart", apart).withColumn("place", F.sum("apart").over(along)).groupBy("row", "doc_id", "n_words", "template", "place").agg(best)
    names, bases = of_template([x.label for x in templates]), of_template([x.base for x in templates])
    of = lambda c: F.when(F.col("template").isNotNull(), F.col(f"best.{c}"))
    return merged.select(
        "row",
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "template",
        names.alias("label"),
        F.coalesce(bases, F.lit(False)).alias("base"),
        of("first").cast("long").alias("first"),
        of("last_end").cast("long").alias("last_end"),
        of("cover").alias("cover"),
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    base = F.col("base")
    return (
        spans(docs, templates)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL over ``documents`` for the rows of :func:`scan`."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lengths = [len(x.text.split()) for x in templates]
    grams = ", ".join(f"({quoted(g)}, {t}, {p}, {n}, {2 if templates[t].phrase else NOTICE_GRAM})" for g, t, p, n in _template_grams(templates))
    named = ", ".join(f"({t}, {quoted(x.label)}, {x.phrase}, {x.base}, {n}, {int((NOTICE_STRETCH - 1) * n)})" for t, (x, n) in enumerate(zip(templates, lengths, strict=True)))
    following = ", ".join(f"lead(w, {j}) OVER place AS w{j}" for j in range(1, NOTICE_GRAM))
    five = " || ' ' || ".join(["w", *(f"w{j}" for j in range(1, NOTICE_GRAM))])
    return f"""WITH t(gram, template, t_pos, n_grams, k) AS (VALUES {grams}), names(template, label, phrase, base, length, band) AS (VALUES {named}),
 rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
 words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM rows), near AS (SELECT r, pos, w, {following} FROM words WINDOW place AS (PARTITION BY r ORDER BY pos)),
 grams AS (SELECT r, pos, w || ' ' || w1 AS gram FROM near WHERE w1 IS NOT NULL UNION ALL SELECT r, pos, {five} FROM near WHERE w{NOTICE_GRAM - 1} IS NOT NULL),
 hits AS (SELECT r, template, pos, t_pos, n_grams, pos - t_pos AS diagonal FROM grams JOIN t USING (gram)),
 votes AS (SELECT r, template, diagonal, count(*) AS votes, min(pos) AS first, any_value(n_grams) AS n_grams FROM hits GROUP BY r, template, diagonal),
 phrases AS (SELECT r, label, base, first, 1.0 AS cover FROM votes JOIN names USING (template) WHERE phrase AND votes >= n_grams),
 windows AS (SELECT v.r, v.template, v.diagonal, any_value(label) AS label, min(h.pos) AS first, count(DISTINCT h.t_pos + j) / any_value(length) AS cover
  FROM votes v JOIN names USING (template) JOIN hits h ON NOT phrase AND h.r = v.r AND h.template = v.template AND h.diagonal BETWEEN v.diagonal AND v.diagonal + band, range({NOTICE_GRAM}) AS o(j) GROUP BY v.r, v.template, v.diagonal),
 kept AS (SELECT * FROM phrases UNION ALL SELECT r, label, false, first, cover FROM windows WHERE cover >= {NOTICE_COVER})
 SELECT doc_id, len(any_value(ws)) AS n_words, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(cover), 0.0) AS score
 FROM rows LEFT JOIN kept USING (r) GROUP BY r, doc_id"""
