"""License scans by diagonal voting.

All rolling word k-grams of the texts (``KGRAM`` words, or all words of a shorter template) are
joined by hash with the places of the templates' k-grams, and each hit is compared word by word.
A hit votes for its diagonal: the word of the text where the template would begin.  Diagonals at
most ``DRIFT`` words apart are one alignment, so words put in or left out do not end it.  An
alignment's share is how many of the template's words its hits cover; a diagonal that all k-grams
of a template vote for is a whole copy.

The templates' k-grams are sent to all tasks in shares of at most ``SENT_GRAMS``, one pass over
the texts for each, so any number of templates is matched and no text is shuffled: hits, which
only texts with shared k-grams have, are all that moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echosieve.llm.common import same
from echosieve.llm.decontaminate import words
from echosieve.workspace import Workspace

KGRAM, DRIFT = 4, 6
LEAST_SHARE = 0.6  # of a text's words; a template of up to SHORT words must be whole
SHORT = 12
SENT_GRAMS = 200_000
#: A word of a text whose letters A-Z are still as they were.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notices of public licenses, and their labels.
NOTICES = [
    ("apache license version 2 0", "apache-2.0"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("cc by nc 4 0", "cc-by-nc"),
    ("cc by sa 4 0", "cc-by-sa"),
    ("cc by nd 4 0", "cc-by-nd"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons "
        "to whom the software is furnished to do so",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0 unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version",
        "gpl-3",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met redistributions of source code "
        "must retain the above copyright notice this list of conditions and the following "
        "disclaimer redistributions in binary form must reproduce the above copyright notice",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a "
        "copy of the mpl was not distributed with this file you can obtain one at http mozilla "
        "org mpl 2 0",
        "mpl-2.0",
    ),
]


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``(template, text, label, base, least)`` for ``spans``, in one partition."""
    named = [(*t, True) for t in phrases] + [(*t, False) for t in notices]
    rows = [
        (n, text, label, base, 1.0 if len(text.split()) <= SHORT else LEAST_SHARE)
        for n, (text, label, base) in enumerate(named)
    ]
    return spark.createDataFrame(
        rows, "template int, text string, label string, base boolean, least double"
    ).coalesce(1)


def _grams(tokens: Column, size: int) -> Column:
    """``array<struct(h, at)>``: the rolling k-grams of one size by hash, from word hashes."""
    n = F.size(tokens)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(
        F.xxhash64(*[tokens[i + j] for j in range(size)]).alias("h"), i.alias("at")
    ))).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, words(F.col("text")).alias("words")).select(
        *keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("tokens")
    )


def _template_grams(table: DataFrame, work: Workspace, k: int) -> DataFrame:
    """``(template, n, label, base, least, size, h, at, gram)``, a row per place of a template."""
    hashed = _hashed(table, "template", "label", "base", "least").withColumn("n", F.size("words")).filter("n > 0")
    each = [
        hashed.filter(F.least("n", F.lit(k)) == size)
        .select("*", F.lit(size).alias("size"), F.inline(_grams(F.col("tokens"), size)))
        for size in range(1, k + 1)
    ]
    return work.table(reduce(DataFrame.unionAll, each).select(
        "template", "n", "label", "base", "least", "size", "h", "at",
        F.slice("words", F.col("at") + 1, F.col("size")).alias("gram"),
    ), "template-grams")


KEY = ["doc_id", "h1", "h2"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, h1, h2, text)``: equal rows, which have equal results, share a key."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(plain).alias("h1"),
        F.xxhash64(F.lit(1), plain).alias("h2"), plain.alias("text"),
    )


def diagonals(
    keyed: DataFrame, grams: DataFrame, sent_grams: int = SENT_GRAMS
) -> DataFrame:
    """``(doc_id, h1, h2, template, n, size, label, base, least, diagonal, places)``.

    ``places``: the places of the template whose k-grams stand on the diagonal; at most as many
    as the template has words.
    """
    shape = grams.agg(F.count(F.lit(1)).alias("rows"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(shape["sizes"])
    hashed = _hashed(keyed, *KEY)
    if not sizes:
        rolling = F.array().cast("array<struct<h:bigint,at:int>>")
    else:
        rolling = F.concat(*[_grams(F.col("tokens"), size) for size in sizes])
    # The k-grams are a column of their own, and outer, so that they are made once a row and
    # the words are handed on by reference, not copied for every k-gram.
    exploded = hashed.select(*KEY, "words", rolling.alias("rolling")).select(
        *KEY, "words", F.inline_outer("rolling").alias("h", "pos")
    )
    shares = max(1, -(-shape["rows"] // sent_grams))
    met = []
    for share in range(shares):
        own = grams.filter(F.pmod("h", F.lit(shares)) == share)
        met.append(exploded.join(F.broadcast(own), "h").filter(
            F.slice("words", F.col("pos") + 1, F.col("size")) == F.col("gram")
        ).select(
            *KEY, "template", "n", "size", "label", "base", "least",
            (F.col("pos") - F.col("at")).alias("diagonal"), "at",
        ))
    return reduce(DataFrame.unionAll, met).groupBy(
        *KEY, "template", "n", "size", "label", "base", "least", "diagonal"
    ).agg(F.collect_set("at").alias("places"))


def alignments(found: DataFrame, drift: int = DRIFT) -> DataFrame:
    """``(doc_id, h1, h2, template, label, base, least, first, last, share)``: merged diagonals.

    ``first`` and ``last`` are the outermost words of the text that hits cover, ``share`` is the
    part of the template's words that they cover.
    """
    by_place = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    parted = found.withColumn(
        "parts", (F.col("diagonal") - F.lag("diagonal").over(by_place) > drift).cast("int")
    ).withColumn("run", F.sum(F.coalesce("parts", F.lit(0))).over(by_place))
    covered = F.array_distinct(F.flatten(F.transform(
        "places", lambda p: F.sequence(p, p + F.col("size") - 1)
    )))
    return parted.select(
        *KEY, "template", "label", "base", "least", "run", "n", F.explode(covered).alias("place"),
        (F.col("diagonal") + F.array_min("places")).alias("begin"),
        (F.col("diagonal") + F.array_max("places") + F.col("size") - 1).alias("end"),
    ).groupBy(*KEY, "template", "label", "base", "least", "run", "n").agg(
        F.min("begin").alias("first"), F.max("end").alias("last"),
        # At most as many as the template has words.
        (F.size(F.collect_set("place")) / F.col("n")).alias("share"),
    ).drop("run", "n")


def spans(
    docs: DataFrame, table: DataFrame, work: Workspace, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, template, label, first, last, share)``: the verified spans of templates.

    ``table``: ``(template, text, label, base, least)``, ``least`` being the share that must be
    covered.  Words count from 0; equal rows give their
    spans once.
    """
    keyed = _keyed(docs, doc_id, text)
    found = diagonals(keyed, _template_grams(table, work, KGRAM))
    return alignments(found).filter("share >= least").drop("h1", "h2", "base", "least")


def scan_licenses(
    docs: DataFrame, table: DataFrame, work: Workspace, doc_id: str = "doc_id",
    text: str = "text", sent_grams: int = SENT_GRAMS,
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    Every row of ``docs`` gives one.  ``n_base`` counts the places where all words of a base
    template stand; ``first_word`` and ``last_word`` are the least and greatest of them, else
    null.  ``labels`` adds those of all templates with an alignment of their ``least`` share;
    ``score`` is the greatest share of any alignment, 0 without one.  Null and empty texts have
    no words and empty labels; templates without words match nothing.  Repeated rows and null ids
    give a row each; other columns are ignored.  A text is held whole by the task that reads it,
    its k-grams are not; the alignments of one text with one template are ordered in one task.
    """
    keyed = _keyed(docs, doc_id, text)
    found = work.table(
        diagonals(keyed, _template_grams(table, work, KGRAM), sent_grams), "diagonals"
    )
    whole = F.size("places") == F.col("n") - F.col("size") + 1
    base = found.filter(F.col("base") & whole).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"),
        F.max("diagonal").alias("last_word"),
        # Labels are a list of the caller's, not of the corpus.
        F.collect_set("label").alias("own"),
    )
    every = alignments(found).groupBy(*KEY).agg(
        F.max("share").alias("score"),
        F.collect_set(F.when(~F.col("base") & (F.col("share") >= F.col("least")), F.col("label")))
        .alias("more"),
    )
    keys = lambda x: [F.col(f"{x}.{c}").alias(f"{x}_{c}") for c in KEY]
    none = F.array().cast("array<string>")
    both = work.table(every.alias("e").join(
        base.alias("b"),
        reduce(Column.__and__, [same(F.col(f"e.{c}"), F.col(f"b.{c}")) for c in KEY]), "left",
    ).select(
        *keys("e"), "score", "n_base", "first_word", "last_word",
        F.coalesce("own", none).alias("own"), "more",
    ), "licensed")
    joined = keyed.select(*KEY, F.regexp_count("text", F.lit(WORD)).alias("n_words")).join(
        both, reduce(Column.__and__, [same(F.col(c), F.col(f"e_{c}")) for c in KEY]), "left"
    )
    spelt = lambda c: F.array_join(F.array_sort(c), ",")
    return joined.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        spelt(F.coalesce("own", none)).alias("base_labels"),
        spelt(F.array_union(F.coalesce("own", none), F.coalesce("more", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
