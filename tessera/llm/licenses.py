"""License scans by an exact set-similarity join, with DataFrame functions only.

Templates and text blocks are sets of words. A block holds a template when it has at least a given share of
the template's distinct words. With the words in a global order from rare to frequent, a block that holds a
template must have one of the template's first words (prefix filter), enough words at all (length filter) and
enough words from the first shared one on (positional filter); only then is the overlap counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a template's distinct words that a block must have, and words from one block's start to the next's.
#: A block is two such strides long, so any passage of up to one stride lies in a block.
CONTAINMENT, STRIDE = 0.8, 64

#: Phrases whose every place counts, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Characteristic passages of public licenses, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text in order: runs of digits, letters a to z and characters beyond ASCII, A to Z in lower case."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def families(templates: list[str], containment: float) -> list[int]:
    """A number for each template, equal for those that share so many words that one could be taken for the other."""
    own = [set(t.split()) for t in templates]
    out = list(range(len(own)))
    for i, x in enumerate(own):
        for j, y in enumerate(own[:i]):
            if len(x & y) >= containment * min(len(x), len(y)):
                out = [out[j] if f == out[i] else f for f in out]
    return out


def _postings(spark, templates: list[tuple[str, str, bool]], counts: dict[str, int], containment: float) -> DataFrame:
    """The words of each template's prefix, rare first, with what the filters need to know of the template."""
    order = sorted({w for _, t, _ in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    family = families([t for _, t, _ in templates], containment)
    rows = []
    for number, (label, text, phrase) in enumerate(templates):
        words = text.split()
        own = sorted(set(words), key=rank.get)
        need = len(own) if phrase else math.ceil(containment * len(own) - 1e-9)
        for i, w in enumerate(own[: len(own) - need + 1]):
            rows.append((w, number, label, phrase, family[number], i, need, own, own[i:], own[:i], words, words.index(w)))
    return spark.createDataFrame(rows, "w string, template int, label string, phrase boolean, family int, i int, need int, own array<string>, rest array<string>, before array<string>, spelled array<string>, place int")


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=None, phrases=None, containment: float = CONTAINMENT, stride: int = STRIDE) -> DataFrame:
    """Licenses of each row's whole text: a row for each row of ``df``.

    (``key``, n_words, n_base, first_word, last_word, base_labels, labels, score): ``n_base`` counts the places
    where a phrase's words stand one after another, ``first_word`` and ``last_word`` are their smallest and
    largest start or null; ``labels`` adds those of templates that some block holds; ``score`` is the largest
    share of a template's words found in a block that holds it, or 1 for a phrase, else 0. Of templates that could
    be taken for one another a block has the label of the one with the largest share, then the most words, then the
    last label, and none where the block that begins a stride earlier or later has a better one; so a passage has
    one license, not also those that differ from it in a word.

    Null texts count as empty and have no words. Rows that repeat a key and a text have the same result each; null
    keys keep their rows; an empty table gives no rows; other columns are left out, whatever their names. Templates
    longer than ``stride`` words are refused, as a block might miss them.

    The templates are a fixed list, so their postings are bounded and broadcast. Words are matched as they leave
    the scan; only the few rows that pass every filter are shuffled, with the documents' keys.
    """
    spark = df.sparkSession
    every = [(label, p, True) for p, label in (PHRASES if phrases is None else phrases).items()]
    every += [(label, t, False) for label, t in (TEMPLATES if templates is None else templates)]
    if any(len(t.split()) > stride for _, t, _ in every):
        raise ValueError("a template is longer than a stride")
    docs = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    docs = docs.select("key", F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"), words_of(F.col("text")).alias("words"))
    universe = F.array(*(F.lit(w) for w in sorted({w for _, t, _ in every for w in t.split()})))
    found = docs.select(F.explode(F.array_intersect("words", universe)).alias("w")).groupBy("w").count().collect()  # one row for each template word: documents that have it
    postings = _postings(spark, every, {r["w"]: r["count"] for r in found}, containment)

    # the null after the last word matches nothing: its row stands for the document itself
    met = docs.select("key", "h", "bytes", "words", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "w"))
    met = met.join(F.broadcast(postings), "w", "left").where("w is null or template is not null")
    met = met.withColumn("words", F.when(F.col("w").isNotNull(), F.col("words")))  # a document's own row needs no text
    # a phrase is looked up where the shared word puts it; a template in the two blocks around the word
    block = F.floor(F.col("pos") / stride).cast("int") * stride
    tried = F.when(F.col("phrase"), F.array(F.col("pos") - F.col("place"))).when(F.col("template").isNotNull(), F.array(block, block - stride)).otherwise(F.array(F.lit(0)))
    met = met.select("*", F.explode(F.filter(tried, lambda x: x >= 0)).alias("start"))
    size = F.when(F.col("phrase"), F.size("spelled")).otherwise(F.lit(2 * stride))
    row = F.col("w").isNull()
    met = met.select("key", "h", "bytes", row.alias("row"), F.when(row, F.col("pos")).cast("bigint").alias("n"), "label", "phrase", "family", "i", "need", "own", "rest", "before", "spelled", "start", F.when(~row, F.slice("words", F.col("start") + 1, size)).alias("block"))
    long_enough = F.size(F.array_distinct("block")) >= F.col("need")
    first_shared = ~F.arrays_overlap("block", "before")  # the pair is tried from its first shared word only
    overlap = F.size(F.array_intersect("rest", "block"))
    holds = F.when(F.col("phrase"), F.col("block") == F.col("spelled")).otherwise(long_enough & first_shared & (F.size("rest") >= F.col("need")) & (overlap >= F.col("need")))
    share = F.when(F.col("phrase"), 1.0).otherwise(overlap / F.size("own"))
    met = met.withColumn("holds", F.col("row") | F.coalesce(holds, F.lit(False))).where("holds")
    met = met.withColumn("share", F.when(~F.col("row"), share)).withColumn("base", F.col("phrase") & ~F.col("row"))
    kept = ["key", "h", "bytes", "row", "n", "base", "start", "label", "share"]
    # the best template of a family in a block and its neighbours
    near = met.where("not row and not phrase").withColumn("rated", F.struct("share", overlap.alias("words"), "label"))
    near = near.groupBy("key", "h", "bytes", "family", "start").agg(F.max("rated").alias("best"))
    along = Window.partitionBy("key", "h", "bytes", "family").orderBy("start")
    rating = F.struct("best.share", "best.words")
    better = [(F.abs(step("start").over(along) - F.col("start")) <= stride) & (step(rating).over(along) > rating) for step in (F.lag, F.lead)]
    near = near.select("*", (F.coalesce(better[0], F.lit(False)) | F.coalesce(better[1], F.lit(False))).alias("worse")).where("not worse")
    near = near.select("key", "h", "bytes", F.lit(False).alias("row"), F.lit(None).cast("bigint").alias("n"), F.lit(False).alias("base"), "start", "best.label", "best.share")
    met = met.where("row or phrase").select(*kept).unionByName(near.select(*kept))
    one = met.groupBy("key", "h", "bytes").agg(
        F.max("n").alias("n_words"),
        F.count(F.when(F.col("base"), 1)).alias("places"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("row"), 1)).alias("copies"),
    )
    out = one.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return out.select(
        F.col("key").alias(key), "n_words", F.expr("places div copies").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(F.array_sort("labels"), ",").alias("labels"), "score",
    )
