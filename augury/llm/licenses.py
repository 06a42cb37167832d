"""License scans by diagonal voting, in DataFrame functions alone.

Rolling word k-gram hashes of every text are joined to the positions of the same k-grams in the templates. Hits vote for
their diagonal (document position less template position); neighbouring diagonals merge into one span, and a span counts
when it covers enough of its template. Base phrases are templates that must be covered whole, on one diagonal, and whose
words are compared again."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lower_ascii

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases that a scan must always find, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and opening clauses of well-known licenses; one passage may stand for a whole license.
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2 0", "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ],
    "mit": [
        "released under the mit license", "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "gpl-notice": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl": ["under the terms of the gnu affero general public license as published by the free software foundation"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
}
COVER, DRIFT, GAP = 0.7, 3, 12


def _rows(base: dict, templates: dict, k: int):
    for phrase, label in base.items():
        words = re.findall(r"\S+", phrase)
        yield label, True, words, min(2, len(words))
    for label, lines in templates.items():
        for line in lines:
            words = line.split()
            yield label, False, words, min(k, len(words))


def _lowered(ascii_only: bool):
    """The text with A-Z in lower case. Templates of ASCII words cannot tell it from one whose other letters are lower-cased as
    well, which is faster, once the Kelvin sign (the one other character whose lower case is an ASCII word) is set apart."""
    return F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u0138"))) if ascii_only else lower_ascii(F.col("text"))


def scan(docs: DataFrame, base: dict = BASE, templates: dict = TEMPLATES, k: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty label strings and score 0. Repeated rows each get the same result; of ties
    (spans of equal cover) all labels are kept. An empty table gives no rows; other columns are not looked at. A text's words
    and their hashes are arrays of one row, so that memory grows with the longest text (about 40 bytes a word)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = list(_rows(base, templates, k))
    grams = [(t, label, exact, words, i, size) for t, (label, exact, words, size) in enumerate(rows) for i in range(len(words) - size + 1)]
    sizes = sorted({g[5] for g in grams})
    tpl = spark.createDataFrame(grams, "t int, label string, exact boolean, words array<string>, tpos int, size int")
    # The template table is a parameter of the scan, so its size does not grow with the documents; nor do its opening words.
    tpl = tpl.withColumn("h", F.expr("transform(words, x -> xxhash64(x))"))
    tpl = tpl.withColumn("gram", F.expr("xxhash64(slice(h, tpos + 1, size))")).withColumn("two", F.expr("xxhash64(h[tpos], get(h, tpos + 1))"))
    opening = [r[0] for r in tpl.filter("size > 1").select("two").distinct().collect()]
    single = [r[0] for r in tpl.filter("size = 1").select(F.expr("h[tpos]")).distinct().collect()]
    starts = [f"{what} IN ({', '.join(f'{x}L' if x > -(1 << 63) else 'long(-9223372036854775808)' for x in values)})" for what, values in (("xxhash64(x, get(h, i + 1))", opening), ("x", single)) if values]
    ascii_only = all(w.isascii() for _, _, words, _ in rows for w in words)
    words = docs.select("doc_id", F.xxhash64("text").alias("key"), F.regexp_extract_all(_lowered(ascii_only), F.lit(WORDS), F.lit(0)).alias("w"))
    words = words.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    # Places where some template's first two words stand; the whole grams are built only there, and joined with the templates'.
    at = f"filter(transform(h, (x, i) -> IF({' OR '.join(starts) or 'false'}, i, -1)), i -> i >= 0)"
    words = words.withColumn("at", F.expr(at))
    gram = ", ".join(f"IF(i + {s} <= size(w), named_struct('gram', xxhash64(slice(h, i + 1, {s})), 'said', slice(w, i + 1, {s})), NULL)" for s in sizes) or "NULL"
    words = words.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.expr(f"transform(at, i -> named_struct('dpos', i, 'gs', filter(array({gram}), g -> g is not null)))").alias("hits"))
    # The texts are read once; what follows works on the places found.
    words = scratch.cut(words, "words", keep=True)
    hits = words.select("doc_id", "key", F.explode("hits").alias("x")).select("doc_id", "key", "x.dpos", F.explode("x.gs").alias("g")).select("doc_id", "key", "dpos", "g.gram", "g.said")
    hits = hits.join(F.broadcast(tpl), "gram").filter(F.expr("said = slice(words, tpos + 1, size)"))
    hits = hits.select("doc_id", "key", "t", "label", "exact", F.size("words").alias("len"), "size", "dpos", "tpos", (F.col("dpos") - F.col("tpos")).alias("diag")).distinct()
    diag = hits.groupBy("doc_id", "key", "t", "label", "exact", "len", "size", "diag").agg(
        F.count("*").alias("votes"), F.min("dpos").alias("lo"), (F.max("dpos") + F.first("size")).alias("hi"), F.collect_set("tpos").alias("at")
    )
    w = Window.partitionBy("doc_id", "key", "t").orderBy("lo", "diag")
    new = (F.col("lo") - F.lag("hi").over(w) > GAP) | (F.abs(F.col("diag") - F.lag("diag").over(w)) > DRIFT) | F.lag("hi").over(w).isNull()
    spans = diag.filter("not exact").withColumn("span", F.sum(new.cast("int")).over(w))
    spans = spans.groupBy("doc_id", "key", "t", "label", "len", "size", "span").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    covered = F.expr("size(array_distinct(flatten(transform(at, p -> sequence(p, p + size - 1))))) / len")
    spans = spans.select("doc_id", "key", "label", covered.alias("cover")).filter(F.col("cover") >= COVER)
    spans = spans.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    exact = diag.filter("exact and votes = len - size + 1").groupBy("doc_id", "key").agg(
        F.count("*").alias("n_base"), F.min("diag").cast("long").alias("first_word"), F.max("diag").cast("long").alias("last_word"), F.collect_set("label").alias("b")
    )
    both = exact.unionByName(spans, allowMissingColumns=True)  # a group, unlike a join, holds null ids together
    found = both.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(
        F.max("n_base").alias("n_base"), F.max("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.flatten(F.collect_list("b")).alias("b"), F.flatten(F.collect_list("more")).alias("more"), F.max("cover").alias("cover"))
    none = F.array().cast("array<string>")
    docs_side = words.select("doc_id", "key", "n_words")
    out = docs_side.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("b", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("b", none), F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )

