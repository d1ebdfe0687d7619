"""Operator 7: license scans by diagonal voting, in DataFrame operations only.

Every document is cut into words (lower case) once.  In the same pass, those of its rolling
k-grams whose hash some template has are picked out of the array of words; the rest of the
document goes no further.  The picked k-grams are joined by their hash with their positions
in a table of templates; equal hashes count only if the words are equal.  A match at word p
of the document and position t of a template lies on the diagonal p - t.  Votes are gathered
by (document, template, diagonal) as bitmaps of template positions, so repeated rows can't
vote twice; a template of any length has as many bitmaps of 64 positions as it needs.
Neighbouring diagonals (an inserted or dropped word shifts the rest by one) are merged,
and the merged span is verified by the share of template positions it covers.

Templates of one diagonal and full coverage are the places where the base phrases stand.

The templates come from the caller, and their table is broadcast; what the pass over the
texts finds is checkpointed, so that texts are read and cut once for the two that use it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import shared_folder

K = 2
#: Diagonals this far apart still merge; share of a template's k-grams that makes a label.
NEIGHBOUR, SHARE = 3, 0.7
#: Words of all templates together, which bounds the broadcast.
MOST_WORDS = 100_000
#: The base phrases and their labels, and openings and texts of public licenses.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
NOTICES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-3-notice": "licensed under the gnu general public license version 3",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
        OF THIS SOFTWARE.""",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def templates(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(label, base, t, w1, w2, n, gram): the k-grams of every template."""
    rows = []
    for base, group in ((True, phrases), (False, notices)):
        for label, text in group.items():
            words = template_words(text)
            n = len(words) - K + 1
            if n < 1:
                raise ValueError(f"template {label!r} must have {K} words at least")
            rows += [(label, base, t, words[t], words[t + 1], n) for t in range(n)]
    if len(rows) > MOST_WORDS:
        raise ValueError(f"templates must have {MOST_WORDS} words together at most")
    out = spark.createDataFrame(rows, "label string, base boolean, t int, w1 string, w2 string, n int")
    return out.withColumn("gram", F.xxhash64("w1", "w2"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """Words, base places and labels of every document.

    Returns the other columns of `docs` (any names) in a struct `row`, ``n_words``,
    ``n_base`` (places where a base phrase's words stand one after the other),
    ``first_word`` and ``last_word`` (smallest and largest start of these, words from 0, NULL
    without any), ``base_labels`` and ``labels`` (arrays, sorted; the latter with the notices
    found too), ``spans`` (array of (label, start, end, share) of the verified notices and
    phrases, sorted) and ``score`` (the largest share of a template that is covered, 1 with
    a base place, 0 without a match).

    NULL and empty texts have no words.  Rows with one id and equal texts get equal results,
    rows with one id and different texts are scanned each; a NULL id is a value of its own.
    An empty table gives no rows.  Words are lower-cased by `lower` (the Kelvin sign, which it
    would make a k, is taken out before), which differs from lower-casing A-Z only within
    words that hold other letters, and no template has any of these.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    shared_folder(docs)
    table = templates(docs.sparkSession, phrases, notices)
    # at most `MOST_WORDS` numbers: the k-grams that any template has
    grams = sorted({r["gram"] for r in table.select("gram").collect()})
    i, text = F.col(f"`{id_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.regexp_extract_all(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b"))), F.lit(f"({WORD})"), 1)
    key = [F.xxhash64(F.coalesce(i, F.lit("")), i.isNull()).alias("k1"), F.xxhash64(text).alias("k2")]
    cut = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"), words.alias("w"))
    at = F.when(F.size("w") >= K, F.filter(F.sequence(F.lit(0), F.size("w") - K), lambda p: F.xxhash64(F.get("w", p), F.get("w", p + 1)).isin(grams)))
    places = F.transform(at, lambda p: F.struct(p.alias("p"), F.get("w", p).alias("a"), F.get("w", p + 1).alias("b")))
    rows = cut.select("k1", "k2", "row", F.size("w").cast("long").alias("n_words"), places.alias("places")).checkpoint()

    found = rows.select("k1", "k2", F.inline("places"))
    met = found.join(F.broadcast(table), (F.xxhash64("a", "b") == F.col("gram")) & (F.col("a") == F.col("w1")) & (F.col("b") == F.col("w2")))
    votes = met.groupBy("k1", "k2", "label", "base", "n", (F.col("p") - F.col("t")).alias("d"), F.expr("t div 64").alias("part")).agg(
        F.bit_or(F.expr("shiftleft(1L, t % 64)")).alias("seen"), F.min("p").alias("start"), F.max("p").alias("last")
    )

    # neighbouring diagonals of one document and template; a document's own matches only
    order = Window.partitionBy("k1", "k2", "label").orderBy("d", "part")
    apart = F.coalesce((F.col("d") - F.lag("d").over(order) > F.when(F.col("base"), 0).otherwise(NEIGHBOUR)).cast("int"), F.lit(1))
    merged = votes.withColumn("new", apart).withColumn("run", F.sum("new").over(order))
    parts = merged.groupBy("k1", "k2", "label", "base", "n", "run", "part").agg(F.bit_or("seen").alias("seen"), F.min("d").alias("d"), F.min("start").alias("start"), F.max("last").alias("last"))
    spans = parts.groupBy("k1", "k2", "label", "base", "n", "run").agg(F.sum(F.bit_count("seen")).alias("seen"), F.min("d").alias("d"), F.min("start").alias("start"), F.max("last").alias("last"))
    covered = F.col("seen") / F.col("n")
    good = F.when(F.col("base"), F.col("seen") == F.col("n")).otherwise(covered >= share)
    spans = spans.select("k1", "k2", "label", (F.col("base") & good).alias("place"), good.alias("good"), "d", covered.alias("share"), "start", (F.col("last") + K).alias("end"))
    place = F.col("place")
    of = spans.groupBy("k1", "k2").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("d"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("d"))).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"), F.sort_array(F.collect_set(F.when(F.col("good"), F.col("label")))).alias("labels"),
        F.sort_array(F.collect_list(F.when(F.col("good"), F.struct("label", "start", "end", "share")))).alias("spans"), F.max("share").alias("score"),
    )
    none = F.array().cast("array<string>")
    return rows.select("k1", "k2", "row", "n_words").join(of, ["k1", "k2"], "left").select(
        "row", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"), "spans", F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    out = scan_licenses(docs.select("doc_id", "text"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")
