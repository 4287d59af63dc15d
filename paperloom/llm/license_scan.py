"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a document or, across line breaks, a window of so many
words in a row that a template fits in with as many others as THRESHOLD lets it
miss (its length over THRESHOLD); its words are runs of ASCII letters and digits
and of characters beyond ASCII, A-Z lower-cased. A block meets a template when
it holds at least THRESHOLD of the template's distinct words. Words are ordered
by their number of documents in the whole corpus, rarest first: a block that
meets a template has one of the template's first |T| - need + 1 words (prefix),
has at least `need` words that templates know (length), and the places of a
common word in both orders leave room for `need` common words (position). What
passes is counted exactly. Windows are those around a word of the prefix, in two
steps: the words around it that any window could hold (length), then each window.
Only built-in functions run.

Besides, the places of a few fixed phrases are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.workspace import Workspace

#: Phrases and labels that are always reported.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Openings of public licenses and usual notices, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
THRESHOLD = 0.8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaced(text):
    """The words of a text, each between two spaces of its own; empty without words."""
    bare = F.trim(F.regexp_replace(F.lower(text), GAP, "  "))
    return F.when(bare != "", F.concat(F.lit(" "), bare, F.lit(" "))).otherwise(F.lit(""))


def _count(text, inner: str, step: int):
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(inner), F.lit("")))) / step).cast("long")


def _words(spaced):
    return _count(spaced, " ", 2)


def _phrase(spaced, phrase: str):
    """(places, first word, last word) of a phrase; no phrase here overlaps itself."""
    inner = " " + phrase.replace(" ", "  ") + " "
    there = F.contains(spaced, F.lit(inner))
    places = F.when(there, _count(spaced, inner, len(inner))).otherwise(F.lit(0).cast("long"))
    first = F.when(there, _words(F.substring_index(spaced, inner, 1)))
    last = F.when(there, _words(spaced) - _words(F.substring_index(spaced, inner, -1)) - len(phrase.split()))
    return places, first, last


def _windows(texts: DataFrame, table: DataFrame, openers: list[str], widest: int) -> DataFrame:
    """(doc_id, h, label, words, both) of windows of texts(doc_id, h, maybe) that meet a template, the best around each word of its prefix."""
    reach = widest - 1
    around = lambda x, i: F.struct(x.alias("word"), F.least(i, F.lit(reach)).alias("ahead"), F.slice("all", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near"))
    rows = texts.select("doc_id", "h", F.filter(F.split(F.lower("maybe"), GAP), lambda x: x != "").alias("all"))
    places = rows.select("doc_id", "h", F.explode(F.filter(F.transform("all", lambda x, i: F.when(x.isin(openers), around(x, i))), lambda s: s.isNotNull())).alias("s")).select("doc_id", "h", "s.*")
    return (
        places.join(F.broadcast(table), "word")  # the templates' prefixes: a fixed table
        .withColumn("near", F.expr("slice(near, greatest(ahead - width + 1, 0) + 1, least(ahead, width - 1) + width)"))
        .where("size(array_intersect(words, near)) >= need")
        .withColumn("both", F.expr("array_max(transform(sequence(1, greatest(size(near) - width, 0) + 1), i -> size(array_intersect(words, slice(near, i, width)))))"))
        .where("both >= need")
        .select("doc_id", "h", "label", "words", "both")
    )


def license_scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, across: bool = False) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    n_base, first_word and last_word are about the phrases; labels joins those
    of phrases and templates; score is the largest share of a template's words
    that a block holds, among those that meet the threshold, 1 where a phrase
    stands and 0 without either. Blocks are lines and, with across, the windows
    across line breaks too. Null and empty texts have no words. Rows with
    the same id are told apart by their text; other columns are not read.
    """
    ws = Workspace(spark, "license-scan")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()})
    known = F.array(*map(F.lit, vocabulary))
    counts = rows.select(F.explode(F.array_intersect(F.split(F.lower("text"), GAP), known)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r.word: r.n for r in counts.collect()}  # as many rows as templates have words
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for number, (label, text) in enumerate(TEMPLATES):
        words = sorted(set(text.split()), key=rank.get)
        need = max(1, -(-round(threshold * 1000) * len(words) // 1000))
        width = -(-1000 * len(text.split()) // max(1, round(threshold * 1000)))
        entries += [(w, number, label, i, need, words, width) for i, w in enumerate(words[: len(words) - need + 1])]
    table = spark.createDataFrame(entries, "word string, template int, label string, place int, need int, words array<string>, width int")
    openers = sorted({e[0] for e in entries})

    spaced = rows.select("doc_id", F.xxhash64("text").alias("h"), "text", _spaced(F.col("text")).alias("spaced"))
    found = [_phrase(F.col("spaced"), p) for p in PHRASES]
    base_labels = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(n > 0, F.lit(label)) for (n, _, _), label in zip(found, PHRASES.values()))), lambda x: x.isNotNull())))
    may = reduce(lambda a, b: a | b, (F.contains("spaced", F.lit(f" {w} ")) for w in openers))
    base = ws.save(
        spaced.select(
            "doc_id", "h", _words(F.col("spaced")).alias("n_words"), reduce(lambda a, b: a + b, (n for n, _, _ in found)).alias("n_base"),
            F.least(*(a for _, a, _ in found)).alias("first_word"), F.greatest(*(b for _, _, b in found)).alias("last_word"), base_labels.alias("base"),
            F.when(may, F.col("text")).alias("maybe"),
        ),
        "base",
    )

    ordered = F.array(*map(F.lit, order))
    lines = base.where("maybe IS NOT NULL").select("doc_id", "h", F.explode(F.split("maybe", "\n")).alias("line"))
    least = min(e[4] for e in entries)
    blocks = lines.select("doc_id", "h", F.array_intersect(ordered, F.split(F.lower("line"), GAP)).alias("block")).where(F.size("block") >= least)
    opened = blocks.select("doc_id", "h", "block", F.explode(F.array_intersect("block", F.array(*map(F.lit, openers)))).alias("word"))
    met = (
        opened.join(F.broadcast(table), "word")  # the templates' prefixes: a fixed table
        .where("size(block) >= need")
        .withColumn("at", F.expr("array_position(block, word) - 1"))
        .where("least(place, at) + 1 + least(size(words) - 1 - place, size(block) - 1 - at) >= need")
        .withColumn("both", F.size(F.array_intersect("words", "block")))
        .where("both >= need")
        .select("doc_id", "h", "label", "words", "both")
    )
    if across:
        met = met.unionByName(_windows(base.where("maybe IS NOT NULL"), table, openers, max(e[6] for e in entries)))
    met = met.groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.max(F.col("both") / F.size("words")).alias("share"))
    wide = base.drop("maybe").alias("b").join(met.alias("m"), F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.h") == F.col("m.h")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.expr("array()").cast("array<string>"))))
    return wide.select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("share", F.lit(0.0))).alias("score"),
    )
