"""License scans: an exact containment join between text blocks and a table of license sentences.

A block is a sentence of a paragraph: line breaks inside a paragraph are spaces, so wrapped notices are
found; blank lines (also those with comment marks only) and sentence ends cut. A block matches a template
when it holds at least ``threshold`` of the template's distinct words. Template words are ordered by
frequency over the whole corpus, rarest first. An inverted index of every template's prefix is joined with
the blocks' words (prefix filter); a pair goes on at its first shared word only, where the block has enough
words (length filter) and enough of the template is left (positional filter), and is then verified. The
plan does not grow with the templates, and Spark chooses the join by the index's size.

Of the templates that match a block the best names it: highest containment, then the longest, then the
last by label; so a notice of one license is not also taken for its longer relatives.

Defined results: null text counts as empty; rows are judged alone, so repeated rows, null ids and ties pass
through; an empty table gives no rows; columns that are not carried are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WS = r"[ \t\n\x0B\f\r]"
#: Where blocks end: blank lines, sentence marks before a space, and the character that stands for either.
CUT = rf"(?=[.!?;\n\x01])(?:[.!?;]{WS}|\n[ \t\n\x0B\f\r*#/]*\n|\x01)"
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
THRESHOLD = 0.8
#: Names of licenses as notices state them; each makes the sentences of VERBS.
NAMES = {
    "mit": ("MIT License",),
    "isc": ("ISC License",),
    "zlib": ("zlib License",),
    "bsl-1.0": ("Boost Software License, Version 1.0",),
    "bsd": ("BSD License", "3-Clause BSD License", "2-Clause BSD License"),
    "apache-2.0": ("Apache License, Version 2.0",),
    "mpl-2.0": ("Mozilla Public License, version 2.0",),
    "epl-2.0": ("Eclipse Public License 2.0",),
    "gpl-2": ("GNU General Public License, version 2",),
    "gpl-3": ("GNU General Public License, version 3",),
    "lgpl": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1"),
    "agpl": ("GNU Affero General Public License, version 3",),
    "odbl": ("Open Database License",),
    "ofl": ("SIL Open Font License, Version 1.1",),
}
VERBS = ("licensed under the {}", "released under the {}", "distributed under the terms of the {}", "available under the {}")
#: Creative Commons short forms, with and without a version.
CC = {f"cc-{x.lower()}": f"CC {x}" for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")}
#: Sentences of the licenses themselves and of their usual notices.
SENTENCES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)


def templates_listed() -> list[tuple[str, str]]:
    """(label, sentence) of every bundled template."""
    out = [(label, verb.format(name)) for label, names in NAMES.items() for name in names for verb in VERBS]
    return out + [(label, f"licensed under {name} 4.0") for label, name in CC.items()] + list(SENTENCES)


def default_templates(spark: SparkSession) -> DataFrame:
    """(label, text), made of one literal so that the plan stays the same whatever the list."""
    lines = F.lit("\n".join(f"{label}\t{text}" for label, text in templates_listed()))
    return spark.range(1).select(F.explode(F.split(lines, "\n")).alias("l")).select(F.split("l", "\t")[0].alias("label"), F.split("l", "\t")[1].alias("text"))


def lowered(text: Column) -> Column:
    """Lower-casing other letters than A-Z cannot make or split a phrase."""
    return F.lower(F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit(""))))


def words_of(text: Column) -> Column:
    """The words of a text and an empty one."""
    return F.split(F.regexp_replace(lowered(text), BREAK, " "), " ")


def blocks(text: Column) -> Column:
    """A text's words with a space before each and \x01 after each block."""
    t = F.regexp_replace(F.regexp_replace(lowered(text), CUT, "\x01"), r"[\x00\x02-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    t = F.replace(F.replace(t, F.lit(" \x01"), F.lit("\x01")), F.lit("\x01 "), F.lit("\x01"))
    return F.rtrim(F.regexp_replace(t, "\x01+", "\x01 "))


def index(docs: DataFrame, templates: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Written table (word, pos, need, size, ws, label): the prefix of every template (label, text).

    A row of no template and the empty word is joined by one token of every document.
    """
    t = templates.select("label", F.array_remove(F.array_distinct(words_of(F.col("text"))), "").alias("ws")).where(F.size("ws") > 0).distinct()
    t = t.select("label", F.explode("ws").alias("word"), F.col("ws").alias("of"))
    seen = docs.select(F.explode(words_of(F.col(text))).alias("word"))
    seen = seen.join(t.select("word").distinct(), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = t.join(seen, "word", "left").groupBy("label", "of").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("r"))
    ranked = ranked.select("label", F.transform("r", lambda x: x["word"]).alias("ws"), F.size("r").alias("size"))
    need = F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int")
    prefix = ranked.withColumn("need", need).select("label", "ws", "size", "need", F.posexplode(F.slice("ws", F.lit(1), F.col("size") - F.col("need") + 1)).alias("pos", "word"))
    none = templates.sparkSession.range(1).select(
        F.lit("").alias("word"), F.lit(0).alias("pos"), F.lit(0).alias("need"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("ws"), F.lit(None).cast("string").alias("label")
    )
    return stored(prefix.select("word", "pos", "need", "size", "ws", "label").unionByName(none), "templates", 1)[0]


def _base(n: Column) -> list[Column]:
    """Columns n_words, n_base, first_word, last_word and the labels b of a text's words, a space around each."""
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    counts, firsts, lasts, names = [], [], [], []
    for label, phrase in BASE.items():
        w = len(phrase.split())
        has = F.contains(n, F.lit(f" {phrase} "))
        parts = F.split(n, f"(?<= ){phrase}(?= )", -1)
        counts.append(F.when(has, F.size(parts) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(has, spaces(parts[0]) - 1))
        # words before the last place: all words less those of the last place and after it
        lasts.append(F.when(has, spaces(n) - 1 - (spaces(F.element_at(parts, -1)) - 1) - w))
        names.append(F.when(has, F.lit(label)))
    return [
        (spaces(n) - 1).cast("long").alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"), F.array_sort(F.array_compact(F.array(*names))).alias("b"),
    ]


def scan(docs: DataFrame, templates: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """One row per row of ``docs``: columns ``carry``, then n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``templates`` is what index() gives. One pass over the texts; only ids, counts and matches are shuffled.
    """
    keep = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    d = docs.select(*keep, blocks(F.col(text)).alias("bs"), F.monotonically_increasing_id().alias("_id"))
    d = d.withColumn("n", F.concat(F.replace("bs", F.lit("\x01"), F.lit("")), F.lit(" ")))
    whole = [*[f"_c{i}" for i in range(len(carry))], "_id", "n_words", "n_base", "first_word", "last_word", "b"]
    d = d.select(*whole[: len(carry) + 1], *_base(F.col("n")), F.split(F.concat(F.lit("\x01"), "bs"), "\x01").alias("bs"))  # beside a generator they would be computed per block
    d = d.select(*whole, F.posexplode("bs").alias("block", "t")).where("block = 0 or t <> ''")
    d = d.select(*whole, "block", F.array_distinct(F.split(F.ltrim("t"), " ")).alias("ws_b"))
    hit = d.select(*whole, "block", "ws_b", F.explode("ws_b").alias("word")).join(templates, "word")
    size_b = F.size("ws_b")
    left = (size_b >= F.col("need")) & (F.col("size") - F.col("pos") >= F.col("need")) & ~F.arrays_overlap(F.slice("ws", F.lit(1), F.col("pos")), F.col("ws_b"))
    shared = F.when(F.col("label").isNull(), F.lit(0)).when(left, F.size(F.array_intersect("ws", "ws_b"))).otherwise(F.lit(-1))
    hit = hit.select(*whole, "block", "size", "label", "need", shared.alias("shared")).where("shared >= need")
    found = F.when(F.col("label").isNotNull(), F.struct("block", (F.col("shared") / F.col("size")).alias("c"), "size", "label"))
    got = hit.groupBy(*whole).agg(F.collect_list(found).alias("h"))
    best = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["block"] != x["block"]))
    got = got.select("*", let(F.sort_array("h", asc=False), best).alias("best"))
    return got.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias(prefix + c) for c in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join("b", ",").alias(f"{prefix}base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("b", F.transform("best", lambda x: x["label"])))), ",").alias(f"{prefix}labels"),
        F.when(F.size("b") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("best", lambda x: x["c"])), F.lit(0.0))).alias(f"{prefix}score"),
    )
