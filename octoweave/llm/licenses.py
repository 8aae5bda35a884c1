"""License scan by exact set-similarity join, in DataFrame functions only.

Templates are license notices of known length. Blocks are overlapping runs of words, whatever lines they stand on: a template of up to
W words, W a power of two, is compared with the runs of 2 W words that begin at every W-th word of a text, so that each passage as long
as the template lies whole in a block. A block meets a template if it holds CONTAINMENT of the template's distinct words.

The join is exact and filtered in four ways. Template words are ordered by their document frequency over the corpus, rarest first.
Prefix: a block that meets a template of n words, a = ceil(CONTAINMENT n) of which must match, holds one of the template's n - a + 1
first words; only occurrences of these make blocks at all. Length: a block of fewer than a words meets nothing. Position: the first
shared word in the order alone brings a pair, and the words from it on must suffice. Candidates are then counted in full.

Only the templates, a fixed list, are broadcast. Phrases that name a license outright are counted beside the join.

Defined results: null text is empty; empty texts have no words, no place and score 0; words are what stands between ``BREAK`` after A-Z
became a-z; rows that repeat give rows that repeat; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that is not folded.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices in common use, as their words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl-1", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]


def template_sets() -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct words, words needed, W) of each template."""
    out = []
    for i, (label, text) in enumerate(TEMPLATES):
        words = sorted(set(text.split()))
        out.append((i, label, words, ceil(CONTAINMENT * len(words) - 1e-9), 1 << (len(text.split()) - 1).bit_length()))
    return out


def _folded(text: Column) -> Column:
    """A-Z as a-z and nothing else. Two letters beyond ASCII fold to ASCII by the general rule, so texts that have them take the slow way."""
    return F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _spaced(text: Column) -> Column:
    """The text's words, each between two spaces of its own: ' a  b '; '' without words."""
    joined = F.trim(F.regexp_replace(_folded(text), BREAK, " "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(joined, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _count(spaced: Column) -> Column:
    """Words in a spaced text."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.split(_folded(text), BREAK), lambda w: w != "")


def rarest_first(docs: DataFrame) -> list[str]:
    """The templates' words by how many documents hold them; a row for each word of a fixed list comes back, whatever the corpus."""
    vocabulary = sorted({w for _, _, words, *_ in template_sets() for w in words})
    held = docs.select(F.explode(F.array_distinct(F.filter(F.split(_folded(F.col("text")), BREAK), lambda w: w.isin(*vocabulary)))).alias("word"))
    frequency = {r["word"]: r["df"] for r in held.groupBy("word").agg(F.count("*").alias("df")).collect()}
    return sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))


def blocks_meeting(docs: DataFrame) -> DataFrame:
    """(key, block, template, label, containment) of each block of ``docs`` (key, text) that meets a template."""
    order, rows = rarest_first(docs), []
    for i, label, words, need, width in template_sets():
        ranked = [w for w in order if w in words]
        rows += [(i, label, len(words), need, width, w, ranked) for w in ranked[: len(words) - need + 1]]
    prefix = docs.sparkSession.createDataFrame(rows, "template int, label string, n int, need int, width int, word string, t_words array<string>")
    first = sorted({r[5] for r in rows})
    texts = docs.select("key", _words(F.col("text")).alias("words"))
    texts = texts.withColumn("hits", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(*first))).where(F.size("hits") > 0)
    met = texts.select("key", "words", F.explode("hits").alias("hit")).select("key", "words", "hit.word", "hit.at").join(F.broadcast(prefix), "word")  # a fixed list
    last = F.floor(F.col("at") / F.col("width")).cast("int")
    met = met.withColumn("block", F.explode(F.sequence(F.greatest(last - 1, F.lit(0)), last)))
    run = F.slice("words", F.col("block") * F.col("width") + 1, F.col("width") * 2)
    met = met.select("key", "block", "template", "label", "n", "need", "word", F.when(F.size(run) >= F.col("need"), F.array_intersect("t_words", run)).alias("shared"))
    met = met.where((F.size("shared") >= F.col("need")) & (F.element_at("shared", 1) == F.col("word")))
    # The first shared word may stand in a block several times.
    return met.select("key", "block", "template", "label", (F.size("shared") / F.col("n")).alias("containment")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    # Rows equal in doc_id and text get equal answers, so their hash is key enough.
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    folded = keyed.select("doc_id", "key", "text", _folded(F.col("text")).alias("folded"))
    may = None
    for phrase in PHRASES:
        all_ = None
        for word in sorted(phrase.split(), key=lambda w: -len(w)):
            has = F.contains("folded", F.lit(word))
            all_ = has if all_ is None else all_ & has
        may = all_ if may is None else may | all_
    spaced = folded.select("doc_id", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(may, _spaced(F.col("text"))).otherwise("").alias("spaced"))
    places = []
    for phrase, label in PHRASES.items():
        needle = " " + phrase.replace(" ", "  ") + " "
        n = ((F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(needle), F.lit("")))) / len(needle)).cast("long")
        first = _count(F.substring_index("spaced", needle, 1))
        last = F.col("n_words") - _count(F.substring_index("spaced", needle, -1)) - len(phrase.split())
        places.append(F.when(F.contains("spaced", F.lit(needle)), F.struct(n.alias("n"), first.alias("first"), last.alias("last"), F.lit(label).alias("label"))))
    base = spaced.select("doc_id", "key", "n_words", F.filter(F.array(*places), lambda p: p.isNotNull()).alias("places"))

    met = blocks_meeting(keyed.select("key", "text")).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    out = base.join(met.hint("merge"), "key", "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return out.select(
        "doc_id", "n_words", F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
