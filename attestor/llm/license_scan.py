"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a statement of a license. It *stands* in a text if some run of words, a quarter longer than
the statement, holds the threshold's share of its distinct words: whole words are compared, over the
whole text, so that line breaks, marks and a few foreign words do not matter, while words that are
scattered over a longer stretch do not count.

Blocks are overlapping stretches of words, each twice as long as the longest run and starting halfway
through the one before, so that every run lies whole in a block. Candidates come from the classical
filters of exact set-similarity joins: words are put in one global order, rarest first, by how many
documents of the whole corpus hold them; a block and a template that overlap enough must share a word
of both *prefixes*; the block must be *long* enough; and what follows the *positions* of the shared word
must still allow the overlap. Candidates are then verified run by run. Words of no template take no
part in any overlap, so blocks keep template words only, and documents that hold too few of every
template's words have no block.

Only DataFrame functions are used. The templates are a constant table; their words' frequencies (one
number for each word of the templates) visit the driver, which writes the order into the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.bitset import bitset, only_possible
from attestor.llm.common import numbered, unused

#: What separates words (any ASCII that is no letter or digit), once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are found word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Share of a template's distinct words that a run must hold.
THRESHOLD = 0.9
#: Fixed values: (label, statement) of usual licenses, in the licenses' own words.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)


class Template:
    """A statement's label, distinct words, least overlap, and the longest run that may hold it."""

    def __init__(self, label: str, text: str, threshold: float):
        words = text.split()
        self.label, self.words, self.run = label, sorted(set(words)), len(words) + len(words) // 4
        self.need = math.ceil(threshold * len(self.words) - 1e-9)


def _templates(templates, threshold: float) -> list[Template]:
    return [Template(label, text, threshold) for label, text in templates]


def _normal(text: Column) -> Column:
    """The words of a text between single spaces, with a space before and behind."""
    # lower() also turns the Kelvin sign into an ASCII letter; any other letter that is none stays one
    small = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))
    trimmed = F.trim(F.regexp_replace(small, SEPARATORS, " "))
    return F.when(trimmed == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), trimmed, F.lit(" ")))


def _words(normal: Column) -> Column:
    return F.split(F.trim(normal), " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _phrase_columns(phrases: dict[str, str]) -> list[Column]:
    """Word-by-word matches of the phrases in ``norm``, whose word k follows its k-th space."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        n, padded = len(phrase.split()), f" {phrase} "
        has = F.contains(F.col("norm"), F.lit(padded))
        before = F.substring_index("norm", padded, 1)
        after = F.substring_index("norm", padded, -1)
        counts.append(F.when(has, F.regexp_count("norm", F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(has, _spaces(before)))
        lasts.append(F.when(has, F.col("n_words") - _spaces(after) - n))
        labels.append(F.when(has, F.lit(label)))
    return [
        sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    ]


def _literal(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _candidates(blocks: DataFrame, sets: list[Template], rank: dict[str, int]) -> DataFrame:
    """Blocks (uid, words, found) with each template (t) that enough of their words are in: prefix, length and position filters, then the overlap."""
    least = min(t.need for t in sets)
    prefixes = []
    for k, t in enumerate(sets):
        ordered = sorted(rank[w] for w in t.words)
        prefixes += [(r, i + 1, k, ordered, t.need) for i, r in enumerate(ordered[: len(ordered) - t.need + 1])]
    one = lambda r, i, k, ordered, need: F.struct(F.lit(r).alias("rank"), F.lit(i).alias("i"), F.lit(k).alias("t"), _literal(ordered).alias("ordered"), F.lit(need).alias("need"))
    table = blocks.sparkSession.range(1).select(F.inline(F.array(*[one(*p) for p in prefixes])))

    known = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    blocks = blocks.withColumn("block", F.array_sort(F.transform("found", lambda w: known[w])))
    prefix = F.slice("block", 1, F.greatest(F.size("block") - least + 1, F.lit(0)))
    exploded = blocks.select("uid", "words", "block", F.posexplode(prefix).alias("j", "at"))
    size, j = F.size("block"), F.col("j") + 1
    candidate = (
        (F.col("at") == F.col("rank"))
        & (size >= F.col("need"))  # length
        & (j <= size - F.col("need") + 1)  # prefix of the block
        & (F.least(size - j, F.size("ordered") - F.col("i")) + 1 >= F.col("need"))  # positions
    )
    joined = exploded.join(F.broadcast(table), candidate)  # the constant templates: some hundreds of rows
    return joined.where(F.size(F.array_intersect("block", "ordered")) >= F.col("need")).select("uid", "words", "t")


def _best_run(words: Column, of: Column, run: Column) -> Column:
    """The most distinct words of a template that one run of a block holds."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(of, x["w"]))
    held = lambda all_, a: F.size(F.array_distinct(F.transform(F.filter(all_, lambda x: (x["i"] >= a["i"]) & (x["i"] < a["i"] + run)), lambda x: x["w"])))
    return F.transform(F.array(hits), lambda all_: F.array_max(F.transform(all_, lambda a: held(all_, a))))[0]


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES, phrases=None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    score: the largest share of a template's words in one run, among those that meet the threshold;
    1.0 where a phrase stands; else 0.0. A null text is the empty text: no words, null positions,
    empty labels. Each repeated row, or row with the same or a null id, gives its own row; an empty
    table gives an empty result; other columns are not read.
    """
    sets = _templates(templates, threshold)
    vocabulary = sorted({w for t in sets for w in t.words})
    half = max(t.run for t in sets)
    uid = unused(docs, "__uid")
    rows = numbered(docs, uid).select(F.col(uid).alias("uid"), F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    # texts are read once; what is kept of them is short
    normal = rows.select("uid", "id", _normal(F.col("text")).alias("norm")).withColumn("n_words", (_spaces(F.col("norm")) - 1).cast("long"))
    held = F.array_intersect(_words(F.col("norm")), _literal(vocabulary))
    based = normal.select("uid", "id", "n_words", *_phrase_columns(phrases or PHRASES), held.alias("held")).checkpoint()
    counted = based.select(F.explode("held").alias("word")).groupBy("word").count().collect()  # one count for each word of the templates
    count = {r["word"]: r["count"] for r in counted}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}

    enough = [F.size(F.array_intersect("held", _literal(t.words))) >= t.need for t in sets]
    some = based.where(F.size("held") >= min(t.need for t in sets)).where(F.exists(F.array(*enough), lambda x: x)).select("uid").checkpoint()
    chosen = only_possible(rows.select("uid", "text"), F.xxhash64("uid"), bitset(some, F.xxhash64("uid"))).join(some, "uid", "left_semi")
    words = chosen.select("uid", _words(_normal(F.col("text"))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / half) - 2, F.lit(0)))
    blocks = words.select("uid", "w", F.explode(starts).alias("b")).select("uid", F.slice("w", (F.col("b") * half + 1).cast("int"), 2 * half).alias("words"))
    blocks = blocks.select("uid", "words", F.array_intersect("words", _literal(vocabulary)).alias("found"))

    facts = F.array(*[F.struct(F.lit(t.label).alias("label"), _literal(t.words).alias("words"), F.lit(t.need).alias("need"), F.lit(t.run).alias("run")) for t in sets])
    found = _candidates(blocks, sets, rank).withColumn("t", F.get(facts, F.col("t")))
    found = found.select("uid", "t.label", "t.need", F.size("t.words").alias("size"), _best_run(F.col("words"), F.col("t.words"), F.col("t.run")).alias("best")).where("best >= need")
    more = found.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max(F.col("best") / F.col("size")).alias("share"))
    joined = based.drop("held").join(more, "uid", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, phrases=None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan_licenses() over the table documents: every run of words that starts with a template's word, against that template."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"list_filter(string_split_regex(translate({{}}, '{upper}', '{upper.lower()}'), '{SEPARATORS}'), lambda x: x <> '')"
    places, labels = [], []
    for phrase, label in (phrases or PHRASES).items():
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))
        places.append(f"list_filter(range(len(w)), lambda i: {test})")
        labels.append(f"CASE WHEN len({places[-1]}) > 0 THEN ['{label}'] ELSE [] END")
    rows = ", ".join(f"('{t.label}', {t.words}, {t.need}, {t.run})" for t in _templates(templates, threshold))
    return f"""
WITH t(label, words, need, run) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
p AS MATERIALIZED (SELECT uid, doc_id, {words.format('text')} AS w FROM d),
b AS (SELECT uid, doc_id, len(w) AS n_words, {' || '.join(places)} AS places, list_sort(list_distinct({' || '.join(labels)})) AS base FROM p),
h AS (SELECT uid, label, words, need, run, w, unnest(range(1, len(w) + 1)) AS a FROM p JOIN t ON len(list_intersect(p.w, t.words)) >= t.need),
m AS (SELECT uid, label, need, max(len(list_intersect(w[a:a + run - 1], words)) / len(words)::DOUBLE) AS share, max(len(list_intersect(w[a:a + run - 1], words))) AS best FROM h WHERE list_contains(words, w[a]) GROUP BY uid, label, need, words),
g AS (SELECT uid, list(DISTINCT label) AS more, max(share) AS share FROM m WHERE best >= need GROUP BY uid)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN g USING (uid)"""
