"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of words, across lines and paragraphs, so that a notice is found however it is wrapped. A
template of up to s words (s a power of two, `least_window` at least) is held against windows of 2 s words that
start every s words: a passage of s words lies in one of them. A template is a set of words, and a block meets it
if it holds at least `threshold` of them: |block and template| >= ceil(threshold * |template|) = t. The join is exact:

* order: every template word has a frequency over all blocks of the corpus; words are ordered
  from the rarest up, so that prefixes hold the rarest words. Words of no template can never count.
* prefix: a template of n words and a block of m template words can only meet if the first n - t + 1
  words of the template and the first m - t + 1 words of the block share one.
* length: m >= t.
* position: at the first shared word, 1 + the fewer of the words that follow on either side >= t.
* verification: the intersection is counted for the candidates that are left.

Every match is kept. Labels are told apart by two rules. Where the text of another license meets a template, too,
because the two differ in few words, the words that set it apart from that are asked for (`marks`). And a match
gives no label where, in the same block, a template of another license is met that holds all of its words and more.

Texts are read once. A document goes on to windows only if all of it, as one block, meets a template; its blocks
go to a small table in the shared folder, and frequencies, join and verification read that. Templates are a small
parameter table (`MAX_TEMPLATE_WORDS` words in all, checked), so their index is broadcast; only frequencies and
matches are shuffled. DataFrame functions alone, no Python.

The base finds places where a phrase's words stand one after the other, anywhere in the text.

Defined results: a null text counts as empty (no words, no labels, score 0); each row gives one row,
repeated rows and a null doc_id included; other columns are ignored whatever their names; ties need
no order, since labels are sets; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.sources.scratch import materialize
from crossgrain.sources.tables import table

THRESHOLD = 0.8
#: The templates' words, repeats of a word in other templates included. They are looked up for every document.
MAX_TEMPLATE_WORDS = 20_000
#: Words of the templates that the shortest windows, of twice as many words, are for.
LEAST_WINDOW = 8
#: Characters between words: every ASCII character but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Notices and passages of public licenses, lower case.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
)


@dataclass(frozen=True)
class Template:
    """`window`: the length of passages that its blocks are made for; `marks`: words that a match must have; `above`: numbers of templates that take its place in a block."""

    label: str
    words: frozenset[str]
    window: int
    marks: frozenset[str] = frozenset()
    above: tuple[int, ...] = ()

    def needed(self, threshold: float) -> int:
        return max(1, math.ceil(threshold * len(self.words) - 1e-9))


def parse_templates(templates: tuple[tuple[str, str], ...], threshold: float = THRESHOLD, least_window: int = LEAST_WINDOW) -> list[Template]:
    """Of (label, text) pairs; their words together are bounded by MAX_TEMPLATE_WORDS."""
    texts = [(label, text.split()) for label, text in templates if text.split()]
    if (n := sum(len(set(t)) for _, t in texts)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{n} template words; at most {MAX_TEMPLATE_WORDS} are looked up at a time, so scan in several calls")
    found = [Template(label, frozenset(t), max(least_window, 1 << (len(t) - 1).bit_length())) for label, t in texts]
    out = []
    for t in found:
        others = [(k, o) for k, o in enumerate(found) if o.label != t.label]
        near = [o.words for _, o in others if len(o.words & t.words) >= t.needed(threshold)]
        above = [k for k, o in others if t.words < o.words]
        window = max([t.window, *(found[k].window for k in above)])
        out.append(Template(t.label, t.words, window, frozenset().union(*[t.words - o for o in near]), tuple(above)))
    return out


def split_words(text: Column) -> Column:
    """Maximal runs of digits, ASCII letters and everything beyond ASCII, with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def _words(words) -> Column:
    """An array as one literal."""
    return F.split(F.lit(" ".join(sorted(words))), " ")


def windows(w: Column, n: Column, size: int, universe: Column, least: int) -> Column:
    """The blocks of `size`-word passages of `w` (`n` words) that have at least `least` words of `universe`."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 2, F.lit(0)))
    each = F.transform(starts, lambda i: F.struct(F.lit(size).alias("window"), i.alias("no"), F.array_intersect(universe, F.slice(w, i * size + 1, 2 * size)).alias("b")))
    return F.filter(each, lambda x: F.size(x["b"]) >= least)


def with_blocks(docs: DataFrame, templates: list[Template], threshold: float, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """For each row of `docs` (doc_id, text), in one pass over the texts: row_key, doc_id, n_words, the starts and labels of
    the phrases, and `blocks` (window, no, b), each the template words of a window that has enough of them for the smallest template.
    """
    sizes = sorted({t.window for t in templates})
    needs = {s: min(t.needed(threshold) for t in templates if t.window == s) for s in sizes}
    universe = _words({w for t in templates for w in t.words})
    df = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", F.coalesce("text", F.lit("")).alias("doc_text"))
    # arrays get columns of their own: a lambda that names an expression would evaluate it again for each element
    df = df.select("row_key", "doc_id", split_words(F.col("doc_text")).alias("w"))
    df = df.select("row_key", "doc_id", "w", F.array_intersect(universe, F.col("w")).alias("held"))
    needed = F.array(*[F.struct(_words(t.words).alias("words"), F.lit(t.needed(threshold)).alias("need")) for t in templates])
    met = F.when(F.size("held") < min(needs.values()), F.lit(False)).otherwise(F.exists(needed, lambda t: F.size(F.array_intersect(t["words"], F.col("held"))) >= t["need"]))
    df = df.select("row_key", "doc_id", "w", met.alias("met"))
    # not when(): a table without such a row has no blocks, and one with it has no nulls
    each = [windows(F.col("w"), F.size("w"), s, _words({w for t in templates if t.window == s for w in t.words}), needs[s]) for s in sizes]
    empty = F.array().cast("array<struct<window:int,no:int,b:array<string>>>")
    blocks = F.when(F.col("met"), F.concat(*each)).otherwise(empty)
    df = df.select("row_key", "doc_id", "w", blocks.alias("blocks"))
    at = [" AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split())) for phrase, _ in phrases]
    length = [len(phrase.split()) for phrase, _ in phrases]
    places = [f"CASE WHEN array_contains(w, '{phrase.split()[0]}') AND array_contains(w, '{phrase.split()[-1]}') AND size(w) >= {n} THEN filter(sequence(0, size(w) - {n}), i -> {a}) ELSE array() END" for (phrase, _), a, n in zip(phrases, at, length, strict=True)]
    df = df.select("row_key", "doc_id", "blocks", F.size("w").cast("long").alias("n_words"), F.expr(f"array({', '.join(places)})").alias("places"))
    labels = F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])
    flat = F.flatten("places")
    return df.select(
        "row_key", "doc_id", "blocks", "n_words", F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"),
        F.array_max(flat).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base_label_set"),
    )


def template_word_ranks(blocks: DataFrame, templates: list[Template]) -> dict[str, int]:
    """The place of each template word in the global order, rarest first by blocks that hold it, over all blocks; ties by the word.

    The driver gets one count for each template word, at most MAX_TEMPLATE_WORDS.
    """
    words = {w for t in templates for w in t.words}
    counted = blocks.select(F.explode(F.flatten("blocks.b")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r["word"]: r["n"] for r in counted}
    return {w: k for k, w in enumerate(sorted(words, key=lambda w: (n.get(w, 0), w)))}


def prefix_index(spark: SparkSession, templates: list[Template], ranks: dict[str, int], threshold: float) -> DataFrame:
    """A row for each template and word of its prefix; template_words are in the global order, places count from 0."""
    rows = []
    for k, t in enumerate(templates):
        ordered, need = sorted(t.words, key=ranks.__getitem__), t.needed(threshold)
        rows += [(w, t.window, k, t.label, place, ordered, sorted(t.marks), need) for place, w in enumerate(ordered[: len(ordered) - need + 1])]
    return spark.createDataFrame(rows, "prefix_word string, window int, template int, template_label string, template_place int, template_words array<string>, marks array<string>, need int")


def block_matches(blocks: DataFrame, templates: list[Template], threshold: float = THRESHOLD) -> DataFrame:
    """Each block of `blocks` (row_key, blocks) that meets a template: row_key, window, no, template, template_label, containment, marked (it has the words that are asked for).

    A pair may come once for each shared prefix word.
    """
    ranks = template_word_ranks(blocks, templates)
    universe = F.split(F.lit(" ".join(sorted(ranks, key=ranks.__getitem__))), " ")
    index = prefix_index(blocks.sparkSession, templates, ranks, threshold)
    least = F.create_map(*[F.lit(x) for s in sorted({t.window for t in templates}) for x in (s, min(t.needed(threshold) for t in templates if t.window == s))])
    ordered = blocks.select("row_key", F.inline("blocks")).select("row_key", "window", "no", F.array_intersect(universe, F.col("b")).alias("b"))
    # no template of a window asks for fewer than `least` words, so no block's prefix is longer than this
    probes = ordered.select("row_key", "window", "no", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - least[F.col("window")] + 1)).alias("block_place", "prefix_word"))
    n, m = F.size("template_words"), F.size("b")
    return (
        probes.join(F.broadcast(index), ["prefix_word", "window"])
        .where((m >= F.col("need")) & (F.col("block_place") <= m - F.col("need")))
        .where(F.least(n - F.col("template_place"), m - F.col("block_place")) >= F.col("need"))
        .select("row_key", "window", "no", "template", "template_label", "need", n.alias("n"), F.size(F.array_intersect("b", "template_words")).alias("shared"), (F.size(F.array_intersect("b", "marks")) == F.size("marks")).alias("marked"))
        .where("shared >= need")
        .select("row_key", "window", "no", "template", "template_label", (F.col("shared") / F.col("n")).alias("containment"), "marked")
    )


def matched_labels(matches: DataFrame, templates: list[Template]) -> DataFrame:
    """row_key, found, containment: of all marked matches that no match of the same block takes the place of. A block has as many matches as there are templates at most."""
    match = F.struct("template", "template_label", "containment")
    blocks = matches.where("marked").groupBy("row_key", "window", "no").agg(F.collect_set(match).alias("all"), F.collect_set("template").alias("met"))
    above = F.array(*[F.array(*map(F.lit, t.above)).cast("array<int>") for t in templates])
    own = F.filter("all", lambda m: ~F.arrays_overlap(F.element_at(above, m["template"] + 1), F.col("met")))
    labels = blocks.select("row_key", F.inline(own))
    return labels.groupBy("row_key").agg(F.collect_set("template_label").alias("found"), F.max("containment").alias("containment"))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, phrases: tuple[tuple[str, str], ...] = PHRASES, least_window: int = LEAST_WINDOW) -> DataFrame:
    """A row for each of `docs` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the greatest containment of a template that gives a label in a block, and 1 where a phrase stands.
    """
    parsed = parse_templates(templates, threshold, least_window)
    base = materialize(with_blocks(docs, parsed, threshold, phrases), "license-blocks")
    found = matched_labels(block_matches(base.select("row_key", "blocks"), parsed, threshold), parsed)
    out = base.drop("blocks").join(found, "row_key", "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_label_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_label_set", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and score of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    parsed = parse_templates(TEMPLATES)
    rows = ", ".join(f"({k}, '{t.label}', {sorted(t.words)!r}, {t.window}, {sorted(t.marks)!r} :: VARCHAR[], {list(t.above)!r} :: INTEGER[])" for k, t in enumerate(parsed))
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES)
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrase(p, label) AS (VALUES {phrases}
), template(id, label, words, size, marks, above) AS (VALUES {rows}
), place AS (
  SELECT k, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(string_split(p, ' '))] = string_split(p, ' '))) AS i FROM w, phrase
), base AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM place GROUP BY k
), block AS (
  SELECT k, size, no, w[no * size + 1 : (no + 2) * size] AS b
  FROM (SELECT k, w, size, unnest(range(0, greatest(CAST(ceil(len(w) / size) AS BIGINT) - 1, 1))) AS no FROM w, (SELECT DISTINCT size FROM template))
), met AS (
  SELECT k, size, no, id, label, above, len(list_intersect(words, b)) / len(words) AS share
  FROM block JOIN template USING (size) WHERE len(list_intersect(words, b)) >= ceil({THRESHOLD} * len(words) - 1e-9) AND list_has_all(b, marks)
), own AS (
  SELECT * FROM met WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.k = met.k AND o.size = met.size AND o.no = met.no AND list_contains(met.above, o.id))
), found AS (
  SELECT k, list(DISTINCT label) AS found, max(share) AS containment FROM own GROUP BY k
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END :: DOUBLE AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN found USING (k)
"""


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLE_SQL = {"op7_license_scan": _oracle()}
