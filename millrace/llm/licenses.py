"""License scan: base phrases, and an exact set-similarity join with templates.

Text blocks are lines, sets of words; templates are short word sets. A template
is found where a block holds at least ``threshold`` of its words. Template
words are ordered by how many documents of the whole corpus hold them, rarest
first, and blocks keep, in that order, those of their words that a template has
(others can't add to what is shared). A block and a template become candidates
by a common word in the template's prefix, its first |T| - need + 1 words
(prefix filter), if the block has ``need`` words (length filter) and, with the
common word at place i of the template and j of the block, min(|T| - i, |B| - j)
words can still agree (positional filter). Candidates are verified word by word.
Prefixes are a map from a word to its places in templates, a constant bounded
by the list of templates, so the plan does not grow with their number, the join
happens in the row, and nothing of the corpus is shuffled but word counts.

A template that no line holds is looked for where lines are wrapped: if the
same filters let it through for the whole text as one block, in all windows of
|T| / threshold words that start at one of its words.

A null text is empty. A very long text is one row's arrays in memory. Repeated
rows are judged alike; an empty table gives an empty result. Other columns,
whatever their names, come back unchanged. The base phrases' labels are never
dropped; a base phrase counts as a template contained wholly (score 1).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let, named
from .urlfilter import LOWER, UPPER

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
PLACES = "array<struct<t:int,i:int,size:int,need:int>>"

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Template sentences and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this text is available under the cc by 4 0 license", "cc-by"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose is hereby granted", "isc"),
    ("all rights reserved no part may be reproduced without permission", "proprietary"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def strings(items) -> Column:
    return F.array(*(F.lit(x) for x in items))


def document_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """For each template word, the number of documents that hold it; as many rows as template words."""
    vocabulary = sorted({w for text, _ in templates for w in text.split()})
    held = F.array_intersect(strings(vocabulary), words_of(F.col("text")))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in counts}


def ordered(templates, counts: dict[str, int], threshold: float) -> list[tuple[str, list[str], int]]:
    """(label, words rarest first, words needed) of every template."""
    out = []
    for text, label in templates:
        words = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        out.append((label, words, math.ceil(threshold * len(words) - 1e-9)))
    return out


def base_places(words: Column) -> Column:
    """Sorted (start, label) of every place of a base phrase; ``words`` must be a stored column."""
    def at(i: Column, phrase: str) -> Column:
        return reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(phrase.split())))

    def places(phrase: str, label: str) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(at(i, phrase), F.lit(False)))
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("i"), F.lit(label).alias("label")))

    return F.sort_array(F.concat(*(places(p, label) for p, label in PHRASES.items())))


@dataclass(frozen=True)
class Tables:
    """The templates as constant columns."""

    vocabulary: Column  # all words, in the order of the join
    places: Column  # a prefix word's (template, place, size, need)
    words: Column  # of templates
    labels: Column
    needs: Column
    prefixes: Column  # all prefix words


def tables(plan: list[tuple[str, list[str], int]], counts: dict[str, int]) -> Tables:
    at: dict[str, list[Column]] = {}
    for t, (_, words, need) in enumerate(plan):
        for i, w in enumerate(words[: len(words) - need + 1]):
            at.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(len(words)).alias("size"), F.lit(need).alias("need")))
    order = sorted(counts, key=lambda w: (counts[w], w))
    return Tables(
        strings(order), F.create_map(*(c for w, x in at.items() for c in (F.lit(w), F.array(*x)))),
        F.array(*(strings(words) for _, words, _ in plan)), strings([label for label, _, _ in plan]), F.array(*(F.lit(need) for _, _, need in plan)), strings(sorted(at)),
    )


def candidates(block: Column, known: Tables) -> Column:
    """Templates that may be held by ``block``, words in the order of the join."""
    def of_word(word: Column, j: Column) -> Column:
        fits = lambda p: (F.size(block) >= p["need"]) & (F.least(p["size"] - p["i"], F.size(block) - j) >= p["need"])
        return F.transform(F.filter(F.coalesce(F.try_element_at(known.places, word), F.array().cast(PLACES)), fits), lambda p: p["t"])

    return F.array_distinct(F.flatten(F.transform(block, of_word)))


def hit(t: Column, shared: Column, known: Tables) -> Column:
    return F.struct(F.get(known.labels, t).alias("label"), F.when(shared >= F.get(known.needs, t), shared / F.size(F.get(known.words, t)).cast("double")).otherwise(0.0).alias("share"))


def template_hits(text: Column, known: Tables) -> Column:
    """(label, share) of every template in every block that meets its threshold."""
    def verified(block: Column) -> Column:
        return F.transform(candidates(block, known), lambda t: hit(t, F.size(F.array_intersect(F.get(known.words, t), block)), known))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), words_of)
    near = F.filter(lines, lambda b: F.arrays_overlap(b, known.prefixes))
    blocks = F.transform(near, lambda b: F.array_intersect(known.vocabulary, b))
    return F.filter(F.flatten(F.transform(blocks, verified)), lambda h: h["share"] > 0)


def wrapped_hits(words: Column, hits: Column, known: Tables, threshold: float) -> Column:
    """(label, share) of every template that is in no line, but in a window of the text's words wherever its lines end."""
    def best(t: Column) -> Column:
        own = F.get(known.words, t)
        size = F.ceil(F.size(own) / F.lit(threshold) - F.lit(1e-9)).cast("int")
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(own, F.get(words, i)))
        return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(own, F.slice(words, i + 1, size)))))

    left = lambda block: F.filter(candidates(block, known), lambda t: (F.size(F.array_intersect(F.get(known.words, t), block)) >= F.get(known.needs, t)) & ~F.exists(hits, lambda h: h["label"] == F.get(known.labels, t)))
    found = let(F.array_intersect(known.vocabulary, words), left)
    return F.filter(F.transform(found, lambda t: let(best(t), lambda n: hit(t, n, known))), lambda h: h["share"] > 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a last column, a struct of places, labels and score.

    It is called ``_license``, with more underscores while ``docs`` has a column that starts like it.
    """
    counts = document_counts(docs, templates)
    known = tables(ordered(templates, counts, threshold), counts)
    mine, result = free(docs.columns, "_l_"), free(docs.columns, "_license")
    words, places, hits = (F.col(f"{mine}{x}") for x in ("words", "places", "hits"))
    starts = strings(sorted({p.split()[0] for p in PHRASES}))
    none_base, none_hit = F.array().cast("array<struct<i:bigint,label:string>>"), F.array().cast("array<struct<label:string,share:double>>")
    rows = docs.withColumn(f"{mine}words", words_of(F.col("text")))
    rows = rows.withColumn(f"{mine}places", F.when(F.arrays_overlap(words, starts), base_places(words)).otherwise(none_base))
    rows = rows.withColumn(f"{mine}near", F.arrays_overlap(words, known.prefixes))
    near = F.col(f"{mine}near")
    rows = rows.withColumn(f"{mine}hits", F.when(near, template_hits(F.col("text"), known)).otherwise(none_hit))
    rows = rows.withColumn(f"{mine}hits", F.when(near, F.concat(hits, wrapped_hits(words, hits, known, threshold))).otherwise(none_hit))
    base = F.array_distinct(F.transform(places, lambda b: b["label"]))
    found = F.array_distinct(F.concat(base, F.transform(hits, lambda h: h["label"])))
    done = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.get(places, F.lit(0))["i"].alias("first_word"),
        F.get(places, F.size(places) - 1)["i"].alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(found), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(hits, lambda h: h["share"])), F.lit(0.0))).alias("score"),
    )
    return rows.select(*named(docs.columns), done.alias(result))
