"""License scans with a positional rare-token index, in DataFrame functions only.

First pass: the document frequency of every word that any template holds, counted over all rows; the
result has one number for each template word. Second pass, a narrow projection without a shuffle: the
rarest words that a file shares with a template are looked up, each place in the file minus each place in
the template is an offset, and where at least two offsets agree within a slack the template may begin.
There the mandatory phrases must stand word by word, and enough of the template's weight must be present.
A template is looked at only if the file holds every word of its phrases, which loses nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(text.translate(str.maketrans(UPPER, LOWER))))


@dataclass(frozen=True)
class Phrase:
    """A phrase whose every occurrence counts, and the label it gives."""

    text: str
    label: str


@dataclass(frozen=True)
class Template:
    """A licence notice; each of ``key`` must stand in the place where the notice is found."""

    name: str
    label: str
    text: str
    key: tuple[str, ...]

    @property
    def words(self) -> tuple[str, ...]:
        return words_of(self.text)

    @property
    def slack(self) -> int:
        """Words by which places may be shifted: holders' names and small edits."""
        return max(3, len(self.words) // 8)


# Phrases of the contract, and public licence notices.
PHRASES = (
    Phrase("mit license", "mit"),
    Phrase("apache license", "apache"),
    Phrase("general public license", "gpl"),
)
TEMPLATES = (
    Template("mit-notice", "mit", "Released under the MIT License.", ("mit license",)),
    Template(
        "mit-text",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template(
        "isc-text",
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("with or without fee", "permission notice appear in all copies"),
    ),
    Template("apache-notice", "apache", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template(
        "apache-header",
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template(
        "gpl-notice",
        "gpl",
        "This work is licensed under the GNU General Public License, version 3.",
        ("gnu general public license",),
    ),
    Template(
        "gpl-header",
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    Template(
        "lgpl-header",
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation",
        ("redistribute it and or modify it", "gnu lesser general public license"),
    ),
    Template(
        "agpl-header",
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation",
        ("redistribute it and or modify it", "gnu affero general public license"),
    ),
    Template(
        "bsd-text",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "mpl-header",
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        ("mozilla public license",),
    ),
    Template(
        "unlicense-text",
        "unlicense",
        "This is free and unencumbered software released into the public domain.",
        ("released into the public domain",),
    ),
    Template("cc-by-notice", "cc-by", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-sa-notice", "cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    Template("cc-by-nc-notice", "cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("cc-by-nd-notice", "cc-by-nd", "Licensed under CC BY-ND 4.0.", ("cc by nd",)),
    Template("cc0-notice", "cc0", "Licensed under CC0 1.0 Universal.", ("cc0 1 0",)),
)
#: Words of a template, the rarest that the file holds, that are looked up.
SEEDS = 4
#: Percent of a template's weight that must stand where it is found.
MIN_PERCENT = 60
#: Score of a file that holds a phrase but no template.
PHRASE_SCORE = 0.5


def vocabulary(templates: tuple[Template, ...], phrases: tuple[Phrase, ...]) -> list[str]:
    found = {w for t in templates for text in (t.text, *t.key) for w in words_of(text)}
    return sorted(found | {w for p in phrases for w in words_of(p.text)})


def _strings(words) -> Column:
    """The words as one folded constant: a plan node for each list, not for each word."""
    return F.split(F.lit(" ".join(words)), " ")


def _integers(numbers) -> Column:
    return _strings(map(str, numbers)).cast("array<int>")


def _known(words: Column, found: list[str]) -> Column:
    """The distinct words of a file that stand in ``found``."""
    return F.array_distinct(F.filter(words, lambda w: w.isin(*found)))


def file_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, words`` of every row; only A-Z are lower-cased."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    split = docs.select(F.col(id_col).alias("doc_id"), F.split(lowered, SEPARATOR).alias("cut"))
    # A text's first and last piece may be empty.
    first = F.when(F.get("cut", F.lit(0)) == "", 2).otherwise(1)
    last = F.when(F.get("cut", F.size("cut") - 1) == "", F.size("cut") - 1).otherwise(F.size("cut"))
    return split.select("doc_id", F.slice("cut", first, F.greatest(last - first + 1, F.lit(0))).alias("words"))


def word_weights(files: DataFrame, words: list[str]) -> dict[str, int]:
    """Integer inverse document frequency of each word: thousandths of ln((1 + N) / (1 + df)), plus 1."""
    n = F.count("*").alias("n")
    # Partial counts leave a task as one row for each of the templates' words; "" counts the files.
    held = F.array_append(_known(F.col("words"), words), F.lit(""))
    counted = files.select(F.explode(held).alias("word")).groupBy("word").agg(n).collect()
    df = {r["word"]: r["n"] for r in counted}
    total = df.pop("", 0)
    return {w: math.floor(1000 * math.log((1 + total) / (1 + df.get(w, 0)))) + 1 for w in words}


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Where the phrase's words stand consecutively, from 0."""

    def here(i: Column) -> Column:
        match = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            match = match & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return match

    starts = F.sequence(F.lit(0), F.size(words) - len(phrase))
    return F.when(F.size(words) >= len(phrase), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, whatever ``f`` does with it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _share(template: Template, weights: dict[str, int], seeds: int) -> Column:
    """Largest weight of the template's words where it is found with its phrases; 0 where nowhere."""
    body = template.words
    ranked = sorted(set(body), key=lambda w: (-weights[w], w))
    of_ranked = _integers(weights[w] for w in ranked)
    words = F.col("words")
    rare = F.slice(F.array_intersect(_strings(ranked), F.col("known")), 1, seeds)

    def places_in_template(word: Column) -> Column:
        return F.filter(F.transform(_strings(body), lambda w, j: F.when(w == word, j)), lambda j: j.isNotNull())

    def offsets(chosen: Column) -> Column:
        hit = F.filter(
            F.transform(words, lambda w, i: F.when(F.array_contains(chosen, w), i)), lambda i: i.isNotNull()
        )
        apart = F.transform(hit, lambda i: F.transform(places_in_template(F.get(words, i)), lambda j: i - j))
        return F.array_sort(F.flatten(apart))

    def begins(sorted_offsets: Column) -> Column:
        agree = F.filter(
            sorted_offsets,
            lambda o, i: F.coalesce(F.get(sorted_offsets, i + 1) - o <= template.slack, F.lit(False)),
        )
        return F.array_distinct(agree)

    def found(at: Column) -> Column:
        start = F.greatest(at, F.lit(0))
        end = at + len(body) + template.slack

        def weight(region: Column) -> Column:
            joined = F.concat(F.lit(" "), F.array_join(region, " "), F.lit(" "))
            keyed = F.lit(True)
            for k in template.key:
                keyed = keyed & F.contains(joined, F.lit(f" {' '.join(words_of(k))} "))
            here = F.transform(_strings(ranked), lambda w, j: F.when(F.array_contains(region, w), F.get(of_ranked, j)).otherwise(0))
            here = F.aggregate(here, F.lit(0), lambda a, x: a + x)
            return F.when(keyed, here).otherwise(0)

        region = F.slice(words, start + 1, F.greatest(end - start, F.lit(0)))
        return _bound(region, weight)

    alignments = _bound(_bound(rare, offsets), begins)
    best = F.coalesce(F.array_max(F.transform(alignments, found)), F.lit(0))
    needed = sorted({w for k in template.key for w in words_of(k)})
    return F.when(F.size(F.array_intersect(F.col("known"), _strings(needed))) == len(needed), best).otherwise(0)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: tuple[Phrase, ...] = PHRASES,
    seeds: int = SEEDS,
    min_percent: int = MIN_PERCENT,
) -> DataFrame:
    """Licence phrases and notices of every row.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, notices, score``:
    places of the phrases (count, smallest and largest start), labels, the templates found, and the largest
    share of a template's weight (``PHRASE_SCORE`` where only a phrase stands, 0 where nothing does).

    A null or empty text has no words, no labels (empty strings) and null places. Repeated rows and null
    ids are judged row by row, whole texts of any length are searched, other columns are ignored; an empty
    table gives no row. Of equally rare words the alphabetically first are looked up. The list of
    templates is a parameter and part of the plan: a few thousand words are its bound.
    """
    files = file_words(docs, id_col, text_col)
    words = vocabulary(templates, phrases)
    weights = word_weights(files, words)
    known = files.select("doc_id", "words", _known(F.col("words"), words).alias("known"))

    def places(p: Phrase) -> Column:
        parts = words_of(p.text)
        there = F.size(F.array_intersect(F.col("known"), _strings(sorted(set(parts))))) == len(set(parts))
        return F.when(there, _places(F.col("words"), parts)).otherwise(F.array().cast("array<int>"))

    # Every phrase and template needs its rarest key word: a file without any of them has nothing to look up.
    keys = [words_of(p.text) for p in phrases] + [tuple(w for k in t.key for w in words_of(k)) for t in templates]
    telling = sorted({max(k, key=lambda w: (weights[w], w)) for k in keys})
    looked_up = F.struct(
        *[places(p).alias(f"phrase_{i}") for i, p in enumerate(phrases)],
        *[_share(t, weights, seeds).alias(f"share_{i}") for i, t in enumerate(templates)],
    )
    hit = F.arrays_overlap("known", _strings(telling))
    shares = known.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(hit, looked_up).alias("hit")).select("doc_id", "n_words", "hit.*")
    total = [sum(weights[w] for w in set(t.words)) for t in templates]
    good = [F.col(f"share_{i}") * 100 >= min_percent * n for i, n in enumerate(total)]
    base = F.array_compact(F.array(*[F.when(F.cardinality(f"phrase_{i}") > 0, F.lit(p.label)) for i, p in enumerate(phrases)]))
    notices = F.array_compact(F.array(*[F.when(g, F.lit(t.name)) for g, t in zip(good, templates, strict=True)]))
    more = F.array_compact(F.array(*[F.when(g, F.lit(t.label)) for g, t in zip(good, templates, strict=True)]))
    share = [F.when(g, F.col(f"share_{i}").cast("double") / n) for i, (g, n) in enumerate(zip(good, total, strict=True))]
    nowhere = F.array().cast("array<int>")
    all_places = F.flatten(F.array(nowhere, *[F.coalesce(f"phrase_{i}", nowhere) for i in range(len(phrases))]))
    held = shares.select("doc_id", "n_words", all_places.alias("at"), base.alias("base"), notices.alias("notices"), more.alias("more"), F.array_max(F.array(F.lit(None).cast("double"), *share)).alias("share"))
    return held.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        "notices",
        F.coalesce("share", F.when(F.size("base") > 0, F.lit(PHRASE_SCORE)), F.lit(0.0)).alias("score"),
    )
