"""Licence scans through a positional index of rare words, in DataFrame operations only.

The templates' words have postings: in which template, at which place. One pass counts in how
many files each licence word occurs. A file's licence words are then looked up by their
rarity: of the mandatory words of a template, the rarest one's places in the file, each
less its place in the template, are where the template may begin; the next rarest one's
must agree. At what is left of these beginnings the mandatory phrases are compared word by
word, and the share of the template's words found in their places, weighed by rarity, is
its score there.

A template that stands in a file has all its mandatory words there, so looking up the
rarest of them misses none; a file without it is left after that one look.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, once A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The least share of a template, weighed by rarity, that must stand in its places.
LEAST_SHARE = 0.5
#: Places that scores are rounded to before they are compared.
PLACES = 6


@dataclass(frozen=True)
class Template:
    """A licence's words, and the phrases in them that must be there; by default all of it."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def mandatory(self) -> list[tuple[int, list[str]]]:
        """(place, words) of each mandatory phrase."""
        found = []
        for phrase in self.phrases or (self.text,):
            key, words = phrase.split(), self.words
            place = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
            if not key or place is None:
                raise ValueError(f"the template of {self.label} doesn't hold {phrase!r}")
            found.append((place, key))
        return found

    def mandatory_words(self) -> set[str]:
        return {w for _, key in self.mandatory() for w in key}


#: The phrases asked for, and sentences of public licences and their usual notices.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("you may not use this file except in compliance with the license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software you can redistribute it and or modify it", "gnu general public license")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty in no event will the authors be held liable",)),
    Template("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced", ("no part of this publication may be reproduced",)),
)


def _array(values: Sequence) -> Column:
    """A constant array of words or numbers, as one expression, so that plans stay small."""
    return F.split(F.lit(" ".join(map(str, values))), " ")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """For each word of the templates ln((rows + 1) / (rows that hold it + 1)) + 1, counted over all texts.

    One row for each of the templates' words reaches the driver, whatever the table's size.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(vocabulary)))
    # The null word stands for the row itself.
    counts = docs.select(F.explode(F.array_append(held, F.lit(None).cast("string"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r["word"]: r["n"] for r in counts}
    return {w: math.log((n.get(None, 0) + 1) / (n.get(w, 0) + 1)) + 1 for w in vocabulary}


def anchors(template: Template, weight: dict[str, float]) -> list[str]:
    """The two rarest of the mandatory words, in order of rarity (ties: by the word); one if there is but one."""
    return sorted(template.mandatory_words(), key=lambda w: (-weight[w], w))[:2]


def _beginnings(template: Template, anchor: str) -> Column:
    """Where the template may begin by the file's places of one of its words, from 0."""
    hits = F.filter("hits", lambda h: h["word"] == anchor)
    # A word may stand in the template several times; any of its mandatory places serves as posting.
    posting = [p + j for p, key in template.mandatory() for j, w in enumerate(key) if w == anchor]
    moved = lambda p: F.transform(hits, lambda h: h["at"] - p)
    return F.array_distinct(F.flatten(F.array(*map(moved, posting))))


def _stands(template: Template, start: Column) -> Column:
    """Whether every mandatory phrase is in its place, for a beginning."""
    right = F.lit(True)
    for place, key in template.mandatory():
        spelled = F.slice("words", F.greatest(start + place, F.lit(0)) + 1, len(key)) == _array(key)
        right &= (start + place >= 0) & spelled
    return right


def _share(template: Template, weight: dict[str, float], start: Column) -> Column:
    """The share of the template's words, by weight, that stand in their places."""
    there, parts = _array(template.words), _array([weight[w] for w in template.words]).cast("array<double>")
    mine = F.slice("words", F.greatest(start, F.lit(0)) + 1, len(template.words))
    # What stands before 0 is missing; zip_with fills what the text lacks at its end with nulls.
    cut = F.greatest(-start, F.lit(0))
    right = F.zip_with(mine, F.slice(there, cut + 1, len(template.words)), lambda a, b: a == b)
    found = F.zip_with(right, F.slice(parts, cut + 1, len(template.words)), lambda ok, x: F.when(ok, x).otherwise(0.0))
    return F.round(F.aggregate(found, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / sum(weight[w] for w in template.words), PLACES)


_MATCHES = "array<struct<label:string,base:boolean,start:int,score:double>>"


def _matches(template: Template, weight: dict[str, float]) -> Column:
    """Where the template stands, by the columns words and hits."""
    first, *second = [_beginnings(template, a) for a in anchors(template, weight)]
    starts = F.array_intersect(first, *second) if second else first
    right = F.filter(starts, lambda s: _stands(template, s))
    match = lambda s: F.struct(F.lit(template.label).alias("label"), F.lit(template.base).alias("base"), s.alias("start"), _share(template, weight, s).alias("score"))
    return F.transform(right, match).cast(_MATCHES)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and matches, an array of (label, base, start, score).

    * Words are counted from 0 over the whole text; a null text counts as empty.
    * matches: where a template begins whose mandatory phrases are all in place, with the share
      of it found there (1 for a base phrase, which is mandatory as a whole). A template whose
      first words are cut off may begin before 0.
    * n_base, first_word, last_word: how many matches are of base phrases, their least and
      largest beginning (null if none).
    * base_labels: labels of base matches; labels: those and the labels of matches with a share
      of LEAST_SHARE or more; each distinct, sorted, joined by commas, '' if none.
    * score: the largest share of a match, 0 without one.

    Each row stands for itself: repeated rows repeat, ties and null ids need no care, no rows
    give none. Nothing but counts of the templates' words is shuffled. A text takes memory
    for its words in one row.
    """
    weight = rarity(docs, templates, text_col)
    wanted = sorted({a for t in templates for a in anchors(t, weight)})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    at = F.transform("words", lambda w, i: F.when(w.isin(wanted), F.struct(i.alias("at"), w.alias("word"))))
    # A generator of one row: else what reads the words would each split the text again.
    rows = rows.select("doc_id", F.inline(F.array(F.struct("words", F.filter(at, lambda h: h.isNotNull()).alias("hits")))))
    found = F.flatten(F.array(*[_matches(t, weight) for t in templates]))
    matches = F.when(F.size("hits") > 0, found).otherwise(F.array().cast(_MATCHES))
    rows = rows.select("doc_id", F.inline(F.array(F.struct(F.size("words").cast("long").alias("n_words"), matches.alias("matches")))))
    base = F.transform(F.filter("matches", lambda m: m["base"]), lambda m: m["start"])
    joined = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("matches", keep), lambda m: m["label"]))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        joined(lambda m: m["base"]).alias("base_labels"),
        joined(lambda m: m["base"] | (m["score"] >= LEAST_SHARE)).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
        "matches",
    )
