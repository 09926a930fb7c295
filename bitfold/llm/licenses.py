"""License scan by patience alignment.

Text and license template are aligned on words that occur exactly once in both: the longest
increasing run of their positions anchors the alignment, and the gaps between anchors are aligned
the same way in turn.  Coverage is the share of the template's words that found their place.

A notice that names its license has phrases that must stand in the text word for word: the name, the version, the
conditions.  They are in brackets in the templates.  Every other word may be missing or misspelt as long as the
coverage is large enough, but no notice becomes another license for want of the word that tells them apart.
Notices that do not name their license are told by coverage alone.

Texts are judged one by one in Arrow batches, nothing is shuffled.  Templates with phrases are tried around each
place of the least common word of these.  Of the others each has rare words, one more than the least coverage allows to
be missing, so a text that covers it holds at least one of them.  Around every such place, a window that holds
enough of the template's words goes through the alignment.  Windows are as wide as the template to both sides,
so a notice that occurs at distant places is found although its words are not unique in the whole text, and
the work on a very long text grows with its rare words.

Defined results: a null text, or one no template covers enough, has no license, coverage 0 and
no span.  Of equal coverage the longer template, then the first place wins.  Repeated rows get
equal results; other columns stay, and existing columns with the names of the results are
replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: license names and the public texts that announce them
TEMPLATES = {
    "Apache-1.1": "Licensed under the [Apache License, Version 1.1].",
    "Apache-2.0": "Licensed under the [Apache License, Version 2.0].",
    "Apache-2.0 header": (
        'Licensed under the [Apache License, Version 2.0] (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "BSD name": "Released under the [BSD License].",
    "CC-BY-4.0 name": "Licensed under [CC BY 4.0].",
    "CC-BY-SA-4.0 name": "Licensed under [CC BY-SA 4.0].",
    "CC-BY-NC-4.0": "Licensed under [CC BY-NC 4.0].",
    "CC-BY-3.0": "This work is licensed under a [Creative Commons Attribution 3.0] International License.",
    "CC-BY-4.0": "This work is licensed under a [Creative Commons Attribution 4.0] International License.",
    "GPL-2.0": "This work is licensed under the [GNU General Public License, version 2].",
    "GPL-3.0": "This work is licensed under the [GNU General Public License, version 3].",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU "
        "General Public License] as published by the Free Software Foundation"
    ),
    "MIT": "Released under the [MIT License].",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction"
    ),
}
# fixed values: words of the templates that stand in texts of any kind
COMMON = frozenset("a and any are as at be by can following for free in is it may not of or work the this that to under use with you your".split())
# fixed values: words of license names that many licenses have
NAMED_OFTEN = frozenset("2 3 1.1 2.0 3.0 4.0 attribution general license public sa nc version".split())
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
RESULTS = ("license", "coverage", "start_word", "end_word", "n_licenses")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs`` (sorted by the first) that increases in the second, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Matched positions (template, text), increasing in both.

    In a gap next to an anchor, words that go on alike are matched first.
    """
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(template), 0, len(text), False, False)]
    while gaps:
        a, b, c, d, after, before = gaps.pop()
        while after and a < b and c < d and template[a] == text[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while before and a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        once, there = Counter(template[a:b]), Counter(text[c:d])
        place = {w: c + k for k, w in enumerate(text[c:d]) if there[w] == 1}
        shared = [(a + k, place[w]) for k, w in enumerate(template[a:b]) if once[w] == 1 and w in place]
        anchors = increasing(shared)
        if not anchors:
            continue
        matched += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        last = len(edges) - 2
        gaps += [
            (p + 1, q, r + 1, s, after or k > 0, before or k < last) for k, ((p, r), (q, s)) in enumerate(zip(edges, edges[1:]))
        ]
    return sorted(matched)


def most_missing(template: list[str], least: float) -> int:
    """How many words of the template may be missing in a text that covers ``least`` of it."""
    n = len(template)
    return max(k for k in range(n + 1) if k == 0 or (n - k) / n >= least)


def rare_words(template: list[str], least: float) -> frozenset[str]:
    """Words that stand at more places of the template than may be missing: the longest, common ones last."""
    counts, out, places = Counter(template), set(), 0
    for word in sorted(counts, key=lambda w: (w in COMMON, -len(w), w)):
        if places > most_missing(template, least):
            break
        out.add(word)
        places += counts[word]
    return frozenset(out)


@dataclass(frozen=True)
class Template:
    words: list[str]
    phrases: list[tuple[int, int]]  # first and last (exclusive) place of the words that must stand together
    rare: frozenset[str]
    distinct: frozenset[str]
    fewest: int  # distinct words that a text covering it holds

    @property
    def named(self) -> frozenset[str]:
        return frozenset(w for a, b in self.phrases for w in self.words[a:b])

    def holds_phrases(self, matched: list[tuple[int, int]]) -> bool:
        place = dict(matched)
        return all(
            all(place.get(k, -1) == place.get(a, -2) + k - a for k in range(a, b)) for a, b in self.phrases
        )


def prepared(template: str, least: float) -> Template:
    words, phrases = [], []
    for k, part in enumerate(re.split(r"[\[\]]", template)):
        found = words_of(part)
        if k % 2:
            phrases.append((len(words), len(words) + len(found)))
        words += found
    distinct = frozenset(words)
    rare = rare_words(words, least)
    if phrases:
        named = [w for a, b in phrases for w in words[a:b]]
        rare = frozenset([min(named, key=lambda w: (w in COMMON, w in NAMED_OFTEN, -len(w), w))])
    return Template(words, phrases, rare, distinct, len(distinct) - most_missing(words, least))


def windows(text: list[str], template: Template) -> Iterator[tuple[int, int]]:
    """A stretch of text for each rare word: the template's size to both sides, if it holds enough of its words."""
    size = len(template.words)
    for at in (k for k, w in enumerate(text) if w in template.rare):
        start, end = max(0, at - size), min(len(text), at + size + 1)
        if len(template.distinct.intersection(text[start:end])) >= template.fewest:
            yield start, end


def best_match(text: str | None, templates: dict[str, Template], least: float) -> tuple[str | None, float, int | None, int | None, int]:
    """License, coverage, first and last matched word (end exclusive), and how many templates fit."""
    found = []
    words = words_of(text or "")
    present = frozenset(words)
    for name, template in templates.items():
        if template.rare.isdisjoint(present) or not template.named <= present or len(template.distinct & present) < template.fewest:
            continue
        top = None
        size = len(template.words)
        for start, end in windows(words, template):
            matched = align(template.words, words[start:end])
            share = len(matched) / size
            if matched and share >= least and (top is None or share > top[0]) and template.holds_phrases(matched):
                top = (share, start + matched[0][1], start + matched[-1][1] + 1)
        if top:
            found.append((top[0], size, name, top[1], top[2]))
    if not found:
        return None, 0.0, None, None, 0
    share, _, name, start, end = max(found, key=lambda f: (f[0], f[1], f[2]))
    return name, share, start, end, len(found)


def scanner(templates: dict[str, str], least: float):
    cut = {name: prepared(t, least) for name, t in templates.items()}
    kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]

    @F.arrow_udf("struct<license: string, coverage: double, start_word: int, end_word: int, n_licenses: int>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [best_match(t.as_py(), cut, least) for t in texts]
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(RESULTS))

    return scan


def worth_reading(text: Column, templates: dict[str, str], least: float) -> Column:
    """False only for texts that no template can fit: they lack a word of its phrases, or all its rare words."""
    lower = F.lower(text)
    held = lambda w: F.contains(lower, F.lit(w))
    fits = []
    for template in (prepared(t, least) for t in templates.values()):
        words, join = (sorted(template.named), and_) if template.phrases else (sorted(template.rare), or_)
        fits.append(reduce(join, map(held, words)))
    return reduce(or_, fits)


def scan(documents: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """``documents`` with ``RESULTS``; ``least`` is the smallest coverage that counts."""
    kept = [c for c in documents.columns if c not in RESULTS]
    text_column = F.col(f"`{text}`")
    # texts that cannot fit are not sent to Python at all
    hint = F.when(worth_reading(text_column, templates, least), text_column)
    # the other columns travel in a struct, so none of their names can meet a working name
    read = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("others"), hint.alias("hint"))
    judged = read.select("others", scanner(templates, least)(F.col("hint")).alias("found"))
    return judged.select(*[F.col(f"others.`{c}`") for c in kept], "found.*")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(documents.select("doc_id", "text")).drop("text")
