"""Licence scan with a positional rare-token index, in DataFrame functions only.

The corpus tells how rare the words of the licence phrases are.  Each template is posted, with the
word's position in it, under the words of highest IDF of its mandatory phrase.  A file's words of
that index are looked up; templates that all their posted words lead to stay, the starts which the
places of these words imply are intersected, and the whole phrase is verified at each start that is
left.  The templates are data (literal arrays and a map), so hundreds of them make no larger
expression.  Everything happens within the row: no word is exploded, joined or shuffled, so neither
long texts nor frequent words gather anywhere.  Only the document frequencies (one number for each
phrase word) are aggregated over the corpus.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character but digits and (lower-cased) letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    """A notice, the label it stands for, and the phrase that must stand in it word for word."""

    label: str
    notice: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def phrase_words(self) -> list[str]:
        return self.phrase.split()

    @property
    def offset(self) -> int:
        """Where the phrase starts in the notice."""
        w, p = self.words, self.phrase_words
        return next(i for i in range(len(w)) if w[i : i + len(p)] == p)


# The phrases that the scan must find, then notices of public licences.
TEMPLATES = [
    Template("mit", "mit license", "mit license", base=True),
    Template("apache", "apache license", "apache license", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms", "redistribute it and or modify it under the terms"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "in source and binary forms"),
    Template("cc-by", "this work is licensed under a creative commons attribution", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("proprietary", "all rights reserved", "all rights reserved"),
    Template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file"),
    Template("proprietary", "proprietary and confidential", "proprietary and confidential"),
    Template("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain"),
    Template("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "this software for any purpose with or without fee"),
    Template("zlib", "without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable"),
    Template("boost", "distributed under the boost software license", "boost software license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("public-domain", "dedicated to the public domain", "dedicated to the public domain"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("gfdl", "gnu free documentation license", "free documentation license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("eupl", "european union public licence", "european union public licence"),
    Template("cddl", "common development and distribution license", "common development and distribution license"),
    Template("artistic", "the artistic license", "artistic license"),
    Template("psf", "python software foundation license", "python software foundation license"),
    Template("openssl", "openssl license", "openssl license"),
    Template("ms-pl", "microsoft public license", "microsoft public license"),
    Template("ofl", "sil open font license", "open font license"),
    Template("odbl", "open database license", "open database license"),
    Template("ncsa", "university of illinois ncsa open source license", "ncsa open source license"),
    Template("afl", "academic free license", "academic free license"),
    Template("osl", "licensed under the open software license", "open software license"),
    Template("bsl", "business source license", "business source license"),
    Template("sspl", "server side public license", "server side public license"),
    Template("elastic", "elastic license", "elastic license"),
    Template("commons-clause", "commons clause license condition", "commons clause"),
    Template("cc0", "creative commons zero", "creative commons zero"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    Template("cc-by", "licensed under cc by 4 0", "under cc by 4 0"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    Template("cc-by-nd", "creative commons attribution noderivatives", "creative commons attribution noderivatives"),
]
# Identifiers as they stand in the one-line tag of source files.
TAG = "spdx license identifier"
IDENTIFIERS = [
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "BUSL-1.1", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0",
    "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "SSPL-1.0", "Unlicense", "UPL-1.0", "Zlib",
]


def tagged(identifier: str) -> Template:
    """The template of an identifier's tag; its label is the identifier without a version."""
    phrase = " ".join([TAG, *re.findall("[a-z0-9]+", identifier.lower())])
    return Template(re.sub(r"-[0-9].*$", "", identifier.lower()), phrase, phrase)


TEMPLATES += map(tagged, IDENTIFIERS)


def literal(values: object, kind: str) -> Column:
    """A constant of the given type."""
    text = json.dumps(values).replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"from_json('{text}', '{kind}')")


def split_words(text: str) -> Column:
    """Column: lower-cased words of the whole text (none for null), an empty string before or after them where it has separators there."""
    return F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), SEPARATORS)


def words(text: str) -> Column:
    """Column: :func:`split_words` without the empty strings."""

    def inner(parts: Column) -> Column:
        first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, first + 1, F.size(parts) - first - last)

    # The lambda names the split, which is costly, so that it is computed once.
    return F.get(F.transform(F.array(split_words(text)), inner), F.lit(0))


def document_frequencies(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES) -> dict[str, int]:
    """In how many documents each phrase word occurs, over all documents."""
    vocabulary = sorted({w for t in templates for w in t.phrase_words})
    found = docs.select(F.array_distinct(F.filter(split_words(text), lambda w: w.isin(vocabulary))).alias("w"))
    counts = dict.fromkeys(vocabulary, 0)
    # One row at most for each word of the vocabulary.
    return counts | {r.word: r["count"] for r in found.select(F.explode("w").alias("word")).groupBy("word").count().collect()}


def anchors(template: Template, frequency: dict[str, int]) -> list[tuple[int, str]]:
    """(position in the notice, word) of the phrase's words of highest IDF."""
    places = {w: template.offset + i for i, w in reversed(list(enumerate(template.phrase_words)))}
    return [(places[w], w) for w in sorted(places, key=lambda w: (frequency.get(w, 0), places[w]))[:ANCHORS]]


def postings_of(templates: list[Template], frequency: dict[str, int]) -> dict[str, list[dict]]:
    """Word to its postings: template number, position in the notice, and whether it is the template's only posted word."""
    postings: dict[str, list[dict]] = {}
    for number, t in enumerate(templates):
        rare = anchors(t, frequency)
        for at, word in rare:
            postings.setdefault(word, []).append({"t": number, "p": at, "w": word, "only": len(rare) == 1})
    return postings


POSTING = "struct<t:int,p:int,w:string,only:boolean>"
MATCHES = "array<struct<template:int,start:bigint>>"
OWN_COLUMNS = {"n_words", "matches", "labels", "score", "file_words", "hits", "posted"}


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """``docs`` with what the scan finds.

    Appends ``n_words`` (long), ``matches`` (template number, first word) for every verified place,
    ``labels`` (distinct, sorted) and ``score`` (0 without a match, else a half plus half the best
    share of a notice's words that stand at their place around a match).

    Null and empty texts have no words, no matches and score 0; repeated rows are scanned each on
    its own; columns of ``docs`` with these names are replaced; an empty table gives no rows.
    """
    postings = postings_of(templates, document_frequencies(docs, text, templates))
    index, rare = literal(postings, f"map<string,array<{POSTING}>>"), sorted(postings)
    phrases = literal([t.phrase_words for t in templates], "array<array<string>>")
    offsets = literal([t.offset for t in templates], "array<int>")
    docs = docs.select([f"`{c}`" for c in docs.columns if c == text or c.lower() not in OWN_COLUMNS])
    out = docs.withColumn("file_words", words(text))

    # The file's words of the index and their places; most files have none.
    hit = F.transform("file_words", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i"))))
    met = F.arrays_overlap("file_words", literal(rare, "array<string>"))
    out = out.withColumn("hits", F.when(met, F.filter(hit, lambda h: h.isNotNull())))
    # What these words are posted with, by template: two postings side by side, or an only one, make a candidate.
    posted = F.sort_array(F.flatten(F.transform(F.array_distinct(F.col("hits.w")), lambda w: F.element_at(index, w))))
    out = out.withColumn("posted", posted)
    pairs = F.transform("posted", lambda x, i: F.struct(x.alias("a"), F.when(x.only, x).otherwise(F.get(F.col("posted"), i + 1)).alias("b")))
    candidates = F.filter(pairs, lambda c: c.a.t == c.b.t)

    def implied(posting: Column) -> Column:
        return F.transform(F.filter("hits", lambda h: h.w == posting.w), lambda h: h.i - posting.p)

    def verified(c: Column) -> Column:
        phrase, offset = F.get(phrases, c.a.t), F.get(offsets, c.a.t)
        both = F.array_intersect(implied(c.a), implied(c.b))
        kept = F.filter(both, lambda s: (s + offset >= 0) & (F.slice("file_words", F.greatest(s + offset, F.lit(0)) + 1, F.size(phrase)) == phrase))
        return F.transform(kept, lambda s: F.struct(c.a.t.alias("template"), s.cast("long").alias("start")))

    out = out.withColumn("matches", F.coalesce(F.flatten(F.transform(candidates, verified)), F.expr(f"cast(array() as {MATCHES})")))
    names = literal([t.label for t in templates], "array<string>")
    notices = literal([t.words for t in templates], "array<array<string>>")

    def share(m: Column) -> Column:
        notice = F.get(notices, m.template)
        same = F.filter(F.transform(notice, lambda w, i: F.get(F.col("file_words"), (m.start + i).cast("int")) == w), lambda x: x)
        return F.size(same) / F.size(notice)

    best = F.array_max(F.transform("matches", share))
    return out.select(
        *(f"`{c}`" for c in docs.columns),
        F.size("file_words").cast("long").alias("n_words"),
        "matches",
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.get(names, m.template)))).alias("labels"),
        F.when(F.size("matches") > 0, 0.5 + 0.5 * best).otherwise(F.lit(0.0)).alias("score"),
    )
