"""Licence scan: a positional index over the rarest words of licence notices."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.storage import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and the notices (label, words of the notice, its mandatory key phrase).
BASE = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
NOTICES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "under the terms of the eclipse public license", "eclipse public license"),
    ("isc", "released under the isc license", "isc license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license version 2 0"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "including commercial applications"),
]
COVERAGE = 0.8  # of a notice's IDF, for its label


POSTINGS = "map<string, array<struct<label:string, base:boolean, at:int, words:array<struct<word:string, idf:double>>, whole:double, key:array<string>, key_at:int>>>"
ENTRY = "array<struct<label:string, base:boolean, start:int, share:double>>"


class Templates:
    """Base phrases and notices as a positional index.

    ``vocabulary``: their words.  ``keys``: the sets of words of which a text
    needs one whole.  ``postings``: for each word that is the rarest of a
    template's key words, the templates it enters, each with the word's place
    (``at``), all words with their IDF, and the key phrase with its place.
    """

    def __init__(self, base: dict[str, str], notices: list[tuple[str, str, str]]):
        self.all = [(label, phrase.split(), phrase.split(), True) for label, phrase in base.items()]
        self.all += [(label, notice.split(), key.split(), False) for label, notice, key in notices]
        self.vocabulary = sorted({w for _, words, _, _ in self.all for w in words})
        self.keys = sorted({tuple(sorted(set(key), key=lambda w: (-len(w), w))) for _, _, key, _ in self.all})

    def postings(self, idf: dict[str, float]) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for label, words, key, is_base in self.all:
            rarest = max(key, key=lambda w: (idf[w], w))
            key_at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
            out.setdefault(rarest, []).append({
                "label": label, "base": is_base, "at": key_at + key.index(rarest), "words": [{"word": w, "idf": idf[w]} for w in words],
                "whole": sum(idf[w] for w in words), "key": key, "key_at": key_at,
            })
        return out


def _stored(value: object, schema: str) -> Column:
    """A constant of any size as one expression."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _entries(index: Column, entered: list[str]) -> Column:
    """The templates that stand in the words ``w`` with their whole key phrase: label, base, start and share of the IDF at its place."""
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda s: s["word"].isin(entered))

    def at_place(s: Column) -> Column:
        def keyed(t: Column) -> Column:
            first = s["i"] - t["at"] + t["key_at"]
            return (first >= 0) & (F.slice("w", F.greatest(first, F.lit(0)) + 1, F.size(t["key"])) == t["key"])

        def share(t: Column) -> Column:
            hits = F.transform(t["words"], lambda x, k: F.when((s["i"] - t["at"] + k >= 0) & (F.get("w", s["i"] - t["at"] + k) == x["word"]), x["idf"]).otherwise(F.lit(0.0)))
            return F.aggregate(hits, F.lit(0.0), lambda a, b: a + b) / t["whole"]

        entry = lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"), (s["i"] - t["at"]).alias("start"), F.when(t["base"], F.lit(0.0)).otherwise(share(t)).alias("share"))
        return F.transform(F.filter(index[s["word"]], keyed), entry)

    return F.flatten(F.transform(places, at_place))


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: list[tuple[str, str, str]] = NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """Licence phrases and notices of every whole text.

    The index holds, for each template (base phrase or notice), its words with
    their positions and IDF, and is entered by the rarest of its key words: the
    one of highest IDF over all documents (``Templates``).  A text that has all
    key words of some template is walked once; at each of its words that enters
    templates these are looked up, the place fixes where each of them would
    begin, and the other postings are laid against the words there.
    A base phrase needs all its words there.  A notice needs its mandatory key
    phrase there and, by IDF, at least ``coverage`` of its words, so small edits
    outside the key phrase do not hide it.  The plan does not grow with the
    number of templates: they are one constant.

    Returns, per row of ``docs``: the id, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (smallest and largest start of
    these, from 0, else null), ``base_labels`` and ``labels`` (distinct, sorted,
    comma-joined, else empty) and ``score``: the largest coverage of a template
    found, rounded to 6 digits, 0 where none is.

    Null text: as an empty one, with no words.  Null ids and repeated rows: rows
    of their own.  Empty table: no rows.  Other columns are ignored.  The text is
    read once; nothing is shuffled but the document counts of the templates'
    words, and what goes to the driver are these counts, a row for each word of
    the templates at most.
    """
    templates, scratch = Templates(base, notices), Scratch(docs.sparkSession)
    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    vocabulary = _stored(templates.vocabulary, "array<string>")
    possible = F.exists(_stored(templates.keys, "array<array<string>>"), lambda key: F.forall(key, lambda x: F.array_contains(F.col("licence"), x)))
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("w")).select("id", "text", F.size("w").alias("n"), F.array_intersect("w", vocabulary).alias("licence"))
    # lower() may change other letters than A-Z, never their number of words; for the few texts that are looked up it is done exactly
    exact = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    found = scratch.save(found.select("id", F.col("n").cast("long").alias("n_words"), "licence", F.when(possible, exact).alias("w")))
    total = found.count()
    seen = {r["word"]: r["n"] for r in found.select(F.explode("licence").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    index = templates.postings({w: math.log((total + 1.0) / (seen.get(w, 0) + 1.0)) + 1e-6 for w in templates.vocabulary})

    # an array of one, so that the entries are found once and not for each column that reads them
    entered = found.select("id", "n_words", F.explode(F.array(F.coalesce(_entries(_stored(index, POSTINGS), list(index)), F.array().cast(ENTRY)))).alias("found"))
    starts = F.transform(F.filter("found", lambda t: t["base"]), lambda t: t["start"])
    labels = lambda test: F.array_join(F.sort_array(F.array_distinct(F.transform(F.filter("found", test), lambda t: t["label"]))), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda t: t["share"])), F.lit(0.0))
    plain = F.when(F.size(starts) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return entered.select(
        F.col("id").alias(id_col), "n_words",
        F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(lambda t: t["base"]).alias("base_labels"), labels(lambda t: t["base"] | (t["share"] >= coverage)).alias("labels"),
        F.round(F.least(F.lit(1.0), F.greatest(best, plain)), 6).alias("score"),
    )
