"""License scans by a positional index of rare license words. DataFrame expressions only.

Templates are short license sentences. Document frequencies of their words come from all documents. The
index holds (word, template, position) of the two rarest words (highest IDF) among each template's mandatory
key phrases. Such a word at place p that stands at position t of a template proposes the template to start
at p - t. The starts that both words propose are the intersection of their postings by relative position
(one hash intersection of numbers for the whole document); such a start is kept if every key phrase stands
where the template has it. Since the proposing words are part of key phrases, no start at which all of them
stand is missed, whatever else the document holds. Base phrases are templates that are one key phrase as a
whole.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. Documents that hold no word
on which a template depends are decided by one regular expression and never split into words. Nothing is
shuffled but the word counts (a row per index word and task). Null texts have no words. Each row is decided
for itself: repeated rows and rows with a shared or null doc_id have a result each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Label, template sentence, and the key phrases it must hold (parts of the sentence).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "www apache org licenses"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this program is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ["terms of the gnu general public license", "free software foundation"]),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights cc0 1 0", ["waived all copyright", "neighboring rights"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RAREST = 8  # rarest words of a template that its score counts
STARTS, LEAD = 1 << 32, 64  # a start s of template n is the number n * STARTS + LEAD + s; none is below -LEAD


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # (position in the template, words)
    base: bool


def templates() -> list[Template]:
    out = [Template(label, tuple(p.split()), ((0, tuple(p.split())),), True) for label, p in BASE.items()]
    for label, sentence, phrases in TEMPLATES:
        words = sentence.split()
        placed = []
        for phrase in phrases:
            own = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            placed.append((at, tuple(own)))
        out.append(Template(label, tuple(words), tuple(placed), False))
    return out


def _gate(made: list[Template]) -> str:
    """A regular expression that every document with a verified template matches: a word of the first
    key phrase of each template. Case-insensitive for ASCII."""
    needed: list[str] = []
    for t in made:
        options = [w for w in t.phrases[0][1] if len(w) > 2 or w == "cc"]
        if not set(options) & set(needed):
            needed.append(max(options, key=lambda w: (w in ("license", "cc"), len(w))))
    letter = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    return f"(?i)(?<!{letter})(?:{'|'.join(needed)})(?!{letter})"


def document_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def idf(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every index word over all ``docs``. The result has a row for each
    index word (a few hundred); the count combines before its shuffle."""
    made = templates()
    index = sorted({w for t in made for w in t.words})
    total = docs.count()
    held = F.array_intersect(F.array(*[F.lit(w) for w in index]), document_words(F.col("text")))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    counts = dict(rows)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in index}


def scan(docs: DataFrame, weights: dict[str, float] | None = None, rarest: int = RAREST) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, base_places (array of (template label, word)), and found
    (array of (label, start, score)): all verified templates."""
    made, weights = templates(), weights or idf(docs)
    names = [c for c in docs.columns if c not in ("n_words", "base_places", "found")]
    # word -> [(which of a template's two words, number that a place of the word turns into a start)]
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(made):
        ranked = sorted((at + i for at, own in t.phrases for i in range(len(own))), key=lambda i: (-weights[t.words[i]], -i))
        for which, i in enumerate((ranked * 2)[:2]):
            postings.setdefault(t.words[i], []).append((which, n * STARTS + LEAD - i))
    index = F.create_map(*[
        x for w, held in sorted(postings.items())
        for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).cast("long").alias("b")) for k, b in held]))
    ])

    gate = F.coalesce(F.col("text").rlike(_gate(made)), F.lit(False))
    words = F.when(gate, document_words(F.col("text")))
    # places of index words, with postings
    hits = F.filter(
        F.transform(F.col("__words"), lambda w, p: F.struct(p.alias("p"), F.try_element_at(index, w).alias("e"))),
        lambda h: h["e"].isNotNull(),
    )

    def proposed(which: int) -> Column:
        return F.flatten(F.transform("__hits", lambda h: F.transform(F.filter(h["e"], lambda a: a["k"] == which), lambda a: a["b"] + h["p"])))

    agreed = F.array_intersect(proposed(0), proposed(1))
    starts = F.transform(agreed, lambda c: F.struct((c.bitwiseAND(F.lit(~(STARTS - 1))) / STARTS).cast("int").alias("t"), (c.bitwiseAND(F.lit(STARTS - 1)) - LEAD).cast("int").alias("s")))

    def stands(s: Column, phrases: tuple[tuple[int, tuple[str, ...]], ...]) -> Column:
        ok = F.lit(True)
        for at, own in phrases:
            start = s + at
            ok = ok & (start >= 0) & (start + len(own) <= F.size("__words")) & (F.slice("__words", F.greatest(start, F.lit(0)) + 1, len(own)) == F.array(*[F.lit(w) for w in own]))
        return ok

    def verified(c: Column) -> Column:
        out = F.lit(False)
        for n, t in enumerate(made):
            out = F.when(c["t"] == n, stands(c["s"], t.phrases)).otherwise(out)
        return out

    def shown(c: Column) -> Column:
        """Share of the IDF of the template's rarest words that stands where the template has them."""
        out = F.lit(1.0)
        for n, t in enumerate(made):
            rare = sorted(set(t.words), key=lambda w: (-weights[w], w))[:rarest]
            places = [(i, w) for i, w in enumerate(t.words) if w in rare]
            got = sum((F.when(F.get("__words", c["s"] + i) == w, weights[w]).otherwise(0.0) for i, w in places), F.lit(0.0))
            out = F.when(c["t"] == n, F.least(F.lit(1.0), got / sum(weights[w] for _, w in places))).otherwise(out)
        return out

    labels = F.array(*[F.lit(t.label) for t in made])
    is_base = F.array(*[F.lit(t.base) for t in made])
    found = F.transform(
        F.filter("__starts", verified),
        lambda c: F.struct(
            F.element_at(labels, c["t"] + 1).alias("label"), c["s"].cast("long").alias("start"), F.element_at(is_base, c["t"] + 1).alias("base"), shown(c).alias("score"),
        ),
    )
    # Words are counted without being cut out: each becomes one character.
    n_words = F.when(F.col("text").rlike(WORD), F.length(F.regexp_replace("text", f"{OTHER}*+{WORD}+{OTHER}*+", "x"))).otherwise(F.lit(0))

    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        """A column that is computed once a row: the generator keeps it from being written into lambdas."""
        return df.select("*", F.explode_outer(F.array(value)).alias(name))

    out = docs.select(*names).withColumn("n_words", n_words.cast("long"))
    out = once(once(out, "__words", words), "__hits", hits)
    out = once(out, "__starts", starts)
    out = out.withColumn("found", F.coalesce(found, F.array().cast("array<struct<label:string,start:bigint,base:boolean,score:double>>")))
    return out.select(*names, "n_words", "found")


def summary(scanned: DataFrame) -> DataFrame:
    """One row per document of ``scan``: n_base places, their first and last word, labels and a score
    (1 for a base place; else the best template's share of the rarity it could show)."""
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["start"])

    def joined(rows: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda f: f["label"]))), ",")

    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0))).alias("score"),
    )
