"""License scans by an exact set-similarity join of text blocks with license templates.

A template is a set of words; a block meets it if it holds at least THRESHOLD of them. Words are ordered by the number
of documents of the whole corpus that hold them, rarest first. A block that meets a template of n words must share a =
ceil(THRESHOLD n) of them, hence one of the template's first n - a + 1 (prefix filter), hold a of the words of all templates
itself (length filter), and have enough words left after a shared one in both orders (positional filter). What passes is
compared in full.

Blocks are windows of words, whatever line ends they hold: for templates of up to SHORT_WORDS distinct words, of twice a
template's length at steps of its length, and for longer ones, of BLOCK words, or twice the longest template's length if that
is more, at steps of half that. So a template's words that stand together lie in a window. Short templates are also sought in
single lines, whatever their length. All templates that a block meets give labels, but one whose words are nearly those of
another (Jaccard similarity ALIKE) gives way to that where the block holds a larger part of the other.

Base phrases are found at all places of their words. Null texts are empty; an empty table gives no rows. Rows don't depend on each
other, so repeated rows and ids, ties and other columns play no part.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and license texts.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
]
#: Short notices of licenses that TEMPLATES know by a long text only.
NOTICES = [
    ("gpl-3", "under the gnu general public license version 3"),
    ("bsd", "under the bsd license"),
    ("mpl-2", "under the mozilla public license version 2"),
    ("isc", "under the isc license"),
]
THRESHOLD = Fraction(9, 10)
ALIKE = Fraction(8, 10)
SHORT_WORDS, BLOCK = 16, 200
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of words before A-Z are lower-cased, and what parts words.
ANY_CASE, APART = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """The runs of WORD in lower case. Splitting takes time linear in the text; extracting all matches copies it for each."""
    return F.array_remove(F.split(F.lower(text), APART), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """The number of rows of docs that hold each of these words; the driver gets one row a word."""
    found = docs.select(F.explode(F.array_intersect(_strings(words), _words(F.coalesce("text", F.lit(""))))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + NOTICES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of docs (doc_id, text)."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    count = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    sets = [(label, sorted(set(t.split()), key=order.index)) for label, t in templates]
    needed = [ceil(threshold * len(s)) for _, s in sets]
    prefixes = [s[: len(s) - a + 1] for (_, s), a in zip(sets, needed)]

    short = [k for k, (_, s) in enumerate(sets) if len(s) <= SHORT_WORDS]
    long = [k for k in range(len(sets)) if k not in short]
    of_length = {n: [k for k in short if len(templates[k][1].split()) == n] for n in sorted({len(templates[k][1].split()) for k in short})}

    none = F.array().cast("array<struct<k:int,label:string,part:double>>")
    near = [[j for j, (_, u) in enumerate(sets) if len(set(s) & set(u)) >= ALIKE * len(set(s) | set(u))] for _, s in sets]
    alike = F.array(*[F.array(*map(F.lit, js)) for js in near])

    def met(tokens: Column, chosen: list[int]) -> Column:
        """(k, label, part) of the chosen templates that a block with these words, in global order, meets."""
        tests = []
        for k in chosen:
            (label, s), a, prefix = sets[k], needed[k], prefixes[k]
            # The j-th word of the template at place p of the block: at most 1 + min(n - j, |block| - p) are shared.
            places = [(len(s) - j, F.array_position(tokens, F.lit(w))) for j, w in enumerate(prefix, 1)]
            close = F.lit(False)
            for left, p in places:
                close = close | ((p > 0) & (F.least(F.lit(left), F.size(tokens) - p) + 1 >= a))
            shared = F.size(F.array_intersect(tokens, _strings(s)))
            tests.append(F.when((F.size(tokens) >= a) & close & (shared >= a), F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), (shared / float(len(s))).alias("part"))))
        return F.filter(F.array(*tests), lambda t: t.isNotNull())

    def best(found: Column) -> Column:
        return F.filter(found, lambda t: ~F.exists(found, lambda o: F.array_contains(F.element_at(alike, t["k"] + 1), o["k"]) & (o["part"] > t["part"])))

    def labels(blocks: Column, chosen: list[int]) -> Column:
        if not chosen:
            return none
        some = F.filter(blocks, lambda b: F.arrays_overlap(b, _strings(sorted({w for k in chosen for w in prefixes[k]}))))
        ordered = F.transform(some, lambda b: F.array_intersect(_strings(order), b))
        return F.flatten(F.transform(F.transform(ordered, lambda t: met(t, chosen)), best))

    block = max(BLOCK, 2 * max((len(templates[k][1].split()) for k in long), default=0))

    def windows(length: int) -> Column:
        """Windows of this many words at steps of half that; the last one is shorter."""
        step = length // 2
        return F.transform(F.sequence(F.lit(1), F.greatest(size - step, F.lit(1)), F.lit(step)), lambda k: F.slice("words", k, length))

    candidates = sorted({w for p in prefixes for w in p})
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("words", _words(F.col("text")))
    lines = F.transform(F.split("text", "\n"), _words)
    size = F.size("words")
    found = F.when(F.arrays_overlap("words", _strings(candidates)), F.concat(labels(lines, short), *[labels(windows(2 * n), chosen) for n, chosen in of_length.items()], labels(windows(block), long))).otherwise(none)

    phrase = {p: rf"(?i)(?<!{ANY_CASE}){APART.join(p.split())}(?!{ANY_CASE})" for p in BASE}
    every = "(?i)(?<!{0})(?:{1})(?!{0})".format(ANY_CASE, "|".join(APART.join(p.split()) for p in BASE))
    maybe = F.arrays_overlap("words", _strings(sorted({p.split()[-1] for p in BASE if p.split()[-1] != "2"} | {"license"})))
    counts = F.when(maybe, F.regexp_count("text", F.lit(every))).otherwise(0)
    rows = rows.select("doc_id", "text", size.cast("long").alias("n_words"), found.alias("found"), counts.cast("long").alias("n_base"))
    has = F.col("n_base") > 0
    before = lambda pattern: F.size(_words(F.regexp_extract("text", pattern, 1))).cast("long")
    base = F.when(has, F.filter(F.array(*[F.when(F.regexp_like("text", F.lit(phrase[p])), F.lit(label)) for p, label in BASE.items()]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("base", base)
    return rows.select(
        "doc_id", "n_words", "n_base", F.when(has, before("(?s)^(.*?)" + every)).alias("first_word"), F.when(has, before("(?s)^(.*)" + every)).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.transform("found", lambda t: t["label"]))), ",").alias("labels"),
        F.when(has, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda t: t["part"])), F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """Brute force in SQL: every template against every block."""
    all_ = TEMPLATES + NOTICES
    sets = [sorted(set(t.split())) for _, t in all_]
    rows = ", ".join(f"({k}, '{label}', {len(sets[k]) <= SHORT_WORDS}, {len(t.split())}, [{', '.join(map(repr, sets[k]))}])" for k, (label, t) in enumerate(all_))
    alike = ", ".join(f"({i}, {j})" for i, s in enumerate(sets) for j, t in enumerate(sets) if i != j and len(set(s) & set(t)) >= ALIKE * len(set(s) | set(t))) or "(-1, -1)"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in BASE.items())
    windows = "list_transform(range(1, greatest(len(words) - step, 1) + 1, step), lambda i: words[i : i + 2 * step - 1])"
    return rf"""
    WITH t(k, label, short, length, words) AS (VALUES {rows}), alike(i, j) AS (VALUES {alike}), p(phrase, label) AS (VALUES {phrases}),
    d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
    w AS (SELECT doc_id, text, low, regexp_extract_all(low, '{WORD}') AS words FROM d),
    b AS (SELECT DISTINCT doc_id, true AS short, 0 AS step, unnest(list_transform(string_split(low, chr(10)), lambda x: regexp_extract_all(x, '{WORD}'))) AS words FROM w
          UNION ALL SELECT doc_id, short, step, unnest({windows}) FROM w, (SELECT DISTINCT short, CASE WHEN short THEN length ELSE {max(BLOCK, 2 * max(len(t.split()) for _, t in all_)) // 2} END AS step FROM t)),
    c AS (SELECT doc_id, b.words, b.short, b.step, k, label, len(list_intersect(list_distinct(b.words), t.words)) AS shared, len(t.words) AS n FROM b JOIN t ON b.short = t.short AND (step = 0 OR NOT t.short OR step = t.length)),
    m AS (SELECT *, shared / n AS part FROM c WHERE {THRESHOLD.denominator} * shared >= {THRESHOLD.numerator} * n),
    best AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o JOIN alike ON i = m.k AND j = o.k WHERE o.doc_id = m.doc_id AND o.words = m.words AND o.short = m.short AND o.step = m.step AND o.part > m.part)),
    x AS (SELECT doc_id, phrase, label, unnest(list_filter(range(1, len(words) + 1), lambda i: words[i : i + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' '))) - 1 AS place FROM w, p
          WHERE list_contains(words, string_split(phrase, ' ')[1])),
    xs AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM x GROUP BY doc_id),
    ms AS (SELECT doc_id, list(DISTINCT label) AS labels, max(part) AS part FROM best GROUP BY doc_id)
    SELECT w.doc_id, len(w.words) AS n_words, coalesce(xs.n, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(xs.labels), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(xs.labels, []), coalesce(ms.labels, [])))), ','), '') AS labels,
        CASE WHEN xs.n > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score
    FROM w LEFT JOIN xs USING (doc_id) LEFT JOIN ms USING (doc_id)
    """


ORACLE = _oracle()
