"""License scans: phrases, and an exact set-similarity join of blocks of words with notice templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices in wide use: the label of the method, the text, and words without which it is not that notice.
TEMPLATES = [
    ("agpl-header", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0.", "apache"),
    (
        "apache-header",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "apache",
    ),
    (
        "apache-terms",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "",
    ),
    (
        "bsd-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "",
    ),
    (
        "bsd-clauses",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "",
    ),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons"),
    ("cc-by-notice", "Licensed under CC BY 4.0.", "cc by"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-nd-notice", "Licensed under CC BY-ND 4.0.", "cc by nd"),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("cc-by-nc-nd-notice", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd"),
    ("cc-by-nc-sa-notice", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa"),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ""),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3.", "gnu"),
    (
        "gpl-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "gnu",
    ),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "",
    ),
    ("lgpl-header", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser"),
    ("mit-notice", "Released under the MIT License.", "mit"),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        "",
    ),
    (
        "mit-rights",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "",
    ),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
]
Template = tuple[str, str, str]

#: A-Z to a-z, and every ASCII byte that is not part of a word to a space. Other bytes are word parts.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, across its lines."""
    return (text or "").encode().translate(_TABLE).split()


def block_words(text: str) -> int:
    """How many consecutive words a block has that is held against a template: a quarter more than the template."""
    return ceil(1.25 * len(words_of(text)))


@dataclass
class _Wanted:
    """A template: its different words from rare to frequent, how many a block needs, which it must hold, and its words."""

    label: str
    order: dict[bytes, int]
    need: int
    must: frozenset[bytes]
    width: int


@dataclass
class TemplateIndex:
    """Templates by the words of their prefixes, at least one of which any block of enough containment holds."""

    templates: list[_Wanted]
    prefixes: dict[bytes, list[int]]

    @classmethod
    def build(cls, templates: list[Template], counts: dict[bytes, int], threshold: float) -> TemplateIndex:
        whole: list[_Wanted] = []
        prefixes: dict[bytes, list[int]] = {}
        for label, text, must in templates:
            ordered = sorted(set(words_of(text)), key=lambda w: (counts.get(w, 0), w))
            need = max(1, ceil(threshold * len(ordered) - 1e-9))
            for w in ordered[: len(ordered) - need + 1]:
                prefixes.setdefault(w, []).append(len(whole))
            order = {w: i for i, w in enumerate(ordered)}
            whole.append(_Wanted(label, order, need, frozenset(words_of(must)), block_words(text)))
        return cls(whole, prefixes)

    def matches(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """(label, best containment) of each template that some block of consecutive words holds to the threshold."""
        present = set(words)
        for t in sorted({t for w in self.prefixes.keys() & present for t in self.prefixes[w]}):
            wanted = self.templates[t]
            # Length: the text itself must hold enough of the template's words.
            if len(wanted.order.keys() & present) < wanted.need or not wanted.must <= present:
                continue
            best = _best_block(words, wanted)
            if best >= wanted.need:
                yield wanted.label, best / len(wanted.order)


def _best_block(words: list[bytes], wanted: _Wanted) -> int:
    """The most different template words in a block that holds those it must; 0 if no block may have enough."""
    order, width, most_prefix = wanted.order, wanted.width, len(wanted.order) - wanted.need
    hits = [(at, order[w]) for at, w in enumerate(words) if w in order]
    # Position: only blocks around a prefix word can have enough.
    near, last = [], -width
    anchors = [at for at, rank in hits if rank <= most_prefix]
    k = 0
    for at, rank in hits:
        while k < len(anchors) and anchors[k] < at:
            last = anchors[k]
            k += 1
        following = anchors[k] if k < len(anchors) else at + width
        if at - last < width or following - at < width:
            near.append((at, rank))
    must = [order[w] for w in wanted.must]
    counts, different, best, low = [0] * len(order), 0, 0, 0
    for at, rank in near:
        different += not counts[rank]
        counts[rank] += 1
        while at - near[low][0] >= width:
            counts[near[low][1]] -= 1
            different -= not counts[near[low][1]]
            low += 1
        if different > best and all(counts[m] for m in must):
            best = different
    return best


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand consecutively."""
    places = []
    for phrase, label in phrases.items():
        wanted = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(wanted[-1], at + 1)
            except ValueError:
                break
            start = at - len(wanted) + 1
            if start >= 0 and words[start : at + 1] == wanted:
                places.append((start, label))
    return places


def _counted(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(sorted(vocabulary), 0)
        for batch in batches:
            for text in batch.column(0):
                for w in vocabulary.intersection(words_of(text.as_py())):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()))], ["w", "n"])

    return run


def word_counts(docs: DataFrame, text_col: str, templates: list[Template]) -> dict[bytes, int]:
    """In how many texts each template word stands; as many rows as the templates have words."""
    vocabulary = frozenset(w for _, text, _ in templates for w in words_of(text))
    cells = docs.select(F.col(text_col).cast("string")).mapInArrow(_counted(vocabulary), "w binary, n bigint")
    return {bytes(r.w): r.n for r in cells.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[Template] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row, whole texts.

    Base: every place where a phrase's words stand consecutively in the text's words, across lines too. Method: a block
    is any run of consecutive words, across lines too, a quarter longer than the template; a template's label is added
    where some block of the text holds at least threshold of its different words, and those that it must. Template
    words are ordered by the number of texts that hold them, rare first; a text is a candidate only if it holds a word
    of the template's prefix and enough of its words, a block only if it lies around a prefix word; what remains is
    counted, so nothing is missed. score is 1 with a base phrase, else the best containment found, else 0.

    Null and empty texts have 0 words, no place, empty labels and score 0. Repeated rows and null ids are kept, each
    with its own result; an empty table gives no rows; other columns are not read. Work is linear in a text's words.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    index = TemplateIndex.build(templates, word_counts(docs, text_col, templates), threshold)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                places = phrase_places(words, phrases)
                base = {label for _, label in places}
                found: dict[str, float] = {}
                for label, share in index.matches(words):
                    found[label] = max(share, found.get(label, 0.0))
                rows.append(
                    {
                        "n_words": len(words),
                        "n_base": len(places),
                        "first_word": min((p for p, _ in places), default=None),
                        "last_word": max((p for p, _ in places), default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | found.keys())),
                        "score": 1.0 if base else max(found.values(), default=0.0),
                    }
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double",
    )


def scan_sql(threshold: float = 0.8) -> str:
    """The same result in SQL by plain comparison of every block that begins with a template word with the template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    templates = ", ".join(f"('{label}', '{text}', '{must}', {block_words(text)})" for label, text, must in TEMPLATES)

    def words(x: str) -> str:
        return f"regexp_extract_all(translate({x}, '{upper}', '{lower}'), '{word}')"

    places = []
    for phrase in PHRASES:
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        places.append(f"list_filter(range(len(w)), lambda i: {test})")
    union = " UNION ALL ".join(f"SELECT row, '{label}' AS label, unnest({p}) AS p FROM t"
                               for label, p in zip(PHRASES.values(), places, strict=True))
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w
           FROM documents),
places AS ({union}),
base AS (SELECT row, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word,
                list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY row),
templates AS (SELECT label, list_distinct({words("body")}) AS body, {words("must")} AS must, width
              FROM (VALUES {templates}) AS v(label, body, must, width)),
wholes AS (SELECT row, w, label, body, must, width FROM t, templates
           WHERE len(list_intersect(list_distinct(w), body)) >= {threshold} * len(body) - 1e-9),
blocks AS (SELECT row, label, body, must, w[i:i + width - 1] AS block FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM wholes)
           WHERE list_contains(body, w[i])),
shares AS (SELECT row, label, len(list_intersect(list_distinct(block), body)) / len(body) AS share FROM blocks
           WHERE list_has_all(block, must)),
method AS (SELECT row, list(DISTINCT label) AS labels, max(share) AS share FROM shares
           WHERE share >= {threshold} - 1e-9 GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ',')
           AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(method.share, 0.0) END::DOUBLE AS score
FROM t LEFT JOIN base USING (row) LEFT JOIN method USING (row)"""
