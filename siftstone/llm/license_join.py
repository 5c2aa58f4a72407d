"""License scan: exact set-similarity join of text blocks against license notices.

A block is a window of a text's words, across line ends, of one and a half times the template's words;
it is joined to a template when it holds at least the threshold of the template's distinct words
(containment). The join is exact: tokens are ordered by their frequency over all lines of all
documents (rarest first, ties by the token); a template of n tokens needs overlap
a = ceil(threshold * n), so a matching block must hold one of the template's first n - a + 1 tokens
(prefix filter), have a tokens of the templates' vocabulary at all (length filter), and at each shared
token have enough tokens left on both sides to still reach a (positional filter). The filters judge the
stretches of text within the longest window's reach of a prefix token, which hold all blocks that can
match; in those that pass, the windows slide word by word and are verified by their full overlap. Windows are
blocks without regard to lines or paragraphs, so wrapped, quoted and commented texts match (the leaders of comments are
no words). Of
overlapping windows the best is reported, cut to the shortest span with these words. A window must
also hold the words by which a template differs from other licenses' notices (their names). The
templates are a short list in the program, so their index goes to every task.

Beside it every place is found where a base phrase's words stand consecutively, across
line ends too.

Edge cases: a null or empty text has no words, no labels and score 0; repeated ids or texts are scored
row by row; texts of any length are scanned whole; kept columns may have any name but
those of the result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import licenses
from .common import WORD_BYTES, as_bytes, extended

# Short license notices by label.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Notices and whole texts.
ALL_TEMPLATES = [*TEMPLATES, *licenses.TEXTS]
# Names that a block must hold if its template does: other licenses have the remaining words.
NAMES = frozenset("mit apache gnu general public cc nc noncommercial sharealike creative commons mozilla".encode().split())
# Words of a block per word of the template.
WINDOW = 1.5
# Base phrases by label.
PHRASES: list[tuple[str, str]] = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class TemplateIndex:
    """Prefix index over templates whose tokens are in global frequency order."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(words(t.encode()))) for label, t in templates]
        vocabulary = sorted(set().union(*(s for _, s in sets)), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in sets]
        self.tokens = [sorted(self.rank[w] for w in s) for _, s in sets]
        self.names = [{self.rank[w] for w in NAMES.intersection(s)} for _, s in sets]
        self.width = [math.ceil(WINDOW * len(words(t.encode()))) for _, t in templates]
        self.reach = max(self.width, default=0)
        self.need = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in self.tokens]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.tokens):
            for i in range(len(t) - self.need[k] + 1):
                self.prefix.setdefault(t[i], []).append((k, i))
        self.prefix_words = {w for w, r in self.rank.items() if r in self.prefix}
        self.least = min(self.need, default=0)

    def match(self, block: list[bytes]) -> list[tuple[int, float]]:
        """Templates that the block contains, with the containment."""
        if self.prefix_words.isdisjoint(block):
            return []
        get = self.rank.get
        ranks = sorted({r for w in block if (r := get(w)) is not None})
        if len(ranks) < self.least:
            return []
        seen: dict[int, int] = {}
        for j, r in enumerate(ranks):
            for k, i in self.prefix.get(r, ()):
                so_far = seen.get(k, 0)
                if so_far < 0:
                    continue
                left = 1 + min(len(self.tokens[k]) - i - 1, len(ranks) - j - 1)
                seen[k] = so_far + 1 if len(ranks) >= self.need[k] and so_far + left >= self.need[k] else -1
        have = set(ranks)
        found = []
        for k, n in seen.items():
            if n > 0 and (both := len(have.intersection(self.tokens[k]))) >= self.need[k]:
                found.append((k, both / len(self.tokens[k])))
        return found

    def spans(self, text: list[bytes]) -> list[tuple[int, int, int, float]]:
        """Template, first and end word, and containment of the best of overlapping windows that hold a template."""
        if self.prefix_words.isdisjoint(text):
            return []
        stretches: list[list[int]] = []
        for i, w in enumerate(text):
            if w in self.prefix_words:
                if stretches and i - self.reach < stretches[-1][1]:
                    stretches[-1][1] = i + self.reach
                else:
                    stretches.append([max(0, i - self.reach + 1), i + self.reach])
        found = []
        for start, end in stretches:
            block = text[start:end]
            for k, _ in self.match(block):
                found += [(k, start + a, start + b, c) for a, b, c in self.windows(block, k)]
        return found

    def windows(self, block: list[bytes], k: int) -> list[tuple[int, int, float]]:
        """First and end word and containment of the best windows of a block for one template."""
        own = set(self.tokens[k])
        get = self.rank.get
        at = [(i, r) for i, w in enumerate(block) if (r := get(w)) in own]
        count: dict[int, int] = {}
        best: list[tuple[int, int, int]] = []
        left = 0
        for i, r in at:
            count[r] = count.get(r, 0) + 1
            # A word that left a window leaves for good; one that occurs again later isn't needed at the left.
            while i - at[left][0] >= self.width[k] or count[at[left][1]] > 1:
                old = at[left][1]
                count[old] -= 1
                if not count[old]:
                    del count[old]
                left += 1
            if len(count) >= self.need[k] and count.keys() >= self.names[k]:
                new = (at[left][0], i + 1, len(count))
                if not best or new[0] >= best[-1][1]:
                    best.append(new)
                elif (new[2], new[0] - new[1]) > (best[-1][2], best[-1][0] - best[-1][1]):
                    best[-1] = new
        return [(a, b, n / len(own)) for a, b, n in best]


def token_frequency(docs: DataFrame, templates: list[tuple[str, str]], text_col: str) -> dict[bytes, int]:
    """In how many lines of all documents each template token occurs."""
    vocabulary = sorted({w for _, t in templates for w in words(t.encode())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(vocabulary)
        count = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                for line in text.translate(BLOCKS).split(b"\n"):
                    for w in known.intersection(line.split()):
                        count[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()))], ["w", "n"])

    counted = docs.select(text_col).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in counted.collect()}  # the templates' words


# As WORD_BYTES, with line ends kept.
BLOCKS = bytes(10 if b == 10 else x for b, x in enumerate(WORD_BYTES))

# block is the line in which a span begins.
SPAN = "array<struct<label:string,block:int,first_word:bigint,end_word:bigint,containment:double>>"


def scan(
    docs: DataFrame,
    threshold: float = 0.8,
    templates: list[tuple[str, str]] = ALL_TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the matching spans."""
    frequency = token_frequency(docs, templates, text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = extended(
        docs,
        ["doc_id"],
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        f"spans {SPAN}",
    )
    span_type = pa.list_(
        pa.struct(
            [("label", pa.string()), ("block", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, frequency, threshold)
        base = [(p.encode().split(), label) for p, label in phrases]
        last = {p[-1] for p, _ in base}
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in as_bytes(batch.column(1)):
                lines = [x.split() for x in text.translate(BLOCKS).split(b"\n")]
                starts = list(accumulate(map(len, lines), initial=0))
                spans = []
                flat = [w for x in lines for w in x]
                for k, a, b, c in index.spans(flat):
                    line = bisect_right(starts, a) - 1
                    spans.append({"label": index.labels[k], "block": line, "first_word": a, "end_word": b, "containment": c})
                places: list[int] = []
                base_labels: set[str] = set()
                if any(w in text.lower() for w in last):
                    for p, label in base:
                        n = len(p)
                        at = [i for i, w in enumerate(flat) if w == p[0] and flat[i : i + n] == p]
                        places += at
                        if at:
                            base_labels.add(label)
                labels = base_labels | {s["label"] for s in spans}
                score = max((s["containment"] for s in spans), default=0.0)
                row = (
                    starts[-1], len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base_labels)), ",".join(sorted(labels)), max(score, 1.0 if places else 0.0), spans,
                )
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], schema.names
            )

    return docs.mapInArrow(run, schema)


