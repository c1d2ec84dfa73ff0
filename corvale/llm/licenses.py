"""Licence scan: a trained paragraph classifier with template confirmation.

A paragraph is a line of a text, or a run of words over any number of lines: notices are often
wrapped, within comments, or part of a longer line. A run is a stretch of the whole text, at
most ``SPREAD`` times as long as a template, that holds at least ``CONFIRM`` of the template's
word pairs; line breaks and words of marks only (comment signs) do not part a pair. Words and
pairs of neighbouring words are hashed into sparse counts, scaled by the root of the
paragraph's length, and a multinomial logistic regression gives a probability for each licence
family and for the class of all else. The
regression is trained in numpy on disturbed copies of the templates (words dropped,
re-cased, other words around) against ordinary paragraphs: generated ones, notices of no
known family, and at most ``PARAGRAPHS`` paragraphs, by smallest hash of their words, out of
at most ``SAMPLE`` documents of the table, by smallest hash of doc_id; lines that a template
resembles or a run touches are left out, and longer lines count in stretches of
``STRETCH`` words. The least probability of a family is calibrated on unseen paragraphs of the
other class, so that at most ``UNKNOWN_RATE`` of them pass; what does not pass is unknown.

A prediction stands only if the paragraph confirms it: it holds at least ``CONFIRM`` of the word
pairs of one of the family's templates; it holds the words of that template that name the
licence; it holds no word that names another licence only and, after "version" or "v", no number
but the family's; and no template of another family is held to a larger share (of equal ones
the longer template stands). Of runs that overlap the one with the largest share stands; a
line counts where no run of its family touches it.

Edge cases: null, empty and blank texts have one line and no licence. Texts are taken
whole. Repeated rows are scanned each, null doc_ids too. Tables without rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.llm.common import binary_column, each_batch, offsets_of, table

SAMPLE = 400
#: Paragraphs of those documents that are trained on at most, and words of a stretch of a longer line.
PARAGRAPHS = 20_000
STRETCH = 60
BUCKETS = 1 << 15
UNKNOWN_RATE = 0.001
CONFIRM = 0.6
#: Length of a run in lengths of its template: room for comment signs and for other words between.
SPREAD = 2

#: Notices by which texts name their licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "afl-3.0": ("Licensed under the Academic Free License, Version 3.0.",),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "all-rights-reserved": ("All rights reserved.",),
    "apache-1.1": ("Licensed under the Apache License, Version 1.1.", "The Apache Software License, Version 1.1."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "epl": (
        "Licensed under the Eclipse Public License, Version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ),
    "gfdl": (
        "This work is licensed under the GNU Free Documentation License, version 1.3.",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
}
#: Words that name a family. A template that has some of them asks for each of those.
NAMES: dict[str, tuple[str, ...]] = {
    "afl-3.0": ("academic",),
    "agpl": ("affero",),
    "apache-1.1": ("apache",),
    "apache-2.0": ("apache",),
    "bsd": ("bsd",),
    "bsl-1.0": ("boost",),
    "cc-by": ("cc", "attribution", "by"),
    "cc-by-nc": ("attribution-noncommercial", "by-nc"),
    "cc-by-nc-sa": ("attribution-noncommercial-sharealike", "by-nc-sa"),
    "cc-by-nd": ("attribution-noderivatives", "by-nd"),
    "cc-by-sa": ("attribution-sharealike", "by-sa"),
    "cc0": ("cc0",),
    "epl": ("eclipse",),
    "gfdl": ("documentation", "gnu"),
    "gpl": ("gnu", "general"),
    "isc": ("isc",),
    "lgpl": ("lesser",),
    "mit": ("mit",),
    "mpl-2.0": ("mozilla",),
    "unlicense": ("unencumbered",),
}
#: Names of further licences, which no family's notice has.
FURTHER_NAMES = ("artistic", "cddl", "cecill", "eupl", "microsoft", "netscape", "nokia", "python", "qpl", "sissl", "sleepycat", "w3c", "wtfpl", "zope")
#: The version numbers of families that have them; for the others any number does.
VERSIONS: dict[str, tuple[str, ...]] = {
    "afl-3.0": ("3.0", "3"),
    "apache-1.1": ("1.1",),
    "apache-2.0": ("2.0", "2"),
    "bsl-1.0": ("1.0", "1"),
    "cc0": ("1.0", "1"),
    "mpl-2.0": ("2.0", "2"),
}
#: Notices that name no family above.
UNKNOWN_NOTICES = (
    "Licensed under the Artistic License, Version 2.0.",
    "Licensed under the Nokia Open Source License, Version 1.0.",
    "This work is licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the Common Development and Distribution License, Version 1.0.",
    "Released under the Python License.",
    "Released under the terms of our own licence.",
    "This software is licensed to you under the agreement that you signed.",
    "All orders reserved.",
)
#: Ordinary words and sentences near the subject, so that single words do not decide.
ORDINARY = (
    "He lost his driving license on the way to the public library.",
    "The general was under the apache helicopter when the version arrived.",
    "All of the work is in the public domain of the city council.",
    "The author reserved all rooms at the hotel for the students of MIT.",
    "A new version of the source is subject to approval by the foundation.",
    "Permission was granted to use the copy room without a fee.",
    "The rights of the people are reserved for the next generation.",
    "Software and documentation files are stored in the common folder.",
    "She released the birds under the bridge and licensed the song.",
    "Creative people work in the commons building of the university.",
)
FAMILIES = (*TEMPLATES, "none")
_EDGES = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())


def words_of(paragraph: bytes) -> list[bytes]:
    """Lower-cased words without marks at their ends."""
    return [w.strip(_EDGES) for w in paragraph.lower().split()]


def _pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:])) if len(words) > 1 else {(w, b"") for w in words}


def similarity(paragraph: bytes, family: str) -> float:
    """The largest share of a template's word pairs that the paragraph holds."""
    own = _pairs(words_of(paragraph))
    return max(len(own & pairs) / len(pairs) for pairs in _TEMPLATE_PAIRS[family])


def confirmed(words: list[bytes], after: list[bytes], family: str) -> float:
    """The share of a template of the family that the words hold, or 0 where they do not confirm it; after: some words that follow."""
    words = [w for w in words if w]
    own, held = _pairs(words), set(words)
    best = (0.0, 0)
    for pairs, names in zip(_TEMPLATE_PAIRS[family], _ASKED[family]):
        if names <= held:
            best = max(best, (len(own & pairs) / len(pairs), len(pairs)))
    if best[0] < CONFIRM or held & _FOREIGN[family]:
        return 0.0
    line = [*words, *(w for w in after if w)]
    if family in VERSIONS and any(x in (b"version", b"v") and y.replace(b".", b"").isdigit() and y.decode() not in VERSIONS[family] for x, y in zip(line, line[1:])):
        return 0.0
    for other, templates in _TEMPLATE_PAIRS.items():
        if other != family and any(names <= held and (len(own & pairs) / len(pairs), len(pairs)) > best for pairs, names in zip(templates, _ASKED[other])):
            return 0.0
    return best[0]


_TEMPLATE_PAIRS = {family: [_pairs(words_of(t.encode())) for t in texts] for family, texts in TEMPLATES.items()}
_ASKED = {family: [{n.encode() for n in NAMES.get(family, ())} & set(words_of(t.encode())) for t in texts] for family, texts in TEMPLATES.items()}
_OWN_WORDS = {family: {w for t in texts for w in words_of(t.encode())} for family, texts in TEMPLATES.items()}
_FOREIGN = {family: {n.encode() for names in (*NAMES.values(), FURTHER_NAMES) for n in names if len(n) > 2} - _OWN_WORDS[family] for family in TEMPLATES}
_KNOWN = {w: i for i, w in enumerate(sorted({w for sets in _TEMPLATE_PAIRS.values() for pairs in sets for p in pairs for w in p}))}
_MARKS, _OTHER = -2, -1
#: (family number, sorted codes of the word pairs, longest run) of each template.
_TEMPLATE_CODES = [(k, np.sort([_KNOWN[x] * len(_KNOWN) + _KNOWN[y] for x, y in pairs]), SPREAD * len(words_of(text.encode()))) for k, family in enumerate(TEMPLATES) for text, pairs in zip(TEMPLATES[family], _TEMPLATE_PAIRS[family])]
_ALL_CODES = np.unique(np.concatenate([codes for _, codes, _ in _TEMPLATE_CODES]))


@dataclass
class Run:
    """Words first to last (both within) of a text that hold a share of a template's pairs."""

    family: int
    share: float
    first: int
    last: int
    lines: tuple[int, int]
    words: bytes
    after: bytes


def runs(texts: list[list[bytes]]) -> tuple[list[Run], np.ndarray]:
    """(all runs, lines with a pair of any template) of texts given as lines; lines are numbered over all texts."""
    split = [line.split() for lines in texts for line in lines]
    flat = list(chain.from_iterable(split))
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    normal = [(words_of(w) or [b""])[0] for w in number]
    known = np.array([_KNOWN.get(w, _OTHER) if w else _MARKS for w in normal], dtype=np.int64)
    ids = known[np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))] if flat else np.zeros(0, dtype=np.int64)
    raw = np.flatnonzero(ids != _MARKS)
    ids = ids[raw]
    line_of = np.repeat(np.arange(len(split)), [len(s) for s in split])
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[line_of] if len(line_of) else line_of
    line, text = line_of[raw], text_of[raw]
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (text[:-1] == text[1:]))
    codes = ids[at] * len(_KNOWN) + ids[at + 1]
    of_template = np.isin(codes, _ALL_CODES)
    at, codes = at[of_template], codes[of_template]
    out = []
    for family, own, longest in _TEMPLATE_CODES:
        hit = np.isin(codes, own)
        p, c = at[hit], codes[hit]
        least = max(1, math.ceil(CONFIRM * len(own) - 1e-9))
        if len(p) < least:
            continue
        begins = np.flatnonzero((p[least - 1 :] - p[: len(p) - least + 1] < longest) & (text[p[least - 1 :]] == text[p[: len(p) - least + 1]]))
        for k in begins.tolist():
            seen, last, j = set(), k, k
            while j < len(p) and p[j] - p[k] < longest and text[p[j]] == text[p[k]]:
                if c[j] not in seen:
                    seen.add(c[j])
                    last = j
                j += 1
            share = len(seen) / len(own)
            if share >= CONFIRM:
                first, end = int(p[k]), int(p[last]) + 1
                out.append(Run(family, share, first, end, (int(line[first]), int(line[end])), b" ".join(flat[i] for i in raw[first : end + 1]), b" ".join(flat[i] for i in raw[end + 1 : end + 3] if text_of[i] == text[first])))
    return out, np.unique(np.concatenate([line[at], line[at + 1]])) if len(at) else np.zeros(0, dtype=np.int64)


class Paragraphs:
    """Hashed words and word pairs of many paragraphs, in flat arrays."""

    def __init__(self, paragraphs: list[bytes]):
        split = [p.split() for p in paragraphs]
        flat = list(chain.from_iterable(split))
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        which = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        hashes = np.array([zlib.crc32((words_of(w) or [b""])[0]) for w in number], dtype=np.int64)
        self.full = np.flatnonzero(lengths)
        self.starts = offsets_of(lengths)[self.full]
        self.scale = 1 / np.sqrt(np.maximum(lengths[self.full], 1))
        self.count = len(lengths)
        self.single = (hashes % BUCKETS)[which] if len(which) else which
        after = np.append(self.single[1:], 0)
        self.pair = (self.single * 40503 + after * 30011 + 7) % BUCKETS + BUCKETS
        if len(self.full):
            self.pair[np.append(self.starts[1:], len(which)) - 1] = 2 * BUCKETS  # no pair at a paragraph's end

    def sums(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Linear scores of each paragraph; one without words has the bias only."""
        out = np.tile(bias, (self.count, 1)).astype(np.float64)
        if len(self.full):
            out[self.full] += np.add.reduceat(weights[self.single] + weights[self.pair], self.starts, axis=0) * self.scale[:, None]
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Classifier:
    weights: np.ndarray
    bias: np.ndarray
    least: float = 0.5

    def predict(self, paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(family number, or that of none; its probability) of each paragraph, before confirmation."""
        p = softmax(Paragraphs(paragraphs).sums(self.weights, self.bias))
        best = p.argmax(1)
        chance = p.max(1)
        none = len(FAMILIES) - 1
        return np.where((best != none) & (chance < self.least), none, best), chance

    def scan(self, text: bytes) -> list[tuple[int, str, float, float]]:
        """(line number, family, probability, similarity) of the confirmed licences of a text."""
        return self.scan_all([text.split(b"\n")])[0]

    def scan_all(self, texts: list[list[bytes]]) -> list[list[tuple[int, str, float, float]]]:
        """The confirmed licences of texts given as lines; a licence has the number of the line where it begins."""
        starts = offsets_of(np.array([len(t) for t in texts], dtype=np.int64))
        found, touched = runs(texts)
        out: list[tuple[int, str, float, float]] = []
        here: dict[int, list[int]] = {}
        best, chance = self.predict([r.words for r in found])
        taken: dict[int, list[Run]] = {}
        agreed = [n for n, r in enumerate(found) if best[n] == r.family]
        share = {n: confirmed(words_of(found[n].words), words_of(found[n].after), FAMILIES[found[n].family]) for n in agreed}
        for n in sorted((n for n in agreed if share[n]), key=lambda n: (-share[n], found[n].last - found[n].first, found[n].first)):
            run = found[n]
            blocks = range(run.first >> 7, (run.last >> 7) + 1)
            if any(x.first <= run.last and run.first <= x.last for b in blocks for x in taken.get(b, ())):
                continue
            for b in blocks:
                taken.setdefault(b, []).append(run)
            for i in range(run.lines[0], run.lines[1] + 1):
                here.setdefault(i, []).append(run.family)
            out.append((run.lines[0], FAMILIES[run.family], float(chance[n]), share[n]))
        flat = list(chain.from_iterable(texts))
        lines = touched.tolist()  # others share no pair with a template
        best, chance = self.predict([flat[i] for i in lines])
        for n in np.flatnonzero(best != len(FAMILIES) - 1).tolist():
            i, family = lines[n], int(best[n])
            if family in here.get(i, ()):
                continue
            alike = confirmed(words_of(flat[i]), [], FAMILIES[family])
            if alike:
                out.append((i, FAMILIES[family], float(chance[n]), alike))
        each: list[list[tuple[int, str, float, float]]] = [[] for _ in texts]
        for i, *rest in sorted(out):
            doc = int(np.searchsorted(starts, i, side="right")) - 1
            each[doc].append((i - int(starts[doc]), *rest))
        return each


def disturbed(text: str, rng: np.random.Generator, vocabulary: list[bytes]) -> bytes:
    """A copy of a notice as it may be met."""
    words = text.encode().split()
    if len(words) > 6:
        words = [w for w in words if rng.random() > 0.08]
    if rng.random() < 0.2:
        words = [w.upper() for w in words]
    if vocabulary and rng.random() < 0.3:
        around = [vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(1, 5))]
        words = around + words if rng.random() < 0.5 else words + around
    return b" ".join(words)


def fit(ordinary: list[bytes], rounds: int = 60, copies: int = 40, seed: int = 11) -> Classifier:
    """Trains on disturbed templates against ordinary paragraphs; a third is kept for the calibration."""
    rng = np.random.default_rng(seed)
    ordinary = [p for p in ordinary if p.strip() and max(similarity(p, f) for f in TEMPLATES) < 0.3]
    vocabulary = sorted({w for p in ordinary for w in p.split()}) or [b"word"]
    near = [w for t in chain.from_iterable(TEMPLATES.values()) for w in t.encode().split()]
    mixed = [b" ".join([*(near[i] for i in rng.integers(0, len(near), 2)), *(vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(3, 15)))]) for _ in range(400)]
    unknown = [t for notice in UNKNOWN_NOTICES for t in (notice.encode(), *(disturbed(notice, rng, vocabulary) for _ in range(copies)))]
    none = [*ordinary, *mixed, *(o.encode() for o in ORDINARY * 10), *unknown]
    texts, y = list(none), [len(FAMILIES) - 1] * len(none)
    for k, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            texts += [t.encode(), *(disturbed(t, rng, vocabulary) for _ in range(copies))]
            y += [k] * (copies + 1)
    labels = np.array(y)
    order = rng.permutation(len(labels))
    kept, used = order[: len(order) // 3], order[len(order) // 3 :]
    weights, bias = np.zeros((2 * BUCKETS + 1, len(FAMILIES)), dtype=np.float32), np.zeros(len(FAMILIES))
    rows = Paragraphs([texts[i] for i in used])
    target = np.eye(len(FAMILIES))[labels[used]]
    sizes = np.diff(np.append(rows.starts, len(rows.single)))
    owner = np.repeat(rows.full, sizes)
    share = np.repeat(rows.scale, sizes)[:, None]
    features = np.unique(np.concatenate([rows.single, rows.pair]))
    at_single, at_pair = np.searchsorted(features, rows.single), np.searchsorted(features, rows.pair)
    squares = np.full((len(features), len(FAMILIES)), 1e-8)
    for _ in range(rounds):
        error = (softmax(rows.sums(weights, bias)) - target) / len(used)
        grad = np.zeros_like(squares)
        spread = error[owner] * share
        np.add.at(grad, at_single, spread)
        np.add.at(grad, at_pair, spread)
        grad += 1e-6 * weights[features]
        grad[features == 2 * BUCKETS] = 0
        squares += grad**2
        weights[features] -= (0.5 * grad / np.sqrt(squares)).astype(np.float32)
        bias -= 2.0 * error.sum(0)
    p = softmax(Paragraphs([texts[i] for i in kept]).sums(weights, bias))
    wrong = p[labels[kept] == len(FAMILIES) - 1, :-1].max(1)
    return Classifier(weights, bias, float(np.quantile(wrong, 1 - UNKNOWN_RATE)))


def ordinary_paragraphs(rows: pa.Table) -> pa.Table:
    """(draw, paragraph) of the lines that no run touches, in stretches of at most STRETCH words."""
    split = [t.split(b"\n") for t in binary_column(rows, "text")]
    notices = {i for r in runs(split)[0] for i in range(r.lines[0], r.lines[1] + 1)}
    found = []
    for i, line in enumerate(chain.from_iterable(split)):
        if i not in notices:
            words = line.split()
            found += [b" ".join(words[at : at + STRETCH]) for at in range(0, len(words), STRETCH)]
    return pa.table({"draw": pa.array([zlib.crc32(p) for p in found], pa.int64()), "paragraph": pa.array(found, pa.binary())})


def train(docs: DataFrame, sample: int = SAMPLE, paragraphs: int = PARAGRAPHS) -> Classifier:
    """Fits on the templates and on at most so many paragraphs of at most sample documents."""
    order = ["draw", "doc_id"]
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("draw")).orderBy(*order).limit(sample)  # texts follow for these few only
    some = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids.select("doc_id")), "doc_id")
    found = each_batch(some.select("text"), ordinary_paragraphs, "draw long, paragraph binary", 4 << 20).distinct().orderBy("draw", "paragraph").limit(paragraphs)
    return fit(found.select("draw", "paragraph").toArrow().sort_by([("draw", "ascending"), ("paragraph", "ascending")])["paragraph"].to_pylist())


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """One row per row of docs: doc_id, n_paragraphs, n_licensed, families, probability, spans.

    n_paragraphs: lines; families: distinct, sorted, joined by commas; probability: the largest; spans: line where it begins:family, joined by commas."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows: pa.Table) -> pa.Table:
        split = [t.split(b"\n") for t in binary_column(rows, "text")]
        found = shipped.value.scan_all(split)
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "n_paragraphs": pa.array([len(s) for s in split], pa.int64()),
                "n_licensed": pa.array([len(f) for f in found], pa.int64()),
                "families": pa.array([",".join(sorted({x for _, x, *_ in f})) for f in found], pa.string()),
                "probability": pa.array([max((c for _, _, c, _ in f), default=0.0) for f in found], pa.float64()),
                "spans": pa.array([",".join(f"{i}:{x}" for i, x, *_ in f) for f in found], pa.string()),
            }
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return each_batch(rows, work, "doc_id long, n_paragraphs long, n_licensed long, families string, probability double, spans string", 4 << 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
