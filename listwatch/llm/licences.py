"""Licence scans with a trained paragraph classifier.

A multinomial logistic regression over word 1- to 3-grams tells licence families and "no licence"
apart.  It learns from worded notices, varied by seeded edits, and from a bounded sample of the
corpus's own paragraphs as the unknown class.  Temperature and the probability that counts as known
are calibrated on held-out variations and paragraphs.  A prediction stands only when the paragraph
shares enough word pairs with a notice of that family.

Paragraphs are lines.  Only n-grams of the notices have weights; a paragraph that shares too few word
pairs with every notice could not be confirmed, so it is unknown without being scored.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from listwatch.llm.common import mix, word_hashes

# Usual wordings of licence notices, by family.
NOTICES = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "This project is available under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction.",
            "SPDX-License-Identifier: MIT"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met.", "Released under the BSD License.", "Licensed under the 3-clause BSD license.",
            "SPDX-License-Identifier: BSD-3-Clause"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation.", "Licensed under the GNU GPL v3.",
            "SPDX-License-Identifier: GPL-3.0-or-later"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under CC BY 4.0.", "Text is available under CC BY 4.0."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Licensed under CC BY-SA 4.0.", "Text is available under CC BY-SA 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0.", "Text is available under CC BY-NC 4.0."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "This work is dedicated to the public domain under CC0 1.0.", "Released under CC0 1.0 Universal."),
    "reserved": ("All rights reserved.", "Copyright by the author. All rights reserved.",
                 "No part of this publication may be reproduced without prior written permission."),
}
FAMILIES = tuple(NOTICES)
SPLIT = re.compile(rb"[^a-z0-9.\-]+")


def notice_words(paragraph: str) -> list[bytes]:
    """Words of letters, digits, inner dots and hyphens, in lower case."""
    return [w for x in SPLIT.split(paragraph.encode().lower()) if (w := x.strip(b".-"))]


def longer(shorter: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams with one more word, from those of n words and of single words."""
    return mix(shorter[:-1] + np.uint64(n)) + words[n:] if len(words) > n else np.empty(0, np.uint64)


def word_pairs(words: list[bytes]) -> np.ndarray:
    """Hashes of the 2-grams, in order."""
    h = word_hashes(words)
    return longer(h, h, 1)


def grams(words: list[bytes]) -> list[np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams, each in order."""
    h = word_hashes(words)
    pairs = longer(h, h, 1)
    return [h, pairs, longer(pairs, h, 2)]


class Templates:
    """The word pairs of every notice, as a table (pair x notice)."""

    def __init__(self, notices: list[list[list[bytes]]]):
        sets = [np.unique(word_pairs(n)) for family in notices for n in family]
        self.family = np.array([f for f, family in enumerate(notices) for _ in family])
        self.sizes = np.array([len(s) for s in sets])
        self.pairs = np.unique(np.concatenate(sets))
        self.holds = np.stack([np.isin(self.pairs, s) for s in sets], axis=1)

    def at(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs in the table, and which of them are in it."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return at, self.pairs[at] == pairs

    def shares(self, pairs: np.ndarray) -> np.ndarray:
        """Per notice the share of word pairs common to it and the paragraph (of the smaller of both)."""
        own = np.unique(pairs)
        at, known = self.at(own)
        return self.holds[at[known]].sum(axis=0) / np.maximum(1, np.minimum(len(own), self.sizes))

    def overlap(self, family: int, pairs: np.ndarray) -> float:
        """The best share among the notices of the family."""
        return float(self.shares(pairs)[self.family == family].max())


@dataclass(frozen=True)
class LicenceModel:
    vocabulary: np.ndarray
    weights: np.ndarray
    templates: Templates
    temperature: float
    known_at: float

    def features(self, words: list[bytes]) -> np.ndarray:
        """Indices of the paragraph's n-grams in the vocabulary; the last index is the bias."""
        found = np.unique(np.concatenate(grams(words)))
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        return np.append(at[self.vocabulary[at] == found], len(self.vocabulary))

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        """Calibrated probabilities of the families, and of unknown as the last.

        The share of words outside the vocabulary speaks for unknown.
        """
        found = self.features(words)
        strange = 1 - np.isin(grams(words)[0], self.vocabulary).mean() if words else 1.0
        z = (self.weights[found].sum(axis=0) + strange * self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def overlap(self, family: int, words: list[bytes]) -> float:
        """Best share of word pairs common to the paragraph and a notice of the family (of the smaller of both)."""
        return self.templates.overlap(family, word_pairs(words))


def varied(rng: np.random.Generator, notice: list[bytes], other: list[bytes]) -> list[bytes]:
    """A notice with words lost or replaced and strange words around it."""
    words = [w for w in notice if rng.random() > 0.06] or list(notice)
    words = [other[rng.integers(len(other))] if other and rng.random() < 0.04 else w for w in words]
    if other:
        around = [other[i] for i in rng.integers(0, len(other), rng.integers(0, 4))]
        cut = rng.integers(0, len(around) + 1)
        words = around[:cut] + words + around[cut:]
    return words


@dataclass(frozen=True)
class LicenceScan:
    """``sample`` bounds the paragraphs of the corpus that the unknown class is learned from (by hash of id and place).

    Null and empty texts have no paragraphs.  Ids may be null or repeated; every row is scanned for
    itself.  An empty table trains on the notices alone and finds nothing.  Other columns are ignored.
    """

    sample: int = 6_000
    variants: int = 40
    epochs: int = 120
    confirm: float = 0.6
    false_rate: float = 0.001
    id: str = "doc_id"
    text: str = "text"

    def fit(self, docs: DataFrame) -> LicenceModel:
        lines = docs.select(F.col(self.id).alias("id"), F.posexplode(F.split(F.coalesce(F.col(self.text), F.lit("")), "\n")).alias("at", "line"))
        lines = lines.where(F.trim("line") != "")
        total = lines.count()
        share = int(min(1.0, self.sample / max(1, total)) * (1 << 30))
        rows = lines.where(F.pmod(F.xxhash64(F.lit("licence"), "id", "at"), F.lit(1 << 30)) < share)
        return self._train(sorted(r["line"] for r in rows.select("line").collect()))

    def _train(self, paragraphs: list[str]) -> LicenceModel:
        rng = np.random.default_rng(11)
        notices = [[notice_words(n) for n in NOTICES[f]] for f in FAMILIES]
        vocabulary = np.unique(np.concatenate([g for family in notices for n in family for g in grams(n)]))
        templates = Templates(notices)
        blank = LicenceModel(vocabulary, np.zeros((len(vocabulary) + 2, len(FAMILIES) + 1)), templates, 1.0, 0.5)
        unknown = [w for p in paragraphs if (w := notice_words(p)) and templates.shares(word_pairs(w)).max() < self.confirm]
        other = [w for p in unknown[:200] for w in p]
        samples = [(f, varied(rng, n, other)) for f, family in enumerate(notices) for n in family for _ in range(self.variants)]
        samples += [(f, n) for f, family in enumerate(notices) for n in family for _ in range(4)]
        samples += [(len(FAMILIES), w) for w in unknown] or [(len(FAMILIES), [b"x"])]
        # Parts of notices that name no family are unknown as well.
        generic = [notice_words(x) for x in ("licensed under the", "this work is", "available under the terms of", "the license")]
        samples += [(len(FAMILIES), g) for g in generic for _ in range(self.variants)]
        held = rng.random(len(samples)) < 0.25
        x = np.zeros((len(samples), len(vocabulary) + 2), np.float32)
        for i, (_, words) in enumerate(samples):
            x[i, blank.features(words)] = 1
            x[i, -1] = 1 - np.isin(grams(words)[0], vocabulary).mean() if words else 1
        y = np.array([f for f, _ in samples])
        weights = self._descend(x[~held], y[~held], len(FAMILIES) + 1)
        logits = x[held] @ weights
        temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=lambda t: self._loss(logits / t, y[held]))
        p = self._softmax(logits / temperature)
        strange = p[y[held] == len(FAMILIES), :-1].max(axis=1, initial=0)
        known_at = max(0.5, float(np.quantile(strange, 1 - self.false_rate)) if len(strange) else 0.5)
        return LicenceModel(vocabulary, weights.astype(float), templates, temperature, min(known_at, 0.95))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _loss(self, z: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(self._softmax(z)[np.arange(len(y)), y] + 1e-12).mean()) if len(y) else 0.0

    def _descend(self, x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
        """Adam on the regularised cross entropy; every class weighs alike."""
        target = np.eye(classes, dtype=np.float32)[y]
        weight = (1 / np.maximum(1, target.sum(axis=0)))[y][:, None]
        weight /= weight.sum()
        w = np.zeros((x.shape[1], classes), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, self.epochs + 1):
            g = x.T @ ((self._softmax(x @ w) - target) * weight) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return w

    def scan(self, docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
        """id, spans (paragraph, start, length, family, probability, overlap) per row, empty where nothing is found."""
        model = model or self.fit(docs)
        shared = docs.sparkSession.sparkContext.broadcast(model)
        confirm = self.confirm

        @F.pandas_udf("array<struct<paragraph int, start int, length int, family string, probability double, overlap double>>")
        def spans(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: list(find(shared.value, t, confirm)))

        return docs.select(F.col(self.id), spans(F.col(self.text)).alias("spans"))


def find(model: LicenceModel, text: str | None, confirm: float) -> Iterator[dict]:
    """The confirmed licence paragraphs of one text."""
    start, templates = 0, model.templates
    lines = (text or "").split("\n")
    words = [notice_words(x) for x in lines]
    # The pairs of all lines at once; those over a line's end belong to none.
    ends = np.cumsum([len(w) for w in words])
    pairs = word_pairs([w for line in words for w in line])
    hits = np.flatnonzero(templates.at(pairs)[1])
    line_of = np.searchsorted(ends, hits, "right")
    wanted = set(line_of[hits + 1 < ends[line_of]].tolist()) if len(hits) else set()
    for i, line in enumerate(lines):
        if i in wanted:
            own = pairs[ends[i] - len(words[i]): ends[i] - 1]
            # No family could be confirmed below that share, whatever the classifier says.
            if templates.shares(own).max() >= confirm:
                p = model.probabilities(words[i])
                best = int(p.argmax())
                if best < len(FAMILIES) and p[best] >= model.known_at and (o := templates.overlap(best, own)) >= confirm:
                    yield {"paragraph": i, "start": start, "length": len(line), "family": FAMILIES[best],
                           "probability": float(p[best]), "overlap": o}
        start += len(line) + 1
