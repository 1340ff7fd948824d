"""Licence notices in paragraphs.

A multinomial logistic regression on sparse word 1- and 2-grams tells licence
families, licence language of no known family (``unknown``) and other text
apart. It is trained on notices put together from the templates below and on a
bounded sample of paragraphs of the corpus. Probabilities are calibrated by a
temperature on rows that were held out of the fit.

A paragraph is a line. It is scored in windows of 16 words, 8 apart, so that a
notice in a long line counts as much as one alone, and a line can hold several.
The family of a window is reported if one of its templates is found there: its
words one after another, a word in six of those that are no names changed, left
out or put in, and no other family's template fits the same place better. A line that
reads like a licence and has no such family is ``unknown``. All paragraphs of all
texts are scored, as arrays.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import words as W

OTHER, UNKNOWN = "none", "unknown"

#: Titles and short names by family, as they stand in headings, tags and sentences.
TITLES = {
    "agpl": ["GNU Affero General Public License", "AGPL-3.0", "AGPLv3", "GNU AGPL"],
    "apache": ["Apache License", "Apache-2.0", "Apache 2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license",
            "2-clause BSD license"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution License",
              "creativecommons.org/licenses/by/4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial License",
                 "creativecommons.org/licenses/by-nc/4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike License",
                 "creativecommons.org/licenses/by-sa/4.0"],
    "cc0": ["CC0 1.0", "CC0-1.0", "Creative Commons Zero", "creativecommons.org/publicdomain/zero/1.0"],
    "gpl": ["GNU General Public License", "GPL-2.0", "GPL-3.0", "GPLv2", "GPLv3", "GNU GPL"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "LGPL-2.1", "LGPL-3.0", "LGPLv3", "GNU LGPL"],
    "mit": ["MIT License", "MIT License (MIT)"],
    "mpl": ["Mozilla Public License", "MPL-2.0", "MPL 2.0"],
    "proprietary": ["proprietary license", "commercial license agreement"],
}

#: Names of the tag ``SPDX-License-Identifier``.
TAGS = {
    "agpl": ["AGPL-3.0"], "apache": ["Apache-2.0"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"], "cc0": ["CC0-1.0"], "gpl": ["GPL-2.0", "GPL-3.0"], "lgpl": ["LGPL-2.1", "LGPL-3.0"], "mit": ["MIT"], "mpl": ["MPL-2.0"],
}

_GNU = {"agpl": "GNU Affero General Public License", "gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License"}

#: Wording of notices by family.
SENTENCES = {
    **{family: [f"licensed under the {title}", f"under the terms of the {title} as published by the Free Software Foundation",
                f"under the terms of the {title} version 3", f"you should have received a copy of the {title}", f"see the {title} for more details"]
       for family, title in _GNU.items()},
    "apache": ["licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License",
               "distributed under the License is distributed on an as is basis without warranties or conditions of any kind",
               "distributed under the terms of the Apache License 2.0"],
    "bsd": ["redistribution and use in source and binary forms, with or without modification, are permitted",
            "redistributions of source code must retain the above copyright notice",
            "redistributions in binary form must reproduce the above copyright notice", "licensed under the BSD license"],
    "cc-by": ["licensed under CC BY 4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["dedicated to the public domain under CC0 1.0", "the author has waived all copyright under CC0", "this work is in the public domain"],
    "mit": ["released under the MIT License", "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the software",
            "the above copyright notice and this permission notice shall be included in all copies", "distributed under MIT", "licensed under MIT"],
    "mpl": ["this source code form is subject to the terms of the Mozilla Public License", "licensed under the Mozilla Public License 2.0",
            "a copy of the MPL was not distributed with this file"],
    "proprietary": ["all rights reserved", "unauthorized copying of this file is strictly prohibited", "proprietary and confidential"],
}

TEMPLATES = {family: [*SENTENCES[family], *TITLES[family], *(f"SPDX-License-Identifier: {tag}" for tag in TAGS.get(family, []))]
             for family in sorted(SENTENCES)}

#: Licence language of no family above: {n} is an invented name.
UNKNOWN_NOTICES = [
    "licensed under the {n} License", "released under the {n} Public License, version {v}", "distributed under the terms of the {n} licence",
    "this work is licensed under the {n} License {v}", "use is subject to the {n} licence agreement", "licensed under {n} {v}",
    "made available under the {n} Open License", "the terms of the {n} License apply",
]

#: Words of licences in text that grants nothing.
ORDINARY = [
    "he lost his driving licence last year", "the public library has a copy of the work", "the general was granted a version of the terms",
    "permission to land was refused", "a licence to print money", "source and binary stars", "all rights and no duties",
    "the MIT campus is in Cambridge", "an apache helicopter landed", "free of charge for members", "creative people share common ideas",
    "the fishing licence costs ten dollars", "version 2.0 of the software was slow", "the rights of the public were reserved for later",
    "copies of the file are distributed by post", "without permission he used the car", "she renewed her hunting licence in spring",
    "the driver showed a licence at the gate", "a new license plate", "the pilot has a license", "poetic licence is common in the work",
    "the council gave the pub a licence", "copyright law changed in the last century", "the terms of the sale were public",
]

CLASSES = (*sorted(TEMPLATES), UNKNOWN, OTHER)
#: Words of a window, and how far apart windows begin.
WINDOW, STEP = 16, 8
#: One in so many words of a template may be off; names never.
SLIPS = 6
_AROUND = ["this project is", "this software is", "copyright (c) {y} {n}.", "copyright {y} {n},", "see LICENSE for details.", "unless otherwise noted,",
           "all files are", "", "", "", "this file is", "the text is", "by {n}."]


def grams(paragraph: str) -> set[str]:
    """Word 1- and 2-grams, in lower case, words being runs of letters and digits."""
    found = W.words(*W.texts_buffer(pa.array([paragraph], pa.large_string())), W.ALNUM)
    words = [found.word(k) for k in range(len(found.starts))]
    return set(words) | {" ".join(p) for p in zip(words, words[1:], strict=False)}


def _word_hashes(text: str) -> np.ndarray:
    return W.words(*W.texts_buffer(pa.array([text], pa.large_string())), W.ALNUM).hashes()


_SPELLINGS = [(_word_hashes(a)[0], _word_hashes(b)[0]) for a, b in (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"))]


def _spelt(hashes: np.ndarray) -> np.ndarray:
    """Hashes of words, British spellings as the American ones."""
    out = hashes.copy()
    for british, american in _SPELLINGS:
        out[hashes == british] = american
    return out


@dataclass(frozen=True)
class Template:
    words: list[int]
    #: Cost of a word that is missing or another one: names are not to be missed.
    costs: list[int]
    slips: int

    @classmethod
    def of(cls, text: str) -> Template:
        hashes = _spelt(_word_hashes(text)).tolist()
        names = set()
        for word in text.split():
            if any(c.isupper() or c.isdigit() for c in word):
                names |= set(_spelt(_word_hashes(word)).tolist())
        slips = len(hashes) // SLIPS
        return cls(hashes, [slips + 1 if h in names else 1 for h in hashes], slips)

    def find(self, line: list[int], held: set[int]) -> tuple[int, int, int] | None:
        """``(score, start, end)`` of the best place in a line: words that fit, less twice the slips; None where there is none."""
        if sum(w not in held for w in self.words) > self.slips:
            return None
        # Least cost to have read the template up to each word, by where in the line it ends; a place may begin anywhere.
        n = len(self.words)
        before = [(0, -1)]
        for w, cost in zip(self.words, self.costs):
            before.append((before[-1][0] + cost, -1))
        best = None
        for at, seen in enumerate(line):
            row = [(0, at + 1)]
            for j in range(1, n + 1):
                skip, same = self.costs[j - 1], self.words[j - 1] == seen
                diagonal = before[j - 1] if j > 1 else (0, at)
                row.append(min((diagonal[0] + (0 if same else skip), diagonal[1]), (before[j][0] + 1, before[j][1]), (row[j - 1][0] + skip, row[j - 1][1])))
            slips, start = row[n]
            if slips <= self.slips and start >= 0 and (best is None or n - 2 * slips > best[0]):
                best = (n - 2 * slips, start, at + 1)
            before = row
        return best


def _hashes(texts: list[str]) -> list[np.ndarray]:
    """Feature hashes of paragraphs (distinct, sorted)."""
    out: list[np.ndarray] = []
    data, offsets = W.texts_buffer(pa.array(texts, pa.large_string()))
    words = W.words(data, offsets, W.ALNUM)
    h = _spelt(words.hashes())
    pairs, ok = W.windows(h, 2), W.within(words.offsets, 2)
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        two = pairs[a:max(b - 1, a)][ok[a:max(b - 1, a)]]
        out.append(np.unique(np.concatenate([h[a:b], two])))
    return out


def notices(rng: random.Random, per_class: int) -> tuple[list[str], list[str]]:
    """Paragraphs made from the templates and their classes."""
    name = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).capitalize()
    fill = lambda t: t.format(n=name(), y=rng.randint(1990, 2030), v=f"{rng.randint(1, 4)}.{rng.randint(0, 2)}")
    texts, classes = [], []
    for family, forms in [*TEMPLATES.items(), (UNKNOWN, UNKNOWN_NOTICES)]:
        for i in range(per_class):
            body = fill(forms[i % len(forms)])
            words = body.split(" ")
            if len(words) > 6 and rng.random() < 0.4:  # a word lost
                words.pop(rng.randrange(len(words)))
            body = " ".join(words).replace("icense", rng.choice(["icense", "icense", "icence"]))
            filler = " ".join(name().lower() for _ in range(rng.choice([0, 0, 0, 3, 8])))
            parts = [fill(rng.choice(_AROUND)), body, fill(rng.choice(_AROUND)), filler]
            texts.append(" ".join(p for p in parts if p))
            classes.append(family)
    for i in range(per_class):
        texts.append(" ".join([ORDINARY[i % len(ORDINARY)], name().lower(), name().lower()]))
        classes.append(OTHER)
    # Words of licences in any order say nothing.
    bag = [w for forms in TEMPLATES.values() for form in forms for w in form.split()] + [w for form in ORDINARY for w in form.split()]
    for _ in range(2 * per_class):
        texts.append(" ".join(rng.choice(bag) for _ in range(WINDOW)))
        classes.append(OTHER)
    return texts, classes


@dataclass(frozen=True)
class Model:
    features: W.Lookup
    weights: np.ndarray      # one row per feature, one column per class
    constant: np.ndarray
    temperature: float
    templates: list[list[Template]]  # by class

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        return _softmax(scores / self.temperature)

    def reads_as(self, words: np.ndarray) -> int:
        """Class of a stretch of words, given by their hashes."""
        found = np.concatenate([self.features.find(words), self.features.find(W.windows(words, 2))])
        return int(self.probabilities((self.weights[np.unique(found[found >= 0])].sum(0) + self.constant)[None])[0].argmax())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(ordinary: list[str], *, per_class: int = 240, rounds: int = 250, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> Model:
    """Model from the templates and ``ordinary`` paragraphs; those that hold a template are left out."""
    rng = random.Random(seed)
    templates = [[Template.of(t) for t in TEMPLATES.get(c, [])] for c in CLASSES]
    held = np.unique(np.concatenate([h for c in CLASSES for h in _hashes(TEMPLATES.get(c, []))]))
    plain = []
    for text in ordinary:
        words = _spelt(_word_hashes(text)).tolist()
        if not any(t.find(words, set(words)) for ts in templates for t in ts):
            cut = text.split()
            at = WINDOW * (len(plain) % max(1, len(cut) // WINDOW))  # one window, from anywhere in it
            plain.append(" ".join(cut[at:at + WINDOW]))
    texts, classes = notices(rng, per_class)
    texts += plain
    classes += [OTHER] * len(plain)
    own = _hashes(texts)
    # Features: all of notices and made-up sentences that occur in two of them, and all of templates.
    seen, times = np.unique(np.concatenate(own[:len(texts) - len(plain)]), return_counts=True)
    keys = np.union1d(seen[times >= 3], held)
    lookup = W.Lookup(keys)
    x = np.zeros((len(texts), len(keys)), np.float32)
    for i, h in enumerate(own):
        at = lookup.find(h)
        x[i, at[at >= 0]] = 1
    y = np.zeros((len(texts), len(CLASSES)), np.float32)
    y[np.arange(len(texts)), [CLASSES.index(c) for c in classes]] = 1
    out = np.arange(len(texts)) % 4 == 3
    weight = (1 / y[~out].sum(0).clip(1))[y[~out].argmax(1)]
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    w, b = np.zeros((len(keys), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    seen, target = x[~out], y[~out]
    turned = np.ascontiguousarray(seen.T)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        gap = (_softmax(seen @ w + b) - target) * weight
        for k, (p, g) in enumerate(((w, turned @ gap + decay * w), (b, gap.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    scores, truth = x[out] @ w + b, y[out].argmax(1)
    loss = lambda t: -np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min(np.geomspace(0.1, 10, 60), key=loss)
    return Model(lookup, w.astype(np.float64), b.astype(np.float64), float(temperature), templates)


@dataclass
class Found:
    text: np.ndarray         # of each paragraph that reads like a licence
    paragraph: np.ndarray    # its number in the text, from 1
    family: list[str]
    probability: np.ndarray


def _families(predicted: list[int], line: np.ndarray, model: Model) -> list[str]:
    """Those of the predicted classes that a template confirms, in their order in the line.

    Places of templates compete: of two that overlap the one with the higher
    score stays. A window may hold a second notice, so what lies around the
    place of another family is read by itself, up to the next places.
    """
    words = line.tolist()
    held = set(words)
    places = sorted(((found, c) for c, ts in enumerate(model.templates) for t in ts if (found := t.find(words, held))),
                    key=lambda x: (-x[0][0], x[0][1], x[1]))
    kept: list[tuple[int, int, int]] = []
    for (_, start, end), c in places:
        if not any(start < e and s < end and own != c for s, e, own in kept):
            kept.append((start, end, c))
    out = []
    for start, end, c in sorted(kept):
        others = [(s, e) for s, e, own in kept if own != c]
        low, high = max((e for _, e in others if e <= start), default=0), min((s for s, _ in others if s >= end), default=len(words))
        if c in predicted or model.reads_as(line[low:high]) == c:
            out.append(CLASSES[c])
    return list(dict.fromkeys(out))


def scan(data: np.ndarray, offsets: np.ndarray, model: Model, *, least: float = 0.5, sure: float = 0.9) -> tuple[Found, np.ndarray]:
    """Licences in the texts that ``offsets`` cut ``data`` into, and the number of paragraphs with words of each text.

    A window reads like a licence with a probability of ``least``; its class is
    then the likeliest family. ``unknown``, which no template confirms, takes ``sure``.
    """
    words = W.words(data, offsets, W.ALNUM)
    upto = np.concatenate([[0], np.cumsum(data == 0x0A)])
    text = np.repeat(np.arange(len(offsets) - 1), words.counts())
    number = upto[words.starts] - upto[offsets[text]] + 1 if len(text) else text
    line = np.cumsum(np.concatenate([[True], (number[1:] != number[:-1]) | (text[1:] != text[:-1])])) - 1 if len(text) else text
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    counts = np.bincount(text[head], minlength=len(offsets) - 1)
    none = Found(*[np.zeros(0, np.int64)] * 2, [], np.zeros(0)), counts
    if not len(line):
        return none
    hashes = _spelt(words.hashes())
    # Windows are numbered through all lines; a word lies in two of them, in one at the ends of a line.
    ends = np.append(head[1:], len(line))
    windows = np.maximum((ends - head - 1) // STEP, 1)
    first_window = np.concatenate([[0], np.cumsum(windows)])
    step = (np.arange(len(line)) - head[line]) // STEP
    later = first_window[line] + np.minimum(step, windows[line] - 1)
    earlier = first_window[line] + np.clip(step - 1, 0, windows[line] - 1)
    one = model.features.find(hashes)
    two = model.features.find(W.windows(hashes, 2))
    two[line[1:] != line[:-1]] = -1
    feature = np.concatenate([one, two])
    width = max(len(model.features.keys), 1)
    hit = np.flatnonzero(feature >= 0)
    at = np.where(hit < len(one), hit, hit - len(one))
    pair = np.unique(np.concatenate([later[at] * width + feature[hit], earlier[at] * width + feature[hit]]))
    owner, feature = pair // width, pair % width
    if not len(owner):
        return none
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    p = model.probabilities(np.add.reduceat(model.weights[feature], first, axis=0) + model.constant)
    like = np.flatnonzero(p[:, -1] < 1 - least)
    of = np.searchsorted(first_window, owner[first[like]], side="right") - 1
    texts, numbers, families, sureness = [], [], [], []
    for k in np.unique(of).tolist():
        rows = like[np.searchsorted(of, k):np.searchsorted(of, k, side="right")]
        best = set(p[rows, :-2].argmax(1).tolist())
        found = _around(owner[first[rows]] - first_window[k], hashes[head[k]:ends[k]], best, model)
        chance = float(1 - p[rows, -1].min())
        if not found and chance >= sure:
            found = [UNKNOWN]
        for family in found:
            texts.append(text[head[k]])
            numbers.append(number[head[k]])
            families.append(family)
            sureness.append(chance)
    return Found(np.array(texts, np.int64), np.array(numbers, np.int64), families, np.array(sureness)), counts


def _around(windows: np.ndarray, line: np.ndarray, best: set[int], model: Model) -> list[str]:
    """Confirmed families of the windows of one line that read like a licence, looked for a window further on both sides."""
    spans: list[list[int]] = []
    for w in windows.tolist():
        a, b = max(0, w * STEP - WINDOW), w * STEP + 2 * WINDOW
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return list(dict.fromkeys(f for a, b in spans for f in _families(sorted(best), line[a:b], model)))


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = 4_000) -> Model:
    """Fit with one paragraph each of about ``sample`` documents, those of the least hashes."""
    n = docs.count()
    rank = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("licence")), F.lit(1 << 30))
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    one = F.element_at(lines, (F.pmod(F.xxhash64(F.lit("line"), F.col(doc_id).cast("string")), F.size(lines)) + 1).cast("int"))
    rows = docs.where(rank < int((1 << 30) * min(1.0, sample / max(n, 1)))).select(one.alias("p")).where("p <> ''").toArrow()
    return fit(sorted(rows["p"].to_pylist()))


_HIT = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))


def find(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, licences`` of every row; ``licences`` lists ``paragraph, family, probability``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, offsets = W.texts_buffer(batch.column(1))
            for a, b in W.slices(offsets):
                part = offsets[a:b + 1]
                found, counts = scan(data[part[0]:part[-1]], part - part[0], shipped.value)
                hits: list[list[dict]] = [[] for _ in range(a, b)]
                for t, n, family, p in zip(found.text.tolist(), found.paragraph.tolist(), found.family, found.probability.tolist(), strict=True):
                    hits[t].append({"paragraph": n, "family": family, "probability": p})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(hits, _HIT)], ["doc_id", "n_paragraphs", "licences"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        W.lean(run), f"doc_id {kind}, n_paragraphs long, licences array<struct<paragraph:int,family:string,probability:double>>")


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``doc_id, n_paragraphs, n_licences, families, licences`` of every row.

    ``families`` are the distinct families found, sorted, and ``licences`` the
    findings as ``family:paragraph`` in order, comma-joined; a paragraph may hold several. ``n_paragraphs``
    counts lines with a word. Null and empty texts have none. Ids may be null
    or repeat, and other columns are not looked at.
    """
    rows = find(docs, train(docs, doc_id=doc_id, text=text, **how), doc_id=doc_id, text=text)
    return rows.select(
        "doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), ",").alias("families"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["paragraph"].cast("string"))), ",").alias("licences"))
