"""Licence classifier: held-out notices, ordinary text, odd rows."""

import random

import pyarrow as pa
import pytest

from caselens.llm import licences
from caselens.llm import words as W


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)] + ["the", "of", "to", "all", "by", "this"] * 30
    return licences.fit([" ".join(rng.choice(words) for _ in range(40)) for _ in range(800)])


def classify(model, text):
    found, _ = licences.scan(*W.texts_buffer(pa.array([text], pa.large_string())), model)
    return found.family


def test_held_out_notices(model):
    texts, classes = licences.notices(random.Random(99), 40)
    right = sum((classify(model, t) or [licences.OTHER])[0] == c for t, c in zip(texts, classes, strict=True))
    assert right > 0.9 * len(texts)  # some have lost a word that the template needs


@pytest.mark.parametrize("text,family", [
    ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache"), ("Released under the MIT License.", "mit"),
    ("Copyright 2011 Somebody. All rights reserved.", "proprietary"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under the Wobble Frob License 3.1.", "unknown"), ("He renewed his fishing licence in May.", None), ("", None),
    ("the rights of all and the version of this work", None),
    ("MIT License", "mit"), ("The MIT License (MIT)", "mit"), ("SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache"),
    ("BSD 3-Clause License", "bsd"), ("GNU General Public License", "gpl"), ("Apache License", "apache"), ("Licensed under GPLv3", "gpl"),
    ("Mozilla Public License Version 2.0", "mpl"), ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("it under the terms of the GNU General Public License as published by", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("it under the terms of the GNU Affero General Public License as published by", "agpl"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    # Wording that is in no template.
    ("This file may be used under the terms of the MIT licence only", "mit"), ("see the file COPYING; this is covered by the GNU General Public Licence", "gpl"),
    ("// Dual licensed software, pick the Apache License if you prefer", "apache"), ("documentation is under Creative Commons Attribution 4.0, see the web site", "cc-by")])
def test_examples(model, text, family):
    assert classify(model, text) == ([family] if family else [])


def test_long_lines(model, vocabulary, rng):
    before, between = " ".join(vocabulary(300)), " ".join(vocabulary(60))
    assert classify(model, f"{before} released under the MIT License {between} licensed under the Apache License, Version 2.0 {before}") == ["mit", "apache"]
    assert classify(model, "Released under the MIT License, parts are licensed under CC BY-NC 4.0.") == ["mit", "cc-by-nc"]
    assert classify(model, before + " " + between) == []


def test_words_of_licences_in_any_order(model, rng):
    words = "terms under software version public general the of this work source copy use file free person notice and or to a is".split()
    found = [classify(model, " ".join(rng.choice(words) for _ in range(400))) for _ in range(20)]
    assert sum(bool(f) for f in found) <= 2, found


def test_families_are_confirmed_by_a_template(model):
    """What reads like a family but holds no template of it is unknown."""
    bare = licences.Model(model.features, model.weights, model.constant, model.temperature, [[] for _ in licences.CLASSES])
    assert classify(bare, "Released under the MIT License.") == ["unknown"]


def test_rows(documents, vocabulary, rng):
    rows = [(i, "\n".join(" ".join(vocabulary(rng.randint(3, 30))) for _ in range(5))) for i in range(120)]
    rows += [(200, rows[0][1] + "\n\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (201, None), (202, ""), (203, "\n \n"),
             (None, "All rights reserved."), (4, "All rights reserved."), (204, " ".join(vocabulary(40_000)) + "\nReleased under the MIT License.")]
    got = licences.report(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_paragraphs): r for r in got}
    assert by[200, 7].licences == "mit:7,cc-by-nc:8" and by[200, 7].families == "cc-by-nc,mit"
    assert [by[i, 0].licences for i in (201, 202, 203)] == [""] * 3
    assert by[None, 1].families == by[4, 1].families == "proprietary" and by[204, 2].licences == "mit:2"
    assert sum(r.n_licences for r in got) == 5
    assert licences.report(documents([])).collect() == []
