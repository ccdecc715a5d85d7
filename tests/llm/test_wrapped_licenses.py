"""Notices wrapped over lines, siblings told apart, and lines that hold no notice."""

import textwrap

import numpy as np
import pytest

from stepfield.llm import licenses
from tests.llm.test_text_operators import slow_license

LABELS = {
    "Released under the Apache License, Version 2.0": "apache-2",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "Copyright 2020 A. All rights reserved.": "proprietary",
    "Released under the MIT License": "mit",
}
CLEAN = [
    "All of the civil rights that were reserved for the few", "all the rights of those whom the law reserved it to, of all kinds", "Released under the new name of the old license holder", "a license to drive under the influence of the version 2 law",
    "The general public may use this work, licensed or not", "Permission to use this room is granted for any purpose without fee of copy", "free software is distributed by the public library under these terms", "source and binary forms are met with or without conditions",
]


@pytest.fixture(scope="module")
def index():
    return licenses.build_index(licenses.TEMPLATES, {})


def test_siblings_are_told_apart(index):
    for text, label in LABELS.items():
        assert index.labelled(index.blocks(licenses.words(text.encode()))) == {label}, text
    both = " and, for the data, which took the better part of some other year to collect, ".join(list(LABELS)[1:3])
    assert index.labelled(index.blocks(licenses.words(both.encode()))) == {"cc-by", "cc-by-nc"}


def test_any_one_word_may_be_missing(index):
    """Every template of at least five words is found, by its own containment, whichever of its words is left out."""
    tried = 0
    for t, (label, text) in enumerate(licenses.TEMPLATES):
        ws = licenses.words(text.encode())
        for gone in set(ws) if len(set(ws)) >= 5 else ():
            found = index.blocks([w for w in ws if w != gone])
            assert max(n for *_, n in found[t]) == len(set(ws)) - 1, (label, gone)
            tried += 1
    assert tried > 300


def test_clean_lines_have_no_label(index):
    """Also shuffled words of the notices themselves: of 500 texts few hold 80 % of one by chance."""
    for text in CLEAN:
        assert not index.blocks(licenses.words(text.encode())), text
    rng = np.random.default_rng(1)
    every = [w for *_, t in licenses.TEMPLATES for w in t.lower().split()]
    hits = sum(bool(index.blocks(licenses.words(" ".join(rng.choice(every, 60)).encode()))) for _ in range(500))
    assert hits <= 10


def test_blocks_against_brute_force(index):
    rng = np.random.default_rng(6)
    every = [w.decode() for *_, t in licenses.TEMPLATES for w in licenses.words(t.encode())]
    for _ in range(80):
        ws = rng.choice([*every, *["other"] * 20], 40).tolist()
        ws[10:10] = [w.decode() for w in licenses.words(licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))][1].encode()) if rng.random() < 0.9]
        got = sorted(index.labelled(index.blocks([w.encode() for w in ws])))
        assert ",".join(got) == slow_license(" ".join(ws), {})[5]


def test_wrapped_notices(spark):
    notices = [" ".join(t.split()) for *_, t in licenses.TEMPLATES]
    rows = [(i, "Head.\n" + textwrap.fill(t, 30, initial_indent="# ", subsequent_indent="# ") + "\ncode = 1") for i, t in enumerate(notices)]
    rows.append((99, "all of it\nis mine; rights\nwere never reserved"))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(t[0] in got[i].labels.split(",") and got[i].score == 1 for i, t in enumerate(licenses.TEMPLATES)) and got[99].labels == ""
