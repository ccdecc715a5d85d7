"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of as many consecutive words as 1 / `threshold` times the template's own, over line ends, so wrapped notices
are found and words scattered over a long line are not. A template is found in every block that holds at least `threshold` of the
template's distinct words; `found` has each label with its best containment, and leaves none out. Labels come from what is found: where
blocks of different labels overlap, the one of the higher containment counts, of equal ones that of more words, of equal ones both.
Template words are ordered by the number of texts of the whole corpus that hold them, rarest first. A text with such a block must
hold one of the first |T| - a + 1 words of the template (prefix; a: the words it needs) and at least a words (length); and
a first common word at places i and j leaves at most 1 + min(rest of T, rest of the text's template words) common words
(position). In what remains, the windows near prefix words are counted exactly.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Defined cases: null text is empty; empty texts have no words, labels
or score; texts of any length are scanned whole; repeated rows are scanned alike; ties of score give all labels; a null doc_id
stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.common import bounded_batches

THRESHOLD = 0.8
#: Phrases and the labels that they prove.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed values: (label, notice). Several notices may have one label. Texts of public licenses.
TEMPLATES = (
    ("mit", "The MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by", "CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "GNU General Public License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in
        a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such"""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
)
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found string"


def words(data: bytes) -> list[bytes]:
    return data.translate(_PLAIN).split()


@dataclass
class Index:
    """Templates as word lists, rarest first; the words each needs; its window's length; rank of each template word; prefix word ->
    (template, place) pairs."""

    labels: list[str]
    sets: list[list[bytes]]
    need: list[int]
    span: list[int]
    rank: dict[bytes, int]
    prefix: dict[bytes, list[tuple[int, int]]]

    def candidates(self, distinct: set[bytes]) -> list[int]:
        """The templates that a text of these words may hold a block of: prefix, length and positional filters."""
        held = sorted(distinct & self.rank.keys(), key=self.rank.__getitem__)
        seen, out = set(), []
        for j, w in enumerate(held):
            for t, i in self.prefix.get(w, ()):
                if t in seen or len(distinct) < self.need[t] or 1 + min(len(self.sets[t]) - i - 1, len(held) - j - 1) < self.need[t]:
                    continue
                seen.add(t)
                if sum(x in distinct for x in self.sets[t]) >= self.need[t]:
                    out.append(t)
        return out

    def blocks(self, ws: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """For each template found its blocks (first word, last word, distinct words): at every word of the template the window that ends there."""
        templates = self.candidates(set(ws))
        held, out = [(p, w) for p, w in enumerate(ws) if w in self.rank] if templates else [], {}
        for t in templates:
            mine, span, need = frozenset(self.sets[t]), self.span[t], self.need[t]
            own = [(p, w) for p, w in held if w in mine]
            inside, left = Counter(), 0
            for place, w in own:
                inside[w] += 1
                while place - own[left][0] >= span:
                    gone = own[left][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    left += 1
                if len(inside) >= need:
                    out.setdefault(t, []).append((own[left][0], place, len(inside)))
        return out

    def labelled(self, blocks: dict[int, list[tuple[int, int, int]]]) -> set[str]:
        """The labels of blocks that no better block of another label overlaps."""
        out = set()
        for t, own in blocks.items():
            rivals = [(n / len(self.sets[k]), n, a, b) for k, other in blocks.items() if self.labels[k] != self.labels[t] for a, b, n in other]
            if not rivals:
                out.add(self.labels[t])
                continue
            best = _highest_over(rivals, max(b for *_, b in own + [(0, r[3]) for r in rivals]) + 1)
            if any((n / len(self.sets[t]), n) >= best(a, b) for a, b, n in own):
                out.add(self.labels[t])
        return out


def _highest_over(rivals: list[tuple[float, int, int, int]], end: int):
    """(first, last) -> the highest (containment, words) of the rivals (containment, words, first, last) that overlap these places."""
    at = [(0.0, 0)] * end
    for c, n, a, b in sorted(rivals):
        at[a : b + 1] = [(c, n)] * (b + 1 - a)
    return lambda a, b: max(at[a : b + 1])


def build_index(templates, frequency: dict[bytes, int], threshold: float = THRESHOLD) -> Index:
    of = [words(text.encode()) for *_, text in templates]
    every = sorted({w for ws in of for w in ws}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: r for r, w in enumerate(every)}
    sets = [sorted(set(ws), key=rank.__getitem__) for ws in of]
    need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
    prefix = defaultdict(list)
    for t, s in enumerate(sets):
        for i, w in enumerate(s[: len(s) - need[t] + 1]):
            prefix[w].append((t, i))
    return Index([label for label, *_ in templates], sets, need, [math.ceil(len(ws) / threshold) for ws in of], rank, dict(prefix))


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """For each template word the number of texts that hold it, over all texts. Tasks count before the shuffle; the result has
    at most as many rows as the templates have words."""
    bounded_batches(docs.sparkSession)
    vocabulary = frozenset(w for *_, text in templates for w in words(text.encode()))

    def count(batches):
        tally: Counter = Counter()
        for b in batches:
            for data in b.column(0).cast(pa.binary()).to_pylist():
                tally.update(vocabulary.intersection(words(data or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def places(joined: bytes, phrases: list[bytes]) -> list[tuple[int, int]]:
    """(first word, phrase) of every place where a phrase's words stand consecutively; joined: ` word word ... word `."""
    out = []
    for p, phrase in enumerate(phrases):
        at = joined.find(phrase)
        while at >= 0:
            out.append((joined.count(b" ", 0, at), p))
            at = joined.find(phrase, at + 1)
    return sorted(out)


def scan(docs: DataFrame, phrases=None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> RESULT, one row per document. Two passes over the texts, no shuffle of them."""
    phrases = PHRASES if phrases is None else phrases
    index = build_index(templates, word_frequencies(docs, templates), threshold)
    needles, base_labels = [b" " + b" ".join(words(p.encode())) + b" " for p in phrases], list(phrases.values())
    first = frozenset(index.prefix)

    def one(data: bytes) -> tuple:
        ws = words(data)
        found = places(b" " + b" ".join(ws) + b" ", needles)
        base = {base_labels[p] for _, p in found}
        labels, contained = set(base), {}
        if not first.isdisjoint(ws):
            blocks = index.blocks(ws)
            labels |= index.labelled(blocks)
            for t, own in blocks.items():
                contained[index.labels[t]] = max(contained.get(index.labels[t], 0.0), max(n for *_, n in own) / len(index.sets[t]))
        score = 1.0 if base else max(contained.values(), default=0.0)
        held = ",".join(f"{label}:{c:.4f}" for label, c in sorted(contained.items()))
        return len(ws), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, held

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        for b in batches:
            got = [one(data or b"") for data in b.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*got, strict=True)) if got else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
