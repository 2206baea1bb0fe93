"""Operator 6: licence scan by the Dice coefficient of word bigrams.

A span is a line, a paragraph of several lines, or the whole text if it has several paragraphs. Spans and
templates are normalised (lower case, words of letters and digits, dots inside numbers kept) and become multisets
of word bigrams (a single word is one bigram with itself). Dice = 2 |A and B| / (|A| + |B|). For Dice >= t the size
of B lies between t / (2 - t) and (2 - t) / t of that of A, so only templates within these bounds of a span's size
are compared, and of spans without any no bigrams are made.

Result: for every span, the templates that reach the threshold. Defined results: null and empty texts have no
spans; equal lines match each; of several templates all that reach the threshold are given; repeated rows and
null ids stay; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skucast.llm.common import chunks

THRESHOLD = 0.8
#: Statements and notices by which texts name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
FOUND = "doc_id long, kind string, first_line int, licence string, dice double"
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def counted(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:])) if len(words) != 1 else Counter([(words[0], words[0])])


def bigrams(text: str) -> Counter:
    return counted(_WORD.findall(text.lower()))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def spans(text: str):
    """(kind, first line, text) of every line with a word, paragraph of several lines, text of several paragraphs."""
    lines, start, paragraphs = text.split("\n"), None, 0
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            yield "line", i, line
            start = i if start is None else start
        elif start is not None:
            paragraphs += 1
            if i - start > 1:
                yield "paragraph", start, "\n".join(lines[start:i])
            start = None
    if paragraphs > 1:
        yield "text", 0, text


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.by_size = sorted((bigrams(t).total(), name, bigrams(t)) for name, t in templates.items())
        self.sizes = [s[0] for s in self.by_size]
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)

    def candidates(self, size: int):
        lo = bisect_left(self.sizes, size * self.ratio - 1e-9)
        return self.by_size[lo:bisect_right(self.sizes, size / self.ratio + 1e-9)]

    def match(self, text: str):
        words = _WORD.findall(text.lower())
        near = self.candidates(max(len(words) - 1, min(len(words), 1)))
        own = counted(words) if near else None
        for _, name, template in near:
            value = dice(own, template)
            if value >= self.threshold - 1e-9:
                yield name, value


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every span and template whose Dice coefficient reaches the threshold."""

    def work(batches):
        matcher = Matcher(templates, threshold)
        for b in chunks(batches, "text"):
            out = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                for kind, line, span in spans(text or ""):
                    out += [(doc, kind, line, name, value) for name, value in matcher.match(span)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                             names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, FOUND)
