"""Operator 9: license scan by banded MinHash over overlapping windows, verified by shingle containment.

Templates are grouped by their number of shingles into classes that span a factor of two.
For a class whose largest template has s shingles, each text is cut into blocks of s shingles
and every two neighbouring blocks form a window, so windows overlap by half and each
occurrence of a template lies whole in one.  A window that holds the share c
of a template of t shingles resembles it by at least c t / (2 s + (1 - c) t); with
one row a band, the number of bands is the least that gives windows at that resemblance
a collision with the stated probability.  Retrieved templates are then counted exactly:
the share of their distinct shingles that the window holds.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, with A-Z lower-cased.

Defined results: null and empty texts and texts of fewer than five words have no rows, except that
a template of fewer than five words is found where a text consists of it; repeated
rows come out repeated; a null id stays null; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import bound_batches

#: Notices that licenses ask to be given, by SPDX identifier and a number.
TEMPLATES = {
    "MIT#1": "Released under the MIT License.",
    "MIT#2": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT#3": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0#1": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0#3": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0#1": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#2": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL#1": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0#1": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0#1": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0#1": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD#1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD#2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-3-Clause#1": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC#1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0#1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense#1": "This is free and unencumbered software released into the public domain.",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TABLE = 1 << 16


def bands_for(resemblance: float, probability: float) -> int:
    """The least number of one-row bands with which windows of this resemblance collide at that probability."""
    return math.ceil(math.log(1 - probability) / math.log(1 - resemblance)) if resemblance < 1 else 1


class Scanner:
    """Templates arranged by size class, with the tables of their band values."""

    def __init__(self, templates: Mapping[str, str], width: int, share: float, probability: float):
        self.width, self.share = width, share
        self.names = sorted(templates)
        hashes, first, _, _ = tx.words([templates[n].encode() for n in self.names], _WORD)
        runs, bounds = tx.shingle_hashes(hashes, first, width)
        self.sets = [np.unique(runs[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.classes = []
        sizes = np.array([len(s) for s in self.sets])
        for power in sorted({int(s).bit_length() for s in sizes if s}):
            own = [i for i, s in enumerate(sizes) if s and int(s).bit_length() == power]
            block, least = int(max(sizes[own])), int(min(sizes[own]))
            # A template is found with `needed` of its shingles at least.
            lowest = min(math.ceil(share * t) / (2 * block + t - math.ceil(share * t)) for t in range(least, block + 1))
            count = bands_for(lowest, probability)
            rng = np.random.default_rng(power)
            factors = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            tables, owners = [], []
            for f in factors:
                table, owner = np.zeros(_TABLE, bool), {}
                for i in own:
                    value = int(((self.sets[i] * f) >> np.uint64(16)).min())
                    table[value % _TABLE] = True
                    owner.setdefault(value, []).append(i)
                tables.append(table)
                owners.append(owner)
            self.classes.append((block, factors, tables, owners))

    def scan(self, texts: list[bytes]) -> list[tuple[int, str, float, int, int]]:
        """(text, template, share, first byte, end byte) of the occurrences, overlapping ones of a template merged."""
        hashes, first, start, end = tx.words(texts, _WORD)
        runs, bounds = tx.shingle_hashes(hashes, first, self.width)
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        sizes = np.diff(bounds)
        some = np.flatnonzero(sizes)
        if not len(some):
            return []
        for block, factors, tables, owners in self.classes:
            # Blocks of each text; the last one of a text may be short.
            blocks = -(-sizes[some] // block)
            text = np.repeat(some, blocks)
            begin = np.concatenate(([0], np.cumsum(blocks)))
            opens = bounds[text] + block * (np.arange(begin[-1]) - np.repeat(begin[:-1], blocks))
            next_too = np.append(text[1:] == text[:-1], False)
            hits = set()
            for f, table, owner in zip(factors, tables, owners, strict=True):
                least = np.minimum.reduceat((runs * f) >> np.uint64(16), opens)
                both = least.copy()
                both[:-1] = np.where(next_too[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
                for w in np.flatnonzero(table[(both % np.uint64(_TABLE)).astype(np.int64)]):
                    for i in owner.get(int(both[w]), ()):
                        hits.add((int(w), i))
            for w, i in sorted(hits):
                t, a = int(text[w]), int(opens[w])
                z = min(a + 2 * block, int(bounds[t + 1]))
                inside = np.isin(runs[a:z], self.sets[i])
                share = len(np.unique(runs[a:z][inside])) / len(self.sets[i])
                if share >= self.share:
                    at = np.flatnonzero(inside) + a - bounds[t]
                    found.setdefault((t, i), []).append((int(at[0]), int(at[-1]), share))
        out = []
        for (t, i), spans in sorted(found.items()):
            spans.sort()
            merged = [list(spans[0])]
            for a, z, share in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1:] = max(z, merged[-1][1]), max(share, merged[-1][2])
                else:
                    merged.append([a, z, share])
            for a, z, share in merged:
                last = min(int(first[t]) + z + self.width, int(first[t + 1])) - 1
                out.append((t, self.names[i], share, int(start[first[t] + a]), int(end[last])))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: float = 0.75, probability: float = 0.999) -> DataFrame:
    """(doc_id, license, template, share, start, end) for every occurrence of a template; offsets in code points."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "license", "template", "share", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(templates, width, share, probability)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for at, part in tx.slices(batch.column(1).to_pylist()):
                for t, name, held, a, z in own.scan(part):
                    before = len(part[t][:a].decode("utf-8", "surrogatepass"))
                    out.append((ids[at + t], name.split("#")[0], name, held, before, before + len(part[t][a:z].decode("utf-8", "surrogatepass"))))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id long, license string, template string, share double, start long, end long")
