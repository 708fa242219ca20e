"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates (license notices) fall into size classes. For a class of up to C words, texts are read
in windows of C + S words at every S = C / 4 words, so any run of C words lies in some window. A
window and a template are candidates if any of ``BANDS`` one-row bands, that is any of as many
MinHash values over five-word shingles, agree. A window that contains 80 % of a template's
shingles has a Jaccard similarity of at least 1/3 with it (sizes are within 1.5), so it is missed
with a probability below (2/3) ** 32 = 2.4e-6. Candidates are decided by their words.

The scan is one pass over whole texts without any shuffle: templates go to every task, texts don't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
LEAST = 0.8
BANDS = 32
#: Bytes of text hashed at a time; a longer text goes in pieces that overlap.
CHUNK = 1 << 20

# Notices as the licenses' own texts and common practice word them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    # fragments of the notices that hold their version: whole notices of two versions are alike by over LEAST
    "GPL-3.0": "the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-2.0": "the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
    "LGPL-3.0": "the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-2.1": "the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License",
    "AGPL-3.0": "the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-3.0-notice": "GNU General Public License, version 3",
    "GPL-2.0-notice": "GNU General Public License, version 2",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-warranty": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-licensed-notice": "Licensed under the MIT License.",
    "BSD-2-or-3-Clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "Apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "GPL-2.0-only-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "GPL-2.0-or-later-spdx": "SPDX-License-Identifier: GPL-2.0-or-later",
    "GPL-3.0-only-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "GPL-3.0-or-later-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "LGPL-2.1-only-spdx": "SPDX-License-Identifier: LGPL-2.1-only",
    "LGPL-2.1-or-later-spdx": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "LGPL-3.0-only-spdx": "SPDX-License-Identifier: LGPL-3.0-only",
    "LGPL-3.0-or-later-spdx": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "AGPL-3.0-only-spdx": "SPDX-License-Identifier: AGPL-3.0-only",
    "AGPL-3.0-or-later-spdx": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "BSD-2-Clause-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "MPL-2.0-spdx": "SPDX-License-Identifier: MPL-2.0",
    "CC0-1.0-spdx": "SPDX-License-Identifier: CC0-1.0",
    "CC-BY-4.0-spdx": "SPDX-License-Identifier: CC-BY-4.0",
    "CC-BY-SA-4.0-spdx": "SPDX-License-Identifier: CC-BY-SA-4.0",
}

# Notices of fewer than SHINGLE words, which are found whole.
NOTICES = {
    "All-rights-reserved-notice": "All rights reserved.",
    "CC0-notice": "Licensed under CC0.",
    "ISC-spdx": "SPDX-License-Identifier: ISC",
    "MIT-spdx": "SPDX-License-Identifier: MIT",
    "Unlicense-spdx": "SPDX-License-Identifier: Unlicense",
}
ALL = TEMPLATES | NOTICES

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
    return up, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes."""
    inside = _IS_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edges[::2], edges[1::2]


def shingle_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of all runs of ``size`` words, from prefix sums of a polynomial over the bytes."""
    if len(starts) < size:
        return np.empty(0, np.uint32)
    n = 1 << max(20, (len(data) - 1).bit_length())
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        words = _mixed((sums[ends] - sums[starts]) * down[starts])
        out = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            out = out * np.uint64(_BASE) + words[k : len(words) - size + 1 + k]
        return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def _constants(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, bands, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, bands, dtype=np.uint32)


def _permuted(x: np.ndarray, a: np.uint32, b: np.uint32) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x * a + b
        return y ^ (y >> np.uint32(15))


class Templates:
    """Templates by size class, with the band values that retrieve them."""

    def __init__(self, templates: dict[str, str], size: int = SHINGLE, bands: int = BANDS):
        self.size, self.bands = size, bands
        self.names = sorted(templates)
        words = [WORD.findall(templates[n].encode().translate(_LOWER)) for n in self.names]
        if short := [n for n, w in zip(self.names, words, strict=True) if len(w) < size]:
            raise ValueError(f"templates of fewer than {size} words: {short}")
        self.shingles = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in words]
        self.a, self.b = _constants(bands)
        edges = [size + 1]
        while edges[-1] < max(map(len, words), default=0):
            edges.append(edges[-1] + edges[-1] // 2)
        self.classes: list[tuple[int, int, list[dict[int, list[int]]], list[np.ndarray]]] = []
        for low, c in zip([0, *edges], edges, strict=False):
            members = [k for k, w in enumerate(words) if low < len(w) <= c]
            if not members:
                continue
            values: list[dict[int, list[int]]] = [{} for _ in range(bands)]
            tables = [np.zeros(1 << 16, bool) for _ in range(bands)]
            for k in members:
                data = b" ".join(words[k])
                h = shingle_hashes(data, *word_spans(data), size)
                for band in range(bands):
                    v = int(_permuted(h, self.a[band], self.b[band]).min())
                    values[band].setdefault(v, []).append(k)
                    tables[band][v >> 16] = True
            self.classes.append((c, max(1, c // 4), values, tables))

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int, int]]:
        """(first word, words, template) of windows that share a band value with a template."""
        found = set()
        n = len(hashes)
        for band in range(self.bands):
            y = _permuted(hashes, self.a[band], self.b[band])
            for c, step, values, tables in self.classes:
                # a window of c + step words has shingles in this many blocks of step shingles
                width, blocks = -(-(c + step - self.size + 1) // step), np.arange(0, n, step)
                least = np.minimum.reduceat(y, blocks) if step > 1 else y
                low = least
                for k in range(1, width):
                    low = np.minimum(low, np.concatenate([least[k:], np.full(min(k, len(least)), 0xFFFFFFFF, np.uint32)]))
                for w in np.flatnonzero(tables[band][low >> np.uint32(16)]):
                    for k in values[band].get(int(low[w]), ()):
                        found.add((int(w) * step, width * step + self.size - 1, k))
        return found


def scan(docs: list[tuple[int, bytes]], templates: Templates, least: float = LEAST) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first word, words of the window) for the best window of each match."""
    if not docs:
        return []
    data = b" ".join(d for _, d in docs)
    starts, ends = word_spans(data)
    limits = np.cumsum([len(d) + 1 for _, d in docs])
    of_word = np.searchsorted(limits, starts, side="right")
    first = np.searchsorted(of_word, np.arange(len(docs)))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for at, count, k in sorted(templates.candidates(shingle_hashes(data, starts, ends, templates.size))) if len(starts) >= templates.size else ():
        last = min(at + count, len(starts))
        for doc in range(of_word[at], of_word[last - 1] + 1):
            a, b = max(at, first[doc]), min(last, first[doc + 1] if doc + 1 < len(docs) else len(starts))
            words = [data[starts[i] : ends[i]] for i in range(a, b)]
            own = {tuple(words[i : i + templates.size]) for i in range(len(words) - templates.size + 1)}
            share = len(own & templates.shingles[k]) / len(templates.shingles[k])
            if share >= least and share > best.get((doc, k), (0.0,))[0]:
                best[doc, k] = (share, int(a - first[doc]), int(b - a))
    return [(docs[doc][0], k, *x) for (doc, k), x in sorted(best.items())]


class Notices:
    """Templates of fewer words than a shingle: their one shingle is all their words."""

    def __init__(self, templates: dict[str, str]):
        self.patterns = []
        for name, text in sorted(templates.items()):
            words = WORD.findall(text.encode().translate(_LOWER))
            if not words:
                raise ValueError(f"template without words: {name}")
            inner = rb"[^0-9a-z\x80-\xff]+".join(words)
            self.patterns.append((name, len(words), max(words, key=len), re.compile(rb"(?<![0-9a-z\x80-\xff])" + inner + rb"(?![0-9a-z\x80-\xff])")))

    def scan(self, row: int, data: bytes) -> Iterator[tuple[int, str, float, int, int]]:
        """(row, name, containment, first word, words) of the first place of each notice in lower-cased bytes."""
        for name, count, longest, pattern in self.patterns:
            if longest in data and (found := pattern.search(data)):
                yield row, name, 1.0, len(WORD.findall(data, 0, found.start())), count


def long_pieces(data: bytes, overlap: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(words before it, piece) of lower-cased bytes: pieces of about ``most`` bytes, cut between words, that share ``overlap`` words."""
    at, words = 0, 0
    while True:
        end = at + most
        if end >= len(data):
            yield words, data[at:]
            return
        while end < len(data) and _IS_WORD[data[end]]:
            end += 1
        piece = data[at:end]
        starts, _ = word_spans(piece)
        yield words, piece
        again = max(0, len(starts) - overlap)
        if not again:  # fewer words than the overlap: the next piece begins at the last but one half
            again = len(starts) // 2
        words += again
        at += int(starts[again]) if again < len(starts) and again else len(piece)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """Licenses found in ``docs`` (doc_id, text): doc_id, license, containment, first_word, n_words.

    A row for each row of ``docs`` and template of which some window holds at least ``least`` of
    the five-word shingles; containment and place are those of the first best window. A template of
    fewer words is found where all its words stand in a row. Words are
    runs of a-z (A-Z lowered), 0-9 and non-ASCII characters. Null and empty texts match nothing;
    repeated rows are reported each; an empty table gives no rows. A text of over ``CHUNK`` bytes is
    read whole too, in pieces that share as many words as the largest window has.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = templates or TEMPLATES
    short = {n: t for n, t in given.items() if len(WORD.findall(t.encode().translate(_LOWER))) < SHINGLE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, notices = Templates({n: t for n, t in given.items() if n not in short}, SHINGLE, bands), Notices(short)
        named = lambda rows: [(row, ready.names[k], *x) for row, k, *x in rows]
        overlap = max([c + step for c, step, _, _ in ready.classes], default=0) + SHINGLE

        def scan_long(row: int, data: bytes) -> list[tuple]:
            best: dict[int, tuple[float, int, int]] = {}
            for before, piece in long_pieces(data, overlap, CHUNK):
                for _, k, share, first, count in scan([(row, piece)], ready, least):
                    if share > best.get(k, (0.0,))[0]:
                        best[k] = (share, first + before, count)
            return [(row, k, *x) for k, x in sorted(best.items())]
        for batch in batches:
            found, held, size = [], [], 0
            for row, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER)
                if held and size + len(data) > CHUNK:
                    found += named(scan(held, ready, least))
                    held, size = [], 0
                found += notices.scan(row, data)
                if len(data) > CHUNK:
                    found += named(scan_long(row, data))
                    continue
                held.append((row, data))
                size += len(data) + 1
            found += named(scan(held, ready, least))
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                ["doc_id", "license", "containment", "first_word", "n_words"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, license string, containment double, first_word bigint, n_words bigint")
