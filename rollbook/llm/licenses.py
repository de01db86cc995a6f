"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment confirms them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .decontaminate import plain_words

#: Fixed wording of common license notices, short and long, by name.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Released under the GNU General Public License v2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Licensed under the terms of the MIT license."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Licensed under the BSD License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Attribution licenses: abbreviation and the words of the full name.
_COMMONS = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_IDENTIFIERS = (
    "Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "Unlicense",
)


def templates() -> tuple[tuple[str, str], ...]:
    """All notices, those of the attribution licenses 3.0 and 4.0, and machine-readable tags; tags name the plain license."""
    made = list(NOTICES)
    for short, name in _COMMONS:
        for version, scope in (("4.0", "International"), ("3.0", "Unported")):
            own = f"CC-{short}-{version}"
            made += [
                (own, f"Licensed under CC {short} {version}."),
                (own, f"This work is licensed under a Creative Commons {name} {version} {scope} License."),
                (own, f"Licensed under the Creative Commons {name} {version} license."),
            ]
    made += [(x.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {x}") for x in _IDENTIFIERS]
    return tuple(made)


TEMPLATES = templates()


@dataclass(frozen=True)
class Scan:
    """Bands of `rows` hashes each; a window as near as `similarity` shares a band with probability 1 - (1 - s^rows)^bands."""

    shingle: int = 2  # words
    bands: int = 16
    rows: int = 1
    similarity: float = 0.4  # for this one, 16 bands of 1 find 99.97 %
    containment: float = 0.8
    seed: int = 7

    def found(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def _shingles(own: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` word hashes."""
    n = max(0, len(own) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Index:
    """Templates by the bands of their signatures; windows are as long as the templates they may hold."""

    def __init__(self, templates: Sequence[tuple[str, str]], scan: Scan):
        self.scan = scan
        words = [plain_words(t) for _, t in templates]
        self.names = [name for name, _ in templates]
        self.sets = [np.unique(_shingles(_hashes(w), scan.shingle)) for w in words]
        draw = np.random.default_rng(scan.seed)
        hashes = scan.bands * scan.rows
        self.a = draw.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, hashes, dtype=np.uint64)
        #: One pass for each size of windows; a template belongs to the smallest that holds it.
        self.sizes: dict[int, dict[tuple[int, int], list[int]]] = {}
        for i, own in enumerate(self.sets):
            if not len(own):
                continue
            width = 1 << max(2, int(np.ceil(np.log2(len(own)))))
            bands = self.sizes.setdefault(width, {})
            for key in enumerate(self._bands(self.signature(own, np.array([0])))[0].tolist()):
                bands.setdefault(key, []).append(i)
        #: Low bits of the bands' keys, to pass over nearly all windows before the exact keys are looked up.
        self.low = {w: np.zeros((scan.bands, 65_536), bool) for w in self.sizes}
        for width, bands in self.sizes.items():
            for band, key in bands:
                self.low[width][band, key & 0xFFFF] = True

    def signature(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Minimum of each hash over the stretches that begin at `starts`, one row a stretch."""
        out = np.empty((len(starts), len(self.a)), np.uint64)
        for k in range(len(self.a)):
            out[:, k] = np.minimum.reduceat((shingles * self.a[k] + self.b[k]) >> np.uint64(16), starts)
        return out

    def _bands(self, signature: np.ndarray) -> np.ndarray:
        parts = signature.reshape(len(signature), self.scan.bands, self.scan.rows)
        key = np.zeros(parts.shape[:2], np.uint64)
        for k in range(self.scan.rows):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k]
        return key

    def search(self, texts: list[str | None]) -> list[tuple[int, str, float, int]]:
        """(text, license, containment, first word) of the best confirmed window of each text and license.

        Where windows of several licenses overlap, the one whose template is held more fully counts, or, if equally, the
        longer template: a version 3 notice is no version 2 notice with a word changed.
        """
        each = [_shingles(_hashes(plain_words(t)), self.scan.shingle) for t in texts]
        sizes = np.array([len(x) for x in each], np.int64)
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate(each) if each else np.empty(0, np.uint64)
        hits: dict[int, list[tuple[float, int, int, int, int]]] = {}
        blocks, block = None, 0
        for width, bands in sorted(self.sizes.items()) if len(flat) else ():
            # Blocks of half a window, laid out text by text; a template lies whole in one, two or three of them. Those of
            # the next size are pairs of these.
            if blocks is None:
                block = width // 2
                counts = -(-sizes // block)
                text = np.repeat(np.arange(len(sizes)), counts)
                place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                blocks = self.signature(flat, begin[text] + block * place)
            while block < width // 2:
                first = np.flatnonzero(place % 2 == 0)
                blocks = np.minimum.reduceat(blocks, first, axis=0)
                text, place, block = text[first], place[first] // 2, 2 * block
            starts = begin[text] + block * place
            for span in (1, 2, 3):
                n = len(starts) - span + 1
                whole = text[:n] == text[span - 1 :] if n > 0 else np.empty(0, bool)
                joined = np.minimum.reduce([blocks[k : n + k] for k in range(span)]) if n > 0 else blocks[:0]
                keys = self._bands(joined)
                tried = set()
                for band in range(self.scan.bands):
                    for at in np.flatnonzero(self.low[width][band][keys[:, band] & np.uint64(0xFFFF)] & whole).tolist():
                        for item in bands.get((band, int(keys[at, band])), ()):
                            if (at, item) in tried:
                                continue
                            tried.add((at, item))
                            owner, start = int(text[at]), int(starts[at])
                            stop = min(start + span * block, int(begin[owner] + sizes[owner]))
                            held = np.flatnonzero(np.isin(flat[start:stop], self.sets[item]))
                            share = len(np.unique(flat[start + held])) / len(self.sets[item])
                            if share >= self.scan.containment:
                                hits.setdefault(owner, []).append((share, len(self.sets[item]), item, start + int(held[0]), start + int(held[-1])))
        found = []
        for owner, own in sorted(hits.items()):
            kept: list[tuple[float, int, int, int, int]] = []
            for hit in sorted(own, key=lambda x: (-x[0], -x[1], x[3], x[2])):
                if not any(hit[3] <= k[4] and k[3] <= hit[4] and self.names[k[2]] != self.names[hit[2]] for k in kept):
                    kept.append(hit)
            best: dict[str, tuple[float, int]] = {}
            for share, _, item, start, _ in kept:
                best.setdefault(self.names[item], (share, start - int(begin[owner])))
            found += [(owner, name, share, at) for name, (share, at) in sorted(best.items())]
        return found


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, setting: Scan = Scan()) -> DataFrame:
    """Licenses found in each row: doc_id, license, containment, first_word; one row a document and license.

    Windows of one, two and three half-windows of a template's size overlap over the whole text; those that share a band
    with a template are compared by the share of the template's shingles they hold, and where windows overlap the better
    one counts. `first_word` is where the notice begins. Null and empty texts hold none; a very long text is laid out as a
    whole, with the few texts beside it; repeated rows and rows without id return as often as they come; an empty table
    gives an empty result; extra columns are ignored. `templates` is a short list and travels with the task; nothing is
    shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, setting)
        for part in chunks(batches):
            found = index.search(part.column(1).to_pylist())
            at, out = [x[0] for x in found], [x[1:] for x in found]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *columns], ["doc_id", "license", "containment", "first_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, containment double, first_word bigint")
