"""License texts in documents: winnowed fingerprints, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.words import LETTERS, Words, blocks, windows

#: Words in a fingerprint, and fingerprints among which the smallest is kept.
GRAM, WINNOW = 3, 2
#: Words by which an alignment may leave its diagonal.
BAND = 8
#: Equal words that a finding needs at least, and share of the aligned words.
LEAST, IDENTITY = 4, 0.8

#: Notices as they are commonly written, by name.
TEMPLATES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED."
    ),
    "MIT-notice": "Released under the MIT License.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer."
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "GPL-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "CC-BY-NC-notice": "Licensed under CC BY-NC 4.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
}


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the smallest of each ``WINNOW`` neighbouring fingerprints."""
    if len(grams) <= WINNOW:
        return np.arange(len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def inverted_index(templates: dict[str, str]) -> dict:
    """Word hashes of the templates, and (template, place) by fingerprint, sorted."""
    names = sorted(templates)
    words = Words(pa.array([templates[n] for n in names], pa.string()), LETTERS)
    hashes = words.hashes(lower=True)
    own = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    prints: list[tuple[int, int, int]] = []
    for k, w in enumerate(own):
        grams, _ = windows(w, np.zeros(len(w), np.int64), GRAM)
        prints += [(int(grams[p]), k, int(p)) for p in winnow(grams)]
    prints.sort()
    return {"names": names, "words": own,
            "prints": np.array([p for p, _, _ in prints], np.uint64),
            "template": np.array([t for _, t, _ in prints], np.int64),
            "place": np.array([p for _, _, p in prints], np.int64)}


def banded(a: np.ndarray, b: np.ndarray, diagonal: int) -> list[tuple[int, int]]:
    """Equal pairs (place in a, place in b) of the best alignment near a diagonal.

    Local alignment (match 2, change or gap -1) over cells whose ``a - b`` is
    within ``BAND`` of ``diagonal``.
    """
    width = 2 * BAND + 1
    score = np.zeros((len(b) + 1, width + 2), np.int64)
    for j in range(1, len(b) + 1):
        # Column c stands for the place i = j + diagonal + c - BAND - 1 of a, counted from 1.
        i = j + diagonal + np.arange(width) - BAND
        inside = (i >= 1) & (i <= len(a))
        equal = np.zeros(width, bool)
        equal[inside] = a[i[inside] - 1] == b[j - 1]
        straight = score[j - 1, 1:-1] + np.where(equal, 2, -1)
        best = np.maximum(np.maximum(straight, score[j - 1, 2:] - 1), 0)
        # A gap in b runs along the row: the best of all scores to the left, less the way.
        ways = np.arange(width)
        best = np.maximum(best, np.maximum.accumulate(best + ways) - ways)
        score[j, 1:-1] = np.where(inside, best, 0)
    j, c = np.unravel_index(int(score.argmax()), score.shape)
    pairs = []
    while j > 0 and score[j, c] > 0:
        i = j + diagonal + (c - 1) - BAND
        equal = 1 <= i <= len(a) and a[i - 1] == b[j - 1]
        if score[j, c] == score[j - 1, c] + (2 if equal else -1):
            if equal:
                pairs.append((i - 1, j - 1))
            j -= 1
        elif score[j, c] == score[j - 1, c + 1] - 1:
            j, c = j - 1, c + 1
        else:
            c -= 1
    return pairs[::-1]


def close_parts(pairs: list[tuple[int, int]], least: int) -> list[list[tuple[int, int]]]:
    """Parts of an alignment that are equal enough, cut at its longest runs of unequal words."""
    out, parts = [], [pairs]
    while parts:
        part = parts.pop()
        if len(part) < least:
            continue
        ways = np.diff(np.array(part), axis=0).max(axis=1)
        if len(part) >= IDENTITY * max(part[-1][0] - part[0][0] + 1, part[-1][1] - part[0][1] + 1):
            out.append(part)
        else:
            k = int(ways.argmax()) + 1
            parts += [part[k:], part[:k]]
    return out


def _scan(texts: pa.Array, index: dict) -> list[tuple[int, str, float, int, int, int, int, int, int]]:
    """(row, name, coverage, first and last word of the template, words, characters)."""
    words = Words(texts, LETTERS)
    hashes = words.hashes(lower=True)
    grams, at = windows(hashes, words.doc, GRAM)
    if not len(grams) or not len(index["prints"]):
        return []
    low = np.searchsorted(index["prints"], grams)
    high = np.searchsorted(index["prints"], grams, side="right")
    near: dict[tuple[int, int, int], list[int]] = {}
    for g in np.flatnonzero(high > low):
        row = int(words.doc[at[g]])
        for k in range(low[g], high[g]):
            place = int(at[g] - words.first[row])
            near.setdefault((row, int(index["template"][k]), place - int(index["place"][k])), []).append(place)
    found: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
    for row, template, diagonal in sorted(near):
        seeds = near[row, template, diagonal]
        told = found.setdefault((row, template), [])
        b = index["words"][template]
        start = max(0, diagonal - BAND)
        a = hashes[words.first[row] + start : min(words.first[row + 1], words.first[row] + diagonal + len(b) + BAND)].copy()
        for s, e, *_ in told:  # a word is told once
            a[max(s - start, 0) : max(e - start, 0)] = 0
        while any(not any(s <= x and x + GRAM <= e for s, e, *_ in told) for x in seeds):
            parts = close_parts(banded(a, b, diagonal - start), min(LEAST, len(b)))
            for part in parts:
                told.append((start + part[0][0], start + part[-1][0] + 1, part[0][1], part[-1][1] + 1, len(part)))
                a[part[0][0] : part[-1][0] + 1] = 0
            if not parts:
                break
    out = []
    for (row, template), places in sorted(found.items()):
        for s, e, u, v, same in places:
            first, last = words.first[row] + s, words.first[row] + e - 1
            base = words.offsets[row]
            out.append((row, index["names"][template], same / len(index["words"][template]), u, v, s, e,
                        int(words.start[first] - base), int(words.end[last] - base)))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """Where each document holds a license text or a part of one.

    Three-word fingerprints of the templates, winnowed, form an inverted index;
    every window of a document is looked up in it.  Around the diagonal of a hit a
    banded local alignment finds the equal words; four at least (or the whole
    template) and 80 % of the aligned words make a finding; an alignment of less is
    cut at its longest run of unequal words and its parts are judged.

    Gives doc_id, license, coverage (equal words in the template's words),
    template_start and template_end, start_word and end_word, start_byte and
    end_byte in the UTF-8 text.  A license that occurs twice is told twice.  Null
    and wordless texts and texts without a finding give no row; repeated rows
    repeat theirs; a null doc_id stays null; other columns are not read.
    """
    index = inverted_index(TEMPLATES if templates is None else templates)
    schema = ("doc_id long, license string, coverage double, template_start int, template_end int, "
              "start_word int, end_word int, start_byte int, end_byte int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                rows = _scan(block.column(1), index)
                columns = list(zip(*rows, strict=True)) or [()] * 9
                kinds = [pa.string(), pa.float64()] + [pa.int32()] * 6
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(pa.array(columns[0], pa.int64())),
                     *(pa.array(list(c), k) for c, k in zip(columns[1:], kinds, strict=True))],
                    names=[f.split()[0] for f in schema.split(", ")],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.where("text is not null").mapInArrow(run, schema)
