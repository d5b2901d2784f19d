"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies them.

A window is WINDOW shingles of WIDTH words; windows start every STRIDE shingles and so overlap in words. A band is the
smallest hash of a window under one of BANDS permutations. A text that holds at least LEAST of the shingles of a
template in order has a run of STRIDE + WINDOW - 1 of them without a gap if the template has eight shingles or more: a
changed word costs four shingles at least. Some window lies within that run, equals a window of the template, and
collides in every band. A window of similarity s collides in some band with probability 1 - (1 - s) ** BANDS, 0.97 for
three shingles out of four. Templates of fewer shingles are retrieved by windows of a single shingle, whose smallest
hash is the shingle's own, so that they collide for certain.
"""

from __future__ import annotations

from collections.abc import Mapping

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import missing, stage

WIDTH = 5
WINDOW = 4
STRIDE = 4
LEAST = 0.8
SEED = 42
# Permutations of the hashes: each flips other bits.
PERMUTATIONS = (0, 0x5555555555555555, 0x33CC33CC33CC33CC, 0x1234567890ABCDEF)
BANDS = len(PERMUTATIONS)
SHORT = STRIDE + WINDOW
# Keys of templates in one pass over the documents; more templates take more passes.
KEYS_AT_ONCE = 4000
NO_WORD = r"[^\p{L}\p{N}]+"

# Notices as licenses prescribe or commonly word them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-grant": "This is free and unencumbered software released into the public domain.",
}
# Notices of fewer than WIDTH words, each a single shingle of its own length.
SHORT_NOTICES: dict[str, str] = {
    "All-rights-reserved": "All rights reserved.",
    "ISC-tag": "SPDX-License-Identifier: ISC",
    "MIT-tag": "SPDX-License-Identifier: MIT",
    "Unlicense-tag": "SPDX-License-Identifier: Unlicense",
}


def _words(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    if not words:
        raise ValueError(f"a template without words: {text!r}")
    return words


def width_of(text: str) -> int:
    """The words in a shingle of a template: WIDTH, or all of a shorter template."""
    return min(WIDTH, len(_words(text)))


def shingles(text: str) -> list[str]:
    """The distinct shingles of a template, in order; fewer than WIDTH words are one shingle."""
    words, width = _words(text), width_of(text)
    return list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(len(words) - width + 1)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def template_keys(text: str) -> set[int]:
    """The keys of a template's windows, as ``_window_keys`` gives them for a document."""
    found = [_signed(xxhash.xxh64_intdigest(s.encode(), SEED)) for s in shingles(text)]
    if len(found) < SHORT:
        return set(found)
    keys = set()
    for at in range(len(found) - WINDOW + 1):
        for band, flip in enumerate(PERMUTATIONS):
            keys.add(min(h ^ flip for h in found[at : at + WINDOW]) ^ (band + 1))
    return keys


def _window_keys(hashes: Column) -> Column:
    """The keys of a document's windows of WINDOW shingles."""
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW, F.lit(STRIDE))

    def band(i: Column, number: int) -> Column:
        flip = F.lit(PERMUTATIONS[number])
        members = [F.get(hashes, i + k).bitwiseXOR(flip) for k in range(WINDOW)]
        return F.least(*members).bitwiseXOR(F.lit(number + 1))

    windows = F.flatten(F.transform(starts, lambda i: F.array(*[band(i, n) for n in range(BANDS)])))
    return F.when(F.size(hashes) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def _slices(templates: Mapping[str, str]) -> list[dict[str, set[int]]]:
    slices: list[dict[str, set[int]]] = [{}]
    for name, text in templates.items():
        keys = template_keys(text)
        if slices[-1] and sum(map(len, slices[-1].values())) + len(keys) > KEYS_AT_ONCE:
            slices.append({})
        slices[-1][name] = keys
    return slices


def _hashed(rows: DataFrame, width: int) -> DataFrame:
    rows = rows.filter(F.size("words") >= width)
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("words") - width),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(width)])),
    )
    return stage(rows, hashes=hashes)


def _scanned(hashed: DataFrame, templates: Mapping[str, str], keys: Mapping[str, set[int]], width: int) -> DataFrame:
    short = {n for n in keys if len(shingles(templates[n])) < SHORT}
    none = F.array().cast("array<bigint>")
    sought = lambda names: sorted({k for n in names for k in keys[n]})
    singles, windows = sought(short), sought(set(keys) - short)
    hits = lambda column, wanted: F.filter(column, lambda h: h.isin(*wanted)) if wanted else none
    met = stage(hashed, met=F.concat(hits(F.col("hashes"), singles), hits(_window_keys(F.col("hashes")), windows)))
    met = stage(met.filter(F.size("met") > 0), met_once=F.array_distinct("met")).drop("met")
    known = F.array(
        *[
            F.struct(
                F.lit(n).alias("license_id"),
                F.array(*[F.lit(k) for k in sorted(keys[n])]).alias("keys"),
                F.array(*[F.lit(s) for s in shingles(templates[n])]).alias("shingles"),
            )
            for n in keys
        ]
    )
    retrieved = F.filter(known, lambda t: F.arrays_overlap(t["keys"], F.col("met_once")))
    own = F.transform(
        F.sequence(F.lit(0), F.size("words") - width),
        lambda i: F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(width)]),
    )
    found = stage(met, own=own, retrieved=retrieved)
    found = found.select("row", "own", F.inline("retrieved"))
    found = stage(found, shared=F.size(F.array_intersect("shingles", "own")))
    found = found.withColumn("containment", F.col("shared") / F.size("shingles")).filter(F.col("containment") >= LEAST)
    first = F.array_position(F.transform("own", lambda s: F.array_contains("shingles", s)), F.lit(True)) - 1
    return found.select("row", "license_id", F.col("shared").cast("long"), "containment", first.alias("first_word"))


def scan_licenses(
    docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", templates: Mapping[str, str] = TEMPLATES
) -> DataFrame:
    """The license templates that each document holds, found without user functions and without a shuffle.

    A row for each document and template of which the document holds LEAST of the distinct shingles or more: ``keys``,
    ``license_id``, ``shared`` (shingles), ``containment`` and ``first_word``, the place of the first shared shingle
    in the document. Words are runs of letters and digits, in lower case.

    * NULL and empty texts, and those with fewer words than a shingle of the template, give no row.
    * NULL keys are kept; repeated rows are scanned one by one and give repeated rows.
    * A template that occurs many times in a document gives one row. Very long texts are scanned whole.
    * A template of fewer than WIDTH words is one shingle of its own length, so it is held whole or not at all; each
      such length takes a pass. Any number of templates is taken, KEYS_AT_ONCE keys in a pass.
    * Other columns are ignored, whatever their names. An empty table, or no template, gives no rows.
    """
    missing(docs, text, *keys)
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.array_remove(F.split(body, NO_WORD), "")
    rows = stage(docs.select(F.struct(*keys).alias("row"), F.col(text)), words=words).select("row", "words")
    widths: dict[int, dict[str, str]] = {}
    for name, body in templates.items():
        widths.setdefault(width_of(body), {})[name] = body
    parts = [
        _scanned(_hashed(rows, width), alike, part, width)
        for width, alike in widths.items()
        for part in _slices(alike)
    ]
    if not parts:
        kind = rows.schema["row"].dataType.simpleString()
        schema = f"row {kind}, license_id string, shared long, containment double, first_word long"
        parts = [docs.sparkSession.createDataFrame([], schema)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("row.*", "license_id", "shared", "containment", "first_word")
