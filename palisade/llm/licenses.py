"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance
from the nearest ancestor directory by joins of paths.

Every line of a text is compared with every template, by one sparse product per batch: only words of
the templates' vocabulary (fixed in size) can add to a cosine, all other words add to the norm.  Every word is
weighed by its count in the line and its document frequency over all texts: a template's words exactly,
all others by hashed features, whose number is fixed, so the frequencies are bounded whatever the texts hold.
Neighbouring lines that resemble a template are read as one block, so licence texts of many lines count whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import text as tx
from palisade.llm.language_id import folded
from palisade.session import stored

# Common notices of licences, by SPDX identifier where there is one.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("Released under CC0 1.0 Universal, dedicated to the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."),
}

#: Least cosine of a line or block to a template.
SIMILARITY = 0.75
#: Least cosine of a line that is joined with its neighbours.
NEIGHBOUR = 0.3
#: A document is a licence file if licence lines hold at least this share of its words.
FILE_SHARE = 0.3

#: Hashed features of the words that no template holds.
FEATURES = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Vocabulary(NamedTuple):
    terms: np.ndarray  # sorted hashes of the templates' words
    texts: list[str]  # one word for each hash
    names: list[str]  # licence of each template
    counts: np.ndarray  # templates × terms


def _tokens(texts: pa.Array) -> tuple[tx.Words, np.ndarray, np.ndarray]:
    """Words (runs of letters and digits in lower case), their hashes, and the line each is in."""
    bounds, data = tx._bounds(texts)
    data = folded(data[bounds[0] : bounds[-1]])
    bounds = bounds - bounds[0]
    inside = np.concatenate([_WORD[data], [False]])
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero((before & (~inside | first)))
    words = tx.Words(starts, ends, np.searchsorted(starts, bounds), data)
    breaks = np.sort(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]), kind="stable")
    return words, words.hashes(), np.searchsorted(breaks, starts, "right") - 1


def vocabulary(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Vocabulary:
    names = [name for name, texts in templates.items() for _ in texts]
    words, hashes, _ = _tokens(pa.array([x for texts in templates.values() for x in texts], pa.large_string()))
    terms, at = np.unique(hashes, return_index=True)
    counts = np.zeros((len(names), len(terms)))
    np.add.at(counts, (tx.spread(words.counts()), np.searchsorted(terms, hashes)), 1)
    texts = [words.data[words.starts[i] : words.ends[i]].tobytes().decode() for i in at]
    return Vocabulary(terms, texts, names, counts)


def _numbers(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each word's feature: its place among the templates' terms, or behind them by hash."""
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at, len(terms) + (hashes % np.uint64(FEATURES)).astype(np.int64))


def document_frequencies(docs: DataFrame, known: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts that hold each feature; counted over all rows, added up by feature."""
    features = len(known.terms) + FEATURES

    def count(batches):
        total, found = 0, np.zeros(features, np.int64)
        for batch in batches:
            texts = tx.string_column(batch, "text")
            for a, b in tx.chunks(texts):
                words, hashes, _ = _tokens(texts.slice(a, b - a))
                pairs = np.unique(tx.spread(words.counts()) * features + _numbers(known.terms, hashes))
                np.add.at(found, pairs % features, 1)
                total += b - a
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(found[held], total))], names=["feature", "n"]
        )

    rows = docs.select("text").where("text is not null").mapInArrow(count, "feature long, n long")
    sums = rows.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = (np.asarray(sums.column(c).combine_chunks()) for c in ("feature", "n"))
    frequency = np.zeros(features, np.int64)
    frequency[feature[feature >= 0]] = n[feature >= 0]
    return int(n[feature < 0].sum()), frequency


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``docs`` without text but with ``license``, ``score`` and ``share``.

    ``license`` is that of the line, or block of neighbouring lines, with the highest cosine to a template, ``score``
    the cosine; null and 0 where none reaches ``SIMILARITY``.  ``share`` is the share of the text's words that
    stand in such lines and blocks.  Ties go to the earlier line, then to the earlier template.  Null and
    empty texts have no licence.  Other columns pass through; those named like a result are replaced.
    """
    results = ("license", "score", "share")
    docs = docs.drop(*results)
    carried = [c for c in docs.columns if c != "text"]
    known = vocabulary(templates)
    texts_read, frequency = document_frequencies(docs, known)
    idf = np.log((texts_read + 1) / (frequency + 1)) + 1
    weights = known.counts * idf[: len(known.terms)]
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)

    def cosines(line: np.ndarray, term: np.ndarray, lines: int) -> np.ndarray:
        """Lines × templates."""
        pairs, times = np.unique(line * len(idf) + term, return_counts=True)
        of, term_of = pairs // len(idf), pairs % len(idf)
        value = times * idf[term_of]
        norm = np.bincount(of, value**2, lines)
        mine = term_of < len(known.terms)
        out = np.zeros((lines, len(known.names)))
        np.add.at(out, of[mine], value[mine][:, None] * weights.T[term_of[mine]])
        return out / np.sqrt(np.maximum(norm, 1e-12))[:, None]

    def run(batches):
        for batch in batches:
            texts = tx.string_column(batch, "text")
            for a, b in tx.chunks(texts):
                part = batch.slice(a, b - a)
                words, hashes, line = _tokens(texts.slice(a, b - a))
                counts = words.counts()
                owner, term = tx.spread(counts), _numbers(known.terms, hashes)
                # Only lines with words of a template can resemble one.
                kept = np.flatnonzero(np.isin(line, line[term < len(known.terms)]))
                ids, row = np.unique(line[kept], return_inverse=True)
                found = cosines(row, term[kept], len(ids))
                text_of = np.zeros(len(ids), np.int64)
                text_of[row] = owner[kept]
                close = found.max(1, initial=0) >= NEIGHBOUR
                joined = np.zeros(len(ids), bool)
                joined[1:] = close[1:] & close[:-1] & (ids[1:] == ids[:-1] + 1) & (text_of[1:] == text_of[:-1])
                block = np.cumsum(~joined) - 1
                whole = cosines(block[row], term[kept], int(block[-1]) + 1 if len(block) else 0)
                best = np.maximum(found, whole[block]) if len(ids) else found
                top = best.max(1, initial=0)
                hit = top >= SIMILARITY
                share = np.bincount(owner[kept], hit[row], b - a) / np.maximum(counts, 1)
                score, license_of = np.zeros(b - a), np.full(b - a, None, object)
                for i in np.flatnonzero(hit):
                    if top[i] > score[text_of[i]]:
                        score[text_of[i]] = top[i]
                        license_of[text_of[i]] = known.names[int(best[i].argmax())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array(license_of, pa.string()),
                        pa.array(np.minimum(score, 1.0)),
                        pa.array(share),
                    ],
                    names=[*carried, *results],
                )

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return docs.select(*carried, "text").mapInArrow(run, f"{schema}license string, score double, share double")


def inherit(files: DataFrame) -> DataFrame:
    """``files (path, license, score, is_license_file)`` with ``effective_license``, ``origin`` and ``license_dir``.

    A file's own licence counts first (``origin`` 'own'); else that of the nearest directory on its path
    that holds a licence file ('inherited'); else none (null).  Of several licence files in a directory the
    highest score counts, then the first path.  Paths are joined on directories, which are far fewer than
    files; a directory's ancestors are bounded by its depth.  A null path inherits nothing.
    """
    files = files.drop("effective_license", "origin", "license_dir")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    placed = files.withColumn("directory_", F.when(F.col("path").isNotNull(), parent))
    given = (
        placed.where("is_license_file and license is not null and path is not null")
        .groupBy(F.col("directory_").alias("above"))
        .agg(F.min(F.struct((-F.col("score")).alias("rank"), "path", "license")).alias("it"))
        .select("above", F.col("it.license").alias("given"))
    )
    steps = F.split("directory_", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("above")))
    nearest = (
        placed.where("directory_ is not null")
        .select("directory_")
        .distinct()
        .select("directory_", F.inline(ancestors))
        .join(stored(given), "above")
        .groupBy("directory_")
        .agg(F.max(F.struct("depth", "given", "above")).alias("it"))
        .select("directory_", F.col("it.given").alias("given"), F.col("it.above").alias("license_dir"))
    )
    own = F.col("license").isNotNull()
    return placed.join(stored(nearest), "directory_", "left").select(
        *files.columns,
        F.coalesce("license", "given").alias("effective_license"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("license_dir")).alias("license_dir"),
    )
