"""License scan as an exact set-similarity join.

Text blocks are lines, and paragraphs: runs of lines between blank ones, so that a notice wrapped over
lines is found as well. (A line of comment marks alone is not blank.) Blocks and license templates are sets of
words; a block meets a template if it holds at least the threshold share of the template's words. All such pairs are found:

* words are ordered by how many lines of the whole corpus hold them, rarest first;
* prefix filter: an overlap of o words needs one of the template's first |T| - o + 1 words; these are in an
  inverted index, so that work follows the words that match, not the number of templates;
* length filter: a block with fewer than o words of the templates' vocabulary cannot hold o of T's;
* positional filter: words of T at or after its first match bound the overlap that is left.

Words in no template cannot match, so they are left out before counting: what is counted and ordered,
over every line of every document, is the templates' vocabulary. Templates are a parameter whose
size does not depend on the data.

Ids may be of any type. Nulls: a null text has no blocks; rows with a null id are reported with it. Blank lines are
blocks without words. A paragraph of one line is that line and not reported again. Repeated rows report
each block again. Blocks of any length are taken whole. A template without words matches nothing, templates of equal words
are each reported. An empty table gives an empty result; other columns, of any name, are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.arrowtext import distinct_in_rows, lowered, mapped, raw, slices, span_hash, words

THRESHOLD = 0.8
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution 4.0 International.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-2-Clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Proprietary": "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
}


def _vocabulary(templates: Mapping[str, str]) -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """(template names, sorted word hashes by name, all hashes sorted)."""
    sets = {}
    for name, text in templates.items():
        data, off = raw(lowered(pa.array([text])))
        s, e, _ = words(data[: off[1]], off)
        sets[name] = np.unique(span_hash(data[: off[1]], s, e))
    every = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]))
    return [n for n in templates if len(sets[n])], sets, every


def _required(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _paragraphs(part: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(newlines, paragraph of each line, lines in each paragraph, number within its row of each paragraph's first line).

    A row's lines follow each other: a word at s in row r is in line r + (newlines before s). o: bounds of the rows.
    """
    newline = np.flatnonzero(part == 10)
    row = np.searchsorted(o, newline, side="right") - 1
    rows = len(o) - 1
    n = rows + len(newline)
    first = np.arange(rows) + np.searchsorted(newline, o[:-1])
    start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start[first] = o[:-1]
    start[np.arange(len(newline)) + 1 + row] = newline + 1
    end[np.arange(rows) + np.searchsorted(newline, o[1:])] = o[1:]
    end[np.arange(len(newline)) + row] = newline
    text = np.concatenate([[0], np.cumsum(~_SPACE[part])])
    full = text[end] > text[start]
    opens = ~full
    opens[first] = True
    paragraph = np.cumsum(opens) - 1
    lines = np.bincount(paragraph[full], minlength=int(paragraph[-1]) + 1)
    own, at = np.unique(paragraph[full], return_index=True)
    at = np.flatnonzero(full)[at]
    begin = np.zeros(len(lines), np.int64)
    begin[own] = at - first[np.searchsorted(first, at, side="right") - 1]
    return newline, paragraph, lines, begin


def _blocks(batch: pa.Array, every: np.ndarray, lines_only: bool = False) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice and kind of block: kind, first row, row and number of each block that holds words of the vocabulary, (vocabulary index of its distinct words, bounds)."""
    data, off = raw(lowered(batch))
    for i, j in slices(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, _ = words(part, o)
        if not len(s):
            continue
        h = span_hash(part, s, e)
        at = np.searchsorted(every, h)
        at[at == len(every)] = 0
        hit = np.flatnonzero(every[at] == h)
        if not len(hit):
            continue
        newline, paragraph, lines, begin = _paragraphs(part, o)
        row = np.searchsorted(o, s[hit], side="right") - 1
        before = np.searchsorted(newline, s[hit])
        line = row + before
        number = before - np.searchsorted(newline, o[row])
        held = paragraph[line]
        for kind, block, no, live in (("line", line, number, np.ones(len(hit), bool)), ("paragraph", held, begin[held], lines[held] > 1))[: 1 if lines_only else 2]:
            x = np.flatnonzero(live)
            if len(x):
                first = np.append(np.flatnonzero(np.append(True, block[x][1:] != block[x][:-1])), len(x))
                word, _, bounds = distinct_in_rows(at[hit[x]], first)
                yield kind, i, row[x][first[:-1]], no[x][first[:-1]], word, bounds


def line_frequencies(df: DataFrame, text: str = "text", templates: Mapping[str, str] = TEMPLATES) -> dict[int, int]:
    """Number of lines of the whole corpus that hold each word of the templates, by the word's place in the vocabulary."""
    every = _vocabulary(templates)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(every), dtype=np.int64)
        for batch in batches if len(every) else ():
            for *_, word, _ in _blocks(batch.column(0), every, lines_only=True):
                n += np.bincount(word, minlength=len(every))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["word", "n"])

    counts = df.select(F.col(text).cast("string").alias("text")).transform(mapped, run, "word int, n long")
    return {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class PrefixIndex:
    """Templates as sets of ranks 0..n-1 (rarest word first), with inverted indexes of their prefixes and of all their words."""

    def __init__(self, ranked: list[np.ndarray], n: int, threshold: float):
        self.sizes = np.array([len(t) for t in ranked], dtype=np.int64)
        self.required = np.array([_required(int(k), threshold) for k in self.sizes], dtype=np.int64)
        template = np.repeat(np.arange(len(ranked)), self.sizes)
        word = np.concatenate([*ranked, np.zeros(0, np.int64)]).astype(np.int64)
        place = np.concatenate([*(np.arange(k) for k in self.sizes), np.zeros(0, np.int64)]).astype(np.int64)
        prefix = place < (self.sizes - self.required + 1)[template]
        self.all = self._inverted(word, template, place, n)
        self.prefixes = self._inverted(word[prefix], template[prefix], place[prefix], n)

    @staticmethod
    def _inverted(word: np.ndarray, template: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(word, kind="stable")
        return np.searchsorted(word[order], np.arange(n + 1)), template[order], place[order]

    def _met(self, index: tuple, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, place) of each template word that a block holds; a cell is a block and a template."""
        bounds, template, place = index
        count = bounds[rank + 1] - bounds[rank]
        at = np.repeat(bounds[rank] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(rank) else rank, count) + np.arange(count.sum())
        return np.repeat(block, count) * len(self.sizes) + template[at], place[at]

    def search(self, rank: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, overlap) of all pairs that meet the threshold; rank: each block's distinct words, bounds: where they begin."""
        length = np.diff(bounds)
        block = np.repeat(np.arange(len(length)), length)
        long_enough = (length >= (self.required.min() if len(self.required) else 1))[block]
        block, rank = block[long_enough], rank[long_enough]
        cell, place = self._met(self.prefixes, block, rank)
        order = np.lexsort((place, cell))
        cell, at = np.unique(cell[order], return_index=True)
        place = place[order][at]
        b, k = cell // max(len(self.sizes), 1), cell % max(len(self.sizes), 1)
        cell = cell[(length[b] >= self.required[k]) & (self.sizes[k] - place >= self.required[k])]
        if not len(cell):
            return cell, cell, cell
        b = np.zeros(len(length), bool)
        b[cell // len(self.sizes)] = True
        every, _ = self._met(self.all, block[b[block]], rank[b[block]])
        at = np.minimum(np.searchsorted(cell, every), len(cell) - 1)
        overlap = np.bincount(at[cell[at] == every], minlength=len(cell))
        k = cell % len(self.sizes)
        met = overlap >= self.required[k]
        return (cell // len(self.sizes))[met], k[met], overlap[met]


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, kind (line or paragraph), block_no (of the block's first line, from 0), license, overlap, containment: every block and template at or above the threshold."""
    names, sets, every = _vocabulary(templates)
    frequency = line_frequencies(df, text, templates)
    order = np.argsort(np.array([frequency.get(k, 0) for k in range(len(every))]), kind="stable")
    rank = np.empty(len(every), dtype=np.int64)
    rank[order] = np.arange(len(every))
    index = PrefixIndex([np.sort(rank[np.searchsorted(every, sets[n])]) for n in names], len(every), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if names else ():
            for kind, i, row, number, word, bounds in _blocks(batch.column("text"), every):
                m, k, o = index.search(rank[word], bounds)
                if len(m):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(row[m] + i)), pa.array([kind] * len(m)), pa.array(number[m].astype(np.int32)), pa.array([names[x] for x in k]), pa.array(o.astype(np.int32)), pa.array(o / index.sizes[k])],
                        names=["key", "kind", "block_no", "license", "overlap", "containment"],
                    )

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("kind", T.StringType()), T.StructField("block_no", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("overlap", T.IntegerType()), T.StructField("containment", T.DoubleType())])
    return source.transform(mapped, run, schema).withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    """Every line and paragraph of documents that meets a license template."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("containment", F.round("containment", 6))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    rows = ", ".join(f"('{n}', '{q(t)}')" for n, t in TEMPLATES.items())
    split = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
    return f"""
WITH templates AS (SELECT license, list_distinct(regexp_extract_all(lower(body), '{split}')) AS wanted FROM (VALUES {rows}) t(license, body)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no FROM documents),
marked AS (SELECT *, regexp_full_match(line, '[ \\t\\x0B\\f\\r]*') AS blank FROM lines),
placed AS (SELECT *, sum(blank::INTEGER) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS paragraph FROM marked),
blocks AS (
  SELECT doc_id, 'line' AS kind, block_no, line AS body FROM lines
  UNION ALL SELECT doc_id, 'paragraph', min(block_no), string_agg(line, chr(10)) FROM placed WHERE NOT blank GROUP BY doc_id, paragraph HAVING count(*) > 1),
sets AS (SELECT doc_id, kind, block_no, list_distinct(regexp_extract_all(lower(body), '{split}')) AS have FROM blocks),
pairs AS (SELECT doc_id, kind, block_no, license, len(list_intersect(have, wanted)) AS overlap, len(wanted) AS size FROM sets, templates)
SELECT doc_id, kind, CAST(block_no AS INTEGER) AS block_no, license, CAST(overlap AS INTEGER) AS overlap, round(overlap / size, 6) AS containment
FROM pairs WHERE size > 0 AND overlap >= ceil({THRESHOLD} * size - 1e-9)"""


SQL = _sql()
