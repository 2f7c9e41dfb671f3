"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A text's words are lower-case runs of letters, digits and anything beyond ASCII. Blocks are windows: a template of n words is held against
windows of s words, s the smallest power of two from 2n (16 at least), that begin at every multiple of s/2, so a passage
of the template's length lies whole within one. A block contains a template if it holds at least the template's threshold as a share of its
different words; every such pair is found:

* words of templates are counted over the whole corpus and ranked from the rarest on, ties by the word itself;
* prefix filter: a block that holds `need` of a template's m words holds one of its m - need + 1 rarest, so blocks without any such
  word of the templates of their size are not built, and the join is by these words;
* length filter: a block has at least `need` different words of templates;
* positional filter: no more words can be common than stand from the joined word on, in the block's order or in the template's;
* what is left is verified on the sets, at the pair's rarest common word only, so a pair comes once.

Two passes over the texts and no shuffle of them: one counts, one writes the blocks that pass the prefix filter. Templates are a parameter;
their prefix table is broadcast only up to a counted size. Hot words cost blocks where they stand, not pairs.

Defined cases: a null text counts as empty (no words, no labels, score 0); ids may be null or repeated, each row has its own result; the
longest texts are read whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import attach, materialise, q

# Phrases and wording of public license notices. A notice of a line must be there with all its words, a longer one with most.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", 0.8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", 0.8, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", 0.8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", 1.0, "under the terms of the GNU Lesser General Public License"),
    ("agpl", 1.0, "under the terms of the GNU Affero General Public License"),
    ("gpl-3", 1.0, "licensed under the GNU General Public License, version 3"),
    ("gpl-2", 1.0, "licensed under the GNU General Public License, version 2"),
    ("apache-2", 1.0, "licensed under the Apache License, version 2.0"),
    ("bsd", 0.8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", 0.85, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", 0.85, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", 0.85, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", 1.0, "licensed under CC BY"),
    ("cc-by", 1.0, "licensed under a Creative Commons Attribution License"),
    ("cc-by-nc", 1.0, "licensed under CC BY-NC"),
    ("cc-by-nc", 1.0, "licensed under a Creative Commons Attribution NonCommercial License"),
    ("cc-by-sa", 1.0, "licensed under CC BY-SA"),
    ("cc-by-sa", 1.0, "licensed under a Creative Commons Attribution ShareAlike License"),
    ("cc0", 1.0, "CC0 1.0 Universal Public Domain Dedication"),
]
SMALLEST = 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCANNED = "_row long, _id {id}, _n_words long, _n_base long, _first_word long, _last_word long, _base array<string>, _blocks array<struct<size:int,at:long,words:array<int>>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Templates:
    """Templates as sets of words. order() ranks the words; then prefix() has the rows to join by."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, float, str]]):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases]
        self.labels = [label for label, _, _ in templates]
        self.sets = [sorted(set(words_of(text.encode()))) for _, _, text in templates]
        self.need = [math.ceil(len(s) * share - 1e-9) for s, (_, share, _) in zip(self.sets, templates, strict=True)]
        self.size = [max(SMALLEST, 1 << math.ceil(math.log2(2 * len(words_of(text.encode()))))) for _, _, text in templates]
        self.vocabulary = sorted({w for s in self.sets for w in s} | {w for p, _ in self.phrases for w in p})
        self.number = {w: k for k, w in enumerate(self.vocabulary)}
        self.rank = list(range(len(self.vocabulary)))

    def order(self, counts: dict[int, int]) -> None:
        """Rank the words: rarest first, then by the word itself."""
        for place, k in enumerate(sorted(range(len(self.vocabulary)), key=lambda k: (counts.get(k, 0), k))):
            self.rank[k] = place

    def prefix(self) -> list[tuple]:
        """(word, size, at, need, label, words) of each template's prefix, all words being ranks."""
        rows = []
        for words, need, size, label in zip(self.sets, self.need, self.size, self.labels, strict=True):
            ranks = sorted(self.rank[self.number[w]] for w in words)
            rows.extend((r, size, at, need, label, ranks) for at, r in enumerate(ranks[: len(ranks) - need + 1]))
        return rows


def _word_numbers(text: bytes | None, number: dict[bytes, int]) -> np.ndarray:
    """The template word's number at each word of the text, -1 at others."""
    words = words_of(text or b"")
    return np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))


def word_counts(docs: DataFrame, text_col: str, known: Templates) -> dict[int, int]:
    """How often each template word stands in all texts; as many rows as templates have words."""
    number, many = known.number, len(known.vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total += np.bincount(_word_numbers(text.as_py(), number) + 1, minlength=many + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(many, dtype=np.int32)), pa.array(total[1:])], ["word", "n"])
        textops.release()

    counts = docs.select(q(text_col).cast("string")).mapInArrow(counted, "word int, n long")
    return {r.word: r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _blocks(numbers: np.ndarray, sizes: list[tuple[int, np.ndarray, int]], rank: np.ndarray) -> list[dict]:
    """The text's blocks that hold a prefix word of a template of their size, and at least the fewest words that any of these needs."""
    found = []
    for size, in_prefix, least in sizes:
        half = size // 2
        last = np.flatnonzero(in_prefix[numbers]) // half
        for k in np.unique(np.concatenate([last, last[last > 0] - 1])).tolist():
            own = numbers[k * half : k * half + size]
            words = np.unique(rank[own[own >= 0]])
            if len(words) >= least:
                found.append({"size": size, "at": k * half, "words": words})
    return found


def scanned(docs: DataFrame, id_col: str, text_col: str, known: Templates) -> DataFrame:
    """Rows of SCANNED: base phrases, and the blocks that the prefix filter leaves."""
    number, rank = known.number, np.array(known.rank, np.int32)
    sizes = []
    for size in sorted(set(known.size)):
        in_prefix = np.zeros(len(rank) + 1, bool)  # the last place is that of other words, -1
        in_prefix[np.flatnonzero(np.isin(rank, [r[0] for r in known.prefix() if r[1] == size]))] = True
        sizes.append((size, in_prefix, min(n for n, s in zip(known.need, known.size, strict=True) if s == size)))
    phrases = [(np.array([number[w] for w in words]), label) for words, label in known.phrases]
    docs = docs.select(q(id_col).alias("_id"), q(text_col).cast("string").alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    block = pa.struct([("size", pa.int32()), ("at", pa.int64()), ("words", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n_words, n_base, first, last, labels, blocks = ([] for _ in range(6))
            for text in batch.column(1).cast(pa.binary()):
                numbers = _word_numbers(text.as_py(), number)
                places, named = [], set()
                for words, label in phrases:
                    fits = np.ones(max(0, len(numbers) - len(words) + 1), bool)
                    for k, w in enumerate(words):
                        fits &= numbers[k : k + len(fits)] == w
                    at = np.flatnonzero(fits)
                    if len(at):
                        places.append(at)
                        named.add(label)
                at = np.concatenate(places) if places else None
                n_words.append(len(numbers))
                n_base.append(0 if at is None else len(at))
                first.append(None if at is None else int(at.min()))
                last.append(None if at is None else int(at.max()))
                labels.append(sorted(named))
                blocks.append(_blocks(numbers, sizes, rank))
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            longs = [pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), *longs, pa.array(labels, pa.list_(pa.string())), pa.array(blocks, pa.list_(block))], [x.split()[0] for x in re.split(r", (?=_)", SCANNED)])
        textops.release()

    return docs.mapInArrow(scan, SCANNED.format(id=kind))


def contained(blocks: DataFrame, known: Templates) -> DataFrame:
    """(_row, _label, _share, _at, _size): each block and the templates that it contains."""
    spark = blocks.sparkSession
    kind = "_word int, _size int, _place int, _need int, _label string, _template array<int>"
    index = spark.createDataFrame(known.prefix(), kind)
    words = blocks.select("_row", F.explode("_blocks").alias("_b")).select("_row", F.col("_b.size").alias("_size"), F.col("_b.at").alias("_at"), F.col("_b.words").alias("_words"))
    words = words.select("*", F.posexplode("_words").alias("_j", "_word"))
    pairs = attach(words, index, ["_word", "_size"], "_row").filter("_template IS NOT NULL")
    left = lambda array, place: F.size(array) - F.col(place)
    pairs = pairs.filter((F.size("_words") >= F.col("_need")) & (F.least(left("_words", "_j"), left("_template", "_place")) >= F.col("_need")))
    pairs = pairs.withColumn("_common", F.array_intersect("_words", "_template"))  # in the words' order
    pairs = pairs.filter((F.size("_common") >= F.col("_need")) & (F.get("_common", F.lit(0)) == F.col("_word")))
    return pairs.select("_row", "_label", (F.size("_common") / F.size("_template")).alias("_share"), "_at", "_size")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, float, str]] = TEMPLATES) -> DataFrame:
    """One row a document: _id, _n_words, _n_base, _first_word, _last_word, _base_labels, _labels (arrays), _score and _found.

    phrases: (words, label); templates: (label, threshold, text). _score is 1 with a phrase, else the greatest containment found, else 0;
    _found has the blocks: array<struct<label, share, at (word), size (words)>>.
    """
    known = Templates(phrases, templates)
    known.order(word_counts(docs, text_col, known))
    rows = materialise(scanned(docs, id_col, text_col, known), "license-blocks")
    found = contained(rows.select("_row", "_blocks").filter(F.size("_blocks") > 0), known)
    block = F.struct(F.col("_label").alias("label"), F.col("_share").alias("share"), F.col("_at").alias("at"), F.col("_size").alias("size"))
    found = found.groupBy("_row").agg(F.collect_set("_label").alias("_more"), F.max("_share").alias("_best"), F.sort_array(F.collect_list(block)).alias("_found"))
    rows = rows.drop("_blocks").join(found, "_row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_more", F.array().cast("array<string>")))))
    score = F.when(F.col("_n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    none = F.array().cast("array<struct<label:string,share:double,at:bigint,size:int>>")
    return rows.select("_id", "_n_words", "_n_base", "_first_word", "_last_word", F.col("_base").alias("_base_labels"), labels.alias("_labels"), score.alias("_score"), F.coalesce("_found", none).alias("_found"))
