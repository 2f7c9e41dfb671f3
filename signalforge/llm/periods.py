"""Periodic runs of words by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words whose words `period` apart are identical (the smallest such period), of at least
max(shortest, 2 x period) words, that no neighbouring word extends. All runs of a text are found:

* naming: level k gives equal names to equal stretches of 2^k words of a text, from pairs of names of level k - 1. Level 0 names the
  words themselves, so names are exact. A stretch that occurs once needs no name, and levels end where nothing repeats;
* grid: a run of period q holds a place i, a multiple of q, with both i and i + q in it. Only places where the stretch of 2^k words
  before or after them is repeated q further on are looked at, 2^k being what the longer side of a run must hold;
* extension: equal words from i and i + q on, and before them, are counted by descending name levels. Of runs with the same
  words the smallest period stays.

Work is about words x log^2(words), in one pass without a shuffle. Short texts are named together (names tell texts apart); a longer
text is worked on alone, within about 4 bytes x words x levels.

Defined cases: null and empty texts have no words and no runs; repeated rows get equal results; ids may be null; an empty table gives an
empty result; other columns pass through, whatever they are called (find()'s own take the place of columns called like them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textops
from .shared import positional, q, restored

#: Words worked on together; a longer text is worked on alone.
TOGETHER = 1 << 16
#: Grid places looked at together.
PLACES = 1 << 20
SHORTEST = 12
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _named(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The rank of each key at its place in `at`; -1 at other places, and where a key occurs once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys) + 1, bool)
    new[1:-1] = ranked[1:] != ranked[:-1]
    names = np.full(size, -1, np.int32)
    names[at[order]] = np.where(new[:-1] & new[1:], -1, np.cumsum(new[:-1]) - 1)
    return names


def name_levels(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """names[k][i]: the name of the 2^k words from i on within their text, or -1; one place longer than the words."""
    n, width = len(words), 1
    found = _named(text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, np.arange(n), n + 1)
    names = []
    while (found >= 0).any():
        names.append(found)
        near, far = found[: max(0, n - width)], found[width:n]
        at = np.flatnonzero((near >= 0) & (far >= 0) & (text[: len(near)] == text[width:]))
        found = _named(near[at].astype(np.int64) << 32 | far[at], at, n + 1)
        width *= 2
    return names


def _ahead(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal from i and from j on (i < j)."""
    more = np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        here = names[k][i + more]
        more += ((here >= 0) & (here == names[k][j + more])).astype(np.int64) << k
    return more


def _behind(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal before i and before j (i < j)."""
    more = np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        start = i - more - (1 << k)
        here = names[k][np.maximum(start, 0)]
        more += ((start >= 0) & (here >= 0) & (here == names[k][j - more - (1 << k)])).astype(np.int64) << k
    return more


def _smallest_periods(found: list[np.ndarray]) -> np.ndarray:
    """Of rows (start, length, period) with the same words that of the smallest period, in order."""
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return rows[:, new]


def runs(words: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, length, period) as rows of three, by start and length, of all texts' runs; words and texts are given by numbers."""
    n, names, found = len(words), name_levels(words, text), [np.zeros((3, 0), np.int64)]
    periods = np.arange(1, int(np.bincount(text).max(initial=0)) // 2 + 1)
    # a run has `beyond` words besides a period, so at least half of them on one side of its grid place
    half = (np.maximum(periods, shortest - periods) + 1) // 2
    level = np.floor(np.log2(half)).astype(int)
    for k, name in enumerate(names):
        width = 1 << k
        own = periods[level == k]
        places = (n - 1) // own
        cut = np.searchsorted(np.cumsum(places), np.arange(0, places.sum(), PLACES), "left")
        for some, count in zip(np.split(own, cut[1:]), np.split(places, cut[1:]), strict=True):
            period = np.repeat(some, count)
            i = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period
            here, before = name[i], name[np.maximum(i - width, 0)]
            held = (here >= 0) & (here == name[i + period])
            held |= (i >= width) & (before >= 0) & (before == name[np.maximum(i + period - width, 0)])
            i, period = i[held], period[held]
            more, less = _ahead(names, i, i + period), _behind(names, i, i + period)
            long = more + less >= np.maximum(period, shortest - period)
            some_found = np.stack([i - less, period + more + less, period])[:, long]
            found.append(_smallest_periods([some_found]))
    return _smallest_periods(found)


def _results(texts: list[bytes | None], shortest: int) -> pa.RecordBatch:
    """(_n_words, _runs, _collapsed) of the texts."""
    words = [(t or b"").split() for t in texts]  # of bytes: ASCII white space
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    names = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy()
    start, length, period = runs(names, np.repeat(np.arange(len(words)), sizes), shortest)
    row = np.searchsorted(at, start, "right") - 1
    gone = np.zeros(at[-1] + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.cumsum(gone) == 0
    counts = np.bincount(row, minlength=len(words))
    collapsed = [b" ".join(compress(w, kept[a : a + len(w)].tolist()) if c else w) for w, a, c in zip(words, at.tolist(), counts, strict=False)]
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    order = np.lexsort((period, start))
    listed = pa.StructArray.from_arrays([pa.array(x[order]) for x in (start - at[row], length, period)], [f.name for f in RUN.fields])
    return pa.RecordBatch.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(ends, listed), pa.array(collapsed, pa.binary()).cast(pa.string())], ["_n_words", "_runs", "_collapsed"])


def find(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """docs with _n_words, _runs (array<struct<start, length, period>>, by start and period) and _collapsed.

    _collapsed is the text's words without those that a run holds after its first period, joined by a space.
    """
    names = docs.columns
    docs, text_col = positional(docs, text_col)
    docs = docs.withColumn("_said", q(text_col).cast("string"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, rest = batch.column(batch.num_columns - 1).cast(pa.binary()), batch.drop_columns(["_said"])
            low = held = 0
            for row, text in enumerate(said, 1):
                held += len(text.as_buffer() or b"") // 2 + 1  # no text has more words
                if held >= TOGETHER or row == len(said):
                    more = _results(said.slice(low, row - low).to_pylist(), shortest)
                    part = rest.slice(low, row - low)
                    yield pa.RecordBatch.from_arrays([*part.columns, *more.columns], [*part.schema.names, *more.schema.names])
                    low, held = row, 0
        textops.release()

    own = [T.StructField("_n_words", T.LongType()), T.StructField("_runs", T.ArrayType(RUN)), T.StructField("_collapsed", T.StringType())]
    return restored(docs.mapInArrow(found, T.StructType([*docs.drop("_said").schema.fields, *own])), names)
