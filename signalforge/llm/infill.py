"""Fill-in-middle transformation by overlapping-chunk decomposition.

A text is cut in three at two ranks among its units and its parts are written in another order between sentinels, so that a model
learns to fill in what lies between. Where a unit begins is told by two adjacent bytes (PREDICATES). A text's bytes are divided into chunks, each
seen with the byte before it, and units that begin in a chunk are counted for all chunks at once. Prefix sums of the counts give
the units of the whole text, hence the two cut ranks, and the chunk that each rank falls in: only those two chunks are
scanned again for the place itself.

Cuts and forms are drawn from the SHA-256 of `<seed>:<id>`, so reruns and partitions change nothing. There is no shuffle, and beside the
texts at hand only a slab of bytes and a number a chunk are held.

Defined cases: a null text counts as empty; an empty text, or one that holds a sentinel, stays as it is (form plain); a null id draws
as an empty one; repeated rows get equal results; an empty table gives an empty result; other columns pass through, whatever they
are called (transform()'s own take the place of columns called like them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import positional, q, restored

#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk, and of the chunks whose predicates are worked out together.
CHUNK, SLAB = 4096, 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Whether a unit begins at a byte, by the byte before it and the byte itself; a line feed stands before a text's first byte.
PREDICATES = {
    "character": lambda before, byte: (byte & 0xC0) != 0x80,  # of UTF-8: code points
    "word": lambda before, byte: _WHITE[before] & ~_WHITE[byte],
    "line": lambda before, byte: before == 0x0A,
}
OWN = [("_n_units", T.LongType()), ("_form", T.StringType()), ("_prefix_units", T.LongType()), ("_middle_units", T.LongType()), ("_output", T.StringType())]


def chunk_grid(offsets: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each chunk, chunks before each text): chunks end with their text."""
    number = -(-np.diff(offsets) // chunk)
    before = np.concatenate([[0], np.cumsum(number)])
    row = np.repeat(np.arange(len(number)), number)
    return offsets[:-1][row] + (np.arange(before[-1]) - before[row]) * chunk, before


def begins(data: np.ndarray, low: int, high: int, firsts: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte from low to high, given the first bytes of texts."""
    before = np.full(high - low, 0x0A, np.uint8)
    if low > 0:
        before[0] = data[low - 1]
    before[1:] = data[low : high - 1]
    own = firsts[np.searchsorted(firsts, low) : np.searchsorted(firsts, high)]
    before[own - low] = 0x0A
    return PREDICATES[unit](before, data[low:high])


def unit_counts(data: np.ndarray, starts: np.ndarray, end: int, firsts: np.ndarray, unit: str) -> np.ndarray:
    """Units that begin in each chunk, slab by slab."""
    counts = np.zeros(len(starts), np.int64)
    ends = np.append(starts[1:], end)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + SLAB)))
        marks = begins(data, int(starts[low]), int(ends[high - 1]), firsts, unit)
        counts[low:high] = np.add.reduceat(marks, starts[low:high] - starts[low], dtype=np.int64)
        low = high
    return counts


def cut_places(column: pa.Array, ranks, unit: str = "character") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, cut ranks, bytes before the cuts) of each text; ranks(units) gives two ascending ranks a text."""
    data, offsets = textops.utf8(column)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    starts, before = chunk_grid(offsets)
    sums = np.concatenate([[0], np.cumsum(unit_counts(data, starts, int(offsets[-1]), firsts, unit))])
    first = sums[before[:-1]]
    units = sums[before[1:]] - first
    wanted = ranks(units)
    places = np.where(wanted > 0, np.diff(offsets)[:, None], 0)
    ends = np.append(starts[1:], offsets[-1])
    inside = (wanted > 0) & (wanted < units[:, None])
    row, side = np.nonzero(inside)
    rank = first[row] + wanted[inside]
    owner = np.searchsorted(sums, rank, "right") - 1  # the chunk with the unit of that rank
    for r, s, k, nth in zip(row.tolist(), side.tolist(), owner.tolist(), (rank - sums[owner]).tolist(), strict=True):
        marks = begins(data, int(starts[k]), int(ends[k]), firsts, unit)
        places[r, s] = starts[k] + np.flatnonzero(marks)[nth] - offsets[r]
    return units, wanted, places


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "character", rate: int = 90, spm: int = 20, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with _n_units, _form (plain, psm or spm), _prefix_units, _middle_units (null if plain) and _output.

    rate: texts in a hundred that are cut; spm: of those in a hundred, the ones whose suffix comes first.
    """
    names = docs.columns
    docs, id_col, text_col = positional(docs, id_col, text_col)
    width = len(docs.columns)
    docs = docs.withColumns({f"_h{k}": h for k, h in enumerate(draws(q(id_col), seed))} | {"_said": F.coalesce(q(text_col).cast("string"), F.lit(""))})
    pre, suf, mid = (s.encode() for s in sentinels)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(width + k).to_numpy(zero_copy_only=False) for k in range(4)]
            said = batch.column(width + 4)
            units, wanted, places = cut_places(said, lambda n: np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)], axis=1), axis=1), unit)  # noqa: B023
            forms, made = [], []
            for k, text in enumerate(said.cast(pa.binary())):
                text = text.as_py()
                if not text or h[2][k] % 100 >= rate or pre in text or suf in text or mid in text:
                    forms.append("plain")
                    made.append(text)
                    continue
                a, b = places[k].tolist()
                forms.append("spm" if h[3][k] % 100 < spm else "psm")
                parts = [suf, text[b:], pre, text[:a]] if forms[-1] == "spm" else [pre, text[:a], suf, text[b:]]
                made.append(b"".join([*parts, mid, text[a:b]]))
            plain = np.array([f == "plain" for f in forms], bool)
            own = [pa.array(units), pa.array(forms, pa.string()), pa.array(wanted[:, 0], mask=plain), pa.array(wanted[:, 1] - wanted[:, 0], mask=plain), pa.array(made, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *own], [*batch.schema.names[:width], *[n for n, _ in OWN]])
        textops.release()

    schema = T.StructType([*docs.schema.fields[:width], *[T.StructField(*f) for f in OWN]])
    return restored(docs.mapInArrow(outputs, schema), names)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transform() made the output of."""
    pre, suf, mid = sentinels
    # a text that was cut holds no sentinel, so the first of each is the mark
    split = lambda first, mark: F.split(F.substring(output, len(first) + 1, 2**31 - 1), f"{re.escape(mark)}|{re.escape(mid)}", -1)
    psm, spm = split(pre, suf), split(suf, pre)
    joined = lambda parts, *order: F.concat(*[F.get(parts, k) for k in order])
    return F.when(form == "plain", output).when(form == "psm", joined(psm, 0, 2, 1)).otherwise(joined(spm, 1, 2, 0))
