"""Cost-balanced packing of tokenised documents into sequences.

A document's tokens are cut into pieces of at most `capacity`. Windows of pieces, bounded in tokens, are
packed one by one within a task, so there is no shuffle and no task holds more than a window: with as many
sequences as the window's tokens need, pieces go in descending length to the sequence of lowest estimated
cost (linear plus quadratic attention) among those with room; a piece that fits nowhere is cut at
the roomiest one. A window leaves less than one sequence of padding, and a sequence that ends at a power of two
needs none.

Defined cases: null or empty text is the end token alone; documents longer than a window are packed in
several windows; repeated rows and ids are documents of their own; an empty table gives no sequence; other
columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import materialise, q

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Tokens packed together; bounds a task's memory.
WINDOW_TOKENS = 2_000_000
#: Bytes of text encoded together; a longer text is encoded alone.
CHUNK = 4 << 20
#: Words of up to so many bytes are merged by numpy.
LONGEST = 48
#: Words merged together.
TOGETHER = 1 << 15
#: What a tokenizer's file says where WordMerges gives its ids.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_FAR = np.int32(1 << 30)
_encoders: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class WordMerges:
    """Byte pair merges of many words at once: a step joins the leftmost pair of lowest rank in every word that has one."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_letters()], np.int32)
        self.none = max(vocab.values()) + 1  # beside a word's ends
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.keys(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        bits = (len(keys) * 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self.places(keys).tolist(), strict=True)):
            while self.ranks[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at], self.ranks[at] = key, rank

    def keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) * np.uint64(self.none + 1) + right.astype(np.uint64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def order(self, left: np.ndarray, right: np.ndarray, position: np.ndarray | int) -> np.ndarray:
        """rank x 64 + position of each pair, or _FAR where none is merged."""
        keys = self.keys(left, right)
        at, todo = self.places(keys), None
        here = self.ranks[at]
        met = self.slots[at] == keys
        out = np.where(met & (here >= 0), here * np.int32(64) + np.asarray(position, np.int32), _FAR)
        todo = np.flatnonzero(~met & (here >= 0))
        keys, at = keys[todo], at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            here, met = self.ranks[at], self.slots[at] == keys
            found = np.flatnonzero(met & (here >= 0))
            out[todo[found]] = here[found] * np.int32(64) + (position[todo[found]] if isinstance(position, np.ndarray) else np.int32(position))
            on = np.flatnonzero(~met & (here >= 0))
            todo, keys, at = todo[on], keys[on], at[on]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(longest, words) ids in order, -1 where there is none, of words of one to LONGEST bytes."""
        n, longest = len(starts), int(sizes.max())
        ids = np.full((longest + 1, n), self.none, np.int32)
        pairs = np.full((longest, n), _FAR, np.int32)
        for k in range(longest):
            some = np.flatnonzero(sizes > k)
            letter = data[starts[some] + k]
            ids[k, some] = np.where(sizes[some] == k + 1, self.last[letter], self.inner[letter])
        for k in range(longest - 1):
            some = np.flatnonzero(sizes > k + 1)
            pairs[k, some] = self.order(ids[k, some], ids[k + 1, some], k)
        after = np.repeat(np.arange(1, longest + 2, dtype=np.int32)[:, None], n, axis=1)
        np.minimum(after, sizes.astype(np.int32), out=after)  # ids[size] is none
        before = np.repeat(np.arange(-1, longest, dtype=np.int32)[:, None], n, axis=1)
        out = np.empty((longest, n), np.int32)
        word = np.arange(n)
        while len(word):
            best = pairs.min(axis=0)
            on = np.flatnonzero(best < _FAR)
            if len(on) < 0.7 * len(word) or not len(on):
                done = np.flatnonzero(best >= _FAR)
                out[:, word[done]] = ids[:-1, done]
                word, best = word[on], best[on]
                ids, pairs, after, before = (np.ascontiguousarray(x[:, on]) for x in (ids, pairs, after, before))
                on = np.arange(len(word))
            if not len(word):
                break
            width = len(word)
            best = best[on]
            place, rank = best & 63, best >> 6
            p = place.astype(np.int64) * width + on
            gone = after.ravel()[p]
            g = gone.astype(np.int64) * width + on
            new, following = self.joined[rank], after.ravel()[g]
            f = following.astype(np.int64) * width + on
            ids.ravel()[p] = new
            ids.ravel()[g] = -1
            pairs.ravel()[g] = _FAR
            after.ravel()[p] = following
            before.ravel()[f] = place
            right = ids.ravel()[f]
            pairs.ravel()[p] = self.order(new, right, place)
            left = before.ravel()[p]
            has = np.flatnonzero(left >= 0)
            l_at = left[has].astype(np.int64) * width + on[has]
            pairs.ravel()[l_at] = self.order(ids.ravel()[l_at], new[has], left[has])
        out[out == self.none] = -1
        return out


class Encoder:
    """ids of whole texts, word by word where the tokenizer's file shows that it never looks across white space.

    A batch's different words are encoded once. Those of ASCII and Latin-1 letters, perhaps with a full stop or comma behind
    them, have normal forms of letters alone, and are merged together; the tokenizer itself encodes all others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        known = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and all(model.get(k, v) == v for k, v in MODEL.items())
        plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and "<" in t["content"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        self.merges = WordMerges(model) if known and plain and spec["post_processor"] is None and spec["truncation"] is None else None
        self.low = np.arange(256, dtype=np.uint8)
        self.low[ord("A") : ord("Z") + 1] += 32
        self.letter = np.zeros(256, bool)
        self.letter[[*range(ord("a"), ord("z") + 1)]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text's end), each text's with end_id behind them."""
        if self.merges is None:
            end = np.array([] if end_id is None else [end_id], np.uint32)
            parts = [np.append(self.ids(t or ""), end).astype(np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([len(x) for x in parts])
        data, offsets = textops.utf8(texts)
        data, ends = data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
        white = (data == 32) | (data == 10)
        # a text's end comes before a space at the same place, which is the next text's
        edges = np.sort(np.concatenate([2 * np.flatnonzero(white) + 1, 2 * ends]), kind="stable")
        last = edges % 2 == 0
        stops = np.append(0, edges // 2 - (np.cumsum(~last) - ~last))
        words = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~white]))])
        coded = words.dictionary_encode()
        flat, starts, counts = self.words(coded.dictionary, end_id)
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if end_id is not None:
            word = np.insert(word, np.flatnonzero(last) + 1, len(coded.dictionary))
        n = counts[word]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(starts[word] - before, n) + np.arange(int(n.sum()))]
        stop = np.flatnonzero(last) + (np.arange(1, len(ends) + 1) if end_id is not None else 0)
        return ids, (before + n)[stop]

    def words(self, words: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, where each one's start, how many it has) of different words, and of a last one, the end."""
        data, offsets = textops.utf8(words)
        data, offsets = self.low[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
        starts, ends = offsets[:-1], offsets[1:]
        ok = self.letter[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF but the signs of multiplication and division
        second = data[lead + 1]
        lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
        data[lead + 1] = np.where(second < 0x9F, second | 0x20, second)
        ok[lead] = ok[lead + 1] = True
        bad = np.append(0, np.cumsum(~ok))
        some = ends > starts
        mark = np.zeros(len(starts), np.uint8)
        mark[some] = data[ends[some] - 1]
        mark[(mark != ord(".")) & (mark != ord(","))] = 0
        core_ends = ends - (mark > 0)
        quick = (core_ends > starts) & (core_ends - starts <= LONGEST) & (bad[core_ends] == bad[starts])
        counts = np.zeros(len(starts) + 1, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (word, id), in order within a word
        at, sizes = np.flatnonzero(quick), (core_ends - starts)[quick]
        order = np.argsort(sizes, kind="stable")
        for low in range(0, len(at), TOGETHER):
            part = at[order[low : low + TOGETHER]]
            ids = self.merges.encode(data, starts[part], (core_ends - starts)[part])
            tails = np.where(mark[part] > 0, self.merges.last[mark[part]], -1)
            ids = np.vstack([ids, tails[None, :]]).T
            held = ids >= 0
            counts[part] = held.sum(axis=1)
            found.append((np.repeat(part, counts[part]), ids[held]))
        rest = np.flatnonzero(~quick & some)
        for low in range(0, len(rest), 4096):
            part = rest[low : low + 4096]
            texts = words.take(pa.array(part)).cast(pa.string()).to_pylist()
            coded = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            counts[part] = [len(x) for x in coded]
            found.append((np.repeat(part, counts[part]), np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in coded]])))
        if end_id is not None:
            counts[-1] = 1
            found.append((np.array([len(starts)]), np.array([end_id])))
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for word, ids in found:
            within = np.arange(len(word)) - np.flatnonzero(np.append(True, word[1:] != word[:-1]))[np.cumsum(np.append(True, word[1:] != word[:-1])) - 1] if len(word) else word
            flat[first[word] + within] = ids
        return flat, first, counts


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(texts: pa.Array, words: Encoder, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each text, in runs of rows of about CHUNK bytes."""
    _, offsets = textops.utf8(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        ids, ends = words.encode(texts.slice(low, high - low), end_id)
        start = 0
        for row, end in zip(range(low, high), ends.tolist(), strict=True):
            yield row, ids[start:end]
            start = end
        low = high


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset there), every token once, ceil(tokens / capacity) sequences."""
    n = -(-sum(lengths) // capacity)
    used = [0] * n
    waiting = [(-capacity, s) for s in range(n)]  # (-room, sequence): not known to have room for the piece at hand
    active: list[tuple[float, int]] = []  # (cost, sequence): room for the piece at hand
    cost = [0.0] * n
    pieces = [(-length, k, 0) for k, length in enumerate(lengths) if length]
    heapq.heapify(pieces)
    out = []
    while pieces:
        negative, k, start = heapq.heappop(pieces)
        length = -negative
        while waiting and -waiting[0][0] >= length:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(active, (cost[s], s))
        if active:
            s, put = heapq.heappop(active)[1], length
        else:
            s = heapq.heappop(waiting)[1]
            put = capacity - used[s]
            heapq.heappush(pieces, (put - length, k, start + put))
        out.append((k, start, put, s, used[s]))
        used[s] += put
        cost[s] += linear * put + quadratic * put * put
        if used[s] < capacity:
            heapq.heappush(waiting, (used[s] - capacity, s))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 4096, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        window: list[tuple[int | None, int, np.ndarray, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            placed = sorted(assign([len(p[2]) for p in window], capacity, linear, quadratic), key=lambda x: x[3:])
            for k in range(0, len(placed), 4096):
                part = placed[k : k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([window[p][0] for p, *_ in part], pa.int64()),
                        pa.array([window[p][1] + b for p, b, *_ in part], pa.int64()),
                        pa.array([n for _, _, n, *_ in part], pa.int64()),
                        pa.array([window[p][2][b : b + n].astype("<u4").tobytes() for p, b, n, *_ in part], pa.binary()),
                        pa.array([window[p][3] for p, *_ in part], pa.int64()),
                        pa.array([sequence + s for *_, s, _ in part], pa.int64()),
                        pa.array([at for *_, at in part], pa.int64()),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )
            sequence += -(-held // capacity)
            window.clear()
            held = 0

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, ids in encoded(batch.column(1), words, end_id):
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    window.append((keys[row], start, piece, len(ids)))
                    held += len(piece)
                    if held >= window_tokens:
                        yield from flush()
        yield from flush()
        textops.release()

    return docs.select(q(id_col).cast("long"), q(text_col).cast("string")).mapInArrow(packed, SCHEMA)


def digests(docs: DataFrame, **options) -> DataFrame:
    """pack()'s rows with ids_crc32 in place of the ids, written once in small batches of texts."""
    pieces = pack(docs, **options)
    return materialise(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"), "pieces")
