"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts that are equal are one node. A node's shingles (five words, ASCII case folded) weigh tf x idf, idf = 1 + ln(N / df),
where df is the exact number of documents that hold the shingle, for every shingle: windows of documents count their own, the counts
are dealt out by hash and added up, and go back to their windows as bare numbers in the order of the window's shingles. Consistent
weighted samples are banded; nodes that share a band's bucket are verified by weighted Jaccard similarity on their whole
shingle sets, and classes are the connected components of the verified pairs.

Where copies are many, df of what they share grows with their number, so that each copy's few changes outweigh all the rest and
near copies of a large group come apart, the more so the larger it is. With copies_once, N and df (1 at least) are therefore counted
without copies of earlier texts: documents whose text is equal to another's, or shares one of 16 sketches with a text of a smaller digest.
A sketch is two min-hashes of the set of shingles, so at Jaccard similarity j to what a group has in common, a text is taken for
a copy with probability 1 - (1 - j^2)^16 (0.87 at 0.35, 0.99 at 0.5). Copies are only left out of the counts: all are sampled and compared.

Within a bucket, all members are first compared with one hub, and what they differ by from it is kept. Members that are one class
with the hub by then need no more; each of the others is compared with all of the hub's group, tile by tile, as
differences from the hub. No pair that could join two classes is left out, no pairs are listed, and no bucket is collected
in one task.

Defined cases: null, empty and white texts have no shingles and are alone in their classes unless their texts are equal;
texts of one to four words are one shingle; repeated rows share a class; null ids are ids like others but never
a class's name unless all are null; an empty table gives an empty result; other columns are not looked at by classes().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .graph import components
from .shared import attach, discard, forget, materialise, q

SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Bytes of the texts of a window, whose shingles are counted together before they are dealt out; a longer text is counted alone.
WINDOW = 2_000_000
#: Bytes of text whose shingles make one part of the count.
PART_BYTES = 6_000_000
#: Sketches of a text by which copies are known before shingles are counted, and min-hashes in each.
SKETCHES, SKETCH_ROWS = 16, 2
#: Members of a hub's group that are compared in one go.
TILE = 128
#: Texts to verify whose digests may be broadcast to pick them out of the corpus.
BROADCAST_NODES = 500_000
_TABLE = 1 << 16


class Sampler:
    """Consistent weighted samples: the random numbers of a shingle are drawn from fixed tables by its hash."""

    def __init__(self, number: int, usual: float, seed: int = 20_240_501):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
        self.beta = rng.random(_TABLE, np.float32)
        self.odd = textops.mix(np.arange(1, number + 1, dtype=np.uint64)) | np.uint64(1)
        self.usual = np.float32(usual)  # most shingles' log weight: its draws are tabled
        self.usual_a, self.usual_t = self.draw(np.arange(_TABLE), self.usual)

    def draw(self, at: np.ndarray, log_w: np.ndarray | np.float32) -> tuple[np.ndarray, np.ndarray]:
        """(ln a, t) of shingles with table places `at` and log weights."""
        r = self.r[at]
        t = np.floor(log_w / r + self.beta[at])
        return self.log_c[at] - r * (t - self.beta[at]) - r, t

    def samples(self, hashes: np.ndarray, log_w: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Samples of each row (rows x samples); rows must not be empty."""
        starts = np.cumsum(number) - number
        row = np.repeat(np.arange(len(number)), number)
        rest = np.flatnonzero(log_w != self.usual)
        out = np.empty((len(number), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            at = ((hashes * odd) >> np.uint64(48)).view(np.int64)
            a = self.usual_a[at]
            if len(rest):
                a[rest], rest_t = self.draw(at[rest], log_w[rest])
            pos = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), number))
            if len(pos) > len(number):  # equal draws: the smaller hash
                pos = pos[np.lexsort((hashes[pos], row[pos]))]
                pos = pos[np.append(True, np.diff(row[pos]) > 0)]
            t = self.usual_t[at[pos]]
            if len(rest):
                odd_ones = np.flatnonzero(log_w[pos] != self.usual)
                t[odd_ones] = rest_t[np.searchsorted(rest, pos[odd_ones])]
            out[:, k] = textops.mix(hashes[pos] + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def _weights(tf: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    """tf x idf as float32."""
    return tf.astype(np.float32) * (1.0 + np.log(total / df)).astype(np.float32)


def _sketches(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Buckets (rows x SKETCHES) of rows of ascending different shingles, none of them empty.

    The hashes are uniform, so the first one from a fixed point on, after the last again the first, is a min-hash: two sets agree
    on it with the probability of their Jaccard similarity.
    """
    points = SKETCHES * SKETCH_ROWS
    cell = (((values >> np.uint64(40)) * np.uint64(points)) >> np.uint64(24)).astype(np.int64)
    held = np.bincount(np.repeat(np.arange(len(number)) * points, number) + cell, minlength=len(number) * points)
    first, ends = (np.cumsum(held) - held).reshape(-1, points), np.cumsum(number)[:, None]
    found = values[np.where(first < ends, first, ends - number[:, None])].reshape(-1, SKETCHES, SKETCH_ROWS)
    odd = textops.mix(np.arange(201, 201 + SKETCH_ROWS, dtype=np.uint64)) | np.uint64(1)
    return textops.mix((found * odd).sum(axis=2, dtype=np.uint64) ^ textops.mix(np.arange(2001, 2001 + SKETCHES, dtype=np.uint64)))


def _sketched(rows: pa.RecordBatch) -> pa.Array:
    """Of rows (_id, _text, text): one list of (place, key, bucket), place the row's number and key the head of its digest."""
    keys = np.frombuffer(b"".join(rows.column(1).to_pylist()), ">i8")[::2].astype(np.int64)
    at, buckets = [np.zeros(0, np.int64)], [np.zeros((0, SKETCHES), np.uint64)]
    for low, high, words, counts in textops.chunks(rows.column(2)):
        values, _, number = textops.distinct(*textops.shingles(words, counts))
        some = np.flatnonzero(number)
        if len(some):
            at.append(low + some)
            buckets.append(_sketches(values, number[some]))
    place = np.repeat(np.concatenate(at), SKETCHES)
    parts = [pa.array(place.astype(np.int32)), pa.array(keys[place]), pa.array(np.concatenate(buckets).reshape(-1).view(np.int64))]
    return pa.ListArray.from_arrays(pa.array([0, len(place)], pa.int32()), pa.StructArray.from_arrays(parts, ["place", "key", "bucket"]))


def _blocks(batches: Iterator[pa.RecordBatch], sketched: bool) -> Iterator[pa.RecordBatch]:
    """Rows (_id, _text, text) -> block, rows, size and, if asked for, sketch: windows of rows, each a compressed Arrow stream."""
    kind = pa.schema([("_id", pa.int64()), ("_text", pa.binary()), ("text", pa.string())])
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        _, ends = textops.utf8(batch.column(2))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + WINDOW, "right")) - 1)
            out = pa.BufferOutputStream()
            rows = pa.RecordBatch.from_arrays([c.slice(low, high - low) for c in batch.columns], schema=kind)
            with pa.ipc.new_stream(out, kind, options=options) as stream:
                stream.write_batch(rows)
            columns = {"block": pa.array([out.getvalue().to_pybytes()], pa.binary()), "rows": pa.array([high - low]), "size": pa.array([ends[high] - ends[low]])}
            yield pa.RecordBatch.from_pydict(columns | ({"sketch": _sketched(rows)} if sketched else {}))
            low = high
    textops.release()


def _texts(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_all().combine_chunks().to_batches()[0]


def windows_of(rows: DataFrame, sketched: bool = False) -> DataFrame:
    """(window, block, rows, size): rows (_id, _text, text) in windows of about WINDOW bytes, written once; a longer text is alone.

    sketched: then their sketches too, by which copies() knows copies.
    """
    kind = "block binary, rows long, size long" + ", sketch array<struct<place: int, key: long, bucket: long>>" * sketched
    blocks = rows.mapInArrow(lambda it: _blocks(it, sketched), kind)
    return materialise(blocks.withColumn("window", F.monotonically_increasing_id()), "windows")


def _not_first(rows: DataFrame, many: int) -> DataFrame:
    """(window, place) of the rows (bucket, who, window, place) whose bucket holds a smaller who; `many`: a bucket with more rows is hot."""
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_members"), F.min("who").alias("_least"), F.max("who").alias("_most"))
    full = materialise(full.filter("_least < _most").select("bucket", "_members", "_least"), "shared-sketches")
    hot, usual = F.broadcast(full.filter(F.col("_members") > many)), full.filter(F.col("_members") <= many)
    both = rows.join(hot, "bucket").unionByName(rows.join(hot.select("bucket"), "bucket", "left_anti").join(usual, "bucket"))
    return both.filter("who > _least").select("window", "place")


def copies(windows: DataFrame) -> DataFrame:
    """(window, copies): the places, in windows with sketches, of documents that are copies of an earlier text."""
    said = windows.select("window", F.inline("sketch"))
    many = max(1, windows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] // 1000)  # fewer than a thousand buckets a sketch are larger
    near = _not_first(said.select("bucket", F.col("key").alias("who"), "window", "place"), many)
    each = windows.select("window", F.explode(F.filter("sketch", lambda x, k: k % SKETCHES == 0)).alias("_s")).select("window", "_s.place", F.col("_s.key").alias("bucket"))
    equal = _not_first(each.withColumn("who", F.struct("window", "place")), many)
    found = near.unionByName(equal).distinct().groupBy("window").agg(F.collect_list("place").alias("copies"))
    return materialise(found, "copies")


def _counted_windows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (window, block, copies) -> part, window, packed differences of its ascending shingles, documents of the window that hold each.

    Documents at the places in copies are not counted, but their shingles are there.
    """
    for batch in batches:
        for window, block, left_out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            texts = _texts(block.as_py())
            counted = np.ones(texts.num_rows, bool)
            counted[left_out or []] = False
            found, own = [], []
            for low, high, words, counts in textops.chunks(texts.column(2)):
                values, _, number = textops.distinct(*textops.shingles(words, counts))
                found.append(values)
                own.append(np.repeat(counted[low:high], number))
            values, n = np.unique(np.concatenate(found), return_counts=True)
            if not len(values):
                continue
            if left_out:
                held, times = np.unique(np.concatenate(found)[np.concatenate(own)], return_counts=True)
                n = np.zeros(len(values), np.int64)
                n[np.searchsorted(values, held)] = times
            part = ((values >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)  # ascending, like the shingles
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            slices = [slice(cuts[k], cuts[k + 1]) for k in some]
            keys = [textops.packed(np.diff(values[x], prepend=np.uint64(0)), np.uint64) for x in slices]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([window] * len(some), pa.int64()), pa.array(keys, pa.binary()), pa.array([textops.packed(n[x], np.uint32) for x in slices], pa.binary())], names=["part", "window", "keys", "n"])
    textops.release()


def _df_in_part(rows: pa.Table) -> pa.Table:
    """All windows' rows of one part -> window, part, df of the window's shingles in the part, in their order."""
    windows, part = rows.column("window").to_pylist(), rows.column("part")[0].as_py()
    keys = [np.cumsum(textops.unpacked(x, np.uint64), dtype=np.uint64) for x in rows.column("keys").to_pylist()]
    n = np.concatenate([textops.unpacked(x, np.uint32) for x in rows.column("n").to_pylist()])
    flat, ends = np.concatenate(keys), np.append(0, np.cumsum([len(x) for x in keys]))
    del keys
    order = np.argsort(flat)
    flat = flat[order]
    new = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    df = np.empty(len(flat), np.uint32)
    sums = np.maximum(np.add.reduceat(n[order], new, dtype=np.uint32), 1)  # 1 for what only copies hold
    df[order] = np.repeat(sums, np.diff(np.append(new, len(flat))))
    out = [textops.squeezed(df[low:high], np.uint32) for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    textops.release()
    return pa.table([pa.array(windows, pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["window", "part", "df"])


def counted_shingles(windows: DataFrame, left_out: DataFrame | None = None) -> tuple[int, DataFrame]:
    """(documents, (window, part, df)): in how many documents of all each of a window's shingles is, part by part.

    A window's shingles are counted before they are dealt out by hash, so that none is hot. What comes back is a number a
    shingle, without the shingles: their order says which is which. left_out (window, copies): documents that are not counted.
    """
    total, size = windows.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = int(max(1, min(size // PART_BYTES, 1 << 22)))
    texts = windows.select("window", "block")
    if left_out is None:
        texts = texts.withColumn("copies", F.lit(None).cast("array<int>"))
    else:
        total -= left_out.agg(F.coalesce(F.sum(F.size("copies")), F.lit(0))).first()[0]
        texts = attach(texts, left_out, ["window"], "window").select("window", "block", "copies")
    dealt = texts.mapInArrow(lambda it: _counted_windows(it, parts), "part int, window long, keys binary, n binary")
    return total, materialise(dealt.groupBy("part").applyInArrow(_df_in_part, "window long, part int, df binary"), "shingle-counts")


def window_shingles(texts: pa.Table, found: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """((batch, first row, last row + 1, shingles, tf, shingles a row) of each run of texts, the window's shingles, their df)."""
    runs = [(batch, low, high, *textops.distinct(*textops.shingles(words, counts))) for batch in map(_texts, texts.column("block").to_pylist()) for low, high, words, counts in textops.chunks(batch.column("text"))]
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[run[3] for run in runs]]))
    parts = sorted(zip(found.column("part").to_pylist(), found.column("df").to_pylist(), strict=True))
    df = np.concatenate([np.zeros(0, np.uint32), *[textops.unsqueezed(x, np.uint32) for _, x in parts]])
    return runs, keys, df


def weighted_jaccard(a: np.ndarray, a_w: np.ndarray, b: np.ndarray, b_w: np.ndarray) -> float:
    """Of two sets of ascending different hashes with their weights."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = np.flatnonzero(b[at] == a)
    low = float(np.minimum(a_w[same], b_w[at[same]]).sum(dtype=np.float64))
    return low / (float(a_w.sum(dtype=np.float64)) + float(b_w.sum(dtype=np.float64)) - low)


def _difference(a: np.ndarray, a_w: np.ndarray, b: np.ndarray, b_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, a's weight less b's) where the two sets differ."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    moved = np.where(same, a_w - b_w[at], a_w)
    gone = np.ones(len(b), bool)
    gone[at[same]] = False
    some = moved != 0
    return np.concatenate([a[some], b[gone]]), np.concatenate([moved[some], -b_w[gone]])


def _compare(batches: Iterator[pa.RecordBatch], rare: float, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (node, hub) with both sets -> node, hub, linked, hub's weight and the node's difference from the hub."""
    for batch in batches:
        lists = [batch.column(k) for k in range(2, 6)]
        ends = [c.offsets.to_numpy() for c in lists]
        data = [c.values.to_numpy(zero_copy_only=False) for c in lists]
        linked, weight, where, what = [], [], [], []
        for row in range(batch.num_rows):
            a, a_w, b, b_w = (data[c][ends[c][row] : ends[c][row + 1]] for c in range(4))
            a, b = a.view(np.uint64), b.view(np.uint64)  # ascending as unsigned
            a_w = a_w if len(a_w) else np.full(len(a), rare, np.float32)
            b_w = b_w if len(b_w) else np.full(len(b), rare, np.float32)
            places, moved = _difference(a, a_w, b, b_w)
            total, change = float(b_w.sum(dtype=np.float64)), moved.astype(np.float64)
            linked.append(total + np.minimum(change, 0).sum() >= similarity * (total + np.maximum(change, 0).sum()))
            weight.append(total)
            where.append(places)
            what.append(moved)
        offsets = pa.array(np.append(0, np.cumsum([len(x) for x in where])), pa.int32())
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (where, what)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(weight, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(flat[0].astype(np.uint64).view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.float32)))],
            names=["node", "hub", "linked", "hub_weight", "places", "moved"],
        )
    textops.release()


def _tile_links(left: list[tuple], right: list[tuple], hub_weight: float, similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """Links between rows (node, comp, places, moved) of two tiles of one hub's group, of different components.

    With both sets known as differences from the hub's, their overlap is the hub's weight less what either lacks, plus what both
    lack or both add.
    """
    sides = []
    for rows in (left, right):
        of = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        places, moved = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]).astype(np.float64)
        keys = places * np.uint64(2) + (moved > 0).astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        less = np.bincount(of, np.minimum(moved, 0), len(rows))
        total = hub_weight + np.bincount(of, moved, len(rows))
        values, starts = np.unique(keys[order], return_index=True)
        sides.append((of[order], np.abs(moved[order]), less, total, values, np.append(starts, len(keys))))
    (l_of, l_by, l_less, l_total, l_keys, l_at), (r_of, r_by, r_less, r_total, r_keys, r_at) = sides
    overlap = hub_weight + l_less[:, None] + r_less[None, :]
    _, i, j = np.intersect1d(l_keys, r_keys, assume_unique=True, return_indices=True)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        some, other = slice(l_at[x], l_at[x + 1]), slice(r_at[y], r_at[y + 1])
        overlap[np.ix_(l_of[some], r_of[other])] += np.minimum.outer(l_by[some], r_by[other])
    found = overlap >= similarity * (l_total[:, None] + r_total[None, :] - overlap)
    joined: set[tuple] = set()
    for x, y in zip(*np.nonzero(found), strict=True):
        a, b = left[x], right[y]
        if a[1] != b[1] and (ends := (min(a[1], b[1]), max(a[1], b[1]))) not in joined:
            joined.add(ends)  # one link joins two components
            yield a[0], b[0]


def _tiles(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, i, j, side): the links of each pair of tiles."""
    key, weight, sides = None, 0.0, ([], [])

    def links() -> Iterator[pa.RecordBatch]:
        if key is not None and sides[0] and sides[1]:
            pairs = list(_tile_links(*sides, weight, similarity))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs, strict=True)], names=["a", "b"])

    for batch in batches:
        places, moved = batch.column(7), batch.column(8)
        flat, ends = places.values.to_numpy(zero_copy_only=False).view(np.uint64), places.offsets.to_numpy()
        values = moved.values.to_numpy(zero_copy_only=False)
        for row, (hub, i, j, side, node, comp, w) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)):
            if (hub, i, j) != key:
                yield from links()
                key, weight, sides = (hub, i, j), w, ([], [])
            part = slice(ends[row], ends[row + 1])
            sides[side].append((node, comp, flat[part].copy(), values[part].copy()))
    yield from links()


def link_buckets(members: DataFrame, sets: DataFrame, rare: float, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified links that join all linked members of all buckets.

    members (bucket, node), sets (node, shingles, weights; no weights: all `rare`). Every bucket's hub, the member with the most
    company in all its buckets, is compared with the others; those of a hub's group that are still in different components
    are compared tile by tile, as differences from the hub.
    """
    nodes = sets.select("node")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialise(sizes, "bucket-sizes")
    many = max(1, members.count() // 1000)  # fewer than a thousand buckets are larger than this

    def with_bucket(table: DataFrame) -> DataFrame:
        hot = members.join(F.broadcast(table.filter(F.col("_n") > many)), "bucket")
        large = F.broadcast(table.filter(F.col("_n") > many).select("bucket"))
        return hot.unionByName(members.join(large, "bucket", "left_anti").join(table.filter(F.col("_n") <= many), "bucket"))

    company = materialise(with_bucket(sizes).groupBy("node").agg(F.sum("_n").alias("_company")), "company")
    ranked = members.join(company, "node").groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_company", "node")).alias("_top"))
    hubs = materialise(ranked.select("bucket", "_n", F.col("_top.node").alias("hub")), "hubs")
    pairs = materialise(with_bucket(hubs).filter("node <> hub").select("node", "hub").distinct(), "pairs")
    groups = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("_chunks"))
    groups = materialise(groups, "hub-groups")
    # a hub's set goes to every 64 of its partners
    theirs = groups.join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", F.col("shingles").alias("h_s"), F.col("weights").alias("h_w"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    mine = attach(pairs, groups, ["hub"], "node").withColumn("_chunk", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int")).drop("_chunks").join(sets, "node")
    both = mine.join(theirs, ["hub", "_chunk"]).select("node", "hub", "shingles", "weights", "h_s", "h_w")
    compared = both.mapInArrow(lambda it: _compare(it, rare, similarity), "node binary, hub binary, linked boolean, hub_weight double, places array<long>, moved array<float>")
    compared = materialise(compared, "compared")
    links = compared.filter("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    comp = materialise(components(nodes, links), "components").filter("comp <> node")
    rows = attach(compared, comp, ["node"], "hub").withColumn("comp", F.coalesce("comp", "node"))
    rows = attach(rows, comp.select(F.col("node").alias("hub"), F.col("comp").alias("_hub_comp")), ["hub"], "node").withColumn("_hub_comp", F.coalesce("_hub_comp", "hub"))
    rows = rows.withColumn("_apart", F.col("comp") != F.col("_hub_comp"))
    counts = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_apart").alias("_apart_n"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
    tiles = counts.filter("_apart_n > 0 and _lo <> _hi").select("hub", F.ceil(F.col("_all") / TILE).cast("int").alias("_t_all"), F.ceil(F.col("_apart_n") / TILE).cast("int").alias("_t_apart"))
    rows = attach(rows, materialise(tiles, "tiles"), ["hub"], "node").filter("_t_all is not null")
    # left: those apart from their hub; right: all of the group
    turn = F.xxhash64("node", "hub")
    left_tile, right_tile = F.pmod(turn, F.col("_t_apart")).cast("int"), F.pmod(turn, F.col("_t_all")).cast("int")
    seat = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    on_left = F.transform(F.sequence(F.lit(0), F.col("_t_all") - 1), lambda j: seat(left_tile, j, 0))
    on_right = F.transform(F.sequence(F.lit(0), F.col("_t_apart") - 1), lambda i: seat(i, right_tile, 1))
    seated = rows.withColumn("_seat", F.explode(F.when(F.col("_apart"), F.concat(on_left, on_right)).otherwise(on_right)))
    seated = seated.select("hub", "_seat.i", "_seat.j", "_seat.side", "node", "comp", "hub_weight", "places", "moved")
    seated = seated.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side")
    more = seated.mapInArrow(lambda it: _tiles(it, similarity), "a binary, b binary")
    return links.union(materialise(more, "links"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, copies_once: bool = False) -> DataFrame:
    """One row a document: _id, _text (digest), class_id (smallest id of the class), n_class (its documents).

    copies_once: shingles are weighed by the documents that hold them without those that are copies of an earlier text.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.md5(F.coalesce(q(text_col).cast("string"), F.lit(""))))
    rows_in = docs.select(q(id_col).cast("long").alias("_id"), digest.alias("_text"), q(text_col).cast("string").alias("text"))
    windows = windows_of(rows_in, copies_once)
    total, counted = counted_shingles(windows, copies(windows) if copies_once else None)
    rare = float(np.float32(1.0 + np.log(max(total, 1))))  # idf of what one document holds
    forget(spark)
    made: list[Sampler] = []

    def signed(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not made:
            made.append(Sampler(bands * rows, float(np.log(np.float32(rare)))))
        sampler = made[0]
        weights = textops.mix(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
        names = textops.mix(np.arange(1001, 1001 + bands, dtype=np.uint64))
        runs, keys, counts = window_shingles(texts, found)
        out = []
        for batch, low, high, values, tf, number in runs:
            df = counts[np.searchsorted(keys, values)]
            buckets = np.zeros((high - low, bands), np.uint64)
            some = np.flatnonzero(number)
            if len(some):
                drawn = sampler.samples(values, np.log(_weights(tf, df, total)), number[some]).reshape(len(some), bands, rows)
                buckets[some] = textops.mix((drawn * weights).sum(axis=2, dtype=np.uint64) ^ names)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(number > 0, bands, 0))]), pa.int32()), pa.array(buckets[some].reshape(-1).view(np.int64)))
            ends = np.append(0, np.cumsum(number))
            of_text = [df[ends[k] : ends[k + 1]] for k in range(high - low)]
            packed = pa.array([textops.squeezed(x, np.uint32) if (x > 1).any() else b"" for x in of_text], pa.binary())
            out.append(pa.RecordBatch.from_arrays([batch.column("_id").slice(low, high - low), batch.column("_text").slice(low, high - low), lists, packed], names=["_id", "_text", "buckets", "df"]))
        textops.release()
        return pa.Table.from_batches(out, pa.schema([("_id", pa.int64()), ("_text", pa.binary()), ("buckets", pa.list_(pa.int64())), ("df", pa.binary())]))

    both = windows.select("window", "block").groupBy("window").cogroup(counted.groupBy("window"))
    signed_rows = materialise(both.applyInArrow(signed, "_id long, _text binary, buckets array<long>, df binary"), "signatures")
    for done in [files[0].rpartition("/")[0] for files in (windows.inputFiles(), counted.inputFiles()) if files]:
        discard(spark, done)
    forget(spark)
    texts = materialise(signed_rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")), "texts")
    # a text's buckets are those of any of its rows
    said = signed_rows.select("_text", F.explode("buckets").alias("bucket"))
    full = said.groupBy("bucket").agg(F.count(F.lit(1)).alias("_members"), F.min("_text").alias("_lo"), F.max("_text").alias("_hi")).filter("_lo <> _hi")
    full = materialise(full.select("bucket", "_members"), "full-buckets")
    many = F.lit(max(1, total // 1000))
    hot = F.broadcast(full.filter(F.col("_members") > many).select("bucket"))  # under 1000 a band
    members = said.join(hot, "bucket", "left_semi").union(said.join(hot, "bucket", "left_anti").join(full.filter(F.col("_members") <= many).select("bucket"), "bucket", "left_semi"))
    members = materialise(members.select("bucket", F.col("_text").alias("node")).distinct(), "bucket-members")
    nodes = materialise(members.select("node").distinct(), "nodes")
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words, counts in textops.chunks(batch.column(1)):
                values, tf, number = textops.distinct(*textops.shingles(words, counts))
                ends = pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32())
                packed = batch.column(2).slice(low, high - low).to_pylist()
                df = np.concatenate([np.zeros(0, np.uint32), *[textops.unsqueezed(x, np.uint32) if x else np.ones(n, np.uint32) for x, n in zip(packed, number.tolist(), strict=True)]])
                weights = _weights(tf, df, total)
                usual = np.minimum.reduceat(weights == np.float32(rare), (np.cumsum(number) - number)[number > 0]) if len(weights) else np.zeros(0, bool)
                kept = number.copy()
                kept[np.flatnonzero(number)[usual]] = 0  # all rare: no weights are sent
                weights = weights[np.repeat(kept > 0, number)]
                w_ends = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64))), pa.ListArray.from_arrays(w_ends, pa.array(weights))], names=["node", "shingles", "weights"])
        textops.release()

    holders = texts.select("_text", "_first").join(nodes.withColumnRenamed("node", "_text"), "_text", "left_semi")
    one_each = rows_in.join(F.broadcast(holders) if few else holders, "_text").filter(F.col("_id").eqNullSafe(F.col("_first")))
    dfs = signed_rows.select("_text", "_id", "df").join(F.broadcast(holders) if few else holders, "_text").filter(F.col("_id").eqNullSafe(F.col("_first")))
    one_each = one_each.select("_text", "text").dropDuplicates(["_text"]).join(dfs.select("_text", "df").dropDuplicates(["_text"]), "_text")
    sets = one_each.mapInArrow(sets_of, "node binary, shingles array<long>, weights array<float>")
    sets = materialise(sets, "shingle-sets")
    links = link_buckets(members, sets, rare, similarity)
    comp = materialise(components(nodes, links), "classes").filter("comp <> node")
    named = attach(texts, comp.withColumnRenamed("node", "_text"), ["_text"], "_text").withColumn("comp", F.coalesce("comp", "_text"))
    sizes = named.groupBy("comp").agg(F.min("_first").alias("class_id"), F.sum("_n").alias("n_class"))
    sizes = materialise(sizes, "class-sizes")
    named = attach(named, sizes.filter("n_class > 1"), ["comp"], "_text").select("_text", F.coalesce("class_id", "_first").alias("class_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))
    shared = materialise(named.filter("n_class > 1"), "shared-classes")
    result = attach(signed_rows.select("_id", "_text"), shared, ["_text"], "_id")
    return result.select("_id", "_text", F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class: that of the smallest id (of repeated rows, one)."""
    found = classes(docs, id_col, text_col, **options).filter("n_class > 1")
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63)))
    marks = found.select(key(F.col("_id")).alias("_key"), F.col("_text").alias("_digest"), (key(F.col("_id")) == key(F.col("class_id"))).alias("_first")).distinct()
    marks = materialise(marks, "class-members")
    few = marks.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    digest = F.unhex(F.md5(F.coalesce(q(text_col).cast("string"), F.lit(""))))
    d = docs.withColumn("_key", key(q(id_col))).withColumn("_digest", digest)
    d = d.join(F.broadcast(marks) if few else marks, ["_key", "_digest"], "left")
    first = d.filter("_first").dropDuplicates(["_key", "_digest"])
    return d.filter("_first is null").unionByName(first).select(*[q(c) for c in docs.columns])
