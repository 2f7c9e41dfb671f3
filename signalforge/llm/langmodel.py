"""Hashed maximum-entropy language model: class-factored softmax over n-gram and skip features.

Tokens are words (ASCII case folded) and one end a text. P(token | history) = P(class | history) P(token | class, history). A
word's class follows from its ending, so unseen words have one too; the most frequent endings of the training words are
classes of their own. Both factors are softmaxes whose weights are looked up by hashed features of the history. For the class:
the last word, the last two words, the word before the last (skip), and the classes of the last two. Within the class: the
last word and the word before it, each with the class. Within a class the outcomes are its most frequent words, and all others
together; one of these then has its add-one smoothed share of the training words there, with one unseen word.

Weights are learned by distributed gradient rounds: every task sums the gradient of its texts at common weights, in whole numbers of
a fixed fraction, sums are added row by row, and each weight moves by its share of its own counts. The sums do not depend on
how texts are dealt out, nor do the weights. The first round, whose probabilities are the priors, takes counts alone; the
others take the texts by a hash of their ids. The number of hashed rows grows with the square root of the counted
vocabulary, and a task sums over as many tokens as make its sums small beside its texts.

Counts of words cover the whole corpus; scoring looks frequent words up in a bounded table that all tasks hold, and the
rest by a join. Row keys and partial scores are written once, so a lost executor changes no result.

Defined cases: null text is empty (its end is its only token); the longest texts are read whole; null ids count as the text "" where
the fold and the round are chosen; repeated rows are texts of their own; with no training text every token is unknown and each class
as likely; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, q
from .textops import chunks, mix, release, squeezed, unsqueezed

#: Classes, and outcomes within a class.
CLASSES = 32
_HASHED = 7  # classes that share the rarer endings
#: Hashed rows of a feature: so many times the square root of the different words, and at least LEAST_ROWS.
ROWS, LEAST_ROWS = 8, 1 << 12
#: Tokens that a task sums over, at least, for each hashed row of a feature.
TOKENS_A_ROW = 256
#: Words whose counts every scoring task holds: the most frequent, at most so many.
FREQUENT = 1 << 20
#: Gradient rounds after the counts, the share of its counts that a weight moves by, and what is added to them.
ROUNDS, FIRST_RATE, RATE, SMOOTH = 2, 0.7, 0.5, 4.0
BATCH = 8192
#: A probability is summed in whole numbers of 1 / UNIT: BATCH of them are exact in single precision.
UNIT = 1 << 10
#: Rows of sums sent together.
SENT = 256
_END, _REST, _START = 0, CLASSES - 1, np.uint64(0x5851F42D4C957F2D)
#: Features of the class and within the class; the last one of the class has a row for each pair of classes.
OUTER, INNER = 4, 2


@dataclass
class Tables:
    """What every task holds."""

    rows: int
    classes: np.ndarray  # class of an ending
    tops: np.ndarray  # the classes' most frequent words, each at the place of its first 16 bits or one soon after
    outcomes: np.ndarray  # their outcomes
    probes: int  # places in a row that a word may be at
    priors: np.ndarray  # log of each class's share
    inner: np.ndarray  # log of each outcome's share within its class
    weights: np.ndarray  # rows of all features x CLASSES

    def starts(self) -> list[int]:
        """The first row of each feature."""
        return [0, self.rows, 2 * self.rows, 3 * self.rows, 3 * self.rows + CLASSES**2, 4 * self.rows + CLASSES**2]


@dataclass
class Model:
    counts: DataFrame  # word long, n long
    tokens: int
    distinct: int
    ends: int
    words: np.ndarray  # frequent words, ascending
    first: np.ndarray  # where those with given first bits begin
    word_logs: np.ndarray  # their log10(count + 1)
    floor: int  # words with at least this level of counts are in `words`
    norms: np.ndarray  # log10(tokens + different words + 1) of the others in each class
    tables: Tables


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _firsts(words: np.ndarray) -> np.ndarray:
    """Where the ascending words with each value of their first bits begin; as many values as words, about."""
    bits = max(1, len(words).bit_length())
    return np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)


def _places(words: np.ndarray, first: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the words, whether it is there) of each word asked for."""
    if not len(words):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    top = len(words) - 1
    at = np.minimum(first[(asked >> np.uint64(65 - len(first).bit_length())).astype(np.int64)], top)
    todo = np.flatnonzero(words[at] < asked)
    while len(todo):
        at[todo] += 1
        todo = todo[at[todo] <= top]
        todo = todo[words[at[todo]] < asked[todo]]
    at = np.minimum(at, top)
    return at, words[at] == asked


def _classes_of(endings: np.ndarray) -> np.ndarray:
    """Class of every two-byte ending: the most frequent alone, the rest by hash; class 0 is the end's."""
    own = CLASSES - 1 - _HASHED
    out = (CLASSES - _HASHED + (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(_HASHED)).astype(np.int64)).astype(np.int16)
    top = np.argsort(-endings, kind="stable")[:own]
    top = top[endings[top] > 0]
    out[top] = np.arange(1, 1 + len(top))
    return out


def _slotted(words: np.ndarray, outcomes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, outcomes, places tried at most) of a table in which each word lies at its first 16 bits, or at the next free place."""
    table, out, probes = np.zeros(1 << 16, np.uint64), np.full(1 << 16, _REST), 0
    while len(words):
        at = ((words >> np.uint64(48)).astype(np.int64) + probes) & 0xFFFF
        first = np.zeros(len(words), bool)
        first[np.unique(at, return_index=True)[1]] = True
        placed = first & (out[at] == _REST)
        table[at[placed]], out[at[placed]] = words[placed], outcomes[placed]
        words, outcomes, probes = words[~placed], outcomes[~placed], probes + 1
    return table, out, probes


def _outcomes(t: Tables, words: np.ndarray) -> np.ndarray:
    """Each word's outcome within its class."""
    at = (words >> np.uint64(48)).astype(np.int64)
    out = np.full(len(words), _REST)
    for _ in range(t.probes):
        out = np.where(t.tops[at] == words, t.outcomes[at], out)
        at = (at + 1) & 0xFFFF
    return out


def _sequence(t: Tables, words: np.ndarray, counts: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows: features x tokens, class of each token, outcome within it) of texts, each with its end."""
    n = len(words) + len(counts)
    stops = np.cumsum(counts + 1) - 1
    is_end = np.zeros(n, bool)
    is_end[stops] = True
    token, kind, outcome = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    token[~is_end], kind[~is_end] = words, t.classes[tails]
    outcome[~is_end] = _outcomes(t, words)
    begin = np.zeros(n, bool)
    begin[np.append(0, stops[:-1] + 1)] = True
    second = np.zeros(n, bool)
    second[1:] = begin[:-1] & ~begin[1:]
    last, last_kind = np.roll(token, 1), np.roll(kind, 1)
    last[begin], last_kind[begin] = _START, _END
    skip, skip_kind = np.roll(token, 2), np.roll(kind, 2)
    skip[begin | second], skip_kind[begin | second] = _START, _END
    top = np.uint64(64 - t.rows.bit_length() + 1)
    own_class = mix(kind.view(np.uint64) + np.uint64(0x51ED270B))
    rows = np.empty((OUTER + INNER, n), np.int64)
    for k, (start, value) in enumerate(zip(t.starts(), (last, last + mix(skip + np.uint64(1)), skip ^ np.uint64(0x2545F4914F6CDD1D), None, last + own_class, skip ^ own_class), strict=True)):
        rows[k] = start + (skip_kind * CLASSES + last_kind if value is None else (mix(value) >> top).astype(np.int64))
    return rows, kind, outcome


def _chances(prior: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, their exponentials, sums of these) of tokens; a token's do not depend on the others."""
    z = weights[rows[0]]
    for own in rows[1:]:
        z += weights[own]
    z += prior
    np.clip(z, -80, 80, out=z)  # in the range of float32's exp, so no maximum need be taken off
    e = np.exp(z)
    return z, e, e.sum(axis=1)


def _factors(t: Tables, rows: np.ndarray, kind: np.ndarray, outcome: np.ndarray) -> Iterator[tuple]:
    """(features, what came, prior) of both factors."""
    yield slice(0, OUTER), kind, t.priors
    yield slice(OUTER, OUTER + INNER), outcome, t.inner[kind]


def token_logs(t: Tables, words: np.ndarray, counts: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of P(class | history) P(outcome | class, history), class, whether the outcome is a class's other words) of each token."""
    rows, kind, outcome = _sequence(t, words, counts, tails)
    out = np.empty(len(kind))
    for low in range(0, len(kind), BATCH):
        part = slice(low, low + BATCH)
        logs = np.zeros(len(kind[part]))
        for features, came, prior in _factors(t, rows[:, part], kind[part], outcome[part]):
            z, _, total = _chances(prior, t.weights, rows[features, part])
            logs += z[np.arange(len(came)), came].astype(np.float64) - np.log(total.astype(np.float64))
        out[part] = logs / np.log(10.0)
    return out, kind, (outcome == _REST) & (kind != _END)


def count_words(docs: DataFrame) -> DataFrame:
    """(word long, tail int, n long) of texts (column 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            words, tails = (np.concatenate(x) for x in zip(*held, strict=True))
            values, at, n = np.unique(words, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(tails[at].astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])

        for batch in batches:
            for _, _, words, _, tails in chunks(batch.column(0), tails=True):
                held.append((words, tails))
                size += len(words)
                if size >= 4_000_000:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    partial = docs.mapInArrow(count, "word long, tail int, n long")
    return partial.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _counted(t: Tables, texts: Iterator[tuple]) -> np.ndarray:
    """How often each outcome came with each row."""
    size = len(t.weights) * CLASSES
    out, held, n = np.zeros(size, np.int64), [], 0
    for words, counts, tails in texts:
        rows, kind, outcome = _sequence(t, words, counts, tails)
        held += [(rows[:OUTER] * CLASSES + kind).ravel(), (rows[OUTER:] * CLASSES + outcome).ravel()]
        n += rows.size
        if n > size:
            out += np.bincount(np.concatenate(held), minlength=size)
            held, n = [], 0
    if held:
        out += np.bincount(np.concatenate(held), minlength=size)
    return out.reshape(-1, CLASSES)


def _gradient(t: Tables, texts: Iterator[tuple]) -> np.ndarray:
    """Sums of probability less what came, in 1 / UNIT, of each row."""
    out = np.zeros((len(t.weights), CLASSES), np.int64)
    some, tokens = np.zeros(out.shape, np.int32), 0
    kind_of = np.uint16 if t.rows <= 1 << 16 else np.uint32  # 16 bits: a radix sort
    starts = t.starts()
    for words, counts, tails in texts:
        rows, kind, outcome = _sequence(t, words, counts, tails)
        for low in range(0, len(kind), BATCH):
            part = slice(low, low + BATCH)
            if (tokens + BATCH) * UNIT >= 1 << 31:
                out += some
                some[:], tokens = 0, 0
            tokens += BATCH
            for features, came, prior in _factors(t, rows[:, part], kind[part], outcome[part]):
                _, error, total = _chances(prior, t.weights, rows[features, part])
                error *= (UNIT / total)[:, None]
                np.rint(error, out=error)
                error[np.arange(len(came)), came] -= UNIT
                for k in range(features.start, features.stop):
                    own = rows[k, part]
                    order = np.argsort((own - starts[k]).astype(kind_of), kind="stable")
                    own = own[order]
                    at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    # whole numbers: exact in any order, two columns at once
                    some[own[at]] += np.add.reduceat(error[order].view(np.complex64), at, axis=0).view(np.float32).astype(np.int32)
    return out + some


def _summed(texts: DataFrame, tables: Tables, work) -> np.ndarray:
    """The sums of work(tables, texts) over all tasks, as float32."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = work(shared.value, ((words, counts, tails) for batch in batches for _, _, words, counts, tails in chunks(batch.column(0), tails=True)))
        for low in range(0, len(sums), SENT):
            if sums[low : low + SENT].any():
                yield pa.RecordBatch.from_arrays([pa.array([low // SENT], pa.int32()), pa.array([squeezed(sums[low : low + SENT].ravel(), np.int64)], pa.binary())], names=["part", "sums"])
        release()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = unsqueezed(data, np.int64)
                sums[part] = sums[part] + own if part in sums else own
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.astype(np.float32).tobytes()], pa.binary())], names=["part", "sums"])

    out = np.zeros(tables.weights.shape, np.float32)
    parts = -(-len(out) // SENT)
    table = texts.mapInArrow(run, "part int, sums binary").repartition(min(parts, 64), "part").mapInArrow(total, "part int, sums binary").toArrow()
    for part, data in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        out[part * SENT : (part + 1) * SENT] = np.frombuffer(data, np.float32).reshape(-1, CLASSES)
    shared.unpersist()
    return out


def _expected(t: Tables, counts: np.ndarray) -> np.ndarray:
    """What the priors alone expect of each row, given how often it came: within a class, by what came with its rows."""
    starts = t.starts()
    out = counts.sum(axis=1, keepdims=True) * np.exp(t.priors)[None, :]
    if len(t.weights) > starts[OUTER]:
        inner = counts[starts[OUTER] :]
        # a row within a class is nearly always of one class: the one whose priors make its counts likeliest
        logs = inner @ np.maximum(t.inner, -20).T
        out[starts[OUTER] :] = inner.sum(axis=1, keepdims=True) * np.exp(t.inner[np.argmax(logs, axis=1)])
    return out.astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, rate: float = RATE, frequent: int = FREQUENT) -> Model:
    """The model of all texts of docs."""
    texts = docs.select(q(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.coalesce(q(id_col).cast("string"), F.lit(""))), F.lit(max(rounds, 1))).alias("round"))
    counts = materialise(count_words(texts.select("text")), "word-counts")
    ends = docs.count()
    endings = np.zeros(1 << 16, np.int64)
    by_ending = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()  # at most 65536 rows
    tail, mass, words = (by_ending.column(k).to_numpy() for k in range(3))
    endings[tail] = mass
    classes = _classes_of(endings)
    class_mass = np.bincount(classes[tail], mass, CLASSES)
    class_words = np.bincount(classes[tail], words, CLASSES)
    class_mass[_END] = ends
    reached = np.bincount(classes, minlength=CLASSES) > 0  # by some ending
    reached[_END] = True
    priors = np.where(reached, np.log((class_mass + 1) / (class_mass.sum() + reached.sum())), -80).astype(np.float32)
    # the frequent words: counts by eighths of a power of two, down to where the bound is reached
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1))).collect()), reverse=True)
    least, total = 1 << 30, 0
    for at, n in levels:
        if total + n > frequent:
            break
        least, total = at, total + n
    often = counts.filter(level >= least).select("word", "n", "tail").toArrow()
    hashes, n, tails = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy(), often.column(2).to_numpy()
    order = np.argsort(hashes)
    hashes, n, kinds = hashes[order], n[order], classes[tails[order]].astype(np.int64)
    # the most frequent words of each class are outcomes of their own
    by_class = np.lexsort((hashes, -n, kinds))
    place = np.arange(len(by_class)) - np.searchsorted(kinds[by_class], np.arange(CLASSES))[kinds[by_class]]
    tops, outcomes = by_class[place < _REST], place[place < _REST]
    top_words, top_outcomes, probes = _slotted(hashes[tops], outcomes)
    shares = np.zeros((CLASSES, CLASSES))
    shares[kinds[tops], outcomes] = n[tops]
    rest_mass = class_mass - shares.sum(axis=1)
    rest_words = class_words - np.bincount(kinds[tops], minlength=CLASSES)
    shares[:, _REST] = rest_mass + 1
    shares[_END] = 0
    shares[_END, 0] = 1  # the end is its class's only outcome
    with np.errstate(divide="ignore"):
        inner = np.maximum(np.log(shares / shares.sum(axis=1, keepdims=True)), -80).astype(np.float32)
    norms = np.log10(rest_mass + rest_words + 1)
    distinct = int(words.sum())
    rows = 1 << int(np.ceil(np.log2(max(LEAST_ROWS, ROWS * np.sqrt(distinct)))))
    tables = Tables(rows, classes, top_words, top_outcomes, probes, priors, inner, np.zeros(((OUTER - 1 + INNER) * rows + CLASSES**2, CLASSES), np.float32))
    tokens = int(mass.sum()) + ends
    tasks = max(1, tokens // (TOKENS_A_ROW * rows))
    came = _summed(texts.select("text").coalesce(tasks), tables, _counted)
    expected = _expected(tables, came)
    scale = np.maximum(came, expected) + np.float32(SMOOTH)
    tables.weights = (FIRST_RATE * (came - expected) / scale).astype(np.float32)
    tables.weights[expected < 1e-6] = 0  # no such outcome in the class
    del came
    for turn in range(rounds):
        gradient = _summed(texts.filter(F.col("round") == turn).select("text").coalesce(max(1, tasks // rounds)), tables, _gradient)
        gradient *= np.float32(rounds / UNIT)
        tables.weights -= np.float32(rate) * np.clip(gradient / scale, -1, 1)
        tables.weights[expected < 1e-6] = 0
    return Model(counts.select("word", "n"), tokens, distinct + (ends > 0), ends, hashes, _firsts(hashes), np.log10(n + 1.0), least, norms, tables)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' _id with _n_tokens, _n_known, _base_score and _score (log10 probabilities of the texts)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.words, model.first, model.word_logs, model.norms, model.tables))
    base, ends = float(np.log10(model.tokens + model.distinct + 1)), model.ends

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, first, logs, norms, tables = shared.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high, words, counts, tails in chunks(batch.column(1), tails=True):
                docs_here = high - low
                by_token, kind, rest = token_logs(tables, words, counts, tails)
                by_token[rest] -= norms[kind[rest]]
                doc_of = np.repeat(np.arange(docs_here), counts + 1)
                history = np.bincount(doc_of, by_token, docs_here)
                word_doc = np.repeat(np.arange(docs_here), counts)
                is_word = np.ones(len(by_token), bool)
                is_word[np.cumsum(counts + 1) - 1] = False
                rest = rest[is_word]
                at, known = _places(frequent, first, words)
                said = np.bincount(word_doc[known], logs[at[known]] if len(frequent) else None, docs_here)
                among = known & rest  # a class's own outcomes have no count in the score
                history = history + np.bincount(word_doc[among], logs[at[among]] if len(frequent) else None, docs_here)
                n_known = np.bincount(word_doc[known], minlength=docs_here)
                rare, rare_doc = words[~known], word_doc[~known]
                order = np.lexsort((rare, rare_doc))
                rare, rare_doc = rare[order], rare_doc[order]
                new = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1]))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rare))).astype(np.int32)
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(rare_doc[new], minlength=docs_here))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + np.arange(docs_here)), batch.column(0).slice(low, docs_here), pa.array(counts + 1), pa.array(n_known), pa.array(said.astype(np.float64)), pa.array(history),
                        pa.ListArray.from_arrays(offsets, pa.array(rare[new].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times)),
                    ],
                    names=["row", "_id", "tokens", "known", "said", "history", "rare", "times"],
                )
                key += docs_here
        release()

    source = docs.select(q(id_col).cast("long"), q(text_col).cast("string"))
    rows = materialise(source.mapInArrow(partial, "row long, _id long, tokens long, known long, said double, history double, rare array<long>, times array<int>"), "scores")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    level = F.floor(F.log2("n") * 8).cast("int")
    found = rare.join(model.counts.filter(level < model.floor), "word")
    found = found.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    d = rows.drop("rare", "times").join(found, "row", "left")
    said = F.col("said") + F.coalesce("logs", F.lit(0.0))
    end = float(np.log10(ends + 1.0))
    known = F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))
    score = F.col("history") + F.coalesce("logs", F.lit(0.0))
    return d.select("_id", F.col("tokens").alias("_n_tokens"), known.alias("_n_known"), (said + end - F.col("tokens") * base).alias("_base_score"), score.alias("_score"))
