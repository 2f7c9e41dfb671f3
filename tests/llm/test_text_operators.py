"""Infilling, license scans and periodic runs against brute force, on small tables with every odd case."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalforge.llm import infill, licenses, periods
from signalforge.llm import queries as llm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns called like working columns of the operators.
CLASHES = ["_said", "_h0", "_row", "_id", "_runs", "_n_units", "_form", "_text", "_words", "c0", "value"]


def documents(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    for c in CLASHES:
        d = d.withColumn(c, F.lit("own"))
    return d


# ---- periodic runs ----


def brute_runs(words, shortest=12):
    """{(start, length): period} by comparing all words so many apart."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        same = [a == b for a, b in zip(words, words[q:], strict=False)]
        at = 0
        for equal, part in itertools.groupby(same):
            n = len(list(part))
            if equal and n >= q and n + q >= shortest:
                found.setdefault((at, n + q), q)
            at += n
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(seed, n, letters):
    rng, out = random.Random(seed), []
    while len(out) < n:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        out += (unit * rng.randint(1, 5))[: rng.randint(1, 40)]
    return out[:n]


def run_texts():
    texts = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a b " * 6, "x a b c a b c a b c a b c y", "x\ta\nb  a b a b a b a b a b a\x0bq", "A a " * 20, "ü ü " * 14, "a " * 3000]
    texts += [" ".join(repetitive(k, 30 + 17 * k, "ab" if k % 2 else "abcde")) for k in range(14)]
    return texts


@pytest.mark.parametrize("together", [64, 1 << 16])
def test_runs_equal_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(periods, "TOGETHER", together)
    monkeypatch.setattr(periods, "PLACES", 50)
    texts = run_texts()
    for k, (start, length, period) in enumerate([r.tolist() for r in _runs_of(t)] for t in texts):
        assert sorted(zip(start, length, period, strict=True)) == brute_runs((texts[k] or "").split() if k != 10 else WORD.findall(texts[k]))
    rows = [*enumerate(texts), (3, texts[-1]), (3, texts[-1]), (None, "b " * 13)]
    got = periods.find(documents(spark, rows)).select("doc_id", "text", "_n_words", "_runs", "_collapsed", "value").collect()
    want = []
    for i, text in rows:
        words = WORD.findall(text or "")
        runs = brute_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, text, len(words), sorted((s, n, q) for s, n, q in runs), " ".join(w for k, w in enumerate(words) if k not in gone), "own"))
    have = [(r.doc_id, r.text, r._n_words, [tuple(x) for x in r._runs], r._collapsed, r.value) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert periods.find(documents(spark, [])).count() == 0


def _runs_of(text):
    words = WORD.findall(text or "")
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return periods.runs(np.array([names[w] for w in words], np.int64), np.zeros(len(words), np.int64))


def test_random_words_equal_brute_force():
    rng = random.Random(3)
    for case in range(150):
        words = repetitive(case, rng.randint(0, 200), "ab" if case % 3 else "abcdef")
        start, length, period = _runs_of(" ".join(words)).tolist()
        assert sorted(zip(start, length, period, strict=True)) == brute_runs(words)
    start, length, period = periods.runs(np.array([0] * 30 + [0] * 30), np.array([0] * 30 + [1] * 30)).tolist()
    assert (start, length, period) == ([0, 30], [30, 30], [1, 1])  # a run ends with its text


def test_runs_query(spark, tmp_path):
    texts = [t for k in range(5) for t in run_texts()]
    rows = [*enumerate(texts), (None, "a b c d e f g h")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.collapsed_sha256): r for r in llm.op13_runs(spark, str(tmp_path)).collect()}
    assert len({k for k, _ in got}) == len(rows)
    for i, text in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        collapsed = hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
        r = got[i, collapsed]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256) == (len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest())


# ---- fill-in-middle ----

CUT_TEXTS = [None, "", "a", "plain <P> sentinel", "<S", "no <M> here", "ends with <", "üñí 日本語 😀 text", "two words", " lead and trail ", "line\nline\n\nlast", "x" * 9000, "日" * 9000 + "\n" + "é é " * 500]


def cut_by_hand(i, text, starts, rate=90, spm=20, seed=1):
    """(units, form, prefix, middle, output) by slices of the whole text."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    places = starts(text)
    n = len(places)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    at = lambda r: 0 if r == 0 else places[r] if r < n else len(text)
    pre, mid, suf = text[: at(a)], text[at(a) : at(b)], text[at(b) :]
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, a, b - a, f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


STARTS = {
    "character": lambda t: list(range(len(t))),
    "word": lambda t: [m.start() for m in WORD.finditer(t)],
    "line": lambda t: [k for k in range(len(t)) if k == 0 or t[k - 1] == "\n"],
}


@pytest.mark.parametrize("unit", sorted(STARTS))
@pytest.mark.parametrize("chunk", [7, 4096])
def test_cuts_equal_slices(spark, monkeypatch, unit, chunk):
    grid = infill.chunk_grid
    monkeypatch.setattr(infill, "chunk_grid", lambda offsets: grid(offsets, chunk))
    monkeypatch.setattr(infill, "SLAB", 5 * chunk)
    rows = [(k * 31 + j, t) for j in range(25) for k, t in enumerate(CUT_TEXTS)] + [(None, "null id text"), (5, "twice"), (5, "twice")]
    column = pa.array([t or "" for _, t in rows]).slice(3)  # a column that does not begin at its buffer's start
    units, wanted, places = infill.cut_places(column, lambda n: np.stack([n // 3, n], axis=1), unit)
    for (_, t), n, ranks, cut in zip(rows[3:], units, wanted, places, strict=True):
        starts = STARTS[unit](t or "")
        assert n == len(starts)
        for r, p in zip(ranks, cut, strict=True):
            want = 0 if r == 0 else starts[r] if r < n else len(t or "")
            assert p == len((t or "")[:want].encode())
    if chunk == 7:
        return  # of the workers' module nothing is changed
    got = infill.transform(documents(spark, rows), unit=unit)
    got = got.withColumn("back", infill.restore(F.col("_output"), F.col("_form"))).select("doc_id", "text", "_n_units", "_form", "_prefix_units", "_middle_units", "_output", "back", "value").collect()
    have = sorted((tuple(r) for r in got), key=repr)
    assert have == sorted(((i, t, *cut_by_hand(i, t, STARTS[unit]), t or "", "own") for i, t in rows), key=repr)
    assert {r._form for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(documents(spark, [])).count() == 0


# ---- licenses ----


def scan_by_hand(text, phrases, templates):
    """(words, base places, labels of base and all, score, found) by looking at every window."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    cut = lambda t: licenses.words_of(t.encode())
    places, base, found = [], set(), set()
    for phrase, label in phrases:
        p = [w.decode() for w in cut(phrase)]
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, share, wording in templates:
        p = [w.decode() for w in cut(wording)]
        size = 16
        while size < 2 * len(p):
            size *= 2
        for at in range(0, len(words), size // 2):
            common = len(set(p) & set(words[at : at + size]))
            if common >= share * len(set(p)) - 1e-9:
                found.add((label, common / len(set(p)), at, size))
    score = 1.0 if places else max((s for _, s, *_ in found), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | {x[0] for x in found}), score, sorted(found)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = sorted({w for _, _, t in licenses.TEMPLATES for w in t.split()})
    rows = [(0, None), (1, ""), (2, "12 !!"), (3, "MIT License"), (4, "mit mit LICENSE mit-license"), (5, "ünder the Mit\nlicense, Apache License"), (None, "licensed under CC BY-NC 4.0"), (6, "KK mit"), (6, "KK mit")]
    for k in range(60):
        _, _, wording = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        words = wording.split()
        gone = set(rng.sample(range(len(words)), len(words) * (k % 5) // 14))
        lead = [rng.choice(vocabulary) if k % 3 else f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 300))]
        rows.append((10 + k, " ".join(lead + [w for j, w in enumerate(words) if j not in gone] + lead[:40])))
    rows.append((99, " ".join(rng.choice(vocabulary) for _ in range(20_000))))
    got = licenses.scan(documents(spark, rows)).collect()
    want = Counter(repr((i, *scan_by_hand(t, licenses.PHRASES, licenses.TEMPLATES))) for i, t in rows)
    have = Counter(repr((r._id, r._n_words, r._n_base, r._first_word, r._last_word, r._base_labels, r._labels, r._score, [tuple(x) for x in r._found])) for r in got)
    assert have == want
    assert licenses.scan(documents(spark, [])).count() == 0


def test_templates_of_ones_own(spark, monkeypatch):
    """A low threshold, many templates of common words, and the salted join in place of the broadcast one."""
    monkeypatch.setattr(licenses, "attach", lambda *a: shared_attach(*a, max_rows=0))
    rng = random.Random(1)
    templates = [(f"t{k}", 0.5 + 0.1 * (k % 5), " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 40)))) for k in range(25)]
    rows = [(k, " ".join(f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(rng.randint(0, 200)))) for k in range(40)]
    got = licenses.scan(documents(spark, rows), phrases=[("w1 w2", "x"), ("w3", "y")], templates=templates).collect()
    have = sorted((r._id, r._n_words, r._n_base, r._first_word, r._last_word, r._base_labels, r._labels, r._score, sorted(tuple(x) for x in r._found)) for r in got)
    assert have == sorted((i, *scan_by_hand(t, [("w1 w2", "x"), ("w3", "y")], templates)) for i, t in rows)


def shared_attach(*args, max_rows):
    from signalforge.llm import shared

    return shared.attach(*args, max_rows=max_rows)
