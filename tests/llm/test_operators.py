"""The ten operators against brute force, on small tables with every odd case."""

import functools
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from signalforge.llm import graph, langmodel, linedup, mixing, neardup, packing, passages, pii, quality, textops, urlrules, vecdup, warc
from signalforge.llm.shared import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns called like working columns of the operators.
CLASHES = ["_key", "_size", "_text", "_id", "_hash", "_kept", "_base", "_n", "c0", "text2", "value", "node"]


def documents(spark, rows, clash=True):
    d = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    for c in CLASHES if clash else []:
        d = d.withColumn(c, F.lit("own"))
    return d


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    base = prose(1, 120)
    near = base.split(" ")
    near[50] = "changed"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, prose(2, 80), "b"), (5, None, None), (6, "", "a"), (7, " \n\t ", "c"), (8, "one two", "c"), (9, "one two", "c"),
        (10, "x " * 3000, "a"), (11, prose(3, 4000), "a"), (11, prose(3, 4000), "a"), (None, prose(4, 60), "b"), (12, "mail a@b.co or +49 30 1234567 ok\nsee 10.0.0.1 and 4111 1111 1111 1111", "a"), (13, "ünïcode ñandú 日本語 text", None),
    ]
    return rows


# ---- packing ----


def test_packing_covers_every_token_once(spark):
    rows = corpus()
    pieces = packing.pack(documents(spark, rows)).collect()
    words = packing.encoder(packing.default_tokenizer())
    whole = defaultdict(list)
    for i, t, _ in rows:
        whole[i].append(words.tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    by_seq = defaultdict(list)
    got = Counter()
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 2048
        assert any(d[p.start : p.start + p.length] == ids and len(d) == p.doc_tokens for d in whole[p.doc_id])
        got[p.doc_id] += p.length
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert got == {i: sum(map(len, ds)) for i, ds in whole.items()}
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(documents(spark, []).filter("false")).count() == 0


def test_packing_has_little_padding():
    rng = random.Random(5)
    lengths = [rng.randint(1, 2048) for _ in range(500)]
    placed = packing.assign(lengths, 2048, 1.0, 1 / 4096)
    used = Counter()
    for _, _, n, s, at in placed:
        assert at == used[s]
        used[s] += n
    assert sum(used.values()) == sum(lengths)
    assert len(used) == -(-sum(lengths) // 2048) and max(used.values()) <= 2048


def test_word_merges_equal_the_tokenizer():
    words = packing.encoder(packing.default_tokenizer())
    assert words.merges is not None
    rng = random.Random(3)
    letters = [c for c in map(chr, range(1, 0x3100)) if unicodedata.category(c) not in ("Cs", "Cn")]
    odd = ["Áb, c", "x<|endoftext|>y \x01 z", "\x1c a\x1db", "İstanbul, ΣΑΣ. straße. don't they're", "ANKARADAKİ.", "  a\t\tb\r\nc ", "№5, ①. 12,3", "日本語、テスト。", ".,. ,", "é, é", "", prose(9, 300)]
    odd += [f"{c}. a{c}, {c}x. b{c}" for c in letters] + ["a" * n + "." for n in range(1, 80)]
    pool = letters + list("abcXYZ .,\n\t'éÉßÿÀ×÷ŉµª\u0301\u0327\u3000<|>") * 300
    odd += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(2000)]
    got = [ids.tolist() for _, ids in packing.encoded(pa.array([None, *odd]), words, 1)]
    assert got == [[1], *[[*words.ids(t).tolist(), 1] for t in odd]]
    words.merges, kept = None, words.merges  # another tokenizer: whole texts
    try:
        assert [ids.tolist() for _, ids in packing.encoded(pa.array([None, *odd[:20]]), words, 1)] == got[:21]
    finally:
        words.merges = kept


# ---- mixing ----


def test_mixing_targets_and_copies(spark):
    rows = corpus() + [(100 + k, prose(k, 20 + k % 50), "s%d" % (k % 4)) for k in range(400)]
    d = documents(spark, rows)
    got = mixing.plan(d).select("doc_id", "source", "_size", "_words", "_target", "_copies").collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in got:
        assert r._words == sizes[r.source] and math.isclose(r._target, target[r.source])
        assert 0 <= r._copies <= 2
        taken[r.source] += r._copies * r._size
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(taken[s] - target[s]) < 0.05 * target[s] + 140
    again = mixing.plan(d.repartition(7)).select("doc_id", "_copies").collect()
    assert sorted((x.doc_id or 0, x._copies) for x in got) == sorted((x.doc_id or 0, x._copies) for x in again)
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r._copies for r in got)
    assert mixing.mix(d.filter("false")).count() == 0


# ---- quality ----


def test_quality_statistics(spark):
    rows = corpus() + [(20, "a b c d e f a b c d e\nx\nx\n \nx y", "q"), (21, "#1 *$%& |<>", "q")]
    d = documents(spark, rows)
    got = quality.judge(d).select("doc_id", "text", "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_kept").collect()
    assert len(got) == len(rows)
    for r in got:
        w = WORD.findall(r.text or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        times, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if times[x] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r._n_words, r._word_chars, r._n_dup_lines, r._n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r._n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r._base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r._base_failed and r._kept)


def test_quality_boilerplate(spark):
    banner = "this line is on every page of the host\n"
    rows = [(k, banner + "\n".join(prose(50 * k + j, 12) for j in range(6)), "h") for k in range(60)]
    rows += [(100, banner + "only three words", "h")] + [(200 + k, prose(7000, 40), "h") for k in range(30)]
    d = documents(spark, rows)
    got = {r.doc_id: r for r in quality.judge(d, min_left=0.4).select("doc_id", "text", "_clean_text", "_kept", "_removed_words").collect()}
    assert all(got[k]._kept and banner not in got[k]._clean_text and got[k]._removed_words == 9 for k in range(60))
    assert not got[100]._kept
    assert all(got[200 + k]._kept for k in range(30))  # copies are one document
    kept = quality.clean(d)
    assert kept.columns == d.columns and kept.count() == 90
    assert quality.clean(d.filter("false")).count() == 0


def test_quality_several_shared_lines(spark):
    shared = ["header of all pages here", "a licence in one line", "its second line follows", "footer of all pages here"]
    rows = [(k, "\n".join([*shared[:2], *[prose(50 * k + j, 12) for j in range(5)], *shared[2:]]), "h") for k in range(60)]
    rows += [(100 + k, "\n".join([f"copied line number {j}" for j in range(6)]), "h") for k in range(40)]
    lines = quality.boilerplate(documents(spark, rows, clash=False)).collect()
    want = spark.createDataFrame([(x,) for x in shared], "t string").select(quality.line_hash(F.col("t")).alias("h")).collect()
    assert {(r._line, r._docs) for r in lines} == {(r.h, 60) for r in want}


def test_quality_is_the_same_beyond_the_broadcast(spark, monkeypatch):
    banner = "this line is on every page of the host\nand so is this one here\n"
    rows = [(k, banner + "\n".join(prose(50 * k + j, 12) for j in range(4)), "h") for k in range(40)] + [(40 + k, banner + "body of a copied page with ten words and one more", "h") for k in range(40)]
    rows += [(100 + k, banner + prose(900 + k, 20), None) for k in range(20)] + [(200, None, "h"), (201, "", None), (None, banner + "only three words", "h")]
    d = documents(spark, rows)

    def judged():
        return Counter(tuple(r) for r in quality.judge(d).select("doc_id", "_removed_words", "_kept", "_clean_text", "text2").collect())

    want = judged()
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert judged() == want and sum(want.values()) == len(rows)
    assert sum(r[1] == 15 for r in want.elements()) == 101
    assert quality.judge(d.filter("false")).count() == 0


# ---- personal data ----

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 14 <= len(x := re.sub("[^0-9]", "", m)) <= 19 and luhn(x), "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15}
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text) if ok[kind](m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_pii_base_spans(spark):
    odd = ["a@b.com_x@y.org", "1.2.3.4.5.6.7.8 1.2.3.256", "4111-1111-1111-1111 and +1 (415) 555-2671.", "+1(((((((", "é😀 a@b.co 😀 x@y.zz", None, "", "a" * 3000 + "@", "+12 345 678 90123456789", "foo@bar@baz.com", "0000.0001.1.255", "call +49 30 1234567+49 30 1234567", "12345678901234567 890", "me@x.y " * 300]
    rng = random.Random(3)
    odd += ["".join(rng.choice("a1+@. -_()2\n") for _ in range(200)) for _ in range(60)]
    d = documents(spark, [(k, t, "s") for k, t in enumerate(odd)])
    got = pii.find(d)
    for r in got.select("text", pii.described(F.col("_base")).alias("base"), pii.described(F.col("_spans")).alias("spans")).collect():
        assert r.base == base_spans(r.text or "")
    clean = pii.sanitise(d)
    assert clean.columns == d.columns
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert rows[2] == "[CARD] and [PHONE]." and rows[4] == "é😀 [EMAIL] 😀 [EMAIL]" and rows[5] is None
    assert pii.find(d.filter("false")).count() == 0


def test_pii_disclosing_terms(spark):
    rows = [(k, f"report {k} by ghostwriter kestrel at kes@trel.org today\n" + prose(k, 30), "s") for k in range(5)] + [(10 + k, "report today by others\n" + prose(90 + k, 30), "s") for k in range(30)]
    d = documents(spark, rows)
    terms = {(r._entity, r._term) for r in pii.disclosing_terms(d).collect()}
    assert terms == {("email:kes@trel.org", "ghostwriter"), ("email:kes@trel.org", "kestrel")}
    texts = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "kestrel" not in texts[0] and "[EMAIL]" in texts[0] and "report 0 by" in texts[0]
    assert texts[10] == rows[5][1]


def brute_terms(texts, disclosure, support):
    """{entity: terms} that disclose it, counted line by line."""
    lines, word = [x for t in texts for x in (t or "").split("\n")], re.compile(r"[^\W\d_]{3,}")
    said, holds, both, where = Counter(), Counter(), Counter(), defaultdict(set)
    for line in lines:
        said.update(set(word.findall(line.lower())))
        spans = [x.split(":") for x in base_spans(line).split(",") if x]
        entities = {f"{k}:{line[int(a) : int(b)].lower()}" for k, a, b in spans}
        bare = line
        for kind in BASE:
            bare = re.sub(BASE[kind], " ", bare)
        for e in entities:
            holds[e] += 1
            for t in set(word.findall(bare.lower())):
                both[e, t] += 1
                where[e, t].add(line)
    out = defaultdict(set)
    for (e, t), n in both.items():
        ic, pmi = math.log2(len(lines) / holds[e]), math.log2(len(lines) * n / (said[t] * holds[e]))
        if len(where[e, t]) >= support and ic > 0 and pmi >= disclosure * ic:
            out[e].add(t)
    return out


@pytest.mark.parametrize(("disclosure", "support"), [(0.9, 3), (0.5, 2), (1.0, 1)])
def test_pii_spans_equal_brute_force(spark, disclosure, support):
    rng = random.Random(17)
    mails, words = [f"{x}@{x}.org" for x in ("kes", "tern", "wren", "Owl")], ["ghost", "kestrel", "tern", "Zürich", "owl", "report", "kestrels", "today"]
    texts = [None, "", "kes@kes.org", "kestrel kes@kes.org\n" * 4]
    for k in range(60):
        lines = []
        for j in range(rng.randint(1, 4)):
            m = rng.randrange(4)
            said = [words[2 * m + (rng.random() < 0.2)] for _ in range(rng.randint(1, 3))] + ["plain", "ab", str(rng.randrange(4))][: rng.randrange(4)]
            said += [rng.choice(words)] * (rng.random() < 0.1) + [mails[m]] * (rng.random() < 0.93)
            rng.shuffle(said)
            lines.append(" ".join(said))
        texts.append("\n".join(lines))
    texts += ["solely wren@wren.org", "plain, solely: wren@wren.org"]  # a term never without its entity: a tie at 1
    texts += texts[-3:]  # repeated rows
    terms = brute_terms(texts, disclosure, support)
    assert terms
    got = pii.find(documents(spark, [(k, t, "s") for k, t in enumerate(texts)]), disclosure=disclosure, support=support)
    for r in got.select("text", pii.described(F.col("_spans")).alias("spans")).collect():
        text = r.text or ""
        base = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(text).split(",") if x)]
        named = sorted(set().union(*(terms.get(f"{k}:{text[a:b].lower()}", set()) for a, b, k in base)))
        added = [(m.start(), m.end(), "term") for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(named) + r")(?![^\W_])", text, re.I)] if named else []
        want = sorted(base + [t for t in added if not any(b[0] < t[1] and t[0] < b[1] for b in base)])
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in want)


# ---- near-duplicates ----


def weighted(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").lower())
        sets[i] = Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))
    df = Counter(s for x in sets.values() for s in x)
    n = len(texts)
    idf = {s: 1 + math.log(n / c) for s, c in df.items()}
    return {i: {s: c * idf[s] for s, c in x.items()} for i, x in sets.items()}


def jaccard(a, b):
    low = sum(min(v, b[s]) for s, v in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


@pytest.mark.parametrize("tile", [512, 16])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(11)
    rows = [(k, prose(k, 60)) for k in range(80)]
    base = prose(500, 150).split(" ")
    for k in range(100, 190):  # one large group from light to heavy edits
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(200, "one two"), (201, "One TWO"), (202, "one two three"), (203, None), (204, ""), (205, " ")]
    got = {r._id: r.class_id for r in neardup.classes(documents(spark, [(i, t, "s") for i, t in rows])).collect()}
    sets = weighted(rows)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, t), (j, u) in itertools.combinations(rows, 2):
        if jaccard(sets[i], sets[j]) >= 0.8 or (t or "") == (u or ""):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i, _ in rows}


def test_dedup_keeps_one_of_each(spark):
    rows = corpus()
    d = documents(spark, rows)
    kept = neardup.dedup(d)
    assert kept.columns == d.columns
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert ids == [0, 1, 4, 5, 7, 8, 10, 11, 12, 13]
    assert neardup.dedup(d.filter("false")).count() == 0


def counted(docs):
    """(documents, df of each shingle) as classes() counts them."""
    windows = neardup.windows_of(docs.select(F.lit(0).cast("long").alias("_id"), F.lit(b"").alias("_text"), "text"))
    total, rows = neardup.counted_shingles(windows)
    rows, found = rows.toArrow(), {}
    for w in windows.collect():
        own = rows.filter(pa.compute.equal(rows.column("window"), w.window))
        _, keys, df = neardup.window_shingles(pa.table({"block": [bytes(w.block)]}), own)
        assert len(keys) == len(df)
        for key, n in zip(keys.tolist(), df.tolist(), strict=True):
            assert found.setdefault(key, n) == n
    return total, found


def test_shingles_are_counted_exactly(spark):
    texts = [(k, "a common opening of six words " + prose(k, 20), "s") for k in range(30)] + [(50 + k, prose(100 + k, 30), "s") for k in range(60)] + [(200, None, "s")]
    total, df = counted(documents(spark, texts).repartition(3))
    assert total == 91 and sorted(df.values(), reverse=True)[:3] == [30, 30, 1]


def test_weights_are_unclamped_tf_idf(spark):
    # texts of their own words and one of 40 passages, each held by 3 of 520 documents
    rows = []
    for k in range(40):
        own, passage = prose(5000 + k, 24), prose(6000 + k, 54)
        rows += [(3 * k, f"{own} {passage}"), (3 * k + 1, f"{prose(7000 + k, 14)} {own[-80:]} {passage}"), (3 * k + 2, f"{prose(8000 + k, 24)} {passage}")]
    rows += [(1000 + k, prose(9000 + k, 30)) for k in range(400)]
    d = documents(spark, [(i, t, "s") for i, t in rows])
    total, df = counted(d)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    true = Counter(s for x in sets for s in x)
    assert total == len(rows) and sorted(df.values()) == sorted(true.values())
    assert max(true.values()) < 0.02 * len(rows)  # all of them rarer than a fiftieth
    weights = []
    for _, t in rows:
        w = t.split()
        tf = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        weights.append({s: n * (1 + math.log(len(rows) / true[s])) for s, n in tf.items()})
    pairs = [(jaccard(weights[i], weights[j]), jaccard(dict.fromkeys(weights[i], 1), dict.fromkeys(weights[j], 1)), i, j) for i, j in itertools.combinations(range(120), 2) if i // 3 == j // 3]
    limit = 0.5
    flipped = [p for p in pairs if p[0] < limit <= p[1]]
    assert flipped  # linked by plain term frequency, not by TF-IDF
    got = {r._id: r.class_id for r in neardup.classes(d, similarity=limit, bands=80, rows=2).collect()}
    for k in range(40):
        root = {3 * k + j: 3 * k + j for j in range(3)}
        for p, _, i, j in sorted(x for x in pairs if x[2] // 3 == k and x[0] >= limit):
            low, high = sorted((root[i], root[j]))
            root = {x: low if r == high else r for x, r in root.items()}
        assert {i: got[i] for i in root} == root
    assert all(got[1000 + k] == 1000 + k for k in range(400))


def shingle_counts(rows):
    words = {i: WORD.findall((t or "").lower()) for i, t in rows}
    return {i: Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])) for i, w in words.items()}


def copy_rows():
    """One text, 150 exact copies of it and 100 with a few words changed (ids from 0), then texts of their own."""
    rng = random.Random(23)
    base = prose(900, 300).split(" ")
    rows = [(k, " ".join(base)) for k in range(151)]
    for k in range(151, 251):
        w = list(base)
        for at in rng.sample(range(5, 295), 1 + k % 6):
            w[at] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, prose(1000 + k, 60)) for k in range(150)]
    return rows + [(2000, None), (2001, " "), (2002, "one two"), (2003, "one two"), (2004, None)]


def left_out(docs):
    """Ids of the documents that copies() leaves out of the count."""
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    windows = neardup.windows_of(docs.select(F.col("doc_id").cast("long").alias("_id"), digest.alias("_text"), "text"), sketched=True)
    blocks = {w.window: neardup._texts(bytes(w.block)).column("_id").to_pylist() for w in windows.collect()}
    return {blocks[r.window][k] for r in neardup.copies(windows).collect() for k in r.copies}


def test_copies_are_told_from_other_texts(spark):
    rows = copy_rows()
    d = documents(spark, [(i, t, "s") for i, t in rows])
    text = dict(rows)
    whole, dealt = left_out(d.coalesce(1)), left_out(d.repartition(5))
    kept = [i for i, _ in rows if i not in whole]
    assert len([i for i in kept if i < 251]) == 1 and len([i for i in kept if i in (2002, 2003)]) == 1
    assert {i for i, _ in rows if i >= 1000} - {2002, 2003} <= set(kept)  # other texts, and those without a word
    assert sorted(text[i] or "" for i in whole) == sorted(text[i] or "" for i in dealt)
    assert left_out(d.filter("false")) == set()


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_large_groups_of_copies_keep_their_near_copies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(neardup, "attach", functools.partial(neardup.attach, max_rows=broadcast))
    rows = copy_rows()
    d = documents(spark, [(i, t, "s") for i, t in rows])
    out, sets, by_all = left_out(d), shingle_counts(rows), weighted(rows)
    counted = [i for i, _ in rows if i not in out]
    df = Counter(s for i in counted for s in sets[i])
    weights = {i: {s: n * (1 + math.log(len(counted) / max(1, df[s]))) for s, n in x.items()} for i, x in sets.items()}
    near = [i for i in range(151, 251) if jaccard(sets[0], sets[i]) >= 0.82]
    assert len(near) > 80 and sum(jaccard(by_all[0], by_all[i]) < 0.8 for i in near) > 30  # they come apart if copies count
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, t), (j, u) in itertools.combinations(rows, 2):
        if (t or "") == (u or "") or jaccard(weights[i], weights[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {r._id: r.class_id for r in neardup.classes(d, copies_once=True).collect()}
    assert got == {i: find(i) for i, _ in rows}
    assert all(got[i] == 0 for i in near) and all(got[i] == i for i in range(1000, 1150))


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = np.ones(300, np.float32) * 2
    v = w.copy()
    v[:60] *= 3
    a = neardup.Sampler(400, float(np.log(np.float32(2)))).samples(hashes, np.log(w), np.array([300]))
    b = neardup.Sampler(400, float(np.log(np.float32(2)))).samples(hashes, np.log(v), np.array([300]))
    true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert abs((a == b).mean() - true) < 0.08


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 99)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 99, 100, 101, 7000]], "node long")
    got = {r.node: r.comp for r in graph.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99, 101: 99, 7000: 7000}


# ---- repeated lines ----


def test_repeated_lines_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    shared = [prose(700 + k, 9) for k in range(12)]
    rows = corpus() + [(300 + k, "\n".join(rng.choice([rng.choice(shared), prose(rng.randrange(10**6), 8), "", " \t", "A  shared\tLINE ", "a shared line"]) for _ in range(rng.randint(1, 9))), "s") for k in range(90)]
    rows += [(300, "a shared line\nof one id", "s"), (None, "a shared line\nof no id", "s"), (4000, "é 日本\nÉ 日本\nend", "s")]
    left = defaultdict(list)
    seen = set()
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())):
        spans, kept, start = [], [], 0
        for k, line in enumerate((t or "").split("\n")):
            unit = " ".join(WORD.findall(line.lower()))
            if unit and unit in seen:
                spans.append((k, start, start + len(line)))
            else:
                kept.append(line)
            seen.add(unit)
            start += len(line) + 1
        left[i].append((t, spans, None if t is None else "\n".join(kept)))
    for hot in (0.001, 0.05, 1.0):  # all, some and none of the repeated digests are broadcast
        monkeypatch.setattr(linedup, "HOT", hot)
        d = documents(spark, rows).repartition(5)
        got = defaultdict(list)
        for r in linedup.find(d).collect():
            got[r.doc_id].append((r.text, [tuple(s) for s in r._spans], r._clean_text))
            assert all("\n" not in r.text[s.start : s.end] for s in r._spans)
        order = lambda found: {i: sorted(x, key=repr) for i, x in found.items()}
        assert order(got) == order(left)
    clean = linedup.dedup(d)
    assert clean.columns == d.columns
    assert sorted((r.text or "", -1 if r.n_chars is None else r.n_chars) for r in clean.collect()) == sorted((c or "", -1 if c is None else len(c)) for x in left.values() for _, _, c in x)
    assert linedup.dedup(d.filter("false")).count() == 0


# ---- repeated passages ----


def test_repeated_passages_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    shared = [prose(900 + k, n) for k, n in enumerate([49, 50, 51, 60, 75, 130, 400])]
    # clean: neighbours share short lines and 49 words; the others hold passages between words of their own, without line feeds of their own
    clean = [(500 + k, f"And.\n{prose(1000 + k, 30)} {shared[0]} {prose(2000 + k, 30)}\nThe end\nAnd.", "s") for k in range(20)]
    held = [(600 + k, f"{prose(3000 + k, 20)} {shared[3 + k % 4].upper() if k % 2 else shared[3 + k % 4]} {prose(4000 + k, 20)}", "s") for k in range(20)]
    rows = corpus() + clean + held
    for k in range(120):
        parts = [rng.choice([rng.choice(shared), prose(rng.randrange(10**6), rng.randint(1, 60)), "é 日本 " * rng.randint(1, 30), "again " * 70]) for _ in range(rng.randint(1, 5))]
        rows.append((rng.choice([700 + k, 700, None]), rng.choice([" ", "\n", " \t\n "]).join(parts), "s"))
    left, seen = defaultdict(list), {}
    for rank, (i, t, _) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))):
        found = list(WORD.finditer(t or ""))
        words = [m.group().lower() for m in found]
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if seen.setdefault(" ".join(words[k : k + 50]), rank) < rank:
                gone[k : k + 50] = [True] * 50
        spans, rest, at = [], "", 0
        for out, group in itertools.groupby(range(len(words)), gone.__getitem__):
            group = list(group)
            if out:
                spans.append((len(group), found[group[0]].start(), found[group[-1]].end()))
                rest, at = rest + t[at : spans[-1][1]], spans[-1][2]
        left[i].append((t, spans, None if t is None else rest + t[at:]))
    assert not any(spans for i, x in left.items() if i in range(500, 520) for _, spans, _ in x)
    assert all(len(left[600 + k][0][1]) == (k >= 4) for k in range(20))
    order = lambda found: {i: sorted(x, key=repr) for i, x in found.items()}
    for hot, blocks in ((0.001, 8192), (0.05, 0), (1.0, 8192)):  # all, some and none of the seeds are broadcast; rows are marked or joined
        monkeypatch.setattr(passages, "HOT", hot)
        monkeypatch.setattr(passages, "BLOCKS", blocks)
        d = documents(spark, rows).repartition(5)
        got = defaultdict(list)
        for r in passages.find(d).collect():
            got[r.doc_id].append((r.text, [tuple(s) for s in r._spans], r._clean_text))
        assert order(got) == order(left)
    clean = passages.dedup(d)
    assert clean.columns == d.columns
    assert sorted((r.text or "", -1 if r.n_chars is None else r.n_chars) for r in clean.collect()) == sorted((c or "", -1 if c is None else len(c)) for x in left.values() for _, _, c in x)
    assert passages.dedup(d.filter("false")).count() == 0


def test_passages_equal_sql(spark):
    test_queries_equal_sql(spark, "op2_passages")


def test_all_operators_are_registered():
    from signalforge.llm import queries

    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", ["op2_lines", "op3_vectors", "op4_warc", "op5_mix", "op8_quality", "op11_infill", "op12_licenses"])
def test_queries_equal_sql(spark, name):
    from signalforge.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda found: sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in found), key=repr)
    have = rows(got.select(*names).collect())
    assert have and have == rows(want.fetchall())


# ---- vectors ----


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vecdup, "TILE", 8)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(150):
        rows.append((k, rng.normal(size=16).tolist(), k % 3))
    centre = rng.normal(size=16)
    for k in range(200, 260):
        rows.append((k, (centre + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.14])).tolist(), 1))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [math.nan] * 16, 1), (303, [1.0, None], 1), (304, [1.0, 2.0], 1), (305, [2.0, 4.0], 1), (305, [2.0, 4.0], 1), (306, [1.0, 2.0], None), (307, [], 1), (308, [math.inf] * 2, 1)]
    # null ids link too: two equal vectors, one beside the large group, one that alone joins two others
    rows += [(None, [3.0, 1.0, 2.0], 2), (None, [3.0, 1.0, 2.0], 2), (None, centre.tolist(), 1), (None, [1.0, 0.15], 4), (400, [1.0, 0.0], 4), (401, [1.0, 0.31], 4), (None, None, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("own"))
    fit = [(k, np.array(v, np.float32).astype(float), y) for k, (_, v, y) in enumerate(rows) if v and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (i, x, a), (j, y, b) in itertools.combinations(fit, 2):
        if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            links[i] += 1
            links[j] += 1
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min((x for x in (i, least.get(find(k))) if x is not None), default=None)
    got = Counter((r._id, r.n_links, r.component_id) for r in vecdup.links(d).collect())
    assert got == Counter((i, links[k], least[find(k)]) for k, (i, _, _) in enumerate(rows))
    assert vecdup.links(d.filter("false")).count() == 0


# ---- archives ----


def test_archives_round_trip(spark):
    big = "x" * 200
    rows = [(1, None, None), (2, "http://a/", ""), (3, "http://b.c\r\nX: y/é?q#f", big), (4, "u", big), (5, "u", big), (5, "u", big), (6, "u", "é" * 49 + "a"), (7, "u", "é" * 49 + "a"), (8, "u", "é" * 50), (9, "u", "é" * 50), (None, "u", big), (10, "z", "a\r\n\r\nWARC/1.1 \x00 \r\n")]
    rows += [(20 + k, f"http://h{k % 5}.com/{k % 7}", prose(k, 50)) for k in range(80)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_id", F.lit("own"))
    path = scratch_path(spark, "archives")
    warc.write(d.repartition(5), path)
    got = warc.index(spark, path).withColumn("part", F.spark_partition_id()).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and i != first[h]
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert sorted(map(repr, expected)) == sorted(repr((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    order = [(r.url_key, r.timestamp, r.id or -1) for r in sorted(got, key=lambda r: r.part)]
    assert order == sorted(order)
    empty = scratch_path(spark, "archives")
    warc.write(d.filter("false"), empty)
    assert warc.index(spark, empty).count() == 0


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((rng.randrange(9), n) for n in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, order=lambda r: r)) == sorted(itertools.chain(*runs))


def test_damaged_archives_are_found():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Date: 1970-01-01T00:00:01Z\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 1\r\nContent-Length: 5\r\n\r\n\r\n\r\nab\r\n\r\n"
    with pytest.raises(ValueError):
        warc.captures("f", record)


# ---- language model ----


def test_language_model_against_brute_force(spark, monkeypatch):
    rows = [(1000 + k, " ".join(random.Random(k).choice(["the", "a", "big"] if k % 2 else ["le", "un", "gros"]) + " " + random.Random(k * j).choice("xyz") for j in range(60)), "s") for k in range(120)]
    rows += corpus()
    d = documents(spark, rows)
    train = d.filter(~langmodel.held_out(F.col("doc_id")))
    for frequent in (1 << 20, 4):
        model = langmodel.train(train, frequent=frequent)
        scored = langmodel.score(d, model).collect()
        assert len(scored) == len(rows)
        low = {k: k + 32 for k in range(65, 91)}
        texts = [(i, [*WORD.findall((t or "").translate(low)), "\n"]) for i, t, _ in rows]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
        count = Counter(w for i, ws in texts if not held(i) for w in ws)
        n, v = sum(count.values()), len(count)
        expected = sorted((len(ws), sum(count[w] > 0 for w in ws), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for _, ws in texts)
        assert expected == sorted((r._n_tokens, r._n_known, round(r._base_score, 6)) for r in scored)
        unseen = [r for r in scored if r._id is not None and r._id >= 1000 and held(r._id)]  # random strings hold nothing to learn
        assert sum(r._score for r in unseen) > sum(r._base_score for r in unseen)
    empty = langmodel.train(d.filter("false"))
    assert langmodel.score(d, empty).count() == len(rows) and langmodel.score(d.filter("false"), empty).count() == 0


def test_language_model_is_a_distribution(spark):
    texts = [" ".join(random.Random(k).choice(["the", "an", "bing", "of", "mill"]) for _ in range(30)) for k in range(20)] + [prose(40 + k, 60) for k in range(12)]
    model = langmodel.train(documents(spark, [(k, t, "s") for k, t in enumerate(texts)]))
    t, seen = model.tables, Counter(w for x in texts for w in x.split())
    unseen = {}
    for x, y in itertools.product("abcdefghijklmnopqrstuvwxyz0123456789.,;", repeat=2):
        _, _, tails = textops.word_hashes(*textops.utf8(pa.array(["qq" + x + y])), tails=True)
        if "qq" + x + y not in seen:
            unseen.setdefault(int(t.classes[tails[0]]), "qq" + x + y)
    assert len(seen) > langmodel.CLASSES and len(unseen) == len(set(t.classes.tolist()))
    for history in ("", "the", "the an", "never seen"):
        words = [*seen, *unseen.values(), None]
        hashed = textops.word_hashes(*textops.utf8(pa.array([f"{history} {w or ''}" for w in words])), tails=True)
        logs, kind, rest = langmodel.token_logs(t, *hashed)
        at = np.cumsum(hashed[1] + 1) - 1  # each text's end; the word comes before it
        at[:-1] -= 1
        logs, kind, rest = logs[at], kind[at], rest[at]
        logs[rest] -= model.norms[kind[rest]]
        logs[rest] += np.log10([seen.get(w, 0) + 1 for w, r in zip(words, rest.tolist(), strict=True) if r])
        assert abs((10**logs).sum() - 1) < 1e-4


def test_language_model_does_not_depend_on_partitions(spark):
    d = documents(spark, [(k, prose(k % 17, 80), "s") for k in range(60)] + corpus())
    scores = []
    for parts in (1, 7):
        dealt = d.repartition(parts)
        model = langmodel.train(dealt)
        scores.append(sorted((r._n_tokens, r._base_score, r._score) for r in langmodel.score(dealt, model).collect()))
    assert np.allclose(*scores, rtol=1e-9, atol=0)


def test_words_that_share_their_first_bits_keep_their_outcomes():
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(1, 1 << 63, 900, np.uint64))
    words = np.append(words, [(words[0] & ~np.uint64(0xFFFF)) + np.uint64(k) for k in range(5)] + [np.uint64((1 << 64) - k) for k in range(1, 4)])
    words = np.unique(words)
    outcomes = np.arange(len(words)) % 31
    table, found, probes = langmodel._slotted(words, outcomes)
    t = langmodel.Tables(0, None, table, found, probes, None, None, None)
    assert (langmodel._outcomes(t, words) == outcomes).all() and probes >= 3
    assert (langmodel._outcomes(t, words + np.uint64(1 << 20)) == 31).all() and len(langmodel._outcomes(t, words[:0])) == 0


def test_language_model_grows_with_the_vocabulary(spark):
    few = langmodel.train(documents(spark, [(k, prose(k, 40), "s") for k in range(20)]))
    many = langmodel.train(documents(spark, [(k, " ".join(f"w{k}x{j}" for j in range(4000)), "s") for k in range(120)]))
    assert few.tables.rows == langmodel.LEAST_ROWS < many.tables.rows


# ---- URLs ----


def test_urls(spark):
    rules = urlrules.RULES
    rows = [(1, None), (2, ""), (3, "x://A.COM"), (4, "http://a.com/"), (5, "http://Example.com/en/a?b=1#c"), (6, "http://www.example.com/en/"), (7, "http://xexample.com/en/"), (8, "http://a.net?x=/fr/"), (9, "http://a.net/fr/\nq"), (10, "a\nb://É.NET/es/"), (10, "a\nb://É.NET/es/"), (11, "http://h.com" + "/seg" * 3000)]
    rows += [(100 + k, f"http://spam{k % 3}.example.com/en/{k}") for k in range(40)] + [(200 + k, f"http://spam{k % 3}.org/en/{k}") for k in range(5)]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("_key", F.lit("own")).withColumn("_rule", F.lit("own"))
    got = urlrules.judge(d).collect()
    assert len(got) == len(rows)
    for r in got:
        host = path = ""
        if r.url is not None and "://" in r.url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", r.url.split("://", 1)[1], re.S).groups()
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = max(((len(a + b), a + b, v) for a, b, v in rules if (host == a or host.endswith("." + a)) and path.startswith(b)), default=None)
        assert (r._host, r._path, r._rule) == (host, path, fits[1] if fits else None)
        assert r._verdict == (fits[2] if fits else (r._mined or "allow")) and r._key == "own"
    assert {r._verdict for r in got if r.page_id >= 200} == {"block"}
    assert urlrules.judge(d.filter("false")).count() == 0


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(8)
    baskets = [(sorted({rng.choice("abcd"), rng.choice("abcd"), rng.choice("xyz")}), rng.choice(["block", "allow", "block"])) for _ in range(120)]
    mined = urlrules.mine(spark.createDataFrame(baskets, "_tokens array<string>, _label string"), 0.05, 0.7).collect()
    items = sorted({x for b, _ in baskets for x in b})
    rules = {}
    for n in (1, 2, 3):
        for combo in itertools.combinations(items, n):
            labels = [y for b, y in baskets if set(combo) <= set(b)]
            for y in ("block", "allow"):
                if labels and labels.count(y) / 120 >= 0.05 and labels.count(y) / len(labels) >= 0.7:
                    rules[combo, y] = labels.count(y) / len(labels)
    kept = {k: c for k, c in rules.items() if not any(rules.get((tuple(x for x in k[0] if x != out), k[1]), -1) >= c for out in k[0])}
    assert {(tuple(r._if), r._then): round(r._confidence, 9) for r in mined} == {k: round(c, 9) for k, c in kept.items()}


def test_url_verdicts_equal_brute_force(spark):
    """The best rule over single tokens is the best over groups of tokens that always come together."""
    rng = random.Random(21)
    twins = {"a": "a/deep/er", "b": "b", "c": "c/twin", "d": "d"}  # tokens that never part
    urls = []
    for k in range(150):
        parts = [rng.choice("abcd") for _ in range(rng.randint(1, 3))]
        usual = "allow" if "b" in parts else "block"
        urls.append((k, f"http://h{rng.choice('xyz')}.example.org/" + "/".join(twins[p] for p in parts), rng.choice([usual] * 6 + ["block", "allow", None])))
    # the last ones hold parts of twins alone
    urls += [(200 + k, f"http://q.org/{p}", None) for k, p in enumerate(["deep", "er", "deep/er", "twin/b", "zz", "c/er", "a/d"])]
    d = spark.createDataFrame(urls, "page_id long, url string, label string")
    got = {r.page_id: r._mined for r in urlrules.judge(d, rules=(("none.none", "/", "allow"),), label_col="label", support=0.05, confidence=0.7).collect()}
    sets = {r.page_id: set(r.t) for r in d.select("page_id", urlrules.tokens(F.col("url")).alias("t")).collect()}
    known = [(sets[k], y) for k, _, y in urls if y]
    rules = {}
    for n in (1, 2, 3, 4):
        for combo in itertools.combinations(sorted(set().union(*[t for t, _ in known])), n):
            labels = [y for t, y in known if t.issuperset(combo)]
            for y in ("block", "allow"):
                if labels and labels.count(y) >= math.ceil(0.05 * len(known)) and labels.count(y) / len(labels) >= 0.7:
                    rules[combo, y] = labels.count(y) / len(labels), labels.count(y) / len(known)
    assert len(rules) > 20 and len(set(got.values())) >= 2
    for k, tokens in sets.items():
        fits = [(c, y) for (combo, y), c in rules.items() if tokens.issuperset(combo)]
        best = max((c for c, _ in fits), default=None)
        assert got[k] in ({y for c, y in fits if c == best} or {None}), (k, tokens)


def test_long_common_paths_are_one_token(spark):
    urls = [(k, "http://deep.example.com/en/" + "/".join(f"part{chr(97 + j)}" for j in range(30)) + f"/{chr(97 + k % 26)}x") for k in range(60)] + [(100, "http://other.org/partq"), (101, "http://other.org/nothing")]
    got = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert {got[k]._verdict for k in range(60)} == {"block"} and got[100]._mined == "block" and got[101]._mined is None
