"""The corpus pipeline stage by stage against plain Python, and as a whole."""

import zlib
from collections import Counter

import numpy as np
from test_operators import WORD, base_spans, corpus, documents, jaccard, prose, weighted

import corpus_pipeline
from signalforge.llm import packing
from signalforge.llm.shared import scratch_path

BANNER = "this line is on every page of the host"


def passes_rules(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if times[x] > 1:
            covered.update(range(k, k + 5))
    return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)


def near_classes(texts):
    sets, root = weighted(list(enumerate(texts))), list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def mix_targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while over := {s for s in open_ if left / sum(weight[x] for x in open_) * weight[s] > 2 * sizes[s]}:
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target | {s: left / sum(weight[x] for x in open_) * weight[s] for s in open_}


def test_pipeline(spark):
    rows = corpus() + [(100 + k, (f"{BANNER}\n" if k % 3 == 0 else "") + prose(900 + k, 60 + k % 40), "s%d" % (k % 3)) for k in range(60)]
    folder = scratch_path(spark, "sf")
    documents(spark, rows, clash=False).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = docs.cache()
        after[name] = docs.collect()

    want = Counter((i, (t or "").removeprefix(f"{BANNER}\n"), s) for i, t, s in rows if passes_rules(t))
    assert Counter((r.doc_id, r.text, r.source) for r in after["quality rules"]) == want
    assert {1, 2, 3, 4, 11, 12, None, *range(100, 160)} == {i for i, _, _ in want}

    before = after["quality rules"]
    classes = near_classes([r.text for r in before])
    kept = Counter(tuple(r) for r in after["near-duplicates"])
    class_of = {tuple(r): c for r, c in zip(before, classes, strict=True)}
    assert sorted(class_of[r] for r in kept.elements()) == sorted(set(classes)) and len(set(classes)) == len(before) - 3

    clean = {r.doc_id: r for r in after["personal data"]}
    assert Counter(r.doc_id for r in after["personal data"]) == Counter(r.doc_id for r in after["near-duplicates"])
    for r in after["near-duplicates"]:
        assert clean[r.doc_id].text == r.text if r.doc_id != 12 else not base_spans(clean[12].text)
    assert "ok" in clean[12].text and "see" in clean[12].text

    mixed, target, taken = after["mixing"], mix_targets(after["personal data"]), Counter()
    assert all(n <= 2 for n in Counter(r.doc_id for r in mixed).values())
    for r in mixed:
        assert r.text == clean[r.doc_id].text and r.source == clean[r.doc_id].source
        taken[r.source] += len(WORD.findall(r.text))
    longest = {s: max(len(WORD.findall(r.text)) for r in after["personal data"] if r.source == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + longest[s] for s in target)

    pieces = corpus_pipeline.run(spark, folder).collect()
    words = packing.encoder(packing.default_tokenizer())
    ids, lengths = {}, Counter()
    for r in mixed:
        ids.setdefault(r.doc_id, words.tokenizer.encode(r.text, add_special_tokens=False).ids + [1])
        lengths[r.doc_id] += len(ids[r.doc_id])
    for p in pieces:
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert zlib.crc32(part) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        lengths[p.doc_id] -= p.length
    assert not any(lengths.values())


def test_stages_are_named():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
