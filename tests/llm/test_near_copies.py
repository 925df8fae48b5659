"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from eventloom.llm import minhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_copies_at_four_fifths(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice((20, 60, 200, 400)))]
        texts.append(" ".join(base))
        for _ in range(4):  # copies on both sides of the bound
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randint(1, max(1, len(copy) // 40))):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "", None, "one two", "one two", "one two three"]
    want = classes(texts)
    assert 60 < len(set(want)) < len(texts) - 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == ["doc_id", "text"]
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(want))


def test_rows_are_told_apart_by_text(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "other words are in this row"), (5, "other words are in this row"), (None, "no copy of this one exists"), (0, None)]
    kept = minhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)
    assert minhash.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0
