"""Predictions of language ID against a plain version, recall of decontamination at its bound, and the cases that each operator defines."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import ann, decontaminate, language_id, packing, token_count, toxicity, url_filter
from eventloom.llm.queries import tokenizer_path

R = random.Random(17)


def words(n, letters="abcdefgh", longest=6):
    return " ".join("".join(R.choice(letters) for _ in range(R.randint(1, longest))) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


# language ID


def plain_trigrams(text):
    cleaned = "".join(c if unicodedata.category(c).startswith("L") else " " for c in f" {text.lower()} ")
    out = [cleaned[0]]
    for c in cleaned[1:]:
        if c != " " or out[-1] != " ":
            out.append(c)
    return Counter(zip(out, out[1:], out[2:]))


def plain_bundle(counts, dims):
    def letter(c):
        return np.random.default_rng(ord(c)).choice(np.array([-1, 1], np.int8), dims).astype(np.int64)

    total = np.zeros(dims, np.int64)
    for (a, b, c), n in counts.items():
        total += n * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total


def test_predictions_against_a_plain_version(spark):
    alphabets = {"aa": "abcdeé", "bb": "bcdfgß", "cc": "xyzabñ"}
    rows = [(k, None if k % 17 == 0 else words(R.randint(1, 40), alphabets[lang]), lang if k % 5 else None) for k, lang in enumerate(["aa", "bb", "cc"] * 14)]
    rows += [(100, "", "aa"), (101, "12 34!", None), (102, "Éé-é 7 xyz", None), (3, rows[3][1], "aa"), (None, "abc abd", None)]
    docs = docs_of(spark, rows)
    prototypes = language_id.train(docs.where("lang is not null"), 256)
    total = {}
    for _, text, lang in rows:
        if lang:
            total[lang] = total.get(lang, 0) + plain_bundle(plain_trigrams(text or ""), 256)
    assert sorted(total) == list(prototypes) and all(np.array_equal(total[x], prototypes[x]) for x in total)
    got = sorted((r.doc_id or -1, r.text or "", r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs.drop("lang"), prototypes, 256).collect())
    want = []
    for doc_id, text, _ in rows:
        v = plain_bundle(plain_trigrams(text or ""), 256).astype(float)
        if not any(c.isalpha() for c in text or ""):
            want.append((doc_id or -1, text or "", "und", 0.0))
            continue
        cosine = {x: float(total[x] @ v / np.linalg.norm(total[x]) / np.linalg.norm(v)) for x in sorted(total)}
        best = max(cosine, key=lambda x: cosine[x])
        want.append((doc_id or -1, text or "", best, round(min(1.0, max(0.0, cosine[best])), 9)))
    assert got == sorted(want)


def test_language_ties_and_empty_table(spark):
    docs = docs_of(spark, [(1, "abc abc", "zz"), (1, "abc abc", "yy"), (1, "abc abc", "yy")])
    prototypes = language_id.train(docs)
    assert {r.lang_pred for r in language_id.predict(docs, prototypes).collect()} == {"yy"}
    assert language_id.predict(docs.limit(0), prototypes).count() == 0 and language_id.train(docs.limit(0)) == {}
    got = language_id.predict(docs.selectExpr("doc_id", "text", "1 lang_pred", "2 letters"), prototypes)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "letters"]


# decontamination


def test_recall_at_the_bound_of_edits(spark):
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(R.choice(vocabulary) for _ in range(R.choice((10, 15, 25, 40, 80))))) for k in range(120)]
    rows = []
    for k, text in items:
        copy = text.split()
        for _ in range(decontaminate.allowed(len(copy))):
            at = R.randrange(len(copy))
            kind = R.choice("sdi")
            copy[at : at + 1] = {"s": ["other"], "d": [], "i": [copy[at], "more"]}[kind]
        rows.append((k, f"{' '.join(R.choice(vocabulary) for _ in range(50))} {' '.join(copy)} {words(30)}", None))
    got = decontaminate.matches(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len({(k, k) for k, _ in items} & found) >= 0.85 * len(items)


def test_short_items_match_whole(spark):
    items = spark.createDataFrame([(1, "Four little words here"), (2, "solo"), (3, "four little"), (4, "... !"), (5, "not in there"), (5, "solo")], "item_id long, text string").withColumn("lang", F.lit("x"))
    docs = docs_of(spark, [(1, "xx four, LITTLE words here", "a"), (1, "xx four, LITTLE words here", "a"), (2, "little four words solo.", None), (3, "four litle words here", None), (None, "solo", None), (4, None, None)]).withColumn("item_id", F.lit(9))
    got = sorted(tuple(r) for r in decontaminate.matches(docs, items).collect())
    one = [(1, 1, 0, 4, 1, 4), (1, 3, 0, 2, 1, 2)]
    assert got == sorted([*one, *one, (2, 2, 0, 1, 3, 1), (2, 5, 0, 1, 3, 1)])
    assert sorted(map(str, (r.doc_id for r in decontaminate.clean(docs, items).collect()))) == ["3", "4"]
    assert decontaminate.matches(docs.limit(0), items).count() == 0 and decontaminate.clean(docs.limit(0), items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == 6


def test_very_many_length_classes(monkeypatch):
    """More classes than a mask has bits."""
    monkeypatch.setattr(decontaminate, "MASK_BITS", 7)
    sizes, n = [], 5
    while len(sizes) < 20:
        sizes.append(n)
        n = max(n + 2, n * 5 // 4 + 1)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(R.choice(vocabulary) for _ in range(n))) for k, n in enumerate(sizes)]
    matcher = decontaminate.Matcher(items)
    assert len(matcher.classes) > 2 * decontaminate.MASK_BITS
    cache = decontaminate._Words(matcher.vocabulary)
    for k, text in items:
        found = matcher.find(decontaminate._word_ids(f"before it {text} after".encode(), cache))
        assert (k, 0) in [(x[0], x[1]) for x in found]


# packing, token counts, URL filters, toxicity, nearest neighbours


def test_packing_of_repeated_and_null_ids(spark):
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack(docs_of(spark, [(7, "a b", None), (7, "a b", None), (None, "c", None), (None, None, None)]).withColumn("offset", F.lit(1)), path).collect()
    assert sorted((r.doc_id or 0, r.start) for r in got) == [(0, 0), (0, 0), (7, 0), (7, 0)]
    assert sorted(r.offset for r in got)[0] == 0 and min(r.length for r in got) == 1


def test_token_counts_of_odd_tables(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    docs = docs_of(spark, [(7, "a b a", None), (7, "a b a", None), (None, None, None)]).withColumn("n_tokens", F.lit("old"))
    got = [(r.doc_id, r.n_words, r.n_distinct) for r in token_count.token_counts(docs, path, ["doc_id"]).collect()]
    assert sorted(got, key=str) == [(7, 3, 2), (7, 3, 2), (None, 0, 0)]
    assert token_count.token_counts(docs.limit(0), path, ["doc_id"]).count() == 0


def test_url_filter_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://A.com/x"), (2, None)], "page_id long, url string")
    rules = url_filter.rule_table(spark, [("block", "com", "/")])
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(pages, rules.limit(0), default="block").collect()}
    assert got == {1: ("a.com", None, "block"), 2: ("", None, "block")}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_toxicity_of_odd_tables(spark):
    rows = [(k, f"{words(30)} {'vile' if k % 3 == 0 else ''}", None) for k in range(120)]
    docs = docs_of(spark, rows + rows[:30] + [(None, "vile", None)]).withColumn("score", F.lit("old")).withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] * 2 + [(1000 + k, k % 2) for k in range(500)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.words == toxicity.train(docs_of(spark, rows), labels, max_rows=90).words  # labels without a document don't use the bound up
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 151 and all(r.predicted == int("vile" in t) for r in got if r.doc_id is not None for k, t, _ in rows if k == r.doc_id)
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_segments_take_linear_time():
    import time

    def took(n):
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            toxicity.segments([(k, 1.0 + 1e-6 * k) for k in range(n)], n)
            toxicity.segments([(9 * k, 1.0) for k in range(n)], 9 * n)
            runs.append(time.perf_counter() - began)
        return min(runs)

    assert took(128_000) < 24 * took(16_000)  # 8 where it is linear, 64 where it is quadratic


def nearest(spark, rows, **more):
    return ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **more)


def plain_recall(rows, got, k=5):
    x = np.array([v for _, v in rows])
    unit, ids, hit, total = x / np.linalg.norm(x, axis=1)[:, None], np.array([i for i, _ in rows]), 0, 0
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    for at in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[at]
        s[at] = -9
        hit += len(mine[int(ids[at])] & set(ids[np.lexsort((ids, -s))[:k]].tolist()))
        total += k
    return hit / total


def test_recall_above_a_block(spark):
    rng = np.random.default_rng(4)
    made = {"random": rng.standard_normal((6000, 64)), "clustered": (rng.standard_normal((150, 1, 64)) + 0.3 * rng.standard_normal((150, 40, 64))).reshape(-1, 64)}
    for data in made.values():
        rows = [(k, v.astype(np.float32).astype(float).tolist()) for k, v in enumerate(data)]
        assert plain_recall(rows, nearest(spark, rows).collect()) >= 0.9


def test_few_candidates_and_repeated_ids(spark):
    few = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest(spark, few).collect())
    half = round(0.5**0.5, 9)
    assert got == [(0, 1, 1, half), (0, 2, 50, 0.0), (50, 1, 1, half), (50, 2, 0, 0.0)]
    assert nearest(spark, few[:1]).count() == 0 and nearest(spark, few[1:2]).count() == 0 and nearest(spark, []).count() == 0
    twice = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0]), (5, [1.0, 0.1]), (7, [1.0])]
    got = [(r.rank, r.vec_id) for r in nearest(spark, twice, k=2).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 4)]
    clash = spark.createDataFrame([(0, [1.0, 0.0], 1, 2), (1, [1.0, 0.5], 1, 2)], "vec_id long, embedding array<double>, cid int, score int")
    assert [(r.query_id, r.vec_id) for r in ann.search(clash).collect()] == [(0, 1)]


def test_hot_vector_and_slices(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "SLICE", 2)
    rng = np.random.default_rng(6)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(200)] + [(200 + k, rng.standard_normal(3).astype(np.float32).astype(float).tolist()) for k in range(300)]
    got = nearest(spark, rows, target=1.0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0] == [1, 2, 3, 4, 5] and by[50] == [0, 1, 2, 3, 4] and by[150] == [0, 1, 2, 3, 4]
    assert sorted(by) == list(range(0, 500, 50)) and all(len(v) == 5 for v in by.values())
