from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as pipeline
from eventloom.llm import decontaminate, language_id
from eventloom.llm.common import table
from eventloom.llm.queries import tokenizer_path

from .test_near_copies import classes
from .test_operators import brute_substrings

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialise(stage(spark, docs, DATA))
        assert docs.columns == columns, name
        counts.append(docs.count())
        assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    assert counts[1] == counts[0] and counts[2] < counts[1] and counts[4] < counts[3]
    packed = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_rejects_noise(spark):
    known = table(spark, DATA, "documents")
    odd = spark.createDataFrame([(-1, "123 456", "en", "s", 7), (-2, None, None, None, None)], known.schema)
    left = {r.doc_id for r in pipeline.known_language(spark, known.unionByName(odd), DATA).collect()}
    assert left == {r.doc_id for r in known.collect()}
    assert language_id.UNKNOWN == "und"


def test_nothing_learned_keeps_all_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None, None, None), (1, None, None, None, None), (None, "7", None, None, None)], SCHEMA)
    assert sorted(map(tuple, pipeline.known_language(spark, docs, DATA).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    docs = docs.unionByName(spark.createDataFrame([(None, "some more words", "en", None, None)], SCHEMA))
    got = pipeline.known_language(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0, r.text, r.lang) for r in got) == [(0, "some more words", "en"), (1, "some words", "en")]


def plain_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(23)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(900)]

    def prose(n):
        return [r.choice(vocabulary) for _ in range(n)]

    passage, items = prose(60), [prose(n) for n in (3, 8, 14, 30)]
    rows = [prose(r.randint(20, 160)) for _ in range(30)]
    rows += [rows[1], rows[2][:-1] + ["changed"], rows[3] + ["more"], [*prose(10), *passage, *prose(9)], [*prose(12), *passage], passage[5:45]]
    for item in items:
        copy = list(item)
        copy[1:2] = ["edited"] if len(item) > 8 else copy[1:2]
        rows.append([*prose(20), *copy, *prose(15)])
    texts = [" ".join(w) for w in rows] + [None, "12 345", " ".join(prose(5000)), "", "..."]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()

    left = {k: t for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    roots = classes(list(left.values()))
    left = {k: t for n, (k, t) in enumerate(left.items()) if roots[n] == n}
    seen, cut = set(), {}
    for k, t in left.items():  # kept words
        words = t.split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        cut[k] = [w for w, x in zip(words, gone, strict=True) if not x]
        assert hashlib.sha256(" ".join(cut[k]).encode()).hexdigest() == brute_substrings(list(left.items()))[k][2] if k % 20 == 0 else True
    cut = {k: w for k, w in cut.items() if w}
    clean = {k: w for k, w in cut.items() if not any(plain_distance(item, w) <= decontaminate.allowed(len(item)) for item in items)}
    assert len(texts) - 4 > len(left) > len(clean) > 30 and any(len(cut[k]) < len(left[k].split()) for k in cut)
    tokenizer, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
    for k, w in clean.items():
        ids = [*tokenizer.encode(" ".join(w), add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            want[k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    windows = {}
    for x in got:
        windows.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces in windows.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:], strict=False)) and sum(n for _, n in pieces) <= 2048
