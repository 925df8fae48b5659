"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import ann, components, decontaminate, language_id, packing, simhash, substring_dedup, token_count, toxicity, url_filter
from eventloom.llm.queries import tokenizer_path

R = random.Random(3)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 6))) for _ in range(120)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def documents(spark, texts, ids=None):
    rows = [(None if ids and ids[k] is None else int((ids or range(len(texts)))[k]), t, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, h string")


@pytest.fixture(scope="module")
def texts():
    base = [prose(R.randint(1, 300)) for _ in range(60)]
    out = base + [base[3]] * 20  # a hot copy
    passage = prose(70)
    out += [f"{prose(30)} {passage}\n{prose(10)}" for _ in range(15)]
    for t in base[:15]:
        words = t.split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    return [*out, "a " * 4000, prose(30_000), "", None, "   ", "one two"]


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, texts):
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).select("*", simhash.hex_fingerprint(F.col("fp")).alias("hex")).collect()}
    assert [got[k].hex for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[k].component_id for k in range(len(texts))] == want


@pytest.mark.parametrize("hot, sent", [(2048, 100_000), (1, 100_000), (1, 0)])
def test_simhash_links_at_the_bound(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(simhash, "HOT_HOME", hot)
    monkeypatch.setattr(simhash, "SENT_ANCHORS", sent)
    base = R.getrandbits(64)
    fps = [base]
    for _ in range(60):  # chains of flips, some at 3 bits and some at 4
        x = R.choice(fps)
        for b in R.sample(range(64), R.choice([1, 2, 3, 3, 4, 9])):
            x ^= 1 << b
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    classes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "node long, fp long")
    got = {r.node: r.root for r in components.connected_components(simhash.links(classes)).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == brute_components(fps)


def test_simhash_nulls_and_empty(spark):
    got = simhash.near_duplicates(documents(spark, ["a b c d", "a b c d", "a b c d"], [None, 5, 5])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (5, 5), (5, 5)]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.representatives(documents(spark, ["a b c d", "a b c d", "a b c d", "other words are here"], [None, 5, 5, 7]))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 5, 7]


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.root for r in components.connected_components(chain.repartition(7)).collect()} == {0}


# substring dedup


def brute_substrings(rows, window=20):
    seen, out = set(), {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, x in zip(words, gone, strict=True) if not x)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("splits", [(), (0.3, 0.6), substring_dedup.SPLITS])
def test_substring_dedup(spark, texts, splits):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(documents(spark, texts), splits=splits).collect()}
    assert got == brute_substrings(list(enumerate(texts)))
    assert sum(v[1] for v in got.values()) > 1000


def test_substring_index_compacts(spark, texts):
    docs = documents(spark, texts)
    index = substring_dedup.FingerprintIndex(spark, max_runs=1)
    got, last = {}, -1
    for high in (20, 50, 80, len(texts)):
        batch = docs.where((F.col("doc_id") > last) & (F.col("doc_id") <= high))
        got |= {r.doc_id: r.n_removed for r in index.add(batch, docs.where(F.col("doc_id") <= high)).collect()}
        last = high
    assert len(index.runs) == len(index.seen) == 1
    assert got == {k: v[1] for k, v in brute_substrings(list(enumerate(texts))).items()}


def test_substring_index_reopens(spark, texts):
    docs, want = documents(spark, texts), brute_substrings(list(enumerate(texts)))
    path, got, last = None, {}, -1
    for high in (20, 50, 80, len(texts)):
        index = substring_dedup.FingerprintIndex.open(spark, path) if path else substring_dedup.FingerprintIndex(spark, max_runs=2)
        batch = docs.where((F.col("doc_id") > last) & (F.col("doc_id") <= high))
        got |= {r.doc_id: r.n_removed for r in index.add(batch, docs.where(F.col("doc_id") <= high)).collect()}
        last, path = high, index.path
    assert got == {k: v[1] for k, v in want.items()}
    assert len(substring_dedup.FingerprintIndex.open(spark, path).runs) == 2
    with pytest.raises(FileNotFoundError):
        substring_dedup.FingerprintIndex.open(spark, substring_dedup.materialise(spark.range(1)).inputFiles()[0].rpartition("/")[0])


def test_substring_edges(spark):
    text = prose(25)
    got = substring_dedup.dedup(documents(spark, [text, text, text, prose(19)], [None, 4, 4, 6])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (4, 0), (4, 0), (6, 0)]
    assert substring_dedup.dedup(documents(spark, [])).count() == 0
    kept = {r.doc_id: r.text for r in substring_dedup.strip(documents(spark, [f"{text}\n tail", f"head \n{text}  end\nof", text, "", None])).collect()}
    assert kept == {0: f"{text}\n tail", 1: "head \nend\nof", 3: "", 4: None}


# language ID


def test_language_id(spark):
    make = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(k, " ".join("".join(R.choice(make[lang]) for _ in range(5)) for _ in range(40)), lang) for k, lang in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.train(docs.where("doc_id < 30"))
    got = {r.doc_id: r for r in language_id.predict(docs.withColumn("score", F.lit("old")), known).collect()}
    assert all(got[k].lang_pred == lang and 0 < got[k].score <= 1 for k, _, lang in rows)
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "123 !"), (3, "é" * 200_000)], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(odd, known).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(docs.limit(0))).collect()} == {"und"}


def test_bundles_are_sums_of_bound_letters():
    letter, vectors = language_id._letters(), language_id.Trigrams(64)
    codes, counts = language_id.trigrams("Ab-a", letter)
    total = np.zeros(64)
    for tri in (" ab", "ab ", "b a", " a "):
        a, b, c = (vectors._letter(ord(x)).astype(int) for x in tri)
        total += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.array_equal(vectors.bundle(codes, counts), total)


# packing


def test_best_fit_decreasing():
    for capacity in (7, 16, 2048):
        lengths = [R.randint(1, capacity) for _ in range(300)]
        rooms, want = [], {}
        for k in sorted(range(300), key=lambda k: -lengths[k]):
            fits = [r for r in rooms if r[0] >= lengths[k]]
            if not fits:
                rooms.append([capacity])
                fits = [rooms[-1]]
            best = min(r[0] for r in fits)
            want[k] = best - lengths[k]
            next(r for r in reversed(rooms) if r[0] == best)[0] -= lengths[k]
        got = packing.best_fit_decreasing(lengths, capacity)
        used = {}
        for k, (w, at) in enumerate(got):
            used.setdefault(w, []).append((at, lengths[k]))
            assert capacity - at - lengths[k] == want[k]
        for pieces in used.values():
            end = 0
            for at, n in sorted(pieces):
                assert at == end
                end += n
            assert end <= capacity


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    odd = [*texts, "Ünï ΣΑΣ café cafe\u0301 don't 12,5%% <|endoftext|> x\u00a0y İstanbul", "!!! ... ###"]
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(documents(spark, odd), path, with_ids=True).collect()
    for k, text in enumerate(odd):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [i for r in mine for i in r.ids] == ids
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for some in by.values():
        end = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    assert packing.pack(documents(spark, []), path).count() == 0


# URL filters


def test_url_filter(spark, monkeypatch):
    from eventloom.llm.queries import URL_RULES

    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "notexample.org", "x.com", "com", "org", "", "x.net", "org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/#t", "/de/x", "?q", "#f"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "no scheme", "://", "http://a://b/c"] + ["https://x.com/de/1"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("old"))

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:n].lower(), rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, "allow")))

    for few in (url_filter.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", few)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).collect()}
        assert got == {k: brute(u) for k, u in enumerate(urls)}


# toxicity


def brute_segments(scores):
    """Maximal segments by recursion: the best one, then those on either side of it."""
    def solve(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        i, j = best[3:]
        return [*solve(a, i), (i, j), *solve(j, b)]

    return solve(0, len(scores))


def test_segments():
    for _ in range(200):
        n = R.randint(1, 25)
        given = {k: R.uniform(-3, 3) for k in R.sample(range(n), R.randint(0, n))}
        scores = [given.get(k, -toxicity.DRIFT) for k in range(n)]
        got = toxicity.segments(sorted(given.items()), n)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_toxicity(spark):
    bad = ["vile", "foul", "nasty"]
    rows = []
    for k in range(300):
        words = prose(60).split()
        if toxic := k % 4 == 0:
            for w in bad:
                words.insert(R.randrange(len(words)), w + R.choice(["", "!", ","]))
        rows.append((k, " ".join(words), int(toxic)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(data.select("doc_id", "text"), data.where("doc_id < 200").select("doc_id", "toxic"))
    out = {r.doc_id: r for r in toxicity.score(data.select("doc_id", "text"), model, ["doc_id"]).collect()}
    held = [r for r in rows if r[0] >= 200]
    assert sum(out[k].predicted == t for k, _, t in held) >= 0.98 * len(held)
    assert all(out[k].passages for k, _, t in held if t)
    odd = documents(spark, [None, "", "vile " * 50_000])
    assert [r.predicted for r in toxicity.score(odd, model, ["doc_id"]).orderBy("doc_id").collect()] == [0, 0, 1]
    assert toxicity.score(odd, toxicity.train(odd.limit(0), data.select("doc_id", "toxic").limit(0)), ["doc_id"]).count() == 3


# decontamination


def test_edit_distance():
    for _ in range(300):
        item, words = ([R.randrange(4) for _ in range(R.randint(1, n))] for n in (8, 15))
        row = [0] * (len(words) + 1)
        for i, w in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(words, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
            row = new
        got, start, end = decontaminate.edit_distance_within(item, np.array(words))
        assert got == min(row) and 0 <= start <= end <= len(words)


def test_decontamination(spark):
    items = [(k, " ".join(R.choice(VOCABULARY) for _ in range(R.randint(6, 50)))) for k in range(40)] + [(99, "too short"), (100, None), (None, "x y z a b c")]
    docs, want = [], set()
    for k, text in items[:40]:
        words = text.upper().split()
        for _ in range(int(0.1 * len(words))):
            words[R.randrange(len(words))] = "stranger"
        docs.append(f"{prose(40)} {', '.join(words)}. {prose(30)}")
        want.add((k, k))
    docs += [" ".join(f"w{R.randrange(10**6)}" for _ in range(300)) for _ in range(20)] + ["", None, prose(40_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(documents(spark, docs), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(want & found) >= 0.95 * len(want)
    assert not {d for d, _ in found} & set(range(40, 62))
    assert all(r.edits <= decontaminate.allowed(r.item_words) for r in got)
    left = {r.doc_id for r in decontaminate.clean(documents(spark, docs), bench).collect()}
    assert set(range(40, 62)) <= left and not left & {d for d, _ in found}
    assert decontaminate.matches(documents(spark, docs), bench.limit(0)).count() == 0


# nearest neighbours


def test_hilbert_is_a_walk_over_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = ann.hilbert_keys(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(5)
    data = rng.standard_normal((40, 1, 12)) + 0.2 * rng.standard_normal((40, 15, 12))
    rows = [(k, v.tolist()) for k, v in enumerate(data.reshape(-1, 12))]
    rows += [(600 + k, rows[7][1]) for k in range(30)]  # equal vectors
    odd = [(900, None), (950, [0.0] * 12), (1000, [float("nan")] * 12), (1050, [1.0, None] * 6), (1100, [])]
    got = ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = total = 0
    for k, (i, _) in enumerate(rows):
        if i % 50 == 0:
            s = unit @ unit[k]
            order = sorted((-round(v, 12), j) for j, v in zip((r[0] for r in rows), s, strict=True) if j != i)[:5]
            mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
            assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
            hit += len({j for _, j in order} & {r.vec_id for r in mine})
            total += 5
    assert hit / total >= 0.9 and {r.query_id for r in got} == {i for i, _ in rows if i % 50 == 0}
    assert ann.search(spark.createDataFrame(odd[:1], "vec_id long, embedding array<float>")).count() == 0


# token counts


def test_token_counts(spark, texts):
    pieces = token_count.pieces_of(tokenizer_path("piece_bpe_32k.model"))
    vocabulary, scores = token_count.Vocabulary(pieces), dict(pieces)

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            options = [(best[i - 1][0] + vocabulary.unknown, best[i - 1][1] + len(word[i - 1].encode()))]
            options += [(best[k][0] + scores[word[k:i]], best[k][1] + 1) for k in range(max(0, i - 20), i) if word[k:i] in scores]
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        return best[-1][1]

    odd = [*texts, "日本語 naïve 😀x " + "ab" * 3000]
    got = {r.doc_id: r for r in token_count.token_counts(documents(spark, odd), tokenizer_path("piece_bpe_32k.model"), ["doc_id"]).collect()}
    for k, text in enumerate(odd):
        words = (text or "").split()
        known = {w: brute("▁" + w) for w in set(words)}
        assert (got[k].n_words, got[k].n_tokens) == (len(words), sum(known[w] for w in words))
