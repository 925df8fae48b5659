"""WARC archives, phrase collocations and source divergence against plain versions, and the cases that each defines."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from eventloom.llm import divergence, phrases, warc
from eventloom.llm.common import shared_dir

R = random.Random(23)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# WARC


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, records int, sha string")


def page_rows():
    body = "<html><body>" + "<p>a paragraph of shared words</p>" * 20
    rows = [(k, f"https://h{k % 3}.example/p {k}%41?é=\r\n", f"{body}{k % 40} é {'x' * (k % 7)}") for k in range(300)]
    rows += [(400 + k, "u", "one page that many share") for k in range(150)]  # a hot payload
    rows += [(900, None, None), (901, "", ""), (902, "u", " "), (7, rows[7][1], rows[7][2]), (None, "n", "one page that many share"), (903, "long", "y" * 3_000_000)]
    return [(*r, 1, "x") for r in rows]


def plain_types(rows, least=0):
    firsts = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None and len((html or "").encode()) >= least:
            firsts[html or ""] = min(firsts.get(html or "", page_id), page_id)
    out = []
    for page_id, url, html, *_ in rows:
        data = (html or "").encode()
        first = firsts.get(html or "") if page_id is not None else None
        first = None if first == page_id else first
        out.append((page_id, url, "response" if first is None else "revisit", first, base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data), data if first is None else None))
    return out


@pytest.mark.parametrize("least", [0, 1, 100])
def test_archives_round_trip(spark, least):
    rows = page_rows()
    folder = shared_dir(spark)
    manifest = warc.write(pages_of(spark, rows).repartition(5), folder, least, archive_bytes=200_000)
    got = [tuple(None if v is None else bytes(v) if isinstance(v, bytearray) else v for v in r) for r in warc.read(manifest).collect()]
    assert sorted(got, key=repr) == sorted(plain_types(rows, least), key=repr)
    files = manifest.collect()
    assert sum(f.records for f in files) == len(rows) and len(files) > 5
    assert sum(f.bytes for f in files) < 0.2 * sum(f.raw_bytes for f in files)
    assert warc.read(manifest, payload=False).where("payload is not null").count() == 0


def test_archive_format(spark):
    folder = shared_dir(spark)
    manifest = warc.write(pages_of(spark, page_rows()).coalesce(1), folder).orderBy(F.desc("records")).collect()
    held = Path(manifest[0].path).read_bytes()
    assert held[:4] == bytes.fromhex("5d2a4d18") and manifest[0].dictionary_bytes > 1000
    size = int.from_bytes(held[4:8], "little")
    dictionary = zstandard.decompress(held[8 : 8 + size])
    assert dictionary[:4] == bytes.fromhex("37a430ec")
    data, frames = held[8 + size :], 0
    while data:  # each record is a frame of its own
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
        assert one.decompress(data).startswith(b"WARC/1.1\r\n")
        data, frames = one.unused_data, frames + 1
    assert frames == manifest[0].records + 1
    opened = [x for m in manifest for x in warc.opened(Path(m.path).read_bytes())]
    assert opened[0][0]["WARC-Type"] == "warcinfo"
    ids = {f["WARC-Record-ID"]: f for f, _ in opened}
    again = [f for f, _ in opened if f["WARC-Type"] == "revisit"]
    assert len(again) > 100 and all(ids[f["WARC-Refers-To"]]["X-Page-ID"] == f["X-Refers-To-Page-ID"] for f in again)


def test_a_dictionary_pays():
    records = [b"<html><head><title>t%d</title></head><body class='page'><div id='main'>%d %d</div></body></html>" % (k, k * k, R.random() * 1e6) for k in range(4000)]
    archive, size = warc.compressed(records, b"info")
    assert size and len(archive) < 0.5 * sum(len(zstandard.compress(r)) for r in records)
    assert warc.compressed([], b"info")[1] == warc.compressed([b"a"], b"info")[1] == 0
    assert list(warc.frames(io.BytesIO(archive)))[1:] == records


def test_strays_and_damage(spark):
    folder = shared_dir(spark)
    manifest = warc.write(pages_of(spark, page_rows()[:40]).coalesce(1), folder)
    path = Path(manifest.first().path)
    (path.parent / "pages-000000-00000-999.warc.zst").write_bytes(path.read_bytes())  # of an attempt that was lost
    assert warc.read(manifest).count() == 40
    assert warc.remove_strays(manifest, folder) == 1 and path.exists() and warc.remove_strays(manifest, folder) == 0
    one = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(one.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="within a record"):
        path.write_bytes(path.read_bytes()[:-20])
        warc.opened(path.read_bytes())


def test_no_pages(spark):
    manifest = warc.write(pages_of(spark, []))
    assert manifest.count() == 0 and warc.read(manifest).count() == 0


# phrases


def plain_collocations(rows, least, top, longest=4, scale=2_000_000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, known in f.items():
        wide = {p: a for p, a in known.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in wide.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * known[p[i : i + m]]}
        kept = []
        for p, a in wide.items():
            score, k = min((scale * a // (known[p[:k]] + known[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                kept.append((-score, -a, " ".join(p).encode(), known[p[:k]], known[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out, key=repr)


def phrase_rows():
    letters = ["new", "york", "New", "é", "x y", "日本", "a\x00b", "the", "city", "of", "über-Maß", "q r"]
    rows = [(R.choice(["en", "de", None, "und"]), " ".join(R.choice(letters) + R.choice(["", "", "", ".", ",", "\n", "\t", "!?", "\x0b"]) for _ in range(R.randint(0, 60)))) for _ in range(120)]
    rows += [("en", "new york city of the new york city")] * 50 + [("fr", "a a a a a a")] * 9 + [("en", None), ("fr", ""), ("fr", " \t.;"), (None, None)]
    return [*rows, ("long", "ab cd ef " * 4000), ("piece", "one. two! " * 300)]


@pytest.mark.parametrize(("shard_bytes", "least", "top"), [(6 << 20, 30, 2000), (700, 4, 25), (60, 2, 3)])
def test_collocations(spark, shard_bytes, least, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, shard int").repartition(6)
    got = phrases.collocations(docs, least=least, top=top, shard_bytes=shard_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == plain_collocations(rows, least, top)


def test_small_automata_count_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrases, "AUTOMATON_PHRASES", 7)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.collocations(docs, least=3)) == plain_collocations(rows, 3, 2000)


def test_nothing_to_count(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0


def test_sums_beyond_64_bits(spark, monkeypatch):
    big = 10**14
    known = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big), ("en", "a b c", big - 1), ("en", "c", big), ("en", "b c", big)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 10 * big)], "lang string, n long")
    monkeypatch.setattr(phrases, "counts", lambda *a: (known, totals))
    got = {r.phrase: r.score for r in phrases.collocations(known).collect()}
    assert got == {"a b c": 2_000_000 * (big - 1) // (4 * big)}


# divergence


def plain_audit(rows, least_docs=3, top=200):
    docs = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        total, seen, own = Counter(), Counter(), defaultdict(Counter)
        for _, source, text in (d for d in docs if d[0] == lang):
            terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
            total.update(terms), seen.update(set(terms)), own[source].update(terms)
        kept = sorted(t for t in total if seen[t] >= least_docs)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]

        q, p = shares(total), {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = sorted((-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o) for o in own if o != s)
            terms = sorted((-((a - b) ** 2 // b), t) for a, b, t in zip(p[s], q, kept, strict=True) if own[s][t] and a > b)[:top]
            out += [(lang, s, part, item, -value, rank) for part, found in (("pair", pairs), ("term", terms)) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out, key=repr)


def audit_rows(langs=("en", "de", None, "", "x")):
    words = ["".join(R.choice("abcdeEéß日") for _ in range(R.randint(1, 3))) for _ in range(150)]
    rows = [(lang, R.choice(["hot", "hot", "s1", "s2", "é", None, ""][: 2 + k]), " ".join(R.choice(words[: 30 * (k + 1)]) + R.choice(["", "1", "-", " "]) for _ in range(R.randint(0, 80)))) for k, lang in enumerate(langs) for _ in range(40)]
    rows += [("one", "alone", "a b a b")] * 3 + [("bare", "s1", "1 2"), ("bare", "s2", None), ("bare", "s3", "once")] + [("en", "silent", None), ("en", "silent", "?!"), rows[0]]
    return [*rows, ("en", "s1", "Long " * 50_000)]


@pytest.mark.parametrize(("block", "rounds", "top"), [(4096, 16, 200), (7, 2, 5)])
def test_audit(spark, block, rounds, top):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, seat int, block int").repartition(5)
    got = divergence.audit(docs, top=top, block_terms=block, rounds_a_job=rounds)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == plain_audit(rows, top=top)


def test_every_pair_meets_once(spark):
    """Tournament over 1 to 9 groups, a shared vocabulary of one block and of many."""
    for n in (1, 2, 5, 8, 9):
        rows = [("l", f"s{k}", " ".join(f"w{chr(97 + (i * k) % 11)}" for i in range(30))) for k in range(n)] * 3
        docs = spark.createDataFrame(rows, "lang string, source string, text string")
        got = divergence.audit(docs, block_terms=3, rounds_a_job=4)
        assert rows_of(got) == plain_audit(rows)
        assert {(r.source, r.item) for r in got.where("part = 'pair'").collect()} == set(itertools.permutations([f"s{k}" for k in range(n)], 2))


def test_heaps_flush(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    rows = audit_rows(("en", "de"))
    assert rows_of(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), top=4)) == plain_audit(rows, top=4)


def test_empty_audit(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(docs).count() == 0
    kept = divergence.audit(docs.unionByName(spark.createDataFrame([(None, None, None)], docs.schema)))
    assert kept.count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, c, v = 9 * 10**18 - 5, 10**13, 7
    got = spark.range(1).select(F.expr(divergence._share(f"{c}L", f"{n}L").replace(" v)", f" {v}L)")).alias("p")).first().p
    assert got == 1 + 10**9 * (c + 1) // (n + v)
