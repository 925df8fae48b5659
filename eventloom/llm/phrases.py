"""Phrase collocations: candidates from sketch upper bounds, counted exactly by automata, scored and thinned out.

Texts are folded into shards of one language: words joined by single spaces, pieces parted by a byte that no UTF-8 text has. A
shard hashes its phrases into the cells of a count-min sketch of one row, whose width grows with the text and which is never in
one place: it is dealt in blocks of cells, each block adds up what the shards sent, and answers each shard with those of its
cells that reach the least count. Such a cell bounds the counts of its phrases from above, so no phrase that reaches the count is missed. The
phrases of a shard that pass (with all phrases inside them) compile into Aho-Corasick automata, guarded by a delimiter on either side, and
a scan of the shard counts overlapping matches. Counts travel as packed lists, are summed in buckets of phrases, and only then held against the least count.

Every step is linear in the text; shards, blocks and automata are bounded, a shard but by its longest piece. A hot language or a
very long text is many shards. Nothing goes through the driver but the number of bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, raw, slices, texts, tidy

UNKNOWN = "und"
BREAK = b"\xff"
_SPLITS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER + b"\t" + _SPLITS, _LOWER + b" " + BREAK * len(_SPLITS))
SHARD_BYTES, BLOCK_BITS, AUTOMATON_PHRASES = 6 << 20, 18, 400_000
#: counts of phrases are summed in so many buckets, and one more for so much text
BUCKETS, BUCKET_BYTES, RANK_SALTS = 32, 8 << 20, 32
#: bytes of text for each cell of the sketch: about four phrases fall on a cell
BYTES_A_CELL = 8
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def folded(text: bytes) -> bytes:
    """Words, lower-cased in A-Z, with single spaces between them and a break between pieces."""
    return b" ".join(text.translate(_FOLD).replace(BREAK, b" \xff ").split())


def _cut(body: bytes, most: int) -> Iterator[bytes]:
    """body in parts of about most bytes, cut at breaks."""
    while len(body) > most and (at := body.find(b" \xff ", most)) >= 0:
        yield body[:at]
        body = body[at + 3 :]
    yield body


def shards(docs: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """(shard, lang, body, size, words) of docs (lang, text): folded texts of one language, compressed. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def shard(lang: str) -> pa.RecordBatch:
            body = b" \xff ".join(held.pop(lang))
            words = body.count(b" ") + 1 - body.count(BREAK)
            sizes.pop(lang)
            return pa.record_batch({
                "shard": pa.array([next(number)], pa.int64()), "lang": pa.array([lang]), "body": pa.array([zstandard.compress(body, 1)], pa.binary()),
                "size": pa.array([len(body)], pa.int64()), "words": pa.array([words], pa.int64()),
            })

        for batch in slices(batches, 256):
            for lang, text in zip(texts(batch, "lang"), raw(batch, "text"), strict=True):
                for part in _cut(folded(text), most):
                    if part.strip(b" \xff"):
                        held.setdefault(lang, []).append(part)
                        sizes[lang] = sizes.get(lang, 0) + len(part)
                        if sizes[lang] >= most:
                            yield shard(lang)
                        elif sum(sizes.values()) >= 4 * most:
                            yield shard(max(sizes, key=lambda x: sizes[x]))
        for lang in list(held):
            yield shard(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "shard long, lang string, body binary, size long, words long")


def _levels(words: list[bytes], lang: str, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 1 to longest: n, the hash of the phrase of n words at each start, and whether it lies in one piece."""
    digest = xxhash.xxh3_64_intdigest
    word = np.fromiter(map(digest, words), np.uint64, len(words))
    inside = word != np.uint64(digest(BREAK))
    h, whole = word + np.uint64(digest(lang.encode())), inside
    with np.errstate(over="ignore"):
        for n in range(1, longest + 1):
            if n > 1:
                h, whole = h[:-1] * _STEP + word[n - 1 :], whole[:-1] & inside[n - 1 :]
            h = (h ^ h >> np.uint64(30)) * _MIX
            h ^= h >> np.uint64(31)
            yield n, h, whole
            if len(h) < 2:
                return


def _pack(*columns: np.ndarray) -> bytes:
    """Integer arrays of one length, byte by byte, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), 1)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(flat) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(flat[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _cells(bits: int, longest: int, least: int):
    """Rows of shards → (block, shard, cells) with the shard's counts of its cells, none over least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = zstandard.decompress(body.as_py()).split(b" ")
                cells, counts = np.unique(np.concatenate([h[whole] >> np.uint64(64 - bits) for _, h, whole in _levels(words, lang, longest)]), return_counts=True)
                block = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
                offset = (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int32)
                counts = np.minimum(counts, least).astype(np.int32)
                start = np.flatnonzero(np.diff(block, prepend=-1))
                blobs = [_pack(np.diff(offset[a:b], prepend=0).astype(np.int32), counts[a:b]) for a, b in itertools.pairwise([*start.tolist(), len(block)])]
                yield pa.record_batch({"block": pa.array(block[start]), "shard": pa.array(np.full(len(start), shard, np.int64)), "cells": pa.array(blobs, pa.binary())})

    return run


def _answers(least: int):
    """Rows of _cells sorted by block → (shard, block, heavy): the shard's cells whose sum over all shards reaches least."""

    def answer(block: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for _, blob in rows:
            step, n = _unpack(blob, np.int32, np.int32)
            total[np.cumsum(step)] += n
        heavy = total >= least
        out = []
        for shard, blob in rows:
            cells = np.cumsum(_unpack(blob, np.int32, np.int32)[0])
            if len(cells := cells[heavy[cells]]):
                out.append((shard, _pack(np.diff(cells, prepend=0).astype(np.int32))))
        return pa.record_batch({"shard": pa.array([s for s, _ in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()), "heavy": pa.array([b for _, b in out], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        at = None
        for batch in batches:
            for block, shard, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != at and held:
                    yield answer(at, held)
                    held = []
                at = block
                held.append((shard, cells))
        if held:
            yield answer(at, held)

    return run


def _count(phrases: list[bytes], body: str) -> np.ndarray:
    """Overlapping matches of each phrase, by an automaton whose patterns carry a delimiter on either side."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase.decode('latin-1')} ", k)
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(body)), np.int64), minlength=len(phrases))


def _listed(phrases: list[bytes], counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype(np.int64).tobytes() + BREAK.join(phrases), 1)


def _scan(bits: int, longest: int, buckets: int):
    """Shards, each followed by its heavy cells → (bucket, lang, n, phrases): n phrases of the shard with their occurrences in it, dealt by hash."""

    def scanned(lang: str, packed: bytes, heavy: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        cells = np.sort(np.concatenate([(block << BLOCK_BITS) + np.cumsum(_unpack(blob, np.int32)[0]) for block, blob in heavy])).astype(np.uint64)
        body = zstandard.decompress(packed)
        words = body.split(b" ")
        bucket_of: dict[bytes, int] = {}
        inner = None
        for n, h, whole in _levels(words, lang, longest):
            at = np.flatnonzero(whole if inner is None else whole & inner[:-1] & inner[1:])
            cell = h[at] >> np.uint64(64 - bits)
            at = at[cells[np.minimum(np.searchsorted(cells, cell), len(cells) - 1)] == cell]
            inner = np.zeros(len(h), bool)
            inner[at] = True
            bucket_of.update(zip([b" ".join(words[i : i + n]) for i in at.tolist()], (h[at] % np.uint64(buckets)).tolist(), strict=True))
        del words
        text = f" {body.decode('latin-1')} "
        phrases = list(bucket_of)
        for k in range(0, len(phrases), AUTOMATON_PHRASES):
            part = phrases[k : k + AUTOMATON_PHRASES]
            counts = _count(part, text)
            bucket = np.fromiter(map(bucket_of.__getitem__, part), np.int64, len(part))
            order = np.argsort(bucket, kind="stable")
            edges = [*np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist(), len(order)]
            lots = [order[a:b] for a, b in itertools.pairwise(edges)]
            yield pa.record_batch({
                "bucket": pa.array(bucket[order[edges[:-1]]]), "lang": pa.array([lang] * len(lots), pa.string()), "n": pa.array(list(map(len, lots)), pa.int64()),
                "phrases": pa.array([_listed([part[i] for i in lot.tolist()], counts[lot]) for lot in lots], pa.binary()),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lang, body, heavy = None, None, None, []
        for batch in batches:
            for shard, block, name, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != at:
                    if heavy:
                        yield from scanned(lang, body, heavy)
                    at, lang, body, heavy = shard, name, blob, []
                else:
                    heavy.append((block, blob))
        if heavy:
            yield from scanned(lang, body, heavy)

    return run


def _summed(least: int):
    """Rows of _scan sorted by bucket and language → (lang, phrase, f) of the phrases whose occurrences sum to least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        at: tuple = (None, None)

        def told() -> pa.RecordBatch:
            kept = [x for x in total.items() if x[1] >= least]
            return pa.record_batch({"lang": pa.array([at[1]] * len(kept), pa.string()), "phrase": pa.array([x[0] for x in kept], pa.binary()).cast(pa.string()), "f": pa.array([x[1] for x in kept], pa.int64())})

        for batch in batches:
            for bucket, lang, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (bucket, lang) != at:
                    if total:
                        yield told()
                    total, at = {}, (bucket, lang)
                flat = zstandard.decompress(blob)
                for phrase, count in zip(flat[8 * n :].split(BREAK), np.frombuffer(flat, np.int64, n).tolist(), strict=True):
                    total[phrase] = total.get(phrase, 0) + count
        if total:
            yield told()

    return run


def counts(docs: DataFrame, longest: int = 4, least: int = 30, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of every phrase of 1 to longest words that occurs at least least times, and (lang, n) words a language."""
    parts = materialise(shards(docs, shard_bytes))
    size = parts.agg(F.sum("size")).first()[0] or 0
    bits = min(BLOCK_BITS + 24, max(BLOCK_BITS, (size // BYTES_A_CELL).bit_length()))
    cells = parts.select("shard", "lang", "body").mapInArrow(tidy(_cells(bits, longest, least)), "block long, shard long, cells binary")
    answers = cells.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_answers(least)), "shard long, block long, heavy binary")
    # a shard's text comes before its cells
    rows = parts.select("shard", F.lit(-1).cast("long").alias("block"), "lang", F.col("body").alias("blob")).unionByName(answers.select("shard", "block", F.lit(None).cast("string").alias("lang"), F.col("heavy").alias("blob")))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(tidy(_scan(bits, longest, BUCKETS + size // BUCKET_BYTES)), "bucket long, lang string, n long, phrases binary")
    out = materialise(rows.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(tidy(_summed(least)), "lang string, phrase string, f long"))
    words = materialise(parts.groupBy("lang").agg(F.sum("words").alias("n")))
    discard(parts)
    return out, words


def _joined(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, scale: int = 2_000_000, inside: tuple[int, int] = (80, 100), top: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to longest words within a piece that occurs a >= least times is cut in two where floor(scale * a / (l + r)) is
    smallest (ties: the shorter first part); l and r are the counts of the parts. It goes if a longer candidate around it has at least inside[0] / inside[1]
    of its count. Ties of score go to larger a, then to the smaller phrase in byte order.

    Null lang is und; null and empty texts have no words; repeated rows count each; a language without candidates, and an empty table, give no
    row; other columns don't matter.
    """
    known, totals = counts(docs, longest, least, shard_bytes)
    words = F.split("phrase", " ", -1)
    wide = known.withColumn("w", words).withColumn("m", F.size("w")).where("m > 1").withColumnRenamed("f", "a")
    at = wide.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    at = at.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("head"), _joined(F.col("w"), F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr(f"cast({scale} as decimal(12, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    cut = at.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    best = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # the largest count of a longer candidate around a phrase
    start = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda i: _joined(F.col("w"), i, n)))))
    around = wide.where("m > 2").select("lang", F.col("a").alias("longer"), start.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.expr(f"cast(longer as decimal(20, 0)) * {inside[1]} >= cast(a as decimal(20, 0)) * {inside[0]}")
    kept = best.join(around, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    # the top of salted parts first, so that a hot language is not ranked in one task
    salt = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return rows.where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
