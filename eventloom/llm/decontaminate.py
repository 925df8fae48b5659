"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Items and documents are words (letters and digits, lower case); a word that no item has is one and the same stranger.
The CGK embedding (Chakraborty, Goldenberg, Koucky, 2016) walks over a window with random bits that depend on the step
and on the word: at each step it writes the word it stands on, then stays or moves on. Windows within few edits are
written almost alike, so a few sampled steps agree with high probability. Each of several walks is sampled several
times; a window becomes a candidate of an item when one sample agrees. Windows are sized by classes of item lengths.

Conditions that every match meets are tested on all positions before the walks: k edits destroy at most gk of an item's
runs of g words, so a match of an item of n words holds n - g + 1 - gk runs that occur in items of its class (g = 2 and 3). They drop
no match.

A match is a stretch of a document whose word edit distance from the item is at most a fifth of the item's words.
Items of under 5 words allow no edit: their runs of words are looked up whole. Items without a word match nothing. Items are taken
in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, tidy

EDITS, MIN_WORDS, WALKS, SAMPLES, SAMPLED, BLOCK_ITEMS, MASK_BITS = 0.2, 5, 4, 8, 4, 20_000, 32
WORD = re.compile(r"[^\W_]+")
GRAMS = (2, 3)


def item_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed(n: int) -> int:
    return int(EDITS * n + 1e-9)


def edit_distance_within(item: list[int], words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end): the stretch of words nearest to the item; ties: the first end, then the latest start."""
    n = len(words)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    at = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        swap = cost[:-1] + (words != w)
        drop = cost[1:] + 1
        new = np.concatenate(([i], np.minimum(swap, drop)))
        origin = np.concatenate(([0], np.where(swap <= drop, start[:-1], start[1:])))
        # insertions: the running minimum of new - position
        low = np.minimum.accumulate(new - at)
        src = np.maximum.accumulate(np.where(new - at == low, at, 0))
        cost, start = low + at, origin[src]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Matcher:
    """Items of one block, hashed."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, w) for i, w in ((i, item_words(t)) for i, t in items) if w]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        self.classes: list[tuple[int, int, int]] = []  # item words from, to; steps of a walk
        self.short: dict[int, dict[int, list[int]]] = {}  # by length and code of the words
        for k, ids in enumerate(self.ids):
            if len(ids) < MIN_WORDS:
                self.short.setdefault(len(ids), {}).setdefault(int(self._codes(ids, len(ids))[0]), []).append(k)
        lengths = sorted({len(w) for w in self.ids if len(w) >= MIN_WORDS})
        while lengths:
            low = lengths[0]
            of = [n for n in lengths if n <= max(low + 1, low * 5 // 4)]
            lengths = lengths[len(of) :]
            self.classes.append((low, of[-1], 2 * low))
        self.shift = 64 - min(26, max(18, 5 + sum(map(len, self.ids)).bit_length()))
        #: for each run of g words a bit for every class that has it, 32 classes to a mask
        groups = -(-len(self.classes) // MASK_BITS)
        self.runs = {g: [np.zeros(1 << 64 - self.shift, np.uint32) for _ in range(groups)] for g in GRAMS}
        self.needed = {g: [min(n - g + 1 - g * allowed(n) for n in {len(w) for w in self.ids} if low <= n <= high) for low, high, _ in self.classes] for g in GRAMS}
        for ids in self.ids:
            c = next((c for c, (low, high, _) in enumerate(self.classes) if low <= len(ids) <= high), None)
            for g in GRAMS if c is not None else ():
                self.runs[g][c // MASK_BITS][self._runs(ids, g)] |= np.uint32(1 << c % MASK_BITS)
        self.bits = np.random.default_rng(20).integers(0, 2, (WALKS, 2 * max((len(w) for w in self.ids), default=1), len(self.vocabulary) + 1), np.uint8)
        self.tables: list[dict[tuple[int, int, int], list[int]]] = []
        for low, high, steps in self.classes:
            table: dict[tuple[int, int, int], list[int]] = defaultdict(list)
            for k, ids in enumerate(self.ids):
                if low <= len(ids) <= high:
                    for walk, sample, keys in self._keys(np.concatenate((ids, np.zeros(2 * high, np.int64))), np.zeros(1, np.int64), steps):
                        table[walk, sample, int(keys[0])].append(k)
            self.tables.append(dict(table))

    @staticmethod
    def _codes(ids: np.ndarray, g: int) -> np.ndarray:
        """Hash of the run of g words at each position."""
        n = max(0, len(ids) - g + 1)
        code, words = np.zeros(n, np.uint64), ids.astype(np.uint64)
        for k in range(g):
            code = (code ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(32)
        return code

    def _runs(self, ids: np.ndarray, g: int) -> np.ndarray:
        """Slot of the run of g words at each position."""
        return (self._codes(ids, g) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(self.shift)).astype(np.int64)

    def _exact(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first start) of the short items that occur."""
        for g, table in self.short.items():
            codes = self._codes(ids, g)
            for at in np.flatnonzero(np.isin(codes, np.fromiter(table, np.uint64, len(table)))).tolist():
                for k in table[int(codes[at])]:
                    if np.array_equal(self.ids[k], ids[at : at + g]):
                        yield k, at

    def _starts(self, masks: dict[int, list[np.ndarray]], c: int, n: int) -> np.ndarray:
        """Positions whose window holds enough runs of items of class c."""
        high = self.classes[c][1]
        span, fine = high + allowed(high), np.ones(n, bool)
        for g, mask in masks.items():
            if (needed := self.needed[g][c]) > 0:
                seen = np.concatenate(([0], np.cumsum(mask[c // MASK_BITS] >> np.uint32(c % MASK_BITS) & np.uint32(1), dtype=np.int64)))
                if seen[-1] < needed:
                    return np.zeros(0, np.int64)
                at = np.minimum(np.arange(n), len(seen) - 1)
                fine &= seen[np.minimum(at + span - g + 1, len(seen) - 1)] - seen[at] >= needed
        return np.flatnonzero(fine)

    def _keys(self, ids: np.ndarray, starts: np.ndarray, steps: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(walk, sample, key of each start): the words written at the sampled steps of the walk."""
        for walk in range(WALKS):
            at, written = starts.copy(), []
            for step in range(steps):
                here = ids[at]
                written.append(here)
                at = at + self.bits[walk, step][here]
            rng = np.random.default_rng([walk, steps])
            for sample in range(SAMPLES):
                key = np.zeros(len(starts), np.uint64)
                with np.errstate(over="ignore"):
                    for step in sorted(rng.choice(steps, min(SAMPLED, steps), replace=False).tolist()):
                        key = (key ^ written[step].astype(np.uint64)) * np.uint64(0x100000001B3)
                        key ^= key >> np.uint64(29)
                yield walk, sample, key

    def find(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best match of each item in one document."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, at in self._exact(ids):
            best.setdefault(k, (0, at, at + len(self.ids[k])))
        if not self.classes:
            return [(k, *found) for k, found in sorted(best.items())]
        masks: dict[int, list[np.ndarray]] = {}
        for g in GRAMS:
            slots = self._runs(ids, g)
            masks[g] = [runs[slots] for runs in self.runs[g]]
            held = int(np.count_nonzero(np.bitwise_or.reduce(masks[g]))) if len(masks[g]) > 1 else int(np.count_nonzero(masks[g][0]))
            if 0 < min(self.needed[g]) > held:  # too few runs for any class
                return [(k, *found) for k, found in sorted(best.items())]
        padded = np.concatenate((ids, np.zeros(4 * self.classes[-1][1], np.int64)))
        for c, ((_, _, steps), table) in enumerate(zip(self.classes, self.tables, strict=True)):
            starts = self._starts(masks, c, len(ids))
            if not len(starts):
                continue
            found: dict[int, list[int]] = defaultdict(list)
            for walk, sample, keys in self._keys(padded, starts, steps):
                for start, key in zip(starts.tolist(), keys.tolist(), strict=True):
                    for k in table.get((walk, sample, key), ()):
                        found[k].append(start)
            for k, some in found.items():
                n, most = len(self.ids[k]), allowed(len(self.ids[k]))
                some = sorted(set(some))
                done = -1
                for start in some:
                    if start <= done:
                        continue
                    if k in best and best[k][0] == 0:
                        break
                    a, b = max(0, start - 2 * most), min(len(ids), start + 2 * n + 2 * most)
                    done = start + n // 2
                    distance, s, e = edit_distance_within(self.ids[k].tolist(), ids[a:b])
                    if distance <= most and (k not in best or (distance, a + s) < best[k][:2]):
                        best[k] = (distance, a + s, a + e)
        return [(k, *found) for k, found in sorted(best.items())]


class _Words(dict):
    """Chunk of text → item word ids of its words; strangers are 0. Bounded: it starts anew when full."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, chunk: bytes) -> tuple[int, ...] | int:
        if len(self) > 400_000:
            self.clear()
        ids = [self.vocabulary.get(w, 0) for w in item_words(chunk.decode("utf-8", "replace"))]
        self[chunk] = got = ids[0] if len(ids) == 1 else tuple(ids)
        return got


def _matchers(items: DataFrame) -> Iterator[Matcher]:
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    n_blocks = -(-known.count() // BLOCK_ITEMS)
    for block in range(n_blocks):
        # by a hash, so that a block's size is bounded in expectation; what is sent out is one block
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        matcher = Matcher(sorted({(r.item_id, r.text) for r in part.collect()}))
        if matcher.items:
            yield matcher


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_word, n_words): the best match of each item in each document.

    Of equally good matches the first counts. Null texts have no words; rows whose doc_id or item_id is null are left out; an
    item whose words repeat those of another matches by itself, as does each text of an item_id that has several; repeated rows
    of documents give repeated matches, repeated rows of items don't. Either table may be empty, and have more columns.
    """
    schema = "doc_id long, item_id long, edits long, item_words long, start_word long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out = None
    for matcher in _matchers(items):
        one = rows.mapInArrow(tidy(_finder(matcher)), schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _word_ids(text: bytes, cache: _Words) -> np.ndarray:
    chunks = text.split()
    try:
        return np.fromiter(map(cache.__getitem__, chunks), np.int64, len(chunks))
    except (TypeError, ValueError):  # a chunk of no word or of several
        return np.array([i for g in map(cache.__getitem__, chunks) for i in (g if isinstance(g, tuple) else (g,))], np.int64)


def _finder(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words(matcher.vocabulary)
        for batch in slices(batches, 512):
            out: list[tuple[int, ...]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch, "text"), strict=True):
                out += [(doc_id, matcher.items[k][0], d, len(matcher.ids[k]), s, e - s) for k, d, s, e in matcher.find(_word_ids(text, cache))]
            cols = list(zip(*out, strict=True)) or [()] * 6
            names = ("doc_id", "item_id", "edits", "item_words", "start_word", "n_words")
            yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})

    return run


def _without(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words(matcher.vocabulary)
        for batch in slices(batches, 512):
            yield batch.filter(pa.array([not matcher.find(_word_ids(text, cache)) for text in raw(batch, "text")], pa.bool_()))

    return run


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a match; ids of documents are not looked at, so null and repeated ones don't matter."""
    out = docs
    for matcher in _matchers(items):
        out = out.mapInArrow(tidy(_without(matcher)), docs.schema)
    return out
