"""Near copies by the Jaccard similarity of five-word shingle sets: SimHash classes and MinHash bands find candidates, exact similarity decides.

The SimHash classes are op8's, by anchor-point covering, of fingerprints of the five-word shingles. 3 of 64 bits reach only a part of the pairs at 0.8, so bands find the rest: 32 bands of 5 minima miss a pair of similarity s with probability (1 - s^5)^32: 3 in a million at 0.8, 7 in a billion at 0.85.
Texts with equal sets are one node. Nodes that share a class or a band are joined to candidate components; a component's texts meet in one
task, where every pair that shares one of these and is not linked yet has its exact similarity taken.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialise, raw, slices, tidy
from .components import connected_components

SHINGLE, BANDS, ROWS = 5, 32, 5
_RNG = np.random.default_rng(8)
A = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
B = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word → hash. Bounded: it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word, 42)
        return got


def shingle_set(text: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the lower-cased runs of five words; fewer words: one run of all; none: empty."""
    words = text.lower().split()
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(ids))
    code = np.full(len(ids) - width + 1 if width else 0, width, np.uint64)
    for k in range(width):
        code = (code ^ ids[k : k + len(code)]) * MIX
        code ^= code >> np.uint64(32)
    return np.unique(code)


def band_keys(codes: np.ndarray) -> np.ndarray:
    """A key for each band, of the minima of its rows; none for an empty set."""
    if not len(codes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    x = (codes >> np.uint64(16)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024] * A + B).min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ part) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 0.8: shared >= 0.8 * (a + b - shared)."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return 9 * shared >= 4 * (len(a) + len(b))


def fingerprint(codes: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed number: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(codes), 8192):
        counts += np.unpackbits(codes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(codes), bitorder="little").tobytes(), "little", signed=True)


def linked(sets: list[np.ndarray], classes: list[int] | None = None) -> list[list[int]]:
    """Positions of the sets by class, over links of similar sets that share a band or are of one SimHash class."""
    keys = [band_keys(s).tolist() for s in sets]
    for some, name in zip(keys, classes or [], strict=bool(classes)):
        some.append(("class", name))
    members: dict[int, list[int]] = defaultdict(list)
    for k, some in enumerate(keys):
        for key in some:
            members[key].append(k)
    left, out = set(range(len(sets))), []
    for first in range(len(sets)):
        if first not in left:
            continue
        left.discard(first)
        group = [first]
        for at in group:  # grows
            tried: set[int] = set()
            for key in keys[at]:
                members[key] = still = [y for y in members[key] if y in left]
                tried.update(still)
            near = [y for y in tried if similar(sets[at], sets[y])]
            left.difference_update(near)
            group += near
        out.append(group)
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in slices(batches, 512):
        nodes, keys, fps = [], [], []
        for text in raw(batch, "text"):
            codes = shingle_set(text, hashes)
            nodes.append(xxhash.xxh64_intdigest(codes.tobytes(), 42))
            keys.append(band_keys(codes))
            fps.append(fingerprint(codes))
        yield pa.record_batch({"id": batch.column(0), "h": batch.column(1), "no_id": batch.column(2), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "fp": pa.array(fps, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) in order of key → an edge from each node to the first node of its key."""
    key = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        new = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
        heads = np.where(new, np.arange(len(keys)), -1)
        at = np.maximum.accumulate(heads)
        low = np.where(at >= 0, nodes[at], first if first is not None else 0)
        key, first = keys[-1], low[-1]
        use = nodes != low
        yield pa.record_batch({"src": pa.array(nodes[use]), "dst": pa.array(low[use])})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(candidate root, node, SimHash class, text) in order of root → (node, root) of the classes of two nodes and more."""
    hashes, now = _Hashes(), None
    held: dict[int, np.ndarray] = {}
    classes: dict[int, int] = {}

    def settle() -> pa.RecordBatch:
        names = list(held)
        pairs = [(names[k], min(names[x] for x in group)) for group in linked(list(held.values()), list(classes.values())) if len(group) > 1 for k in group]
        held.clear()
        classes.clear()
        flat = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.record_batch({"node": pa.array(flat[:, 0]), "root": pa.array(flat[:, 1])})

    for batch in slices(batches, 256):
        for root, node, name, text in zip(*[batch.column(k).to_pylist() for k in range(3)], raw(batch, "text"), strict=True):
            if root != now:
                if held:
                    yield settle()
                now = root
            held[node], classes[node] = shingle_set(text, hashes), name
    if held:
        yield settle()


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies stays: the smallest doc_id, null ids last. Rows are told apart by doc_id and text."""
    row = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h")]
    found = docs.select(*row, F.col("doc_id").isNull().alias("no_id"), "text").mapInArrow(tidy(_sketches), "id long, h long, no_id boolean, node long, fp long, keys array<long>")
    nodes = materialise(found.groupBy("node").agg(F.min(F.struct("no_id", "id", "h")).alias("pick"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    prints = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    named = prints.join(connected_components(simhash.links(prints)), "node", "left").select("fp", F.coalesce("root", "node").alias("class"))
    nodes = materialise(nodes.join(named, "fp").drop("fp"))
    # a class is a key like a band; a name of its own keeps them apart
    keyed = nodes.select(F.explode(F.array_append("keys", F.xxhash64(F.lit("class"), "class"))).alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    meets = connected_components(keyed.mapInArrow(tidy(_stars), "src long, dst long"))
    wanted = nodes.join(meets, "node").select(F.col("pick.id").alias("id"), F.col("pick.h").alias("h"), "node", "root", "class")
    texts = docs.select(*row, "text").join(wanted, ["id", "h"]).select("root", "node", "class", "text")
    roots = materialise(texts.repartition("root").sortWithinPartitions("root").mapInArrow(tidy(_verify), "node long, root long"))
    chosen = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("pick").alias("pick")).select(F.col("pick.id").alias("_i"), F.col("pick.h").alias("_h"))
    kept = docs.select("*", row[0].alias("_i"), row[1].alias("_h")).join(chosen, ["_i", "_h"], "left_semi")
    return kept.dropDuplicates(["_i", "_h"]).select(*docs.columns)
