"""SimHash near-duplicate classes by anchor-point covering.

Fingerprints within 3 of 64 bits agree, but for one bit at most, in the first or in the second half. On 31 bits of
each half the perfect Hamming code [31, 26] is the covering code: its codewords are the anchors, and every pattern
lies within 1 bit of exactly one of them. A fingerprint is at home at that anchor, and is replicated to every anchor
within the covering radius plus one (home and, unless it is a codeword itself, 15 others). Two linked fingerprints then
meet at the home anchor of either. Anchors compare what they hold and pass on a spanning forest, never all pairs.

An anchor with very many fingerprints at home is split by the other half: its four bytes can't all differ where 3 bits do, so
what it holds goes to four sub-anchors, named by the place and value of a byte, and two linked fingerprints meet at one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise, raw, tidy
from .components import connected_components

CODE_BITS = 31
#: an anchor with more fingerprints at home is split; up to so many such anchors are sent out, beyond that they are joined in salted copies
HOT_HOME, SENT_ANCHORS, SALTS = 2048, 100_000, 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of lower-cased word shingles, repeats included; fewer words: one shingle of all; none: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    spans = zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    for at in range(0, n, 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; null text is empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, shingle) for x in raw(batch, "text")], np.uint64)
        return pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, fp long")


def _half_keys(fp: Column, half: int, home_only: bool = False) -> Column:
    part = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    base = F.lit(half << CODE_BITS).cast("long")
    syndrome = F.lit(0).cast("long")
    for bit in range(5):
        mask = sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> bit & 1)
        syndrome = syndrome + F.bit_count(part.bitwiseAND(F.lit(mask))).cast("long") % 2 * (1 << bit)
    # flips[i] is the bit at position i of the code, counted from 1; position 0 is no bit
    flips = F.array(*[F.lit(1 << i >> 1).cast("long") for i in range(CODE_BITS + 1)])

    def flip(position: Column) -> Column:
        return F.element_at(flips, (position + 1).cast("int"))

    def partner(position: Column) -> Column:
        return position.cast("long").bitwiseXOR(syndrome)

    pairs = F.filter(F.sequence(F.lit(1), F.lit(CODE_BITS)), lambda i: (partner(i) > i) & (syndrome > 0))
    others = F.transform(pairs, lambda i: F.struct(part.bitwiseXOR(flip(i)).bitwiseXOR(flip(partner(i))).bitwiseOR(base).alias("key"), F.lit(False).alias("home")))
    home = F.struct(part.bitwiseXOR(flip(syndrome)).bitwiseOR(base).alias("key"), F.lit(True).alias("home"))
    return F.array(home) if home_only else F.concat(F.array(home), others)


def _anchor_keys(fp: Column, home_only: bool = False) -> Column:
    """Array of (key, home) for both halves of a fingerprint."""
    return F.concat(_half_keys(fp, 0, home_only), _half_keys(fp, 1, home_only))


def _sub_anchors(key: Column, fp: Column) -> Column:
    """Keys by a byte of the half that the anchor is not about, for each of its four bytes."""
    other = F.shiftrightunsigned(fp, 32)
    other = F.when(F.shiftright(key, CODE_BITS) == 0, other).otherwise(fp)
    return F.array(*[F.xxhash64(key, F.lit(k), F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255))) for k in range(4)])


def _forest(nodes: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links at one anchor: each fingerprint is reached once and compared with those not reached yet."""
    left = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= bits
            if not home[at]:  # two guests meet at the home of either; here only a host counts
                near &= home[left]
            if near.any():
                met = left[near]
                out += [(int(nodes[at]), int(nodes[x])) for x in met]
                front += met.tolist()
                left = left[~near]
    return out


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def groups(cols: list[np.ndarray]) -> list[tuple[int, int]]:
            key, node, fp, home = cols
            cut = np.flatnonzero(np.diff(key)) + 1
            start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            big = end - start > 1
            out: list[tuple[int, int]] = []
            for a, b in zip(start[big].tolist(), end[big].tolist(), strict=True):
                if home[a:b].any():
                    out += _forest(node[a:b], fp[a:b].view(np.uint64), home[a:b], bits)
            return out

        def edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            flat = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.record_batch({"src": pa.array(flat[:, 0]), "dst": pa.array(flat[:, 1])})

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest and rest[0][0][0] != cols[0][-1]:
                cols = [np.concatenate(x) for x in zip(*rest, cols, strict=True)]
                rest = []
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield edges(groups([c[:last] for c in cols]))
            rest.append([c[last:] for c in cols])
        if rest:
            yield edges(groups([np.concatenate(x) for x in zip(*rest, strict=True)]))

    return run


def links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """classes (node, fp), fp distinct → (src, dst) edges whose components are those of all pairs within bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover at most 3 bits")
    spread = classes.repartition("fp")
    rows = spread.select(F.explode(_anchor_keys(F.col("fp"))).alias("a"), "node", "fp").select("a.key", "node", "fp", "a.home")
    crowds = classes.select(F.explode(_anchor_keys(F.col("fp"), True)).alias("a")).groupBy("a.key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_HOME)
    hot = materialise(crowds.select("key", F.lit(True).alias("hot")))
    if n := hot.limit(SENT_ANCHORS + 1).count():
        if n <= SENT_ANCHORS:
            rows = rows.join(F.broadcast(hot), "key", "left")
        else:
            salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(hot.select("*", salts), ["key", "salt"], "left")
        keys = F.when(F.col("hot"), _sub_anchors(F.col("key"), F.col("fp"))).otherwise(F.array("key"))
        rows = rows.select(F.explode(keys).alias("key"), "node", "fp", "home")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_compare(bits)), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included.

    A row whose doc_id is null gets its fingerprint and takes no part in links (component_id null). Repeated rows stay.
    Exact classes of fingerprints are formed first, with partial aggregation; only one row of a class goes to the anchors.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle))
    classes = materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = connected_components(links(classes, bits))
    named = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id; of rows that share that id, one. Rows without an id stay."""
    found = near_duplicates(docs.select("doc_id", "text"), shingle=shingle, bits=bits)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("_n = 1")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
