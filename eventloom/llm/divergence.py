"""Source divergence audit: how far the words of each source of a language are from those of every other source.

A group is a source of a language. Its vector gives each kept term of the language a share of a billion, smoothed by one; a term
without occurrences has the group's least share, so vectors are sparse. The terms of a language are dealt into blocks by hash, and the vector of a
group in a block is packed. All pairs of groups meet by systolic rotation: residents stay cached in the partition of their
(language, block, seat), and packed peer vectors circulate. The rounds are those of a round-robin tournament (seats x and y meet in the
round where x + y = 2 * round modulo the number of seats, which is odd: one group rests each round, and an even number of groups gets an empty
seat). A meeting evaluates both directions, and sums over blocks are added up. Terms are ranked by heaps of bounded size in each task, then by rank.

The counts are summed in the tasks that read the texts, so a hot source is as many rows as it has terms; no group's vector is in one task.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, raw, slices, texts, tidy

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: letters, lower-cased, and all bytes over 0x7F stay; the rest parts terms
_FOLD = bytes(_LOWER[_UPPER.index(b)] if b in _UPPER else b if b in _LOWER or b > 0x7F else 0x20 for b in range(256))
WHOLE = 1_000_000_000
BLOCK_TERMS, HELD_TERMS, ROUNDS_A_JOB = 4096, 400_000, 16


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, docs): occurrences and documents of each term in each group, not yet summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (c, docs) in held.items():
                n = len(c)
                yield pa.record_batch({
                    "lang": pa.array([lang] * n, pa.string()), "source": pa.array([source] * n, pa.string()), "term": pa.array(list(c), pa.binary()).cast(pa.string()),
                    "c": pa.array(list(c.values()), pa.int64()), "docs": pa.array([docs[t] for t in c], pa.int64()),
                })
            held.clear()

        for batch in slices(batches, 256):
            for lang, source, text in zip(texts(batch, "lang"), texts(batch, "source"), raw(batch, "text"), strict=True):
                terms = text.translate(_FOLD).split()
                c, seen = held.setdefault((lang, source), (Counter(), Counter()))
                c.update(terms)
                seen.update(set(terms))
            if sum(len(c) for c, _ in held.values()) > HELD_TERMS:
                yield from rows()
        yield from rows()

    return docs.select("lang", "source", "text").mapInArrow(tidy(run), "lang string, source string, term string, c long, docs long")


def _share(count: str, total: str) -> str:
    """1 + floor(WHOLE * (count + 1) / (total + v)), exact beyond 64 bits."""
    return f"1 + cast({WHOLE} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0)) div (cast({total} as decimal(19, 0)) + v)"


def _local_top(top: int):
    """Rows (lang, source, item, value) → the top of each group in this task: larger values first, ties to the smaller item in byte order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[str, str], list] = {}
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
            names = [(x, y) for x in langs.dictionary.to_pylist() for y in sources.dictionary.to_pylist()]
            group = langs.indices.to_numpy() * len(sources.dictionary) + sources.indices.to_numpy()
            values = batch.column(3).to_numpy()
            # only rows that may enter a heap are looked at one by one
            bar = np.array([heaps[x][0].value if len(heaps.get(x, ())) == top else -1 for x in names], np.int64)
            at = np.flatnonzero(values >= bar[group])
            for k, item in zip(at.tolist(), batch.column(2).take(pa.array(at)).to_pylist(), strict=True):
                heap = heaps.setdefault(names[group[k]], [])
                new = _Row(int(values[k]), item)
                # a heap has its worst row on top: of equal values that with the larger item
                if len(heap) < top:
                    heapq.heappush(heap, new)
                elif heap[0] < new:
                    heapq.heapreplace(heap, new)
            if sum(map(len, heaps.values())) > HELD_TERMS:
                yield _told(heaps)
                heaps.clear()
        if heaps:
            yield _told(heaps)

    return run


class _Row:
    """Orders by value, then by item from last to first."""

    __slots__ = ("item", "value")

    def __init__(self, value: int, item: str) -> None:
        self.value, self.item = value, item

    def __lt__(self, other: _Row) -> bool:
        return (self.value, other.item) < (other.value, self.item)


def _told(heaps: dict) -> pa.RecordBatch:
    rows = [(lang, source, x.item, x.value) for (lang, source), heap in heaps.items() for x in heap]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["lang", "source", "item", "value"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """terms array<struct<i, p>> → vector binary: places and shares, compressed."""
    for batch in batches:
        out = []
        for row in batch.column(batch.schema.get_field_index("terms")):
            cells = row.values
            place = cells.field(0).to_numpy() if cells is not None else np.zeros(0, np.int32)
            share = cells.field(1).to_numpy() if cells is not None else np.zeros(0, np.int64)
            out.append(zstandard.compress(place.astype(np.int32).tobytes() + share.astype(np.int64).tobytes(), 1))
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "terms"}
        yield pa.record_batch(cols | {"vector": pa.array(out, pa.binary())})


def _dense(blob: bytes, least: int, size: int) -> np.ndarray:
    flat = zstandard.decompress(blob)
    n = len(flat) // 12
    out = np.full(size, least, np.int64)
    out[np.frombuffer(flat, np.int32, n)] = np.frombuffer(flat, np.int64, n, 4 * n)
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings of a resident and a peer → the sum over the block's terms, in both directions.

    Shares are at most a billion and one, so a squared difference fits 64 bits; so do the sums, as a group's shares sum to at most a billion and a term each.
    """
    names = ("host", "host_least", "host_vector", "peer", "peer_least", "vector", "size")
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        there, back = [], []
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.int64))
        for _, p0, p_vector, _, q0, q_vector, size in zip(*cols, strict=True):
            if known[0] is not p_vector:
                known = (p_vector, _dense(p_vector, p0, size))
            p, q = known[1], _dense(q_vector, q0, size)
            square = (p - q) ** 2
            there.append(int((square // q).sum()))
            back.append(int((square // p).sum()))
        lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        yield pa.record_batch({
            "lang": pa.array(lang * 2, pa.string()), "seat": pa.array(cols[0] + cols[3], pa.int32()), "other": pa.array(cols[3] + cols[0], pa.int32()), "value": pa.array(there + back, pa.int64()),
        })


def _rotated(vectors: DataFrame, rounds: int, a_job: int) -> DataFrame | None:
    """vectors (lang, block, seat, seats, size, least, vector) → (lang, seat, other, value) summed over blocks; seats is odd, made so by an empty one."""
    spark = vectors.sparkSession
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents = vectors.select("lang", "block", F.col("seat").alias("host"), F.col("least").alias("host_least"), F.col("vector").alias("host_vector"))
    residents = residents.repartition(places, "lang", "block", "host").persist()
    out = None
    for first in range(0, rounds, a_job):
        last = F.least(F.lit(first + a_job), F.col("seats")) - 1
        peers = vectors.where(F.col("seats") > first).select("lang", "block", "size", "seats", F.col("seat").alias("peer"), F.col("least").alias("peer_least"), "vector", F.explode(F.sequence(F.lit(first), last)).alias("round"))
        # the seat that a peer meets in this round; the smaller one is host, so each meeting takes place once
        host = F.pmod(2 * F.col("round") - F.col("peer"), F.col("seats"))
        peers = peers.withColumn("host", host).where("host < peer").drop("seats", "round").repartition(places, "lang", "block", "host")
        met = residents.join(peers, ["lang", "block", "host"]).mapInArrow(tidy(_met), "lang string, seat int, other int, value long")
        part = materialise(met.groupBy("lang", "seat", "other").agg(F.sum("value").alias("value")))
        out = part if out is None else out.unionByName(part)
    residents.unpersist()
    return out


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, block_terms: int = BLOCK_TERMS, rounds_a_job: int = ROUNDS_A_JOB) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text).

    Terms are runs of ASCII letters and of all characters beyond ASCII, lower-cased in A-Z; those in at least least_docs documents of a
    language are kept. Part pair: item is each other source of the language, value the divergence from it, all ranks. Part term: the top terms that the source
    uses more than its language does. Ranks go by value, larger first, ties to the smaller item in byte order.

    Null text, lang and source are empty text; repeated rows count each; a group without kept terms has pairs (0 where the language keeps
    none) and no terms; a source alone in its language has no pairs; an empty table gives no row; other columns don't matter.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = materialise(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")))
    # kept terms of each language, dealt into blocks
    kept = materialise(counted.groupBy("lang", "term").agg(F.sum("c").alias("lang_c"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_c").alias("lang_n"))
    names = materialise(docs.select("lang", "source").distinct())
    langs = names.groupBy("lang").agg(F.count("*").alias("groups")).join(langs, "lang", "left").na.fill(0, ["v", "lang_n"])
    langs = materialise(langs.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / block_terms))))
    block = F.expr("pmod(xxhash64(term), blocks)").alias("block")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    terms = materialise(kept.join(langs, "lang").select("lang", "term", "lang_c", block).withColumn("i", place))
    used = counted.drop("docs").join(terms, ["lang", "term"])
    sums = used.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    seat = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = names.join(sums, ["lang", "source"], "left").na.fill(0, ["n"]).withColumn("seat", seat).join(langs, "lang")
    groups = groups.withColumn("least", F.when(F.col("v") > 0, F.expr(_share("0L", "n"))).otherwise(F.lit(1)))
    # an odd number of seats: each round leaves out one seat of an odd number, and one seat is empty where groups are even
    groups = materialise(groups.withColumn("seats", (F.col("groups") + (F.col("groups") + 1) % 2).cast("int")))
    shares = used.join(groups.select("lang", "source", "seat", "n", "v", "lang_n"), ["lang", "source"])
    shares = materialise(shares.select("lang", "source", "seat", "block", "term", "i", F.expr(_share("c", "n")).alias("p"), F.expr(_share("lang_c", "lang_n")).alias("q")))
    # terms
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    above = above.mapInArrow(tidy(_local_top(top)), "lang string, source string, item string, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    # pairs
    cells = shares.groupBy("lang", "block", "seat").agg(F.collect_list(F.struct("i", "p")).alias("terms"))
    sizes = terms.groupBy("lang", "block").agg(F.count("*").cast("int").alias("size"))
    grid = groups.select("lang", "seat", "seats", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    grid = grid.join(sizes, ["lang", "block"], "left").na.fill(0, ["size"]).join(cells, ["lang", "block", "seat"], "left")
    vectors = materialise(grid.mapInArrow(tidy(_packed), "lang string, block long, seat int, seats int, least long, size int, vector binary"))
    rounds = groups.agg(F.max("seats")).first()[0] or 0
    values = _rotated(vectors, rounds, rounds_a_job)
    if values is not None:
        own, other = (groups.select("lang", F.col("seat").alias(s), F.col("source").alias(n)) for s, n in (("seat", "source"), ("other", "item")))
        pairs = values.groupBy("lang", "seat", "other").agg(F.sum("value").alias("value")).join(own, ["lang", "seat"]).join(other, ["lang", "other"])
        pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
        out = pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(out.select("lang", "source", "part", "item", "value", "rank"))
    out = out.select("lang", "source", "part", "item", "value", "rank")
    for done in (counted, kept, langs, names, terms, vectors):
        discard(done)
    return out
