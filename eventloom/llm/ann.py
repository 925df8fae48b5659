"""Approximate nearest neighbours on shifted space-filling curves.

Unit vectors are projected at random (a fixed orthonormal map a curve) to a few dimensions, shifted, cut into cells and
put in order along a Hilbert curve; a range partitioning by (curve, key) makes the ordered list, cut into blocks. A query
looks through the ranks within a window around its own on each curve, block by block; the blocks' answers are merged and
reranked by the exact cosine. Curves carry digests only; vectors travel to the blocks of one curve after the other.

Window and number of curves are not guessed: a bounded pilot of queries is answered exactly, for each number of curves the smallest
window is taken that would have found the wanted share of their neighbours, and the pair that looks through least is used. On data
without structure in few dimensions (like random directions in 64) that is most of one list, on clustered data it is narrow. The
window spans k ranks at least, so a query meets k other vectors, or all there are.

Equal vectors (by a 128-bit digest) are put on the curves once; k + 1 smallest ids stand for them, which is all that k answers can
use, and queries with equal vectors are answered together. A task meets one block and a bounded slice of the queries that look through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, tidy

CURVES, DIMS, BITS, BLOCK, PILOT, TARGET, SLICE, SALTS = 6, 6, 6, 2048, 48, 0.97, 1024, 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of cell coordinates (Skilling, 2004), as int64; dims * bits must be under 63."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    rng = np.random.default_rng([curve, unit.shape[1]])
    dims = min(dims, unit.shape[1])
    basis = np.linalg.qr(rng.standard_normal((unit.shape[1], dims)))[0]
    low = unit @ basis * np.sqrt(unit.shape[1])  # about standard normal for random directions
    cells = np.floor((low / 8 + 0.5) * (1 << bits) + rng.random(dims))
    return hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors written as floats or doubles, as doubles."""
    kind = "<f8" if len(column) and len(column[0].as_py()) == 8 * dims else "<f4"
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dims, vec binary, cid digest): vectors that are neither null, empty nor zero and hold finite numbers only.

    vec holds floats where the column does, else doubles.
    """
    kind = vectors.schema[vec_col].dataType.elementType.typeName()
    short = kind == "float"
    column = F.col(vec_col) if short else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), column.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = rows.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<f4" if short else "<f8")
            size = np.diff(ends)
            vecs = [flat[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch({"vec_id": b.column(0), "dims": pa.array(size.astype(np.int32)), "vec": pa.array(vecs, pa.binary())})

    return fine.mapInArrow(tidy(run), "vec_id long, dims int, vec binary").withColumn("cid", F.unhex(F.md5("vec")))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with those of b, in double precision: the same for a pair wherever it is met."""
    norms = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    return np.einsum("ij,ij->i", a, b) / norms


def _best(queries: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows that may be among the k best (rounding allowed for), and their exact cosines."""
    unit = rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    rough = queries @ unit.T / np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
    k = min(k, rows.shape[0])
    edge = -np.partition(-rough, k - 1, axis=1)[:, k - 1] - 1e-9
    out = []
    for i, row in enumerate(rough):
        at = np.flatnonzero(row >= edge[i])
        out.append((at, _pairs(np.broadcast_to(queries[i], (len(at), queries.shape[1])), rows[at])))
    return out


def _top(frame: DataFrame, by: str, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
    return frame.withColumn("_r", best).where(F.col("_r") <= k).drop("_r")


def search(vectors: DataFrame, query_modulus: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row whose id is divisible by query_modulus.

    Rows of one id count once for each distinct vector, and each such vector is a query; an id is no answer to itself. Vectors of another
    length than the most common one take no part, like null, zero or non-finite ones. Fewer than k other ids give as many answers; without
    any vector, or any query, the result is empty. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialise(clean(vectors, id_col, vec_col))
    size = rows.groupBy("dims").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "dims").first()
    if size is None:
        return spark.createDataFrame([], schema)
    dims = size.dims
    rows = rows.where(F.col("dims") == dims).select("vec_id", "cid", "vec")
    # classes of equal vectors; ranks within a class are cut before the shuffle
    ids = rows.select("vec_id", "cid").distinct()
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    told = first.groupBy("cid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = rows.groupBy("cid").agg(F.min("vec").alias("vec"))
    classes = materialise(told.join(one, "cid"))
    queries = materialise(ids.where(F.col("vec_id") % query_modulus == 0))
    asked = materialise(queries.select("cid").distinct().join(classes.select("cid", "vec"), "cid"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), dims)
                unit = m / np.linalg.norm(m, axis=1)[:, None]
                for c in range(CURVES):
                    yield pa.record_batch({"curve": pa.array(np.full(len(m), c, np.int32)), "key": pa.array(curve_keys(unit, c)), "cid": b.column(1)})

    placed = classes.select("vec", "cid").mapInArrow(tidy(place), "curve int, key long, cid binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialise(placed.repartitionByRange(parts, "curve", "key", "cid").sortWithinPartitions("curve", "key", "cid").withColumn("part", F.spark_partition_id()))
    # global ranks: the rank inside a partition and curve, plus what earlier partitions hold (a number a partition)
    counts = {(r.curve, r.part): r.n for r in ordered.groupBy("curve", "part").agg(F.count("*").alias("n")).collect()}
    before: dict[tuple[int, int], int] = {}
    total = [0] * CURVES
    for (curve, part), n in sorted(counts.items()):
        before[curve, part] = total[curve]
        total[curve] += n
    offsets = spark.createDataFrame([(c, p, n) for (c, p), n in before.items()], "curve int, part int, offset long")
    local = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "cid"))
    ranked = ordered.withColumn("local", local - 1).join(F.broadcast(offsets), ["curve", "part"])  # a row a curve and partition
    ranked = materialise(ranked.select("curve", (F.col("local") + F.col("offset")).alias("rank"), "cid"))
    discard(ordered)
    plan = fitted(queries, classes, ranked, dims, k, total[0], target)
    if plan is None:
        return spark.createDataFrame([], schema)
    curves, window = plan

    def meet(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int, float]] = []
        if len(ask) and len(have):
            m, own = _matrix(have.column("vec").combine_chunks(), dims), ask.column("cid").to_pylist()
            members, vecs = have.column("ids").to_pylist(), _matrix(ask.column("vec").combine_chunks(), dims)
            for low in range(0, len(vecs), 256):
                for i, (at, scores) in enumerate(_best(vecs[low : low + 256], m, k + 1), low):
                    found = sorted((-s, j) for x, s in zip(at.tolist(), scores.tolist(), strict=True) for j in members[x])
                    out += [(own[i], j, -s) for s, j in found[: k + 1]]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"cid": pa.array(cols[0], pa.binary()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = None
    for curve in range(curves):  # one after the other, so that the vectors are on disk for one curve at a time
        line = ranked.where(F.col("curve") == curve).select("rank", "cid")
        low, high = F.greatest(F.col("rank") - window, F.lit(0)), F.least(F.col("rank") + window, F.lit(total[0] - 1))
        touched = F.explode(F.sequence((low / BLOCK).cast("long"), (high / BLOCK).cast("long"))).alias("block")
        wanted = line.join(asked.select("cid"), "cid", "left_semi").select("cid", touched)
        load = materialise(wanted.groupBy("block").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")))
        ask = wanted.join(load, "block").withColumn("slice", F.pmod(F.xxhash64("cid"), F.col("slices")).cast("int")).join(asked, "cid")
        have = line.join(classes, "cid").withColumn("block", (F.col("rank") / BLOCK).cast("long")).join(load, "block")
        have = have.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        sides = (x.groupBy("block", "slice") for x in (ask.select("block", "slice", "cid", "vec"), have.select("block", "slice", "vec", "ids")))
        near = next(sides).cogroup(next(sides)).applyInArrow(meet, "cid binary, vec_id long, score double")
        near = materialise(_top(near, "cid", k + 1))
        found = near if found is None else found.unionByName(near)
        discard(load)
    best = _top(found.groupBy("cid", "vec_id").agg(F.max("score").alias("score")), "cid", k + 1)
    lists = best.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    # very many queries may have one vector: its list is joined in salted copies
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = queries.select(F.col("vec_id").alias("query_id"), "cid", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(lists, ["cid", "salt"])
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    flat = met.select("query_id", F.posexplode(mine).alias("at", "x"))
    if queries.agg(F.count_distinct("vec_id") == F.count("*")).first()[0]:
        return flat.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
    # an id with several vectors: the best answers of any of them
    flat = flat.groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg((-F.min("x.s")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(queries: DataFrame, classes: DataFrame, ranked: DataFrame, dims: int, k: int, n: int, target: float) -> tuple[int, int] | None:
    """(curves, half-width in ranks) with which the pilot's neighbours, found exactly, would be seen on some curve at least cost; None without a query."""
    pilot = queries.groupBy("cid").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT)
    pilot = sorted(pilot.join(classes.select("cid", "vec"), "cid").collect(), key=lambda r: r.vec_id)
    if not pilot:
        return None
    q = _matrix(pa.array([bytes(r.vec) for r in pilot], pa.binary()), dims)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, bytes]]] = [[] for _ in range(len(q))]
        for b in batches:
            for low in range(0, b.num_rows, BLOCK):
                some = b.slice(low, BLOCK)
                names = some.column(1).to_pylist()
                for i, (at, scores) in enumerate(_best(q, _matrix(some.column(0), dims), k + 1)):
                    best[i] = sorted(best[i] + [(-s, names[x]) for x, s in zip(at.tolist(), scores.tolist(), strict=True)])[: k + 1]
        flat = [(i, -s, c) for i, some in enumerate(best) for s, c in some]
        cols = list(zip(*flat, strict=True)) or [(), (), ()]
        yield pa.record_batch({"q": pa.array(cols[0], pa.int32()), "score": pa.array(cols[1], pa.float64()), "cid": pa.array(cols[2], pa.binary())})

    near = classes.select("vec", "cid").mapInArrow(tidy(brute), "q int, score double, cid binary")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k + 1).select("q", "cid").collect()
    wanted = F.broadcast(queries.sparkSession.createDataFrame([(bytes(x),) for x in {bytes(r.cid) for r in [*near, *pilot]}], "cid binary"))  # at most PILOT * (k + 2) rows
    places: dict[bytes, dict[int, int]] = {}
    for r in ranked.join(wanted, "cid", "left_semi").collect():
        places.setdefault(bytes(r.cid), {})[r.curve] = r.rank
    pairs = [(places[bytes(pilot[r.q].cid)], places[bytes(r.cid)]) for r in near if bytes(r.cid) != bytes(pilot[r.q].cid)]
    options = []
    for curves in range(1, CURVES + 1):
        gaps = [min(abs(a[c] - b[c]) for c in range(curves)) for a, b in pairs]
        window = max(k, int(np.quantile(gaps, target, method="higher")) if gaps else 0)
        options.append((curves * min(n, 2 * window + BLOCK), curves, window))
    return min(options)[1:]
