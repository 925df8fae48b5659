"""Substring deduplication over a log-structured fingerprint index.

A window is 20 consecutive words. Its fingerprint is the smallest hash among the 8-word grams that it holds (ties: the
leftmost), so equal windows have equal fingerprints, and neighbouring windows mostly share one: about a seventh of the
positions is indexed, and still no repeated window is missed. The index is a list of immutable runs (h, doc_id, tag,
pos), each in files sorted by h; a fingerprint that very many rows share is spread over salted files. A batch of documents
makes one new run; it is merged by h with the runs of history, windows at fingerprints met more than once are verified against
the words of the batch and of the archive (by 128-bit digests of the words, joined by spaces), and the run joins the index. When
there are too many runs they are compacted into one. A manifest in the index's folder names the runs, so that a later session can
open the index and go on.

Batches must come in order of doc_id: a window counts as repeated if its words also start earlier, in a smaller doc_id
or earlier in the same one. Whole copies are settled first, by a digest of all words, so groups of copies of any size put one
member into the index. A row whose doc_id is null takes no part (nothing is removed from it, nothing is removed because of
it). Null text has no words. Rows that repeat a doc_id are judged alike; tag, the first 8 bytes of the digest of their
words, tells rows of one doc_id with other words apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialise, raw, shared_dir, tidy

RUN_SCHEMA, SEEN_SCHEMA = "h long, doc_id long, tag long, pos int", "sha binary, first_id long"
MANIFEST = "ord int, kind string, name string, value int"
RUN_SALTS, SPLITS = 64, (1 / 3, 2 / 3)
BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[bytes], gram: int) -> np.ndarray:
    """A 64-bit hash for each run of gram words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - gram + 1
    out, power = np.zeros(n, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(gram):
            out += h[i : i + n] * power
            power *= BASE
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(29)


def anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all grams, for each window the position of its fingerprint)."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = _grams(words, gram)
    inside = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
    at = np.concatenate([inside[i : i + 65536].argmin(axis=1) for i in range(0, len(inside), 65536)])
    return g, at + np.arange(len(at))


def _tag(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def prints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row a document: digest of its words and the fingerprints of its windows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, tags, hs, ps = [], [], [], [], []
        for text in raw(batch, "text"):
            words = text.split()
            digest = hashlib.sha256(b" ".join(words)).digest()
            g, at = anchors(words, window, gram)
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]
            n.append(len(words)), sha.append(digest), tags.append(_tag(digest))
            hs.append(g[at].view(np.int64)), ps.append(at)
        return pa.record_batch({
            "doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "sha": pa.array(sha, pa.binary()), "tag": pa.array(tags, pa.int64()),
            "h": _lists(hs, pa.int64()), "pos": _lists(ps, pa.int32()),
        })

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_words long, sha binary, tag long, h array<long>, pos array<int>")


def _files(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _sorted_run(rows: DataFrame) -> DataFrame:
    """Rows of a run, dealt by (h, salt) and sorted by h in each file."""
    salt = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(RUN_SALTS))
    return rows.select("h", "doc_id", "tag", "pos").repartition("h", salt).sortWithinPartitions("h")


class FingerprintIndex:
    """Incremental index. add(batch, archive) judges a batch against itself and all earlier ones, then appends its run.

    Tables of the index are named in its folder's manifest, which is written anew after each batch; tables that it does not name
    any more are deleted after that.
    """

    def __init__(self, spark: SparkSession, window: int = 20, gram: int = 8, max_runs: int = 4, path: str | None = None) -> None:
        self.spark, self.window, self.gram, self.max_runs = spark, window, gram, max_runs
        self.runs: list[str] = []
        self.seen: list[str] = []  # digests of whole texts, with the smallest doc_id
        self.read: list[str] = []  # digests that results of this session still read
        self.path, self.made, self.saved = path or shared_dir(spark), 0, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index in a folder, as its last manifest has it."""
        files, where = _files(spark, path)
        names = [x.getPath().getName() for x in files.listStatus(where)]
        numbers = {int(n.rpartition("-")[2]): n for n in names if re.fullmatch(r"[a-z]+-\d+", n)}
        done = [n for n in numbers.values() if n.startswith("manifest-") and files.exists(_files(spark, f"{path}/{n}/_SUCCESS")[1])]
        if not done:
            raise FileNotFoundError(f"no manifest in {path}")
        last = max(done, key=lambda n: int(n.rpartition("-")[2]))
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/{last}").orderBy("ord").collect()
        told = {r.name: r.value for r in rows if r.kind == "set"}
        out = cls(spark, told["window"], told["gram"], told["max_runs"], path)
        out.runs, out.seen = ([r.name for r in rows if r.kind == kind] for kind in ("run", "seen"))
        out.made, out.saved = max(numbers), int(last.rpartition("-")[2])
        return out

    def _save(self) -> None:
        told = [("set", "window", self.window), ("set", "gram", self.gram), ("set", "max_runs", self.max_runs)]
        told += [("run", n, 0) for n in self.runs] + [("seen", n, 0) for n in self.seen]
        rows = [(k, *x) for k, x in enumerate(told)]
        self._keep(self.spark.createDataFrame(rows, MANIFEST).coalesce(1), "manifest")
        self._drop([f"manifest-{self.saved}"] if self.saved else [])
        self.saved = self.made

    def _drop(self, names: list[str]) -> None:
        for name in names:
            files, where = _files(self.spark, f"{self.path}/{name}")
            files.delete(where, True)

    def _keep(self, df: DataFrame, kind: str) -> DataFrame:
        self.made += 1
        return materialise(df, f"{self.path}/{kind}-{self.made}")

    def _history(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _append(self, run: str, seen: str) -> None:
        old: list[str] = []
        self.runs.append(run)
        self.seen.append(seen)
        if len(self.runs) > self.max_runs:
            old = [*self.runs, *self.seen]
            self._keep(_sorted_run(self._history(self.runs, RUN_SCHEMA)), "run")
            self.runs = [f"run-{self.made}"]
            self._keep(self._history(self.seen, SEEN_SCHEMA).groupBy("sha").agg(F.min("first_id").alias("first_id")), "seen")
            self.seen = [f"seen-{self.made}"]
        self._save()
        self.read.append(seen)
        self._drop([n for n in old if n not in self.read])

    def add(self, batch: DataFrame, archive: DataFrame, append: bool = True) -> DataFrame:
        """batch, archive (doc_id, text); archive holds every document so far, the batch included.

        → (doc_id, tag, n_words, n_removed, kept_sha256, removed array<int>) a row of batch; removed holds the ends of
        the removed word ranges, [from, to) one after another.
        """
        window, gram = self.window, self.gram
        found = self._keep(prints(batch, window, gram), "prints")
        # 1. whole copies
        firsts = found.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first_id"))
        if self.seen:
            known = self._history(self.seen, SEEN_SCHEMA).groupBy("sha").agg(F.min("first_id").alias("old_id"))
            firsts = firsts.join(known, "sha", "left").select("sha", F.coalesce("old_id", "first_id").alias("first_id"))
        firsts = self._keep(firsts, "seen")
        seen = f"seen-{self.made}"
        # 2. the new run, merged by hash with the runs of history
        own = found.join(firsts.withColumnRenamed("first_id", "doc_id"), ["sha", "doc_id"], "left_semi")
        fresh = own.select("doc_id", "tag", F.explode(F.arrays_zip("h", "pos")).alias("a")).select(F.col("a.h").alias("h"), "doc_id", "tag", F.col("a.pos").alias("pos"))
        if append:
            fresh = self._keep(_sorted_run(fresh), "run")
            run = f"run-{self.made}"
        rows = fresh.withColumn("old", F.lit(False))
        if self.runs:
            rows = rows.unionByName(self._history(self.runs, RUN_SCHEMA).withColumn("old", F.lit(True)))
        # counts are aggregated before the shuffle, and the join may split a fingerprint that very many rows share
        shared = rows.groupBy("h").agg(F.count("*").alias("n"), F.bool_or(~F.col("old")).alias("new")).where("n > 1 and new")
        shared = self._keep(shared.select("h"), "shared")  # written, as Spark splits only joins that read two shuffles
        met = self._keep(rows.join(shared, "h", "left_semi").drop("h"), "met")
        # 3. the words of what was met
        places = met.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("pos"), F.first("old").alias("old"))
        words = self._keep(places.join(archive.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "words")
        # 4. windows at these fingerprints, by a digest of their words: all but the first are repeats
        hits = words.mapInArrow(tidy(self._windows()), "a long, b long, doc_id long, start int, tag long, old boolean")
        hits = self._keep(hits, "hits")
        first = hits.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1").drop("n")
        first = self._keep(first, "first")
        again = hits.where("not old").join(first, ["a", "b"]).where(F.struct("doc_id", "start") != F.col("first"))
        starts = again.groupBy("doc_id", "tag").agg(F.collect_set("start").alias("starts"))
        cut = self._keep(words.where("not old").join(starts, ["doc_id", "tag"]).select("doc_id", "tag", "text", "starts").mapInArrow(tidy(self._cut()), "doc_id long, tag long, n_removed long, kept_sha256 string, removed array<int>").distinct(), "cut")
        for done in (words, hits, met, shared, first):
            discard(done)
        # 5. every row of the batch
        copy = (F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window)
        none = F.array().cast("array<int>")
        slim = found.select("doc_id", "n_words", "sha", "tag")
        out = slim.join(firsts, "sha", "left").join(cut, ["doc_id", "tag"], "left").select(
            "doc_id", "tag", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
            F.when(copy, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.coalesce("removed", none)).alias("removed"),
        )
        if append:
            self._append(run, seen)
        return out

    def _windows(self):
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, text in enumerate(raw(batch, "text")):
                    row = {c: batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("doc_id", "tag", "pos", "old")}
                    words = text.split()
                    joined = b" ".join(words)
                    if _tag(hashlib.sha256(joined).digest()) != row["tag"]:
                        continue  # another row of this doc_id
                    g, at = anchors(words, window, gram)
                    wanted = np.zeros(len(g), bool)
                    wanted[row["pos"]] = True
                    starts = np.flatnonzero(wanted[at])
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    begin = np.concatenate(([0], ends[:-1] + 1))
                    spans = zip(begin[starts].tolist(), ends[starts + window - 1].tolist(), strict=True)
                    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[i:j]) for i, j in spans]), np.int64).reshape(-1, 2)
                    n = len(starts)
                    yield pa.record_batch({
                        "a": pa.array(digests[:, 0]), "b": pa.array(digests[:, 1]), "doc_id": pa.array(np.full(n, row["doc_id"], np.int64)),
                        "start": pa.array(starts.astype(np.int32)), "tag": pa.array(np.full(n, row["tag"], np.int64)), "old": pa.array(np.full(n, row["old"], bool)),
                    })

        return run

    def _cut(self):
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, sha, ranges, keep = [], [], [], []
                for text, tag, starts in zip(raw(batch, "text"), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    words = text.split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if mine := _tag(hashlib.sha256(b" ".join(words)).digest()) == tag:
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, np.array(starts) + window, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    keep.append(mine)
                    n.append(int(gone.sum()))
                    sha.append(hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])).hexdigest())
                    ranges.append(np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))))
                out = pa.record_batch({"doc_id": batch.column(0), "tag": batch.column(1), "n_removed": pa.array(n, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "removed": _lists(ranges, pa.int32())})
                yield out.filter(pa.array(keep, pa.bool_()))

        return run


def dedup(docs: DataFrame, window: int = 20, gram: int = 8, splits: tuple[float, ...] = SPLITS, max_runs: int = 1) -> DataFrame:
    """All of docs (doc_id, text), fed to a new index in batches by doc_id; see FingerprintIndex.add for the result.

    splits are the shares of the doc_ids that the batches but the last one reach. With the defaults the first two thirds make runs
    that are compacted, and the last third is merged with them.
    """
    spark = docs.sparkSession
    at = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), list(splits), 100)).first()[0] if splits else None
    bounds = sorted(set(at or []))
    index = FingerprintIndex(spark, window, gram, max_runs)
    out, low = None, None
    for high in [*bounds, None]:
        part = docs if low is None else docs.where((F.col("doc_id") > low) | F.col("doc_id").isNull())
        part = part if high is None else part.where(F.col("doc_id") <= high)
        archive = docs if high is None else docs.where(F.col("doc_id") <= high)
        one = index.add(part, archive, append=high is not None)
        out, low = one if out is None else out.unionByName(one), high
    return out


def strip(docs: DataFrame, window: int = 20, gram: int = 8, splits: tuple[float, ...] = SPLITS) -> DataFrame:
    """docs with the repeated passages cut out of text, and n_chars, if there, set anew; what is left keeps its white space.

    Documents that lose all their words go; others, those without words included, stay.
    """
    cuts = dedup(docs.select("doc_id", "text"), window, gram, splits).where("n_removed > 0 and doc_id is not null")
    cuts = cuts.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("tag", "removed"))).alias("_cuts"))
    rows = docs.join(cuts, "doc_id", "left").select(*docs.columns, "_cuts")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            cuts = batch.column(batch.schema.get_field_index("_cuts"))
            for k, text in enumerate(raw(batch, "text")):
                ranges = None
                if cuts[k].is_valid:
                    words = text.split()
                    ranges = dict(cuts[k].as_py()).get(_tag(hashlib.sha256(b" ".join(words)).digest()))
                if ranges:
                    spans = [m.span() for m in re.finditer(rb"[^ \t-\r]+", text)]
                    parts, at = [], 0
                    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                        parts.append(text[at : spans[a][0]])
                        at = spans[b][0] if b < len(spans) else len(text)
                    text = b"".join([*parts, text[at:]]).strip()
                keep.append(not ranges or bool(text))
                out.append(text.decode("utf-8", "replace"))
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
            changed = pa.array(out, pa.string())
            cols["text"] = pa.compute.if_else(cuts.is_valid(), changed, cols["text"].cast(pa.string()))
            if "n_chars" in cols:
                sizes = pa.array([len(t) for t in out], pa.int64()).cast(cols["n_chars"].type)
                cols["n_chars"] = pa.compute.if_else(cuts.is_valid(), sizes, cols["n_chars"])
            yield pa.record_batch(cols).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidy(run), docs.schema)
