"""Toxic passages by maximum-scoring segments.

A word's score is the log-odds of its document rate in toxic against other training documents, under a Dirichlet prior
whose centre is the rate of words that begin with the same five letters (whose own prior is the overall rate). Words
without significant evidence score a small negative constant. One linear scan (Ruzzo and Tompa, 1999) finds all maximal
scoring segments of a text. Segment scores follow an extreme-value law in texts of random words, so a segment of score S
in a text of n words is worth lambda * S - ln(K n) (Karlin and Altschul, 1990); a logistic curve over the best
segment's worth and their sum, fitted on training rows, gives the probability that the label is 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, raw, slices, tidy

TRAIN_ROWS, PREFIX, PRIOR, DRIFT, MIN_Z, THRESHOLD = 200_000, 5, 8.0, 0.35, 4.0, 0.3
MARKS = b".,;:!?*$%&#\"'()[]{}<>-_=+/\\|~`@^"


def normal(chunk: bytes) -> bytes:
    return chunk.strip(MARKS).decode("utf-8", "replace").lower().encode()


def stem(word: bytes) -> bytes:
    return word.decode()[:PREFIX].encode()


@dataclass
class Model:
    words: dict[bytes, float]
    stems: dict[bytes, float]
    scale: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (-2.0, 1.0, 0.0)

    def score(self, chunk: bytes) -> float:
        word = normal(chunk)
        got = self.words.get(word)
        return got if got is not None else self.stems.get(stem(word), -DRIFT)

    def probability(self, n_words: int, segments: list[tuple[int, int, float]]) -> float:
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(n_words, segments), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def features(self, n_words: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        worth = [max(0.0, self.scale * s - self.log_k - math.log(max(2, n_words))) for _, _, s in segments]
        return math.log1p(max(worth, default=0.0)), math.log1p(sum(worth))


def segments(scores: list[tuple[int, float]], n: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score) of a sequence of n scores, of which only those that differ from -DRIFT are given.

    The sequence is scanned from one given score to the next; the words between them only lower the running total.
    """
    out: list[tuple[int, int, float]] = []
    #: candidates: from, to, total before, total after, place of the nearest candidate with a lower total before (or -1)
    held: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for at, s in scores:
        total -= DRIFT * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        begin, before = at, total
        total += s
        j = len(held) - 1
        while j >= 0 and held[j][2] >= before:  # what is passed here lies behind the new candidate's link from now on
            j = held[j][4]
        while j >= 0 and held[j][3] < total:
            begin, _, before, _, link = held[j]
            del held[j:]
            j = link
        if j < 0:  # no later candidate can reach back: what is held is final
            out += [(x[0], x[1], x[3] - x[2]) for x in held]
            held.clear()
        held.append((begin, at + 1, before, total, j))
    return out + [(x[0], x[1], x[3] - x[2]) for x in held]


class _Scores(dict):
    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, chunk: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        self[chunk] = got = self.model.score(chunk)
        return got


def scan(text: bytes, scores: dict[bytes, float]) -> tuple[int, list[tuple[int, int, float]]]:
    words = text.split()
    each = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    told = np.flatnonzero(each != -DRIFT)
    return len(words), segments(list(zip(told.tolist(), each[told].tolist(), strict=True)), len(words))


def _counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, n): documents that hold the word, summed over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def settle() -> Iterator[pa.RecordBatch]:
            for toxic, c in enumerate(seen):
                words = list(c)
                yield pa.record_batch({"word": pa.array(words, pa.binary()), "toxic": pa.array([toxic] * len(words), pa.int32()), "n": pa.array(list(c.values()), pa.int64())})
                c.clear()

        for batch in slices(batches, 256):
            for text, toxic in zip(raw(batch, "text"), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update({normal(w) for w in set(text.split())})
            if sum(map(len, seen)) > 300_000:
                yield from settle()
        yield from settle()

    return rows.select("text", "toxic").mapInArrow(tidy(run), "word binary, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic): one row a labelled document, at most max_rows of them (by a hash of doc_id)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if known.limit(max_rows + 1).count() > max_rows:  # labels without a document don't use the bound up
        known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows pairs of numbers: sent to the documents, whose texts then need no shuffle
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"))
    n = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if n.n > n.ids:  # rows that repeat an id: the first text counts
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        rows = materialise(rows.withColumn("_n", first).where("_n = 1").drop("_n"))
    return rows


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): learns from the labelled rows given, at most max_rows of them (by a hash of doc_id).

    The bound is on what the classifier is fitted to: words come to the driver, and one row a document for the calibration.
    K and the curve are fitted on a fourth of the rows, with word scores learned from the others; then the words are learned
    from all. Where that fourth has one class only, all rows calibrate. A document's label is its largest; rows that repeat a
    doc_id count once, with the first text; null texts are empty.
    """
    rows = _sample(docs, labels, max_rows)
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model({}, {}, weights=(math.log((n1 + 0.5) / (n0 + 0.5)), 0.0, 0.0))
    aside = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(4)) == 0
    held, rest = rows.where(aside), rows.where(~aside)
    classes = [{r.toxic for r in part.select("toxic").distinct().collect()} for part in (held, rest)]
    model = _words(rows)
    if all(len(c) == 2 for c in classes):
        trial = _words(rest)
        _calibrate(trial, held)
        model.scale, model.log_k, model.weights = trial.scale, trial.log_k, trial.weights
    else:
        _calibrate(model, rows)
    return model


def _words(rows: DataFrame) -> Model:
    """Scores of words and stems, and lambda, from (text, toxic) rows of both classes."""
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size[1], size[0]
    base = n1 / (n0 + n1)
    pivot = _counts(rows).groupBy("word").agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"y{k}") for k in (0, 1)])
    pivot = materialise(pivot.withColumn("stem", F.substring(F.col("word").cast("string"), 1, PREFIX)))
    by_stem = pivot.groupBy("stem").agg(F.sum("y1").alias("s1"), F.sum("y0").alias("s0"))

    def odds(y1, y0, rate):
        """Log-odds of the posterior rate against the base rate, and its z."""
        a1, a0 = y1 + PRIOR * rate, y0 + PRIOR * (1 - rate)
        return F.log(a1 / a0) - math.log(base / (1 - base)), F.sqrt(1 / a1 + 1 / a0)

    def rate(y1, y0):
        return (y1 + PRIOR * base) / (y1 + y0 + PRIOR)

    stem_odds, stem_error = odds(F.col("s1"), F.col("s0"), F.lit(base))
    word_odds, word_error = odds(F.col("y1"), F.col("y0"), rate(F.col("s1"), F.col("s0")))
    # a stem speaks for words not seen in training only if nearly all its words do
    stems = by_stem.where(stem_odds > MIN_Z * stem_error).where(stem_odds > 2).where("s1 >= 3").select("stem", stem_odds.alias("odds")).collect()
    words = pivot.join(by_stem, "stem").where(word_odds > MIN_Z * word_error).where(word_odds > 1).where("y1 >= 2").select("word", word_odds.alias("odds"), "y0").collect()
    # words met in training without evidence don't inherit from their stem
    plain = pivot.join(by_stem.where(stem_odds > MIN_Z * stem_error).where(stem_odds > 2).where("s1 >= 3"), "stem").where(word_odds <= MIN_Z * word_error).where("y0 > y1").select("word").collect()
    model = Model({bytes(r.word): -DRIFT for r in plain} | {bytes(r.word): r.odds for r in words}, {r.stem.encode(): r.odds for r in stems})
    # background: how often other documents hold each positive word, with one pseudo-document
    spread = [((r.y0 + 1) / (n0 + 1) / 100, r.odds) for r in words]
    model.scale = _scale(spread)
    return model


def _scale(spread: list[tuple[float, float]]) -> float:
    """lambda: the positive root of E[exp(lambda * score)] = 1 over background words."""
    rest = max(0.0, 1 - sum(p for p, _ in spread))

    def excess(x: float) -> float:
        return sum(p * math.exp(min(50.0, x * s)) for p, s in spread) + rest * math.exp(-DRIFT * x) - 1

    low, high = 1e-3, 5.0
    if not spread or excess(high) < 0 or excess(low) > 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _calibrate(model: Model, rows: DataFrame) -> None:
    """K from the mean of the best scores of other documents (a Gumbel law), then the logistic curve, by Newton steps with a ridge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        for batch in slices(batches, 256):
            found = [scan(t, scores) for t in raw(batch, "text")]
            yield pa.record_batch({
                "n": pa.array([n for n, _ in found], pa.int64()), "s": pa.array([[x[2] for x in f] for _, f in found], pa.list_(pa.float64())), "toxic": batch.column(1),
            })

    got = rows.select("text", "toxic").mapInArrow(tidy(run), "n long, s array<double>, toxic int").collect()  # at most max_rows
    other = [model.scale * max(r.s) - math.log(max(2, r.n)) for r in got if not r.toxic and r.s]
    share = len(other) / max(1, sum(not r.toxic for r in got))
    model.log_k = (sum(other) / len(other) - 0.5772 if other else 0.0) * share
    x = np.array([(1.0, *model.features(r.n, [(0, 0, s) for s in r.s])) for r in got])
    y = np.array([float(r.toxic) for r in got])
    order = np.lexsort((y, *x.T))  # sums don't depend on how the rows arrived
    x, y, w = x[order], y[order], np.zeros(3)
    ridge = np.diag([1e-6, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    model.weights = tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns keep of docs with score, predicted (1 if score >= threshold, else 0) and passages (from_word, to_word, score).

    Null and empty texts have no passage and get the score of such a text. Every row of docs gives one row.
    """
    from pyspark.sql import types as T

    rows = docs.select(*keep, F.col("text").alias("_text"))
    kind = pa.struct([("from_word", pa.int32()), ("to_word", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        for batch in slices(batches, 512):
            found = [scan(t, scores) for t in raw(batch, "_text")]
            p = [model.probability(n, f) for n, f in found]
            out = {c: batch.column(i) for i, c in enumerate(keep)}
            out |= {"score": pa.array(p, pa.float64()), "predicted": pa.array([int(v >= threshold) for v in p], pa.int32())}
            worth = [[{"from_word": a, "to_word": b, "score": s} for a, b, s in f if model.scale * s > model.log_k + math.log(max(2, n))] for n, f in found]
            yield pa.record_batch(out | {"passages": pa.array(worth, pa.list_(kind))})

    extra = T._parse_datatype_string("score double, predicted int, passages array<struct<from_word:int,to_word:int,score:double>>")
    return rows.mapInArrow(tidy(run), T.StructType([*[f for f in rows.schema.fields if f.name != "_text"], *extra.fields]))
