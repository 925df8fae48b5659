"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is bound as the product of its
letters' vectors, rotated by two, one and no places; a text, or all training text of a language, is the bundle (the
sum) of its trigrams. A text is in the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts, tidy
from .packing import worker_cache

DIMS, CACHED_TRIGRAMS, SPACE = 1024, 40_000, 32
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)])


def trigrams(text: str, letter: np.ndarray, *more: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the trigrams of lower-cased letters; anything else is one space, also at both ends. None reaches from one text to the next."""
    joined = "\0".join([f" {t.lower()} ".replace("\0", " ") for t in (text, *more)])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    points = np.where(letter[points] | (points == 0), points, SPACE).astype(np.int64)
    points = points[np.concatenate(([True], (points[1:] != SPACE) | (points[:-1] != SPACE)))]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    if more:
        codes = codes[(points[:-2] > 0) & (points[1:-1] > 0) & (points[2:] > 0)]
    return np.unique(codes, return_counts=True)


class Trigrams:
    """Vectors of trigrams; the first ones met are kept, up to a fixed number."""

    def __init__(self, dims: int) -> None:
        self.dims, self.letters = dims, {}
        self.index: dict[int, int] = {}
        self.kept = np.zeros((0, dims), np.int8)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[point] = np.random.default_rng(point).choice(np.array([-1, 1], np.int8), self.dims)
        return self.letters[point]

    def _bind(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dims, np.float32 if counts.sum() < 1 << 24 else np.float64)
        rows, loose = [], []
        for k, code in enumerate(codes.tolist()):
            at = self.index.get(code)
            if at is None and len(self.index) < CACHED_TRIGRAMS:
                at = self.index[code] = len(self.index)
                if at >= len(self.kept):
                    self.kept = np.concatenate((self.kept, np.zeros((max(1024, len(self.kept)), self.dims), np.int8)))
                self.kept[at] = self._bind(code)
            (loose if at is None else rows).append(k if at is None else (k, at))
        for low in range(0, len(rows), 4096):
            k, at = np.array(rows[low : low + 4096]).T
            total += counts[k].astype(total.dtype) @ self.kept[at].astype(total.dtype)
        for k in loose:
            total += counts[k] * self._bind(int(codes[k]))
        return total


def _tools(dims: int) -> tuple[np.ndarray, Trigrams]:
    return worker_cache(f"language_id_{dims}", lambda: (_letters(), Trigrams(dims)))


def train(labelled: DataFrame, dims: int = DIMS) -> dict[str, np.ndarray]:
    """labelled (text, lang), lang not null → prototypes. All rows count; sums are of integers, so their order doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, vectors = _tools(dims)
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, dict[int, int]] = {}

        def settle() -> None:
            for lang, seen in counts.items():
                codes = np.fromiter(seen.keys(), np.int64, len(seen))
                total = vectors.bundle(codes, np.fromiter(seen.values(), np.int64, len(seen)))
                sums[lang] = sums.get(lang, 0) + np.rint(total).astype(np.int64)
            counts.clear()

        for batch in slices(batches, 64):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(texts(batch, "text"), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, some in by_lang.items():
                seen = counts.setdefault(lang, {})
                codes, n = trigrams(some[0], letter, *some[1:])
                for code, k in zip(codes.tolist(), n.tolist(), strict=True):
                    seen[code] = seen.get(code, 0) + k
            if sum(map(len, counts.values())) > 200_000:
                settle()
        settle()
        for lang, total in sums.items():
            yield pa.record_batch({"lang": pa.array([lang]), "v": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = labelled.select("text", "lang").mapInArrow(tidy(run), "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dims numbers
        out.setdefault(r.lang, np.zeros(dims))[r.i] = r.x
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = DIMS, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and letters (trigrams counted) added, in place of columns of these names; the text stays behind on request.

    score is the cosine, cut at 0. A null text, or one without a letter, is "und" with score 0, as is every text when
    nothing was learned. Of equal cosines the first language by name wins.
    """
    names = list(prototypes)
    unit = np.array([p / max(np.linalg.norm(p), 1e-12) for p in prototypes.values()]).reshape(len(names), dims)
    rows = docs.drop("lang_pred", "score", "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, vectors = _tools(dims)
        for batch in slices(batches, 256):
            found, scores, sizes = [], [], []
            for text in texts(batch, "text"):
                codes, n = trigrams(text, letter)
                sizes.append(int(n.sum()))
                if not len(codes) or not names:
                    found.append(UNKNOWN), scores.append(0.0)
                    continue
                v = vectors.bundle(codes, n).astype(np.float64)
                cosines = unit @ v / max(np.linalg.norm(v), 1e-12)
                best = int(cosines.argmax())
                found.append(names[best]), scores.append(float(min(1.0, max(0.0, cosines[best]))))
            out = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if keep_text or c != "text"}
            yield pa.record_batch(out | {"lang_pred": pa.array(found, pa.string()), "score": pa.array(scores, pa.float64()), "letters": pa.array(sizes, pa.int64())})

    kept = [f for f in rows.schema.fields if keep_text or f.name != "text"]
    return rows.mapInArrow(tidy(run), T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("letters", T.LongType())]))


def rejected(dims: int = DIMS, letters: int = 50):
    """Condition on predict()'s columns: no letter at all, or enough of them and still no nearer to any language than noise is."""
    return (F.col("lang_pred") == UNKNOWN) | ((F.col("letters") >= letters) & (F.col("score") < 4 / dims**0.5))
