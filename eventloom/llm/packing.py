"""Packing of documents into token windows by best-fit decreasing.

Each scan partition is packed by itself, without a shuffle: documents longer than a window are cut into full windows,
the rests are sorted by length, longest first, and a segment tree indexed by remaining capacity finds the tightest
open window. Groups of about 16 million ids (4 million, if the ids are returned) are packed at a time, which bounds
memory at any partition size.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, tidy

WINDOW, END_ID, GROUP_IDS, CACHE_WORDS = 2048, 1, 1 << 24, 700_000
MARKS = b".,;:!?*$%&#"


def _plain(core: bytes) -> bool:
    """Letters only, with nothing whose normal form or lower case depends on its neighbours."""
    text = core.decode("utf-8", "replace")
    return text.isalpha() and "Σ" not in text and text.lower().isalpha() and unicodedata.is_normalized("NFC", text)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over 0..capacity, and the windows at each leaf."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _bump(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, room: int) -> None:
        if room:
            self.at[room].append(window)
            self._bump(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its room) with the least room that is enough, or None."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node & 1 or not count[node + 1]:  # up to the first subtree on the right that holds a window
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node + (not count[2 * node])
        room = node - self.size
        self._bump(room, -1)
        return self.at[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) of each piece; windows are numbered from 0 as they are opened. Ties keep the order given."""
    places, opened, tree = [(0, 0)] * len(lengths), 0, OpenWindows(capacity)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[k])
        if found is None:
            found, opened = (opened, capacity), opened + 1
        window, room = found
        places[k] = (window, capacity - room)
        tree.put(window, room - lengths[k])
    return places


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """Something kept by a Python worker between tasks; what another operator kept there goes."""
    kept = sys.modules.setdefault("_eventloom_worker", types.ModuleType("_eventloom_worker"))
    if getattr(kept, "name", None) != name:
        kept.name = kept.value = None
        kept.value = make()
        kept.name = name
    return kept.value


class Encoder:
    """Ids of whole texts, word by word.

    The tokenizer drops white space, and no token crosses ASCII white space, so the ids of a text are those of its words,
    one after another. Words are cached; a word of letters with marks after it is looked up by its letters in lower
    case and by its marks. The caches start anew when full, so memory is bounded and results don't depend on them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}

    def _learn(self, words: list[bytes]) -> None:
        if len(self.parts) > CACHE_WORDS:
            self.parts = {b"": b""}
        parts, split = self.parts, []
        for w in words:
            core = w.rstrip(MARKS)
            if core.isalpha() or core and _plain(core):
                split.append((w, core.lower() if core.isascii() else core.decode().lower().encode(), w[len(core) :]))
            else:
                split.append((w, w, b""))
        new = list({p for _, a, b in split for p in (a, b) if p not in parts})
        for part, got in zip(new, self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in new], add_special_tokens=False), strict=True):
            parts[part] = array("I", got.ids).tobytes()
        for w, a, b in split:
            self.words[w] = parts[a] + parts[b]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for text in texts:
            words = text.split()
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            if missing := [w for w in set(words) if w not in self.words]:
                self._learn(missing)
            yield b"".join(map(self.words.__getitem__, words))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) → a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null text is empty: such a document is its end id alone. Null doc_ids and repeated rows are packed like any other
    row. A sequence is the pieces with one sequence_id, without gaps from offset 0; it is padded to the window.
    """
    end = np.array([end_id], "<u4").tobytes()
    group, chunk = (GROUP_IDS // 4, 1024) if with_ids else (GROUP_IDS, 8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_cache(f"encoder_{zlib.crc32(tokenizer_path.encode())}", lambda: Encoder(tokenizer_path))
        context = TaskContext.get()
        first_id = (context.partitionId() if context else 0) << 33
        rows: list[tuple] = []
        held = sequences = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, sequences
            full = [k for k, r in enumerate(rows) if r[2] == window]
            rest = [k for k, r in enumerate(rows) if r[2] < window]
            place = dict(zip(full, ((k, 0) for k in range(len(full))), strict=True))
            for k, (at, offset) in zip(rest, best_fit_decreasing([rows[k][2] for k in rest], window), strict=True):
                place[k] = (at + len(full), offset)
            for low in range(0, len(rows), chunk):
                part = rows[low : low + chunk]
                cols = list(zip(*part, strict=True))
                out = {n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), cols, strict=False)}
                out["sequence_id"] = pa.array([first_id + sequences + place[low + k][0] for k in range(len(part))], pa.int64())
                out["offset"] = pa.array([place[low + k][1] for k in range(len(part))], pa.int64())
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(cols[2]))).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cols[5]), "<i4")))
                yield pa.record_batch(out)
            sequences += 1 + max((w for w, _ in place.values()), default=-1)
            rows, held = [], 0

        for batch in slices(batches, 256):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(raw(batch, "text")), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)
                    rows.append((*row, piece) if with_ids else row)
                held += n
            if held >= group:
                yield from flush()
        if rows:
            yield from flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema + ", ids array<int>" * with_ids)
