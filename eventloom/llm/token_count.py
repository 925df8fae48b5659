"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

Texts are cut at white space into pre-tokens, each with a word mark in front. The distinct pre-tokens of a batch of rows are put
in a trie; level by level, each node gets the best forward score over the pieces that end there, so what pre-tokens share
is computed once, and terminal nodes hold the counts. A text's count is the sum over its pre-tokens.

Of equal scores the segmentation with fewer pieces counts. A character of no piece costs as many tokens as it has UTF-8
bytes, at a score below that of any piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, tidy
from .packing import worker_cache

MARK, CACHE_WORDS, UNKNOWN_PENALTY = "▁", 500_000, 10.0


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, without control, unknown and byte pieces.

    Scores that are merge ranks (whole numbers from 0 down) are turned into log-probabilities by Zipf's law.
    """
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=model_path)
    found = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    if all(s <= 0 and s == int(s) for _, s in found):
        norm = math.log(sum(1 / (2 - s) for _, s in found))
        found = [(p, -math.log(2 - s) - norm) for p, s in found]
    return found


class Vocabulary:
    """Pieces as a trie of its own: arrays of transitions sorted by (state, character), and the score at each state."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        next_of: dict[tuple[int, int], int] = {}
        score: list[float] = [-math.inf]
        for piece, s in pieces:
            at = 0
            for ch in map(ord, piece):
                to = next_of.get((at, ch))
                if to is None:
                    to = next_of[at, ch] = len(score)
                    score.append(-math.inf)
                at = to
            score[at] = max(score[at], s)
        order = sorted(next_of)
        self.keys = np.array([a << 21 | c for a, c in order], np.int64)
        self.to = np.array([next_of[k] for k in order], np.int64)
        self.score = np.array(score)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = state << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, self.to[at], -1) if len(self.keys) else np.full(len(state), -1)


def count_tokens(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Number of pieces of each pre-token (given with its mark)."""
    if not words:
        return np.zeros(0, np.int64)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    lengths = np.array([len(words[k]) for k in order])
    points = [np.frombuffer(words[k].encode("utf-32-le", "surrogatepass"), np.uint32) for k in order]
    flat, begin = np.concatenate(points).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)))[:-1]
    counts = np.zeros(len(words), np.int64)
    node = np.zeros(len(words), np.int64)  # each word's node at the current level
    best, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
    # pieces that may still grow: the node they have reached, where they began (level, node) and their state
    open_node, open_level, open_from, open_state = (np.zeros(0, np.int64) for _ in range(4))
    freed = 0
    for level in range(int(lengths[-1])):
        first = int(np.searchsorted(lengths, level, "right"))  # shorter words are done
        char = flat[begin[first:] + level]
        key, inverse = np.unique(node[first:] << 21 | char, return_inverse=True)
        parent, letter = key >> 21, key & 0x1FFFFF
        n = len(key)
        # every node extends the pieces open at its parent, and begins one
        per = np.bincount(open_node, minlength=len(best[level]))
        open_at = np.concatenate(([0], np.cumsum(per)))
        by_node = np.argsort(open_node, kind="stable")
        reps = per[parent]
        child = np.repeat(np.arange(n), reps)
        pick = by_node[np.arange(len(child)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(open_at[parent], reps)]
        child = np.concatenate((child, np.arange(n)))
        from_level = np.concatenate((open_level[pick], np.full(n, level)))
        from_node = np.concatenate((open_from[pick], parent))
        state = vocabulary.step(np.concatenate((open_state[pick], np.zeros(n, np.int64))), letter[child])
        alive = state >= 0
        child, from_level, from_node, state = child[alive], from_level[alive], from_node[alive], state[alive]
        # candidates: one character of no piece, or a piece that ends here
        width = np.where(letter < 0x80, 1, np.where(letter < 0x800, 2, np.where(letter < 0x10000, 3, 4)))
        ends = np.flatnonzero(vocabulary.score[state] > -math.inf)
        prior, told = np.zeros(len(ends)), np.zeros(len(ends), np.int64)
        for back in np.unique(from_level[ends]).tolist():
            own = from_level[ends] == back
            prior[own], told[own] = best[back][from_node[ends][own]], tokens[back][from_node[ends][own]]
        who = np.concatenate((np.arange(n), child[ends]))
        score = np.concatenate((best[level][parent] + vocabulary.unknown, prior + vocabulary.score[state[ends]]))
        number = np.concatenate((tokens[level][parent] + width, told + 1))
        rank = np.lexsort((number, -score, who))
        top = rank[np.concatenate(([True], np.diff(who[rank]) > 0))]
        best.append(score[top]), tokens.append(number[top])
        open_node, open_level, open_from, open_state = child, from_level, from_node, state
        node[first:] = inverse
        done = slice(first, int(np.searchsorted(lengths, level + 1, "right")))
        counts[done] = tokens[-1][node[done]]
        oldest = int(from_level.min()) if len(from_level) else level + 1
        while freed < oldest:  # levels that no open piece began at are not needed any more
            best[freed] = tokens[freed] = None
            freed += 1
    out = np.zeros(len(words), np.int64)
    out[order] = counts
    return out


def token_counts(docs: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """Columns keep of docs with n_words (pre-tokens), n_tokens and n_distinct (distinct pre-tokens); null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_cache("unigrams", lambda: Vocabulary(pieces_of(model_path)))
        known: dict[str, int] = {}
        for batch in slices(batches, 1024):
            rows = [t.split() for t in texts(batch, "_text")]
            if len(known) > CACHE_WORDS:
                known.clear()
            distinct = [set(r) for r in rows]
            new = sorted({w for some in distinct for w in some if w not in known})
            known.update(zip(new, count_tokens([MARK + w for w in new], vocabulary).tolist(), strict=True))
            out = {c: batch.column(i) for i, c in enumerate(keep)}
            out["n_words"] = pa.array([len(r) for r in rows], pa.int64())
            out["n_tokens"] = pa.array([sum(map(known.__getitem__, r)) for r in rows], pa.int64())
            out["n_distinct"] = pa.array([len(s) for s in distinct], pa.int64())
            yield pa.record_batch(out)

    from pyspark.sql import types as T

    rows = docs.select(*keep, F.col("text").alias("_text"))
    extra = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_distinct")]
    return rows.mapInArrow(tidy(run), T.StructType([*[f for f in rows.schema.fields if f.name != "_text"], *extra]))
