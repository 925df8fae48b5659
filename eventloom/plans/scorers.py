"""Where models plug in: pair scorers, graph refiners, forecasters and extractors. Each maps a DataFrame to a DataFrame.

Defaults are deterministic and need no model. A model runs by mapInPandas (pairs) or applyInPandas (graphs) behind the same interface.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import DEFAULT, Lexicon
from ..operators import retrieval


class PairScorer(Protocol):
    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Candidate pairs with relation_type and score set."""


class GraphRefiner(Protocol):
    def __call__(self, candidates: DataFrame) -> DataFrame:
        """(sample_id, ord, keep_probability, relation_type, strength)."""


class Forecaster(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame:
        """(sample_id, response)."""


class Extractor(Protocol):
    def __call__(self, retrieved: DataFrame) -> DataFrame:
        """Retrieved documents to events, as retrieval.document_events gives them."""


def heuristic_scorer(lexicon: Lexicon = DEFAULT) -> PairScorer:
    return lambda pairs: pairs.withColumn("relation_type", X.relation(F.col("s_text"), F.col("t_text"), lexicon)).withColumn("score", F.round("candidate_score", 4))


def batch_scorer(score: Callable, schema: str) -> PairScorer:
    """A pandas function over Arrow batches of pairs."""
    return lambda pairs: pairs.mapInPandas(score, schema)


def with_prior(candidates: DataFrame) -> DataFrame:
    """Candidates with what prior_refiner says of them, in the row: no join by their number is needed."""
    p = F.least(F.greatest("score", F.lit(1e-4)), F.lit(1 - 1e-4))
    logit = 0.5 * F.ln(p / (1 - p)) + F.when(F.col("source_kind") == "coarse", 0.35).otherwise(0.0) - F.when(F.col("source_kind") == "completion", 0.25).otherwise(0.0)
    return candidates.withColumn("keep_probability", 1 / (1 + F.exp(-logit))).withColumnRenamed("score", "strength")


def prior_refiner() -> GraphRefiner:
    """A graph refiner without a network: the prior of its head alone, type and strength as they came in."""
    return lambda candidates: with_prior(candidates).select("sample_id", "ord", "keep_probability", "relation_type", "strength")


def replay(responses: DataFrame) -> Forecaster:
    """Recorded answers (sample_id, response) instead of a model."""
    return lambda prompts: prompts.join(responses, "sample_id", "left")


EXTRACTORS: dict[str, Extractor] = {"rule": retrieval.document_events}


def extractor(name: str) -> Extractor:
    if name not in EXTRACTORS:
        raise KeyError(f"unknown extractor {name!r}; known: {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name]
