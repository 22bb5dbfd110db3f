"""Scorers give candidates a chance of being relevant; the default is a logistic in lexical features."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """Adds the column `p` (null: not scored) to candidates that hold a query's and a chunk's text."""

    def score(self, candidates: DataFrame, query_text: str, chunk_text: str) -> DataFrame: ...


@dataclass(frozen=True)
class LexicalScorer:
    """p = 1 / (1 + exp(-(bias + by_score * score + by_overlap * share of query words in the chunk)))."""

    bias: float = -2.0
    by_score: float = 0.1
    by_overlap: float = 4.0

    def chance(self, score: Column, overlap: Column) -> Column:
        return 1 / (1 + F.exp(-(self.bias + self.by_score * score + self.by_overlap * overlap)))

    def score(self, candidates: DataFrame, query_text: str, chunk_text: str) -> DataFrame:
        asked = F.array_distinct(F.split(F.lower(query_text), " "))
        held = F.split(F.lower(chunk_text), " ")
        overlap = F.size(F.array_intersect(asked, held)) / F.size(asked)
        return candidates.withColumn("p", self.chance(F.col("score"), overlap))


def temperature_softmax(logits: Column, temperature: float) -> Column:
    """Chances of an array of logits at a temperature."""
    scaled = F.transform(logits, lambda z: F.exp((z - F.array_max(logits)) / temperature))
    return F.transform(scaled, lambda e: e / F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b))
