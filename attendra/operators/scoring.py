"""Scorers: anything that adds ``risk_score`` (4 decimals) to feature rows.

``LogisticScorer`` is a column expression, ``SparkModelScorer`` a fitted Spark
ML pipeline and ``PandasScorer`` any model with a pandas interface, fed Arrow
batches of its input columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra import config
from attendra.functions.columns import flag

SCORE = "risk_score"
SCORE_DIGITS = 4


# Input -> (other input, cut): 1 where the other one lies below the cut. Such an
# input must follow when the other one changes.
DERIVED = {"was_chronic_last_year": ("attendance_rate_t_minus_1", config.CHRONIC_RATE)}

# Factor -> (input, neutral value).
Neutrals = Mapping[str, tuple[str, float]]


class Scorer(Protocol):
    def score(self, df: DataFrame) -> DataFrame:
        """Add ``risk_score``."""


@runtime_checkable
class RowScorer(Scorer, Protocol):
    """A scorer that can also rescore a row under changes, within that row."""

    def counterfactuals(self, neutrals: Neutrals) -> Column:
        """Array of the scores with each input in turn at its neutral value."""


def rederive(df: DataFrame) -> DataFrame:
    """Recompute the derived inputs from the row's current values."""
    return df.withColumns(
        {name: flag(F.col(source) < cut) for name, (source, cut) in DERIVED.items()}
    )


@dataclass(frozen=True)
class LogisticScorer:
    """Logistic model with fixed weights, evaluated inside the query plan."""

    weights: Mapping[str, float]
    intercept: float = 0.0

    def expression(self, replaced: Mapping[str, Column] | None = None) -> Column:
        """Score with some inputs replaced; derived inputs follow them."""
        replaced = replaced or {}

        def value(name: str) -> Column:
            if name in replaced:
                return replaced[name]
            source, cut = DERIVED.get(name, (None, None))
            return flag(value(source) < cut) if source in replaced else F.col(name)

        total = F.lit(float(self.intercept))
        for name, weight in self.weights.items():
            total = total + F.lit(float(weight)) * value(name)
        return F.round(1 / (1 + F.exp(-total)), SCORE_DIGITS)

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SCORE, self.expression())

    def counterfactuals(self, neutrals: Neutrals) -> Column:
        changes = neutrals.values()
        return F.array(*(self.expression({name: F.lit(neutral)}) for name, neutral in changes))


@dataclass(frozen=True)
class SparkModelScorer:
    """A fitted pipeline ending in a classifier with a probability column."""

    model: PipelineModel

    def score(self, df: DataFrame) -> DataFrame:
        chance = vector_to_array("probability")[1]
        scored = self.model.transform(df).withColumn(SCORE, F.round(chance, SCORE_DIGITS))
        return scored.select(*df.columns, SCORE)


@dataclass(frozen=True)
class PandasScorer:
    """A model living in Python.

    ``load`` runs once per task and returns a function from a frame of the
    ``inputs`` to probabilities. Only those columns leave the JVM.
    """

    load: Callable[[], Callable[[pd.DataFrame], Sequence[float]]]
    inputs: Sequence[str] = field(default=config.MODEL_INPUTS)

    def score(self, df: DataFrame) -> DataFrame:
        load = self.load

        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series(model(batch), dtype="float64")

        # Declared so, Spark does not copy the call into filters on the score.
        chance = predict.asNondeterministic()(F.struct(*self.inputs))
        return df.withColumn(SCORE, F.round(chance, SCORE_DIGITS))

    def counterfactuals(self, neutrals: Neutrals) -> Column:
        """Every row crosses to Python once; the changes are made there."""
        load, inputs, derived = self.load, list(self.inputs), dict(DERIVED)
        changes = list(neutrals.values())

        @F.pandas_udf("array<double>")
        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                scores = []
                for name, neutral in changes:
                    changed = batch.copy()
                    if name in inputs:
                        changed[name] = neutral
                    for follower, (source, cut) in derived.items():
                        if source == name and follower in inputs:
                            changed[follower] = int(neutral < cut)
                    scores.append(pd.Series(model(changed), dtype="float64"))
                yield pd.Series(pd.concat(scores, axis=1).to_numpy().tolist())

        chances = predict.asNondeterministic()(F.struct(*inputs))
        return F.transform(chances, lambda chance: F.round(chance, SCORE_DIGITS))
