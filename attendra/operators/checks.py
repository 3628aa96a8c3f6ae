"""Counts taken while a frame is written, with rules that stop a run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attendra.sources.storage import materialize

Metrics = Mapping[str, Column]
Rule = Callable[[Mapping[str, object]], bool]


class DataCheckError(ValueError):
    """A rule found the data unfit; ``stage``, ``rule`` and ``metrics`` tell which and why."""

    def __init__(self, stage: str, rule: str, metrics: Mapping[str, object]):
        super().__init__(f"{stage}: {rule} does not hold for {dict(metrics)}")
        self.stage, self.rule, self.metrics = stage, rule, metrics



@dataclass
class Checks:
    """Stores frames like ``materialize`` and takes metrics of them as the rows pass.

    ``metrics`` maps a stage to aggregates by name (the row count ``n`` for other stages),
    ``rules`` a stage to predicates over its metrics. The aggregates ride on the write
    itself, so the rows are scanned once. A rule that does not hold, or raises on
    a null metric, stops the run with ``DataCheckError`` before anything is read on;
    the table is left for inspection. ``found`` keeps the metrics of every stage.
    """

    metrics: Mapping[str, Metrics] = field(default_factory=dict)
    rules: Mapping[str, Mapping[str, Rule]] = field(default_factory=dict)
    found: dict[str, dict[str, object]] = field(default_factory=dict)

    def __call__(self, df: DataFrame, stage: str) -> DataFrame:
        wanted = self.metrics.get(stage) or {"n": F.count(F.lit(1))}
        observation = Observation(stage)
        stored = materialize(df.observe(observation, *(c.alias(name) for name, c in wanted.items())), stage)
        taken = self.found[stage] = dict(observation.get)
        for rule, holds in self.rules.get(stage, {}).items():
            try:
                good = bool(holds(taken))
            except TypeError:  # a null metric, such as the minimum of no rows
                good = False
            if not good:
                raise DataCheckError(stage, rule, taken)
        return stored

    def report(self, spark: SparkSession) -> DataFrame:
        """Rows (stage, metric, value) of all metrics taken, values as text: a handful, whatever the data."""
        rows = [(s, m, None if v is None else str(v)) for s, taken in self.found.items() for m, v in taken.items()]
        return spark.createDataFrame(rows, "stage string, metric string, value string")
