"""Which inputs drive a score: rescoring with one input made neutral."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.joins import duplicate_keys
from attendra.operators.scoring import SCORE, Neutrals, RowScorer, Scorer, rederive


def contributions(
    df: DataFrame,
    scorer: Scorer,
    key: str | Sequence[str] = "student_key",
    neutrals: Neutrals = config.NEUTRAL_VALUES,
    min_delta: float = config.MIN_CONTRIBUTION,
    cap: int = config.MAX_CONTRIBUTIONS,
) -> DataFrame:
    """Rows (key, rank, factor, delta, direction), strongest factor first.

    ``delta`` is the score minus the score with the factor's input at its
    neutral value. ``key`` names the columns that tell rows apart, such as student
    and year. Give flagged rows only: the work is a multiple of theirs.
    """
    keys = [key] if isinstance(key, str) else list(key)
    base = df if SCORE in df.columns else scorer.score(df)
    local = isinstance(scorer, RowScorer)
    effects = _within_rows if local else _by_rescoring
    found = effects(base, scorer, keys, neutrals)
    kept = F.filter("effects", lambda e: F.abs(e["delta"]) > min_delta)
    strongest = F.slice(F.array_sort(kept), 1, cap)
    delta = F.col("effect.delta")
    return found.select(*keys, F.posexplode(strongest).alias("at", "effect")).select(
        *keys,
        (F.col("at") + 1).alias("rank"),
        F.col("effect.factor").alias("factor"),
        F.round(delta, 4).alias("delta"),
        F.when(delta > 0, "risk").otherwise("protective").alias("direction"),
    )


def _effect(factor: Column, delta: Column) -> Column:
    """Sorts by strength, then by name."""
    return F.struct((-F.abs(delta)).alias("weight"), factor.alias("factor"), delta.alias("delta"))


def _within_rows(base: DataFrame, scorer: RowScorer, keys: list[str], neutrals: Neutrals) -> DataFrame:
    """All changes of a row are scored inside that row: no shuffle at all."""
    scored = base.select(*keys, SCORE, scorer.counterfactuals(neutrals).alias("changed"))
    effects = F.array(
        *(_effect(F.lit(f), F.col(SCORE) - F.col("changed")[i]) for i, f in enumerate(neutrals))
    )
    return scored.select(*keys, effects.alias("effects"))


def _by_rescoring(base: DataFrame, scorer: Scorer, keys: list[str], neutrals: Neutrals) -> DataFrame:
    """For any other scorer: one row per change, scored in one pass and regrouped.

    A key that names several rows raises ``ValueError``: their effects would mix in one list.
    """
    if not duplicate_keys(base, keys).isEmpty():
        raise ValueError(f"{', '.join(keys)} does not tell the rows apart")
    cases = F.explode(F.array(*(F.lit(f) for f in neutrals))).alias("factor")
    rows = base.withColumnRenamed(SCORE, "base_score").select("*", cases)
    types = dict(base.dtypes)
    inputs: dict[str, Column] = {}
    for factor, (name, neutral) in neutrals.items():
        other = inputs.get(name, F.col(name))
        changed = F.lit(neutral).cast(types[name])
        inputs[name] = F.when(F.col("factor") == factor, changed).otherwise(other)
    rescored = scorer.score(rederive(rows.withColumns(inputs)))
    effect = _effect(F.col("factor"), F.col("base_score") - F.col(SCORE))
    # A list holds one element per factor, as keys are unique.
    return rescored.groupBy(*keys).agg(F.collect_list(effect).alias("effects"))
