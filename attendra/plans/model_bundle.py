"""A fitted model kept with everything needed to score with it later.

A bundle is a folder: the model (written by Spark ML, or a logistic model's weights),
the vocabularies its category inputs were coded with, and one settings row. The
settings are written last, so a folder without them is no bundle. Nothing is
pickled: any Spark session can read it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.encoding import encode
from attendra.operators.scoring import LogisticScorer, Scorer, SparkModelScorer
from attendra.plans.risk_report import risk_rows

FORMAT = 1
SETTINGS = (
    "format int, kind string, inputs array<string>, categories array<string>, threshold double, "
    "weights map<string,double>, intercept double, vocab_mark string, learned_until int"
)


@dataclass(frozen=True)
class Bundle:
    """A scorer, its inputs in the model's order, its threshold and its vocabularies.

    ``vocab`` has rows (feature, label, code) of ``categories``, the features that
    enter the model by code, and is None without such. ``learned_until`` is the last
    year whose labels the model has seen, if known.
    """

    scorer: Scorer
    inputs: tuple[str, ...]
    threshold: float
    vocab: DataFrame | None = None
    categories: tuple[str, ...] = ()
    learned_until: int | None = None

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with codes and ``risk_score``; missing inputs raise ``ValueError``."""
        coded = encode(rows, self.vocab, self.categories) if self.categories else rows
        missing = [c for c in self.inputs if c not in coded.columns]
        if missing:
            raise ValueError(f"rows lack the inputs {', '.join(missing)}")
        return self.scorer.score(coded)


def coded_categories(inputs: Sequence[str]) -> tuple[str, ...]:
    """Categories that ``inputs`` want by their code."""
    wanted = {c.removesuffix(config.INDEX_SUFFIX) for c in inputs if c.endswith(config.INDEX_SUFFIX)}
    return tuple(c for c in config.CATEGORY_FEATURES if c in wanted)


def bundle(
    scorer: Scorer,
    threshold: float,
    vocab: DataFrame | None = None,
    learned_until: int | None = None,
) -> Bundle:
    """What belongs together for scoring, from a scorer with known inputs."""
    inputs = model_inputs(scorer)
    categories = coded_categories(inputs)
    if categories and vocab is None:
        raise ValueError(f"the model takes codes of {', '.join(categories)} but no vocabulary is given")
    used = vocab.filter(F.col("feature").isin(*categories)).select("feature", "label", "code") if categories else None
    return Bundle(scorer, inputs, float(threshold), used, categories, learned_until)


def model_inputs(scorer: Scorer) -> tuple[str, ...]:
    if isinstance(scorer, LogisticScorer):
        return tuple(scorer.weights)
    if isinstance(scorer, SparkModelScorer):
        return tuple(scorer.model.stages[0].getInputCols())
    raise ValueError(f"{type(scorer).__name__} cannot be kept: only Spark ML pipelines and logistic models can")


def vocab_mark(vocab: DataFrame) -> str:
    """Number of rows and sum of their hashes: equal for equal vocabularies in any order."""
    row = F.xxhash64("feature", "label", "code").cast("decimal(38,0)")
    count, total = vocab.agg(F.count(F.lit(1)), F.sum(row)).first()
    return f"{count}:{total}"


def save_bundle(kept: Bundle, spark: SparkSession, path: str) -> None:
    """Write ``kept`` to a new folder; an existing bundle is never changed."""
    weights: Mapping[str, float] | None = None
    intercept = None
    if isinstance(kept.scorer, LogisticScorer):
        kind, intercept = "logistic", float(kept.scorer.intercept)
        weights = {name: float(weight) for name, weight in kept.scorer.weights.items()}
    else:
        kind = "spark"
        kept.scorer.model.write().save(f"{path}/model")
    mark = None
    if kept.vocab is not None:
        kept.vocab.write.parquet(f"{path}/vocab")
        mark = vocab_mark(spark.read.parquet(f"{path}/vocab"))
    row = (
        FORMAT,
        kind,
        list(kept.inputs),
        list(kept.categories),
        kept.threshold,
        weights,
        intercept,
        mark,
        kept.learned_until,
    )
    spark.createDataFrame([row], SETTINGS).coalesce(1).write.parquet(f"{path}/settings")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """The bundle in ``path``; an unfinished or altered one raises ``ValueError``."""
    try:
        found = spark.read.schema(SETTINGS).parquet(f"{path}/settings").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if len(found) != 1 or found[0]["format"] != FORMAT:
        raise ValueError(f"no complete bundle of format {FORMAT} in {path}")
    settings = found[0]
    vocab = None
    if settings["vocab_mark"] is not None:
        vocab = spark.read.parquet(f"{path}/vocab")
        if vocab_mark(vocab) != settings["vocab_mark"]:
            raise ValueError(f"the vocabulary in {path} is not the one the model was kept with")
    inputs = tuple(settings["inputs"])
    if settings["kind"] == "logistic":
        # Maps keep no order; the sum of a logistic model is taken in the order of its inputs.
        scorer: Scorer = LogisticScorer({c: settings["weights"][c] for c in inputs}, settings["intercept"])
    else:
        scorer = SparkModelScorer(PipelineModel.load(f"{path}/model"))
    if model_inputs(scorer) != inputs:
        raise ValueError(f"the model in {path} takes {model_inputs(scorer)}, not {inputs}")
    return Bundle(
        scorer, inputs, settings["threshold"], vocab, tuple(settings["categories"]), settings["learned_until"]
    )


def bundle_rows(
    tables: Mapping[str, DataFrame], year: int, cohort: str, kept: Bundle, **kwargs
) -> DataFrame:
    """``risk_rows`` with the model, codes and threshold of a bundle.

    A year the model has learned from raises ``ValueError``: its scores would look
    better than they are.
    """
    if kept.learned_until is not None and year <= kept.learned_until:
        raise ValueError(f"the model has learned from years up to {kept.learned_until}, {year} is to be scored")
    return risk_rows(tables, year, cohort, kept, threshold=kept.threshold, **kwargs)
