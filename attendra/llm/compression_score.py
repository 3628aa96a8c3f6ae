"""Quality score from compression against two dictionaries.

Two zstandard dictionaries hold raw text of good and of bad labelled documents.
A text costs fewer bytes with the dictionary of the texts it resembles; the
difference of both sizes per byte of text, with the sizes themselves (repeated
text shrinks under either), is calibrated by logistic regression.

Whole texts are compressed, in blocks of ``BLOCK`` bytes, so that a long text
is held against the dictionaries throughout and not against its own beginning.
Null and empty texts score like a text of no bytes: every measure is 0.
Repeated rows get equal scores. With labels of one kind only, the score is the
share of good labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra.llm.common import labelled_sample

#: Labelled rows used: for the dictionaries, and for the calibration.
LEARN_ROWS = 12_000
DICTIONARY_BYTES = 256 << 10
#: A document's share of a dictionary: many documents, not a few long ones. The
#: excerpt lies anywhere in the text, by hash.
EXCERPT_BYTES = 512
BLOCK = 4096
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]


def dictionary(texts: list[str]) -> bytes:
    """Raw content, an excerpt per text; the format wants at least eight bytes."""
    parts, size = [], 0
    for text in texts:
        part = text.encode()[:EXCERPT_BYTES]
        if size + len(part) > DICTIONARY_BYTES:
            break
        parts.append(part)
        size += len(part)
    return b"\n".join(parts).ljust(8)


@lru_cache(maxsize=4)
def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    kinds = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (good, bad)]
    for one in kinds:
        one.precompute_compress(level=LEVEL)
    plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    return [zstandard.ZstdCompressor(dict_data=d, level=LEVEL, **plain) for d in kinds] + [
        zstandard.ZstdCompressor(level=LEVEL, **plain)
    ]


def sizes(text: str | None, good: bytes, bad: bytes) -> tuple[float, ...]:
    """Normalised difference, and compressed share of the text: good, bad, none."""
    data = (text or "").encode()
    if not data:
        return (0.0, 0.0, 0.0, 0.0)
    by_good, by_bad, alone = compressors(good, bad)
    blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
    a = sum(len(by_good.compress(b)) for b in blocks)
    b = sum(len(by_bad.compress(b)) for b in blocks)
    c = len(alone.compress(data))
    n = len(data)
    return ((b - a) / max(a, b), a / n, b / n, c / n)


def inputs(found: np.ndarray, model: Model | None = None) -> np.ndarray:
    """Measures, their squares and products, and a constant."""
    x = np.asarray(found, float).reshape(-1, 4)
    if model is not None:
        x = (x - model.centre) / model.spread
    pairs = [x[:, i] * x[:, j] for i in range(4) for j in range(i, 4)]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(
    documents: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = LEARN_ROWS
) -> Model:
    """Dictionaries from one half of a bounded labelled sample, calibration from the other.

    Dictionary excerpts and numbers of that sample reach the driver, never the table.
    """
    sample = labelled_sample(documents, labels, "quality", rows, train).where("text is not null")
    half = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2))
    places = F.greatest(F.length("text") - EXCERPT_BYTES + 1, F.lit(1))
    start = F.pmod(F.xxhash64("doc_id", F.lit(31)), places).cast("int") + 1
    excerpt = F.substring("text", start, EXCERPT_BYTES)
    words = sample.where(half == 0).select(
        "label", excerpt.alias("text"), F.xxhash64("doc_id", F.lit(29)).alias("at"), "doc_id"
    )
    most = DICTIONARY_BYTES // EXCERPT_BYTES * 8
    kinds = {}
    for label in (1, 0):
        # Excerpts can be short, so more rows than full ones are fetched.
        got = words.where(F.col("label") == label).orderBy("at", "doc_id", "text").limit(most).collect()
        kinds[label] = dictionary([r["text"] for r in got])
    measured = score_rows(sample.where(half == 1), kinds[1], kinds[0]).toPandas()
    measured = measured.sort_values(["doc_id", "m0", "m1"], kind="stable")
    found = measured[["m0", "m1", "m2", "m3"]].to_numpy(float)
    y = measured["label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Model(kinds[1], kinds[0], (0.0,) * 4, (1.0,) * 4, (bias, *[0.0] * 14))
    centre, spread = found.mean(0), found.std(0) + 1e-9
    model = Model(kinds[1], kinds[0], tuple(centre), tuple(spread), ())
    return Model(kinds[1], kinds[0], tuple(centre), tuple(spread), tuple(logistic(inputs(found, model), y)))


def score_rows(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([sizes(t, good, bad) for t in batch["text"]], columns=["m0", "m1", "m2", "m3"])
            yield pd.concat([batch[["doc_id", "label"]].reset_index(drop=True), found], axis=1)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "label", "text").mapInPandas(
        build, f"doc_id {kind}, label int, m0 double, m1 double, m2 double, m3 double"
    )


def score(documents: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` of every row (1 if the score is at least ``least``)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([sizes(t, model.good, model.bad) for t in batch["text"]], float)
            at = np.clip(inputs(found, model) @ np.array(model.weights), -30, 30)
            p = 1 / (1 + np.exp(-at))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p, "predicted": (p >= least).astype(int)})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInPandas(build, f"doc_id {kind}, score double, predicted int")
