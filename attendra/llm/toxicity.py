"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, strips marks, and maps look-alike letters and digits or
signs inside words to plain letters. Lexicon entries are whole words and word
stems, learned from labelled documents: their log odds are the weights. Matches
run over the whole folded text in one pass; the longest entry at a word start
counts. Phrases around an entry (its word with the word before or after) that
occur in harmless documents are exceptions and void the match. The weights are
summed, normalised by the number of words, and calibrated with the largest
weight by logistic regression.

Null and empty texts have no matches and score lowest. Repeated rows get equal
scores. With labels of one kind only the lexicon is empty and every score is the
share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra.llm.common import labelled_sample
from attendra.llm.compression_score import logistic

LEARN_ROWS = 16_000
STEMS = (4, 5, 6)
#: Toxic documents an entry must occur in, and how much likelier it must be there.
LEAST_TOXIC = 5
LEAST_WEIGHT = 2.0

# Letters that look like plain ones (Cyrillic and Greek), and the
# digits and signs that stand for letters inside words.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ꞵ": "b",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
WORD = re.compile(r"[^\W_]+(?:[@$!]+[^\W_]+)*|[@$!][^\W_]+")
LETTER = re.compile(r"[^\W\d_]")


def fold(word: str) -> str:
    """A word in plain lower-case letters; numbers without letters stay."""
    plain = word.lower()
    if not plain.isascii():
        plain = unicodedata.normalize("NFKD", plain)
        # Some letters stand for whole phrases; their parts stay one word.
        kept = (c for c in plain if not unicodedata.combining(c) and not c.isspace())
        plain = "".join(LOOKALIKES.get(c, c) for c in kept)
    if not plain.isalpha() and LETTER.search(plain):
        plain = "".join(SUBSTITUTES.get(c, c) for c in plain)
    return plain


@lru_cache(maxsize=300_000)
def folded(word: str) -> str:
    return fold(word)


def words_of(text: str | None) -> list[str]:
    return [plain for w in WORD.findall(text or "") if (plain := folded(w))]


def entries_of(word: str) -> Iterable[str]:
    """Entries a word can match: itself, closed by a blank, and its stems."""
    yield f" {word} "
    for n in STEMS:
        if len(word) > n:
            yield f" {word[:n]}"


@dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...]
    exceptions: frozenset[str]
    weights: tuple[float, ...]


@lru_cache(maxsize=2)
def automaton(lexicon: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for entry, weight in lexicon:
        found.add_word(entry, (len(entry), weight))
    found.make_automaton()
    return found


def word_numbers(words: list[str]) -> dict[int, int]:
    """Word number by the place of the blank before it in the joined line."""
    return {at: k for k, at in enumerate(accumulate((len(w) + 1 for w in words[:-1]), initial=0))}


def matches(words: list[str], model: Model) -> list[tuple[int, float]]:
    """Word number and weight of every match that no exception voids."""
    if not model.lexicon or not words:
        return []
    line = f" {' '.join(words)} "
    best: dict[int, tuple[int, float]] = {}
    for end, (size, weight) in automaton(model.lexicon).iter(line):
        start = end - size + 1
        if start not in best or best[start][0] < size:
            best[start] = (size, weight)
    out = []
    numbers = word_numbers(words) if best else {}
    for start, (_, weight) in sorted(best.items()):
        at = numbers[start]
        if model.exceptions and any(p in model.exceptions for p in phrases(words, at)):
            continue
        out.append((at, weight))
    return out


def phrases(words: list[str], at: int) -> list[str]:
    found = []
    if at:
        found.append(f"{words[at - 1]} {words[at]}")
    if at + 1 < len(words):
        found.append(f"{words[at]} {words[at + 1]}")
    return found


def measure(text: str | None, model: Model) -> tuple[float, float, float, float]:
    """Weight sum, weight per word (log scale both), largest weight, any match."""
    words = words_of(text)
    found = [w for _, w in matches(words, model)]
    if not found:
        return 0.0, 0.0, 0.0, 0.0
    total = sum(found)
    return math.log1p(total), math.log1p(1000 * total / len(words)), max(found), 1.0


def learn(documents: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = LEARN_ROWS) -> Model:
    """Lexicon, exceptions and calibration from a bounded labelled sample.

    Entries are counted over the sample in parallel; only those beyond the limits of
    count and weight and four numbers per sampled document reach the driver. The
    bound on the rows bounds them as well.
    """
    sample = labelled_sample(documents, labels, "toxic", rows, train)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"]):
                counts[label == 1].update({e for w in set(words_of(text)) for e in entries_of(w)})
            rows = [(e, counts[1][e], counts[0][e]) for e in counts[0].keys() | counts[1].keys()]
            yield pd.DataFrame(rows, columns=["entry", "toxic", "clean"])

    n = sample.groupBy("label").count().collect()
    n_toxic, n_clean = (sum(r["count"] for r in n if (r["label"] == 1) == side) for side in (True, False))
    if not n_toxic or not n_clean:
        return Model((), frozenset(), (8.0 if n_toxic else -8.0, 0.0, 0.0, 0.0, 0.0))
    counted = sample.mapInPandas(entries, "entry string, toxic long, clean long")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    heavy = (
        counted.groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= LEAST_TOXIC)
        .withColumn("weight", F.round(odds, 6))
        .where(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc(F.col("weight") * F.col("toxic")), "entry")
        .collect()
    )
    lexicon = tuple((r["entry"], r["weight"]) for r in heavy)
    model = Model(lexicon, frozenset(), ())

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"]):
                words = words_of(text)
                line = f" {' '.join(words)} "
                found = {end - size + 1 for end, (size, _) in automaton(lexicon).iter(line)} if lexicon else set()
                numbers = word_numbers(words) if found else {}
                seen = {p for start in found for p in phrases(words, numbers[start])}
                rows += [(p, int(label == 1), int(label != 1)) for p in seen]
            yield pd.DataFrame(rows, columns=["phrase", "toxic", "clean"])

    harmless = (
        sample.mapInPandas(contexts, "phrase string, toxic long, clean long")
        .groupBy("phrase")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("clean") >= 3) & (F.col("toxic") == 0))
        .orderBy(F.desc("clean"), "phrase")
        .collect()
    )
    model = Model(lexicon, frozenset(r["phrase"] for r in harmless), ())
    fitted = measured(sample, model).toPandas().sort_values(["doc_id", "m1"], kind="stable")
    x = np.column_stack([np.ones(len(fitted)), fitted[["m0", "m1", "m2", "m3"]].to_numpy(float)])
    weights = logistic(x, (fitted["label"].to_numpy() == 1).astype(float), ridge=1e-1)
    return Model(lexicon, model.exceptions, tuple(weights))


def measured(rows: DataFrame, model: Model) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([measure(t, model) for t in batch["text"]], columns=["m0", "m1", "m2", "m3"])
            yield pd.concat([batch[["doc_id", "label"]].reset_index(drop=True), found], axis=1)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "label", "text").mapInPandas(
        build, f"doc_id {kind}, label int, m0 double, m1 double, m2 double, m3 double"
    )


def score(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted`` of every row (1 if the score is at least ``least``)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([measure(t, model) for t in batch["text"]], float).reshape(-1, 4)
            at = model.weights[0] + found @ np.array(model.weights[1:])
            p = 1 / (1 + np.exp(-np.clip(at, -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p, "predicted": (p >= least).astype(int)})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInPandas(build, f"doc_id {kind}, score double, predicted int")
