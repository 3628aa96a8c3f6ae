"""Quality rules: a decision list learned by sequential covering.

Statistics of each text feed a base filter and then an ordered list of rules.
Each rule is a conjunction of thresholds, grown on two thirds of the labelled
rows and pruned on the rest; covered rows leave before the next rule is grown.
The list becomes one ordered Spark ``CASE WHEN``.

Null texts count as empty. Empty texts have no words and fail the base filter.
Repeated rows get equal verdicts. Without labels of both kinds the list is empty
and keeps what passes the base filter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra.llm.common import labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_distinct_words long, n_upper_words long, n_lines long"
)
#: Labelled rows a list is learned from.
LEARN_ROWS = 20_000


def statistics(text: str | None) -> tuple[int, ...]:
    """The fields of ``STATS`` for one text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    repeated = 0
    if n >= 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0  # words before this place are counted
            for at, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += at + 5 - max(at, end)
                    end = at + 5
    return (
        n,
        sum(map(len, words)),
        len(SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated,
        len(set(words)),
        sum(map(str.isupper, words)),
        len(lines),
    )


def text_statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=[c.split()[0] for c in STATS.split(", ")])


def with_statistics(rows: DataFrame) -> DataFrame:
    """``doc_id`` (and ``label`` if there is one) with the statistics of ``text``."""
    keys = [c for c in ("doc_id", "label") if c in rows.columns]
    kinds = dict(rows.dtypes)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame(
                [statistics(t) for t in batch["text"]],
                columns=[c.split()[0] for c in STATS.split(", ")],
            )
            yield pd.concat([batch[keys].reset_index(drop=True), found], axis=1)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), STATS])
    return rows.select(*keys, "text").mapInPandas(build, schema)


def base_failed(stats: str = "") -> Column:
    """Fewer than ten words, or over a fifth of them in repeated five-word windows."""
    words, repeated = F.col(f"{stats}n_words"), F.col(f"{stats}n_repeat_words")
    return (words < 10) | (100 * repeated > 20 * words)


def measures(stats: str = "") -> dict[str, Column]:
    """What rules may test, each a number for every text."""
    at = lambda name: F.col(f"{stats}{name}").cast("double")
    words = F.greatest(at("n_words"), F.lit(1.0))
    return {
        "n_words": at("n_words"),
        "chars_per_word": at("word_chars") / words,
        "symbols_per_char": at("n_symbols") / F.greatest(at("word_chars"), F.lit(1.0)),
        "dup_line_share": at("n_dup_lines") / F.greatest(at("n_lines"), F.lit(1.0)),
        "repeat_share": at("n_repeat_words") / words,
        "distinct_share": at("n_distinct_words") / words,
        "upper_share": at("n_upper_words") / words,
    }


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def expression(self, found: dict[str, Column]) -> Column:
        value = found[self.measure]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Test, ...]


def covers(rule: Sequence[Test], x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for test in rule:
        hit &= test.holds(x[:, names.index(test.measure)])
    return hit


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> Rule:
    """Adds the test with the largest information gain until no good row is covered.

    Thresholds lie half-way between the rows a test parts, so that a new row a
    little beyond the rows seen falls on the nearer side.
    """
    rule: list[Test] = []
    hit = np.ones(len(x), bool)
    while len(rule) < most and hit.any() and not bad[hit].all():
        p0, n0 = bad[hit].sum(), (~bad[hit]).sum()
        if not p0:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            seen = np.unique(np.quantile(x[hit & bad, k], np.linspace(0, 1, 33)))
            cuts = np.unique(np.concatenate([seen, np.quantile(x[hit, k], np.linspace(0, 1, 65))]))
            order = np.sort(x[hit & bad, k]), np.sort(x[hit & ~bad, k])
            p_low, n_low = (np.searchsorted(side, cuts, "right") for side in order)
            for above, p, n in ((True, p0 - p_low, n0 - n_low), (False, p_low, n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    each = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                if len(each) and each.max() > gain:
                    at = int(each.argmax())
                    best, gain = Test(name, above, float(cuts[at])), float(each[at])
        if best is None:
            break
        best = centred(best, x[hit, names.index(best.measure)])
        rule.append(best)
        hit &= best.holds(x[:, names.index(best.measure)])
    return tuple(rule)


def centred(test: Test, values: np.ndarray) -> Test:
    """``test`` with its threshold half-way between the values on its two sides: as far from both as can be."""
    below, over = values[values <= test.threshold], values[values > test.threshold]
    if not len(below) or not len(over):
        return test
    return Test(test.measure, test.above, float(below.max() + (over.min() - below.max()) / 2))


def precision(rule: Sequence[Test], x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    hit = covers(rule, x, names)
    return (bad[hit].sum() + 1) / (hit.sum() + 2)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The shortest leading part of ``rule`` with the best smoothed precision."""
    parts = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(parts, key=lambda part: precision(part, x, bad, names), default=())


def learn_list(
    x: np.ndarray,
    bad: np.ndarray,
    names: list[str],
    most_rules: int = 12,
    most_tests: int = 4,
    least_precision: float = 0.9,
    least_cover: int = 5,
) -> list[Rule]:
    """Ordered rules for bad rows; every third row prunes what the others have grown.

    A rule counts only if it is precise on the pruning rows that earlier rules
    left, so that clean text stays. Learning ends at the first that is not.
    """
    rules: list[Rule] = []
    pruning = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and bad[~pruning].any():
        rule = grow(x[~pruning], bad[~pruning], names, most_tests)
        rule = prune(rule, x[pruning], bad[pruning], names)
        hit = covers(rule, x, names)
        if not rule or hit.sum() < least_cover:
            break
        if precision(rule, x[pruning], bad[pruning], names) < least_precision:
            break
        rules.append(rule)
        x, bad, pruning = x[~hit], bad[~hit], pruning[~hit]
    return rules


def rejected(rules: Sequence[Rule], found: dict[str, Column]) -> Column:
    """Number of the first rule that holds, or 0, as one ordered conditional."""
    verdict = None
    for place, rule in enumerate(rules, 1):
        condition = F.lit(True)
        for test in rule:
            condition = condition & test.expression(found)
        verdict = F.when(condition, place) if verdict is None else verdict.when(condition, place)
    return F.lit(0) if verdict is None else verdict.otherwise(0)


def learn(documents: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> list[Rule]:
    """Rules from about ``rows`` labelled documents (``labels.quality`` 0 is bad).

    Only numbers of that bounded sample reach the driver.
    """
    found = measures()
    sample = with_statistics(labelled_sample(documents, labels, "quality", rows))
    passed = sample.where(~base_failed()).select("doc_id", "label", *(c.alias(n) for n, c in found.items()))
    frame = passed.toPandas().sort_values("doc_id", kind="stable")
    order = np.random.default_rng(5).permutation(len(frame))
    x = frame[list(found)].to_numpy(float)[order]
    return learn_list(x, (frame["label"].to_numpy() == 0)[order], list(found))


def judge(documents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every row's statistics, base verdict, rule number and final verdict."""
    judged = with_statistics(documents).withColumn("base_failed", base_failed())
    return judged.withColumn("rule", rejected(rules, measures())).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def keep_good(documents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows of ``documents`` that pass, with all their columns."""
    mark = "_text_statistics"
    while mark in documents.columns:
        mark = f"_{mark}"
    marked = documents.withColumn(mark, F.pandas_udf(text_statistics, STATS)("text"))
    passed = ~base_failed(f"{mark}.") & (rejected(rules, measures(f"{mark}.")) == 0)
    return marked.where(passed).drop(mark)
