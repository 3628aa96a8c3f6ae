"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared in lower case with every run of other signs than letters and
digits as one blank. A passage of ``m`` characters with at most ``k`` edits keeps
``m + 1 - q - k q`` of its q-grams, on diagonals that lie within ``k`` of each
other. Shared q-grams are counted in overlapping diagonal bands of twice that
width; bands that reach the bound are verified by an alignment confined to the
band. The edit budget is ``EDITS`` of the passage's length.

Items over ``SEGMENT`` characters are sought in overlapping segments. Items over
``PART`` characters are sought in parts of that length too, ``STRIDE`` apart and
one at the end: every quotation of ``PART + STRIDE - 1`` characters holds a whole
part, and the part is found if its own edits are within its budget. An item
shorter than ``LEAST`` characters (or null) matches nothing. Null and empty texts
match nothing. Whole texts are searched. Repeated rows get equal matches; of
several places in a document a whole item or segment counts before a part, then
the one with the fewest edits, then the first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 9
EDITS = 0.08
LEAST = 40
SEGMENT = 400
#: A quotation of an item from 149 characters on holds a whole part.
PART = 100
STRIDE = 50
#: Benchmark text searched for in one pass: an index of it goes to every task.
PASS_CHARS = 4_000_000
TABLE_BITS = 24
CHARS_AT_ONCE = 2_000_000
OUTSIDE = re.compile(r"[\W_]+")
FACTOR = 0x9E3779B97F4A7C15


def plain(text: str | None) -> str:
    return OUTSIDE.sub(" ", (text or "").lower()).strip()


def grams(text: str) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = points[:n].copy()
    for k in range(1, Q):
        found *= np.uint64(FACTOR)
        found += points[k : k + n]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found


@dataclass
class Passages:
    """Segments with their q-grams in hash order."""

    items: np.ndarray
    parts: np.ndarray
    texts: list[str]
    edits: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    segments: np.ndarray
    places: np.ndarray
    table: np.ndarray


def segments_of(text: str) -> list[str]:
    if len(text) <= SEGMENT:
        return [text]
    return [text[a : a + SEGMENT] for a in range(0, len(text) - SEGMENT // 2, SEGMENT // 2)]


def parts_of(text: str) -> list[str]:
    if len(text) <= PART:
        return []
    return [text[a : a + PART] for a in (*range(0, len(text) - PART, STRIDE), len(text) - PART)]


@lru_cache(maxsize=2)
def passages(items: tuple[tuple[int, str], ...]) -> Passages:
    rows = []
    for item, text in items:
        # An item's segments come before its parts: ``search`` relies on it.
        rows += [(item, False, one) for one in segments_of(text) if len(one) >= LEAST]
        rows += [(item, True, one) for one in parts_of(text)]
    texts = [t for _, _, t in rows]
    sizes = np.array([len(t) for t in texts], np.int64)
    edits = np.minimum((EDITS * sizes).astype(np.int64), (sizes - Q) // Q)
    hashes = [grams(t) for t in texts]
    every = np.concatenate([*hashes, np.empty(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    segment = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])[order]
    place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.empty(0, np.int64)]).astype(np.int64)[order]
    table = np.zeros(1 << TABLE_BITS, bool)
    table[every >> np.uint64(64 - TABLE_BITS)] = True
    return Passages(
        np.array([i for i, _, _ in rows], np.int64),
        np.array([p for _, p, _ in rows], bool),
        texts,
        edits,
        sizes + 1 - Q - edits * Q,
        every[order],
        segment,
        place,
        table,
    )


def aligned(passage: str, part: str, edits: int) -> tuple[int, int] | None:
    """Fewest edits of ``passage`` against any stretch of ``part`` and where that ends.

    Row by row over the whole of ``part``, which the band has already confined;
    None if above ``edits``.
    """
    exact = part.find(passage)
    if exact >= 0:
        return 0, exact + len(passage)
    text = np.frombuffer(part.encode("utf-32-le"), np.uint32)
    along = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for number, point in enumerate(map(ord, passage), 1):
        new = np.empty_like(row)
        new[0] = number
        new[1:] = np.minimum(row[:-1] + (text != point), row[1:] + 1)
        row = np.minimum.accumulate(new - along) + along
        if row.min() > edits:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= edits else None


def search(texts: list[str], known: Passages) -> Iterator[tuple[int, int, int, int, int]]:
    """``(number of text, item, edits, start, end)`` in normalised text, best per item."""
    # A text's q-grams never reach into the next: Q line feeds lie between.
    gap = "\n" * Q
    joined = gap.join(texts)
    starts = np.cumsum([0, *(len(t) + Q for t in texts)])
    found = grams(joined)
    at = np.flatnonzero(known.table[found >> np.uint64(64 - TABLE_BITS)])
    low = np.searchsorted(known.hashes, found[at], "left")
    many = np.searchsorted(known.hashes, found[at], "right") - low
    at, low, many = at[many > 0], low[many > 0], many[many > 0]
    if not len(at):
        return
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    posting = np.repeat(low, many) + inner
    place, segment = np.repeat(at, many), known.segments[posting]
    diagonal = place - known.places[posting] + SEGMENT
    width = known.edits[segment] + 1
    band = diagonal // width
    # Each diagonal lies in the band that begins here and in the one before.
    key = np.concatenate([segment * (1 << 40) + band, segment * (1 << 40) + band - 1])
    bands, count = np.unique(key, return_counts=True)
    wanted = bands[count >= known.bounds[bands >> 40]]
    best: dict[tuple[int, int], tuple[bool, int, int, int]] = {}
    for one in wanted.tolist():
        number, band_at = one >> 40, one & ((1 << 40) - 1)
        k, passage = int(known.edits[number]), known.texts[number]
        first = band_at * (k + 1) - SEGMENT
        text_at = int(np.searchsorted(starts, min(max(first + len(passage) // 2, 0), len(joined) - 1), "right")) - 1
        at_item, is_part = (text_at, int(known.items[number])), bool(known.parts[number])
        if is_part and at_item in best and not best[at_item][0]:
            continue
        begin, stop = int(starts[text_at]), int(starts[text_at]) + len(texts[text_at])
        left = max(begin, first - k)
        part = joined[left : min(stop, first + 2 * (k + 1) + len(passage) + k)]
        match = aligned(passage, part, k)
        if match is None:
            continue
        end = left + match[1] - begin
        row = (is_part, match[0], max(0, end - len(passage)), end)
        if at_item not in best or row < best[at_item]:
            best[at_item] = row
    for (text_at, item), (_, edits, start, end) in sorted(best.items()):
        yield text_at, item, edits, start, end


def in_pieces(texts: list[str | None], known: Passages) -> Iterator[tuple[int, int, int, int, int]]:
    """``search`` over bounded amounts of text at once."""
    first, size, held = 0, 0, []
    for number, text in enumerate(texts):
        held.append(plain(text))
        size += len(held[-1])
        if size >= CHARS_AT_ONCE or number + 1 == len(texts):
            for at, *rest in search(held, known):
                yield first + at, *rest
            first, size, held = number + 1, 0, []


def benchmark_passes(benchmark: DataFrame) -> list[tuple[tuple[int, str], ...]]:
    """The items, normalised, in passes of a bounded number of characters.

    A benchmark within ``PASS_CHARS`` makes one pass; a larger one is fetched and
    searched for part by part, so what a task holds never grows with it.
    """
    named = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").dropna()
    total = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // PASS_CHARS)) if total > PASS_CHARS else 1
    place = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    rows = (named.where(place == p).distinct().collect() for p in range(parts))
    return [tuple(sorted((r["item"], plain(r["text"])) for r in part)) for part in rows]


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, start, end`` for every item found in a document.

    Places count characters of the normalised text; ``start`` is ``end`` less the
    item's (or its segment's or part's) length, and ``edits`` are those of that stretch.
    """
    kind = dict(documents.dtypes)["doc_id"]
    out = None
    for items in benchmark_passes(benchmark):

        def build(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            known = passages(items)
            for batch in batches:
                rows = list(in_pieces(batch["text"].tolist(), known))
                ids = batch["doc_id"].iloc[[r[0] for r in rows]].reset_index(drop=True)
                rest = pd.DataFrame([r[1:] for r in rows], columns=["item_id", "edits", "start", "end"])
                yield pd.concat([ids, rest], axis=1)

        found = documents.select("doc_id", "text").mapInPandas(
            build, f"doc_id {kind}, item_id long, edits long, start long, end long"
        )
        out = found if out is None else out.unionByName(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no item is found, with all their columns."""
    for items in benchmark_passes(benchmark):
        documents = documents.where(~F.pandas_udf(holding(items), "boolean")("text"))
    return documents


def holding(items: tuple[tuple[int, str], ...]) -> Callable[[pd.Series], pd.Series]:
    """Whether texts hold any of ``items``."""

    def holds(texts: pd.Series) -> pd.Series:
        hit = np.zeros(len(texts), bool)
        hit[[r[0] for r in in_pieces(texts.tolist(), passages(items))]] = True
        return pd.Series(hit)

    return holds
