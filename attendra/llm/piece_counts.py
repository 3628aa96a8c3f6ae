"""Token counts of a BPE model of sentencepiece, without encoding most words.

A text is cut into pre-tokens before every run of blanks. No vocabulary string
holds a blank behind another character (checked), so no merge crosses a cut and
the counts of the pre-tokens add up exactly.

``prove`` finds offline, once on the driver, which vocabulary strings come out of
the merges as themselves; each string the library can be asked about is compared
with it, so a model that merges in another way is refused, not counted wrongly. A
pre-token among the proven strings is one token without a merge. Only the rest is
merged, by the library, each distinct one once while a worker remembers it.

Null counts as empty: no bytes, no tokens. Special strings inside a text are
ordinary text, as by the library's default. Memory holds one batch of texts and
``CACHE`` remembered pre-tokens of at most ``LONGEST`` characters; a longer one is
remembered for its batch only.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens remembered per Python worker, and the longest one worth it.
CACHE = 600_000
LONGEST = 64
BLANK = "▁"
RUNS = re.compile(" ( *[^ ]*)")


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Symbols left when the best-scored neighbours (leftmost first) are joined as long as a piece results."""
    symbols: list[str | None] = list(text)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    waiting = [
        (-scores[pair], at, pair) for at in range(len(symbols) - 1) if (pair := text[at : at + 2]) in scores
    ]
    heapq.heapify(waiting)
    end = len(symbols)
    while waiting:
        _, at, pair = heapq.heappop(waiting)
        right = after[at] if symbols[at] is not None else end
        if right >= end or symbols[at] + symbols[right] != pair:
            continue  # one of the two has been joined otherwise since
        symbols[at], symbols[right] = pair, None
        after[at] = right = after[right]
        if right < end:
            before[right] = at
            if (joined := pair + symbols[right]) in scores:
                heapq.heappush(waiting, (-scores[joined], at, joined))
        left = before[at]
        if left >= 0 and (joined := symbols[left] + pair) in scores:
            heapq.heappush(waiting, (-scores[joined], left, joined))
    return [s for s in symbols if s is not None]


def check_plain(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raises ``ValueError`` unless a text reaches the merges as it is, but for marked blanks and one in front."""
    points = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for probe in (points, "  a  b  ", "e\u0301 \u1100\u1161"):
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("needs a model whose normalizer changes nothing and puts one blank in front")


def prove(path: str) -> frozenset[str]:
    """The strings of the model's vocabulary that encode alone as one token.

    Raises ``ValueError`` for a model that normalises texts, has no byte pieces or
    has unused ones, holds a blank behind another character, or whose own
    strings the library cuts in another way than these merges.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_plain(model)
    ids = range(model.get_piece_size())
    if any(map(model.is_unused, ids)) or not any(map(model.is_byte, ids)):
        raise ValueError("needs a model with byte pieces and without unused pieces")
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in ids
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    }
    if crossing := [p for p in scores if BLANK in p.lstrip(BLANK)]:
        raise ValueError(f"pieces cross a blank: {crossing[:3]}")
    merged = {piece: merge(piece, scores) for piece in scores}
    askable = [p for p in scores if p[0] == BLANK and p != BLANK]
    for piece, found in zip(askable, model.encode([p[1:] for p in askable], out_type=str, num_threads=1)):
        if found != merged[piece]:
            raise ValueError(f"the library encodes {piece!r} as {found}, not {merged[piece]}")
    return frozenset(p for p, symbols in merged.items() if len(symbols) == 1)


def pre_tokens(text: str | None) -> Sequence[str]:
    """Pre-tokens of a text, each without the blank that stands before it."""
    if not text:
        return ()
    text = text.replace(BLANK, " ")
    if "  " in text or text[0] == " ":
        return RUNS.findall(" " + text)
    return text.split(" ")


class Counter:
    """Token counts of texts; remembers pre-tokens."""

    def __init__(self, path: str, alone: frozenset[str]):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alone = alone
        self.known: dict[str, int] = {}

    def counts(self, texts: Sequence[str | None]) -> list[int]:
        rows = [pre_tokens(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known, alone = self.known, self.alone
        missing = {w for row in rows for w in row if w not in known}
        whole = {w for w in missing if BLANK + w.replace(" ", BLANK) in alone}
        known.update(dict.fromkeys(whole, 1))
        rest = list(missing - whole)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            known.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        out = [sum(map(known.__getitem__, row)) for row in rows]
        for word in rest:
            if len(word) > LONGEST:
                del known[word]
        return out


@lru_cache(maxsize=2)
def counter(path: str, proof: Broadcast) -> Counter:
    return Counter(path, proof.value)


def n_tokens(documents: DataFrame, path: str, text: str = "text") -> Column:
    """Expression: tokens of column ``text`` by the model at ``path``, which every executor must reach."""
    proof = documents.sparkSession.sparkContext.broadcast(prove(path))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path, proof).counts(texts.tolist()), dtype="int64")

    return counted(F.col(text))


def with_counts(documents: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``documents`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Columns of those names are replaced, all others stay. Rows stay as they are,
    repeated ones and those with a null id included.
    """
    sized = documents.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    return sized.withColumn("n_tokens", n_tokens(documents, path, text)).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
