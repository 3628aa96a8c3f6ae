"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Every code point gets a symbol class; each class is a function from state to
state, and functions compose associatively. Composing them over blocks, then
over the blocks' totals, gives the state before every code point without a
regular expression, and (state, class) says where a piece starts. Pieces are
merged by rank through a cache; the byte lengths of ids give their offsets.

The pattern reproduced (a fixed value of the vocabulary):
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``

A null text counts as empty, and an empty text has no ids. Very long pieces are
merged with a heap, so time stays near linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Pieces remembered per Python worker.
CACHE = 400_000
BLOCK = 256
#: White space of the pattern's \s.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, SPACE = range(4)
# Symbols: a code point's class with what follows it.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_BLANK, S_LAST, S_INNER = range(8)
# States: what the piece being read is made of.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by symbol and state."""
    go, starts = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    joins = {
        S_LETTER: ({IN_LETTERS, AFTER_BLANK}, IN_LETTERS),
        S_NUMBER: ({IN_NUMBERS, AFTER_BLANK}, IN_NUMBERS),
        S_OTHER: ({IN_OTHERS, AFTER_BLANK}, IN_OTHERS),
        S_INNER: ({IN_SPACES}, IN_SPACES),
        S_BLANK: (set(), AFTER_BLANK),
        S_LAST: (set(), FRESH),
    }
    for symbol, (same, into) in joins.items():
        for state in range(8):
            go[symbol, state], starts[symbol, state] = into, state not in same
    for symbol, into in ((S_QUOTE1, ONE_LEFT), (S_QUOTE2, TWO_LEFT)):
        for state in range(8):
            inside = state in (IN_OTHERS, AFTER_BLANK)
            go[symbol, state], starts[symbol, state] = (IN_OTHERS, False) if inside else (into, True)
    go[:, ONE_LEFT], go[:, TWO_LEFT] = FRESH, ONE_LEFT  # the rest of a contraction
    starts[:, ONE_LEFT] = starts[:, TWO_LEFT] = False
    return go, starts


GO, STARTS = _moves()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            kinds[point] = LETTER
        elif major == "N":
            kinds[point] = NUMBER
    kinds[SPACES] = SPACE
    return kinds


def symbols(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``last`` marks the end of each text."""
    kind = classes()[points]
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER], np.uint8)[kind]
    after = np.full(len(points), SPACE, np.uint8)
    after[:-1] = kind[1:]
    after[last] = SPACE
    closing = (kind == SPACE) & (after != SPACE)
    out[closing] = np.where(points[closing] == 32, S_BLANK, S_LAST)
    quotes = np.flatnonzero((points == 39) & ~last)
    if len(quotes):
        one = points[quotes + 1]
        single = np.isin(one, [ord(c) for c in "stmd"])
        room = ~last[quotes + 1]
        two = np.zeros_like(one)
        two[room] = points[quotes[room] + 2]
        double = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quotes[single]] = S_QUOTE1
        out[quotes[double & room]] = S_QUOTE2
    return out


def piece_starts(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point, by a scan over composed moves."""
    n = len(points)
    symbol = symbols(points, last)
    # A text's first code point is read from the fresh state whatever came before.
    move = np.concatenate([GO, np.repeat(GO[:, :1], 8, axis=1)])
    width = -(-n // BLOCK)
    code = np.full(width * BLOCK, 0, np.uint8)
    code[:n] = symbol + 8 * first
    code = np.ascontiguousarray(code.reshape(width, BLOCK).T)
    total = np.tile(np.arange(8, dtype=np.uint8), (width, 1))
    flat = move.ravel()
    for row in code:  # compose each block's moves, all blocks at once
        total = flat[(row.astype(np.intp) * 8)[:, None] + total]
    reach = 1
    while reach < width:  # prefix composition of the blocks' totals, by doubling
        later = np.take_along_axis(total[reach:], total[:-reach].astype(np.intp), axis=1)
        total = np.concatenate([total[:reach], later])
        reach *= 2
    state = np.concatenate([[FRESH], total[:-1, FRESH]]).astype(np.intp)
    begins = np.empty((BLOCK, width), bool)
    opens = np.concatenate([STARTS, np.repeat(STARTS[:, :1], 8, axis=1)]).ravel()
    for k, row in enumerate(code):
        at = row.astype(np.intp) * 8 + state
        begins[k] = opens[at]
        state = flat[at].astype(np.intp)
    return begins.T.ravel()[:n]


def pieces_of(texts: Sequence[str]) -> list[list[bytes]]:
    """The pieces of each text, as UTF-8."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return [[] for _ in texts]
    joined = "".join(texts)
    data = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    filled = sizes > 0
    first[(ends - sizes)[filled]] = True
    last[ends[filled] - 1] = True
    starts = np.flatnonzero(piece_starts(points, first, last))
    if len(data) == n:
        cuts = starts
    else:
        wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        cuts = (np.cumsum(wide) - wide)[starts]
    bounds = np.append(cuts, len(data)).tolist()
    every = [data[a:b] for a, b in zip(bounds, bounds[1:])]
    edges = np.searchsorted(starts, np.append(0, ends)).tolist()
    return [every[a:b] for a, b in zip(edges, edges[1:])]


class Merges(dict):
    """Ids of a piece, merged on first use."""

    def __init__(self, path: str, most: int = CACHE):
        super().__init__()
        self.most = most
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        rank = self.ranks.get(piece)
        ids = (rank,) if rank is not None else tuple(self.merged(piece))
        if len(piece) <= 256:
            self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if len(piece) > 64:
            return self.merged_long(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        none = len(self.bytes_of)  # above every rank
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            new = parts[at] + parts[at + 1]
            parts[at : at + 2] = [new]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + new, none)
            if at < len(pairs):
                pairs[at] = ranks.get(new + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def merged_long(self, piece: bytes) -> list[int]:
        """As ``merged``, the lowest rank and leftmost pair taken from a heap."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end[k]: end of the part that starts at k; 0 if merged away
        before = list(range(-1, n - 1))
        heap = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                rank = ranks.get(piece[a : end[b]])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, end[b]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue  # one of the two has changed
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        found = pieces_of([t or "" for t in texts])
        look = self.__getitem__
        return [np.fromiter(chain.from_iterable(map(look, p)), np.uint32) for p in found]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes start in the text's UTF-8."""
        sizes = np.fromiter((len(self.bytes_of[i]) for i in ids.tolist()), np.int64, len(ids))
        return np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One cache per Python worker and rank file."""
    return Merges(path)


def encode(documents: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``doc_id, ids, offsets``: ids of the whole text and their byte offsets."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = merges(path)
        for batch in batches:
            ids = bpe.encode(batch[column].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "ids": [i.astype(np.int32) for i in ids],
                    "offsets": [bpe.offsets(i) for i in ids],
                }
            )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", column).mapInPandas(build, f"doc_id {kind}, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` (binary) from ``ids``; a null list of ids gives null."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = merges(path)
        for batch in batches:
            text = [None if i is None else bpe.decode(np.asarray(i)) for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": text})

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInPandas(build, f"doc_id {kind}, text binary")


def digests(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from a round trip in one task."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = merges(path)
        for batch in batches:
            ids = bpe.encode(batch["text"].tolist())
            out = pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(i) for i in ids],
                    "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids],
                }
            )
            if with_ids:
                out["ids"] = [i.astype(np.int32) for i in ids]
            yield out

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", "text").mapInPandas(build, schema + ", ids array<int>" * with_ids)
