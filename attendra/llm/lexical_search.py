"""Exact ranked lexical search: the best documents of every item, by branch and bound over document tries.

Terms are the runs of letters, digits and characters beyond ASCII, only A to Z
lower-cased. A term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document
scores the sum over the item's terms of ``weight * (10^9 tf div (1000 tf + 8m))``
with ``m = 10 + (90 n N) div L``; all statistics cover every document.

1. Items are dealt to blocks of bounded size by hash of their id. For each block one
   scan of the documents writes their term vectors, restricted to the block's
   terms; texts travel no further. The document counts come from these vectors.
2. Every task builds tries over bounded runs of its vectors. A vector lists its
   terms by falling document count, so documents with the same frequent terms share a
   path; single-child paths are one node, and neighbouring subtrees of few documents
   share one leaf. A node keeps the greatest tf of each term and the least m in
   its subtree, whose score no document below can exceed.
3. For each item the trie is walked depth first, best child first. A subtree whose
   bound is below the item's k-th best score so far (or equal to it, with larger
   ids only) is skipped; leaves are scored exactly. The best k go from trie to
   trie, so that later ones are cut early.
4. k rows per item and task meet in one ranking.

No document, item or term is left out. Rows are documents: repeated ids are ranked
each for itself, a null id after all others of its score. Rows of one item id make one
item (a null id counts as an id). Null and empty texts have no terms and count
nowhere. Items without a matching document, and empty tables, give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attendra.sources.storage import materialize

#: Rows (item, term) of one block of items; what the driver holds and sends at once.
BLOCK_TERMS = 200_000
#: Terms that one trie tells apart, unless a single item has more.
TRIE_TERMS = 4096
#: Cells (documents times terms) of one trie's matrix, four bytes each.
TRIE_CELLS = 16 << 20
#: Documents scored together at the end of a path.
LEAF = 32

#: Bytes of UTF-8 outside a term become blanks, A to Z lower case.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a text in order, with repeats, as UTF-8."""
    return text.encode().translate(FOLD).split() if text else []


class Item(NamedTuple):
    item_id: int | None
    terms: np.ndarray


class Group(NamedTuple):
    """Items that share tries: ``place[t]`` is term t's column there (rarer terms further right), or -1."""

    items: list[Item]
    place: np.ndarray
    width: int


def points(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of rows of term frequencies; grows with tf and falls with m."""
    tf = tf.astype(np.int64)
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])) @ weights


class Best:
    """The k first of what was offered: by falling score, then null ids last, then id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(p) for p in ((self.score, score), (self.id, ids), (self.null, null)))
        first = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[first], ids[first], null[first]

    def hopeless(self, bound: int, least_id: int) -> bool:
        if bound <= 0:
            return True
        if len(self.score) < self.k:
            return False
        return bound < self.score[-1] or (bound == self.score[-1] and least_id > self.id[-1])


class Trie:
    """Nodes over runs of documents in path order; the children of a node have consecutive numbers."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, tf: np.ndarray, n: int, width: int, m, ids, null):
        """``rows`` and ``columns`` place the frequencies ``tf``, sorted by both."""
        starts = np.searchsorted(rows, np.arange(n + 1))
        path = columns.astype(">u4")
        paths = [path[a:b].tobytes() for a, b in zip(starts, starts[1:])]
        order = sorted(range(n), key=lambda r: (paths[r], m[r], null[r], ids[r]))
        paths = [paths[r] for r in order]
        self.m, self.ids, self.null = m[order], ids[order], null[order]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.tf = np.zeros((n, width), np.int32)
        self.tf[back[rows], columns] = tf
        self._nodes(np.array([0, *map(shared, paths, paths[1:])]))
        self._maxima()

    def _nodes(self, common: np.ndarray) -> None:
        """Cuts runs where the shared path is shortest, until a run fits a leaf."""
        self.low, self.high, self.first, self.end = [0], [len(self.m)], [], []
        at = 0
        while at < len(self.low):
            low, high = self.low[at], self.high[at]
            self.first.append(len(self.low))
            if high - low > LEAF:
                inner = common[low + 1 : high]
                cuts = [*(np.flatnonzero(inner == inner.min()) + low + 1).tolist(), high]
                start, last = low, low
                for cut in cuts:
                    if cut - start > LEAF and last > start:  # few documents so far: one leaf
                        self.low.append(start)
                        self.high.append(last)
                        start = last
                    if cut - start > LEAF or cut == high:
                        self.low.append(start)
                        self.high.append(cut)
                        start = cut
                    last = cut
            self.end.append(len(self.low))
            at += 1

    def _maxima(self) -> None:
        nodes = len(self.low)
        self.max_tf = np.empty((nodes, self.tf.shape[1]), np.int32)
        self.min_m, self.min_id = np.empty(nodes, np.int64), np.empty(nodes, np.int64)
        for at in reversed(range(nodes)):
            if self.first[at] == self.end[at]:
                part = slice(self.low[at], self.high[at])
                tf, m, ids = self.tf[part], self.m[part], self.ids[part]
            else:
                part = slice(self.first[at], self.end[at])
                tf, m, ids = self.max_tf[part], self.min_m[part], self.min_id[part]
            tf.max(axis=0, out=self.max_tf[at])
            self.min_m[at], self.min_id[at] = m.min(), ids.min()

    def search(self, columns: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offers the documents that may belong to ``best``; returns the number of nodes looked at."""
        waiting, seen = [(int(points(self.max_tf[:1, columns], self.min_m[:1], weights)[0]), 0)], 0
        while waiting:
            bound, at = waiting.pop()
            if best.hopeless(bound, self.min_id[at]):
                continue
            seen += 1
            first, end = self.first[at], self.end[at]
            if first == end:
                part = slice(self.low[at], self.high[at])
                score = points(self.tf[part][:, columns], self.m[part], weights)
                good = score > 0 if len(best.score) < best.k else score >= best.score[-1]
                if good.any():
                    best.offer(score[good], self.ids[part][good], self.null[part][good])
            else:
                bounds = points(self.max_tf[first:end][:, columns], self.min_m[first:end], weights)
                order = np.argsort(bounds, kind="stable")
                waiting.extend(zip(bounds[order].tolist(), (first + order).tolist()))
        return seen


def shared(a: bytes, b: bytes) -> int:
    """Terms that two paths begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    differs = np.frombuffer(a, ">u4", n // 4) != np.frombuffer(b, ">u4", n // 4)
    return int(differs.argmax())


def groups(items: Sequence[Item], counts: np.ndarray) -> list[Group]:
    """Deals items to tries of at most ``TRIE_TERMS`` terms, columns by falling document count."""
    out: list[Group] = []
    held: list[Item] = []
    union: set[int] = set()

    def close() -> None:
        columns = np.array(sorted(union, key=lambda t: (-counts[t], t)), np.int64)
        place = np.full(len(counts), -1, np.int64)
        place[columns] = np.arange(len(columns))
        out.append(Group(held, place, len(columns)))

    for item in items:
        more = union | set(item.terms.tolist())
        if held and len(more) > TRIE_TERMS:
            close()
            held, more = [], set(item.terms.tolist())
        held, union = [*held, item], more
    if held:
        close()
    return out


def vectors(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of documents with a term: all terms counted, those of ``vocabulary`` listed."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = sent.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = terms(text)
                if words:
                    found = Counter(filter(number.__contains__, words))
                    rows.append((doc_id, len(words), [number[w] for w in found], list(found.values())))
            frame = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"])
            yield frame.astype({"doc_id": "Int64"})

    return documents.select("doc_id", "text").mapInPandas(build, "doc_id long, n long, terms array<int>, tfs array<int>")


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined values of a list column."""
    lengths = column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    return lengths, column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def search_block(held: DataFrame, work: Sequence[Group], weights: np.ndarray, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the best k of each task for every item; ``held`` has doc_id, m, terms, tfs."""
    sent = held.sparkSession.sparkContext.broadcast((work, weights))
    run = min(max(LEAF, TRIE_CELLS // g.width) for g in work)

    def walk(table: pa.Table, best: dict) -> None:
        work, weights = sent.value
        lengths, numbers = flat(table["terms"])
        tfs = flat(table["tfs"])[1]
        rows = np.repeat(np.arange(len(table)), lengths)
        m = table["m"].to_numpy()
        null = table["doc_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ids = table["doc_id"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        for g, group in enumerate(work):
            columns = group.place[numbers]
            inside = columns >= 0
            r, c, t = rows[inside], columns[inside], tfs[inside]
            order = np.lexsort((c, r))
            trie = Trie(r[order], c[order], t[order], len(table), group.width, m, ids, null)
            for i, item in enumerate(group.items):
                trie.search(group.place[item.terms], weights[item.terms], best.setdefault((g, i), Best(k)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], Best] = {}
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            while rows >= run:
                table = pa.Table.from_batches(waiting)
                walk(table.slice(0, run), best)
                waiting, rows = table.slice(run).to_batches(), rows - run
        if rows:
            walk(pa.Table.from_batches(waiting), best)
        for (g, i), found in best.items():
            item_id = sent.value[0][g].items[i].item_id
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([item_id] * len(found.id), pa.int64()),
                    pa.array(found.id, pa.int64(), mask=found.null),
                    pa.array(found.score, pa.int64()),
                ],
                ["item_id", "doc_id", "score"],
            )

    return held.mapInArrow(build, "item_id long, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` of all items, each term of an id once."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch["item_id"], batch["text"]) for t in dict.fromkeys(terms(text))]
            yield pd.DataFrame(rows, columns=["item_id", "term"]).astype({"item_id": "Int64"})

    return items.select("item_id", "text").mapInPandas(build, "item_id long, term binary").distinct()


def rank(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item with a score above 0."""
    spark = documents.sparkSession
    wanted = materialize(item_terms(items), "item-terms")
    blocks = max(1, math.ceil(wanted.count() / BLOCK_TERMS))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        vocabulary: dict[bytes, int] = {}
        listed: dict[int | None, list[int]] = {}
        for item_id, term in wanted.where(block_of == block).toLocalIterator():
            listed.setdefault(item_id, []).append(vocabulary.setdefault(bytes(term), len(vocabulary)))
        if not listed:
            continue
        held = materialize(vectors(documents, vocabulary), "term-vectors")
        n_documents, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        if not n_documents:
            break
        counts = np.zeros(len(vocabulary), np.int64)
        for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            counts[term] = df
        weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for df in counts.tolist()], np.int64)
        work = groups([Item(i, np.array(t, np.int64)) for i, t in listed.items()], counts)
        m = F.expr(f"10L + (90L * n * {n_documents}L) div {n_terms}L").alias("m")
        matching = held.where(F.size("terms") > 0).select("doc_id", m, "terms", "tfs")
        found = found.unionByName(materialize(search_block(matching, work, weights, k), "best-documents"))
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL_TEXT = f"""
WITH numbered AS (SELECT row_number() OVER () AS place, doc_id, text FROM documents),
words AS (SELECT place, doc_id, unnest({_WORDS}) AS term FROM numbered),
found AS (SELECT place, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT place, CAST(sum(tf) AS BIGINT) AS n FROM found GROUP BY place),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS words FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM found, totals GROUP BY term, documents),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark)),
scored AS (
  SELECT item_id, f.place, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // words)))) AS BIGINT) AS score
  FROM wanted JOIN found f USING (term) JOIN weights USING (term) JOIN sizes USING (place), totals
  GROUP BY item_id, f.place, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
         doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
