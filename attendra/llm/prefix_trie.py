"""Prefix trie of conversations from sorted matrices of turn ids.

Every conversation is a path of turns (role and text); each distinct sequence of
first turns is a node, from the root without text. The trie is not built by
joins per depth but read off the sorted conversations:

1. A turn becomes a digest and the length of its text; texts travel no further. The
   digests of a conversation, joined, are its path, which sorts as the sequence
   of turns does.
2. Conversations are dealt to shards by ranges of (path, conv_id), so a shard holds
   neighbours and many copies of one conversation are split by their ids.
3. In a shard, digests become small integers and conversations rows of padded
   matrices, ``WIDTH`` turns wide, which hold only the rows long enough. ``lexsort``
   orders the rows; a mask of columns that differ from the row above, OR-accumulated
   along the row, marks where a node starts at each depth, and ``reduceat`` gives the
   members, smallest id and ends of all nodes of a depth at once. Nodes in order of
   (first row, depth) are in preorder, so sums over subtrees are differences of
   one running sum.
4. Nodes that reach over a shard's edge, as told by the turns that neighbouring
   shards have in common, are given out in parts and put together by their key;
   their own values are then added to the nodes above them.

Order and awkward rows: turns go by number, null first, equal numbers by digest. A
null role or text is empty. Rows without a conv_id belong to no conversation and
are left out. Repeated rows are turns of their own. Extra columns are ignored. An
empty table gives no node, not even a root. Two turns are one where their MD5 agrees.

Memory: a task holds one shard of about ``SHARD_TURNS`` turns, or one longer
conversation at 36 bytes a turn. The digest of a node's ends reads the ids in order,
which SHA-256 needs; it streams them in pieces of one shard each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attendra.sources.storage import materialize

#: Turns and conversations of one shard.
SHARD_TURNS = 500_000
#: Columns of one matrix.
WIDTH = 64
#: Characters of a turn's digest.
DIGEST = 32
NO_ENDS = sha256(b"").hexdigest()

_NODES = (
    "conv_id long, depth long, parent_conv_id long, parent_key string, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, key string, chars long, shard int, ends string, above array<string>"
)
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` (digest and text length, in order) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).alias("chars")).alias("one"),
    )
    grouped = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: t.dropFields("turn")).alias("turns"))


def with_shared_starts(whole: DataFrame, every: int = 100, longest: int = 5) -> DataFrame:
    """Conversations rebuilt on the start of another one.

    Conversation c takes its first ``crc32(c) % (longest + 1)`` turns from c - c % ``every``
    (all it has if fewer, none if there is no such conversation) and keeps its own later ones.
    """
    heads = whole.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, longest).alias("head")
    )
    n = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    none = F.slice("turns", 1, 0)
    joined = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    start = F.slice(F.coalesce("head", none), F.lit(1), n.cast("int"))
    rest = F.slice("turns", (n + 1).cast("int"), F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(start, rest).alias("turns"))


class Rows:
    """Conversations of one shard in path order, as flat turn ids."""

    def __init__(self, conv: np.ndarray, paths: list[str], chars: np.ndarray):
        lengths = np.array([len(p) // DIGEST for p in paths], np.int64)
        starts = np.cumsum(lengths) - lengths
        digests = np.frombuffer("".join(paths).encode(), f"S{DIGEST}")
        self.flat = np.unique(digests, return_inverse=True)[1].astype(np.int32)
        self.chars = chars
        self.conv, self.lengths, self.starts = conv, lengths, starts
        order = self._sorted()
        self.conv, self.lengths, self.starts = conv[order], lengths[order], starts[order]
        self.path_of = lambda row: paths[order[row]]

    def matrix(self, rows: np.ndarray, begin: int) -> np.ndarray:
        """Turn ids of ``rows`` from depth ``begin`` on, -1 behind the last turn."""
        have = np.minimum(self.lengths[rows] - begin, WIDTH)
        place = np.arange(have.max())
        inside = place < have[:, None]
        out = np.full(inside.shape, -1, np.int32)
        out[inside] = self.flat[((self.starts[rows] + begin)[:, None] + place)[inside]]
        return out

    def _sorted(self) -> np.ndarray:
        """Order by turns, then conv_id: from the last columns to the first, each step keeping ties."""
        order = np.argsort(self.conv, kind="stable")
        for begin in reversed(range(0, int(self.lengths.max(initial=0)), WIDTH)):
            longer = self.lengths[order] > begin
            rows = order[longer]
            by_turns = np.lexsort(self.matrix(rows, begin).T[::-1])
            order = np.concatenate((order[~longer], rows[by_turns]))
        return order

    def depths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per depth: the depth, rows that are so long, places in them where a node starts, text lengths of the nodes."""
        differs = np.zeros(len(self.conv), bool)  # from the row above, in the turns seen so far
        differs[:1] = True
        for begin in range(0, int(self.lengths.max(initial=0)), WIDTH):
            rows = np.flatnonzero(self.lengths > begin)
            ids = self.matrix(rows, begin)
            change = np.ones(ids.shape, bool)
            change[1:] = (ids[1:] != ids[:-1]) | (np.diff(rows) != 1)[:, None]
            change = np.logical_or.accumulate(change, axis=1) | differs[rows][:, None]
            for column in range(ids.shape[1]):
                there = ids[:, column] >= 0
                here = rows[there]
                first = np.flatnonzero(change[there, column])
                yield begin + column + 1, here, first, self.chars[self.starts[here[first]] + begin + column]
            differs[rows] = change[:, -1]


def subtree(values: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Sums over subtrees of nodes in preorder; ``after`` is the place behind each node's last one."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[after] - total[:-1]


def shard_nodes(rows: Rows, shard: int, left: int, right: int) -> pd.DataFrame:
    """Nodes of one shard; those within ``left`` or ``right`` turns of its edges, and the root, in parts."""
    n = len(rows.conv)
    levels = [(0, np.zeros(1, np.int64), np.array([n]), rows.conv.min()[None], (rows.lengths == 0).sum()[None], np.zeros(1, np.int64), [-1])]
    for depth, here, first, chars in rows.depths():
        above = levels[-1][1]
        begin, last = here[first], here[np.append(first[1:], len(here)) - 1]
        levels.append(
            (
                depth,
                begin,
                last + 1,
                np.minimum.reduceat(rows.conv[here], first),
                np.add.reduceat((rows.lengths[here] == depth).astype(np.int64), first),
                chars,
                np.searchsorted(above, begin, side="right") - 1,
            )
        )
    sizes = [len(level[1]) for level in levels]
    offset = np.cumsum([0, *sizes])
    depth = np.repeat([level[0] for level in levels], sizes)
    begin, end, conv, ended, chars, parent = (np.concatenate([level[i] for level in levels]) for i in range(1, 7))
    parent = parent + np.repeat([0, *offset[:-2]], sizes)
    order = np.lexsort((depth, begin))
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    depth, begin, end, conv, ended, chars = (a[order] for a in (depth, begin, end, conv, ended, chars))
    parent = back[parent[order]]
    parent[0] = 0
    edge = ((begin == 0) & (depth <= left)) | ((end == n) & (depth <= right)) | (depth == 0)
    # Values of nodes at an edge are known only when their parts have met.
    children = np.bincount(parent[1:][~edge[1:]], minlength=len(order))
    members = end - begin
    after = np.searchsorted(begin, end, side="left")
    out = pd.DataFrame(
        {
            "conv_id": conv,
            "depth": depth,
            "parent_conv_id": pd.array(conv[parent], "Int64"),
            "parent_key": None,
            "n_convs": members,
            "n_children": children,
            "n_leaves": subtree(np.where(edge, 0, ended == members), after),
            "saved_tokens": subtree(np.where(edge, 0, (members - 1) * chars), after),
            "ends_sha256": NO_ENDS,
            "key": None,
            "chars": chars,
            "shard": shard,
            "ends": None,
            "above": None,
        }
    )
    ids = rows.conv.tolist()
    text = {at: ",".join(map(str, ids[begin[at] : begin[at] + ended[at]])) for at in np.flatnonzero(ended).tolist()}
    hashes = {at: sha256(ends.encode()).hexdigest() for at, ends in text.items() if not edge[at]}
    out["ends_sha256"] = [hashes.get(at, NO_ENDS) for at in range(len(out))]
    chains = {0: [""]}  # the root's key
    for at in np.flatnonzero(edge).tolist()[1:]:
        chain = chains[parent[at]]
        mine = rows.path_of(begin[at])[(depth[at] - 1) * DIGEST : depth[at] * DIGEST]
        chains[at] = [*chain, md5((chain[-1] + mine).encode()).hexdigest()]
    out["key"] = [chains[at][-1] if at in chains else None for at in range(len(out))]
    out["above"] = [chains.get(at) for at in range(len(out))]
    out["ends"] = [text.get(at) if at in chains else None for at in range(len(out))]
    out["parent_key"] = [chains[p][-1] if p in chains and at else None for at, p in enumerate(parent.tolist())]
    return out


def _common(a: pd.Series, b: pd.Series) -> list[int]:
    out = []
    for one, two in zip(a, b):
        most = min(len(one), len(two)) // DIGEST if one is not None else 0
        out.append(next((d for d in range(most) if one[d * DIGEST : (d + 1) * DIGEST] != two[d * DIGEST : (d + 1) * DIGEST]), most))
    return out


def edges(sharded: DataFrame) -> dict[int, tuple[int, int]]:
    """Turns that each shard's first and last path share with the neighbours: two numbers a shard."""
    ends = sharded.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    before = F.lag("high").over(Window.orderBy("shard"))
    common = F.pandas_udf(lambda a, b: pd.Series(_common(a, b), dtype="int64"), "long")
    found = ends.withColumn("before", before).select("shard", common("before", "low").alias("left")).orderBy("shard").collect()
    lefts = [row["left"] for row in found]
    return {row["shard"]: (row["left"], right) for row, right in zip(found, [*lefts[1:], 0])}


def end_digests(parts: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the ids of all parts in shard order, streamed."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            done = []
            for one, ends in zip(batch["key"], batch["ends"]):
                if one == key:
                    digest.update(b",")
                else:
                    if digest:
                        done.append((key, digest.hexdigest()))
                    key, digest = one, sha256()
                digest.update(ends.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if digest:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])

    listed = parts.where("ends IS NOT NULL").select("key", "shard", "ends")
    return listed.repartition("key").sortWithinPartitions("key", "shard").mapInPandas(build, "key string, ends_sha256 string")


def recombine(parts: DataFrame) -> DataFrame:
    """Whole nodes from their parts in several shards, one row per key."""
    whole = materialize(
        parts.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"),
            F.first("depth").alias("depth"),
            F.first("parent_key").alias("parent_key"),
            F.first("above").alias("above"),
            F.first("chars").alias("chars"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        ),
        "edge-nodes",
    )
    split = whole.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    counted = whole.join(split, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = counted.select(
        F.explode("above").alias("key"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    below = own.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    joined = counted.join(below, "key").join(end_digests(parts), "key", "left").join(parents, "parent_key", "left")
    return joined.select(
        "key",
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def nodes(paths: DataFrame) -> DataFrame:
    """All trie nodes of ``paths`` (``conv_id, turns`` as by ``sequences``; ids are distinct), root included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (text that sharing saves in the subtree) and
    ``ends_sha256`` (of the ids that end at the node, ascending, joined by commas).
    """
    spark = paths.sparkSession
    flat = paths.select(
        "conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.chars").alias("chars")
    )
    size = paths.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(math.ceil(size / SHARD_TURNS), spark.sparkContext.defaultParallelism)
    dealt = flat.repartitionByRange(shards, "path", "conv_id")
    sharded = materialize(dealt.withColumn("shard", F.spark_partition_id()), "trie-shards")
    shared = edges(sharded)

    def build(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        chars = table["chars"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        found = shard_nodes(Rows(table["conv_id"].to_numpy(), table["path"].to_pylist(), chars), shard, *shared[shard])
        return pa.Table.from_pandas(found, schema=ARROW_NODES, preserve_index=False)

    found = materialize(sharded.groupBy("shard").applyInArrow(build, _NODES), "trie-nodes")
    whole = materialize(recombine(found.where("key IS NOT NULL")), "edge-nodes")
    inner = found.where("key IS NULL")
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("whole_parent"))
    hung = inner.where("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv_id", F.col("whole_parent"))
    return (
        inner.where("parent_key IS NULL").select(COLUMNS).unionByName(hung.select(COLUMNS)).unionByName(whole.select(COLUMNS))
    )


ARROW_NODES = pa.schema(
    [
        *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id")),
        ("parent_key", pa.string()),
        *((c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        ("ends_sha256", pa.string()),
        ("key", pa.string()),
        ("chars", pa.int64()),
        ("shard", pa.int32()),
        ("ends", pa.string()),
        ("above", pa.list_(pa.string())),
    ]
)

#: CRC-32 bit by bit over the decimal id; paths as lists of digests.
SQL_TEXT = """
WITH turns AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'digest': digest, 'chars': chars} ORDER BY turn NULLS FIRST, digest) AS turns
  FROM turns GROUP BY conv_id),
cut AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base,
         xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
           lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
         ), 4294967295) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM cut c LEFT JOIN own b ON b.conv_id = c.base),
steps AS (
  SELECT conv_id, d AS depth, len(turns) = d AS ends, turns[1:d] AS path,
         CASE WHEN d = 0 THEN 0 ELSE turns[d].chars END AS chars
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
found AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY path, depth),
shaped AS (
  SELECT a.path, count(b.path) AS n_children
  FROM found a LEFT JOIN found b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path GROUP BY a.path),
summed AS (
  SELECT a.path, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (s.n_children = 0) AS n_leaves
  FROM found a JOIN found b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path JOIN shaped s ON s.path = b.path
  GROUP BY a.path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, s.n_children, t.n_leaves, t.saved_tokens, f.ends_sha256
FROM found f JOIN shaped s ON s.path = f.path JOIN summed t ON t.path = f.path
LEFT JOIN found p ON p.depth = f.depth - 1 AND f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""
