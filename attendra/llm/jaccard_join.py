"""Exact n-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct five-word shingles. Equal sets
are one node from the start. Two sets that link share a shingle among the first
quarter of either (in one global order: shingles frequent in the corpus last, so
that common passages bring few documents together). Documents with such a
shingle in common form a tree each:

* leaf nodes are grown first: the partners of a tree's least document form a tree
  by size, whose nodes are traversed against that document; the pairs left are
  verified on the full sets, and linked documents become clusters;
* where a tree still holds several clusters, inner nodes hold the OR of their
  members' token bitmaps, the range of set sizes and of clusters. A dual
  traversal drops pairs of nodes whose largest possible overlap is too small,
  whose sizes differ too much, or which lie in one cluster;
* surviving pairs are verified on the full sets: first the most promising few
  of each pair of clusters, whose links merge clusters, then all that is left
  between different clusters. No link between components is lost.

``group`` gives classes; ``links`` gives every link between different sets, by a
traversal that drops no pair for being in one cluster, and ``linked`` counts them.

Trees over ``TREE_ROWS`` documents are split into blocks that meet pairwise.

Null texts have no shingles, like texts without words; they are their own
component. A null doc_id takes part in no link and gets a null component. Of
rows with one doc_id but different texts, the one with the least hash counts;
all rows of the id get its component. Hashes have 64 bits (128 for whole sets).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attendra.llm.common import discard
from attendra.llm.graph import components
from attendra.sources.storage import materialize

WORDS = 5
#: Two sets link at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bits per token of a bitmap, at least, and its least width. Sets that can link
#: have widths that differ by a factor of two at most.
BITS_PER_TOKEN = 4
LEAST_BITS = 2048
#: Shingles counted at once when frequent ones are sought, and how often one
#: must occur there. Frequent shingles only change the order, never the result.
COUNT_AT_ONCE = 8_000_000
OFTEN = 3
MOST_FREQUENT = 400_000
TREE_ROWS = 1024
FANOUT = 8
FIRST_PAIRS = 8
#: Ids of nodes to verify that may be broadcast (24 bytes each).
BROADCAST_IDS = 500_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes. Blanks of ASCII part words, A-Z become a-z."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n < WORDS:
        whole = [xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else []
        return np.array(whole, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    count = n - WORDS + 1
    found = each[:count].copy()
    for k in range(1, WORDS):
        found *= np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
        found += each[k : k + count]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(29)
    return np.unique(found)


def needed(total: np.ndarray | int) -> np.ndarray | int:
    """Least intersection of two linking sets with ``total`` elements in both."""
    return -(-PERCENT * total // (100 + PERCENT))


def frequent_shingles(documents: DataFrame) -> np.ndarray:
    """Up to ``MOST_FREQUENT`` shingle hashes, rarest first, found by counting in pieces."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def counted() -> pd.DataFrame:
            value, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= OFTEN
            return pd.DataFrame({"h": value[often].view(np.int64), "times": times[often]})

        for batch in batches:
            for text in batch["text"]:
                held.append(shingles(text))
                size += len(held[-1])
                if size >= COUNT_AT_ONCE:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = documents.select("text").mapInPandas(count, "h long, times long").groupBy("h").agg(F.sum("times").alias("times"))
    rows = counts.orderBy(F.desc("times"), "h").limit(MOST_FREQUENT).toPandas()
    return rows["h"].to_numpy(np.int64)[::-1].view(np.uint64)


def leading(found: np.ndarray, frequent: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """The first elements of a set, one of which any linking set has in front too.

    Rare ones come first; their number is returned with them.
    ``frequent`` is sorted by hash, ``order`` holds its places by frequency.
    """
    n = len(found)
    size = n - -(-PERCENT * n // 100) + 1 if n else 0
    if not len(frequent):
        return found[:size], size
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    common = frequent[at] == found
    rare = found[~common]
    if len(rare) >= size:
        return rare[:size], size
    late = found[common][np.argsort(order[at[common]], kind="stable")]
    return np.concatenate([rare, late])[:size], len(rare)


def bitmap(found: np.ndarray) -> bytes:
    width = LEAST_BITS
    while width < BITS_PER_TOKEN * len(found):
        width *= 2
    bits = np.zeros(width, bool)
    bits[found & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def keys(found: np.ndarray) -> tuple[int, int]:
    data = found.tobytes()
    return tuple(np.array([xxhash.xxh3_64_intdigest(data), xxhash.xxh64_intdigest(data, seed=7)], np.uint64).view(np.int64).tolist())


def described(documents: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per row: size and key of its set, its leading shingles and its bitmap."""
    kind = dict(documents.dtypes)["doc_id"]
    by_hash = np.argsort(frequent, kind="stable")
    frequent, order = frequent[by_hash], by_hash

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text)
                front, rare = leading(found, frequent, order)
                rows.append((len(found), *keys(found), front.view(np.int64), rare, bitmap(found)))
            frame = pd.DataFrame(rows, columns=["n", "k1", "k2", "front", "rare", "bits"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), frame], axis=1)

    return documents.select("doc_id", "text").mapInPandas(
        build, f"doc_id {kind}, n long, k1 long, k2 long, front array<long>, rare int, bits binary"
    )


def full_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, set`` of the nodes in ``ids`` (``id, k1, k2``), made anew from their texts.

    The ids are broadcast only where counted to be few; texts then stay in place.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t) for t in batch["text"]]
            same = [keys(f) == k for f, k in zip(found, zip(batch["k1"], batch["k2"]))]
            yield pd.DataFrame({"id": batch["doc_id"], "set": [f.tobytes() for f in found]})[same]

    wanted = ids.withColumnRenamed("id", "doc_id")
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted
    return documents.select("doc_id", "text").join(wanted, "doc_id").mapInPandas(build, f"id {kind}, set binary")


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sizes and bitmaps leave room for a link."""
    kind = dict(nodes.dtypes)["id"]
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            width = np.minimum(batch["bitsa"].map(len), batch["bitsb"].map(len)).to_numpy()
            for one_width in np.unique(width):
                part = batch[width == one_width]
                centre, members = (leaves(part[f"bits{c}"], part[f"n{c}"], part[c], one_width) for c in "ab")
                keep, _ = star_traversal(part["a"].to_numpy(np.int64), centre, members)
                yield part.iloc[keep][["a", "b"]]

    met = pairs.join(side("b"), "b").join(side("a"), "a")
    near = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    # Partners of one document lie together, by size; a split of a hot one gives several trees.
    rows = met.where(near).select("a", "b", "na", "nb", "bitsa", "bitsb").sortWithinPartitions("a", "nb", "b")
    return rows.mapInPandas(check, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (``a, b``) that link, by their full sets."""
    kind = dict(nodes.dtypes)["id"]
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(nodes.select("id", "k1", "k2").join(ids, "id", "left_semi"), "set-ids")
    sets = materialize(full_sets(documents, wanted), "sets")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = []
            for one, other in zip(batch["set_a"], batch["set_b"]):
                both = np.concatenate([np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                links.append(100 * shared >= PERCENT * (len(both) - shared))
            yield batch.loc[links, ["a", "b"]]

    with_sets = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"
    )
    return materialize(with_sets.select("a", "b", "set_a", "set_b").mapInPandas(check, f"a {kind}, b {kind}"), "links")


#: Of every node: bitmap, least and largest size, largest excess of tokens over
#: bits, least and largest cluster.
Level = tuple[np.ndarray, ...]


def leaves(bits, n, cluster, width: int) -> Level:
    """Members with their bitmaps folded to ``width`` bytes."""
    bits = list(bits)
    rows = np.empty((len(bits), width // 8), np.uint64)
    for at, one in enumerate(bits):
        row = np.frombuffer(one, np.uint64)
        while len(row) > width // 8:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        rows[at] = row
    n, cluster = np.asarray(n, np.int64), np.asarray(cluster, np.int64)
    excess = n - np.bitwise_count(rows).sum(1).astype(np.int64)
    return rows, n, n, excess, cluster, cluster


def grown(members: Level) -> list[Level]:
    """Levels of a tree over members sorted by cluster and size; level 0 are the members."""
    levels = [members]
    how = np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum
    while len(levels[-1][1]) > 1:
        cuts = np.arange(0, len(levels[-1][1]), FANOUT)
        levels.append(tuple(f.reduceat(v, cuts, axis=0) for f, v in zip(how, levels[-1])))
    return levels


def surviving(one: Level, other: Level) -> tuple[np.ndarray, np.ndarray]:
    """Of node pairs, whether they may hold a link, and the largest overlap possible.

    Shared tokens fall on shared bits; a bit holds more than one token of a set
    only as often as that set has more tokens than bits.
    """
    bits_a, low_a, high_a, excess_a, c_low_a, c_high_a = one
    bits_b, low_b, high_b, excess_b, c_low_b, c_high_b = other
    overlap = np.bitwise_count(bits_a & bits_b).sum(1).astype(np.int64) + np.minimum(excess_a, excess_b)
    fits = (100 * high_a >= PERCENT * low_b) & (100 * high_b >= PERCENT * low_a)
    apart = (c_low_a != c_high_a) | (c_low_b != c_high_b) | (c_low_a != c_low_b)
    return fits & apart & (overlap >= needed(low_a + low_b)), overlap


def star_traversal(star: np.ndarray, centre: Level, members: Level) -> tuple[np.ndarray, int]:
    """Members that may link with the centre of their star, and the number of node pairs visited.

    ``star`` is equal along each run of members of one star; each run forms a tree. ``centre`` has
    the star's document once per member. A node that cannot link takes all below it along.
    """
    how = np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum
    levels, heads, above = [members], [np.arange(len(star))], []
    new = np.append(True, star[1:] != star[:-1])[: len(star)]
    while not new.all():
        along = np.arange(len(new))
        cut = new | ((along - np.maximum.accumulate(np.where(new, along, 0))) % FANOUT == 0)
        cuts = np.flatnonzero(cut)
        levels.append(tuple(f.reduceat(v, cuts, axis=0) for f, v in zip(how, levels[-1])))
        heads.append(heads[-1][cuts])
        above.append(np.cumsum(cut) - 1)
        new = new[cuts]
    alive, visited = np.ones(len(new), bool), 0
    for level in range(len(levels) - 1, -1, -1):
        if level < len(above):
            alive = alive[above[level]]
        at = np.flatnonzero(alive)
        visited += len(at)
        alive[at], _ = surviving(tuple(v[heads[level][at]] for v in centre), tuple(v[at] for v in levels[level]))
    return np.flatnonzero(alive), visited


def dual_traversal(one: list[Level], other: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of ``one`` and ``other`` that may link, with their largest overlap."""
    same = one is other
    top = max(len(one), len(other)) - 1
    x = y = np.zeros(1, np.int64)
    overlap = np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        at = [min(level, len(tree) - 1) for tree in (one, other)]
        if level < top:
            x, y = expanded(x, y, *(tree[k] if k == level else None for tree, k in zip((one, other), at)))
            if same:
                x, y = x[x <= y], y[x <= y]
        keep, overlap = surviving(tuple(v[x] for v in one[at[0]]), tuple(v[y] for v in other[at[1]]))
        if same and level == 0:
            keep &= x != y
        x, y, overlap = x[keep], y[keep], overlap[keep]
        if not len(x):
            break
    return x, y, overlap


def expanded(x: np.ndarray, y: np.ndarray, one: Level | None, other: Level | None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children; None keeps the node of a tree that is lower."""
    step = np.arange(FANOUT)
    a = x[:, None] if one is None else x[:, None] * FANOUT + step
    b = y[:, None] if other is None else y[:, None] * FANOUT + step
    shape = len(x), a.shape[1], b.shape[1]
    a, b = np.broadcast_to(a[:, :, None], shape).ravel(), np.broadcast_to(b[:, None, :], shape).ravel()
    real = np.ones(len(a), bool)
    if one is not None:
        real &= a < len(one[1])
    if other is not None:
        real &= b < len(other[1])
    return a[real], b[real]


def tree_pairs(
    ids: np.ndarray, bits: list[bytes], n: np.ndarray, cluster: np.ndarray, split: np.ndarray | None, best: int | None
) -> tuple[np.ndarray, bool]:
    """Candidate pairs of one tree, and whether more than ``best`` of two clusters were left out.

    Members of one bitmap width form a tree; it meets itself and the next width's.
    ``split`` marks the members of the second block where two blocks meet.
    """
    widths = np.array([len(b) for b in bits])
    sides = [np.ones(len(ids), bool)] * 2 if split is None else [~split, split]
    found = []
    for width in np.unique(widths):
        for one_width, other_width in ((width, width), (width, 2 * width), (2 * width, width)):
            if split is None and one_width > other_width:
                continue  # met the other way round
            left, right = (np.flatnonzero(side & (widths == w)) for side, w in zip(sides, (one_width, other_width)))
            if not len(left) or not len(right):
                continue
            one = grown(leaves([bits[k] for k in left], n[left], cluster[left], width))
            same = split is None and one_width == other_width
            other = one if same else grown(leaves([bits[k] for k in right], n[right], cluster[right], width))
            x, y, overlap = dual_traversal(one, other)
            found.append((left[x], right[y], overlap))
    x, y, overlap = (np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    cut = False
    if best is not None and len(x) > best:
        c, d = np.minimum(cluster[x], cluster[y]), np.maximum(cluster[x], cluster[y])
        order = np.lexsort((y, x, -overlap / (n[x] + n[y]), d, c))
        x, y, c, d = x[order], y[order], c[order], d[order]
        new = np.append(True, (c[1:] != c[:-1]) | (d[1:] != d[:-1]))
        place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        cut = bool((place >= best).any())
        x, y = x[place < best], y[place < best]
    pairs = ids[np.column_stack([x, y])].reshape(-1, 2)
    return np.sort(pairs, axis=1), cut


def mixed_trees(shared: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows (``h, id, cluster``) of the trees that hold more than one cluster, each tree once."""
    placed = shared.join(clusters, "id", "left").select("h", "id", F.coalesce("cluster", "id").alias("cluster"))
    hashed = F.xxhash64("id")
    several = (
        placed.groupBy("h")
        .agg(
            F.min("cluster").alias("c0"),
            F.max("cluster").alias("c1"),
            F.count("*").alias("rows"),
            F.bit_xor(hashed).alias("m0"),
            F.bit_xor(F.xxhash64("id", F.lit(3))).alias("m1"),
        )
        .where("c0 < c1")
        # Many shingles bring the same documents together: one tree is enough.
        .groupBy("rows", "m0", "m1")
        .agg(F.min("h").alias("h"))
        .select("h", "rows")
    )
    return placed.join(several, "h")


def candidates(mixed: DataFrame, nodes: DataFrame, best: int | None, by: tuple[str, ...] = ("cluster", "n", "id")) -> DataFrame:
    """Pairs that the dual traversal of each tree leaves; members lie in the order ``by``."""
    blocks = F.ceil(F.col("rows") / TREE_ROWS).cast("int")
    placed = mixed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    met = placed.select("h", "id", "cluster", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("with"))
    met = met.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with")
    order = "h", "i", "j", *by
    rows = met.join(nodes.select("id", "n", "bits"), "id").repartition("h", "i", "j").sortWithinPartitions(*order)
    kind = dict(nodes.dtypes)["id"]

    def found(held: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Candidates of the trees that are whole, and the rows of the one that may go on."""
        key = held[["h", "i", "j"]].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), *([len(held)] if last else [])]
        ids, block = held["id"].to_numpy(np.int64), held["block"].to_numpy(np.int64)
        bits, n, cluster = held["bits"].tolist(), held["n"].to_numpy(np.int64), held["cluster"].to_numpy(np.int64)
        out = []
        for a, b in zip(cuts, cuts[1:]):
            h, i, j = key[a]
            pairs, cut = tree_pairs(
                ids[a:b], bits[a:b], n[a:b], cluster[a:b], None if i == j else block[a:b] == j, best
            )
            more = pd.array([h if cut else None] * len(pairs), dtype="Int64")
            out.append(pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "cut": more}) if len(pairs) else None)
        none = pd.DataFrame({"a": pd.array([], "Int64"), "b": pd.array([], "Int64"), "cut": pd.array([], "Int64")})
        return pd.concat([o for o in out if o is not None] or [none]), held.iloc[cuts[-1] :]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            done, held = found(held, False)
            yield done
        if held is not None and len(held):
            yield found(held, True)[0]

    columns = "h", "i", "j", "id", "cluster", "block", "n", "bits"
    return materialize(rows.select(*columns).mapInPandas(build, f"a {kind}, b {kind}, cut long"), "candidates")


def merged(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """``clusters`` (``id, cluster``) after the links between them."""
    up = lambda side: clusters.select(F.col("id").alias(side), F.col("cluster").alias(f"c{side}"))
    between = links.join(up("a"), "a", "left").join(up("b"), "b", "left")
    edges = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    found = components(edges)
    moved = found.select(F.col("id").alias("cluster"), F.col("component").alias("into"))
    old = clusters.join(moved, "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster"))
    new = found.select("id", F.col("component").alias("cluster")).join(clusters.select("id"), "id", "left_anti")
    return materialize(old.unionByName(new), "clusters")


def shared_fronts(nodes: DataFrame) -> DataFrame:
    """``h, id, least``: leading shingles of at least two nodes, with the least of these.

    A shingle not counted as frequent has a bounded share of the documents, so
    its rows may meet in one window. Frequent ones are counted map-side and then
    joined, where Spark splits a hot key.
    """
    fronts = nodes.select("id", "rare", F.posexplode("front").alias("pos", "h"))
    alike = Window.partitionBy("h")
    rare = (
        fronts.where("pos < rare")
        .select("h", "id", F.min("id").over(alike).alias("least"), F.max("id").over(alike).alias("most"))
        .where("least <> most")
        .drop("most")
    )
    common = fronts.where("pos >= rare").select("h", "id")
    several = common.groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    return rare.unionByName(common.join(several.drop("rows"), "h"))


def rooted(documents: DataFrame) -> tuple[DataFrame, ...]:
    """Sizes of all rows, each document's distinct set, the sets' nodes, and the rows of their trees."""
    whole = materialize(described(documents, frequent_shingles(documents)), "described")
    every = materialize(whole.select("doc_id", "n", "k1", "k2"), "set-keys")
    one_each = whole.where("doc_id is not null and n > 0")
    light = every.where("doc_id is not null and n > 0")
    if light.groupBy("doc_id").count().where("count > 1").take(1):
        least = one_each.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n", "front", "rare", "bits")).alias("s"))
        one_each = least.select("doc_id", "s.*")
        light = light.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("s")).select("doc_id", "s.*")
    same = materialize(light.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "distinct-sets")
    nodes = materialize(one_each.withColumnRenamed("doc_id", "id").join(same.select("id"), "id"), "nodes")
    discard(whole)
    copies = light.select("doc_id", "k1", "k2").join(same, ["k1", "k2"]).select("doc_id", "id")
    return every, copies, nodes, materialize(shared_fronts(nodes), "shared-shingles")


def group(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents``."""
    every, copies, nodes, shared = rooted(documents)
    stars = shared.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(materialize(promising(stars, nodes), "pairs"), nodes, documents)
    clusters = materialize(components(links).select("id", F.col("component").alias("cluster")), "clusters")
    shared = shared.select("h", "id")
    for best in (FIRST_PAIRS, None):
        found = candidates(mixed_trees(shared, clusters), nodes, best)
        pairs = found.select("a", "b").distinct()
        clusters = merged(clusters, verified(pairs, nodes, documents))
        # Only trees of which pairs were put off can hold further links.
        later = found.where("cut is not null").select(F.col("cut").alias("h")).distinct()
        if best is None or not later.take(1):
            break
        shared = materialize(shared.join(later, "h", "left_semi"), "shared-shingles")
    placed = copies.join(clusters, "id", "left").select("doc_id", F.coalesce("cluster", "id").alias("component_id"))
    sizes = every.select("doc_id", F.col("n").alias("n_shingles"))
    return sizes.join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and which documents have each set.

    The first frame has a row ``a, b`` (``a < b``) per two sets that link, each named by its least
    doc_id; the second a row ``doc_id, id`` per document with words. Documents of one set link too.
    All pairs come out of the dual traversal of the trees; the work grows with the links there are.
    """
    _, copies, nodes, shared = rooted(documents)
    alone = nodes.select("id", F.col("id").alias("cluster"))
    found = candidates(mixed_trees(shared.select("h", "id"), alone), nodes, None, ("n", "id"))
    return verified(found.select("a", "b").distinct(), nodes, documents), materialize(copies, "set-members")


def linked(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` of every document with words: the least document with its set, and
    the number of other documents it links with, copies counted each."""
    pairs, members = links(documents)
    sizes = members.groupBy("id").agg(F.count("*").alias("size"))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    others = sizes.select(F.col("id").alias("other"), F.col("size").alias("more"))
    reached = both.join(others, "other").groupBy("id").agg(F.sum("more").alias("more"))
    counted = sizes.join(reached, "id", "left").select("id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return members.join(counted, "id").select("doc_id", F.col("id").alias("class_id"), "n_links")


def keep_one(documents: DataFrame) -> DataFrame:
    """The document with the least id of each component, with all its columns.

    Of repeated rows with one id one stays; rows without an id all stay.
    """
    grouped = group(documents).select("doc_id", "component_id")
    gone = grouped.where("doc_id <> component_id").select("doc_id")
    rest = documents.join(gone, "doc_id", "left_anti").select(documents.columns)
    if not grouped.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        return rest
    return rest.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rest.where("doc_id is null"))
