from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from attendra.llm import prefix_trie
from attendra.llm.prefix_trie import Rows, nodes, sequences, with_shared_starts

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def ordered(rows):
    """Turns (role, text) of every conversation in the module's order."""
    whole = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            whole[conv].append((turn is not None, turn or 0, md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in whole.items()}


def rebuilt(whole):
    out = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = whole.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        saved[node] = own + sum(saved[c] for c in children[node])
        ends = ",".join(str(c) for c in members[node] if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append(
            (members[node][0], len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def tries(df):
    return sorted(map(tuple, df.select(prefix_trie.COLUMNS).collect()), key=str)


def made(seed, n, longest=7, words=3):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        c = c if c % 17 else c * 100
        for turn in range(pick.randrange(1, longest)):
            rows.append((c, turn, pick.choice(["user", "assistant"]), "é" * pick.randrange(words)))
    return rows


@pytest.mark.parametrize("width, shard", [(64, 500_000), (2, 40), (1, 7)])
def test_random_conversations_equal_brute_force(spark, monkeypatch, width, shard):
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    rows = made(width, 150 if shard > 7 else 25)
    # One conversation copied many times, so that its nodes reach over several shards.
    rows += [(c, t, "user", f"copy {t}") for c in range(5000, 5060 if shard > 7 else 5015) for t in range(4)]
    whole = sequences(frame(spark, rows))
    plain = ordered(rows)
    assert tries(nodes(whole)) == brute(plain)
    assert tries(nodes(with_shared_starts(whole))) == brute(rebuilt(plain))


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"),
        (1, None, "user", "first"),
        (1, 0, None, None),
        (1, 0, None, None),
        (1, 5, "b", "tie"),
        (1, 5, "a", "tie"),
        (2, 9, "", ""),
        (-5, 1, "user", "negative"),
        (3, 1, "us", "er"),
        (4, 1, "u", "ser"),  # the same letters, another turn
        (200, 3, "user", "x" * 50_000),
        (206, 1, "a", "own 1"),
    ]
    whole = sequences(frame(spark, rows))
    assert tries(nodes(whole)) == brute(ordered(rows))
    assert dict(nodes(whole).dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in prefix_trie.COLUMNS}


def test_turnless_conversations_end_at_the_root(spark):
    # Without the base conversation, those whose own turns all fall away have none left.
    rows = [(c, t, "user", f"{c} {t}") for c in range(1001, 1040) for t in range(2)]
    paths = rebuilt(ordered(rows))
    assert any(not p for p in paths.values())
    assert tries(nodes(with_shared_starts(sequences(frame(spark, rows))))) == brute(paths)


def test_long_conversations(spark):
    rows = [(c, t, "user", str(t if t < 150 + 40 * c else (c, t))) for c in range(3) for t in range(300)]
    assert tries(nodes(sequences(frame(spark, rows)))) == brute(ordered(rows))


def test_empty_table_gives_no_root(spark):
    none = frame(spark, [(1, 1, "a", "b")]).where(F.lit(False))
    assert nodes(with_shared_starts(sequences(none))).count() == 0


def test_matrices_hold_only_long_enough_rows(monkeypatch):
    monkeypatch.setattr(prefix_trie, "WIDTH", 4)
    turn = [md5(str(i).encode()).hexdigest() for i in range(40)]
    paths = ["".join(turn[:n]) for n in (40, 1, 1, 5)]
    rows = Rows(np.array([4, 3, 2, 1]), paths, np.ones(47, np.int64))
    assert rows.conv.tolist() == [2, 3, 1, 4]  # shorter first, equal ones by id
    assert rows.matrix(np.flatnonzero(rows.lengths > 8), 8).shape == (1, 4)
    assert sum(len(first) for _, _, first, _ in rows.depths()) == 40
