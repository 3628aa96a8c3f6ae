from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from attendra.llm import lexical_search
from attendra.llm.lexical_search import Best, Item, Trie, groups, rank, terms

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document against every item, as the module states it."""
    found = [(i, Counter(words(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for doc_id, c, n in found:
            m = 10 + (90 * n * n_docs) // total
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for place, (score, _, doc_id) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((i, place, doc_id, -score))
    return sorted(out, key=str)


def made(seed, n, words_each=30):
    pick = random.Random(seed)
    vocabulary = [f"w{int(pick.paretovariate(0.6))}" for _ in range(3000)]
    return [" ".join(pick.choice(vocabulary) for _ in range(pick.randrange(1, words_each))) for _ in range(n)]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"),
    )


def test_terms_follow_the_pattern():
    pick = random.Random(3)
    odd = [chr(c) for c in range(128)] + list("éÀ中😀\x80\xa0 İ")
    for _ in range(500):
        text = "".join(pick.choice(odd) for _ in range(20))
        assert [t.decode() for t in terms(text)] == words(text)


@pytest.mark.parametrize("leaf, trie_terms, cells, block", [(32, 4096, 1 << 24, 200_000), (2, 5, 64, 40), (1, 1, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, leaf, trie_terms, cells, block):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "TRIE_TERMS", trie_terms)
    monkeypatch.setattr(lexical_search, "TRIE_CELLS", cells)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    docs = list(enumerate(made(1, 60 if leaf == 1 else 300)))
    docs += [(1000 - i, "the same copy w1 w2 of one text") for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (None, "the same copy w1 w2 of one text"), (2000, None), (2001, ""), (2002, " .,; ")]
    items = list(enumerate(made(2, 4 if leaf == 1 else 25, 12)))
    items += [(3, "copy"), (100, "The SAME copy, of one text!"), (101, None), (102, "nowhere-to-be-found zzz"), (None, "w1 copy")]
    spark_docs, spark_items = frames(spark, docs, items)
    got = rank(spark_docs, spark_items, k=5)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k=5)


def test_long_texts_and_large_frequencies(spark):
    docs = [(1, "w " * 200_000 + "v"), (2, "v " * 3), (3, "x" * 100_000), (4, "w")]
    items = [(1, "w v"), (2, "x" * 100_000), (3, " ".join(f"t{i}" for i in range(9000)) + " v")]
    assert sorted(map(tuple, rank(*frames(spark, docs, items)).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    none = docs.where("false")
    assert rank(none, items).count() == 0
    assert rank(docs, items.where("false")).count() == 0
    assert rank(frames(spark, [(1, None)], [(1, "a")])[0], items).count() == 0


def test_bounds_skip_subtrees():
    """Planted documents are found while most of the trie is never looked at."""
    pick = random.Random(5)
    topics = [[f"{c}{i}" for i in range(40)] for c in "abcdefgh"]
    docs = [[pick.choice(topics[d % 8]) for _ in range(30)] for d in range(4000)]
    vocabulary = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    counts = np.bincount([vocabulary[w] for d in docs for w in set(d)], minlength=len(vocabulary))
    item = Item(1, np.array(sorted({vocabulary[w] for w in docs[17]})))
    everything = Item(2, np.arange(len(vocabulary)))
    group = groups([item, everything], counts)[0]
    cells = sorted((r, int(group.place[vocabulary[w]]), n) for r, d in enumerate(docs) for w, n in Counter(d).items())
    rows, columns, tf = map(np.array, zip(*cells))
    ids = np.arange(len(docs))
    trie = Trie(rows, columns, tf, len(docs), group.width, np.full(len(docs), 100), ids, np.zeros(len(docs), bool))
    best = Best(3)
    seen = trie.search(group.place[item.terms], np.full(len(item.terms), 1000), best)
    assert best.id[0] == 17
    assert seen < len(trie.low) / 3
