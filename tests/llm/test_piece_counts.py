from __future__ import annotations

import os
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from attendra.llm import piece_counts
from attendra.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
BITS = "a|b|th| |  |\n|\t|▁|.|é|中|😀|12|<s>|</s>|<0x0A>|<unk>|\x00|ﬁ|--| the|ing|́|﻿".split("|")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    return piece_counts.Counter(MODEL, piece_counts.prove(MODEL))


def test_random_texts_equal_the_library(library, counter):
    pick = random.Random(7)
    texts = ["".join(pick.choice(BITS) for _ in range(pick.randrange(14))) for _ in range(5000)]
    assert counter.counts(texts) == [len(library.encode(t)) for t in texts]


def test_very_long_words_and_blanks(library, counter):
    texts = ["a" * 50_000, " " * 30_000, "中文" * 20_000, "th e" * 20_000, "=\n" * 5000]
    assert counter.counts(texts) == [len(library.encode(t)) for t in texts]
    assert all(len(w) <= piece_counts.LONGEST for w in counter.known)


def test_merges_equal_the_library_on_words_outside_the_vocabulary(library):
    model = library
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(259, model.get_piece_size())}
    for word in ("untokenizable", "aaaaaaaaaaa", "thethethe", "ererererer", "Donaudampfschiff"):
        assert piece_counts.merge("▁" + word, scores) == model.encode(word, out_type=str)


def test_proven_strings_are_single_tokens(library):
    alone = piece_counts.prove(MODEL)
    some = [p for p in sorted(alone) if p.startswith("▁") and p != "▁"][::7]
    assert all(len(ids) == 1 for ids in library.encode([p[1:] for p in some]))


def test_models_of_another_kind_are_refused():
    class Lower:
        def normalize(self, text):
            return "▁" + text.replace(" ", "▁").lower()

    with pytest.raises(ValueError, match="normalizer"):
        piece_counts.check_plain(Lower())


def test_columns_nulls_and_empty_tables(spark):
    rows = [(1, "a  b", 5), (1, "a  b", 5), (None, None, 6), (2, "", 7), (3, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    found = piece_counts.with_counts(docs, MODEL, limit=2).collect()
    by_text = {(r["doc_id"], r["text"]): (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found}
    assert by_text[(None, None)] == (0, 0, False) and by_text[(2, "")] == (0, 0, False)
    assert by_text[(1, "a  b")] == (4, 3, True) and len(found) == 5
    assert piece_counts.with_counts(docs.where(F.lit(False)), MODEL, limit=2).count() == 0


def test_query_equals_the_library(spark, library):
    table = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {}
    for row in table:
        text = row["text"] or ""
        n = len(library.encode(text))
        want[row["doc_id"]] = (len(text.encode()), n, n > 4096)
    df = QUERIES["op12_piece_counts"](spark, FOLDER)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert {r["doc_id"]: tuple(r)[1:] for r in df.collect()} == want
