"""Text operators against brute force, round trips and held-out labels, and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attendra.llm import (
    byte_bpe,
    compression_score,
    decontaminate,
    jaccard_join,
    main_text,
    quality_rules,
    site_lines,
    token_records,
    tool_calls,
    toxicity,
)
from attendra.llm.common import prepare
from attendra.llm.queries import QUERIES, SQL
from tests import oracle

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
AWKWARD = [None, "", " \n\t ", "\n\n", "one", "a b c d", "don't we'll THEY'RE", "x" * 30_000, "é中　 🎉\x1c y", "w " * 9_000]


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def awkward(spark):
    """Odd texts, repeated rows, null ids, and a column named like a statistic."""
    rows = [(k, t, None, "s1", 1, "clash") for k, t in enumerate(AWKWARD)]
    return spark.createDataFrame([*rows, *rows[4:7], (None, "a b c d e f", None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    """Columns, types and rows."""
    assert oracle.compare(QUERIES[name](spark, SMALL), oracle.connect(SMALL), SQL[name]) is None


# Token records


def expected_ids(text):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_token_records_round_trip(spark, real, awkward, tmp_path):
    for name, df in (("real", real), ("awkward", awkward)):
        folder = str(tmp_path / name)
        files = token_records.write(df, JSON, folder, file_bytes=20_000)
        rows = token_records.read(spark, folder).orderBy("part", "file", "place").collect()
        source = df.orderBy("doc_id", "text").collect()
        assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in source]
        assert [r["ids"] for r in rows] == [expected_ids(r["text"]) for r in source]
        digests = token_records.digests(spark, folder, files).orderBy("start").collect()
        start = 0
        for row, digest in zip(rows, digests):
            data = b"".join(i.to_bytes(4, "little") for i in row["ids"])
            assert (digest["start"], digest["n_tokens"], digest["ids_crc32"]) == (start, len(row["ids"]), zlib.crc32(data))
            start += len(row["ids"])
        mixed = token_records.read_shuffled(spark, folder, 5).collect()
        assert Counter((r[0], tuple(r[1])) for r in mixed) == Counter((r["doc_id"], tuple(r["ids"])) for r in rows)


def test_special_token_strings_get_their_ids(spark, tmp_path):
    plain = Tokenizer.from_file(JSON)
    assert 50256 in plain.encode("a <|endoftext|> b", add_special_tokens=False).ids
    pick = random.Random(4)
    pieces = ["<|endoftext|>", "<|endof", "text|>", "a", "b.c", ",", ".", " ", "  ", "\n", "\t", "don't", "12", "_", "\xa0", "中"]
    odd = ["a <|endoftext|> b", "<|endoftext|>", *("".join(pick.choices(pieces, k=pick.randint(1, 12))) for _ in range(2000))]
    folder = str(tmp_path / "special")
    token_records.write(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), JSON, folder)
    got = {r["doc_id"]: r["ids"] for r in token_records.read(spark, folder).collect()}
    assert got == {k: [*plain.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(odd)}


def test_chunk_cache_never_changes_ids(monkeypatch):
    """Odd blanks, signs and special strings, with caches that overflow and pieces that are cut often."""
    rng = random.Random(5)
    signs = [*" \n\t.,_-'aZ09é  日\x00\x1c\x85½٣", "<|endoftext|>", "'s", "  ", "x" * 17]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(5000)] + [None, "", "\x00", "x" * 5000]
    library = Tokenizer.from_file(JSON)
    wanted = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for limits in ({}, {"CACHE": 300, "CACHE_LONG": 5, "BYTES_AT_ONCE": 3000}):
        for name, value in limits.items():
            monkeypatch.setattr(token_records, name, value)
        encoder = token_records.Encoder(JSON)
        for _ in range(2):
            assert [ids.tolist() for ids in encoder.encode(texts)] == wanted
    for alone in texts[-4:]:
        assert [ids.tolist() for ids in token_records.Encoder(JSON).encode([alone])] == [library.encode(alone or "", add_special_tokens=False).ids]


def test_damaged_records_are_refused():
    data = bytearray(token_records.record(7, token_records.np.arange(5)))
    assert token_records.parse(bytes(data))[0] == 7
    data[15] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_records.parse(bytes(data))


def test_token_records_of_nothing(spark, empty, tmp_path):
    assert token_records.write(empty, JSON, str(tmp_path / "none")).count() == 0


# Byte-level BPE


def test_byte_bpe_matches_the_library(spark, real, awkward):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(3)
    odd = ["".join(pick.choices(list("ab1'strelvmd  \n\t!.é中\xa0　’"), k=pick.randint(0, 40))) for _ in range(3000)]
    bpe = byte_bpe.merges(RANKS)
    for text, ids in zip(odd, bpe.encode(odd)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids).decode() == text
    for df in (real, awkward):
        got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.digests(df, RANKS).collect())
        want = Counter()
        for row in df.collect():
            ids = library.encode_ordinary(row["text"] or "")
            data = b"".join(i.to_bytes(4, "little") for i in ids)
            want[row["doc_id"], len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest()] += 1
        assert got == want


def test_byte_bpe_offsets_and_empty(spark, real, empty):
    row = byte_bpe.encode(real.where("doc_id = 0"), RANKS).first()
    data = real.where("doc_id = 0").first()["text"].encode()
    known = byte_bpe.merges(RANKS).bytes_of
    assert all(data[o : o + len(known[i])] == known[i] for i, o in zip(row["ids"], row["offsets"]))
    assert byte_bpe.digests(empty, RANKS).count() == 0


# Quality rules


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_statistics_and_verdicts(spark, real, awkward, empty):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rules = quality_rules.learn(real, labels)
    for df in (real, awkward, empty):
        got = Counter(tuple(r)[:6] + (r["base_failed"],) for r in quality_rules.judge(df, rules).collect())
        want = Counter()
        for row in df.collect():
            s = brute_statistics(row["text"])
            want[(row["doc_id"], *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
        assert got == want
        kept = quality_rules.keep_good(df, rules)
        assert kept.columns == df.columns
        assert kept.count() == quality_rules.judge(df, rules).where("kept").count()


def test_learned_list_finds_planted_rule():
    x = quality_rules.np.random.default_rng(1).random((3000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)) | (x[:, 2] > 0.95)
    rules = quality_rules.learn_list(x, bad, ["a", "b", "c"])
    hit = quality_rules.np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality_rules.covers(rule, x, ["a", "b", "c"])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * len(x)
    assert quality_rules.learn_list(x[:0], bad[:0], ["a", "b", "c"]) == []


# Scores


@pytest.mark.parametrize("module, column", [(compression_score, "quality"), (toxicity, "toxic")])
def test_scores_on_held_out_rows(spark, module, column, awkward, empty):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = module.learn(documents, labels, F.col("doc_id") % 3 != 0)
    scored = module.score(documents, model).join(labels.groupBy("doc_id").agg(F.min(column).alias("y")), "doc_id")
    right = scored.where("doc_id % 3 = 0").agg(F.avg((F.col("predicted") == F.col("y")).cast("int"))).first()[0]
    assert right > 0.93
    odd = module.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert module.score(empty, model).count() == 0
    blank = module.learn(empty, labels.limit(0))
    assert {r["predicted"] for r in module.score(awkward, blank).collect()} == {0}


def test_folding_and_exceptions():
    assert toxicity.words_of("1d10t ІDIOT $tupid 2024 Ünïcode") == ["idiot", "idiot", "stupid", "2024", "unicode"]
    model = toxicity.Model(((" clown ", 3.0), (" idio", 2.0)), frozenset({"clown fish"}), ())
    assert toxicity.matches(toxicity.words_of("a clown fish and a cl0wn, idiocy"), model) == [(5, 3.0), (6, 2.0)]


# Main text


def test_main_text_of_a_page():
    costs = {"p": 0.01, "h1": 0.01, "nav": 50.0, "div": 50.0, "footer": 50.0, "li": 20.0, "a": 20.0}
    page = """<html><head><title>T</title><script>var t="</p><article>";</script></head><body>
      <nav><ul><li><a href="x">Home page</a></ul></nav><div class="cookie-notice">we use cookies</div>
      <article><h1>A &amp; B</h1><p>First   <b>bold</b>&nbsp;x<p>Second<br>line</p>
      <div class="ad">buy now</div><form><input>name</form><p>caf&eacute; &#8364;</p></article>
      <section class="comments"><p>nice post</p></section><footer>&copy; 2024 some site name</footer></body></html>"""
    assert main_text.main_text(page, costs) == "A & B\n\nFirst bold x\n\nSecond line\n\ncafé €"
    for odd in (None, "", "<p", "<!-- open", "<script>never closed", "</div></article>", "<nav>only"):
        assert main_text.main_text(odd, costs) == ""
    assert main_text.main_text("<", costs) == "<"  # a lone sign is text


def test_main_text_of_marked_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    costs = main_text.learn(pages)
    assert costs["p"] < 1 < costs["li"]
    for row in main_text.extract(pages, costs).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", row["html"], re.S)[1]
        parts = (re.sub(r"</?b>", "", p).replace("<br>", " ") for p in re.split(r"</?(?:p|h1)>", inner))
        clean = (" ".join(main_text.html.unescape(p).split()) for p in parts)
        assert row["text"] == "\n\n".join(p for p in clean if p) and row["n_chars"] == len(row["text"])
    nulls = spark.createDataFrame([(1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in main_text.extract(nulls, {}).collect()] == ["", ""]
    assert main_text.learn(nulls) == {}


PROSE = "The river rose in the night and the town woke to water in every street of the old quarter."


@pytest.mark.parametrize(
    "wrapper",
    ['div class="content has-sidebar"', 'div class="layout no-sidebar"', 'div id="page-with-menu"', 'div class="sidebar-left"', 'div class="widget"'],
)
@pytest.mark.parametrize("marked", [True, False])
def test_wrappers_named_after_asides_keep_the_text(wrapper, marked):
    costs = {"p": 0.01, "h1": 0.01, "div": 5.0, "section": 5.0, "li": 20.0, "a": 20.0}
    inner = f"<h1>Flood</h1><p>{PROSE}</p><p>{PROSE}</p>"
    inner = f"<article>{inner}</article>" if marked else inner
    page = f"""<body><nav><a>Home</a></nav><{wrapper}>{inner}<div class="sidebar"><ul><li><a>More news</a></li></ul></div></div>
      <section class="comments"><p>nice post</p></section></body>"""
    assert main_text.main_text(page, costs) == f"Flood\n\n{PROSE}\n\n{PROSE}"


def test_blocks_of_an_article_named_after_asides_keep_the_text():
    costs = {"p": 0.01, "h1": 0.01, "h2": 0.01, "div": 1.0, "section": 1.0}
    page = f"""<body><article><div class="article-header"><h1>Flood</h1><p>Water in town</p></div><p>{PROSE}</p>
      <section class="search"><h2>The search</h2><p>Two are missing.</p></section><div class="ad">buy now</div>
      <section class="search"><p>{PROSE}</p></section><div class="search">Search this site</div><p>{PROSE}</p></article>
      <div class="comments"><article><p>nice</p></article><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div></body>"""
    want = ["Flood", "Water in town", PROSE, "The search", "Two are missing.", PROSE, PROSE]
    assert main_text.main_text(page, costs) == "\n\n".join(want)
    deep = '<div class="ad">' * 20_000 + "one two"
    assert main_text.main_text(deep, {"div": 0.0}) == "one two"  # read in one pass


# Site lines


def test_spread_lines_go_and_copies_stay(spark):
    rows = [(k, f"own line {k}\nShared terms apply.\n\nend {k}", None, f"s{k % 10}", 1, None) for k in range(30)]
    rows += [(100 + k, "a copied text\nwith two lines", None, f"s{k}", 1, None) for k in range(10)]
    rows += [(200, None, None, "s1", 0, None), (201, "", None, "s1", 0, None), (None, "Shared terms apply.", None, None, 1, None)]
    got = texts(site_lines.remove_spread(spark.createDataFrame(rows, SCHEMA)))
    assert got[3] == "own line 3\n\nend 3" and got[104] == "a copied text\nwith two lines"
    assert got[200] is None and got[201] == "" and got[None] == ""


def test_documents_that_share_another_line_all_count(spark):
    # 20 differing documents share two lines: the least MD5 of the others is equal for most.
    rows = [(k, f"Shared terms apply.\nAll rights reserved.\nown {k}", None, f"s{k}", 1, None) for k in range(20)]
    rows += [(100 + k, "a copied text\nwith two lines\na copied text", None, f"s{k}", 1, None) for k in range(10)]
    rows += [(200 + k, "with two lines\na copied text", None, f"s{k}", 1, None) for k in range(10)]
    got = texts(site_lines.remove_spread(spark.createDataFrame(rows, SCHEMA)))
    assert {got[k] for k in range(20)} == {f"own {k}" for k in range(20)}
    assert got[100] == "a copied text\nwith two lines\na copied text" and got[205] == "with two lines\na copied text"


def test_spread_lines_agree_with_plain_count(spark):
    folder = "/root/testdata/sf0.1/documents.parquet"
    con = duckdb.connect()
    want = con.execute(f"""
        WITH split AS (
          SELECT source, list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                                                             lambda x: x <> ''))) AS lines
          FROM '{folder}' WHERE text IS NOT NULL AND source IS NOT NULL),
        one AS (SELECT lines, min(source) AS site FROM split GROUP BY lines)
        SELECT line FROM (SELECT unnest(lines) AS line, site FROM one)
        GROUP BY line HAVING count(DISTINCT site) >= {site_lines.SITES}""").fetchall()
    lines = spark.createDataFrame(want, "line string").select(site_lines.line_hash(F.col("line")).alias("line"))
    got = site_lines.spread_lines(spark.read.parquet(folder))
    assert sorted(got.collect()) == sorted(lines.collect()) and len(want) == 121


def test_site_lines_awkward(spark, awkward, empty):
    cleaned = site_lines.remove_spread(awkward, removed="n_removed")
    assert cleaned.columns == [*awkward.columns, "n_removed"] and cleaned.count() == awkward.count()
    assert site_lines.remove_spread(empty).count() == 0
    assert "Python" not in cleaned._jdf.queryExecution().executedPlan().toString()


# Jaccard join


def brute_links(rows):
    """Each document's set of shingles, and all pairs that link."""
    sets, pairs = {}, set()
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    holders = defaultdict(list)
    for doc_id, own in sets.items():
        shared = Counter(other for s in own for other in holders[s])
        pairs |= {(other, doc_id) for other, n in shared.items() if 100 * n >= 75 * (len(own) + len(sets[other]) - n)}
        for s in own:
            holders[s].append(doc_id)
    return sets, pairs


def brute_components(rows):
    sets, pairs = brute_links(rows)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for one, other in pairs:
        a, b = find(one), find(other)
        root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def family(pick, base, copies, edits):
    words = [f"w{pick.randint(0, 10**6)}" for _ in range(base)]
    for _ in range(copies):
        new = list(words)
        for at in pick.sample(range(base), edits):
            new[at] = f"e{pick.randint(0, 10**6)}"
        yield " ".join(new)


def test_jaccard_join_matches_brute_force(spark, real, awkward):
    pick = random.Random(7)
    made = [t for size in (5, 8, 40, 300, 1500) for t in family(pick, size, 12, max(1, size // 45))]
    made += [t for _ in range(3) for t in family(pick, 60, 6, 2)] + ["A b C d e f g", "a B c D e F g"] + made[:3]
    chain = [f"c{k}" for k in range(100)]
    made += [" ".join(chain[k : k + 60]) for k in range(0, 40, 4)]  # links form a path
    rows = [(1000 + k, t) for k, t in enumerate(made)] + [(r["doc_id"], r["text"]) for r in real.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.group(df).collect()}
    assert got == brute_components(rows)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(df).collect()}
    assert kept == {k for k, (_, root) in got.items() if k == root}


def test_tree_blocks_and_cuts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TREE_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "FIRST_PAIRS", 1)
    pick = random.Random(9)
    rows = list(enumerate(t for _ in range(6) for t in family(pick, 50, 9, 2)))
    got = jaccard_join.group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)


@pytest.mark.parametrize("tree_rows", [1024, 4])
def test_links_match_brute_force(spark, real, monkeypatch, tree_rows):
    """Every link between different sets comes out of the traversal; copies count in the number of links."""
    monkeypatch.setattr(jaccard_join, "TREE_ROWS", tree_rows)
    pick = random.Random(8)
    made = [t for size in (5, 9, 40, 300, 1500) for t in family(pick, size, 10, max(1, size // 45))]
    made += [*made[:4], made[0], None, "", "A b C d e f g", "a B c D e F g"]
    rows = list(enumerate([*made, *(r["text"] for r in real.collect())]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, pairs = brute_links(rows)
    least = {}
    for doc_id, own in sets.items():
        least.setdefault(frozenset(own), doc_id)
    classes = {k: least[frozenset(own)] for k, own in sets.items() if own}
    found, members = jaccard_join.links(df)
    assert {tuple(r) for r in members.select("doc_id", "id").collect()} == set(classes.items())
    wanted = {(a, b) for a, b in pairs if classes[a] == a and classes[b] == b}
    got = [tuple(r) for r in found.select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted
    degree = Counter(k for pair in pairs for k in pair)
    counted = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.linked(df).collect()}
    assert counted == {k: (c, degree[k]) for k, c in classes.items()}


def test_links_awkward(spark, awkward, empty):
    assert jaccard_join.linked(empty).count() == 0
    counted = jaccard_join.linked(awkward)
    assert counted.columns == ["doc_id", "class_id", "n_links"]
    assert counted.count() == counted.select("doc_id").distinct().count() == counted.where("doc_id is not null").count()


def test_star_traversal_prunes_and_keeps_what_single_checks_keep():
    pick = np.random.default_rng(4)
    sets, star = [], []
    for centre, size in ((0, 700), (1, 1), (2, 65)):
        own = np.unique(pick.integers(0, 2**63, 30).astype(np.uint64))
        for k in range(size):
            near = np.unique(np.append(own[: 30 - k % 3], pick.integers(0, 2**63, k % 3).astype(np.uint64)))
            sets.append((own, near if k % 100 == 0 else np.unique(pick.integers(0, 2**63, 20 + k // 40).astype(np.uint64))))
            star.append(centre)
    star = np.array(star)
    level = lambda side, ids: jaccard_join.leaves([jaccard_join.bitmap(s[side]) for s in sets], [len(s[side]) for s in sets], ids, 256)
    centre, members = level(0, star), level(1, 10 + np.arange(len(sets)))
    keep, visited = jaccard_join.star_traversal(star, centre, members)
    assert keep.tolist() == np.flatnonzero(jaccard_join.surviving(centre, members)[0]).tolist()
    assert 9 <= len(keep) and visited < len(sets) // 2
    none = jaccard_join.star_traversal(star[:0], *(tuple(v[:0] for v in side) for side in (centre, members)))
    assert none[0].tolist() == [] and none[1] == 0


def test_bound_is_never_below_the_overlap():
    pick = jaccard_join.np.random.default_rng(2)
    pool = pick.integers(0, 2**63, 4000).astype("uint64")
    sets = [jaccard_join.np.unique(pick.choice(pool, size)) for size in (30, 500, 520, 900, 1800)]
    for one in sets:
        for other in sets:
            width = min(len(jaccard_join.bitmap(one)), len(jaccard_join.bitmap(other)))
            levels = [jaccard_join.leaves([jaccard_join.bitmap(s)], [len(s)], [k], width) for k, s in enumerate((one, other))]
            assert jaccard_join.surviving(*levels)[1][0] >= len(set(one.tolist()) & set(other.tolist()))


def test_jaccard_join_awkward(spark, awkward, empty):
    got = jaccard_join.group(awkward)
    assert got.count() == awkward.count()
    assert got.where("doc_id is null and component_id is not null").count() == 0
    assert jaccard_join.group(empty).count() == 0
    kept = jaccard_join.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 5").count() == 1
    two = spark.createDataFrame([(1, "a b c d e f"), (1, "other words of the same id here")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.group(two).collect()} == {1}


# Decontamination


def test_passages_are_found_whole_or_edited(spark, real, empty, awkward):
    items = [(k, " ".join(f"{w}{k}" for w in "some fairly long question about many different things in the world".split())) for k in range(40)]
    benchmark = spark.createDataFrame([*items, (98, None), (99, "too short")], "item_id long, text string")
    exact = items[5][1].upper().replace(" ", ",\n ")
    edited = items[7][1].replace("question7", "questoin7").replace("many", "mny")
    far = " ".join(items[9][1].split()[::-1])
    rows = [(1, f"x {exact} y"), (2, "lead " * 500 + edited + " tail"), (3, far), (4, f"{items[1][1]} {items[2][1]}"), (5, "too short"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.matches(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 5), (2, 7), (4, 1), (4, 2)}
    assert {r["edits"] for r in got if r["doc_id"] != 2} == {0}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()) == [3, 5, 6]
    assert decontaminate.clean(awkward, benchmark).count() == awkward.count()
    assert decontaminate.matches(empty, benchmark).count() == 0
    assert decontaminate.matches(docs, benchmark.limit(0)).count() == 0


def test_quotations_of_part_of_an_item_are_found(spark):
    pick = random.Random(12)
    size = {0: 390, 1: 390, 2: 1500, 3: 130}
    items = {k: " ".join(f"w{pick.randint(0, 10**6)}" for _ in range(300))[:n] for k, n in size.items()}
    least = decontaminate.PART + decontaminate.STRIDE - 1
    quotes = [(k, text[a : a + least]) for k, text in items.items() for a in range(0, max(1, len(text) - least + 1), 7)]
    quotes += [(0, items[0][:300]), (1, items[1][-300:]), (3, items[3])]
    edited = []
    for k, quote in quotes:
        letters = list(quote)
        for at in range(20, len(letters), 40):  # three edits at most in any part
            letters[at] = "#" if letters[at] == " " else pick.choice(["", "q", letters[at] + "z"])
        edited.append((k, "".join(letters)))
    every = quotes + edited
    docs = spark.createDataFrame([(n, f"other words go first {q} and others last") for n, (_, q) in enumerate(every)], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, benchmark).collect()}
    assert set(got) == {(n, k) for n, (k, _) in enumerate(every)}
    assert all(r["edits"] == 0 for (n, _), r in got.items() if n < len(quotes))
    assert decontaminate.clean(docs, benchmark).count() == 0
    whole = spark.createDataFrame([(1, items[0].replace(items[0][200:203], "")), (2, items[0][:60])], "doc_id long, text string")
    (one,) = decontaminate.matches(whole, benchmark).collect()
    assert (one["doc_id"], one["edits"]) == (1, 3) and one["end"] - one["start"] >= 387


def test_matches_agree_with_plain_search(spark, real):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: decontaminate.plain(r["text"]) for r in benchmark.collect()}
    want = {(d, i) for d, t in texts(real).items() for i, p in items.items() if len(p) >= decontaminate.LEAST and p in decontaminate.plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(real, benchmark).where("edits = 0").collect()}
    assert got == want


# Tool calls


def test_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame(
        [
            ("c", "1", None, "add", '{"b":2,"a":1}'), ("c", "2", "1", "add", '{"a":"x","b":1}'), ("c", "3", "2", "add", '{"a":1}'),
            ("c", "4", "3", "add", "not json"), ("c", "5", "9", "none", "{}"), ("c", "6", "7", "add", '{"a":1,"b":2}'),
            ("c", "7", "6", "add", '{"a":1,"b":2,"z":3}'), ("c", "1", None, "add", '{"b":2,"a":1}'), ("c", None, None, "add", "{}"),
        ],
        "conv_id string, call_id string, after_id string, name string, arguments string",
    )
    results = spark.createDataFrame([("1", 'say "hi"\n'), ("8", "lone")], "call_id string, content string")
    schema = spark.createDataFrame([("add", "a", "integer", True), ("add", "b", "integer", True)], "name string, field string, kind string, required boolean")
    got = {r["call_id"]: r for r in tool_calls.link(calls, results, schema).collect()}
    assert {k: r["place"] for k, r in got.items()} == {"1": 0, "2": 1, "3": 2, "4": 3, "5": 0, "6": None, "7": None, "8": None}
    errors = {k: r["error"] for k, r in got.items()}
    assert errors == {
        "1": None, "2": "wrong kind of a", "3": "missing field", "4": "malformed arguments", "5": "unknown tool",
        "6": "cycle", "7": "unknown field z", "8": "no call",
    }
    assert got["1"]["json"] == '{"arguments":{"a":1,"b":2},"call_id":"1","name":"add","result":"say \\"hi\\"\\n"}'
    assert got["1"]["linked"] and not got["2"]["linked"]
    assert tool_calls.link(calls.limit(0), results.limit(0), schema).count() == 0


def test_long_paths_take_few_rounds(spark):
    calls = spark.range(700).selectExpr("cast(id as string) call_id", "cast(id - 1 as string) after_id")
    assert tool_calls.places(calls).where("place <> cast(call_id as int)").count() == 0


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = after
    rows = corpus_pipeline.run(spark, SMALL).select("doc_id", "decoded_sha256").collect()
    want = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts(before).items()}
    assert {tuple(r) for r in rows} == want


def test_letters_that_stand_for_phrases_stay_one_word():
    model = toxicity.Model(((" vile ", 3.0),), frozenset({"so vile"}), ())
    words = toxicity.words_of("\ufdfa vile \uff9e so vile end vile")
    assert [at for at, _ in toxicity.matches(words, model)] == [1, len(words) - 1]
    assert all(" " not in w for w in words)


def test_removed_lines_do_not_overwrite_a_column(awkward):
    with pytest.raises(ValueError, match="column already"):
        site_lines.remove_spread(awkward, removed="Lang")


def test_arguments_keep_their_json_kinds(spark):
    schema = spark.createDataFrame(
        [("f", k, k, False) for k in ("string", "integer", "number", "boolean", "object", "array")],
        "name string, field string, kind string, required boolean",
    )
    cases = {
        '{"integer":"1"}': ("wrong kind of integer", '{"integer":"1"}'),
        '{"string":5}': ("wrong kind of string", '{"string":5}'),
        '{"integer":1.5}': ("wrong kind of integer", '{"integer":1.5}'),
        '{"boolean":"true"}': ("wrong kind of boolean", '{"boolean":"true"}'),
        '{"object":[1]}': ("wrong kind of object", '{"object":[1]}'),
        '{"integer":1,"number":0.50,"boolean":false}': (None, '{"boolean":false,"integer":1,"number":0.5}'),
        ' { "object" : {"b":[1, {"z":null,"a":"x"}], "a":{}} , "array":[ ] } ': (None, '{"array":[],"object":{"a":{},"b":[1,{"a":"x","z":null}]}}'),
        '{"integer":123456789012345678901234567890}': (None, '{"integer":123456789012345678901234567890}'),
        '{"string":"\\u00e9 \\" \\n 😀"}': (None, '{"string":"é \\" \\n 😀"}'),
        '{"string":null}': (None, '{"string":null}'),
        "{}": (None, "{}"),
        '{"integer":1,"integer":3}': ("malformed arguments", None),
        '{"object":{"a":1,"a":2}}': ("malformed arguments", None),
        '{"integer":1} trailing': ("malformed arguments", None),
        '{"integer":1}{"integer":2}': ("malformed arguments", None),
        '{"integer":1}],[2': ("malformed arguments", None),
        '{"integer":1}}{"v":1': ("malformed arguments", None),
        '{"integer":1},{"integer":2}': ("malformed arguments", None),
        '{"integer":1},"w":2': ("malformed arguments", None),
        "[1]": ("malformed arguments", None),
        "null": ("malformed arguments", None),
        "": ("malformed arguments", None),
        "{'integer':1}": ("malformed arguments", None),
        None: ("malformed arguments", None),
    }
    calls = spark.createDataFrame([(str(k), "f", a) for k, a in enumerate(cases)], "call_id string, name string, arguments string")
    got = {int(r["call_id"]): (r["problem"], r["canonical"]) for r in tool_calls.checked_arguments(calls, schema).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


COSTS = {"li": 120.0, "ul": 100.0, "div": 100.0, "a": 60.0, "table": 80.0, "td": 40.0, "tr": 40.0, "p": 0.5}
LIST = "<h1>Flood</h1><p>What to bring:</p><ul><li>milk</li><li>flour</li></ul><p>That is all of it.</p>"
LINKS = "<p>Short start of it.</p><p>See <a>one</a> and <a>two</a> and <a>three</a>.</p><p>The end of it.</p>"
TABLE = "<p>Before it.</p><table><tr><td>a</td><td>b</td></tr></table><p>After it.</p>"
MENU = "<div><ul><li><a>Home</a></li><li><a>News</a></li></ul></div>"


@pytest.mark.parametrize(
    "article, text",
    [
        (LIST, "Flood\n\nWhat to bring:\n\nmilk\n\nflour\n\nThat is all of it."),
        (LINKS, "Short start of it.\n\nSee one and two and three.\n\nThe end of it."),
        (TABLE, "Before it.\n\na\n\nb\n\nAfter it."),
        ("<p title=Bob's>One it's.</p><p title=\"5\" tall\">Two.</p><p a=' > ' b=\"<p>\">Three.</p>", "One it's.\n\nTwo.\n\nThree."),
    ],
)
@pytest.mark.parametrize("wrap", ["{}", "<form action=/>{}</form>", "<aside>{}</aside>", "<form><input name=x>{}"])
def test_marked_articles_keep_lists_links_tables_and_forms(article, text, wrap):
    page = f"<html><body>{MENU}{wrap.format(f'<article>{article}</article>')}<form><p>Your mail here</p></form></body></html>"
    assert main_text.main_text(page, COSTS) == text


def test_a_form_around_an_unmarked_page_keeps_its_text():
    body = "".join(f"<p>Paragraph {k} has a few words of its own.</p>" for k in range(9))
    page = f"<body><form id=aspnet>{body}</form><form><label>Mail</label></form></body>"
    assert main_text.main_text(page, {"p": 0.1}).count("\n\n") == 8
    assert "Mail" not in main_text.main_text(page, {"p": 0.1})


def test_all_tags_of_the_sample_are_weighed(spark):
    pages = spark.createDataFrame([(1, "<rare><rare><article><p>a</p></article>")], "page_id long, html string")
    assert set(main_text.learn(pages)) == {"rare", "p"}


def test_lexicon_equals_a_naive_matcher(spark, real):
    """Scores rebuilt by scanning every text for every lexicon entry."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.learn(real, labels)
    assert model.lexicon

    def naive(text):
        words = toxicity.words_of(text)
        line, out, at = f" {' '.join(words)} ", [], 0
        for k, word in enumerate(words):
            fitting = [(len(e), w) for e, w in model.lexicon if line.startswith(e, at)]
            around = {" ".join(words[max(k - 1, 0) : k + 1]) if k else "", " ".join(words[k : k + 2]) if k + 1 < len(words) else ""}
            if fitting and not around & model.exceptions:
                out.append((k, max(fitting)[1]))
            at += len(word) + 1
        return out

    for row in real.collect():
        words = toxicity.words_of(row["text"])
        assert toxicity.matches(words, model) == naive(row["text"])


def test_thresholds_lie_between_the_classes():
    x = np.array([[0.0], [0.0], [0.1], [0.9], [1.0], [0.95]] * 20)
    bad = x[:, 0] > 0.5
    (rule,) = quality_rules.learn_list(x, bad, ["m"])
    (found,) = rule
    assert found.above and 0.4 < found.threshold < 0.6


def test_rules_on_documents_they_have_not_seen(spark):
    """Learned on one half of the labelled documents, measured on the other."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    rules = quality_rules.learn(docs, labels.where(half == 0))
    other = labels.where(half == 1).select("doc_id", "quality")
    judged = quality_rules.judge(docs.join(other, "doc_id", "left_semi"), rules).join(other, "doc_id")
    kept = {r["quality"]: r["share"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert rules[0][0].threshold > 0.001  # one sign in a text does not condemn it
    assert kept[1] > 0.97 and kept[0] < 0.05
