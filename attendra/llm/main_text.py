"""Main text of HTML pages as the maximum-scoring run of words and tags.

A page is read as a sequence: each word scores positive, each tag negative, with
weights from labelled pages (those that mark their article). One linear scan
finds the contiguous region with the largest sum. Inside the article that a page
itself marks, tags cost nothing: its lists, links and tables stay. Elements that
hold no main text (scripts, menus, forms) take no part and give no text, but for a form or
an aside around the article, or around most words of a page. Blocks whose class,
id or role names an advert, a notice, comments and the like are left out too,
unless main text lies in them (``asides``): layout names (``has-sidebar``) and
names of an article's own parts (``article-header``) count for nothing.

Inside the region character references are decoded, white space in a block
becomes one space, and blocks are joined by an empty line. Null, empty and
wordless pages give an empty text; a page cut short is read as far as it goes.
Ties go to the earlier, then the longer region. Repeated rows get equal texts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARN_PAGES = 2_000
WORD_SCORE = 1.0
#: Cost of a tag per natural log of its odds to stand outside the article.
TAG_SCALE = 12.0
LEAST_COST = 0.01

# Fixed values of HTML: elements without content, with raw content, that break
# lines of text, and that are no main text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
NOT_MAIN = frozenset("head nav footer aside form button select dialog menu object canvas map".split())
#: Of these, those that some pages put around the article.
WRAPPING = frozenset("form aside".split())
BOX = frozenset("div section ul ol dl table span figure p details header".split())
ASIDE_NAME = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|popup|modal|comments?|disqus|sidebar|"
    r"menu|nav\w*|breadcrumbs?|footer|share|social|related|recommend\w*|newsletter|subscribe|login|"
    r"pager|pagination|widget",
    re.I,
)
#: Words that also name parts of an article.
WEAK_NAME = re.compile(r"notices?|side|header|search", re.I)
ARTICLE_NAME = re.compile(r"article|post|entry|content|main|page|story|body|text", re.I)
#: Words of a layout that tells of an aside without being one.
LAYOUT_NAME = re.compile(r"has|have|no|not|with|without|is", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A block with an aside's name is left out up to this share of the words that surround it.
ASIDE_SHARE = 0.5
#: One with a weak name, up to so many words.
WEAK_WORDS = 15
TOKEN = re.compile(
    # A quote opens a value only behind "="; any other is a character like the rest.
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name or text, attributes)``: text, open and close tokens in page order."""
    at = 0
    while True:
        found = TOKEN.search(page, at)
        if found is None:
            break
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            yield "close", name, ""
            continue
        yield "open", name, found[3]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = len(page) if end is None else end.end()
            yield "close", name, ""
    if at < len(page):
        yield "text", page[at:], ""


def never_main(name: str, in_article: bool) -> bool:
    return name in RAW or name in NOT_MAIN or (name == "header" and not in_article)


def wrappers(found: list[tuple[str, str, str]]) -> set[int]:
    """Places of the forms and asides that hold an article or main element, or most words of the page."""
    opened: dict[str, list[tuple[int, int, int]]] = {name: [] for name in WRAPPING}
    words, articles, out, silent = 0, 0, set(), ""
    spans = []
    for at, (kind, value, _) in enumerate(found):
        if kind == "text":
            words += 0 if silent else len(value.split())
        elif value in RAW:
            silent = value if kind == "open" else ""
        elif kind == "open" and value in ("article", "main"):
            articles += 1
        elif value in opened:
            if kind == "open":
                opened[value].append((at, words, articles))
            elif opened[value]:
                start, before, earlier = opened[value].pop()
                spans.append((start, words - before, articles - earlier))
    spans += [(start, words - before, articles - earlier) for rows in opened.values() for start, before, earlier in rows]
    for start, inside, marked in spans:
        if marked or (not articles and 2 * inside > words):
            out.add(start)
    return out


def named_aside(name: str, attributes: str) -> str:
    """"strong" or "weak" if class, id or role of a block name an aside, else ""."""
    if name not in BOX or not attributes:
        return ""
    found = ""
    for one in (w for v in NAMED.findall(attributes) for w in v.strip("\"'").split()):
        words = re.split(r"[-_]+", one)
        if any(LAYOUT_NAME.fullmatch(w) for w in words):
            continue
        if any(ASIDE_NAME.fullmatch(w) for w in words):
            return "strong"
        if any(WEAK_NAME.fullmatch(w) for w in words) and not any(ARTICLE_NAME.fullmatch(w) for w in words):
            found = "weak"
    return found


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """``tokens`` without the elements that are no main text; opened ones with their aside's name.

    A token "gone" stands where such an element was.
    """
    skipped, depth, article = "", 0, 0
    found = list(tokens(page))
    wrapping = wrappers(found)
    for at, (kind, value, attributes) in enumerate(found):
        if skipped:
            if kind == "open" and value == skipped:
                depth += 1
            elif kind == "close" and value == skipped:
                depth -= 1
            elif kind == "close" and value in ("article", "main", "body"):
                depth = 0  # never closed: it ends with what holds it
            if depth > 0:
                continue
            ended_by_itself = kind == "close" and value == skipped
            skipped = ""
            if ended_by_itself:
                continue
        if kind == "open" and value not in VOID and never_main(value, article > 0) and at not in wrapping:
            skipped, depth = value, 1
            yield "gone", value, ""
            continue
        if value in ("article", "main") and kind != "text":
            article += 1 if kind == "open" else -(article > 0)
        yield kind, value, named_aside(value, attributes) if kind == "open" else ""


def extents(found: list[tuple[str, str, str]]) -> dict[int, int]:
    """Where each block, article and main begins and ends (first place after it)."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for at, (kind, value, _) in enumerate(found):
        if kind in ("open", "gone") and value not in INLINE:
            for start in opened.pop("p", ()):
                ends[start] = at  # a paragraph ends where the next block begins
        if kind == "open" and (value in BOX or value in ("article", "main", "body")):
            opened.setdefault(value, []).append(at)
        elif kind == "close" and value in ("article", "main", "body"):
            first = opened[value].pop() if opened.get(value) else -1
            for name in opened:
                while opened[name] and opened[name][-1] > first:
                    ends[opened[name].pop()] = at  # never closed: it ends with what holds it
            if first >= 0:
                ends[first] = at + 1
        elif kind == "close" and opened.get(value):
            ends[opened[value].pop()] = at + 1
    ends |= {start: len(found) for starts in opened.values() for start in starts}
    return ends


def asides(found: list[tuple[str, str, str]], scores: list[float]) -> list[tuple[int, int]]:
    """Bounds of the blocks that their names leave out.

    Main text is the article or main element with most words, or the best region
    of a page without any. A block that holds it is kept. Outside a marked
    article all others go. In it, and on pages that mark none, those go that have
    few words beside it (beside the page's); with a weak name only short ones
    without a heading.
    """
    if not any(named for *_, named in found):
        return []
    ends = extents(found)
    words = [0, *accumulate(len(v.split()) if k == "text" else 0 for k, v, _ in found)]
    headings = [0, *accumulate(k == "open" and v in HEADINGS for k, v, _ in found)]
    marked = [(a, b) for a, b in ends.items() if found[a][1] in ("article", "main")]
    size, first, last = max(((words[b] - words[a], a, b) for a, b in marked), key=lambda x: (x[0], -x[1]), default=(0, 0, 0))
    is_marked = size > 0
    if not is_marked:
        size, (first, last) = words[-1], region(scores)
    out, done = [], 0
    for start, (*_, named) in enumerate(found):
        if not named or start < done:
            continue
        end = ends[start]
        own = words[end] - words[start]
        if start <= first and last <= end and last > first:
            continue
        if not is_marked or (first <= start and end <= last):
            if named == "strong" and own > ASIDE_SHARE * size:
                continue
            if named == "weak" and (own > WEAK_WORDS or headings[end] > headings[start]):
                continue
        out.append((start, end))
        done = end
    return out


def tag_counts(page: str) -> tuple[Counter, Counter]:
    """Tags outside and inside the article, over the whole page."""
    outside, inside = Counter(), Counter()
    article = 0
    for kind, value, _ in tokens(page):
        if kind == "text":
            continue
        if value in ("article", "main"):
            article += 1 if kind == "open" else -(article > 0)
            continue
        (inside if article else outside)[value] += 1
    return outside, inside


def learn(pages: DataFrame, rows: int = LEARN_PAGES) -> dict[str, float]:
    """The cost of each tag, from about ``rows`` pages that mark their article.

    One row per tag name of the sample reaches the driver. A name that few pages
    have costs little, as its odds are counted with one tag more on either side.
    """
    marked = pages.select("html", "page_id").where(F.lower("html").rlike("<(article|main)[ >]"))
    total = marked.count()
    share = min(1.0, rows / max(total, 1))
    chosen = F.pmod(F.xxhash64("page_id", F.lit(31)), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = marked.where(chosen) if share < 1 else marked

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch["html"]:
                outside, inside = tag_counts(page)
                rows += [(t, outside[t], inside[t]) for t in outside.keys() | inside.keys()]
            yield pd.DataFrame(rows, columns=["tag", "outside", "inside"])

    counted = sample.mapInPandas(count, "tag string, outside long, inside long").groupBy("tag")
    found = counted.agg(*(F.sum(c).alias(c) for c in ("outside", "inside")))
    return {
        r["tag"]: max(LEAST_COST, TAG_SCALE * math.log((r["outside"] + 1) / (r["inside"] + 1)))
        for r in found.collect()
    }


def region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest positive sum; (0, 0) if none."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, bounds = total, (start, at + 1)
    return bounds


def main_text(page: str | None, costs: dict[str, float]) -> str:
    if not page:
        return ""
    found = list(parts(page))
    scores, article = [], 0
    for kind, value, _ in found:
        if value in ("article", "main") and kind in ("open", "close"):
            article += 1 if kind == "open" else -(article > 0)
        if kind == "text":
            scores.append(WORD_SCORE * len(value.split()))
        elif kind == "gone":
            scores.append(0.0)
        else:
            free = article > 0 or value in ("article", "main", "html", "body")
            scores.append(0.0 if free else -costs.get(value, 1.0))
    for start, end in reversed(asides(found, scores)):
        del found[start:end], scores[start:end]
    first, last = region(scores)
    blocks, open_block = [], []
    for kind, value, _ in found[first:last]:
        if kind == "text":
            open_block.append(value)
        elif kind != "gone" and value not in INLINE:
            blocks.append("".join(open_block))
            open_block = []
        elif value == "br":
            open_block.append(" ")
    blocks.append("".join(open_block))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract(pages: DataFrame, costs: dict[str, float]) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(p, costs) for p in batch["html"]]
            yield pd.DataFrame(
                {"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]}
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInPandas(
        build, f"page_id {kind}, url string, text string, n_chars long"
    )
