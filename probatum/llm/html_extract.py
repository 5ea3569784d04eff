"""Main text of web pages: maximum-scoring subsequence over words and tags.

A page is a sequence of tokens: start and end tags, words with the place they stand in (the kind of their nearest
block), and boilerplate elements as a whole. Words score positive in content places, tags and boilerplate negative by
kind; one linear scan finds the contiguous run with the highest sum, and its blocks are the text.

The weights are log-odds, learnt from labelled pages by counting tokens inside and outside of their content; a page
is its own label where it marks its content with exactly one ``article`` or ``main`` element. About ``TRAIN_PAGES``
pages, drawn by hash, are counted, and Spark sums the counts; the table of places and tags is as small as HTML's
vocabulary. A fixed prior stands behind the counts, so pages without marks, or with places never counted, are still
cut sensibly. When a page is cut, its mark is evidence and no limit: words outside lose up to ``MARK`` each, and together no
more than the words inside score, so the scan over the whole page decides and a lone teaser does not displace the text.

What is never text: scripts, styles, forms, menus and other elements whose names say so, and elements whose class, id
or role names an advert, notice, comment section or the like, inside the run too.

Time is linear in the page, whatever is left open: a tag that is cut off stays a tag, up to the page's end if within a quote.

Stated cases: null or empty html, and a page without content, give an empty text; broken, unclosed or cut-off markup
is read as far as it goes; repeated rows give repeated rows; an empty table gives an empty result; other columns are
ignored unless named in ``keep``.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from probatum.llm.common import col, slices

# Element names of HTML by their part in a page.
RAW = "script style noscript template textarea title iframe svg math canvas object audio video xmp plaintext noembed noframes".split()
BOILER = "nav footer aside form button select option datalist menu dialog label input fieldset head".split()
BLOCK = ("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
         "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
         "section summary table tbody td tfoot th thead title tr ul").split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = frozenset(BLOCK)
CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
# Words in class, id and role attributes that name boilerplate.
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sidebar aside rail widget widgets "
    "footer foot colophon copyright masthead topbar toolbar header skip "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall subscribe subscription "
    "newsletter signup login register search searchbox form "
    "comment comments commentlist discussion disqus respond replies reply reactions "
    "share sharing social related recommended recommendations more-from trending popular tags taglist "
    "complementary contentinfo".split())
GOOD_NAMES = {"article", "content", "entry", "main", "post", "story", "body", "text"}
LAYOUT_WORDS = {"has", "with", "without", "no", "is"}

# Attributes are read once, without a way back: quoted values end at their quote or at the page's end.
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|["'=])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WHITE = re.compile(r"\s+")

TRAIN_PAGES = 20_000
PRIOR = 20.0  # tokens that a prior weight counts for
WORD_CAP, TAG_CAP = 2.0, 3.0
MARK = 2.5  # what a word outside of the page's one content mark loses at most


def _bad_names(attributes: str) -> bool:
    """Whether a class, id, role or label names boilerplate.

    A name that is a bad word, or has one among its parts (``article-comments``), is bad. Parts count for nothing beside
    a whole name for content (``post category-notices``), in the header of such content (``entry-header``) and in names
    that tell what a layout has or lacks (``with-sidebar``).
    """
    for m in _NAMES.finditer(attributes):
        value = next(v for v in m.groups()[1:] if v is not None).lower()
        names = value.split()
        content = any(n in GOOD_NAMES for n in names)
        for name in names:
            parts = [x for x in re.split(r"[^a-z]+", name) if x]
            found = BAD_NAMES.intersection(parts)
            if name in BAD_NAMES or (len(parts) == 1 and found):
                return True
            if found and not content and parts[0] not in LAYOUT_WORDS and not (found == {"header"} and GOOD_NAMES.intersection(parts)):
                return True
    return False


class Token:
    """A tag or a stretch of text, with its place."""

    __slots__ = ("block", "kind", "text", "words")

    def __init__(self, kind: str, text: str = "", words: int = 0, block: int = -1) -> None:
        self.kind, self.text, self.words, self.block = kind, text, words, block


def tokens(page: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens of a page, and the spans of tokens inside its content marks (article or main, the outermost ones)."""
    out: list[Token] = []
    marks: list[tuple[int, int]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are boilerplate themselves
    open_names: Counter[str] = Counter()
    places = ["body"]  # the open blocks
    bad = mark_depth = mark_start = block = 0
    raw = ""

    def close() -> tuple[str, bool]:
        nonlocal bad
        name, own = stack.pop()
        open_names[name] -= 1
        bad -= own
        if name in BLOCKS:
            places.pop()
        return name, own

    for m in _TOKEN.finditer(page):
        closing, name, attributes = m.group(1), m.group(2), m.group(3)
        if raw:
            if name and closing and name.lower() == raw:
                raw = ""
            continue
        if not name:
            text = m.group(0)
            if text[:2] in ("<!", "<?"):
                continue
            if not bad:
                out.append(Token(f"word:{places[-1]}", text, 0 if text.isspace() else text.count(" ") + 1, block))
            continue
        name = name.lower()
        if not closing:
            if name in RAW:
                if not attributes.rstrip().endswith("/"):
                    raw = name
                if not bad:
                    out.append(Token(f"<{name}", block=block))
                continue
            if name in CLOSES_P and "p" in [t for t, _ in stack[-6:]]:
                while stack and stack[-1][0] != "p" and stack[-1][0] not in BLOCKS:
                    close()
                if stack and stack[-1][0] == "p":
                    close()
            if name == "li" and open_names["li"]:
                while stack and stack[-1][0] not in ("ul", "ol", "menu", "li", "body", "nav", "div", "article", "main", "section"):
                    close()
                if stack and stack[-1][0] == "li":
                    close()
            if name in BLOCKS:
                block += 1
            if name == "br":
                if not bad:
                    out.append(Token("<br", " ", 0, block))
                continue
            inside = mark_depth > 0
            own = name in BOILER or (name == "header" and not inside) or _bad_names(attributes) or bool(_HIDDEN.search(attributes))
            if name in ("html", "body", "main"):
                own = False
            if not bad:
                out.append(Token("<boilerplate" if own else f"<{name}", block=block))
            if name in VOID or attributes.rstrip().endswith("/"):
                continue
            stack.append((name, own))
            open_names[name] += 1
            if name in BLOCKS:
                places.append(name)
            bad += own
            if name in ("article", "main") and not bad:
                if not mark_depth:
                    mark_start = len(out)
                mark_depth += 1
        else:
            if name in VOID:
                continue
            while open_names[name]:
                marked = stack[-1][0] in ("article", "main") and not bad and mark_depth
                if marked:
                    mark_depth -= 1
                    if not mark_depth:
                        marks.append((mark_start, len(out)))
                if close()[0] == name:
                    break
            if name in BLOCKS:
                block += 1
            if not bad:
                out.append(Token(f"/{name}", block=block))
    if mark_depth:
        marks.append((mark_start, len(out)))
    return out, marks


def _count(page: str) -> Counter[tuple[str, bool]]:
    """Tokens by kind, inside and outside of the page's content, if it marks exactly one."""
    found, marks = tokens(page)
    seen: Counter[tuple[str, bool]] = Counter()
    if len(marks) == 1:
        a, b = marks[0]
        for i, t in enumerate(found):
            seen[t.kind, a <= i < b] += t.words if ":" in t.kind else 1
    return seen


def _prior(kind: str) -> float:
    if kind.startswith("word:"):
        return {"p": 1.5, "h1": 1.0, "h2": 1.0, "h3": 1.0, "blockquote": 1.0, "pre": 1.0, "article": 1.0, "main": 1.0, "section": 0.6, "td": 0.5,
                "li": 0.5, "figcaption": 0.4, "div": 0.5, "body": 0.1, "header": 0.1}.get(kind[5:], 0.3)
    name = kind.lstrip("</")
    if name == "boilerplate":
        return -1.5
    return {"p": -0.2, "br": 0.0, "b": 0.0, "i": 0.0, "em": 0.0, "strong": 0.0, "a": -0.3, "span": -0.1, "li": -0.3, "article": -0.5, "main": -0.5,
            "h1": -0.2, "h2": -0.2, "h3": -0.2, "code": 0.0, "td": -0.2, "tr": -0.2, "ul": -0.5, "ol": -0.5, "script": -0.5, "style": -0.5}.get(name, -1.0)


def learn_weights(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Weight per token kind, from the pages drawn that mark their content; kinds are bounded by HTML's names."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, bool]] = Counter()
        for batch in slices(batches, 0):
            for page in batch.column(0).to_pylist():
                seen.update(_count(page or ""))
        keys = [k for k in seen if k[0].lstrip("</").split(":")[-1] in KNOWN]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["kind", "inside", "n"])

    source = pages.select(col(html).cast("string").alias("html"))
    every = max(1, source.count() // TRAIN_PAGES)
    drawn = source.filter(F.pmod(F.xxhash64("html"), F.lit(every)) == 0)
    counts = (drawn.mapInArrow(work, "kind string, inside boolean, n bigint")
              .groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inner"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outer")))
    out = {}
    for kind, inner, outer in counts.collect():  # one row per kind of token
        n, prior = inner + outer, _prior(kind)
        odds = math.log((inner + 0.5) / (outer + 0.5))
        if ":" in kind:
            learnt = max(-WORD_CAP, min(WORD_CAP, odds))
        else:
            learnt = max(-TAG_CAP, min(0.0, odds if odds < 0 else prior))
        out[kind] = (n * learnt + PRIOR * prior) / (n + PRIOR)
    return out


KNOWN = {*RAW, *BOILER, *BLOCK, *VOID, "a", "b", "i", "em", "strong", "span", "code", "boilerplate", "small", "sub", "sup", "u", "s", "q", "cite", "time", "font", "mark"}


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum; the longest of equals. (0, 0) if none is positive."""
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores.tolist()):
        total += s
        if total > best or (total == best and best > 0):
            best, best_span = total, (start, i + 1)
        if total < 0:
            total, start = 0.0, i + 1
    return best_span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    found, marks = tokens(page)
    scores = np.array([(weights[t.kind] if t.kind in weights else _prior(t.kind)) * (t.words if ":" in t.kind else 1) for t in found])
    if len(marks) == 1:  # evidence that grows with what the mark holds: all words outside lose no more than that together
        words = np.array([t.words if ":" in t.kind else 0 for t in found])
        inside = np.zeros(len(found), bool)
        inside[marks[0][0] : marks[0][1]] = True
        outside = words[~inside].sum()
        if outside:
            held = np.maximum(scores[inside & (words > 0)], 0.0).sum()
            scores[~inside] -= words[~inside] * min(MARK, held / outside)
    start, end = best_run(scores)
    # words before the run's first and behind its last word of the same block belong to it
    blocks: dict[int, list[str]] = {}
    edge = {t.block for t in found[start:end] if t.words}
    for i, t in enumerate(found):
        if (t.kind.startswith("word:") or t.kind == "<br") and (start <= i < end or t.block in edge):
            blocks.setdefault(t.block, []).append(t.text)
    lines = (_WHITE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep`` and ``text``."""
    weights = learn_weights(pages, html)
    names = [c for c in keep if c.lower() != "text"]
    source = pages.select(*map(col, names), col(html).cast("string").alias("__html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            texts = [main_text(p, weights) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return source.mapInArrow(work, StructType([*source.schema.fields[:-1], StructField("text", StringType())]))
