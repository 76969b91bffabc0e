"""The main text of web pages, as the best-scoring stretch of a page.

A page is a sequence of words and tags. A word scores the log odds that a word of its
context (nearest block, inside a link or not, kind of region) belongs to the article, a
tag costs the more the oftener it stands outside of articles; one linear scan finds the
contiguous stretch of the largest sum. The odds are counted on labelled pages: those that
mark their article themselves (an ``article`` element, else ``main``). The label says
which words count as inside; on other pages contexts alone decide.

Regions that no article contains (menus, footers, sidebars, adverts, notices, forms,
reader comments, and on a labelled page whatever is outside the label) are told by
element, role or class. Their words score low and are left out even if the best stretch
runs across them.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import release, slices

# -- fixed values of HTML ----------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong "
    "sub sup time tt u var audio button canvas img input map object output picture progress script select style svg textarea video br wbr".split()
)
#: An element that ends when one of these begins in the same parent.
ENDS = {"li": ("li", "ul", "ol", "menu"), "dt": ("dt", "dd", "dl"), "dd": ("dt", "dd", "dl"), "tr": ("tr", "table"), "td": ("td", "th", "tr", "table"), "th": ("td", "th", "tr", "table"), "option": ("option", "select")}
REGION_OF_TAG = {
    "nav": "menu", "menu": "menu", "aside": "aside", "footer": "footer", "header": "header", "form": "form", "button": "form",
    "select": "form", "textarea": "form", "fieldset": "form", "dialog": "notice", "script": "code", "style": "code",
    "noscript": "code", "template": "code", "head": "code", "title": "code", "svg": "code", "object": "code", "canvas": "code",
    "iframe": "code", "noembed": "code", "noframes": "code", "audio": "code", "video": "code",
}
REGION_OF_ROLE = {
    "navigation": "menu", "menu": "menu", "menubar": "menu", "complementary": "aside", "contentinfo": "footer", "banner": "header",
    "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice",
}
CLASS_WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc",
    "aside": "sidebar aside related recommended recommendations trending widget",
    "footer": "footer copyright colophon",
    "header": "masthead topbar",
    "notice": "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "comment": "comment comments disqus replies respond",
    "share": "share sharing social",
}
REGION_OF_CLASS = {word: region for region, words in CLASS_WORDS.items() for word in words.split()}

_TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']?)|[\"'])*+)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?(?=[\s\"'/]|$)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _region(name: str, attributes: str) -> str | None:
    """The kind of region an element opens by itself, or None."""
    own = REGION_OF_TAG.get(name)
    if not attributes or own == "code" or name in ("html", "body", "main"):
        return own
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key == "role":
            own = REGION_OF_ROLE.get(value.strip().lower(), own)
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "hidden"
        elif key in ("class", "id"):
            for token in value.split():
                words = [w for w in re.split(r"[^a-z0-9]+", _CAMEL.sub(" ", token).lower()) if w]
                if not {"no", "has", "with", "without", "not"} & set(words):
                    own = own or next((REGION_OF_CLASS[w] for w in words if w in REGION_OF_CLASS), None)
    return "comment" if own == "comment" else None if name == "article" else own


@dataclass
class Page:
    """What the scan sees: words by run of text, and tags, in page order."""

    #: (context, words, text, whether its region can be in an article, inside the label) or (tag name, parts blocks, inside the label)
    items: list[tuple] = field(default_factory=list)
    label: str | None = None  # the element that marks the article


class _Open:
    """Elements that are open, with what holds inside each."""

    def __init__(self):
        # name, nearest block, in a link, region, in an article, in a main element
        self.stack: list[tuple[str, str, bool, str | None, bool, bool]] = [("", "body", False, None, False, False)]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]

    def push(self, name: str, region: str | None) -> None:
        _, block, link, outer, article, main = self.stack[-1]
        if name in ("article", "main") and not region and outer in ("menu", "advert", "notice", "header", "share", "form"):
            outer = None  # an article in a menu: the menu was not closed
        self.at[name].append(len(self.stack))
        if name in BLOCKS:
            block = name
            self.blocks.append(len(self.stack))
        if not (region or outer):
            article, main = article or name == "article", main or name == "main"
        if name == "header" and (article or main):
            region = None  # of the article, not of the page
        self.stack.append((name, block, link or name == "a", outer or region, article, main))

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def close(self, name: str) -> None:
        found = self.at.get(name)
        if found and (name in BLOCKS or found[-1] > self.blocks[-1]):
            self.pop_to(found[-1])

    def begins(self, name: str) -> None:
        """End what ends by itself when ``name`` begins."""
        if name in BLOCKS and self.at["p"] and self.at["p"][-1] == self.blocks[-1]:
            self.pop_to(self.at["p"][-1])
        if name in ENDS:
            last = max(((self.at[x][-1], x) for x in ENDS[name] if self.at[x]), default=(0, ""))
            if last[1] in ENDS and name in ENDS[last[1]][:2]:
                self.pop_to(last[0])


def parse(source: str) -> Page:
    """Words and tags of a page in one pass; whatever the markup, in time about linear in its length."""
    items, now, pos, marks = [], _Open(), 0, set()

    def text(upto: int) -> None:
        if upto > pos:
            raw = source[pos:upto]
            raw = html.unescape(raw) if "&" in raw else raw
            _, block, link, region, article, main = now.stack[-1]
            items.append([f"{block}{' a' if link else ''}", region, raw, article, main])

    while True:
        m = _TOKEN.search(source, pos)
        if m is None:
            text(len(source))
            break
        text(m.start())
        pos, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        breaks = name in BLOCKS
        if m[1]:
            items.append((name, breaks, *now.stack[-1][4:]))
            now.close(name)
            continue
        now.begins(name)
        items.append((name, breaks, *now.stack[-1][4:]))
        if name in VOID:
            continue
        now.push(name, _region(name, m[3]))
        if name in ("article", "main") and now.stack[-1][3] is None:
            marks.add(name)
        if name in RAW:  # its content is no markup
            end = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(source, pos)
            pos = end.start() if end else len(source)
    label = min(marks, default=None)  # an article before a main element
    return Page([_item(x, label) for x in items], label)


def _item(x: list | tuple, label: str | None) -> tuple:
    inside = label is not None and bool(x[-2] if label == "article" else x[-1])
    if isinstance(x, tuple):
        return (x[0], x[1], inside)
    region = x[1] or ("outside" if label and not inside else None)
    return (f"{x[0]} {region or '-'}", len(x[2].split()), x[2], region is None, inside)


# -- scores -------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Counts (inside, outside) of words by context and of tags, on labelled pages."""

    words: dict[str, tuple[int, int]] = field(default_factory=dict)
    tags: dict[str, tuple[int, int]] = field(default_factory=dict)
    most: float = 6.0  # the largest score of a word, either way

    def word(self, context: str) -> float:
        """Log odds; what was never seen scores 1.1, or -3.9 in a region that articles do not contain."""
        inside, outside = self.words.get(context, (0, 0))
        a, b = (3, 1) if context.endswith(" -") else (1, 50)
        return max(-self.most, min(self.most, math.log((inside + a) / (outside + b))))

    def tag(self, name: str) -> float:
        """Below zero for every tag, near it for those that articles are full of. Labels themselves score nothing."""
        if name in ("article", "main"):
            return 0.0
        inside, outside = self.tags.get(name, (0, 0))
        return -min(1.0, math.log1p((outside + 1) / (inside + 1)))

    def score(self, x: tuple) -> float:
        """Of one item. Inside a label words score most and tags next to nothing."""
        if len(x) == 3:
            return self.tag(x[0]) * (0.01 if x[2] else 1)
        return x[1] * (self.most if x[4] and x[3] else self.word(x[0]))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous stretch with the largest sum, the first of equals; empty if no score is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(source: str, weights: Weights) -> str:
    """The blocks of the best stretch, one a line, without regions that are not the article's."""
    items = parse(source).items
    start, end = best_stretch([weights.score(x) for x in items])
    blocks, parts = [], []
    for x in items[start:end]:
        if len(x) == 3:
            if x[1]:
                blocks.append(parts)
                parts = []
            elif x[0] == "br":
                parts.append(" ")
        elif x[3]:
            parts.append(x[2])
    lines = (" ".join("".join(b).split()) for b in (*blocks, parts))
    return "\n".join(line for line in lines if line)


def _counts(sources: Iterator[str], into: dict) -> None:
    for source in sources:
        page = parse(source)
        if page.label is None:
            continue
        for x in page.items:
            if len(x) == 3:
                into["tag", x[0] if x[0] in BLOCKS or x[0] in INLINE or x[0] in VOID else "other"][not x[2]] += 1
            else:
                inside = x[3] and x[4]
                # The words outside count for their context as a page without a label would have it.
                context = x[0].removesuffix(" outside") + " -" if x[0].endswith(" outside") else x[0]
                into["word", context][not inside] += x[1]


def fit(pages: DataFrame) -> Weights:
    """Counts over all labelled pages of ``pages`` (column html); without any, the scores of things never seen.

    Contexts and tags are made of the fixed names above, so that what reaches the
    driver is a few hundred rows at most, whatever the number of pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict = defaultdict(lambda: [0, 0])
        for batch in slices(batches, 0):
            _counts((x or "" for x in batch.column(0).to_pylist()), into)
        rows = [(kind, key, *n) for (kind, key), n in into.items()]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["kind", "key", "inside", "outside"])

    found = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(run, "kind string, key string, inside long, outside long")
    rows = found.groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    of = lambda kind: {r["key"]: (r["inside"], r["outside"]) for r in rows if r["kind"] == kind}
    return Weights(of("word"), of("tag"))


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A NULL or empty page, and one without a word that scores, has an empty text. White
    space, of any kind that Unicode knows, is one space inside a block; blocks are
    joined by one line feed; a line break inside a block is white space. Broken
    markup is read as it comes: elements that are not closed end with their parent,
    comments, tags and scripts that are not closed end the page. Repeated rows and
    ids give a row each, other columns are ignored, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(x or "", weights) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
        release()

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), *[F.col(c).cast("string").alias(c) for c in ("url", "html")])
    return source.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
