"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into blocks of text, the lines of the method.
Each has a ratio of its characters outside links to its tags; the ratios along the page are smoothed
by a Gaussian and split by a threshold into content and the rest. Blocks above it are the text, with
the short ones between them and the title before; an article, or the element that holds most of it,
is taken whole if most of its characters are above. Tags and names of elements take away what they
mark as something else; those that name a place or a layout (``sidebar``, ``widget``, ``form``) yield
where the ratios find nearly all of the page's content in their element.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, valid

#: Standard deviation of the smoothing, in blocks.
SIGMA = 1.0
#: Share of the content's characters that an element must hold to be taken for the place of all.
MOST = 0.75
#: Share of the upper cluster's mean from which a ratio's logarithm counts with it, on pages of almost nothing but text.
NEAR = 2 / 3
#: Characters of content for each field from which a form that holds a page's content is a page in a form.
FIELD = 200
#: Share of such an element's characters that must be content for it to be kept whole.
WHOLE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are a part of a text, with other parts beside them, rather than the place of all.
PARTS = HEADINGS | frozenset("p li ul ol dl blockquote pre figure".split())
#: Elements that nobody sees as text.
UNSEEN = frozenset(
    "script style noscript template head title select option textarea iframe object embed svg math canvas audio video".split()
)
#: Elements that are never part of a text.
NEVER = frozenset("nav footer button menu".split())
#: Elements that aren't either, unless they hold the content of the page.
SELDOM = frozenset("header aside form dialog".split())
FIELDS = frozenset("input select textarea button label".split())
#: Names in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup nav navbar"
    " navigation menu menubar breadcrumb breadcrumbs sidebar complementary widget widgets related recommended"
    " recommendations share sharing social comment comments commentlist respond reply replies disqus footer"
    " contentinfo pagination pager skip toolbar search login teaser teasers".split()
)
#: Those of them that also name a layout or a place of the whole page.
PLACES = frozenset("banner modal overlay popup promo promotion sidebar complementary widget widgets toolbar search login signup social".split())
OTHERS = MARKS - PLACES
#: Names that do so outside the article only, where they may hold its title.
OUTER = frozenset("header masthead topbar".split())
#: Words beside such a name that leave its meaning: ``site-footer``, but not ``share-price`` or ``no-sidebar``.
PLAIN = frozenset(
    "site page post posts article articles entry blog main global top bottom left right upper lower first last primary secondary sticky"
    " fixed bar box block container wrapper wrap inner outer area section slot unit panel list item items link links button buttons"
    " form text body content title heading group row col column module component area thread count icons media us me".split()
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def marked(attrs, names: frozenset = MARKS) -> bool:
    """Whether a whole name of class, id or role is of these names, with plain words beside them at most."""
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.split():
                parts = [x.lower() for x in _NAME.findall(name)]
                if any(x in names for x in parts) and all(x in names or x in MARKS or x in PLAIN for x in parts):
                    return True
    return False


class Page(HTMLParser):
    """Blocks of a page: ``text``, number of tags, characters in links, the element they are in.

    ``mark`` of an element is 1 if a tag or name of a place takes it from the main text, 2 if another one does,
    3 if it is unseen and makes no blocks, it or one that it is in. ``fields`` counts the fields of a form in it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.kind, self.mark = [-1], ["html"], [0]  # of each element that was opened
        self.fields = [0]
        self.stack = [0]
        self.blocks: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.tags, min(self.linked, len(text)), self.stack[-1]))
                self.tags = 0
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in FIELDS and ("type", "hidden") not in attrs:
            self.fields[self.stack[-1]] += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            self.imply(tag)
        above = self.stack[-1]
        mark = 3 if tag in UNSEEN or self.mark[above] == 3 else self.judge(tag, attrs)
        if mark and tag in INLINE:
            if mark < 3 and self.parts:
                self.parts.append(" ")
            mark = 3
        if tag == "a":
            self.links += 1
        self.parent.append(above), self.mark.append(mark), self.fields.append(0)
        self.kind.append("main" if ("role", "main") in attrs else tag)
        self.stack.append(len(self.parent) - 1)

    def judge(self, tag, attrs) -> int:
        """The mark that a tag and its names give."""
        if tag in ("html", "body", "main"):
            return 0
        if tag == "article":  # reader comments are often articles, too
            return 2 if attrs and marked(attrs, frozenset(("comment", "comments", "reply", "teaser", "related"))) else 0
        if tag in NEVER or attrs and marked(attrs, OTHERS):
            return 2
        if tag in SELDOM and tag != "header" or attrs and marked(attrs):
            return 1
        if tag == "header" or attrs and marked(attrs, OUTER):
            return 0 if any(self.kind[k] in ("article", "main") for k in self.stack) else 1
        return 0

    def imply(self, tag) -> None:
        """Ends a paragraph, list item or cell that the start of tag ends."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            kind = self.kind[self.stack[k]]
            if kind == "p" or kind in ends:
                self.close_to(k)
            elif kind not in INLINE:
                return

    def close_to(self, k: int) -> None:
        for node in self.stack[k:]:
            self.links -= self.kind[node] == "a"
        del self.stack[k:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            kind = self.kind[self.stack[k]]
            if kind == tag or kind == "main" and tag in ("div", "section"):
                return self.close_to(k)
            if tag in INLINE and kind not in INLINE:
                return None
        return None

    def handle_data(self, data):
        if self.mark[self.stack[-1]] == 3:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def finish(self, html: str) -> None:
        self.feed(html)
        self.close()
        self.flush()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; beyond its ends the last values go on."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def split_threshold(values: np.ndarray) -> float:
    """Midway between the means of the two clusters into which these values fall best (two-means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        upper = values > middle
        if not upper.any() or upper.all():
            return middle
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            return middle
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by two line feeds."""
    if not html:
        return ""
    page = Page()
    page.finish(html)
    if not page.blocks:
        return ""
    size = np.array([len(t) for t, _, _, _ in page.blocks])
    plain = size - np.array([linked for _, _, linked, _ in page.blocks])
    ratio = smoothed(np.log1p(plain / np.array([max(1, tags) for _, tags, _, _ in page.blocks])))
    out = outside(page, np.where(ratio >= split_threshold(ratio), plain, 0))
    own = np.array([not out[node] for _, _, _, node in page.blocks])
    if not own.any():
        return ""
    upper = ratio[ratio >= split_threshold(ratio)].mean()
    content = own & (ratio >= min(split_threshold(ratio), split_threshold(ratio[own]), NEAR * upper))
    weight = np.where(content, plain, 0)

    inside = characters(page, weight)  # content characters in each element
    total = characters(page, np.where(own, plain, 0))
    named = [k for k in range(len(page.parent)) if page.kind[k] in ("article", "main") and not out[k] and inside[k]]
    best = 0
    if named:
        best = max(named, key=lambda k: (inside[k], total[k]))
        for k in named:  # an article in the main element, rather than that
            if inside[k] >= MOST * inside[best] and k > best and within(page, k, best):
                best = k
    else:
        children: dict[int, list[int]] = {}
        for k in range(1, len(page.parent)):
            if page.kind[k] not in INLINE and page.kind[k] not in PARTS:
                children.setdefault(page.parent[k], []).append(k)
        while more := [k for k in children.get(best, ()) if inside[k] >= MOST * inside[0] and inside[k]]:
            best = more[0]
    whole = [
        (k == best or page.kind[k] == "article" and not out[k]) and inside[k] >= WHOLE * total[k] and inside[k] > 0
        for k in range(len(page.parent))
    ]
    for k in range(1, len(whole)):
        whole[k] = whole[k] or whole[page.parent[k]]
    keep = np.array([whole[node] for _, _, _, node in page.blocks])
    prose = own & (2 * (size - plain) < size)
    keep = own & keep & (prose | bool(named)) | content & prose
    for begin, end in gaps(keep):
        if begin and end < len(keep):
            keep[begin:end] = prose[begin:end]
        elif end < len(keep):  # the title, and what is between it and the text
            titles = [k for k in range(end) if prose[k] and heading(page, page.blocks[k][3])]
            if titles:
                keep[titles[0] : end] = prose[titles[0] : end]
    return "\n\n".join(text for (text, _, _, _), kept in zip(page.blocks, keep, strict=True) if kept)


def characters(page: Page, weight: np.ndarray) -> np.ndarray:
    """The sum of its blocks' weights for each element, those in its children among them."""
    inside = np.zeros(len(page.parent))
    for (_, _, _, node), w in zip(page.blocks, weight, strict=True):
        inside[node] += w
    for node in range(len(page.parent) - 1, 0, -1):  # parents come before their children
        inside[page.parent[node]] += inside[node]
    return inside


def outside(page: Page, weight: np.ndarray) -> list[bool]:
    """Whether each element is none of the main text, by its marks and the blocks' characters above the threshold.

    A mark of a place counts unless the element holds MOST of what no other mark takes away. It counts
    in any case beside an article that has content without it, and for a form with many fields.
    """

    def taken(level: int, kept=()) -> list[bool]:
        out = [False] * len(page.parent)
        for k in range(1, len(out)):
            out[k] = out[page.parent[k]] or page.mark[k] >= level and k not in kept
        return out

    out = taken(1)
    places = [k for k, mark in enumerate(page.mark) if mark == 1]
    if not places:
        return out
    nodes = [node for _, _, _, node in page.blocks]
    hard = taken(2)
    inside = characters(page, np.where([hard[n] for n in nodes], 0, weight))
    free = characters(page, np.where([out[n] for n in nodes], 0, weight))
    articles = [int(kind in ("article", "main") and free[k] > 0) for k, kind in enumerate(page.kind)]
    beside = sum(articles)
    fields = page.fields[:]
    for k in range(len(fields) - 1, 0, -1):
        fields[page.parent[k]] += fields[k]
    for k in range(1, len(articles)):  # how many of them an element is in
        articles[k] += articles[page.parent[k]]
    kept = {
        k
        for k in places
        if inside[k]
        and inside[k] >= MOST * inside[0]
        and articles[k] == beside
        and (page.kind[k] != "form" or inside[k] >= FIELD * fields[k])
    }
    return taken(1, kept) if kept else out


def gaps(keep: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of blocks that aren't kept."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def heading(page: Page, node: int) -> bool:
    while page.kind[node] in INLINE:
        node = page.parent[node]
    return page.kind[node] in HEADINGS


def within(page: Page, node: int, above: int) -> bool:
    while node > above:
        node = page.parent[node]
    return node == above


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of pages (``page_id, url, html``).

    text is the main text, empty where html is null, empty or has none. White space in a block,
    line breaks among it, becomes one space; nothing is cut off. Repeated rows and nulls in page_id
    or url are returned as they are; other columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", valid("html"))
    out = pages.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_text(table(spark, sf_dir, "pages"))
