"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser streams through a page once and yields its lines: the text between two
block-level tags, with the number of tags since the line before. A line's text-to-tag ratio (on a
logarithmic scale, links not counted as text) is smoothed by a Gaussian over its neighbours, so that
a short paragraph between long ones rises with them. Names of classes, ids and roles only weigh a
line's smoothed ratio down (or not, where they also say "content"). Lines above a threshold are
content. They vote, by their text, for the container that holds most of them, which grows to its
ancestors as long as what these add is content, too. The page's text is that container's lines, but
for those that were weighed down below the threshold and link lists at its ends.

A mark tells of a part of a page only: where half of the page's text, reader comments aside, has one
(a layout that is named after its sidebar, a page built of widgets), weights count from that text's. In
the same way, a form that holds more text than all the rest is the page's frame and no form.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultsift.llm.common import with_arrow

SIGMA = 1.5
#: Lines count as content from this part of the mean smoothed ratio on.
THRESHOLD = 0.5
#: A container takes the page's text if it holds this part of the content; a declared article needs half.
MAJORITY, DECLARED = 0.8, 0.5
#: A container grows to an ancestor if this part of the text that it adds is content or heading.
GROWS = 0.5
#: Weights of lines below a name that marks boilerplate, and one that may do so.
STRONG_MARK, WEAK_MARK = 0.1, 0.6
#: A line is a link if this part of its text is.
LINK = 0.8
#: Characters of marked text that a page must have before half of its text can lift a mark.
LIFTED = 250

SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title select textarea button nav footer aside dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ITEMS = frozenset("li dt dd tr td th option".split())
LISTS = frozenset("ul ol dl table menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of what readers wrote.
READERS = frozenset("comment comments commentlist commentsection discussion disqus replies reply respond responses talkback".split())
#: Names that mark what is no article, alone or as the first or last part of a name.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu modal nav navbar navigation newsletter popup promo promos promotion related sidebar signup social sponsor sponsored subscribe subscription widget widgets".split()) | READERS
#: Names that do so alone, and may do so as the first or last part of a name.
WEAK = frozenset("banner copyright disclaimer hidden legal notice notices notification recommended search share sharing skip toolbar".split())
#: Names that say the opposite, and words before a mark that only tell of it.
CONTENT = frozenset("article body content entry main post story text".split())
ABOUT = frozenset("has no with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
ARTICLE = frozenset(["article", "main"])
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*$")
_PARTS = re.compile(r"[a-z]+")


def mark_weight(value: str) -> float:
    """The weight that the names in a class or id give: 1 for names that mark nothing."""
    weight, content = 1.0, False
    names = value.lower().split()
    for name in names:
        parts = _PARTS.findall(name)
        if not parts or parts[0] in ABOUT:
            continue
        content |= not CONTENT.isdisjoint(parts)
        ends = {parts[0], parts[-1]}
        if not STRONG.isdisjoint(ends) or len(parts) == 1 and parts[0] in WEAK:
            weight = min(weight, STRONG_MARK)
        elif not WEAK.isdisjoint(ends):
            weight = min(weight, WEAK_MARK)
    # "post-comments" are comments; "content" beside "sidebar" in other names is content
    if content and weight < 1 and any(_PARTS.findall(n) and CONTENT.issuperset(_PARTS.findall(n)) for n in names):
        return 1.0
    return weight


def _named(attrs: list[tuple[str, str | None]], words: frozenset[str]) -> bool:
    """Whether a class or id begins or ends with one of the words."""
    parts = [_PARTS.findall(n) for name, value in attrs if name in ("class", "id") and value for n in value.lower().split()]
    return any(p and not words.isdisjoint((p[0], p[-1])) for p in parts)


class _Lines(HTMLParser):
    """Collects lines with their tags, links, headings and containers; containers are numbered as they open.

    frame: the number of the form (from 0, by its start) that frames the page; others are skipped.
    """

    def __init__(self, frame: int | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, container, skipped
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # where the open tags of each name stand
        self.blocks: list[int] = []  # and those that are not inline
        self.links = self.headings = self.articles = 0
        self.frame, self.forms, self.shown = frame, [], 0  # characters in each form, and outside
        self.parent, self.weight, self.declared, self.readers = [-1], [1.0], [False], [False]
        self.text: list[str] = []
        self.about: list[tuple[int, int, int, bool]] = []  # tags, characters of links, container, heading
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                self.text.append(text)
                self.about.append((self.tags, self.linked, self.open[-1][1] if self.open else 0, self.headings > 0))
                self.tags = 0
            self.linked = 0

    def _push(self, tag: str, container: int, skip: bool) -> None:
        self.at[tag].append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, container, skip))
        self.links += tag == "a"
        self.headings += tag in HEADINGS
        self.articles += tag in ARTICLE

    def _cut(self, to: int) -> None:
        for tag, _, _ in self.open[to:]:
            self.at[tag].pop()
            self.links -= tag == "a"
            self.headings -= tag in HEADINGS
            self.articles -= tag in ARTICLE
        del self.open[to:]
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()

    def _close(self, tag: str, until: frozenset[str]) -> None:
        """End the innermost open tag, unless one of until stands inside it."""
        if self.at[tag] and not any(self.at[t] and self.at[t][-1] > self.at[tag][-1] for t in until):
            self._cut(self.at[tag][-1])

    @staticmethod
    def _seen(attrs: list[tuple[str, str | None]]) -> bool:
        """Whether nothing hides the element."""
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return False
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return False
        return True

    @staticmethod
    def _weighed(tag: str, attrs: list[tuple[str, str | None]]) -> float:
        if tag in ("html", "body", "article", "main"):
            return 1.0
        weight = 1.0
        for name, value in attrs:
            if name in ("class", "id") and value:
                weight = min(weight, mark_weight(value))
            elif name == "role" and value in ROLES:
                weight = min(weight, STRONG_MARK)
        return weight

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        _, container, skip = self.open[-1] if self.open else ("", 0, False)
        if tag in INLINE:
            if attrs:
                # inside a line there is no ratio to weigh: a name that marks boilerplate alone takes its words out
                skip = skip or not self._seen(attrs) or tag != "a" and self._weighed(tag, attrs) <= STRONG_MARK
            self._push(tag, container, skip)
            return
        self._flush()
        if tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"})
        elif tag in ITEMS:
            self._close(tag, LISTS)
        _, container, skip = self.open[-1] if self.open else ("", 0, False)
        skip = skip or tag in SKIPPED or bool(attrs) and not self._seen(attrs)
        skip = skip or tag == "header" and not self.articles and not _named(attrs, CONTENT)
        if tag == "form" and not self.at["form"]:
            self.forms.append(0)
        self.parent.append(container)
        self.weight.append(self.weight[container] * (self._weighed(tag, attrs) if attrs else 1.0))
        self.declared.append(tag in ARTICLE)
        self.readers.append(self.readers[container] or bool(attrs) and _named(attrs, READERS))
        self._push(tag, len(self.parent) - 1, skip)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in INLINE:
            if self.at[tag] and (not self.blocks or self.at[tag][-1] > self.blocks[-1]):
                self._cut(self.at[tag][-1])
            return
        self._flush()
        self._close(tag, frozenset() if tag != "p" else CLOSES_P - {"p"})

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        size = 0 if self.links else len(data.strip())
        if self.at["form"]:
            self.forms[-1] += size
            if len(self.forms) - 1 != self.frame:
                return
        else:
            self.shown += size
        self.parts.append(data)
        self.linked += len(data) if self.links else 0

    def finish(self) -> None:
        self.close()
        self._flush()


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The Gaussian mean of each value's neighbours, as far as there are any."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def _read(html: str) -> _Lines:
    """The lines of a page; one that a form frames is read once more."""
    lines = _Lines()
    lines.feed(html)
    lines.finish()
    most = max(lines.forms, default=0)
    if 2 * most <= sum(lines.forms) + lines.shown:
        return lines
    lines = _Lines(frame=lines.forms.index(most))
    lines.feed(html)
    lines.finish()
    return lines


def _weights(lines: _Lines, at: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """The weight of each line, from that of half of the prose (characters outside links) that no reader wrote."""
    weight, told = np.array(lines.weight)[at], ~np.array(lines.readers)[at]
    order = np.argsort(-weight[told], kind="stable")
    so_far = np.cumsum(prose[told][order])
    if not len(so_far) or so_far[-1] < LIFTED:
        return weight
    half = weight[told][order][np.searchsorted(so_far, so_far[-1] / 2)]
    return np.where(told, np.minimum(1.0, weight / half), np.minimum(weight, STRONG_MARK))


def _region(lines: _Lines, at: np.ndarray, size: np.ndarray, content: np.ndarray, heading: np.ndarray, free: np.ndarray) -> tuple[int, int]:
    """The first and last container of the region; containers inside one another have consecutive numbers. free: lines without a mark."""
    n = len(lines.parent)
    votes, good, added = (np.bincount(at, weights=size * x, minlength=n).tolist() for x in (content, content | heading & free, free))
    last, parent = list(range(n)), lines.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        votes[p] += votes[i]
        good[p] += good[i]
        added[p] += added[i]
        last[p] = max(last[p], last[i])
    outer = set(parent)  # a paragraph is no container
    holds = [i for i in range(n) if lines.declared[i] and votes[i] >= DECLARED * votes[0] and votes[i] > 0]
    if holds:
        region, up = holds[-1], [i for i in holds[:-1] if last[i] >= holds[-1]][::-1]
    else:
        region, up = max(i for i in range(n) if votes[i] >= MAJORITY * votes[0] and (i in outer or i == 0)), []
        i = parent[region]
        while i >= 0:
            up.append(i)
            i = parent[i]
    for i in up:
        if good[i] - good[region] < GROWS * (added[i] - added[region]):
            break
        region = i
    return region, last[region]


def main_text(html: str | None, threshold: float = THRESHOLD, sigma: float = SIGMA) -> str:
    """The page's main text, one block a line; empty if it has none."""
    lines = _read(_CUT_TAG.sub("", html or ""))
    if not lines.text:
        return ""
    tags, linked, at, heading = (np.array(x) for x in zip(*lines.about, strict=True))
    size = np.array([len(t) for t in lines.text], float)
    link = linked >= LINK * size
    smooth = smoothed(np.log1p(np.maximum(size - linked, 0) / np.maximum(1, tags)), sigma)
    weight = _weights(lines, at, np.maximum(size - linked, 0))
    content = smooth * weight >= threshold * smooth.mean()
    if not smooth.any() or not content.any():  # links alone are no text
        return ""
    first, last = _region(lines, at, size, content, heading, weight >= 1)
    inside = (at >= first) & (at <= last) & (content | (weight >= 1))
    # links that follow one another stay at an end of the text only if all of them are content
    run = np.cumsum(np.diff(link, prepend=False))
    broken = np.bincount(run, weights=link & ~content) > 0
    here = np.flatnonzero(inside & (content & ~broken[run] | ~link | heading))
    if not len(here):
        return ""
    keep = np.flatnonzero(inside[: here[-1] + 1])
    return "\n".join(lines.text[i] for i in keep.tolist() if i >= here[0])


def extract(df: DataFrame, html: str = "html", name: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with the main text of each page.

    Null, empty and text-free pages give the empty text; markup that never ends is read to the end, and
    the work grows with the page's length, however deep its tags are nested. Repeated rows and other
    columns pass through; a column named like the output is replaced.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(v.as_py()) for v in batch.column(html)], pa.string())]

    return with_arrow(df, [html], [T.StructField(name, T.StringType())], compute, keep)
