"""Main text of web pages from streamed parser events.

The standard library's parser streams events into blocks: the lines of the page as a
reader sees them, each with its text, its tags and its place in the tree. A block's
text-to-tag ratio is its characters by its tags (1 at least). Menus, headers, footers,
sidebars, forms and the like, told by element or role, and adverts, notices, reader comments
and so on, told by a class or id all of whose words say so, have ratio 0. The ratios
are smoothed by a Gaussian and split into two clusters by the threshold of a one-dimensional
two-means.

The upper cluster selects the region of content: its blocks vote with their characters. If the page's articles
hold half of the votes, the region is the longest article, or, if others have half its length or more, the least
element around all of these (so of equal articles none is lost); else a main element with half of the votes; else the deepest container that
holds most of them; else the whole page. A container is a division, section, table cell or
the like around at least two blocks that are not boilerplate, never a block's own element. The
region's blocks that are not boilerplate make the text, in page order: short paragraphs belong to the
article too. Where blocks of the lower cluster lie before the first or after the last block of the upper one, a run of three
or more that consist of links goes, and if no article or main element marks the region, those go whose container holds no block
of the upper cluster, unless they are headings or read like text: links are a third of them at most, and they end like a
sentence or have SENTENCE words. Headings at the very end go with what they head.

A class or id counts only as a whole word of the attribute: "comment-list" and "cookie-notice"
do, "related-work" and "has-sidebar" do not. It counts on containers and lists; on a paragraph, a quotation or a phrase
only where it names an advert. It never counts on html, body and main, nor on an element
around the page's main element, a first-level heading or an article, and not at all if
nothing would be left. A form that wraps the article (it stands around such an element, or holds half of the page's text) is
a container, its controls and labels are not text. A header is boilerplate outside article and main only.

Every step is linear in the page: subtrees are ranges of element numbers, sums go from child
to parent, and end tags that HTML lets authors leave out are searched a few levels up only.

Defined results: a null or empty html, or one without text, gives an empty string; markup
that is cut off, not closed or malformed (declarations included) is read as far as it goes,
nested to any depth; an end tag that may be left out is looked for LOOK_BACK levels up, and a page with more than UNCLOSED tags
that a quote keeps open is read as if these were closed, which bounds the work on such pages; very long pages are read whole; repeated rows get a row each; other columns are
ignored, whatever their names; an empty table works.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, REACH = 1.0, 3
VOTES = 0.7
LINK_RUN = 3  # blocks of a menu
UNCLOSED = 50  # searches for the end of a tag that reach the page's end
LOOK_BACK = 32  # levels searched for an element that a start tag closes
ALIKE = 0.5  # of the longest article's length, from which another article is content too
SENTENCE = 10  # words of a block that is text without ending like a sentence
WRAPPED = 400  # characters of a form that holds half of the text

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
BOILERPLATE = frozenset("nav header footer aside menu form button select textarea dialog input option fieldset label legend".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
REGIONS = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section article main center td form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = INLINE | HEADINGS | frozenset("p blockquote pre dt dd figcaption caption".split())
#: Start tags that close an open element, and the elements beyond which they do not look for it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BORDERS = frozenset("ul ol dl menu select table article main section body".split())

#: Words of a class or id that name boilerplate, words of headers (article headers are none), and words that may stand beside them.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar sidenav aside widget widgets footer cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments commentlist discussion disqus reply replies respond pagination pager "
    "copyright toolbar skip".split()
)
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion".split())
HEADER_WORDS = frozenset("header masthead".split())
CONTENT_WORDS = frozenset("article post entry story content text page body".split())
NEUTRAL_WORDS = CONTENT_WORDS | frozenset("box wrap wrapper container inner outer list lists item items section area block group bar unit slot top bottom left right site global user reader links posts articles stories form thread js id the and of".split())
SENTENCE_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*\Z")
CUT_OFF = re.compile(r"<[A-Za-z/!][^<>]*\Z")  # a tag that the page's end cuts off
_PARTS = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def names_boilerplate(word: str, words: frozenset[str] = BOILERPLATE_WORDS | HEADER_WORDS) -> bool:
    """Whether one word of a class or id says that its element is boilerplate: some part does, and no part says anything else."""
    parts = {part.lower() for part in _PARTS.findall(word)}
    named = parts & words
    if named <= HEADER_WORDS and parts & CONTENT_WORDS:
        return False
    return bool(named) and parts <= named | NEUTRAL_WORDS


class Element:
    __slots__ = ("tag", "parent", "own", "named", "dropped", "inside", "heading")

    def __init__(self, tag: str, parent: int, own: bool, named: bool, dropped: bool, inside: bool):
        self.tag, self.parent = tag, parent
        self.own, self.named, self.dropped = own, named, dropped  # boilerplate by element or role; by name; not text
        self.inside = inside  # an article or main element, or inside one
        self.heading = False  # around the page's main element, an article or a first-level heading


class Block:
    __slots__ = ("text", "tags", "links", "size", "element")

    def __init__(self, element: int):
        self.text: list[str] = []
        self.tags = self.links = self.size = 0
        self.element = element


class BlockReader(HTMLParser):
    """Collects blocks from parser events. Elements are numbered as they begin, so that a subtree is a range of numbers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", -1, False, False, False, False)]
        self.stack = [0]
        self.counts: Counter[str] = Counter()  # open elements by tag
        self.blocks: list[Block] = []
        self.open: Block | None = None
        self.tags = self.anchors = self.unclosed = 0
        self.lasts: dict = {}

    def marks(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether the attributes make an element boilerplate outright, and by name."""
        own = named = False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                words = ADVERT_WORDS if tag in TEXTUAL else BOILERPLATE_WORDS | HEADER_WORDS
                named = named or any(names_boilerplate(word, words) for word in value.split())
            elif name == "role":
                own = own or value.strip().lower() in BOILERPLATE_ROLES
            elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDDEN.search(value):
                own = True
        return own, named and tag not in ("html", "body", "main")

    def close_implied(self, tag: str) -> None:
        if self.elements[self.stack[-1]].tag == "p":
            self.pop(len(self.stack) - 1)
        closed = CLOSES.get(tag)
        if closed and any(self.counts[c] for c in closed):
            found = 0
            for at in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - LOOK_BACK), -1):
                own = self.elements[self.stack[at]].tag
                if own in closed:
                    found = at
                    if tag != "tr" or own == "tr":
                        break
                elif own in BORDERS:
                    break
            if found:
                self.pop(found)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.tags += 1
            if tag in ("br", "hr"):
                self.handle_data(" ")
            return
        own, named = self.marks(tag, attrs)
        if tag in INLINE:
            self.tags += 1
            self.anchors += tag == "a"
            if not own and not named:
                return  # it does not change where its text belongs
        else:
            self.close_implied(tag)
        above = self.elements[self.stack[-1]]
        inside = above.inside or tag in REGIONS
        own = own or tag in BOILERPLATE and not (tag == "header" and above.inside)
        if tag in REGIONS:
            number = len(self.elements)
            self.elements.append(Element(tag, self.stack[-1], own, named, False, True))
        else:
            heading_here = tag in HEADINGS and above.tag == "header" and above.inside
            number = len(self.elements)
            self.elements.append(Element(tag, self.stack[-1], (own and not heading_here), named, above.dropped or tag in DROPPED, inside))
        if tag in ("main", "h1") or tag == "article" and not named:
            at = self.stack[-1]
            while at > 0 and not self.elements[at].heading:
                self.elements[at].heading = True
                at = self.elements[at].parent
        self.stack.append(number)
        self.counts[tag] += 1
        self.open = None
        self.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self, to: int) -> None:
        for at in self.stack[to:]:
            self.counts[self.elements[at].tag] -= 1
        del self.stack[to:]
        self.open = None

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if not self.counts[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.elements[self.stack[at]].tag == tag:
                self.pop(at)
                return

    def handle_data(self, data: str) -> None:
        if self.elements[self.stack[-1]].dropped:
            return
        if self.open is None:
            if not data.strip():
                return
            self.open = Block(self.stack[-1])
            self.blocks.append(self.open)
        own = self.open
        own.text.append(data)
        own.tags, self.tags = own.tags + self.tags, 0
        if words := len(data.strip()):
            own.size += words
            own.links += words if self.anchors else 0

    def ends(self, mark: str, i: int) -> int:
        """Where a mark ends at or behind i, or -1; the last one is looked up once, so that many starts without an end cost little."""
        if self.lasts.get("of") is not self.rawdata:
            self.lasts = {"of": self.rawdata}
        if mark not in self.lasts:
            self.lasts[mark] = self.rawdata.rfind(mark)
        return self.rawdata.find(mark, i) + len(mark) if i <= self.lasts[mark] else -1

    def parse_comment(self, i: int, report: bool = True) -> int:
        return super().parse_comment(i, report) if self.ends(">", i) >= 0 and (self.ends("--", i + 4) >= 0 or self.rawdata.startswith(("<!-->", "<!--->"), i)) else -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section, of whatever kind, is a comment up to its end."""
        return self.ends("]]>" if self.rawdata.startswith("<![CDATA[", i) else ">", i)

    def check_for_whole_start_tag(self, i: int) -> int:
        """The end of a start tag. A page with many tags that quotes keep open is read as if they were closed."""
        if self.unclosed < UNCLOSED and self.ends(">", i) >= 0:
            end = super().check_for_whole_start_tag(i)
            self.unclosed += end < 0
            return end
        return self.ends(">", i)


def boilerplate_of(elements: list[Element], use_names: bool, wrappers: frozenset[int] = frozenset()) -> list[bool]:
    """Of each element, whether its text is boilerplate. An article or main element ends what an unclosed menu began, not a comment or an advert; wrappers are forms around the content."""
    soft, hard = [False], [False]
    for n, e in enumerate(elements[1:], 1):
        named = use_names and e.named and not e.heading
        hard.append(hard[e.parent] or named)
        soft.append(e.own and n not in wrappers or (soft[e.parent] and e.tag not in REGIONS and not (e.tag in HEADINGS and elements[e.parent].tag == "header" and elements[e.parent].inside and not elements[e.parent].own)))
    return [s or h for s, h in zip(soft, hard)]


def subtree_sums(elements: list[Element], blocks: list[Block], values: list[int]) -> list[int]:
    """Of each element, the values of the blocks in it."""
    sums = [0] * len(elements)
    for block, value in zip(blocks, values):
        sums[block.element] += value
    for e in range(len(elements) - 1, 0, -1):  # from children to parents
        sums[elements[e].parent] += sums[e]
    return sums


def wrapping_forms(elements: list[Element], blocks: list[Block], texts: list[str], use_names: bool) -> frozenset[int]:
    """Forms around the page's main element, first-level heading or article, or around half of its text, of some length."""
    forms = frozenset(n for n, e in enumerate(elements) if e.tag in ("form", "fieldset"))
    if not forms:
        return forms
    boilerplate = boilerplate_of(elements, use_names, forms)
    chars = subtree_sums(elements, blocks, [0 if boilerplate[b.element] else len(t) for b, t in zip(blocks, texts)])
    return frozenset(n for n in forms if elements[n].heading or chars[n] >= WRAPPED and 2 * chars[n] >= chars[0])


def smooth(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(ratios, reach)
    return np.convolve(padded, kernel, "valid") / np.convolve(np.pad(np.ones(len(ratios)), reach), kernel, "valid")


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of numbers, by two-means from the extremes."""
    low, high = float(values.min()), float(values.max())
    border = (low + high) / 2
    for _ in range(50):
        under, over = values[values < border], values[values >= border]
        new = ((under.mean() if len(under) else low) + (over.mean() if len(over) else high)) / 2
        if new == border:
            break
        border = new
    return border


def _region(elements: list[Element], blocks: list[Block], texts: list[str], boilerplate: list[bool], votes: list[int], around: list[int], last: list[int]) -> tuple[int, bool]:
    """The element that the votes select, and whether articles or a main element mark it."""
    n, total = len(elements), votes[0]
    chars = subtree_sums(elements, blocks, [0 if boilerplate[b.element] else len(t) for b, t in zip(blocks, texts)])
    articles, end = [], -1
    for e in range(1, n):
        if elements[e].tag == "article" and e > end and chars[e]:  # the outermost ones
            articles.append(e)
            end = last[e]
    longest = max((chars[e] for e in articles), default=0)
    alike = [e for e in articles if chars[e] >= ALIKE * longest]
    if alike and 2 * sum(votes[e] for e in alike) >= total:
        region = alike[0]
        while last[region] < last[alike[-1]]:  # up to the element around all of them
            region = elements[region].parent
        return region, True
    mains = [e for e in range(1, n) if elements[e].tag == "main" and 2 * votes[e] >= total]
    if mains:
        return max(mains, key=lambda e: (votes[e], e)), True
    own = [0] * n
    for block in blocks:
        own[block.element] += not boilerplate[block.element]
    return max((e for e in range(1, n) if elements[e].tag in CONTAINERS and around[e] - own[e] > 1 and votes[e] >= VOTES * total), default=0), False


def containers(elements: list[Element]) -> list[int]:
    """Of each element, itself or the one around it that is no element of text."""
    out = [0]
    for n, e in enumerate(elements[1:], 1):
        out.append(out[e.parent] if e.tag in TEXTUAL else n)
    return out


def _reads_like_text(block: Block, text: str, element: Element) -> bool:
    if 3 * block.links > block.size:
        return False
    return element.tag in HEADINGS or bool(SENTENCE_END.search(text)) or len(text.split()) >= SENTENCE


def _select(reader: BlockReader, blocks: list[Block], texts: list[str], boilerplate: list[bool]) -> list[int]:
    """The numbers of the blocks that make the text."""
    ratios = np.array([0.0 if boilerplate[b.element] else len(t) / max(1, b.tags) for b, t in zip(blocks, texts)])
    if not ratios.any():
        return []
    smoothed = smooth(ratios) * (ratios > 0)
    chosen = smoothed >= threshold(smoothed)
    elements, n = reader.elements, len(reader.elements)
    votes = subtree_sums(elements, blocks, [len(t) if ok else 0 for t, ok in zip(texts, chosen.tolist())])
    around = subtree_sums(elements, blocks, [int(not boilerplate[b.element]) for b in blocks])
    last = list(range(n))
    for e in range(n - 1, 0, -1):
        last[elements[e].parent] = max(last[elements[e].parent], last[e])
    region, marked = _region(elements, blocks, texts, boilerplate, votes, around, last)
    kept = [i for i, b in enumerate(blocks) if not boilerplate[b.element] and region <= b.element <= last[region]]
    upper = [k for k, i in enumerate(kept) if chosen[i]]
    first, end = (upper[0], upper[-1]) if upper else (0, len(kept))
    outside = [not chosen[i] and not first <= k <= end for k, i in enumerate(kept)]
    if not marked and upper:
        around_text = containers(elements)
        held = [around_text[blocks[i].element] for i in kept]
        upheld = {c for c, i in zip(held, kept) if chosen[i]}
        stays = [not o or c in upheld or _reads_like_text(blocks[i], texts[i], elements[blocks[i].element]) for o, c, i in zip(outside, held, kept)]
        cut_short = False in stays[upper[-1] :]
        while cut_short and outside[len(stays) - 1] and (not stays[-1] or elements[blocks[kept[len(stays) - 1]].element].tag in HEADINGS):
            stays.pop()  # headings of what has gone
        kept, outside = [i for i, s in zip(kept, stays) if s], [o for o, s in zip(outside, stays) if s]
    link = [o and blocks[i].size > 0 and blocks[i].links == blocks[i].size for o, i in zip(outside, kept)]
    out, run = [], 0
    for k, i in enumerate(kept):
        run = run + 1 if link[k] else 0
        out.append(i)
        if run == LINK_RUN:
            del out[-LINK_RUN:]
        elif run > LINK_RUN:
            out.pop()
    return out


def main_text(html: str | None) -> str:
    reader = BlockReader()
    reader.feed(CUT_OFF.sub("", html or ""))
    reader.close()
    blocks, texts = [], []
    for block in reader.blocks:
        text = " ".join("".join(block.text).split())
        if text:
            blocks.append(block)
            texts.append(text)
    for use_names in (True, False):
        wrappers = wrapping_forms(reader.elements, blocks, texts, use_names)
        kept = _select(reader, blocks, texts, boilerplate_of(reader.elements, use_names, wrappers))
        if kept:
            break
    return " ".join(texts[i] for i in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
