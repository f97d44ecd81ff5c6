"""Main text of web pages by line-block distribution.

Markup is stripped into lines: one for each block of text, and a blank one for
each container tag between them.  Elements that never hold an article (menus,
footers, forms, ...) are left out.  A line weighs its characters, more in an
``article`` or ``main`` element, less in a link or outside a paragraph.  Weights
are summed over windows of ``WINDOW`` lines.  A surge is where the sum reaches the
upper threshold; a dive, to either side of it, is where no window that holds a
line reaches the lower one, or a whole window is blank.  The lines between are kept, and thin ones that lie
between two kept ones of the same container.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A character in a main element weighs as much as so many elsewhere; one in a link, or in no paragraph, this part.
MAIN_WEIGHT, LINK_WEIGHT, LOOSE_WEIGHT = 32, 0.125, 0.5
#: The upper threshold is a part of the page's largest sum, between two bounds; the lower one another part, up to a bound.
SURGE, SURGE_LEAST, SURGE_MOST, DIVE, DIVE_MOST = 1 / 32, 80, 400, 1 / 4, 32

# Elements by their part in a page, and names that mark what is no article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
PARAGRAPHS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
CONTAINERS = frozenset("body center div fieldset section table".split())
RAW = "script style noscript template textarea iframe svg math object canvas xmp".split()
LEFT_OUT = frozenset("aside button datalist dialog footer form head input label menu nav select title".split())
MARKS = frozenset("ad ads adsense advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
PLACES = frozenset("area bar block bottom box container content inner item left links list main outer page post primary right secondary section site top wrap wrapper".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
#: Elements whose end tag may be missing: what starts another, and the elements that bound the search for it.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption", "tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ("html",)),
    "a": (("a",), ()),
}
ENDS_P = BLOCKS - frozenset("body caption dd dt head html legend li summary tbody td tfoot th thead title tr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
LINK = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.IGNORECASE)
WORD_END = re.compile(r"[^a-z0-9]+")


def _marked(value: str) -> bool:
    """Whether a class or id names what is no article: each word of one of its names is a mark or a place, one at least a mark."""
    for name in value.lower().split():
        words = [w for w in WORD_END.split(name) if w]
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in PLACES for w in words):
            return True
    return False


def _judged(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element holds no part of the article, and whether it is a main one."""
    if name in LEFT_OUT or name == "header" and not inside:
        return True, False
    main = name in MAIN
    if not attributes or name in VOID:
        return False, main
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), entities.unescape("".join(values)).strip()
        if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "style" and INVISIBLE.search(value):
            if name not in ("html", "body", "main"):
                return True, False
        elif key == "role":
            if value.lower() in ROLES and name not in ("html", "body", "main"):
                return True, False
            main = main or value.lower() in MAIN
        elif key in ("class", "id") and name not in ("html", "body", "main") and _marked(value):
            if name != "article" or "comment" in value.lower():
                return True, False
    return False, main


@dataclass
class Line:
    """A block's text (empty: a blank line), its weight, and how many containers are open around it."""

    text: str
    weight: float
    depth: int


class _Open:
    """The open elements of a page, and what they make of the text in them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # name, left out, main
        self.places: dict[str, list[int]] = {}
        self.left_out = self.main = self.depth = self.paragraphs = 0

    def push(self, name: str, left_out: bool, main: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, left_out, main))
        self._count(name, left_out, main, 1)

    def cut(self, at: int) -> None:
        """End the elements from place ``at`` on."""
        while len(self.stack) > at:
            name, left_out, main = self.stack.pop()
            self.places[name].pop()
            self._count(name, left_out, main, -1)

    def _count(self, name: str, left_out: bool, main: bool, by: int) -> None:
        self.left_out += by * left_out
        self.main += by * main
        self.depth += by * (name in CONTAINERS)
        self.paragraphs += by * (name in PARAGRAPHS)

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)


def lines(page: str) -> list[Line]:
    """The lines of a page that may belong to the article, with blank ones between them."""
    out: list[Line] = []
    parts: list[str] = []
    open_ = _Open()
    linked = closed = False  # in a link, and one that has an end
    links = 0

    def close() -> None:
        nonlocal links
        # References are decoded once the block is whole; then white space, decoded or not, is one space.
        if parts and (text := " ".join(entities.unescape("".join(parts)).split())):
            linked_size = min(links, len(text))
            size = len(text) - linked_size + LINK_WEIGHT * linked_size
            size *= MAIN_WEIGHT if open_.main else 1 if open_.paragraphs else LOOSE_WEIGHT
            out.append(Line(text, size, open_.depth))
        parts.clear()
        links = 0

    def blank(n: int) -> None:
        out.extend(Line("", 0.0, open_.depth) for _ in range(n))

    for m in TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            if not open_.left_out and (text := m["text"] or m["cdata"]):
                parts.append(text)
                links += len(text) if linked else 0
            continue
        name, ending, was_main = name.lower(), bool(m["end"]), open_.main
        if name in BLOCKS:
            close()
            linked = linked and closed  # a link without an end reaches no further than its block
        if ending:
            if at := open_.places.get(name):
                # An end tag that another container's start hides ends nothing beyond it.
                if name in BLOCKS or at[-1] > open_.last(("td", "th", "li", "div", "section", "article", "main")):
                    open_.cut(at[-1])
            if name == "a":
                linked = False
        else:
            if name in SIBLINGS:
                same, bounds = SIBLINGS[name]
                after = open_.last(bounds)
                starts = [p for n in same for p in open_.places.get(n, ())[-1:] if p > after]
                if starts:
                    open_.cut(min(starts))
            if name in ENDS_P and (at := open_.places.get("p")):
                open_.cut(at[-1])
            left_out, main = _judged(name, m["attributes"], open_.main > 0)
            if name not in VOID and not (m["attributes"].endswith("/") and left_out):
                open_.push(name, left_out, main)
            if name == "a":
                linked = any(key.lower() == "href" for key, *_ in ATTRIBUTE.findall(m["attributes"]))
                following = LINK.search(page, m.end()) if linked else None
                closed = following is not None and bool(following[1])
            elif name in ("br", "td", "th") and not open_.left_out:
                parts.append(" ")
        if bool(was_main) != bool(open_.main):
            close()
            blank(WINDOW)  # no window holds lines of a main element and others
        elif name in CONTAINERS and not open_.main:
            blank(1)
    close()
    return out


def kept(found: list[Line]) -> list[bool]:
    """Which lines lie between a surge and its dives."""
    weights = [x.weight for x in found]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    best = max(sums, default=0)
    if not best:
        return [False] * len(found)
    upper, lower = min(best, max(SURGE_LEAST, min(SURGE * best, SURGE_MOST))), min(DIVE * best, DIVE_MOST)
    held = [max(sums[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(sums))]  # the largest window that holds a line
    out = [False] * len(found)
    start = 0
    for i in range(len(found) + 1):
        if i == len(found) or held[i] < lower or not sums[i]:  # a dive
            if any(s >= upper for s in sums[start:i]):
                out[start:i] = [x.text != "" for x in found[start:i]]
            start = i + 1
    before, least = -1, 0
    for i, line in enumerate(found):
        least = min(least, line.depth)
        if out[i]:
            if before >= 0 and least >= min(found[before].depth, line.depth) - 1:
                out[before:i] = [x.text != "" for x in found[before:i]]
            before, least = i, line.depth
    return out


def main_text(page: str | None) -> str:
    """The article of a page, a line a block; empty if there is none."""
    found = lines(page or "")
    return "\n".join(x.text for x, yes in zip(found, kept(found), strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html; other columns play no part).

    Null and empty html, and pages without an article, give an empty text.  Rows
    that repeat stay repeated; null ids and urls are kept.  Markup may be cut off
    anywhere: an open element ends with the page, and one whose end tag may be
    left out (p, li, td, ...) where HTML says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept_ = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept_.mapInArrow(run, "page_id long, url string, text string, n_chars long")
