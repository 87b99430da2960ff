"""Main text of web pages by consensus host paths.

First every page's containers are scored: a paragraph's letters count for its parent and, halved, for the container
above; link text counts against it. A container's generalised path is its chain of tags and class names, with digits
wiped out. The scores are the pages' votes, summed in Spark for each host and path (partial sums first, so a large host
sends few rows). Then every page is read again and the text of the elements on its host's winning path is taken; a page
without such an element, or with no text there, falls back on its own best container, then on all its parts. A path inside an
article or main element is lifted to the outermost such element whose further text is mostly no links, so that headlines, leads
and sections beside the winner stay.

Scripts, controls, hidden parts and the like never count. Menus, footers, forms and parts named like adverts or notices are
suspects: one goes unless it holds over half of the page's text outside links (a page in one form, an article that is
called "share price", a menu that is never closed); readers' comments and closed menus go in any case. A page that would be left
empty keeps its suspects.

Tags are read as HTML has it: a quote opens a value only after an equals sign; one that never ends is part of the value. The
work is linear in the page's length, however deep its tags nest.

Defined cases: null or empty html gives an empty text; a null or odd url belongs to the empty host; repeated
rows vote and are extracted apiece; ties between paths go to the deeper, then the lesser path; unclosed tags end where
their parent does; html that ends in mid-tag is read up to there; a very long page is read whole; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm.shared import materialize, trimmed

#: Winning paths are broadcast up to this many bytes; beyond, they are joined by a salted shuffle.
BROADCAST_BYTES, SALTS = 16 << 20, 32

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: The end of a tag, or an attribute with its value: quoted, or up to white space.
ATTRIBUTE = re.compile(r"([\s/]*+)(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?)")
INVISIBLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Text is mostly no links if it is longer than so many times its linked part.
MOST_LINKED = 2
CONTAINERS = frozenset("article body div main section td".split())
#: Elements whose text is never main text.
DROPPED = frozenset("script style noscript template iframe svg math button select textarea input object canvas audio video head title noembed noframes xmp".split())
#: Suspects by their tag.
SUSPECT = frozenset("nav footer aside form menu dialog".split())
BAD_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promos?|banner|side-?bar|menus?|nav(?:bar|igation)?|breadcrumbs?|footer|foot|masthead|site-?header|page-?header|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|sign-?up|login|share|sharing|social|related|recommend(?:ed|ations)?|comments?(?:-?list)?|disqus|respond|replies|reply|widgets?|toolbar|pagination|pager|hidden|legal|copyright|tags?-?list)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?(?:-?list)?|disqus|respond|replies|reply)(?:$|[\s_-])", re.I)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: What an opening tag ends if it is still open, up to the nearest of its scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_SCOPE = frozenset("article aside blockquote body div footer form header li main nav section table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(eq=False)
class Element:
    tag: str
    step: str
    parent: Element | None
    path: int = 0  # of the generalised path
    dropped: bool = False
    suspect: str = ""  # why: "half" (goes unless it holds half the text), "part" (goes if it is closed), "comments"
    in_article: bool = False
    header: Element | None = None
    heading: bool = False  # it or an element between it and its header is a headline
    nearest: Element | None = None  # the container that it is or lies in
    closed: bool = False
    size: int = 0
    linked: int = 0
    gone: bool = False
    inside: bool = False


@dataclass(eq=False)
class Block:
    """One block of text with the element that it stands in; each part with its own element and whether it is linked."""

    element: Element
    parts: list[tuple[Element, str, bool]] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    text: str = ""

    def settle(self) -> bool:
        """Set text and sizes from the parts whose elements stay; whether any text is left."""
        left = [(t, k) for e, t, k in self.parts if not e.gone]
        self.text = " ".join("".join(t for t, _ in left).split())
        self.size, self.linked = sum(len(t) for t, _ in left), sum(len(t) for t, k in left if k)
        return bool(self.text)


@dataclass
class Page:
    elements: list[Element]
    blocks: list[Block]


def host_of(url: str | None) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def step(tag: str, attributes: dict[str, str]) -> str:
    """A path's step: the tag and its class names, sorted, without digits."""
    names = sorted({re.sub(r"\d+", "", x) for x in attributes.get("class", "").lower().split()} - {""})
    return ".".join([tag, *names])


def path_of(e: Element | None) -> str:
    """The generalised path in words."""
    steps = []
    while e is not None and e.tag:
        steps.append(e.step)
        e = e.parent
    return "".join(f"/{x}" for x in reversed(steps))


def attributes_at(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """(attributes, end of the tag, whether a slash closes it) of the tag whose name ends at ``at``."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        before, end, name, *values = m.groups()
        if end:
            return found, m.end(), before.endswith("/")
        if m.end() == len(page) or not name and m.end() == at:
            return found, len(page), False
        if name:
            found.setdefault(name.lower(), html.unescape(next((v for v in values if v is not None), "")))
        at = m.end()


def suspicion(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """Why an element may be no main text, empty if there is no reason."""
    names = (attributes.get("class", ""), attributes.get("id", "")) if tag not in ("html", "body") else ()
    if any(map(COMMENTS.search, names)):
        return "comments"
    if tag in SUSPECT and tag != "form" or tag == "header" and not in_article:
        return "part"
    return "half" if tag == "form" or attributes.get("role", "").lower() in BAD_ROLES or any(map(BAD_NAMES.search, names)) else ""


def parse(page: str) -> Page:
    """The elements of a page, parents first, and its text blocks in order; text of dropped elements is left out."""
    root = Element("", "", None)
    root.nearest = root
    stack, elements, blocks = [root], [root], []
    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag
    top: list[int] = []  # depths of the open block elements
    endless: set[str] = set()
    block: Block | None = None
    links = 0

    def add(text: str) -> None:
        nonlocal block
        if stack[-1].dropped:
            return
        if block is None:
            if not text or text.isspace():
                return
            block = Block(stack[-1])
            blocks.append(block)
        block.parts.append((stack[-1], html.unescape(text) if "&" in text else text, links > 0))

    def close(depth: int) -> None:
        nonlocal block, links
        for e in reversed(stack[depth:]):
            if e.tag in BLOCKS:
                block = None
                top.pop()
            if e.tag:
                depths[e.tag].pop()
            links -= e.tag == "a"
        del stack[depth:]

    def deepest(tags: frozenset | set) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=0)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        attributes, at, slash = attributes_at(page, at) if page[at : at + 1] != ">" else ({}, at + 1, False)
        if m[1]:
            if depths[tag]:
                depth = depths[tag][-1]
                if tag in BLOCKS or not top or top[-1] < depth:
                    stack[depth].closed = True
                    close(depth)
                else:  # an inline element that ends across blocks: they stay open
                    depths[tag].pop()
                    links -= tag == "a"
                    stack[depth] = ghost = Element("", stack[depth].step, stack[depth].parent)
                    ghost.dropped = stack[depth - 1].dropped
                    elements.append(ghost)
            elif tag in BLOCKS:
                block = None
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            continue
        if tag in BLOCKS:
            if tag != "option" and depths["p"] and depths["p"][-1] > deepest(P_SCOPE):
                close(depths["p"][-1])
            block = None
        if tag in CLOSES:
            ended, scope = CLOSES[tag]
            depth = deepest(ended)
            if depth > deepest(scope):
                close(depth)
        if tag in RAW:
            stop = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if stop:
                closing = page.find(">", stop.end())
                at = end if closing < 0 else closing + 1
            elif tag in ("script", "style"):
                at = end
            else:
                endless.add(tag)
            continue
        if slash and tag not in BLOCKS:
            continue
        parent = stack[-1]
        e = Element(tag, step(tag, attributes), parent)
        e.path = step_key(parent.path, e.step)
        e.dropped = parent.dropped or tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(INVISIBLE.search(attributes.get("style", "")))
        e.in_article = parent.in_article or tag in ("article", "main")
        e.suspect = suspicion(tag, attributes, parent.in_article)
        e.header = e if tag == "header" else parent.header
        e.heading = tag != "header" and (parent.heading or tag in HEADINGS)
        e.nearest = e if tag in CONTAINERS else parent.nearest
        depths[tag].append(len(stack))
        if tag in BLOCKS:
            top.append(len(stack))
        links += tag == "a"
        stack.append(e)
        elements.append(e)
    return Page(elements, blocks)


def read_page(page: str) -> Page:
    """The page with ``gone`` set for what a suspect takes away; the blocks that are left."""
    found = parse(page)
    for b in found.blocks:
        for e, text, linked in b.parts:
            e.size += len(text)
            e.linked += len(text) * linked
    for e in reversed(found.elements[1:]):
        e.parent.size += e.size
        e.parent.linked += e.linked
    root = found.elements[0]
    plain = root.size - root.linked
    for e in found.elements[1:]:
        stays = not e.suspect or (e.suspect == "half" or e.suspect == "part" and not e.closed) and 2 * (e.size - e.linked) > plain
        e.gone = e.parent.gone or not stays
    left = [b for b in found.blocks if wanted(b) and b.settle()]
    if not left:
        for e in found.elements:
            e.gone = False
        left = [b for b in found.blocks if b.settle()]
    return Page(found.elements, left)


def wanted(block: Block) -> bool:
    """Not in a part that goes; of a header inside the article only its headings."""
    e = block.element
    return not e.gone and (e.header is None or e.heading)


def container_scores(page: Page) -> dict[int, float]:
    """The score of each generalised container path that has one above 0."""
    scores: dict[int, float] = defaultdict(float)
    for b in page.blocks:
        box = b.element.nearest
        if box is None:
            continue
        worth = b.size - 2.0 * b.linked
        if b.element.tag in ("p", "pre", "blockquote") or b.element.tag in ("b", "i", "em", "strong", "span", "a", "code", "u"):
            worth *= 1.5
        scores[box.path] += worth * (1.25 if box.tag in ("article", "main") else 1.0 if box.tag else 0.5)  # text outside all containers counts half
        above = box.parent.nearest if box.parent is not None else None
        if above is not None:
            scores[above.path] += 0.5 * worth
    return {k: v for k, v in scores.items() if v > 0}


def depths_of(page: Page, paths) -> dict[int, int]:
    """How deep each of the paths lies."""
    depth = {page.elements[0]: 0}
    found = {0: 0} if 0 in paths else {}
    for e in page.elements[1:]:
        depth[e] = depth.get(e.parent, 0) + 1
        if e.path in paths:
            found[e.path] = depth[e]
    return found


def lifted(page: Page, path: int) -> Element | None:
    """The outermost article or main element above ``path`` that adds text, most of it outside links; else one on ``path``."""
    first = next((e for e in page.elements if e.path == path and (e.tag or not e.parent)), None)
    if first is None:
        return None
    for e in page.elements:
        e.size = e.linked = 0
    for b in page.blocks:
        b.element.size += b.size
        b.element.linked += b.linked
    sizes: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for e in reversed(page.elements[1:]):
        e.parent.size += e.size
        e.parent.linked += e.linked
        sizes[e.path][0] += e.size
        sizes[e.path][1] += e.linked
    best, e = first, first.parent
    while e is not None and e.tag:
        if e.tag in ("article", "main"):
            size, linked = (x - y for x, y in zip(sizes[e.path], sizes[best.path], strict=True))
            if size > MOST_LINKED * linked:
                best = e
        e = e.parent
    return best


def text_within(page: Page, path: int) -> str:
    page.elements[0].inside = path == 0
    for e in page.elements[1:]:
        e.inside = e.path == path or e.parent.inside
    return "\n\n".join(b.text for b in page.blocks if b.element.inside)


def key_of(path: str) -> int:
    """The hash of a path in words."""
    key = 0
    for x in path.split("/")[1:]:
        key = step_key(key, x)
    return key


def step_key(parent: int, own: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent:x}/{own}")


def extract(page: str | None, path: int | str | None) -> tuple[str, str | None]:
    """(text, path used): the winning path's text, or that of the page's own best container, or of all its parts."""
    if not page:
        return "", None
    found = read_page(page)
    for own in (key_of(path) if isinstance(path, str) else path, None):
        if own is None:
            scores = container_scores(found)
            if not scores:
                break
            depth = depths_of(found, scores)
            own = max(scores, key=lambda p: (scores[p], depth.get(p, 0), p))
        best = lifted(found, own)
        text = text_within(found, best.path) if best is not None else ""
        if text:
            return text, path_of(best)
    return "\n\n".join(b.text for b in found.blocks), None


def strings(column: pa.Array) -> Iterator[str | None]:
    return iter(column.to_pylist())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host's pages, as a 64-bit hash of its steps."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            votes: dict[tuple[str, int], float] = defaultdict(float)
            depth: dict[int, int] = {}
            for url, page in zip(strings(part.column(0)), strings(part.column(1)), strict=True):
                found = read_page(page or "")
                scores = container_scores(found)
                depth |= depths_of(found, scores)
                total = sum(scores.values())
                for path, x in scores.items():
                    votes[host_of(url), path] += x / total
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([signed(p) for _, p in votes], pa.int64()), pa.array([depth[p] for _, p in votes], pa.int32()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "depth", "votes"])

    votes = pages.select("url", "html").mapInArrow(trimmed(run), "host string, path long, depth int, votes double")
    total = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"), F.max("depth").alias("depth"))
    return total.groupBy("host").agg(F.max_by("path", F.struct("votes", "depth", "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every page."""

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    winners = materialize(host_paths(own), "host-paths")
    size = winners.agg(F.sum(F.length("host") + 64).alias("n")).first()["n"] or 0
    keyed = own.withColumn("host", F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit(""))))
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [extract(page, None if path is None else path % (1 << 64)) for page, path in zip(strings(part.column(2)), strings(part.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long, path string")
