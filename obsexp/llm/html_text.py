"""Main text of web pages by minimum-cut labelling of text blocks.

A page becomes a list of text blocks with their place in the document tree. A fixed linear classifier gives each block
a cost for either label, from its text (length, share of links, how it ends) and from the tags and class names around it;
blocks that follow one another and blocks with a near common ancestor are tied by smoothness edges, weaker where one of
the two lies in a named boilerplate element and the other does not; the minimum cut over both is the labelling. Costs and
edges are of one scale: a short or linked line is kept or dropped with the blocks around it. Pages are independent, so
no rows move.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mincut import cut_labels

TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<decl>[!?])[^>]*(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?P<end>>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")

# Elements whose content is never text of the page.
SILENT = frozenset("script style head title noscript template svg iframe object embed canvas audio video select option "
                   "textarea datalist map input".split())
# Of these the content is not even markup.
RAW = frozenset("script style title textarea iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
# A start tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl article main section body".split())

CONTENT_TAGS = {"article": 4.0, "main": 3.0}
FRAME_TAGS = frozenset("nav header footer aside form menu dialog".split())
CONTENT_NAMES = frozenset("article content entry main page post story text topic".split())
FRAME_NAMES = frozenset(
    "ad ads adbox adsbygoogle advert adverts advertisement advertising alert banner breadcrumb breadcrumbs consent "
    "cookie cookies copyright disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pagination pager popup promo promoted promotion recommended related respond share sharing "
    "sidebar sidebars signup social sponsor sponsored subscribe subscription teaser toolbar topbar".split())
COMMENT_NAMES = frozenset("comment comments commentlist reply replies disqus".split())
# An article inside one of these is a card, not the page's article. Inside any other boilerplate element it shows that the
# element describes a layout or was never closed.
CARD_NAMES = frozenset("promoted recommended related sidebar sidebars sponsored teaser".split())
CARD_TAGS = frozenset({"aside", "footer"})
# With one of these before it, a name tells what an element goes with, not what it is: has-sidebar, no-comments.
BESIDE = frozenset("has hide is no show with without".split())
# As the last word of a name these only tell the element's shape: the word before them counts, as in comment-list.
SHAPES = frozenset(
    "area bar block body bottom box button buttons center col column container content group header holder icons inner item items "
    "left link links list outer panel right row section slot text thread top unit widget widgets wrap wrapper zone".split())
# A page's wrapper may carry one of these next to the name of something it holds.
LAYOUT_NAMES = frozenset("container layout page site wrap wrapper".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
FRAME_COST, COMMENT_COST = 8.0, 10.0
CHAIN, KINSHIP, BORDER = 1.0, 1.5, 0.2


@dataclass(slots=True)
class Node:
    """An open or closed element: its evidence is inherited by the blocks below."""

    tag: str
    parent: Node | None
    depth: int
    lean: float = 0.0  # of itself and its ancestors, above 0 for content
    lifted: float = 0.0  # what an article below takes back: costs of elements that may wrap a whole page
    silent: bool = False
    link: bool = False
    control: bool = False
    article: bool = False
    frame: Node | None = None  # the nearest boilerplate element around it, itself included


@dataclass(slots=True)
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    controls: int = 0  # characters on buttons
    text: str = ""


def _kind(name: str) -> str:
    """What one class or id says its element is: "comment", "card", "frame", "content" or "" (nothing)."""
    words = [w.lower() for w in WORD.findall(name)]
    if len(words) > 1 and not BESIDE.isdisjoint(words[:-1]):
        return ""
    head = len(words) - 1
    while head > 0 and words[head] in SHAPES:
        if words[head] == "header" and words[head - 1] not in CONTENT_NAMES:
            break  # site-header; an article-header belongs to the article
        head -= 1
    word = words[head] if words else ""
    if word in COMMENT_NAMES:
        return "comment"
    if word in CARD_NAMES:
        return "card"
    return "frame" if word in FRAME_NAMES else "content" if word in CONTENT_NAMES else ""


def _own_evidence(tag: str, attrs: str, in_article: bool) -> tuple[float, float, bool]:
    """(lean, the part of it that an article below takes back, hidden) that tag and attributes speak for.

    All reasons against an element count once, the heaviest alone, so its lean is bounded.
    """
    against, lifts, favour, hidden = 0.0, True, CONTENT_TAGS.get(tag, 0.0), False
    if tag in FRAME_TAGS and not (tag == "header" and in_article):  # the article's own head, not the page's
        against, lifts = FRAME_COST, tag not in CARD_TAGS
    if attrs and tag not in ("html", "body"):
        kinds, layout = set(), False
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), next((x for x in (m[2], m[3], m[4]) if x is not None), "")
            if key in ("class", "id"):
                kinds.update(_kind(name) for name in value.split())
                layout = layout or any(name.lower() in LAYOUT_NAMES for name in value.split())
            elif key == "role":
                if value.lower() in FRAME_ROLES:
                    against, lifts = FRAME_COST, False
                elif value.lower() in ("main", "article"):
                    favour = max(favour, CONTENT_TAGS["main"])
            elif key == "itemprop" and value.lower() == "articlebody":
                favour = CONTENT_TAGS["article"]
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (
                    key == "style" and "display:none" in value.lower().replace(" ", "")):
                hidden = True
        if "comment" in kinds and "content" not in kinds:
            against, lifts = COMMENT_COST, False
        elif kinds & {"card", "frame"} and tag not in CONTENT_TAGS and tag != "h1":
            against, lifts = FRAME_COST, lifts and (layout or "card" not in kinds)
        elif "content" in kinds:
            favour = max(favour, 2.0)
    return (-against if against else favour), (against if lifts else 0.0), hidden


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order. Unclosed and misnested elements are closed where a browser would."""
    root = Node("", None, 0)
    stack, out = [root], []
    block = Block(root)
    at, n = 0, len(page)

    def text(raw: str) -> None:
        top = stack[-1]
        if raw and not top.silent:
            block.parts.append(raw)
            if top.link:
                block.linked += len(raw.strip())
            if top.control:
                block.controls += len(raw.strip())

    def flush() -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(stack[-1])

    def pop_to(i: int) -> None:
        if any(x.tag in BLOCKS for x in stack[i:]):
            del stack[i:]
            flush()
        else:
            del stack[i:]

    def close_open(tags: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return pop_to(i)
            if stack[i].tag in SCOPES or stack[i].tag in FRAME_TAGS:
                return None
        return None

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if stack[i].tag in CONTENT_TAGS or stack[i].tag in FRAME_TAGS:
                    if tag not in CONTENT_TAGS and tag not in FRAME_TAGS and tag not in ("body", "html"):
                        break  # a stray end tag closes nothing outside its section
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            close_open({"p"} if tag not in ENDS else ENDS[tag] | {"p"})
            if tag in ("body", "article", "main") and stack[-1].silent and any(x.tag == "head" for x in stack):
                pop_to(next(i for i, x in enumerate(stack) if x.tag == "head"))
        elif tag in ENDS:
            close_open(ENDS[tag])
        top = stack[-1]
        lean, lifted, hidden = _own_evidence(tag, m["attrs"], top.article)
        node = Node(tag, top, top.depth + 1, top.lean, top.lifted, top.silent or hidden or tag in SILENT,
                    top.link or tag == "a", top.control or tag == "button", top.article or tag in CONTENT_TAGS, top.frame)
        if lean < 0:  # what favours the elements around it is not its own
            node.lean, node.lifted, node.frame = min(top.lean, 0.0) + lean, top.lifted + lifted, node
        elif lean > 0:
            back = top.lifted if tag in CONTENT_TAGS else 0.0
            node.lean, node.lifted = min(top.lean + back, 0.0) + max(lean, top.lean), top.lifted - back
            node.frame = None if node.lean > 0 else top.frame
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
        if tag in BLOCKS:
            flush()
    if block.parts:
        out.append(block)
    kept = []
    for b in out:
        b.text = SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
        if b.text:
            kept.append(b)
    return kept


def _lean(b: Block) -> float:
    """Cost of calling the block boilerplate less that of calling it content."""
    size = len(b.text)
    links = min(1.0, b.linked / max(1, size))
    lean = b.node.lean
    lean += 0.5 if size < 20 else 1.0 if size < 80 else 2.5
    if b.node.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "td", "dd", "dt"):
        lean += 1.0
    elif b.text[-1] not in ".!?\u2026:;\"\u201d\u00bb)":
        lean -= 0.5
    if b.controls >= 0.9 * size:
        lean -= 6.0  # a button alone; one inside a sentence is part of it
    if b.node.article:
        return lean - 3.5 * links
    lean -= 1.0 + 5.0 * links  # no article around it: short or linked blocks need better reasons
    if "\u00a9" in b.text[:200] or "all rights reserved" in b.text[:400].lower():
        lean -= 6.0
    return lean


def _distance(a: Node, b: Node) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: of neighbours by their distance in the tree, and of the blocks of one parent element in a row."""
    edges = []
    last: dict[int, int] = {}  # the block before under the same parent element
    for i, b in enumerate(found):
        def tie(j: int, weight: float) -> None:
            edges.append((j, i, weight if found[j].node.frame is b.node.frame else weight * BORDER))
        if i:
            tie(i - 1, CHAIN / (1 + _distance(found[i - 1].node, b.node)))
        parent = id(b.node.parent or b.node)
        if parent in last:
            tie(last[parent], KINSHIP if last[parent] == i - 1 else KINSHIP / 2)
        last[parent] = i
    return edges


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text, the number of blocks and of those kept."""
    found = blocks_of(page or "")
    keep = cut_labels([_lean(b) for b in found], _ties(found))
    texts = [b.text for b, k in zip(found, keep) if k]
    return "\n".join(texts), len(found), len(texts)


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` of every page.

    White space inside a block becomes one space, a line break tag too; blocks are joined by one line feed. Null, empty
    and blank pages give an empty text. Repeated rows are extracted each. Other columns are not read, so their names
    don't matter.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(source), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t for t, *_ in got], pa.string()),
                 pa.array([len(t) for t, *_ in got], pa.int64()), pa.array([b for _, b, _ in got], pa.int32()),
                 pa.array([k for *_, k in got], pa.int32())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
