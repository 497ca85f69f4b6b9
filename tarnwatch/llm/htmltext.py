"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Every block of visible text is scored:

* link density over ``LINK_DENSITY``: boilerplate, whatever else it has;
* length: blocks of under ``SHORT`` characters are ambiguous, long ones gain;
* stop-word density: the page's language is the list that its words hit most; where no list is hit
  often enough (another language, a script without spaces) this rule says nothing and length and
  links decide;
* place: menus, footers, asides, forms and the like by tag, and elements whose class, id or role says
  advert, cookie notice, comments and so on, lower the score; ``article`` and ``main`` raise it.  A mark
  counts only where it can be true: not on an element that holds the page's article or heading, nor
  (but for reader comments) on one that holds most of a page without article, and not with a prefix such as ``no-`` or ``has-``.

The first pass decides by that score; what is left is ambiguous and in the second pass takes the label
of its nearest decided neighbour in the same part of the page (the article, or what is beside it;
blocks in menus, adverts and the like are nobody's neighbours).

Scripts, styles, titles and hidden elements are no visible text.  Character references are decoded,
white space inside a block becomes one space, and the blocks are joined in page order by line feeds.

Defined cases: null and empty pages give the empty text; truncated tags at the end are dropped
and truncated references kept as written; unclosed elements end with their parent, unclosed anchors
with their block; end tags that match nothing are skipped; time is linear in the page's length;
repeated rows are extracted each for itself; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textbytes import tidy

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*)>|</?[A-Za-z!?/][^>]*\Z|</[^A-Za-z>][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden\b")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Fixed values.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
UNSEEN = {"template", "svg", "canvas", "object", "head", "audio", "video", "map", "datalist", "select", "button"}
PLACES = {"nav", "aside", "footer", "form", "dialog", "menu", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "option", "template", "dialog", "menu", "head"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "subscription", "signup", "sidebar", "widget", "related", "recommended", "recommendations", "share", "sharing", "social", "comment", "comments", "disqus", "respond", "replies", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "pagination", "pager", "popup", "modal", "overlay", "login", "search", "copyright", "disclaimer", "banner", "paywall", "teaser", "outbrain", "taboola"}
COMMENTS = {"comment", "comments", "reply", "replies", "disqus"}
ABOUT = {"no", "not", "non", "has", "have", "with", "without", "is", "hide", "show", "full", "layout"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
STOP_WORDS = {
    "en": "a about an and are as at be but by for from had has have he his i if in is it its not of on or that the their they this to was we were which will with you",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et il la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im in ist mit nicht sich sie sind und von war werden wie wird zu zum zur",
    "es": "al como con de del el en es está esta este ha la las lo los más no o para pero por que se sin su sus un una y ya",
}
_STOPS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}

#: thresholds of the rules
LINK_DENSITY, SHORT, LONG, LOW_STOPS, HIGH_STOPS, KNOWN_LANGUAGE = 0.4, 70, 200, 0.10, 0.25, 0.12
#: what places add to a block's score
IN_ARTICLE, BESIDE_ARTICLE, IN_PLACE, IN_MARK = 2, -4, -6, -6
#: on a page without article, a mark on an element with more than this share of the text is about its layout
MOST = 0.5
_WORDS = re.compile(r"\w+")


class _Element:
    """An open or closed element whose mark or tag lowers what is inside."""

    __slots__ = ("comments", "holds_article", "prose")

    def __init__(self, comments: bool = False):
        self.comments, self.holds_article, self.prose = comments, False, 0


class _Block:
    __slots__ = ("inside", "linked", "marks", "parts", "places", "text", "words")

    def __init__(self, inside: bool, places: tuple, marks: tuple):
        self.parts, self.linked, self.inside, self.places, self.marks, self.text, self.words = [], 0, inside, places, marks, "", []

    def link_density(self) -> float:
        return self.linked / max(1, len(self.text) - self.text.count(" "))


def _read_attributes(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is hidden, and whether its names or role say that it isn't main text (2: reader comments)."""
    marked = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "hidden").lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for one in value.split():
                names = [x.lower() for x in _NAMES.findall(one)]
                if names and names[0] not in ABOUT and not (COMMENTS if tag == "article" else MARKS).isdisjoint(names):
                    marked = max(marked, 1 if COMMENTS.isdisjoint(names) else 2)
        elif name == "role" and value.strip().lower() in ROLES:
            marked = max(marked, 1)
        elif name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, marked
    return False, marked


def page_blocks(page: str) -> list[_Block]:
    """Blocks of visible text in page order, without empty ones."""
    out: list[_Block] = []
    # open elements: tag, unseen, inside an article, places, marks
    stack: list[tuple[str, bool, bool, tuple, tuple]] = []
    opened: dict[str, list[int]] = {}  # by tag: places in the stack
    walls: list[int] = []  # places of block-level elements
    top = (False, False, (), ())
    block: _Block | None = None
    linked, at, size = False, 0, len(page)

    def text(upto: int) -> None:
        nonlocal block
        unseen, inside, places, marks = stack[-1][1:] if stack else top
        if upto > at and not unseen:
            raw = page[at:upto]
            if block is None:
                if not raw.strip():
                    return
                block = _Block(inside, places, marks)
                out.append(block)
            plain = html.unescape(raw) if "&" in raw else raw
            block.parts.append(plain)
            if linked:
                block.linked += len("".join(plain.split()))

    def close(k: int) -> None:
        """Ends the element at place k of the stack and what is open inside."""
        while len(stack) > k:
            tag = stack.pop()[0]
            opened[tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()

    def within(tag: str) -> None:
        """Ends an open element of this tag unless a block-level element was opened in it."""
        k = opened[tag][-1] if opened.get(tag) else -1
        if k >= 0 and (not walls or walls[-1] <= k):
            close(k)

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(size)
            break
        text(m.start())
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCKS:
            block = None
        elif tag == "br" and block is not None:
            block.parts.append(" ")
        if closing:
            if tag == "a" or tag in BLOCKS:
                linked = False
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag == "a":
            linked = True
        elif tag in ("p", "li", "dt", "dd", "td", "th", "tr"):
            linked = False
            within(tag)
            if tag != "p":
                within("p")
        if tag == "body" and opened.get("head"):
            close(opened["head"][-1])
        unseen, inside, places, marks = stack[-1][1:] if stack else top
        hidden, marked = _read_attributes(tag, attributes) if attributes and tag not in ("html", "body") else (False, 0)
        if tag in ("article", "main", "h1"):
            for e in places + marks:
                e.holds_article = e.holds_article or tag != "h1" or not inside
        if tag in ("article", "main"):
            inside = True
        if tag in PLACES or tag == "header" and not inside:
            places = (*places[-7:], _Element())
        if marked:
            marks = (*marks[-7:], _Element(marked == 2))
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            walls.append(len(stack))
        stack.append((tag, unseen or hidden or tag in UNSEEN, inside, places, marks))
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def language(blocks: list[_Block]) -> frozenset | None:
    """The stop words that the page's unlinked words hit most; None if no list is hit often enough."""
    words = Counter(w for b in blocks if b.link_density() <= LINK_DENSITY for w in b.words)
    total = sum(words.values())
    best = max(_STOPS.values(), key=lambda stops: sum(words[w] for w in stops))
    return best if total and sum(words[w] for w in best) >= KNOWN_LANGUAGE * total else None


def first_pass(block: _Block, stops: frozenset | None, article: bool) -> bool | None:
    """True for main text, False for boilerplate, None where the block's score does not tell."""
    if block.link_density() > LINK_DENSITY:
        return False
    score = IN_ARTICLE if block.inside else BESIDE_ARTICLE if article else 0
    score += IN_PLACE * bool(block.places)
    score += IN_MARK * bool(block.marks)
    size = len(block.text)
    if size >= SHORT:
        score += 1 + (size > LONG)
        if stops is not None:
            share = sum(w in stops for w in block.words) / max(1, len(block.words))
            score += 2 if share >= HIGH_STOPS else 1 if share >= LOW_STOPS else -2
        else:
            score += 1
    if score <= -2:
        return False
    return True if size >= SHORT and score >= 2 else None


def second_pass(labels: list[bool | None], parts: list[int | None], most: int) -> list[bool]:
    """Ambiguous blocks take the label of their nearest decided neighbour in the same part of the page.

    Of two at the same distance main text wins; in a part without any decided block all is main
    text if it is part ``most``.  Blocks of no part (menus, adverts) are nobody's neighbours.
    """
    near = []
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        found, seen = [None] * len(labels), {}
        for k in order:
            if labels[k] is not None and parts[k] is not None:
                seen[parts[k]] = k
            found[k] = seen.get(parts[k])
        near.append(found)
    out = []
    for k, label in enumerate(labels):
        if label is None:
            sides = [(abs(k - found[k]), not labels[found[k]]) for found in near if found[k] is not None]
            label = not min(sides)[1] if sides else parts[k] == most
        out.append(label)
    return out


def labelled(page: str | None) -> tuple[list[_Block], list[bool | None], list[bool]]:
    """Blocks, their labels after the first pass and after the second."""
    blocks = page_blocks(page or "")
    for b in blocks:
        b.words = _WORDS.findall(b.text.lower())
    prose = [len(b.text) if len(b.text) >= SHORT and b.link_density() <= LINK_DENSITY else 0 for b in blocks]
    text = [len(b.text) if b.link_density() <= LINK_DENSITY else 0 for b in blocks]
    for b, n in zip(blocks, text, strict=True):
        for e in b.marks:
            e.prose += n
    most = sum(text) if any(b.inside for b in blocks) else MOST * sum(text)
    for b in blocks:  # marks and places that cannot be true
        b.marks = tuple(e for e in b.marks if not e.holds_article and (e.comments or e.prose <= most))
        b.places = tuple(e for e in b.places if not e.holds_article)
    out_of_flow = [bool(b.places or b.marks) for b in blocks]
    whole = sum(n for n, out in zip(prose, out_of_flow, strict=True) if not out)
    inside = sum(n for n, b in zip(prose, blocks, strict=True) if b.inside)
    # an article that holds little of the page's prose is a card or a teaser, not the article
    article = any(b.inside for b in blocks) and inside >= 0.2 * whole
    if not article:
        for b in blocks:
            b.inside = False
    stops = language(blocks)
    first = [first_pass(b, stops, article) for b in blocks]
    parts = [None if out else int(b.inside) for b, out in zip(blocks, out_of_flow, strict=True)]
    return blocks, first, second_pass(first, parts, int(article))


def main_text(page: str | None) -> str:
    blocks, _, labels = labelled(page)
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


@tidy
def _extract(batches):
    for batch in batches:
        texts, counts = [], []
        for page in batch.column(2).to_pylist():
            blocks, first, labels = labelled(page)
            texts.append("\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep))
            counts.append((len(blocks), sum(x is None for x in first)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())],
            ["page_id", "url", "text", "n_chars", "n_blocks", "n_by_neighbour"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, and how many blocks it has and how many the second pass decided."""
    return small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_by_neighbour long")
