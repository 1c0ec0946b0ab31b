"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is read as a sequence of words and tags, in time linear in its length however deep its elements
nest. Words score by where they stand (in which block element, in a link, inside or outside the page's
article or main element) and by what the elements around them call themselves; tags score below zero.
Scores are logarithms of odds, those of names too, counted in labelled pages: pages with an article or main
element, whose words outside boilerplate elements are content. Each labelled page counts twice, once as
it is and once as if that element weren't marked, so that pages without one are scored by the rest. One
linear scan finds the contiguous region with the greatest sum. Its words are the text, but for those in
boilerplate elements within it: those that hold no content by their kind (menus, footers, asides, what is
hidden), and those that call themselves a form, notice, advert, comment or the like and nothing else
(``says_boilerplate``), unless labelled pages show that name on content, or they hold most words around
them (``held_back``).

Labels come from at most about ``LABELLED`` pages, picked by the hash of their id; all pages are
read whole.

Nulls: a null html is empty and gives the empty text; page_id and url are passed on, nulls too.
Pages without any word that scores above zero give the empty text. Repeated rows are read each; of
regions with equal sums the first is taken. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 2000
#: Bounds of a word's weight and of what a tag costs.
MOST_WEIGHT = 3.0
TAG_COST, MOST_TAG_COST = 0.05, 0.6
#: What a word or tag in a boilerplate element costs; little, as it isn't given out and content may go on after it.
BOILERPLATE_COST = 0.01

# HTML element names by what they mean for extraction.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "noframes", "xmp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img")
BOILERPLATE = ("head", "nav", "footer", "aside", "button", "select", "dialog", "menu", "datalist")
OFTEN_BOILERPLATE = ("form", "fieldset", "header")
ARTICLES = ("article", "main")
WITHIN = ("p", "li", "td", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "article", "main", "dd", "dt", "th", "figcaption", "body")
CLOSES_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
# Words of class, id and role that name boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer comment comments commentlist respond disqus replies reply related recommended recommendations share sharing social widget widgets toolbar pagination pager contentinfo complementary search dialog alertdialog menubar toc outbrain taboola paywall discussion discussions response responses thread threads talkback feedback guestbook".split()
)
# Words that say where something stands or how it looks, so that a name of boilerplate stays one with them.
PLACES = frozenset("area bar block body bottom box button btn col column container content field fixed foot form group head header inner item items left link links list main module msg outer panel primary right row secondary section side slot sticky title top unit wrap wrapper zone".split())
#: Labelled words in elements of a name that outweigh what it says: the logarithm of their odds, and the bound of what names add to a word's score.
OVERRULED, MOST_NAME_WEIGHT = 0.5, 1.0

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"\w\S*")  # from a part's first word character to its end: one for each part that has one
_PART = re.compile(r"[a-z]+|\d+")
_YEAR = re.compile(r"(19|20)\d\d")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


SURE, NAMED = 2, 1


def says_boilerplate(token: str) -> bool:
    """Whether a class, id or role names boilerplate: its parts are such names, places and numbers (not years), and no other word."""
    parts = _PART.findall(token)
    return any(x in NAMES for x in parts) and all(x in NAMES or x in PLACES or (x.isdigit() and not _YEAR.fullmatch(x)) or x == "x" for x in parts)


def described(attributes: str) -> tuple[list[str], bool]:
    """The names that an element has (classes, id, role), and whether it is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names += value.split()
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return names, hidden


def boilerplate(name: str, names: list[str], hidden: bool, in_article: bool, weights: dict[str, float]) -> int:
    """SURE for an element that holds no content: a menu, a footer, something hidden. NAMED for one that is likely a form, notice, advert, comment or the like, by what it calls itself. Else 0."""
    if name in BOILERPLATE or (hidden and name not in ("html", "body", "main")):
        return SURE
    if name in OFTEN_BOILERPLATE and not (name == "header" and in_article):
        return NAMED
    if name in ("html", "body", "main"):
        return 0
    return NAMED if any(says_boilerplate(x) and weights.get(f"name {numbered(x)}", 0.0) <= OVERRULED for x in names) else 0


def numbered(token: str) -> str:
    """A name without its numbers, which tell elements apart rather than kinds."""
    return re.sub(r"\d+", "#", token)


class Piece:
    """Text between two tags, or a tag. named: the number of the innermost element around it that names boilerplate, 0 for the page. names: of the innermost element that has any."""

    __slots__ = ("text", "words", "tag", "block", "boiler", "link", "within", "inside", "named", "names")


class Open:
    """The open elements of a page, with what must be known of them at hand, so that each piece takes the same time however deep it is."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, bool]] = []  # names, how each is boilerplate, and whether it calls itself something and is a parent
        self.names: list[list[str]] = [[]]  # what those do
        self.places: dict[str, list[int]] = {}  # of each name
        self.blocks: list[int] = []  # places of elements that aren't inline
        self.within: list[str] = []
        self.named: list[int] = [0]
        self.parents = [0]  # of named elements and articles; the page is 0
        self.articles: set[int] = set()  # those that only stand for what is around elements within
        self.sure = 0

    def place(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else -1

    def count(self, *names: str) -> int:
        return sum(len(self.places.get(n, ())) for n in names)

    def push(self, name: str, flagged: int, names: list[str]) -> None:
        if names:
            self.names.append(names)
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        if name in WITHIN:
            self.within.append(name)
        parent = flagged == NAMED or (name in ARTICLES and flagged != SURE)
        if parent:
            self.parents.append(self.named[-1])
            self.named.append(len(self.parents) - 1)
            if flagged != NAMED:
                self.articles.add(self.named[-1])
        self.sure += flagged == SURE
        self.stack.append((name, flagged, bool(names), parent))

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, flagged, called, parent = self.stack.pop()
            if called:
                self.names.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            if name in WITHIN:
                self.within.pop()
            if parent:
                self.named.pop()
            self.sure -= flagged == SURE

    def only_inline_above(self, place: int) -> bool:
        return not self.blocks or self.blocks[-1] <= place


def held_back(pieces: list[Piece], parents: list[int], articles: set[int]) -> list[bool]:
    """For each named element whether it is boilerplate. It isn't if it holds most words of the article or named element around it, and that one has few words outside named elements: then it is a wrapper of the content, whatever it calls itself."""
    direct = [0] * len(parents)
    for p in pieces:
        if not p.boiler:
            direct[p.named] += p.words
    total = list(direct)
    for i in range(len(parents) - 1, 0, -1):
        total[parents[i]] += total[i]
    back = [False] * len(parents)
    for i in range(1, len(parents)):
        around = parents[i]
        back[i] = back[around] or (i not in articles and (2 * total[i] <= total[around] or 4 * direct[around] >= total[i]))
    return back


def pieces_of(page: str, weights: dict[str, float] | None = None) -> list[Piece]:
    """A page's pieces of text and tags in order; scripts, styles and comments are left out. weights: what is known of names."""
    weights = weights or {}
    out: list[Piece] = []
    now = Open()

    def piece(text, words, tag, block):
        p = Piece()
        p.text, p.words, p.tag, p.block, p.named = text, words, tag, block, now.named[-1]
        p.boiler, p.link, p.inside = now.sure > 0, now.place("a") >= 0, now.count(*ARTICLES) > 0
        p.within = now.within[-1] if words and now.within else ""
        p.names = now.names[-1]
        out.append(p)

    def text(raw: str):
        decoded = html.unescape(raw)
        if decoded:
            piece(decoded, len(_WORD.findall(decoded)), None, False)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        block = name not in INLINE
        if m[1] or m[4]:
            where = now.place(name)
            if where >= 0 and (block or now.only_inline_above(where)):
                now.pop(where)
            piece("", 0, "/" + name, block)
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            piece("", 0, name, block)
            continue
        if name in CLOSES_P:
            where = now.place("p")
            if where >= 0 and now.only_inline_above(where):
                now.pop(where)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            where = now.place(name)
            if where > max(map(now.place, ("ul", "ol", "dl", "table"))):
                now.pop(where)
        if name == "body":
            now.pop(0)
        attributes = (m[3] if m[2] else m[6]) or ""
        if name not in VOID and not attributes.rstrip().endswith("/"):
            names, hidden = described(attributes) if attributes else ([], False)
            now.push(name, boilerplate(name, names, hidden, now.count(*ARTICLES) > 0, weights), names)
        piece("", 0, name, block)
    back = held_back(out, now.parents, now.articles)
    for p in out:
        p.boiler = p.boiler or back[p.named]
    return out


def kind_of(p: Piece, marked: bool) -> str:
    """What a piece's weight hangs on. marked: whether the page has an article or main element that counts."""
    if p.tag:
        name = p.tag.lstrip("/")
        known = name in WITHIN or name in INLINE or name in BOILERPLATE or name in VOID or name in RAW
        return "tag " + ((p.tag if known else "other") if marked or name not in ARTICLES else "other")
    scope = "none" if not marked else "in" if p.inside else "out"
    within = p.within if marked or p.within not in ARTICLES else "div"
    return f"words {scope} {'link' if p.link else 'text'} {within}"


def default_weight(kind: str) -> float:
    """For kinds that labelled pages don't have."""
    if kind.startswith("tag "):
        return -TAG_COST if kind[4:].lstrip("/") in INLINE else -0.3
    _, scope, link, *_ = kind.split(" ")
    return -1.0 if scope == "out" else -0.5 if link == "link" and scope == "none" else 1.0


def is_marked(pieces: list[Piece]) -> bool:
    return any(p.inside and p.words and not p.boiler for p in pieces)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous region with the greatest sum; (0, 0) if none is above zero."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def score(p: Piece, marked: bool, weights: dict[str, float]) -> float:
    if p.boiler:
        return -BOILERPLATE_COST * max(1, p.words)
    kind = kind_of(p, marked)
    w = weights.get(kind)
    w = default_weight(kind) if w is None else w
    if p.tag:
        return w
    if p.names and not marked:
        w += max(-MOST_NAME_WEIGHT, min(MOST_NAME_WEIGHT, sum(weights.get(f"name {numbered(x)}", 0.0) for x in p.names)))
    return w * p.words


def main_text(page: str, weights: dict[str, float]) -> str:
    pieces = pieces_of(page, weights)
    marked = is_marked(pieces)

    start, end = best_region([score(p, marked, weights) for p in pieces])
    out = []
    for p in pieces[start:end]:
        if p.tag:
            if p.block:
                out.append(" ")
        elif not p.boiler:
            out.append(p.text)
        elif out:
            out.append(" ")
    return " ".join("".join(out).split())


def learned_weights(pages: DataFrame) -> dict[str, float]:
    """Weights of kinds from labelled pages: the logarithm of the odds of content, smoothed; never above -TAG_COST for tags."""
    labelled = pages.filter(F.lower("html").rlike("<(article|main)[\\s>]"))
    n = labelled.count()
    if n > LABELLED:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("labelled"), "page_id"), F.lit(1 << 30)) < int(LABELLED / n * (1 << 30)))

    def run(batches):
        found: dict[str, list[int]] = {}
        for batch in batches:
            for page in (x.as_py() for x in batch.column(0)):
                pieces = pieces_of(page)
                if not is_marked(pieces):
                    continue
                for p in pieces:
                    if not p.boiler:
                        for marked in (True, False):
                            found.setdefault(kind_of(p, marked), [0, 0])[p.inside] += max(1, p.words)
                    if p.words and not p.boiler:
                        for x in p.names:
                            found.setdefault(f"name {numbered(x)}", [0, 0])[p.inside] += p.words
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))], ["kind", "outside", "inside"])

    sums = labelled.select("html").mapInArrow(run, "kind string, outside long, inside long").groupBy("kind").agg(F.sum("outside"), F.sum("inside")).collect()
    weights = {}
    for kind, outside, inside in sums:
        w = math.log((inside + 1) / (outside + 1))
        low, high = (-MOST_TAG_COST, -TAG_COST) if kind.startswith("tag ") else (-MOST_WEIGHT, MOST_WEIGHT)
        weights[kind] = max(low, min(high, w))
    return weights


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(learned_weights(pages))

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), shared.value) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(pages: DataFrame) -> DataFrame:
    return extracted(pages)
