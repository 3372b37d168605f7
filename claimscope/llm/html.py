"""Main text of web pages by tree scoring.

Every paragraph passes 1 point, 1 for each comma and 1 for each 100 characters (3 at most) to its ancestors: all to the parent,
a half to the next, a third to the one after, and so on; each container's sum is discounted by its link density. The best container is kept
with its siblings that hold a fifth of its points, and the paragraphs, headings and loose text beside it that have few links; so are
such siblings of its ancestors. If the best stands in an ``article`` or ``main`` that is not mostly links, this is kept to its edges but
for containers that are mostly links.

Boilerplate neither scores nor stays. Scripts, menus, footers, controls, hidden parts and roles always go. ``form``, ``header`` and elements whose
class or id names boilerplate are only suspects: a name counts by its words, not if one of them negates or describes (``no-sidebar``,
``page-with-sidebar``) or its last is the article (``header-article``). A suspect stays if it holds ``main``, or at least half of the page's
text and itself the article or, on a page that marks none elsewhere, too little would be left without it. The header of an article or main stays.
Inside an article a name must tell of boilerplate by all its words (``share-buttons``, not ``market-share-table``), and an element named by a word that
may be its topic alone (``copyright``) stays if its text is long, has few links and is not the last of its parent. Articles beside the best one stay
as parts of it if they hold a fifth of its points and have few links. Points reach the twelve nearest containers: what is beyond gets less than a
thirteenth of them.

Defined cases: null or empty html gives an empty text; a page without paragraphs gives the text of its body without boilerplate;
unclosed and stray tags are tolerated; ``br`` is white space; any nesting depth works, for nothing recurses; repeated rows
are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote li td dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head title script style noscript template nav footer aside button select option textarea iframe object svg canvas dialog menu audio video".split())
SUSPECT = frozenset("form header".split())
CONTAINER = frozenset("article div dl main ol section table td ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
LAYOUT_WORDS = frozenset("banner dialog footer header masthead menu modal nav navbar navigation notice notices overlay sidebar toolbar widget".split())
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising alert alerts breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer discussion discussions disqus login newsletter pager pagination popup promo promoted promotion recommended related replies reply respond share sharing signup skip social sponsor sponsored subscribe subscription".split())
TOPIC_WORDS = frozenset("copyright discussion share sharing social".split())  # of which an article may treat, too
PART_WORDS = frozenset("area article articles bar block bottom box button buttons container content entry form group icons inline inner item items left link links list message module note page panel post posts right row section site slot story text tools top unit user wrap wrapper".split())
DESCRIBING = frozenset("disable disabled enable enabled free has layout no non not open show supports toggle with without".split())
ARTICLE_WORDS = frozenset("article entry main page post story".split())
HIDDEN_NAMES = frozenset({("hidden",), ("is", "hidden"), ("visually", "hidden"), ("sr", "only")})
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("children", "commas", "drop", "held", "length", "links", "n_links", "own", "parent", "points", "score", "suspect", "tag", "topic", "within")

    def __init__(self, tag: str, parent: Node | None, drop: bool, suspect: int = 0):
        self.tag, self.parent, self.drop, self.suspect, self.children, self.held = tag, parent, drop, suspect, [], frozenset()
        self.topic = False  # its name may as well be what the text is about
        self.within = tag in ("article", "main") or parent is not None and parent.within  # an article
        self.score = self.points = self.links = self.n_links = self.length = self.own = self.commas = 0


def _named(value: str, tag: str, parent: Node) -> int:
    """2 if a name of the class or id tells of things beside an article, 1 if of page layout, else 0."""
    worst = 0
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if tuple(words) in HIDDEN_NAMES:
            return 2
        if DESCRIBING.isdisjoint(words):
            if not ASIDE_WORDS.isdisjoint(words) and not (parent.within and not set(words) <= ASIDE_WORDS | LAYOUT_WORDS | PART_WORDS):
                return 2  # inside an article the whole name must tell of it
            if not LAYOUT_WORDS.isdisjoint(words) and words[-1] not in ARTICLE_WORDS and tag != "article":
                own_header = words[-1] == "header" and (words[0] in ARTICLE_WORDS - {"page", "main"} or parent.within)
                worst = max(worst, 0 if own_header else 1)
    return worst


def _judge(tag: str, attrs: list, parent: Node) -> tuple[bool, int]:
    """Whether an element goes, and how far it is a suspect."""
    if tag in DROPPED:
        return True, 0
    suspect = int(tag in SUSPECT and not (tag == "header" and parent.within))
    for k, v in attrs:
        v = v or ""
        if k in ("class", "id") and tag not in ("html", "body", "main"):
            suspect = max(suspect, _named(v, tag, parent))
        elif (k == "role" and v.lower() in ROLES or k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and _HIDDEN.search(v)) and tag not in ("html", "body"):
            return True, 0
    return False, suspect


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, False)
        self.open: Counter = Counter()
        self.order: list[Node] = [self.root]  # parents before children

    def _pop(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def _close(self, tags: set[str], scope: set[str]) -> None:
        """Close the nearest open element of ``tags`` that no element of ``scope`` encloses."""
        if not any(self.open[t] for t in tags):
            return
        n = self.at
        while n is not self.root and n.tag not in scope:
            if n.tag in tags:
                while self.at is not n:
                    self._pop()
                self._pop()
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.at.children.append(Node("hr", self.at, False) if tag == "hr" else " ")
            return
        if tag in BLOCK:
            self._close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in HEADING:
            self._close(HEADING, {"td", "th", "div", "section", "article"})
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPE[tag])
        if tag in ("html", "body") and self.open[tag]:
            return
        if tag in BLOCK:  # body too: the head ends where content begins
            self._close({"head"}, set())
        tag = next((v.lower() for k, v in attrs if k == "role" and v and v.lower() in ("main", "article") and tag in ("div", "section")), tag)
        n = Node(tag, self.at, *_judge(tag, attrs, self.at))
        n.topic = n.suspect == 2 and self.at.within and all(v in TOPIC_WORDS for k, v in attrs if k in ("class", "id"))
        self.at.children.append(n)
        self.order.append(n)
        self.open[tag] += 1
        self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.at.children.append(" ")
        elif self.open[tag]:
            self._close({tag}, set() if tag in BLOCK else {"td", "th"})

    def handle_data(self, data):
        self.at.children.append(data)


def _few_links(n: Node, most: float = 0.5) -> bool:
    return n.links < most * n.length


def _lengths(order: list[Node]) -> None:
    """Text and link lengths of what does not go, bottom up."""
    for n in order:
        n.length = n.links = n.n_links = n.own = n.commas = 0
        if n.parent is not None and n.parent.drop:
            n.drop = True
    for n in reversed(order):
        if n.drop:
            continue
        for c in n.children:
            if isinstance(c, str):
                own = len(" ".join(c.split()))
                n.own += own
                n.length += own
                n.commas += c.count(",")
            elif not c.drop:
                n.length += c.length
                n.commas += c.commas
                n.links += c.length if c.tag == "a" else c.links
                n.n_links += 1 if c.tag == "a" else c.n_links


def _settle(order: list[Node]) -> None:
    """Decide which suspects go."""
    _lengths(order)
    root = order[0]
    total, rest = root.length - root.links, 0
    clear, inside, told = {id(root)}, set(), False
    for n in order[1:]:
        if not n.drop and not n.suspect and id(n.parent) in clear:
            clear.add(id(n))
            rest += n.own if n.tag != "a" else 0
            if n.tag in ("article", "main") or id(n.parent) in inside:
                inside.add(id(n))
                told = told or n.own > 0
    rest += root.own
    followed = set()  # parents with an element of the text behind the one looked at
    poor = {1: not told and rest < max(100, 0.1 * total), 2: not told and rest < 40}
    for n in reversed(order):
        if n.drop:
            continue
        if n.topic and n.length >= 80 and n.links < 0.2 * n.length and id(n.parent) in followed:
            n.suspect = 0
        held = {n.tag} & {"main", "article", "h1"} if not n.suspect else set()
        for c in n.children:
            if isinstance(c, Node) and not c.drop:
                held |= c.held
        if n.suspect:
            half = n.length - n.links >= 0.5 * total > 0
            n.drop = not ("main" in held or half and (poor[n.suspect] or n.suspect == 1 and bool(held)))
        n.held = frozenset() if n.drop else frozenset(held)
        if n.length and not n.suspect and n.parent is not None:
            followed.add(id(n.parent))
    _lengths(order)


def paragraph_points(n: Node) -> float:
    """What a node's text passes on; 0 if it is no paragraph. Containers count for the text that is directly theirs."""
    whole = n.tag in PARAGRAPH
    if n.drop or not n.length or not whole and not (n.own and n.tag in ("div", "section", "article", "main", "body")):
        return 0.0
    size, commas = (n.length, n.commas) if whole else (n.own, sum(c.count(",") for c in n.children if isinstance(c, str)))
    return (1 + commas + min(size / 100, 3)) * (1 - n.links / n.length)


def _score(order: list[Node]) -> list[Node]:
    """Score the containers; the scored nodes in page order."""
    scored: dict[int, Node] = {}
    for n in order:
        points = paragraph_points(n)
        n.points += points
        up, level = n if n.tag not in PARAGRAPH else n.parent, 1
        while points and up is not None and level <= 12:
            up.score += points / level
            scored[id(up)] = up
            up, level = up.parent, level + 1
    for n in reversed(order):
        if n.parent is not None:
            n.parent.points += n.points
    for n in scored.values():
        n.score *= 1 - n.links / n.length if n.length else 0
    return list(scored.values())


def _blocks(tops: list) -> list[str]:
    """Texts of the blocks below, in page order."""
    out: list[str] = []
    buf: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(buf).split()):
            out.append(text)
        buf.clear()

    stack: list = [*reversed(tops)]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            buf.append(n)
        elif not n.drop:
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(n.children))
    flush()
    return out


def _kept(best: Node) -> list:
    """What stays of the page: parts in page order."""
    edge = best
    while edge is not None and edge.tag not in ("article", "main"):
        edge = edge.parent
    if edge is not None and _few_links(edge):
        stack = [edge]
        while stack:  # containers that are mostly links go
            for c in stack.pop().children:
                if isinstance(c, Node) and not c.drop:
                    c.drop = c.tag in CONTAINER and c.n_links > 1 and not _few_links(c, 0.6)
                    stack.append(c)
        alike = edge.parent.children if edge.tag == "article" and edge.parent is not None else [edge]  # an article in parts
        return [c for c in alike if c is edge or isinstance(c, Node) and c.tag == "article" and not c.drop and c.points >= 0.2 * edge.points and _few_links(c, 0.25)]
    tops, n = [best], best
    while n.parent is not None and n.tag != "body":
        kept, beside = [], n is best
        for c in n.parent.children:
            if c is n:
                kept += tops
            elif isinstance(c, str):
                kept += [c] if beside else []
            elif not c.drop and c.length and _few_links(c, 0.25):
                loose = c.tag in PARAGRAPH or c.tag in HEADING or c.tag not in BLOCK
                if c.points >= 0.2 * best.points or beside and loose or c.tag == "h1":
                    kept.append(c)
        tops, n = kept, n.parent
    return tops


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by a line feed; empty if there is none."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _settle(tree.order)
    scored = _score(tree.order)
    return "\n".join(_blocks(_kept(max(scored, key=lambda n: n.score)) if scored else [tree.root]))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` in code points (they replace columns of these names)."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(main_text, na_action=None)

    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    return pages.select(*keep, text_of("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
