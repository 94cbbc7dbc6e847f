"""Main text of web pages by tree scoring.

A page is read into a tree of elements that leaves out what can't be article:
scripts, forms, menus and whatever its tag, role, class or id names as
boilerplate. Each paragraph scores for its length and commas and passes its points to its
ancestors, less with each level; a container's points count as far as its text
lies outside links. The article or main around the best container is kept whole,
with the siblings that hold text rather than links.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import small_batches, table

# HTML's names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg math".split())
SKIP = RAW | frozenset("nav footer aside form button select object canvas audio video dialog menu head datalist fieldset label".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote header footer nav aside form fieldset figure figcaption address hgroup details summary center hr br search dialog menu".split())
CLOSES_P = BLOCK - {"br"}
#: Start tag: open elements that it ends, up to the tags that hold them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What an open p doesn't reach out of; what an end tag doesn't reach out of, where that isn't a table's cell.
P_HOLDS = ("td", "th", "div", "section", "article", "main", "blockquote", "li")
HOLDS = {"li": ("ul", "ol", "menu"), "td": ("table",), "th": ("table",), "tr": ("table",), "caption": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "table": (), "article": (), "main": ()}
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in a class or id that name boilerplate; weak ones give way to a word that names content.
JUNK = frozenset("""nav navbar navigation menu menus sidebar sidebars footer foot ad ads adv advert adverts advertisement advertising adsbygoogle adbox sponsor
 sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription
 signup login share sharing social breadcrumb breadcrumbs pager pagination paging comment comments disqus respond reply replies discussion related
 recommended recommendations widget widgets toolbar masthead skip hidden form search disclaimer copyright tagcloud outbrain taboola""".split())
WEAK = frozenset("header head meta tools byline tags info".split())
CONTENT = frozenset("article articles content contents entry main post text story body page blog".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class _Node:
    """An open or closed block element. Elements within a line are no nodes: they hold no blocks."""

    __slots__ = ("tag", "up", "score", "chars", "linked", "kids", "weight", "kept")

    def __init__(self, tag: str, up: "_Node | None", weight: float) -> None:
        self.tag, self.up, self.weight = tag, up, weight
        self.score = 0.0
        self.chars = self.linked = 0
        self.kids: list[_Node] = []
        self.kept = False


class _Open:
    """The open elements, innermost last. Finding the innermost of some tags takes no walk, however deep they are."""

    def __init__(self) -> None:
        self.nodes: list[_Node] = [_Node("html", None, 0.0)]
        self.made = self.nodes[:]
        self.at: dict[str, list[int]] = {"html": [0]}

    def push(self, tag: str, weight: float) -> None:
        new = _Node(tag, self.nodes[-1], weight)
        new.up.kids.append(new)
        self.at.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(new)
        self.made.append(new)

    def last(self, tags) -> int:
        """The place of the innermost open element of the tags; 0, the root's, if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags, stop=()) -> bool:
        """Ends the innermost open element of the tags, with all that is open in it, unless one of stop lies between."""
        place = self.last(tags)
        if not place or place <= self.last(stop):
            return False
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()
        return True


def _junk(tag: str, attrs: str) -> tuple[bool, float]:
    """Whether the start tag names boilerplate; the weight of the words in its class and id."""
    got = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if tag in ("html", "body"):
        return False, 0.0
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return True, 0.0
    if got.get("role", "").lower() in JUNK_ROLES:
        return True, 0.0
    words = [w.lower() for w in _WORD.findall(got.get("class", "") + " " + got.get("id", ""))]
    good = bool(CONTENT & set(words))
    for before, w in zip(["", *words], words, strict=False):
        if w in JUNK and before not in ("no", "has", "with", "without") and tag not in ("article", "main") or w in WEAK and not good and tag in ("div", "section", "ul"):
            return True, 0.0
    return False, 25.0 if good else 0.0


def tree(page: str) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """The nodes, each after the one that holds it, and the page's blocks in order: (element that holds it, text). Boilerplate is left out of both.

    Time and room are in proportion to the page, whatever its depth.
    """
    open_ = _Open()
    blocks: list[tuple[_Node, str]] = []
    text: list[str] = []
    link = in_link = 0  # characters of the block within links, open links
    skip: list[str] = []  # open elements of a part left out
    skipped: dict[str, int] = {}
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal link
        if text:
            got = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if got:
                owner = open_.nodes[-1]
                blocks.append((owner, got))
                owner.chars += len(got)
                owner.linked += min(link, len(got))
        link = 0

    def leave_out(tag: str) -> None:
        skip.append(tag)
        skipped[tag] = skipped.get(tag, 0) + 1

    def take_up(tag: str | None = None) -> None:
        """The part left out ends at the innermost element of this tag, or altogether."""
        while skip:
            x = skip.pop()
            skipped[x] -= 1
            if x == tag:
                break

    def add(piece: str) -> None:
        nonlocal link
        if piece and not skip:
            text.append(piece)
            if in_link:
                link += len(piece)

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if skip:
            if closing:
                if skipped.get(tag):
                    take_up(tag)
                elif tag in ("body", "html") or tag in ("article", "main") and open_.at.get(tag):
                    take_up()  # an end tag that the part left out has missed
            elif tag not in VOID and not m[3].endswith("/"):
                if tag in ("article", "main") and skip[0] in ("form", "label", "fieldset"):
                    take_up()
                elif tag in RAW:
                    at = _past(page, at, tag)
                elif tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # their end tags may be left out
                    leave_out(tag)
            if skip or closing:
                continue
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK:
                flush()
                if tag not in VOID and tag not in ("html", "body"):
                    open_.close(HEADINGS if tag in HEADINGS else (tag,), HOLDS.get(tag, ("td", "th", "caption")))
            continue
        if tag in RAW:
            at = _past(page, at, tag)
            if tag in BLOCK or tag == "textarea":
                flush()
            continue
        junk, weight = _junk(tag, m[3])
        if tag == "header" and not open_.last(("article", "main", "section")):
            junk = True
        if junk or tag in SKIP:
            if tag == "head":  # its parts are skipped by themselves; its end tag is often missing
                continue
            if tag in BLOCK:
                flush()
                open_.close(("p",), P_HOLDS)
            if tag not in VOID:
                leave_out(tag)
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                open_.close(("p",), P_HOLDS)
            if tag in ENDS:
                while open_.close(*ENDS[tag]):
                    pass
            if tag not in VOID and tag not in ("html", "body"):
                open_.push(tag, weight)
        if tag == "a":
            in_link += 1
    flush()
    for x in reversed(open_.made[1:]):
        x.up.chars += x.chars
        x.up.linked += x.linked
    return open_.made, blocks


def _line(x: _Node | None):
    while x is not None:
        yield x
        x = x.up


def _past(page: str, at: int, tag: str) -> int:
    """The place after the end tag of an element whose content is no markup; the page's end if there is none."""
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return m.end() if m else len(page)


# What a tag is worth as the container of an article.
TAG_POINTS = {"article": 30, "main": 25, "section": 3, "div": 5, "td": 3, "pre": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "address": -3, "th": -5}
#: Share of a part's characters within links below which it reads as text.
LOW_LINKS = 0.25
LEAVES = frozenset("p pre li blockquote h1 h2 h3 h4 h5 h6 td dd figcaption".split())
#: Levels of containers that a paragraph's points reach.
LEVELS = 8


def _whole(best: _Node) -> _Node:
    """The element that holds all of the article whose best container is given.

    That is the outermost article around it, else the innermost main. Without these it is the container itself, or what is around it
    as far as most of the text outside links lies outside the container; elements around it with no other text don't end its article.
    """
    line = list(_line(best))
    named = [x for x in reversed(line) if x.tag == "article"] or [x for x in line if x.tag == "main"]
    if named:
        return named[0]
    top, plain = best, lambda x: x.chars - x.linked
    for x in line:
        if plain(x) > 2 * plain(top):
            top = x
    while top.up is not None and top.up.up is not None and top.up.chars == top.chars:
        top = top.up
    return top


def extract(page: str) -> str:
    """The article's text: white space within a block is one space, blocks are joined by a newline; '' if there is none.

    Text of any length is kept whole. Broken markup is read as far as it goes.
    """
    nodes, blocks = tree(page)
    if not blocks:
        return ""
    scored: list[_Node] = []
    for owner, text in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        if owner.tag in HEADINGS:
            points = 0.5
        first = owner.up if owner.tag in LEAVES and owner.up else owner
        for level, x in zip(range(LEVELS), _line(first), strict=False):
            if not x.score:
                x.score = 1e-9 + max(0.0, x.weight) + TAG_POINTS.get(x.tag, 0) * (x.chars > 0)
                scored.append(x)
            x.score += points / (1 if not level else 2 if level == 1 else 3 * level)
    value = lambda x: x.score * (1 - x.linked / max(1, x.chars))
    best = max(scored, key=value)  # of equals the first in page order
    need = max(10.0, 0.2 * value(best))
    top = _whole(best)
    top.kept = True
    for x in top.up.kids if top.up is not None else ():
        x.kept = x is top or x.chars > 0 and (x.linked / x.chars < LOW_LINKS or x.score > 0 and value(x) >= need)
    for x in nodes[1:]:
        x.kept = x.kept or x.up.kept
    return "\n".join(text for owner, text in blocks if owner.kept)


def pages(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html gives an empty text; url is passed on as it is, null too. Rows that repeat are rows of the result, an
    empty table gives an empty result. Other columns play no part. Depth and length of a page have no bound.
    """
    small_batches(df.sparkSession)
    urls = df.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(batches):
        for pdf in batches:
            out = pdf[["page_id", "url"]].astype({"page_id": "Int64"})
            out["text"] = [extract(x) if isinstance(x, str) else "" for x in pdf["html"]]
            out["n_chars"] = [len(x) for x in out["text"]]
            yield out

    return urls.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages; null html counts as empty."""
    return pages(table(spark, sf_dir, "pages"))
