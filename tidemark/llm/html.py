"""Main text of web pages: paragraphs give points to their ancestors, the best container is kept."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read

OPEN = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
OPEN_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BARE_END = re.compile(r"""=\s*[^\s"'>]*/$""")  # the slash is part of a value without quotes
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed sets of HTML names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table menu dir select".split())
NEVER_TEXT = frozenset(
    "head script style title textarea noscript iframe xmp noembed noframes template nav footer aside form button select option "
    "object embed svg canvas dialog menu audio video map input".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words in class and id that mark what is around an article, comments, and an article itself.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion menu nav navbar "
    "navigation breadcrumb breadcrumbs side sidebar rail aside footer header masthead cookie cookies consent gdpr notice notices alert "
    "alerts popup modal overlay toast newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget toolbar pagination pager disclaimer copyright".split()
)
COMMENT = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
ITSELF = frozenset("article content main post entry story body text page".split())
WITH = frozenset("has with no without layout".split())
# Within an article: words that name adverts, readers' comments and menus wherever they lead or end a name ...
SURE = frozenset(
    "ad ads advert adverts advertisement advertising adslot sponsor sponsored comment comments commentlist disqus nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr newsletter subscribe signup login pagination".split()
)
# ... but not before these, ...
NOT_SURE = frozenset("hoc on by from price prices planning law policy science study studies history theory".split())
# ... and words that say so only where the content does: mostly links, a form, names and times of readers, or a mere label.
HINTS = (AROUND | COMMENT) - SURE
READER = frozenset("author avatar comment comments commentlist commenter user username reply permalink".split())
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
SENTENCE = re.compile(r"""[.!?…]["'”’)\]]*\s*$""")
#: Elements beside a container that belong to its text unless they are mostly links.
BESIDE = frozenset("blockquote pre table figure ul ol dl".split())


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "score", "chars", "linked", "own")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked, self.own = 0.0, 0, 0, ""


def parse(page: str) -> Node:
    """A tree of any input: unknown and unclosed tags, stray ends, raw text elements and comments are dealt with as
    browsers mostly do. Linear but for pages that never close a quote."""
    root = Node("#root", "", None)
    stack, count = [root], Counter()
    at, n, last = 0, len(page), page.rfind(">")

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            count[stack.pop().tag] -= 1

    def find(names: set[str] | frozenset[str], stop) -> int:
        """Depth of the innermost open element with one of the names, not looking past `stop`; 0 for none."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                return k
            if stop(stack[k].tag):
                break
        return 0

    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last:  # no further tag ends: the rest is text, up to a comment
            comment = page.find("<!--", start) if start >= 0 else -1
            start, n = (n, n) if comment < 0 else (comment, comment)
        if start > at:
            stack[-1].children.append(page[at:start])
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        m = OPEN.match(page, start) or OPEN_LOOSE.match(page, start)
        if not m:
            stack[-1].children.append("<")
            at = start + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if count[tag] > 0 and (depth := find({tag}, BLOCK.__contains__ if tag not in BLOCK else lambda t: False)):
                pop_to(depth)
            continue
        if tag in BLOCK and count["p"] > 0 and (depth := find({"p"}, BLOCK.__contains__)):
            pop_to(depth)
        if tag in ENDS and (depth := find(ENDS[tag], STOPS.__contains__)):
            pop_to(depth)
        node = Node(tag, m[3], stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = n if end < 0 else end + 1
        elif tag not in VOID and (not m[3].endswith("/") or BARE_END.search(m[3])):
            stack.append(node)
            count[tag] += 1
        elif tag not in VOID and tag in BLOCK:  # <div/> opens an element in HTML
            stack.append(node)
            count[tag] += 1
    return root


def _named(value: str) -> set[str]:
    return {p.lower() for p in PART.findall(value)}


def _attributes(node: Node) -> dict[str, str]:
    """By lower-cased name; the first of two counts. A name within a quoted value is no attribute."""
    values: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(node.attributes):
        values.setdefault(name.lower(), html.unescape(a or b or c))
    return values


class Content:
    """What stands in an element: code points of text and of linked text, code points of sentences and paragraphs, and whether it
    has headings, forms, or names and times of readers."""

    __slots__ = ("chars", "linked", "told", "heading", "form", "reader", "first")

    def __init__(self, children: list[Node | str], of: dict[int, Content]):
        self.chars = self.linked = self.told = 0
        self.heading = self.form = self.reader = False
        self.first, run = "", []
        for x in children:
            if isinstance(x, str):
                run.append(x)
                self.chars += len(x.strip())
                self.first = self.first or x.strip()
                continue
            c = of[id(x)]
            self.first = self.first or c.first
            self.chars += c.chars
            self.linked += c.chars if x.tag == "a" else c.linked
            self.told += c.chars - c.linked if x.tag in ("p", "blockquote", "pre", "table") else c.told
            self.heading |= c.heading or x.tag in HEADINGS
            self.form |= c.form or x.tag in ("form", "textarea", "button", "input")
            names = _named(" ".join(v for k, v in _attributes(x).items() if k in ("class", "itemprop", "itemtype"))) if x.attributes else ()
            self.reader |= c.reader or x.tag == "time" or not READER.isdisjoint(names)
        text = " ".join("".join(run).split())
        if SENTENCE.search(text):
            self.told = max(self.told, len(text))


def _content(node: Node, of: dict[int, Content]) -> Content:
    """The content of node; that of all below it is kept in `of`, as marked names may be nested."""
    if id(node) not in of:
        below, todo = [], [node]
        while todo:
            x = todo.pop()
            below.append(x)
            todo += [c for c in x.children if isinstance(c, Node) and id(c) not in of]
        for x in reversed(below):
            of[id(x)] = Content(x.children, of)
    return of[id(node)]


def _says_around(node: Node, names: list[str], of: dict[int, Content]) -> bool:
    """Within an article: whether a class or id, and what the element holds, mark it as no part of the article.

    A sure word that leads or ends a name is enough, unless a word of NOT_SURE tells that it is a topic. Any other marked name
    is a hint, which an element follows if it holds readers' names, a form, mostly links, a notice of rights or no more
    than a label. A hint alone takes no headed or running text away.
    """
    hinted = set()
    for name in names:
        parts = [p.lower() for p in PART.findall(name)]
        if not parts:
            continue
        ends = [p for p in (parts[0], parts[-1]) if p in SURE]
        if ends and not NOT_SURE & set(parts):
            return True
        hinted |= HINTS.intersection(parts) | set(ends)
    if not hinted:
        return False
    c = _content(node, of)
    if c.chars and c.linked >= 0.5 * c.chars or RIGHTS.match(c.first):
        return True
    if hinted & (COMMENT | {"share", "sharing", "social", "signup", "subscription", "popup", "modal"}) and (c.form or c.reader):
        return True
    if "related" in hinted and any(_named(n) <= {"related", "content", "posts", "post", "articles", "article", "stories", "story", "links", "news", "items", "reading"} for n in names if "related" in _named(n)):
        return True
    return not c.told and not c.heading


def unwanted(node: Node, inside: bool = False, of: dict[int, Content] | None = None) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments and hidden parts.

    inside: whether the node is within an article. There a class or id says so only together with its place in the name or
    with what the element holds (`_says_around`), and headings are the article's.
    """
    tag = node.tag
    if tag in NEVER_TEXT or tag == "fieldset" and not inside:
        return True
    if tag == "header" and not inside:
        return True
    if not node.attributes or tag in ("html", "body", "main"):
        return False
    values = _attributes(node)
    if values.get("role", "").lower() in NEVER_ROLE or values.get("aria-hidden", "").lower() == "true" or "hidden" in values:
        return True
    if "display:none" in values.get("style", "").replace(" ", "").lower():
        return True
    names = f"{values.get('class', '')} {values.get('id', '')}"
    if inside:
        if tag in HEADINGS or tag == "header":
            return bool(_named(names) & {"ad", "ads", "advert"})
        return _says_around(node, names.split(), {} if of is None else of)
    words = _named(names)
    if words & COMMENT:
        return True
    if tag == "article" or words & WITH:
        return False
    around = words & AROUND
    if around == {"header"} and words & ITSELF or tag in HEADINGS and not words & {"ad", "ads", "advert"}:
        return False
    return bool(around)


def _walk(node: Node, inside: bool = False) -> Iterator[Node]:
    """All wanted nodes below (and with) node in page order, without recursion; unwanted parts are cut out."""
    todo, of = [(node, inside)], {}
    while todo:
        x, within = todo.pop()
        yield x
        if any(isinstance(c, Node) for c in x.children):
            within = within or x.tag in ("article", "main")
            x.children = [c for c in x.children if isinstance(c, str) or not unwanted(c, within, of)]
            todo += [(c, within) for c in reversed(x.children) if isinstance(c, Node)]


def blocks(node: Node) -> list[str]:
    """Texts between the borders of block elements, white space collapsed, empty ones left out."""
    out, run = [], []

    def close() -> None:
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                out.append(text)
            run.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        else:
            block = x.tag in BLOCK or x.tag == "#root"
            if block:
                close()
                todo.append(None)
            todo += reversed(x.children)
    close()
    return out


def best_container(root: Node) -> Node | None:
    """The container with the most points."""
    nodes = list(_walk(root))
    for x in reversed(nodes):  # children come before their parents
        own = []
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(c.strip())
                own.append(c)
            else:
                x.chars += c.chars
                x.linked += c.chars if c.tag == "a" else c.linked
                if c.tag not in BLOCK:
                    own.append(c.own)
        x.own = "".join(own) if x.tag not in ("a", "#root") else ""
    # points: of a paragraph. given: what its children's paragraphs give to x. handed: what x passes on from further below
    given: dict[int, list] = {}  # by node: the node, points of children, points from deeper levels
    for x in reversed(nodes):
        text, up = x.own.strip(), x.parent
        points = 0.0
        if x.tag in BLOCK and x.tag not in HEADINGS and text and up is not None:
            points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - min(1.0, x.linked / max(x.chars, 1)))
            if x.tag in HOLDERS:  # its own text makes it a container
                held = given.setdefault(id(x), [x, 0.0, 0.0])
                held[1] += points
                points = 0.0
        held = given.get(id(x))
        if up is not None and up.tag != "#root" and (points or held):
            to = given.setdefault(id(up), [up, 0.0, 0.0])
            to[1] += points
            if held:
                to[2] += held[1] / 2 + held[2] / 3
    for x, near, far in given.values():
        x.score = (BONUS.get(x.tag, 0.0) + near + far) * (1 - min(1.0, x.linked / max(x.chars, 1)))
    return max((x for x in nodes if id(x) in given), key=lambda x: x.score, default=None)


#: Elements whose own text counts for themselves, and points that an element has from the start.
HOLDERS = frozenset("div section article main td body".split())
BONUS = {"article": 12.0, "main": 10.0, "section": 3.0, "div": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}


def _menus(kept: list[Node]) -> None:
    """Cuts out lists that are nothing but links, where no article or main element vouches for them: those before the
    first running text, and later ones that neither a heading nor a line with a colon introduces."""
    begun, introduced = False, False
    for x in kept:
        for y in _walk(x):
            children = []
            for c in y.children:
                if isinstance(c, Node):
                    if c.tag in ("ul", "ol") and c.chars and c.linked >= 0.8 * c.chars and not (begun and introduced):
                        continue
                    if c.tag in BLOCK and c.chars:
                        introduced = c.tag in HEADINGS or c.own.strip().endswith(":")
                        begun = begun or c.tag not in HEADINGS and c.linked < 0.5 * c.chars
                children.append(c)
            y.children = children


def main_text(page: str | None) -> str:
    """The blocks of the best container and of siblings like it, in page order, one a line; empty if there are none.

    A paragraph's points (one, one for each comma, up to three for its length, less its share of linked text) go to its
    parent, half of them to the grandparent, a sixth to the next and a third of that to each further one. A container's
    sum is discounted by its own share of linked text. Beside the best container, siblings stay that have a fifth of its
    points (beside an article, only other articles), headings, paragraphs and short containers of running text, quotations,
    tables and lists that aren't mostly links.
    """
    root = parse(page or "")
    best = best_container(root)
    if best is None:
        return "\n".join(blocks(root))
    # an article element around the best container is the article, with its heading; so is main where there is none
    around, up = None, best
    while up is not None:
        if up.tag == "article" or up.tag == "main" and around is None:
            around = up
        up = up.parent
    if around is not None and around.linked < 0.5 * max(around.chars, 1):
        best = around
    kept = [best]
    if best.tag not in ("main", "body") and best.parent is not None:
        bar = max(10.0, best.score / 5)
        kept = []
        for x in best.parent.children:
            if isinstance(x, str):
                continue
            dense = x.linked / max(x.chars, 1)
            text = x.own.strip()
            if x is best:
                kept.append(x)
            elif best.tag == "article":
                if x.tag == "article" and x.score >= bar and dense < 0.25:
                    kept.append(x)
            elif x.score >= bar or x.tag == "p" and dense < 0.25 and (len(text) > 80 or text.endswith((".", "!", "?")) and not dense):
                kept.append(x)
            elif x.tag in ("div", "section") and dense < 0.25 and _content(x, {}).told and not RIGHTS.match(_content(x, {}).first):
                kept.append(x)
            elif x.tag in HEADINGS or x.tag in BESIDE and dense < 0.25 and x.chars:
                kept.append(x)
    if best.tag not in ("article", "main"):
        _menus(kept)
    return "\n".join(b for x in kept for b in blocks(x))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    Null or empty html gives an empty text. Of containers with equal points the first in the page is the best. Whole
    pages are read; nested, broken or very long markup is no special case. Rows that repeat or have no page_id stay, each
    with its page's text; an empty table has no rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every page: page_id, url, text, n_chars."""
    return extract(read(spark, sf_dir, "pages"))
