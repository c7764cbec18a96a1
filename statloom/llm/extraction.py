"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statloom.llm.base import query, table

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?"
    r"|<(?:svg|object)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|title|iframe|object|select)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|(?P<text>[^<]+)|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
# fixed values: elements and names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("nav footer aside form button dialog head menu fieldset label input select canvas audio video map".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumbs?|header|masthead|footer|foot|sidebar|aside|widget|advert|adverts|advertisement|ad|ads|adbox|banner|sponsor|sponsored|promo|promotion"
    r"|cookie|cookies|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|trending|comments?|respond|replies|reply|disqus|pagination|pager|toolbar|skip|hidden)(?=$|[\s_-]|\d)",
    re.I,
)
# names of article sections too: unwanted with many links or with a form
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:side|notice|alert|search|social|related|recommended|discussion)(?=$|[\s_-]|\d)", re.I)
FORMS = frozenset("form input select button".split())
DOUBTFUL_LINKS, SIBLING_LINKS = 0.3, 0.5
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
KEPT_NAMES = frozenset("article main body html".split())


class Node:
    __slots__ = ("tag", "parent", "children", "bad", "doubtful", "score", "text", "linked")

    def __init__(self, tag: str, parent, bad: bool, doubtful: bool = False):
        self.tag, self.parent, self.bad, self.doubtful = tag, parent, bad, doubtful
        self.children: list = []
        self.score = 0.0
        self.text = self.linked = 0


def unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attrs:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and (tag not in KEPT_NAMES or re.search(r"comment|reply|replies|advert|promo", value, re.I)) and UNWANTED.search(value):
            return True
    return False


def doubtful(tag: str, attrs: str) -> bool:
    return bool(attrs) and tag not in KEPT_NAMES and any(name.lower() in ("class", "id") and DOUBTFUL.search(a or b or c) for name, a, b, c in ATTRIBUTE.findall(attrs))


def tree(page: str) -> Node:
    """Elements and texts; unclosed elements end where HTML lets them end."""
    root = Node("html", None, False)
    here, articles = root, 0
    for piece in PIECE.finditer(page):
        text = piece["text"]
        if text is not None:
            here.children.append(html.unescape(text))
            continue
        tag = piece["tag"]
        if tag is None:
            if piece[0] == "<":
                here.children.append("<")
            continue
        tag = tag.lower()
        if piece["close"]:
            node = here
            while node is not None and node.tag != tag:
                node = None if tag not in BLOCK and node.tag in BLOCK else node.parent
            if node is not None and node.parent is not None:
                while here is not node:
                    articles -= here.tag in ("article", "main")
                    here = here.parent
                articles -= here.tag in ("article", "main")
                here = here.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:
            ends, stops = CLOSES.get(tag, {"p"}), STOPS.get(tag, frozenset())
            node, last = here, None
            while node.parent is not None and node.tag not in stops:
                if node.tag in ends:
                    last = node
                elif node.tag in BLOCK and not (tag in STOPS):
                    break
                node = node.parent
            if last is not None:
                here = last.parent
        node = Node(tag, here, unwanted(tag, piece["attrs"], articles > 0), doubtful(tag, piece["attrs"]))
        here.children.append(node)
        if tag not in VOID and not piece["attrs"].endswith("/"):
            here = node
            articles += tag in ("article", "main")
    return root


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(element, text) of each run of text between block borders, in page order, without unwanted parts."""
    out, parts, owner = [], [], node
    stack = [(node, iter(node.children))]

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((owner, text))
        parts.clear()

    while stack:
        at, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if at.tag in BLOCK:
                flush()
                owner = next((n for n, _ in reversed(stack) if n.tag in BLOCK), node)
            continue
        if isinstance(child, str):
            parts.append(child)
        elif child.bad:
            parts.append(" ")
        elif child.tag == "br":
            parts.append(" ")
        else:
            if child.tag in BLOCK:
                flush()
                owner = child
            stack.append((child, iter(child.children)))
    flush()
    return out


def _weigh(root: Node) -> list[Node]:
    """Lengths of text and of linked text below each wanted element; elements, parents first."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append(node)
        for child in node.children:
            if isinstance(child, str):
                n = len(child.strip())
                node.text += n
                node.linked += n * link
            elif not child.bad:
                stack.append((child, link or child.tag == "a"))
                child.text = child.linked = 0
    for node in reversed(order):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
    return order


def _dense(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _settle(order: list[Node]) -> bool:
    """Doubtful elements with many links, or a form, become unwanted; whether there were any."""
    forms, some = set(), False
    for node in reversed(order):
        if node in forms or any(not isinstance(c, str) and c.tag in FORMS for c in node.children):
            forms.add(node.parent)
            form = True
        else:
            form = False
        if node.doubtful and (form or _dense(node) > DOUBTFUL_LINKS):
            node.bad = some = True
    return some


def _beside(best: Node) -> None:
    """Takes out what does not belong to the article beside ``best``: unwanted elements and runs of links."""
    keep, run = [], []

    def close() -> None:
        text = sum(len(x.strip()) if isinstance(x, str) else x.text for x in run)
        linked = sum(x.text if x.tag == "a" else x.linked for x in run if not isinstance(x, str))
        if linked < SIBLING_LINKS * text:
            keep.extend(run)
        elif text:
            keep.append(" ")
        run.clear()

    floor = max(10.0, best.score * 0.2)
    for node in best.parent.children:
        if isinstance(node, str) or node.tag not in BLOCK and node is not best and not node.bad:
            run.append(node)
            continue
        close()
        heading = len(node.tag) == 2 and node.tag[0] == "h" and node.tag != "hr"
        if not node.bad and (node is best or heading or node.score >= floor or _dense(node) < SIBLING_LINKS):
            keep.append(node)
        else:
            keep.append(" ")
    close()
    best.parent.children = keep


def main_text(page: str) -> str:
    """Text of the best container and of its siblings that belong to it; empty if the page has no text."""
    if not page:
        return ""
    root = tree(page)
    order = _weigh(root)
    if _settle(order):
        root.text = root.linked = 0
        order = _weigh(root)
    for node in order:  # lists of links are menus
        if node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.text and _dense(node) > 0.7:
            node.bad = True
    found = blocks(root)
    for node, text in found:
        points = 1.0 + text.count(",") + text.count("、") + min(len(text) / 100, 3.0)
        up, share = node.parent if node.tag in ("p", "li", "td", "dd", "pre", "blockquote") or node.tag[:1] == "h" and len(node.tag) == 2 else node, 1.0
        while up is not None and share > 0.1:
            up.score += points * share
            up, share = up.parent, share / 2
    if not found:
        return ""
    for node in order:
        node.score *= 1 - _dense(node)
        if node.tag in ("article", "main"):
            node.score += 25
    best = max((n for n in order if not n.bad), key=lambda n: n.score)
    up = best
    while up is not None:  # an article holds its parts together
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    if best.parent is not None and best.tag not in ("article", "main"):
        _beside(best)
        best = best.parent
    return " ".join(text for _, text in blocks(best))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py() or "") for p in batch.column("html")]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page: the article without what surrounds it.

    Blocks give points for length and commas to the elements above them, halved at each step and lowered by the share of
    linked text; the best container, or the article around it, is kept with all its siblings but unwanted ones and
    runs of links. Null or empty
    html gives an empty text; broken markup is closed where HTML lets it end; repeated rows get equal answers; null ids
    and urls stay; an empty table gives no rows; other columns are left out. One page is one task's work, never more.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")


@query("op9_html_tree_scoring")
def op9(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
