"""HTML extraction by composite text density.

For each node of a page's DOM the density is its characters per tag, adjusted for links: C / T * log_b(C / LC * T / LT)
with b = ln(C / (C - LC) * LC + LCb / Cb * C + e), where C, T, LC and LT count characters, tags, link characters and
link tags below the node and LCb, Cb those of the body (a zero divisor counts as 1). The subtree with the largest sum of its children's densities is
the main text. It widens to its parent as long as everything else there is a heading or at least as dense as the
sparsest node on the path from the body (the body-path threshold); inside an article or main element, which it never leaves, what is sparser
hinders it only where most of it is links, and is then left out.

Elements that are never main text leave before densities are computed: scripts, styles, form fields, navigation, asides, footers, headers outside an article.
Forms, and elements whose class, id or role names an advert, menu, sidebar, notice, comment section or the like, are only suspect: densities within them count
a fifth, so that an equally dense subtree elsewhere wins, and whatever holds the subtree that does win stays, by whatever name. Suspects beside or within it leave, unless they hold most of its text in headings or paragraphs: forms, comment sections and plain adverts, menus and sidebars always; what may as well be prose (a section named social or notice, or a single paragraph with any such name) only if it is less than
half as dense as the median paragraph or most of it is links. Names count only as whole words: one of several parts must consist of such words and of neutral ones (site-footer, but not
notice-of-motion, nor has-sidebar), and beside a name such as post or content they count for nothing.

Defined results: null, empty or text-free HTML gives an empty text; unclosed and stray tags are repaired the way
browsers do for the common cases; a quote without an end is an ordinary character; other columns are ignored; repeated rows give
repeated rows; an empty table gives an empty table.

Scale: one narrow map over the pages, no shuffle; memory is one Arrow batch and one page's tree; the time is linear in a page's length, however
malformed or deeply nested it is.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template xmp iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROP = frozenset("head script style noscript template iframe svg canvas object nav aside footer button select option input textarea menu dialog".split())
#: Names of elements that are no main text, those of reader comments, and words that may stand beside them in a name.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
BAD_WORDS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox banner banners sponsor sponsors sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside "
    "footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar skip copyright legal disclaimer".split()
)
#: Those of BAD_WORDS that may as well name prose.
WEAK_WORDS = frozenset("footer header notice notices alert overlay social widget widgets toolbar skip copyright legal disclaimer".split())
#: Elements of running text, which no name makes an advert or a comment section by itself.
FLOW = frozenset("p li blockquote pre td th dd dt figcaption span em strong b i u small code q cite mark".split())
PRIOR, HALF = 0.2, 0.5
NEUTRAL = frozenset("site page global top bottom left right main primary secondary list box slot wrap wrapper container section block area zone reader readers user users posts articles links link inner outer item items group bar unit row col column panel form thread buttons button icons js id".split())
CONTENT = frozenset("content article post entry story body text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
KEEP_HEADER_IN = frozenset(("article", "main"))
#: A start tag of the key closes an open element of the set, up to the nearest element of the bound.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("article main section div td th table body html blockquote li ul ol figure".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "bad", "suspect", "c", "t", "lc", "lt", "density", "total", "prior")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False, suspect: str = ""):
        """bad: no main text; suspect: form, comments, strong or weak, if only a name or a form says so."""
        self.tag, self.parent, self.kids, self.bad, self.suspect = tag, parent, [], bad, suspect
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.total = 0.0
        self.prior = 1.0


def _bad(tag: str, attrs: str, opened: Counter) -> tuple[bool, str]:
    """Whether an element is no main text, and what makes it suspect."""
    if tag in DROP:
        return True, ""
    if tag == "header":
        return not any(opened[t] for t in KEEP_HEADER_IN), ""
    if not attrs or tag in HEADINGS or tag in ("html", "body"):
        return False, "form" if tag == "form" else ""
    found = set()
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, ""
        if name == "role" and value in BAD_ROLES:
            found.add("strong")
        if name in ("class", "id"):
            names = [[w for w in re.split(r"[_\-\d]+", x) if w] for x in value.split()]
            if any(not CONTENT.isdisjoint(x) and BAD_WORDS.isdisjoint(x) for x in names):
                continue
            for x in names:
                words = BAD_WORDS.intersection(x)
                if words and all(w in BAD_WORDS or w in NEUTRAL for w in x):
                    found.add("comments" if not words.isdisjoint(COMMENTS) else "weak" if words <= WEAK_WORDS else "strong")
    if tag in KEEP_HEADER_IN:
        found &= {"comments"}
    return False, "form" if tag == "form" else next((k for k in ("comments", "strong", "weak") if k in found), "")


def parse(page: str) -> Node:
    """The DOM; text is in kids as str, white space and character references as in the page."""
    root = Node("html", None)
    stack, opened, at, n, strict = [root], Counter(), 0, len(page), True

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while at < n:
        m = MARK.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        begin = m.start()
        if begin > at:
            stack[-1].kids.append(page[at:begin])
        if m[2] is None:
            comment = page.startswith("<!--", begin)
            end = page.find("-->", begin + 4) if comment else page.find(">", begin)
            if end < 0 and not comment:
                stack[-1].kids.append(page[begin:])
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        end = INSIDE.match(page, m.end()).end() if strict else page.find(">", m.end())
        if strict and page[end : end + 1] != ">":  # a quote has no end: from here on the first > ends a tag
            strict, end = False, page.find(">", m.end())
        if end < 0:
            stack[-1].kids.append(page[begin:])
            break
        tag, attrs = m[2].lower(), page[m.end() : end].strip()
        at = end + 1
        if tag == "html":
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK or tag == "p" and stack[k].tag in SCOPE:
                    break
            continue
        if tag in BLOCK and (opened["p"] > 0 or tag in HEADINGS):  # a block ends an open paragraph, with the inline elements left open in it
            for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 or any(opened[h] > 0 for h in HEADINGS) else ():
                if stack[k].tag == "p" or stack[k].tag in HEADINGS and tag in HEADINGS:
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag == "body" and opened["head"] > 0:  # whatever the head left open
            close(next(k for k in range(1, len(stack)) if stack[k].tag == "head"))
        if tag in CLOSES:
            ends, bound = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in ends) else ():
                if stack[k].tag in bound:
                    break
                if stack[k].tag in ends:
                    close(k)
                    break
        node = Node(tag, stack[-1], *_bad(tag, attrs, opened))
        stack[-1].kids.append(node)
        if tag in RAW:
            found = re.compile(rf"</{tag}\b", re.I).search(page, at)
            end = page.find(">", found.end()) if found else -1
            at = end + 1 if end >= 0 else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def measure(root: Node) -> list[Node]:
    """Counts of every kept node, children before parents; the kept nodes in page order."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        order.append(node)
        linked = linked or node.tag == "a"
        node.prior = (node.parent.prior if node.parent is not None else 1.0) * (PRIOR if node.suspect else 1.0)
        for kid in node.kids:
            if isinstance(kid, str):
                k = len("".join(kid.split()))
                node.c += k
                node.lc += k if linked else 0
        todo.extend((kid, linked) for kid in reversed(node.kids) if not isinstance(kid, str) and not kid.bad)
    for node in reversed(order):
        if node.parent is not None:
            up = node.parent
            up.c += node.c
            up.lc += node.lc
            up.t += node.t + 1
            up.lt += node.lt + (node.tag == "a")
    body = next((n for n in order if n.tag == "body"), root)
    share = body.lc / max(body.c, 1)
    for node in order:
        c, t, lc, lt = node.c, max(node.t, 1), max(node.lc, 1), max(node.lt, 1)
        if c:
            base = math.log(c / max(c - node.lc, 1) * node.lc + share * c + math.e)
            # a page without links has the base 1, whose logarithm is 0: bounded below
            node.density = c / t * max(math.log(c / lc * t / lt), 0.0) / max(math.log(base), 0.1)
    for node in order:
        if node.parent is not None and not node.bad:
            node.parent.total += node.density * node.prior
    return order


def typical(node: Node) -> float:
    """The median density of the paragraphs and the like in a subtree, without headings and suspects."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.c and x.tag not in HEADINGS and any(isinstance(k, str) and k.strip() for k in x.kids):
            found.append(x.density)
        todo.extend(k for k in x.kids if not isinstance(k, str) and not k.bad and not k.suspect)
    return sorted(found)[len(found) // 2] if found else 0.0


def structured(node: Node) -> bool:
    """Whether a heading or a paragraph stands in a subtree."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "p" or x.tag in HEADINGS or x.tag in KEEP_HEADER_IN:
            return True
        todo.extend(k for k in x.kids if not isinstance(k, str) and not k.bad)
    return False


def leaves(node: Node, usual: float, whole: int) -> bool:
    """Whether a suspect beside or within the main text is no part of it. usual: density of its paragraphs; whole: its characters."""
    if node.suspect == "form":
        return 2 * node.c < whole
    if node.suspect != "comments" and 2 * node.c > whole and 2 * node.lc <= node.c and structured(node):  # most of the text has no other place
        return False
    if node.suspect in ("comments", "strong") and node.tag not in FLOW:
        return True
    return node.density < HALF * usual or 2 * node.lc > node.c


def main_node(root: Node) -> Node:
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    best = max((n for n in order if n.c and (n is not root or n is body)), key=lambda n: n.total, default=body)
    if not best.total:  # text without inner elements: the densest node itself
        best = max((n for n in order if n.c), key=lambda n: n.density * n.prior, default=body)
    threshold, node, holder = best.density, best, None
    while node is not None:  # what holds the main text is not suspect
        threshold = min(threshold, node.density)
        holder = node if node.tag in KEEP_HEADER_IN else holder
        node.suspect = ""
        node = node.parent if node is not body else None
    whole, usual = (holder or best).c, typical(holder or best)
    while best is not body and best is not holder and best.parent not in (None, body):
        up = best.parent
        rest = [k for k in up.kids if not isinstance(k, str) and not k.bad and k is not best and k.c]
        for k in rest:
            k.bad = bool(k.suspect) and leaves(k, usual, whole)
        sparse = [k for k in rest if not k.bad and k.tag not in HEADINGS and k.density < threshold]
        if holder is None and (sparse or any(isinstance(k, str) and k.strip() for k in up.kids)):
            break
        for k in sparse:
            k.bad = 2 * k.lc > k.c
        best = up
    if best.tag in ("p", "b", "i", "span", "em", "strong") and best.parent is not None:
        best = best.parent
    todo = [k for k in best.kids if not isinstance(k, str) and not k.bad]
    while todo:
        node = todo.pop()
        node.bad = bool(node.suspect) and leaves(node, usual, whole)
        if not node.bad:
            todo.extend(k for k in node.kids if not isinstance(k, str) and not k.bad)
    return best


def text_of(node: Node) -> str:
    blocks, parts = [], []

    def end() -> None:
        line = " ".join(html_lib.unescape("".join(parts)).split())
        parts.clear()
        if line:
            blocks.append(line)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.bad:
            if x.tag == "br":
                parts.append(" ")
            elif x.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(x.kids))
    end()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return text_of(main_node(parse(page)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
