"""Main text of web pages by site template removal.

A page is read into a tree of its block elements (inline tags, comments, scripts and styles vanish; unclosed
and crossed tags are mended). Every subtree is hashed by tag and text. Spark counts, per host, on how many
pages each subtree stands; one that recurs on at least `LEAST_PAGES` pages and a `LEAST_SHARE` of the host's
pages is template and is deleted. Inside an article only containers are deleted that way, never its
paragraphs, and never what holds most of the text, so a quotation or a copied article is not taken for
template. Pages without an article or main element count once for each text that the host has of them, so that
copies under many urls do not make their own text a template. Of what is left, elements that HTML or common class names mark as menu, header, footer, sidebar,
notice, advert, form or comments go too, and the article (else the main element, else the body) is the text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one.
Null html gives an empty text, a null url an empty host. Repeated pages are reported as often as they occur.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import Batches, one_string_column, store
from fleetwright.llm.url_cascade import split_url

LEAST_PAGES, LEAST_SHARE = 4, 0.01

ROOTS = {"article", "main"}
WHOLE = {"html", "body", "article", "main", "#page"}
BLOCKS = WHOLE | set("""p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section
 aside nav header footer form fieldset blockquote pre figure figcaption address details summary hgroup menu dialog
 br hr head title""".split())
VOID = {"br", "hr"}
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "button", "title"}
#: Of these, whose content is never markup: left open they reach to the end of the page.
TEXT_ONLY = {"script", "style", "textarea", "title"}
#: Inside an article these count as its own text, however often they recur.
CONTENT = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption blockquote pre figcaption summary address br hr".split())
DROPPED = set("head nav header footer aside form menu dialog fieldset".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_NAMES = set("""ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar side-bar
 menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies cookie-notice consent notice
 notification alert popup modal newsletter subscribe signup login share sharing social related recommended comment
 comments comment-list reader-comments respond discussion disqus widget pagination pager toolbar""".split())
#: An open element of the left kind ends where one of the right kinds begins.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"},
            "th": {"td", "th", "tr"}, "tr": {"tr"}, "head": {"body"}} | {
            f"h{i}": {"p", "div", "article", "section", *(f"h{j}" for j in range(1, 7))} for i in range(1, 7)}

# Possessive, so that a broken tag is read once. A tag whose quote is left open ends at the next angle bracket.
_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|<[!?][^>]*(?:>|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|(?=<))"
                     r"|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)(?:>|\Z|(?=<))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMING = re.compile(r"\b(?:class|id|role|hidden)\b", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "marks", "children", "parent", "chars", "digest", "in_article", "holds_article")

    def __init__(self, tag: str, marks: str, parent):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.children: list = []  # texts and nodes
        self.in_article = parent is not None and (parent.in_article or parent.tag in ROOTS)
        self.holds_article, self.chars, self.digest = False, 0, 0


def read_tree(page: str) -> Node:
    root = here = Node("#page", "", None)
    at, end, never_closed = 0, len(page), set()
    while at < end:
        found = _MARKUP.search(page, at)
        text = page[at:found.start() if found else end]
        if text:
            here.children.append(text)
        if not found:
            break
        at = found.end()
        closing, name, rest = found[1] or found[4], found[2] or found[5], found[3] or found[6] or ""
        if not name:
            continue
        tag = name.lower()
        if tag in RAW:
            here.children.append(" ")
            if closing or rest.endswith("/") and tag not in TEXT_ONLY or tag in never_closed:
                continue
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if close or tag in TEXT_ONLY:
                at = close.end() if close else end
            else:
                never_closed.add(tag)  # what follows an element that stays open is read as usual
        elif tag not in BLOCKS:
            continue
        elif closing:
            seek = here
            while seek is not None and seek.tag != tag:
                seek = seek.parent
            if seek is not None and seek.parent is not None:
                here = seek.parent
        elif tag in VOID:
            here.children.append(" ")
        else:
            while tag in ENDED_BY.get(here.tag, ()):
                here = here.parent
            marks = rest if _NAMING.search(rest) else ""
            node = Node(tag, marks, here)
            if tag in ROOTS:
                up = here
                while up is not None:
                    up.holds_article = True
                    up = up.parent
            here.children.append(node)
            here = node
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Length and digest of every subtree, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        state = hashlib.blake2b(node.tag.encode(), digest_size=8)
        for child in node.children:
            if isinstance(child, str):
                if words := child.split():
                    node.chars += sum(map(len, words))
                    state.update(" ".join(words).encode("utf-8", "surrogatepass"))
            elif child.chars:
                node.chars += child.chars
                state.update(b"<%d>" % child.digest)
        node.digest = int.from_bytes(state.digest(), "little", signed=True)


def nodes(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in node.children if not isinstance(c, str)]


def may_be_template(node: Node, main_chars: int) -> bool:
    """Whether a subtree may be deleted for recurring: not a part of the text, and not most of it."""
    if node.tag in WHOLE or node.holds_article or not node.chars:
        return False
    if node.in_article and node.tag in CONTENT:
        return False
    return 2 * node.chars < main_chars or (not node.in_article and _has_article(node))


def _has_article(node: Node) -> bool:
    while node.parent is not None:
        node = node.parent
    return node.holds_article


def subtrees(page: str) -> tuple[set[int], int | None]:
    """Digests of the subtrees of a page that a template may have put there; a page without article, its text's hash."""
    root = read_tree(page)
    found = {n.digest for n in nodes(root) if may_be_template(n, root.chars)}
    return found, None if root.holds_article else _text_hash(root)


def _text_hash(root: Node) -> int:
    parts, stack = [], [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        else:
            parts.append(" ")
            stack += [" ", *reversed(item.children)]
    text = " ".join("".join(parts).split())
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def marked_as_other(node: Node) -> bool:
    """Whether tag, role, class or id say that an element is not the main text."""
    if node.tag in DROPPED:
        return True
    for name, *values in _ATTRIBUTE.findall(node.marks):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "role" and value in DROPPED_ROLES:
            return True
        if name in ("class", "id") and DROPPED_NAMES & {*value.split(), *re.split(r"[\s_-]+", value)} and node.tag not in WHOLE:
            return True
        if name == "class" and node.tag == "article" and {"comment", "comments"} & set(value.split()):
            return True
    return False


def main_text(page: str, template: set[int]) -> str:
    root = read_tree(page)
    gone = {id(n) for n in nodes(root) if n.digest in template and may_be_template(n, root.chars)}

    def tops(tag: str) -> list[Node]:
        """Outermost elements of a tag that are kept, in page order."""
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            if id(node) in gone or marked_as_other(node):
                continue
            if node.tag == tag:
                out.append(node)
            else:
                stack += [c for c in reversed(node.children) if not isinstance(c, str)]
        return out

    parts: list[str] = []
    for top in tops("article") or tops("main") or [root]:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif id(item) not in gone and not marked_as_other(item):
                parts.append(" ")
                stack += [" ", *reversed(item.children)]
    return " ".join(references.unescape("".join(parts)).split())


def template_counts(pages: DataFrame) -> DataFrame:
    """(host, digest, pages) from rows (host, html); a null digest has the host's pages. Summed within each task first."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            seen: dict[tuple[str, int | None, int | None], int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digests, text = subtrees(page)
                for digest in (None, *digests):
                    seen[host, digest, text] = seen.get((host, digest, text), 0) + 1 if text is None else 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), *(pa.array([k[i] for k in seen], pa.int64()) for i in (1, 2)),
                 pa.array(list(seen.values()), pa.int64())], names=["host", "digest", "page_text", "pages"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, digest long, page_text long, pages long")
    each = rows.groupBy("host", "digest", "page_text").agg(F.sum("pages").alias("pages"))
    once = F.when(F.col("page_text").isNull(), F.col("pages")).otherwise(F.lit(1))
    return each.groupBy("host", "digest").agg(F.sum(once).alias("pages"))


def host_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, template): digests of the host's template subtrees.

    A page has only so many subtrees, so at most their mean number / least_share of them reach the share.
    """
    counts = store(template_counts(pages).filter((F.col("pages") >= least_pages) | F.col("digest").isNull()), "subtrees")
    totals = counts.filter("digest IS NULL").select("host", F.col("pages").alias("total"))
    often = counts.filter("digest IS NOT NULL").join(totals, "host")
    return (often.filter(F.col("pages") >= F.col("total") * least_share)
            .groupBy("host").agg(F.collect_list("digest").alias("template")))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, html: str = "html",
            url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"),
                        split_url(pages[url])[0].alias("host"), one_string_column(pages, html, "html"))
    # Stored first: Spark then knows its size, sends it to the pages if it is small, and splits a hot host if not.
    known = store(host_templates(rows.select("host", "html"), least_pages, least_share), "templates")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [main_text(page, set(template or ()))
                     for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return rows.join(known, "host", "left").select("page_id", "url", "html", "template").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
