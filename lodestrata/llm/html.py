"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with the path of tags (and first class names) from the root to its leaf. Text length outside
links and punctuation are summed per path and divided by the path's blocks; both ratios are smoothed over sibling paths and
fused as a product. What markup says of an element is a prior that this is multiplied by: next to nothing for menus, footers,
forms, comments and the like by their tag or role, or by a name that is wholly such a part's; a third where a name is doubtful,
and outside of article and main elements where a page has them. Names weigh on whole elements by what is in them, never on
paragraphs, headings or parts of a sentence: inside the article, headers with a heading stay, and doubtful or menu-like parts
are kept unless half of their text is links. Paths that reach the ratios' mean or spread, whichever is less, are chosen; their
blocks are the content nodes.

The article is the lowest element around the content nodes and the headings. All of its blocks stay that no prior speaks
against, such as short ones and lists of links, whose own ratios are low; elsewhere, and where a prior does, blocks stay by
their path alone. The only h1 of a page without article element is its title, even in a header. Buttons are read where they
stand in a sentence. A page is read in time and memory linear in its size, however deeply it nests.

Defined results: null or empty html gives an empty text; a page with no markup is one block; unclosed and stray tags are
taken as browsers do for paragraphs, lists and tables; repeated rows repeat; extra columns are carried along, and one that is
named like an output gives way to it; very long pages are read whole; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TOKEN = re.compile(r"""<!--(?:>|->)?.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Kinds of HTML elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

# What markup says against an element: its tag, its role, names of parts that aren't the article, names that some have.
DROP_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "head", "search"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status"}
DROP_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "sidebar", "aside", "rail", "footer", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "comment", "comments", "commentlist", "disqus", "discussion", "responses", "replies", "reply", "searchform", "outbrain", "taboola", "notice", "notification", "alert"}
HEADER_WORDS = {"header", "masthead", "banner", "topbar"}
LINK_WORDS = {"nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "toolbar", "pagination", "pager"}
DOUBT_WORDS = {"promotion", "social", "share", "sharing", "related", "recommended", "recommendations", "widget", "skip", "legal", "copyright", "search", "tags"}
#: Words that say where or how a part stands: a name made of these and of one above is that part's; other compounds are doubtful.
LAYOUT_WORDS = {"site", "page", "main", "top", "bottom", "left", "right", "container", "wrapper", "wrap", "box", "block", "list", "area", "section", "bar", "slot", "post", "article", "inner", "outer", "content", "widget", "link", "links", "global", "primary", "secondary", "mobile", "desktop", "fixed", "sticky", "item", "items", "unit", "module", "panel", "form", "thread", "column", "group", "entry", "blog", "message"}
#: Elements that make a sentence or a title: their own names don't count. Elements whose text is none of the page's.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "dt", "caption", "figcaption", "summary", "legend"}
SENTENCES = LEAVES | {"li", "dd", "td", "th", "blockquote"}
MUTED = {"svg", "canvas", "audio", "video", "select", "datalist", "option"}
#: Factors of the fused ratio: what markup excludes; where a name is doubtful, or beside a page's article.
AGAINST, DOUBTED, BESIDE = 1e-6, 1 / 3, 1 / 3
#: What boilerplate() says of an element.
NEUTRAL, NAMED, EXCLUDED, DOUBTFUL, HEADER, LINKS, ARTICLE_NAMED = 0, 1, 2, 3, 4, 5, 6
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An element: path numbers its tag path, block is the block element that it is or stands in, drop what boilerplate() says,
    holds 2 if it is or holds an article, 1 if the title of one; titled if it is or holds a heading. A node's number is less
    than those inside it."""

    __slots__ = ("tag", "up", "path", "drop", "holds", "titled", "block", "number")

    def __init__(self, tag: str, up: Node | None, path: int, drop: int, number: int) -> None:
        self.tag, self.up, self.path, self.drop, self.holds, self.titled, self.number = tag, up, path, drop, 0, tag in HEADINGS, number
        self.block = self if up is None or tag in BLOCK or drop else up.block


def names_of(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes or "hidden" in attributes else {}


def boilerplate(tag: str, found: dict[str, str], within: str = "") -> int:
    """What an element's markup says: EXCLUDED by its tag, role or being hidden; HEADER, LINKS or NAMED as a part that isn't
    the article, DOUBTFUL by a name that such parts may bear; ARTICLE_NAMED for an article named so as a whole. within is the
    tag of the block around it: names of paragraphs, headings and what stands inside of them say nothing."""
    if tag in DROP_TAGS:
        return EXCLUDED
    if not found:
        return HEADER if tag == "header" else NEUTRAL
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return EXCLUDED
    if found.get("role", "").strip().lower() in DROP_ROLES:
        return EXCLUDED
    if tag == "header":
        return HEADER
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag in ("html", "body", "article", "main"):
        whole = set(names.lower().split())
        return ARTICLE_NAMED if tag == "article" and whole & (DROP_WORDS | HEADER_WORDS | LINK_WORDS | DOUBT_WORDS) else NEUTRAL
    if tag in LEAVES or tag not in BLOCK and within in SENTENCES:
        return NEUTRAL
    said = NEUTRAL
    for name in names.split():
        words = set(WORDS.findall(CAMEL.sub("-", name).lower()))
        for kind, telling in ((NAMED, DROP_WORDS), (HEADER, HEADER_WORDS), (LINKS, LINK_WORDS)):
            if words & telling:
                if words <= telling | LAYOUT_WORDS | DROP_WORDS:
                    return kind
                said = DOUBTFUL
        if words & DOUBT_WORDS:
            said = DOUBTFUL
    return said


Block = tuple[Node, str, int]


def blocks_of(page: str) -> tuple[list[Node], list[Block]]:
    """All elements, outer ones first, and (block element, text with single spaces, code points inside links) of every block
    with text."""
    root = Node("", None, 0, 0, 0)
    nodes, stack, out, texts, linked, links, muted, at, worded = [root], [root], [], [], 0, 0, 0, 0, False
    pressed: list[int] = []  # texts of buttons, which are a sentence's where it has other words
    beside_buttons = False
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    block = root

    def flush() -> None:
        nonlocal linked, worded, beside_buttons
        if texts:
            if pressed and not (beside_buttons and block.tag in SENTENCES):
                for i in pressed:
                    texts[i] = " "
            text = " ".join("".join(texts).split())
            if text:  # what stands between links alone, as bars in a menu, counts as linked
                out.append((block, text, len(text) if linked and not worded else linked))
            texts.clear()
            pressed.clear()
            linked, worded, beside_buttons = 0, False, False

    def say(raw: str) -> None:
        nonlocal linked, worded, beside_buttons
        if raw and not muted:
            text = entities.unescape(raw) if "&" in raw else raw
            if opened["button"]:
                pressed.append(len(texts))
            elif not beside_buttons:
                beside_buttons = any(map(str.isalnum, text))
            texts.append(text)
            if links:
                linked += len(text.strip())
            elif not worded:
                worded = any(map(str.isalnum, text))

    def close_to(i: int) -> None:
        nonlocal links, muted, block
        if any(n.block is n for n in stack[i:]):
            flush()
        for n in stack[i:]:
            opened[n.tag] -= 1
            links -= n.tag == "a"
            muted -= n.tag in MUTED
        del stack[i:]
        block = stack[-1].block

    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1].replace("&", "&amp;"))
            continue
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if closing:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close_to(i)
                        break
                    if tag not in BLOCK and stack[i].tag in BLOCK:
                        break
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("br", "hr", "wbr", "img"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                texts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):  # a block element ends an open paragraph
                if stack[i].tag == "p":
                    close_to(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag][0]):
            ends, until = CLOSES[tag]
            last = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in ends:
                    last = i
            if last:
                close_to(last)
        found = names_of(attributes)
        label = f"{tag}.{' '.join(found.get('class', '').split()[:1])}"
        node = Node(tag, stack[-1], paths.setdefault((stack[-1].path, label), len(paths) + 1), boilerplate(tag, found, block.tag), len(nodes))
        nodes.append(node)
        if node.block is node:
            flush()
            block = node
        inside = opened["article"] + opened["main"]
        node.holds = 2 if tag in ("article", "main") else int(tag == "h1" and inside > 0)
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "path"):
            links += tag == "a"
            muted += tag in MUTED
            stack.append(node)
            opened[tag] += 1
    say(page[at:])
    flush()
    for n in reversed(nodes[1:]):
        n.up.holds = max(n.up.holds, n.holds)
        n.up.titled |= n.titled
    return nodes, out


def summed(nodes: list[Node], found: list[Block], values: list[float]) -> list[float]:
    """By number of node: the values of the blocks inside it."""
    out = [0.0] * len(nodes)
    for (node, _, _), v in zip(found, values, strict=True):
        out[node.number] += v
    for n in reversed(nodes[1:]):
        out[n.up.number] += out[n.number]
    return out


def inherited(nodes: list[Node], own: Callable[[Node], float]) -> list[float]:
    """By number of node: the least factor of it and the elements around it."""
    out = [own(nodes[0])]
    for n in nodes[1:]:
        out.append(min(out[n.up.number], own(n)))
    return out


def priors(nodes: list[Node], found: list[Block], by_name: bool) -> tuple[list[float], list[bool]]:
    """By number of node: what markup says, 1 where it says nothing; and whether nothing speaks against or is doubtful.

    Names weigh on a whole element by what is in it. Inside an article, a header with a heading is the article's, and what
    bears a doubtful name or that of a menu is kept unless half of its text is links. Nothing that holds the greater part of
    a page's text is dropped by name.
    """
    marked = [False] * len(nodes)
    for n in nodes[1:]:
        marked[n.number] = marked[n.up.number] or n.tag in ("article", "main")
    own_text = summed(nodes, found, [float(len(text)) for _, text, _ in found])
    in_links = summed(nodes, found, [float(linked) for _, _, linked in found])

    def own(n: Node) -> float:
        inner = marked[n.up.number] if n.up else False
        if n.drop == EXCLUDED:
            return AGAINST
        if not by_name or n.drop in (NEUTRAL, ARTICLE_NAMED) or n.holds:
            return 1.0
        if n.drop == HEADER:
            return 1.0 if inner and n.titled else AGAINST
        if n.drop in (LINKS, DOUBTFUL) and inner:
            return AGAINST if 2 * in_links[n.number] >= own_text[n.number] else 1.0
        return DOUBTED if n.drop == DOUBTFUL else AGAINST

    out = inherited(nodes, own)
    # parts named as boilerplate that are made of articles, as comments and related pages often are, unless most text is there
    held = summed(nodes, found, [(len(text) - linked) * (out[node.number] == 1.0) for node, text, linked in found])
    parts = (NAMED, DOUBTFUL, HEADER, LINKS)
    apart = inherited(nodes, lambda n: AGAINST if (n.drop == ARTICLE_NAMED or n.drop in parts and n.holds == 2) and 2 * held[n.number] < held[0] else 1.0)
    within = sum(held[n.number] for n in nodes if n.tag in ("article", "main") and not marked[n.up.number])
    beside = BESIDE if 2 * within >= held[0] > 0 else 1.0
    least = [min(x, y) for x, y in zip(out, apart, strict=True)]
    return [x * (1.0 if m else beside) for x, m in zip(least, marked, strict=True)], [x == 1.0 for x in least]


def titles(nodes: list[Node], found: list[Block], free: list[bool]) -> list[bool]:
    """Whether each block is the title of a page without article or main element that stands in a header: its only h1 that is no link."""
    h1 = [node.tag == "h1" and linked < len(text) for node, text, linked in found]
    if sum(h1) != 1 or nodes[0].holds == 2:
        return [False] * len(found)
    barred = inherited(nodes, lambda n: 0.0 if n.drop in (EXCLUDED, NAMED, LINKS) else 1.0)
    return [h and not free[node.number] and barred[node.number] > 0 for (node, _, _), h in zip(found, h1, strict=True)]


def ratios(found: list[Block], nodes: list[Node]) -> dict[int, float]:
    """Fused, smoothed ratio of each path: text length per block by punctuation per block."""
    sums: dict[int, list[float]] = {}
    above = {}
    for node, text, linked in found:
        s = sums.setdefault(node.path, [0, 0, 0])
        s[0] += 1
        s[1] += max(0, len(text) - linked)
        s[2] += len(PUNCTUATION.findall(text))
        above[node.path] = node.up.path if node.up else -1
    raw = {p: (length / n, marks / n) for p, (n, length, marks) in sums.items()}
    near: dict[int, tuple[int, float, float]] = {}
    for p, (a, b) in raw.items():
        n, total_a, total_b = near.get(above[p], (0, 0.0, 0.0))
        near[above[p]] = (n + 1, total_a + a, total_b + b)
    out = {}
    for p, (a, b) in raw.items():
        n, total_a, total_b = near[above[p]]
        if n > 1:  # siblings in the tree of paths: half the weight of the path itself, together
            a, b = (2 * a + (total_a - a) / (n - 1)) / 3, (2 * b + (total_b - b) / (n - 1)) / 3
        out[p] = a * (b + 0.1)
    return out


def chosen(found: list[Block], fused: dict[int, float], prior: list[float]) -> list[bool]:
    """Whether each block's path, with its prior, reaches the threshold."""
    values = [fused[node.path] * prior[node.number] for node, _, _ in found]
    by_path = {(node.path, prior[node.number]): v for (node, _, _), v in zip(found, values, strict=True)}
    mean = sum(by_path.values()) / len(by_path)
    spread = (sum((v - mean) ** 2 for v in by_path.values()) / len(by_path)) ** 0.5
    return [v >= min(mean, spread) for v in values]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines."""
    if not page:
        return ""
    nodes, found = blocks_of(page)
    prior, open_to = priors(nodes, found, True)
    if not any(prior[node.number] > AGAINST for node, _, _ in found):
        prior, open_to = priors(nodes, found, False)
        if not any(prior[node.number] > AGAINST for node, _, _ in found):
            return ""
    content = chosen(found, ratios(found, nodes), prior)
    free = [open_to[node.number] for node, _, _ in found]
    title = titles(nodes, found, open_to)
    heads = [ok and node.tag in HEADINGS for (node, _, _), ok in zip(found, free, strict=True)]
    around = [c or h for c, h in zip(content, heads, strict=True)]
    article = common_ancestor(nodes, found, around if any(around) else free)
    inside = [False] * len(nodes)
    for n in nodes:
        inside[n.number] = n is article or n.up is not None and inside[n.up.number]
    return "\n".join(text for (node, text, _), c, h, t, ok in zip(found, content, heads, title, free, strict=True) if c or h or t or ok and inside[node.number])


def common_ancestor(nodes: list[Node], found: list[Block], wanted: list[bool]) -> Node:
    """The lowest node that holds all wanted blocks, above a single paragraph or heading."""
    held = summed(nodes, found, [float(w) for w in wanted])
    low = max((n for n in nodes if held[n.number] == held[0]), key=lambda n: n.number)
    while low.tag in HEADINGS | {"p", "li", "td", "blockquote", "pre"} and low.up and low.up.tag:
        low = low.up
    return low


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text in place of its html column (and of any column named as the output)."""
    keep = [c for c in pages.columns if c not in (html, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, html, 4 << 20):
            texts = pa.array([main_text(x.as_py()) for x in batch.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, text])

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(text, T.StringType())])
    return pages.select(*keep, html).mapInArrow(run, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Edge cases: see the module."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op10_html": op10_html}
ORACLE: dict[str, str] = {}
