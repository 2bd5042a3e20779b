"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import unused

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
DROP = frozenset(
    "head script style noscript template iframe textarea title xmp nav footer aside form svg canvas object audio video "
    "map math button select option input label fieldset dialog menu".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends.
ENDS = {
    **dict.fromkeys(BLOCK - {"td", "th", "tr", "li", "dd", "dt", "body", "html"}, ("p",)),
    "li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"),
}
#: Where looking for what to end stops.
SCOPE = frozenset("html body table ul ol dl div article section main aside blockquote form nav header footer td th".split())
#: Words of class, id or role that mark a part as no main text.
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs combx comment comments commentary cookie cookies "
    "consent disqus disclaimer dialog dropdown footer footnav form gdpr header login masthead menu menus modal nav navbar navigation navigationbar newsletter "
    "notice notices notification overlay pager pagination popup promo promotion promotions reactions related replies reply respond rss share sharing "
    "shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar tooltip widget widgets complementary contentinfo "
    "search alert alerts alertdialog status".split()
)
TOWARDS = frozenset("article body content entry hentry main page post text blog story articlebody".split())
#: Words beside "header" by which a part is the head of an article.
TITLED = frozenset("article entry hentry post story".split())
#: What points count of within a part that is marked as no main text and yet holds it.
LOWERED = 0.2
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "score", "dropped", "lowered")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.score = 0.0
        self.dropped = False
        self.lowered = False


def parse(source: str) -> Node:
    """A tree of elements and text; markup that is cut off or unbalanced ends where its parent does."""
    root = Node("html", None, {})
    at, node, position, size = root, None, 0, len(source)
    while position < size:
        found = TAG.search(source, position)
        end = found.start() if found else size
        if end > position:
            at.children.append(entities.unescape(source[position:end]))
        if not found:
            break
        position, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        for closed in ENDS.get(tag, ()):
            node = at
            while node.parent is not None and node.tag != closed and (node.tag not in SCOPE or node.tag == closed):
                node = node.parent
            if node.tag == closed and node.parent is not None:
                at = node.parent
        rest = found[3]
        attributes = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest else {}
        if tag in ("html", "body") and at is root:
            continue
        node = Node(tag, at, attributes)
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, position)
            position = close.end() if close else size
        elif tag not in VOID and not rest.endswith("/"):
            at = node
    return root


def _marks(node: Node) -> set[str]:
    a = node.attributes
    return {w.lower() for w in WORDS.findall(" ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""))))} if a else set()


def _unwanted(node: Node, inside: bool) -> bool:
    """By tag or because it is hidden. inside: within an article."""
    a = node.attributes
    if node.tag in DROP or (node.tag == "header" and not inside):
        return True
    if not a or node.tag in ("article", "main") or node.tag in HEADING:
        return False
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "")))


def _away(node: Node) -> set[str]:
    """The words that mark ``node`` as no main text."""
    if not node.attributes or node.tag in ("article", "main") or node.tag in HEADING:
        return set()
    marks = _marks(node)
    return set() if marks & {"articlebody", "article"} else marks & AWAY


def _main_parts(root: Node) -> set[int]:
    """Ids of the nodes that hold an article or main element, or most of the page's text in paragraphs."""
    order, stack = [], [(root, root.tag == "p")]
    while stack:
        n, within = stack.pop()
        order.append((n, within))
        stack.extend((c, within or c.tag == "p") for c in n.children if not isinstance(c, str) and not _unwanted(c, True))
    length, holds = {}, set()
    for n, within in reversed(order):  # children come before their parents
        total = length.get(id(n), 0) + (sum(len(c.strip()) for c in n.children if isinstance(c, str)) if within else 0)
        length[id(n)] = total
        if n.parent is not None:
            length[id(n.parent)] = length.get(id(n.parent), 0) + total
            if id(n) in holds or (n.tag in ("article", "main") and not (_marks(n) & AWAY)):
                holds.add(id(n.parent))
    return holds | {i for i, total in length.items() if 2 * total > length[id(root)]}


def _headings(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.tag in HEADING:
            out.append(n)
        else:
            stack.extend(c for c in reversed(n.children) if not isinstance(c, str) and not _unwanted(c, True))
    return out


def _sweep(root: Node) -> None:
    stack, main_parts = [(root, False)], None
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag == "article"
        kept = []
        for c in node.children:
            if isinstance(c, str):
                kept.append(c)
                continue
            if _unwanted(c, inside):
                continue
            c.lowered = node.lowered and c.tag not in ("article", "main")
            if away := _away(c):
                if main_parts is None and not inside:
                    main_parts = _main_parts(root)
                if not inside and id(c) in main_parts:
                    c.lowered = True
                elif away == {"header"} and (inside or _marks(c) & TITLED):
                    for h in _headings(c):
                        h.parent, h.lowered = node, node.lowered
                        kept.append(h)
                        stack.append((h, inside))
                    continue
                else:
                    continue
            kept.append(c)
            stack.append((c, inside))
        node.children = [c for c in kept if not isinstance(c, str) and c.tag in HEADING] if node.tag == "header" else kept


def blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, length of link text) in page order."""
    out: list[tuple[Node, str, int]] = []
    buffer: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            out.append((owner, text, linked))
        buffer.clear()
        linked = 0

    # (node, its block, in a link, next child)
    stack = [[node, node, False, 0]]
    while stack:
        top = stack[-1]
        n, owner, link, i = top
        if i == len(n.children):
            stack.pop()
            if n is owner:
                flush(owner)
            continue
        top[3] += 1
        child = n.children[i]
        if isinstance(child, str):
            buffer.append(child)
            linked += len(child.strip()) if link else 0
        elif child.tag in ("br", "hr"):
            buffer.append(" ")
        elif child.tag in BLOCK:
            flush(owner)
            stack.append([child, child, link, 0])
        else:
            stack.append([child, owner, link or child.tag == "a", 0])
    return out


def _whole(best: Node) -> Node:
    """The article, or else main element, that holds ``best``."""
    article, node = None, best
    while node is not None:
        if node.tag == "article" or node.attributes.get("itemprop") == "articleBody":
            return node
        if node.tag == "main" or node.attributes.get("role") == "main":
            article = article or node
        node = node.parent
    return article or best


def main_text(source: str | None) -> str:
    """Blocks of the best container and its good siblings, joined by line feeds; empty if there is none.

    Each block passes points for itself, its length and its commas to its
    parent, half to the next ancestor and less to the further ones. A
    container's points are cut by the share of link text in it. A container
    within an article stands for the whole article. Siblings count with a
    fifth of the best points, or if they are headings before it. Parts whose
    class, id or role marks them as no main text are left out; if they hold an
    article or main element, or most of the text in paragraphs, their points
    are lowered instead.
    """
    root = parse(source or "")
    _sweep(root)
    found = blocks(root)
    if not found:
        return ""
    total: dict[int, list] = {}
    for owner, text, linked in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        points *= LOWERED if owner.lowered else 1
        node, depth = (owner.parent if owner.parent is not None and owner.tag in ("p", "pre", "li", "td", *HEADING) else owner), 0
        up = owner
        while up is not None:
            entry = total.setdefault(id(up), [up, 0, 0])
            entry[1] += len(text)
            entry[2] += linked
            up = up.parent
        while node is not None:
            node.score += points / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
            node, depth = node.parent, depth + 1
    best, most = root, -1.0
    for node, length, linked in total.values():
        if node.score:
            bonus = 25 * (node.tag in ("article", "main")) + 10 * bool(_marks(node) & TOWARDS)
            node.score = (node.score + bonus) * (1 - min(1, linked / max(1, length)))
            if node.score > most:
                best, most = node, node.score
    best = _whole(best)
    parts, siblings = [best], best.parent.children if best.parent is not None and best.tag not in ("article", "main") else []
    if siblings:
        parts, before = [], True
        for s in siblings:
            if isinstance(s, str):
                continue
            if s is best:
                before = False
                parts.append(s)
            elif s.lowered and not best.lowered:
                continue
            elif s.score >= max(10 * (LOWERED if best.lowered else 1), most / 5) or (before and s.tag in HEADING) or s.tag == "p":
                parts.append(s)
    chosen = set(map(id, parts))

    def within(node: Node | None) -> bool:
        while node is not None:
            if id(node) in chosen:
                return True
            node = node.parent
        return False

    return "\n".join(text for owner, text, _ in found if within(owner))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) added; columns of those names are replaced.

    Null and empty pages have empty text. Pages are independent, so repeated
    rows give repeated results, and an empty table stays empty. The whole page
    is read, however long. Among containers with equal points the first counts.
    """

    @F.pandas_udf("text string, n_chars long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            texts = [main_text(s) for s in sources]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    got = unused(pages, "x")
    out = pages.withColumn(got, run(F.col(html)))
    return out.select(*kept, F.col(got)["text"].alias("text"), F.col(got)["n_chars"].alias("n_chars"))


def op9_tree_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
