"""Main text of web pages with site style trees.

The DOMs of a host's pages are merged: pages that have an element at the same
path (tags with their classes and ids, digits masked) share a node.  A node
keeps how many pages show it, and the distribution of its presentation (the
sequence of child elements) and of its content (the text below it).  Its
importance is the larger of the two entropies, scaled to 0..1 by the logarithm
of the number of pages: what is the same on every page is noise, what differs
is content.  From each page the branches of low importance are removed, as are
elements that say themselves what they are (navigation, forms, adverts, ...).

What an element says of itself does not count where it holds the article: an
<article> or <main> that is not itself such an element, or most of the page's
text (a sidebar layout, a form around the page).  Navigation, asides and the
like (``SHELL_TAGS``, ``DROP_ROLES``) hold the article only if no <article> or
<main> is outside of them.  There the entropies decide, and elements further
inside are judged on their own.

Defined cases: null or empty html has empty text; a page without a host (null
or relative url) and nodes on fewer than ``MIN_PAGES`` pages are judged by
their tags alone; if low importance would empty a page (all pages of a host
alike), it is judged by tags alone too; if the tags empty a page that shows
text, it is judged by importance alone, and all it shows is kept if that
empties it as well; hidden text is never kept; broken markup is read leniently
(unclosed and stray tags, unterminated comments); repeated rows count as pages;
other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_rows, with_columns

MIN_PAGES = 4
MIN_IMPORTANCE = 0.3
BROADCAST_ROWS = 200_000  # hosts with noise nodes that are sent to all tasks; beyond, a join
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>", re.S
)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "xmp", "iframe", "noembed", "noframes", "template")}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div nav".split())
# Elements, roles and names that are not the article.
HIDDEN_TAGS = frozenset("title noscript script style iframe template svg select textarea xmp noembed noframes".split())
SHELL_TAGS = frozenset("nav footer aside menu dialog".split())
DROP_TAGS = frozenset("head form canvas object button fieldset audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|topbar|sidebar|side|footer|masthead|breadcrumbs?|cookies?|consent|gdpr|"
    r"notice|notification|popup|modal|newsletter|subscribe|subscription|signup|comments?|commentlist|respond|replies|disqus|social|share|sharing|related|recommended|widget|login|search|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
# Names of what an element has or lacks ("with-sidebar"): not what it is.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:with|without|no|has)[_-]\S*", re.I)
DROP_UNLESS_ARTICLE = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)


# Why an element may be dropped: it says so by its name or tag, it is part of
# the page's shell, or it is not shown.
NAMED, SHELL, HIDDEN = 1, 2, 3


class _Node:
    __slots__ = ("tag", "key", "up", "rule", "hidden", "drop", "first", "last", "style", "inside", "articles")

    def __init__(self, tag, key, up, rule, first, inside):
        self.tag, self.key, self.up, self.rule, self.first, self.last, self.style, self.inside = tag, key, up, rule, first, None, [], inside
        self.hidden = rule == HIDDEN or (up is not None and up.hidden)
        self.drop, self.articles = self.hidden, 0  # articles: <article> and <main> elements with text below


def _key(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, seed=parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _open(parent: _Node, tag: str, attrs: str, at: int) -> _Node:
    got = {m.group(1).lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
    names = f"{got.get('class', '')} {got.get('id', '')}"
    said = _LAYOUT.sub("", names) if names.strip() and tag not in ("html", "body") else ""
    if tag in HIDDEN_TAGS or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
        rule = HIDDEN
    elif tag in SHELL_TAGS or got.get("role", "").strip().lower() in DROP_ROLES or (tag == "header" and not parent.inside):
        rule = SHELL
    elif tag in DROP_TAGS or DROP_NAMES.search(said) or (not parent.inside and DROP_UNLESS_ARTICLE.search(said)):
        rule = NAMED
    else:
        rule = 0
    name = tag + "".join("." + c for c in sorted(re.sub(r"\d+", "0", got.get("class", "")).split())) + "#" + re.sub(r"\d+", "0", got.get("id", ""))
    parent.style.append(tag)
    return _Node(tag, _key(parent.key, name), parent, rule, at, parent.inside or tag in ("article", "main"))


def parse(page: str | None) -> tuple[list[str], list[tuple[_Node, ...]], list[_Node]]:
    """Text blocks in page order, the chain of nodes above each, all nodes."""
    root = _Node("", 0, None, 0, 0, False)
    stack, nodes, blocks, chains, now = [root], [root], [], [], []

    def flush():
        text = " ".join(html_lib.unescape("".join(now)).split())
        now.clear()
        if text:
            blocks.append(text)
            chains.append(tuple(stack))

    def pop(n):
        while len(stack) > n:
            node = stack.pop()
            node.last = len(blocks)
            if node.up and not node.hidden:
                node.up.articles += node.articles + (node.tag in ("article", "main") and not node.rule and node.last > node.first)

    page, at = page or "", 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            now.append(page[at:])
            break
        now.append(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag or (tag in INLINE and tag not in VOID):
            continue
        if tag in ("img", "input", "wbr"):
            continue
        if tag in _RAW_END:  # not shown, so it does not end a block
            at = at if m.group(1) else _RAW_END[tag].search(page, at).end()
            continue
        flush()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            pop(len(stack) - 1)
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in SELF_CLOSING.get(tag, ()):
                pop(i)
                break
            if stack[i].tag in SCOPES:
                break
        if tag in VOID:
            continue
        if m.group(3).endswith("/") and tag in ("svg", "path", "g"):
            continue
        node = _open(stack[-1], tag, m.group(3), len(blocks))
        stack.append(node)
        nodes.append(node)
    flush()
    pop(0)
    return blocks, chains, nodes


def judge(blocks: list[str], chains: list[tuple[_Node, ...]], nodes: list[_Node]) -> None:
    """Sets ``drop`` of the nodes of a page by what they say of themselves and
    by what they hold."""
    held = [0]  # characters before each block that count as the page's text
    for b, c in zip(blocks, chains):
        held.append(held[-1] + (0 if c[-1].hidden else len(b)))
    for rule in (SHELL, NAMED):
        for n in nodes[1:]:
            own = False
            if n.rule == rule and not n.up.drop:
                most = 2 * (held[n.last] - held[n.first]) > held[-1]
                own = n.tag not in ("article", "main") and not n.articles and not most
                if rule == SHELL:
                    own = nodes[0].articles > n.articles or not (n.articles or most)
            n.drop = n.drop or n.up.drop or own
        if rule == SHELL:
            for i, c in enumerate(chains):
                held[i + 1] = held[i] + (0 if c[-1].drop else len(blocks[i]))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _contents(blocks: list[str], nodes: list[_Node]) -> dict[int, tuple[int, int]]:
    """{node key: (hash of its presentation, hash of its content)}; elements of
    one page at the same path are taken together."""
    n = len(blocks) + 1
    with np.errstate(over="ignore"):
        power = np.full(n + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        prefix = np.zeros(n, dtype=np.uint64)
        for i, b in enumerate(blocks):
            prefix[i + 1] = prefix[i] * _BASE + np.uint64(xxhash.xxh64_intdigest(b))
        out: dict[int, tuple[int, int]] = {}
        for node in nodes:
            text = int(prefix[node.last] - prefix[node.first] * power[node.last - node.first])
            style = xxhash.xxh64_intdigest(" ".join(node.style))
            a, b = out.get(node.key, (0, 0))
            out[node.key] = ((a * 31 + style) % (1 << 64), (b * 31 + text + 1) % (1 << 64))
    return {k: (a - (1 << 63), b - (1 << 63)) for k, (a, b) in out.items()}


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return pages.withColumn("_host", F.when(host != "", host))


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged trees of ``pages`` (url, html): (host, node, pages,
    importance), one row for each node of a host."""

    def run(batches):
        for b in batches:
            out: dict = {"host": [], "node": [], "style": [], "content": []}
            for host, page in zip(b.column("_host").to_pylist(), b.column("html").to_pylist()):
                blocks, _, nodes = parse(page)
                for k, (style, content) in _contents(blocks, nodes).items():
                    for col, v in zip(out.values(), (host, k, style, content)):
                        col.append(v)
            yield out

    rows = with_host(pages.select("url", "html")).where("_host is not null").select("_host", "html")
    seen = map_rows(rows, "host string, node long, style long, content long", run)
    one = seen.groupBy("host", "node", "style", "content").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for c in ("style", "content"):  # a node's entropy over the values of c
        n = one.groupBy("host", "node", c).agg(F.sum("n").alias("n"))
        parts.append(n.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s")).withColumn("h", F.log("pages") - F.col("s") / F.col("pages")))
    a, b = (p.select("host", "node", "pages", F.col("h").alias(f"h{i}")) for i, p in enumerate(parts))
    both = a.join(b.drop("pages"), ["host", "node"])
    scaled = F.when(F.col("pages") > 1, F.greatest("h0", "h1") / F.log("pages")).otherwise(1.0)
    return both.select("host", "node", "pages", scaled.alias("importance"))


def noise(tree: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(_host, _noise): the nodes of low importance of each host."""
    low = tree.where((F.col("pages") >= min_pages) & (F.col("importance") < min_importance))
    return low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("node").alias("_noise"))


def extract(pages: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """``pages`` (url, html) with text and n_chars."""
    low = noise(tree if tree is not None else style_tree(pages)).persist()
    few = low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = with_host(pages).join(F.broadcast(low) if few else low, "_host", "left")

    def run(htmls, noises):
        texts = []
        for page, low in zip(htmls, noises):
            low = set(low or ())
            blocks, chains, nodes = parse(page)
            judge(blocks, chains, nodes)
            shown = [(b, c) for b, c in zip(blocks, chains) if not c[-1].hidden]
            by_tag = [(b, c) for b, c in shown if not c[-1].drop] or shown
            kept = [b for b, c in by_tag if not any(x.key in low for x in c[1:])]
            texts.append(" ".join(kept or [b for b, _ in by_tag]))
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return with_columns(rows, ["html", "_noise"], "text string, n_chars long", run).drop("_host", "_noise")


def op7_extract(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
