"""Main text of web pages by site style trees (operator 5).

Pages of one host are merged into a style tree: a node is the path of elements (tag and class) from the
root. For each node the tree counts in how many pages each text below it occurs, and how often each
sequence of child styles. From these:

* content importance is 1 minus the mean of log(pages of a text) / log(pages of the host): texts that all
  pages repeat give 0, texts of one page only give 1;
* presentation importance is the entropy of child sequences, by the logarithm of the pages;
* a node with l children has (1 - g^l) * presentation + g^l * content.

A branch of low importance is removed from each page of its host. A site of few pages tells nothing that
way, and menus or adverts may differ on each page, so roles that markup states itself (nav, footer, form,
class "ad" and the like, listed below) are removed as well, and where a page marks an article or main part,
text outside it goes and all text inside it stays, whatever the tree says: headings that a host's articles
share are text. Of several articles that don't hold each other the longest is the page's, the first among equals;
the others are teasers. A role is a class name or id of its own, or the last part of one with hyphens
("site-header", but not "has-sidebar" or "tag-notice"), or the first where that can only be one ("comment-list"); on
an article or main part whole names count only. Inline elements have roles too: their text goes, the rest of the
block stays. Should the tree remove all of a page's text (hosts that repeat one page), it is ignored for that page.

Only sums by host, node and text are shuffled. Nodes to remove go to all tasks where there are fewer than
``most_broadcast``; more are joined to the pages by host.

Defined cases: null html is empty and gives an empty text; a null url is a host of its own; broken and
unclosed markup is read as browsers do in the main (implied ends of p, li and the like; an unclosed
comment, script or style reaches the end); repeated pages are each reported; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .packing import record

# Element names of HTML by how they are laid out, and words by which markup states a role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|title|select|audio|video|xmp|noembed|noframes"
DROPPED_TAGS = frozenset("nav footer aside form button head dialog menu select option datalist fieldset input search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tooltip".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner menu nav navbar navigation navigator topnav subnav breadcrumb breadcrumbs "
    "sidebar sidebars aside rail footer foot colophon header masthead topbar cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay dialog newsletter subscribe "
    "subscription signup login register share sharing social comment comments commentlist reply replies respond disqus discussion related recommended recommendations widget widgets toolbar pagination "
    "pager paging search searchbox form tags tagcloud copyright skip paywall hidden".split()
)
#: First parts of names that qualify the rest, and first parts that name a role whatever follows.
_QUALIFIERS = frozenset("has no not with without is hide show category tag post status format type page".split())
_ROLE_FIRST = frozenset("ad ads advert advertisement sponsor sponsored comment comments reply breadcrumb breadcrumbs cookie cookies newsletter nav navbar menu sidebar footer share sharing social related".split())
_HEADERS = frozenset("header masthead topbar banner".split())
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_GAMMA = 0.9
#: Levels of a style tree.
DEPTH = 64


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Block:
    __slots__ = ("article", "dropped", "main", "node", "text")

    def __init__(self, node: int, text: str, dropped: bool, main: bool, article: int):
        self.node, self.text, self.dropped, self.main, self.article = node, text, dropped, main, article


class Tree:
    """The style tree of a page: for each node its parent, its key (a hash of its path) and child sequences.

    Elements nested deeper than ``DEPTH`` belong to the node of their ancestor at that depth, so that a page's
    work grows with its length alone.
    """

    def __init__(self):
        self.parent, self.key, self.depth = [-1], [0], [0]
        self.below: dict[tuple[int, str], int] = {}
        self.shapes: Counter = Counter()

    def child(self, node: int, style: str) -> int:
        if self.depth[node] == DEPTH:
            return node
        known = self.below.get((node, style))
        if known is None:
            known = self.below[node, style] = len(self.parent)
            self.parent.append(node)
            self.key.append(_hash(f"{self.key[node]}/{style}"))
            self.depth.append(self.depth[node] + 1)
        return known

    def branch(self, node: int) -> Iterator[int]:
        """The node and those above it, without the root."""
        while node > 0:
            yield node
            node = self.parent[node]


def _roles(names: set[str]) -> set[str]:
    """The words of these names that state a role to drop."""
    out = names & DROPPED_WORDS
    for name in names:
        parts = re.split(r"[-_]+", name)
        if len(parts) > 1 and parts[0] not in _QUALIFIERS:
            out |= {parts[-1]} & DROPPED_WORDS | {parts[0]} & _ROLE_FIRST
    return out


def _inline_role(attrs: str) -> bool:
    """Whether an inline element states a role to drop."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
    return hidden or found.get("role", "") in DROPPED_ROLES or bool(_roles(set(f"{found.get('class', '')} {found.get('id', '')}".split())))


def _style(tag: str, attrs: str, in_main: bool) -> tuple[str, bool, bool]:
    """The node's name in the tree, whether markup states a role to drop, whether it is the main part."""
    if not attrs or attrs.isspace():
        return tag, tag in DROPPED_TAGS or (tag == "header" and not in_main), tag in ("article", "main")
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    role, names = found.get("role", ""), set(f"{found.get('class', '')} {found.get('id', '')}".split())
    if tag in ("html", "body"):
        return tag, False, False
    bad = names & DROPPED_WORDS if tag in ("article", "main") else _roles(names)
    if in_main or tag in ("article", "main"):
        bad -= _HEADERS
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    drop = tag in DROPPED_TAGS or role in DROPPED_ROLES or bool(bad) or hidden or (tag == "header" and not in_main)
    return f"{tag}.{'.'.join(sorted(found.get('class', '').split()))}", drop, not drop and (tag in ("article", "main") or role == "main")


def parse(page: str) -> tuple[list[Block], Tree]:
    """Text blocks in page order, and the page's style tree."""
    blocks: list[Block] = []
    tree = Tree()
    stack: list[list] = [["", 0, False, False, [], 0]]  # tag, node, dropped, main, child styles, article
    articles = 0
    muted: list | None = None  # an inline element whose text goes: its tag, how often it is open, the stack's height
    opened: Counter = Counter()
    text: list[str] = []

    def flush() -> None:
        if text:
            own = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if own:
                blocks.append(Block(stack[-1][1], own, stack[-1][2], stack[-1][3], stack[-1][5]))

    def close(upto: int) -> None:
        while len(stack) > upto:
            tag, node, _, _, children, _ = stack.pop()
            opened[tag] -= 1
            if children:
                tree.shapes[node, tuple(children)] += 1

    def close_last(tag: str) -> None:
        close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))

    at = 0
    for m in _MARKUP.finditer(page):
        if muted and len(stack) < muted[2]:
            muted = None  # it ends with the block that it is in
        if m.start() > at and not muted:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in ("object", "svg", "math", "canvas"):
                flush()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if muted:
                muted[1] += (tag == muted[0]) * (-1 if m["end"] else 1)
                if not muted[1]:
                    muted = None
            elif not m["end"] and m["attrs"] and tag != "wbr" and _inline_role(m["attrs"]):
                muted = [tag, 1, len(stack)]
            continue
        if tag == "br":
            if not muted:
                text.append(" ")
            continue
        flush()
        if m["end"]:
            if opened[tag]:
                close_last(tag)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and any(s[0] == "p" for s in stack[-3:]):
            close_last("p")
        elif tag in ("li", "option", "dt", "dd", "tr", "td", "th") and stack[-1][0] in (("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)):
            close(len(stack) - 1)
        style, drop, main = _style(tag, m["attrs"], stack[-1][3])
        if not stack[-1][4] or stack[-1][4][-1] != style:
            stack[-1][4].append(style)
        article = stack[-1][5]
        if tag == "article" and not drop and not article:
            articles = article = articles + 1
        stack.append([tag, tree.child(stack[-1][1], style), stack[-1][2] or drop, stack[-1][3] or main, [], article])
        opened[tag] += 1
    if at < len(page) and not (muted and len(stack) >= muted[2]):
        text.append(page[at:])
    flush()
    close(1)
    return blocks, tree


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and node: pages of each text below it, times of each child sequence; host totals at node 0."""
    for batch in (p for b in batches for p in words.chunks(b, "html")):
        sums: Counter = Counter()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            sums[host, 0, 2, 0, 0] += 1
            blocks, tree = parse(page or "")
            seen = set()
            for b in blocks:
                if not b.dropped:
                    own = _hash(b.text)
                    for node in tree.branch(b.node):
                        if (node, own) in seen:
                            break
                        seen.add((node, own))
            for node, own in seen:
                sums[host, tree.key[node], 0, own, 0] += 1
            for (node, children), n in tree.shapes.items():
                sums[host, tree.key[node], 1, _hash(" ".join(children)), len(children)] += n
        host, node, kind, feature, size = zip(*sums) if sums else [()] * 5
        yield record(host=(host, pa.string()), node=(node, pa.int64()), kind=(kind, pa.int32()), feature=(feature, pa.int64()), size=(size, pa.int32()), n=(list(sums.values()), pa.int64()))


def low_importance(pages: DataFrame, threshold: float = 0.2, least_pages: int = 2) -> DataFrame:
    """Rows ``host, node`` to remove; ``pages`` has ``host, html``."""
    counts = pages.mapInArrow(_tally, "host string, node long, kind int, feature long, size int, n long").groupBy("host", "node", "kind", "feature", "size").agg(F.sum("n").alias("n"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    n = F.col("n").cast("double")
    nodes = counts.groupBy("host", "node").agg(
        of(0, F.lit(1)).alias("texts"), of(0, F.log(n)).alias("text_logs"), of(1, n).alias("times"), of(1, n * F.log(n)).alias("time_logs"), of(1, n * F.col("size")).alias("children"), of(2, F.col("n")).alias("pages")
    )
    total = nodes.where("node = 0").select(F.col("host").alias("h"), F.log(F.col("pages").cast("double")).alias("log_pages"), F.col("pages").alias("all_pages")).where(F.col("all_pages") >= least_pages)
    joined = nodes.where("node != 0 and texts is not null").join(total, F.col("host").eqNullSafe(F.col("h")))
    content = 1 - F.col("text_logs") / F.col("texts") / F.col("log_pages")
    shown = F.coalesce((F.log("times") - F.col("time_logs") / F.col("times")) / F.col("log_pages"), F.lit(0.0))
    weight = F.pow(F.lit(_GAMMA), F.coalesce(F.col("children") / F.col("times"), F.lit(0.0)))
    return joined.where((1 - weight) * shown + weight * content < threshold).select("host", "node")


def main_text(page: str | None, remove: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of a page without dropped roles and without the nodes of ``remove``."""
    if not page:
        return ""
    blocks, tree = parse(page)
    blocks = [b for b in blocks if not b.dropped]
    if any(b.main for b in blocks):
        sizes: Counter = Counter()
        for b in blocks:
            if b.article:
                sizes[b.article] += len(b.text)
        own = min(sizes, key=lambda a: (-sizes[a], a), default=0)
        return " ".join(b.text for b in blocks if b.main and b.article in (0, own))
    if remove and blocks:
        gone = [False] * len(tree.parent)
        for node in range(1, len(gone)):  # parents come before their children
            gone[node] = gone[tree.parent[node]] or tree.key[node] in remove
        blocks = [b for b in blocks if not gone[b.node]] or blocks
    return " ".join(b.text for b in blocks)


def extract(pages: DataFrame, *, threshold: float = 0.2, least_pages: int = 2, most_broadcast: int = 500_000, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows ``id, url, text`` for every page."""
    common.bounded_batches(pages)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.col(html).cast("string").alias("html"))
    low = common.cut(low_importance(rows.select("host", "html"), threshold, least_pages))
    few = low.count() <= most_broadcast
    remove: dict[str, set[int]] = {}
    if few:
        for h, node in zip(*low.toArrow().to_pydict().values()):
            remove.setdefault(h, set()).add(node)
    else:
        rows = rows.join(low.groupBy("host").agg(F.collect_list("node").alias("nodes")), "host", "left")
    shared = pages.sparkSession.sparkContext.broadcast(remove)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = shared.value
        for batch in (p for b in batches for p in words.chunks(b, "html")):
            own = [nodes.get(h, frozenset()) for h in batch.column("host").to_pylist()] if few else [set(n or ()) for n in batch.column("nodes").to_pylist()]
            texts = [main_text(p.as_py(), r) for p, r in zip(batch.column("html"), own)]
            yield record(id=(batch.column("id"), pa.int64()), url=(batch.column("url"), pa.string()), text=(texts, pa.string()))

    return rows.mapInArrow(run, "id long, url string, text string")


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``."""
    rows = extract(common.table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The same for pages whose article is marked and holds paragraphs and headings only, as in the test tables.
OP5_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(h1|p)>', chr(1), 'g'), '<br>', ' ', 'g') AS t FROM pages),
u AS (SELECT page_id, url, replace(regexp_replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', chr(2), 'g'), chr(2), '&') AS t FROM a),
b AS (SELECT page_id, url, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM u)
SELECT page_id, url, array_to_string(l, ' ') AS text, length(array_to_string(l, ' '))::BIGINT AS n_chars FROM b"""
