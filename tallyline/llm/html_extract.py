"""Main text of web pages by a site style tree.

Pages of one host are merged into a style tree: an element node for every path of tags
and classes, with the pages that have it, the child sequences (styles) it has there and
the texts it holds there. Over the m pages that have an element,

    presentation   the entropy of its styles: 1 where every page differs, 0 where all agree
    content        1 less the mean, over the texts in it, of the entropy of the pages that a
                   text is spread over: 0 where every page says the same, 1 where none does
    importance     1 - (1 - the greater of the two) (1 - 1 / m): one page says nothing of
                   what repeats, and the more pages do, the surer

with entropies relative to log m. The composite importance of an element without inner
elements is its own; one with l styles has

    (1 - 0.9^l) own + 0.9^l (mean of its children's, by the pages that have them)

An element is noise, and goes from each page, if its composite importance and those of
all below it are low: that is what a site repeats.

Entropy alone can't tell a menu that changes from page to page from an article. So there
is a prior, by an element's kind: what never holds an article's text (menus, headers,
footers, sidebars, forms, adverts, notices, comments, scripts ...), by tag, role or class,
has importance 0 whatever its entropy, and where a page marks its article, the text
directly in it stays, however often the site repeats it. A class or id counts by its head
word (``cookie-notice`` is a notice, ``search-results`` are results, ``has-sidebar`` says
nothing of its element), and an element that holds the article never goes by its name.

The tree is never built in one place. A page's nodes become rows of (host, path, hash),
counted by shuffled aggregation, and the recursion over a branch is a sum over its paths:
a path's weight in an ancestor's composite importance is the product of the factors on
the way. A host with a third of all pages is as many counters as any other. Exact copies
of a page count once.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: Elements below this importance are removed. What every page of a host repeats falls below it from five pages on.
THRESHOLD = 0.25
#: The attenuation of children by the styles of their parent.
GAMMA = 0.9
#: Hosts with one page of so many are spread over SALTS parts where pages meet their host's noise.
HEAVY_HOSTS, SALTS = 512, 256
#: The style tree has so many levels: elements below share the path of the one above them there. Pages have any depth.
PATH_DEPTH = 300

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
NEVER = frozenset(
    "script style head title noscript template textarea iframe object canvas svg math nav header footer aside menu form button select option datalist dialog audio video map".split()
)
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | NEVER
INLINE_SPACE = frozenset(("br", "hr", "wbr"))
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"} | {"hr"}
#: An open element that the start of one of these ends, within the nearest of the given containers.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Words of class, id or role that name what isn't article text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar rail aside complementary contentinfo "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup comment comments disqus respond reply replies share sharing social related recommended pagination pager widget toolbar search login".split()
)
ARTICLE_ROLES = frozenset(("main", "article"))
#: What has these names holds other articles than the page's, where the page has one outside.
TALK = frozenset("comment comments reply replies respond disqus related recommended".split())
REPLIES = frozenset(("comment", "comments", "reply", "replies"))
#: Words that follow the head word of a class or id.
HOLDERS = frozenset("area bar block body box button buttons container form icon icons inner item items link links list outer panel section slot text unit wrap wrapper posts articles stories".split())
#: Words before a name that make it say what an element has or lacks, not what it is.
STATES = frozenset("after before has have hide is js no not show with without".split())
#: A form with one of these around it is the whole page.
LANDMARKS = frozenset(("h1", "nav", "footer"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


class Node:
    """An element. Its kind is never, article or plain; what stands in a "never" is one too.

    While a page is parsed, kind may also be named or talk: a "never" by its name alone, that
    _settle decides on when it is known what stands in it.
    """

    __slots__ = ("children", "depth", "holds", "inner", "kind", "name", "parent", "path", "tag")

    def __init__(self, tag: str, name: str, parent: Node | None, kind: str):
        self.tag, self.name, self.parent = tag, name, parent
        self.kind = "never" if parent and parent.kind == "never" else kind
        self.inner = parent is not None and (parent.inner or parent.kind == "article")  # stands in an article
        self.holds = False  # an article stands in it
        self.depth = parent.depth + 1 if parent else 0
        self.path = 0 if not parent else _path(parent.path, name) if self.depth <= PATH_DEPTH else parent.path
        self.children: list[Node | str] = []


_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, name: str) -> int:
    """The 64-bit name of a path of tags and classes."""
    path = _paths.get((parent, name))
    if path is None:
        if len(_paths) > 200_000:
            _paths.clear()
        path = _paths[parent, name] = _hash(f"{parent}>{name}")
    return path


def _kind(tag: str, attributes: str) -> tuple[str, str]:
    """How an element counts (never, article or plain), and its name in paths: the tag with its classes."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)} if attributes else {}
    classes = sorted(set(found.get("class", "").lower().split()))
    name = ".".join([tag, *[re.sub(r"\d+", "#", c) for c in classes]])
    words = {_head(t) for k in ("class", "id", "role") for t in found.get(k, "").lower().split()}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or tag in NEVER and tag != "form":
        return "never", name
    if tag in ("article", "main") or found.get("role", "").lower() in ARTICLE_ROLES or found.get("itemprop", "").lower() == "articlebody":
        return ("talk" if words & REPLIES else "article"), name
    if tag in ("body", "html"):
        return "plain", name
    return ("talk" if words & TALK else "named" if words & BOILERPLATE or tag == "form" else "plain"), name


def _head(token: str) -> str:
    """The word that says what a class or id names; empty where it names a state."""
    words = _WORD.findall(token.partition("--")[0])
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return words[-1] if words and not STATES.intersection(words[:-1]) else ""


def _settle(nodes: list[Node]) -> None:
    """Decides on the named and the talk: what holds an article stays, a talk only where no other article has text.

    nodes: parents before children.
    """
    apart: set[int] = set()  # in a talk
    for n in nodes:
        if n.kind == "talk" or id(n.parent) in apart:
            apart.add(id(n))
    written: set[int] = set()  # have text outside of what is named, talk or never
    wrapping: set[int] = set()
    elsewhere = False  # an article outside of any talk has text
    for n in reversed(nodes):
        if n.kind in ("plain", "article") and (id(n) in written or any(isinstance(c, str) and c.strip() for c in n.children)):
            written.add(id(n.parent))
            elsewhere = elsewhere or n.kind == "article" and id(n) not in apart
        if n.kind == "article" or n.holds and n.kind != "never":
            n.parent.holds = True
        if n.tag in LANDMARKS or id(n) in wrapping:
            wrapping.add(id(n.parent))
    for n in nodes:
        if n.parent.kind == "never":
            n.kind = "never"
        elif n.kind == "talk":
            n.kind = "plain" if n.holds and not elsewhere else "never"
        elif n.kind == "named":
            n.kind = "plain" if n.holds or n.tag == "form" and id(n) in wrapping else "never"
        n.inner = n.parent.inner or n.parent.kind == "article"


def parse(source: str) -> Node:
    """A forgiving parse: unclosed and stray tags as browsers take them, texts decoded."""
    top = now = Node("", "", None, "plain")
    nodes: list[Node] = []
    opened: Counter[str] = Counter()  # the open elements by tag: spares the way up for what isn't open
    at, end = 0, len(source)

    def text(a: int, b: int) -> None:
        if b > a:
            now.children.append(html.unescape(source[a:b]))

    def close(tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Ends the outermost open element of these tags below the nearest container."""
        if not any(opened[t] for t in tags):
            return
        node, to = now, now
        while node.parent and node.tag not in within:
            if node.tag in tags:
                to = node.parent
            node = node.parent
        leave(to)

    def leave(to: Node) -> None:
        nonlocal now
        while now is not to:
            opened[now.tag] -= 1
            now = now.parent

    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node.parent and node.tag != tag and opened[tag]:
                # The end of an inline element doesn't reach out of the block it stands in.
                if tag not in BLOCK and node.tag in BLOCK:
                    break
                node = node.parent
            if node.parent and node.tag == tag:
                leave(node.parent)
            elif tag == "br":
                nodes.append(Node("br", "br", now, "plain"))
                now.children.append(nodes[-1])
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in CLOSES_P:
            close(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "body", "main", "form", "table", "button"))
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag == "body":
            close(("head",), ())
        kind, name = _kind(tag, m[3])
        node = Node(tag, name, now, kind)
        nodes.append(node)
        now.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            if tag in ("textarea", "title") and stop:
                node.children.append(html.unescape(source[at : stop.start()]))
            at = stop.start() if stop else end
            closing = source.find(">", at)
            at = closing + 1 if stop and closing >= 0 else end
        elif tag not in VOID:
            now = node
            opened[tag] += 1
    _settle(nodes)
    return top


def _own_text(node: Node) -> str:
    """The text in the node and its inline descendants, not in blocks below."""
    parts = []
    todo = node.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in BLOCK and c.kind != "never":
            if c.tag in INLINE_SPACE:
                todo.append(" ")
            todo += c.children[::-1]
    return _SPACES.sub(" ", "".join(parts)).strip()


def blocks(top: Node, removed: frozenset[int] | set[int]) -> list[str]:
    """The page's text blocks in order. removed: the host's noise."""
    roots = [n for n in _elements(top) if n.kind == "article" and not n.inner]
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = _SPACES.sub(" ", "".join(run)).strip()
        if line:
            out.append(line)
        run.clear()

    def walk(root: Node, protected: bool) -> None:
        inside = [(iter(root.children), False)]
        while inside:
            children, block = inside[-1]
            for c in children:
                if isinstance(c, str):
                    run.append(c)
                    continue
                if c.kind == "never" or (c.path in removed and not _protected(c, protected)):
                    if c.tag in BLOCK:
                        flush()
                    continue
                if c.tag in INLINE_SPACE:
                    run.append(" ")
                if c.tag in BLOCK:
                    flush()
                inside.append((iter(c.children), c.tag in BLOCK))
                break
            else:
                inside.pop()
                if block:
                    flush()

    for root in roots or [top]:
        walk(root, bool(roots))
        flush()
    return out


def _protected(node: Node, in_article: bool) -> bool:
    """An article's headings, paragraphs, lists, quotes and tables and its inline text stay."""
    return node.kind == "article" or in_article and node.tag not in ("div", "section", "figure", "details")


def _elements(top: Node) -> Iterator[Node]:
    todo = [c for c in reversed(top.children) if not isinstance(c, str)]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_features(top: Node) -> list[tuple[int, tuple[int, ...], int, list[int]]]:
    """(path, the paths from the top to it, style hash, hashes of the texts) of the page's block elements, once per path."""
    lines: dict[int, tuple[int, ...]] = {id(top): ()}
    gathered: dict[int, tuple[tuple[int, ...], list[str], set[int]]] = {}
    for n in _elements(top):
        line = lines[id(n.parent)]
        if n.tag in BLOCK and n.kind != "never":
            if not line or line[-1] != n.path:
                line = (*line, n.path)
            _, styles, texts = gathered.setdefault(n.path, (line, [], set()))
            styles.append(",".join(c.name for c in n.children if not isinstance(c, str)))
            text = _own_text(n)
            if text:
                texts.add(_hash(text))
        lines[id(n)] = line
    return [(path, line, _hash("\n".join(styles)), sorted(texts)) for path, (line, styles, texts) in gathered.items()]


FEATURES = "host string, page long, path long, line array<long>, style long, content long"
_FEATURES = pa.schema([("host", pa.string()), ("page", pa.int64()), ("path", pa.int64()), ("line", pa.list_(pa.int64())), ("style", pa.int64()), ("content", pa.int64())])


def _features(pages: DataFrame) -> DataFrame:
    """For each page and path a row with the line and the style, and one for each text there."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                found = page_features(parse(source or ""))
                page = _hash(repr(found))
                for path, line, style, texts in found:
                    rows.append((host, page, path, line, style, None))
                    rows += [(host, page, path, None, None, t) for t in texts]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FEATURES.types, strict=True)], schema=_FEATURES)

    return pages.select("host", "html").mapInArrow(make, FEATURES)


def importance(features: DataFrame) -> DataFrame:
    """features -> host, path, line, parent, pages, styles, own: each element's importance by itself."""
    seen = features.distinct()
    n, c = F.sum("c"), F.col("c")
    styles = seen.where("style is not null").groupBy("host", "path", "style").agg(F.count("*").alias("c"), F.min("line").alias("line"))
    h_style = F.log(n) - F.sum(c * F.log("c")) / n
    by_style = styles.groupBy("host", "path").agg(n.alias("pages"), F.count("*").alias("styles"), F.min("line").alias("line"), h_style.alias("h_style"))
    texts = seen.where("content is not null").groupBy("host", "path", "content").agg(F.count("*").alias("c"))
    by_text = texts.groupBy("host", "path").agg((F.sum(c * F.log("c")) / n).alias("h_text"))
    both = by_style.join(by_text, ["host", "path"], "left")
    # A text on c of m pages is spread with entropy log c; the mean counts a text once for each page that has it.
    greater = F.greatest(F.col("h_style") / F.log("pages"), 1 - F.col("h_text") / F.log("pages"))
    own = F.when(F.col("pages") > 1, 1 - (1 - greater) * (1 - 1 / F.col("pages"))).otherwise(1.0)
    return both.select("host", "path", "line", F.try_element_at("line", F.lit(-2)).alias("parent"), "pages", "styles", own.alias("own"))


def composite(own: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """importance's rows with composite: an element's and its branch's importance."""
    top = own.select("host", F.col("path").alias("parent"), F.col("styles").alias("parent_styles"))
    brood = own.where("parent is not null").groupBy("host", "parent").agg(F.sum("pages").alias("brood"))
    # A path's factor in its parent's composite importance, and the product on the way from the top, as logs.
    factor = own.join(top.join(brood, ["host", "parent"]), ["host", "parent"], "left")
    factor = factor.select("host", F.col("path").alias("at"), F.coalesce(F.col("parent_styles") * math.log(gamma) + F.log(F.col("pages") / F.col("brood")), F.lit(0.0)).alias("factor"))
    way = own.select("host", "path", F.explode("line").alias("at")).join(factor, ["host", "at"]).groupBy("host", "path").agg(F.sum("factor").alias("way"))
    part = F.when(F.col("brood").isNull(), F.col("own")).otherwise(F.col("own") * (1 - F.pow(F.lit(gamma), F.col("styles"))))
    parts = own.join(brood.withColumnRenamed("parent", "path"), ["host", "path"], "left").select("host", "path", "line", part.alias("part")).join(way, ["host", "path"])
    above = way.select("host", F.col("path").alias("at"), F.col("way").alias("way_at"))
    sums = parts.select("host", F.explode("line").alias("at"), "part", "way").join(above, ["host", "at"])
    sums = sums.groupBy("host", F.col("at").alias("path")).agg(F.sum(F.exp(F.col("way") - F.col("way_at")) * F.col("part")).alias("composite"))
    return own.join(sums, ["host", "path"])


def noise(features: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, path: elements whose composite importance, and that of all below them, is under the threshold."""
    own = materialize(importance(features), "style-importance")
    weighed = composite(own).select("host", F.explode("line").alias("path"), "composite")
    return weighed.groupBy("host", "path").agg(F.max("composite").alias("most")).where(F.col("most") < threshold).select("host", "path")


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars: one row per row of pages.

    text joins the article's blocks in page order with newlines; white space inside a
    block is one space, character references are decoded. Null or empty html, and pages
    without an article's text, give an empty text. Null urls, and such without ``://``,
    count as one host. Repeated rows give equal rows and count once in the tree. Pages
    nest to any depth; below PATH_DEPTH elements count with the one above them there. An
    empty table gives an empty result; other columns are ignored. Nothing is cut off.
    """
    host = ascii_lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    low = noise(materialize(_features(rows), "style-tree"), threshold)
    low = low.groupBy("host").agg(F.collect_set("path").alias("paths"))
    # Pages meet their host's noise in parts: HEAVY_HOSTS hosts at most, whatever the input, have SALTS of them.
    counts = materialize(rows.groupBy("host").agg(F.count("*").alias("n")), "host-pages")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(counts.where(F.col("n") * HEAVY_HOSTS >= total).select("host", F.lit(SALTS).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    # Written, so that Spark knows its size and sends it to the pages where that is small.
    spread = materialize(low.join(heavy, "host", "left").select("host", "paths", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), "style-noise")
    salted = rows.join(heavy, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(blocks(parse(s), frozenset(p or ()))) for s, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return salted.join(spread, ["host", "salt"], "left").select("page_id", "url", "html", "paths").mapInArrow(make, f"page_id {kind}, url string, text string, n_chars long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
