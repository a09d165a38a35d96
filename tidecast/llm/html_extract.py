"""Main text of web pages by consensus paths of a host.

Every page names its containers with a score each, the share of the page's running text that lies in the
container less its links. Spark adds the scores up per host and generalised path (tags and classes from the
root, digits removed) and the best path of a host wins. Pages are then extracted from the containers at
their host's path; a page without such a container uses its own best one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.session import stage

#: The roles that HTML gives its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = set("article main section div td body center content".split())
DROPPED = set(
    "script style noscript template svg math iframe object canvas audio video map head title nav header footer "
    "aside form button select textarea input option dialog menu".split()
)
#: A start tag in the first set ends an open element of the second (fixed values).
CLOSES_PARAGRAPH = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = set("article aside body div dl footer form header html main nav ol section table td th ul".split())
ASIDE_NAMES = re.compile(
    r"(^|[-_\s])(ad|ads|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disclaimer|disqus|"
    r"footer|header|legal|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|"
    r"promo\w*|related|recommend\w*|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|"
    r"subscribe|subscription|toolbar|widget)($|[-_\s])"
)
#: Names of readers' replies, menus and sidebars: they go however long they are.
REPLY_NAMES = re.compile(
    r"(^|[-_\s])(comments?|commentlist|disqus|menu|nav|navbar|navigation|replies|respond|sidebar)($|[-_\s])"
)
#: What a class name says about its element's state or surroundings, not about the element itself.
STATES = re.compile(r"(?<!\S)(has|with|without|no|not|is)[-_]\S*|--\S*|\S*[-_](open|opened|closed|enabled|disabled|on|off)(?!\S)")
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
SPACES = re.compile(r"\s+")


#: Path keys longer than this go on as a digest, so that their lengths do not add up in deep pages.
LONG_KEY = 1000


class Node:
    __slots__ = ("tag", "names", "dropped", "named", "reply", "children", "parent", "_key")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.parent, self.children, self._key = tag, parent, [], None
        self.names = (attrs.get("class") or "").lower()
        marks = f"{self.names} {(attrs.get('id') or '').lower()}"
        self.dropped = (
            tag in DROPPED
            or "hidden" in attrs
            or (attrs.get("aria-hidden") or "").lower() == "true"
            or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
            or (attrs.get("role") or "").lower() in ASIDE_ROLES
        )
        # Dropped by its name alone; articles are not.
        self.named = self.reply = False
        if not self.dropped and tag not in ("html", "body", "article", "main") and ASIDE_NAMES.search(marks):
            own = STATES.sub("", marks)
            self.named = ASIDE_NAMES.search(own) is not None
            self.reply = REPLY_NAMES.search(own) is not None
        self.dropped = self.dropped or self.named

    @property
    def path(self) -> str:
        """Tags and classes from the root, digits removed; outer steps of a very long path as a digest."""
        waiting, node = [], self
        while node._key is None and node.tag != "#root":
            waiting.append(node)
            node = node.parent
        key = node._key or ""
        for node in reversed(waiting):
            classes = sorted({re.sub(r"\d+", "", c) for c in node.names.split()} - {""})
            step = ".".join([node.tag, *classes])
            if len(key) > LONG_KEY:
                key = "#" + hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            key = node._key = f"{key}>{step}" if key else step
        return key


class _Tree(HTMLParser):
    """A tolerant tree: missing end tags are implied, end tags without a start are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.nodes = [self.root]
        self.open: Counter = Counter()

    def _leave(self, node: Node) -> None:
        """End a node and all that is open in it."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags: set, within: set) -> None:
        if not any(self.open[tag] for tag in tags):
            return
        node = self.at
        while node is not None and node.tag not in within | {"#root"}:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_PARAGRAPH:
            self._close({"p"}, SCOPES)
        if tag in CLOSES:
            self._close(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "div"})
        node = Node(tag, dict(attrs), self.at)
        self.nodes.append(node)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open[tag] <= 0:
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._leave(node)

    def parse_marked_section(self, i, report=1):
        """Pass over ``<![...``, which HTML treats as a comment, whatever it holds."""
        mark = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        end = self.rawdata.find(mark, i + 3)
        return end + len(mark) if end >= 0 else -1

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _keep_most(tree.nodes)
    return tree.root


def _keep_most(nodes: list[Node]) -> None:
    """Keep containers with more than half of the page's running text, whatever their names.

    Readers' replies, menus and sidebars are kept only where the page has no other running text.
    """
    if not any(node.named for node in nodes):
        return
    held: dict[int, int] = dict.fromkeys(map(id, nodes), 0)
    for node in reversed(nodes):  # what a node holds comes after it
        if node.tag == "a" or (node.dropped and not node.named):
            held[id(node)] = 0
            continue
        held[id(node)] += sum(len(child.strip()) for child in node.children if isinstance(child, str))
        if node.parent is not None:
            held[id(node.parent)] += held[id(node)]
    whole = held[id(nodes[0])]
    for node in nodes:
        if node.named and (held[id(node)] == whole > 0 if node.reply else 2 * held[id(node)] > whole):
            node.named = node.dropped = False


def blocks(top: Node) -> list[str]:
    """Text blocks below a node in page order, without what it drops; a loop, since pages nest deeply."""
    found, current, todo = [], [], [(top, False)]

    def flush():
        text = SPACES.sub(" ", "".join(current)).strip()
        if text:
            found.append(text)
        current.clear()

    while todo:
        node, ended = todo.pop()
        if isinstance(node, str):
            current.append(node)
        elif ended or node.tag == "#end":
            flush()
        elif node.tag == "br":
            current.append(" ")
        elif not (node.dropped and node is not top):
            if node.tag not in INLINE:
                flush()
                todo.append((node, True))
            todo.extend((child, False) for child in reversed(node.children))
    flush()
    return found


def containers(root: Node) -> dict[str, float]:
    """Score of every generalised container path: its share of running text, a little less if it is wide.

    Running text is what stands in blocks directly, links not counted. An outer container holds all that
    an inner one holds, so each level above the text costs a fifth; article and main elements are credited.
    """
    own: dict[int, float] = {}
    nodes: list[Node] = []
    kept: list[bool] = []
    todo = [(root, False, False)]
    while todo:
        node, dropped, linked = todo.pop()
        if isinstance(node, str):
            continue
        dropped, linked = dropped or node.dropped, linked or node.tag == "a"
        nodes.append(node)
        kept.append(not dropped)
        text = sum(len(child.strip()) for child in node.children if isinstance(child, str))
        own[id(node)] = 0.0 if dropped else -text if linked else text
        todo.extend((child, dropped, linked) for child in node.children)
    scores: dict[str, float] = {}
    total = sum(max(x, 0.0) for x in own.values())
    held = dict(own)
    paragraphs = dict.fromkeys(own, 0.0)
    for node in reversed(nodes):
        if node.parent is not None:
            held[id(node.parent)] += held[id(node)]
            step = 1.0 if node.tag in INLINE or node.tag == "p" else 0.8
            paragraphs[id(node.parent)] += step * (own[id(node)] + paragraphs[id(node)])
    for node, stays in zip(nodes, kept):
        if stays and node.tag in CONTAINERS and total and held[id(node)] > 0:
            credit = 1.5 if node.tag in ("article", "main") else 1.0
            score = credit * (own[id(node)] + paragraphs[id(node)]) / total
            if score > 0:
                scores[node.path] = scores.get(node.path, 0.0) + score
    return scores


def _at_path(root: Node, path: str | None) -> list[Node]:
    """The kept containers at a generalised path, in page order."""
    found, todo = [], [root] if path else []
    while todo:
        node = todo.pop()
        if node.dropped:
            continue
        if node.tag in CONTAINERS and node.path == path:
            found.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def main_text(html: str | None, path: str | None) -> str:
    """Text of the page's containers at ``path``, else of its own best one, else of the whole page."""
    root = parse(html or "")
    chosen = _at_path(root, path)
    if not chosen or not any(blocks(node) for node in chosen):
        scores = containers(root)
        best = min(scores, key=lambda p: (-scores[p], p)) if scores else None
        chosen = _at_path(root, best) or [root]
    return "\n".join(block for node in chosen for block in blocks(node))


def host(url):
    """Host of a URL in lower case, without a leading ``www.``; empty if there is none."""
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.coalesce(F.regexp_replace(name, r"^www\.", ""), F.lit(""))


def vote(pages: DataFrame) -> DataFrame:
    """``host, path``: the winning container path of every host.

    Scores are added up per (host, path) before the choice, so a host with a third of all pages reaches
    the last step as a few rows. Ties go to the smaller path.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "path", "score"]
        for batch in batches:
            rows = [
                (name, path, value)
                for name, html in zip(*(column.to_pylist() for column in batch.columns))
                for path, value in containers(parse(html)).items()
            ]
            columns = zip(*rows) if rows else [[]] * 3
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    named = pages.select(host("url").alias("host"), "html").filter(F.col("html").isNotNull())
    scored = named.mapInArrow(score, "host string, path string, score double")
    # Sums of rounded scores do not depend on the order in which tasks end.
    votes = scored.groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 1e6).cast("long")).alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return votes.withColumn("place", F.row_number().over(order)).filter("place = 1").select("host", "path")


def _salted(pages: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages, and one row per host, with a ``salt``: a large host's pages go to several tasks.

    A host with more than one page in a thousand gets salts in proportion to its pages, the others one.
    There are fewer than a thousand such hosts, however many pages there are.
    """
    counts = stage(pages.groupBy("host").count())
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    large = counts.filter(F.col("count") * 1000 > total).collect()
    rows = [(row["host"], -(-4000 * row["count"] // total)) for row in large]
    salts = F.broadcast(pages.sparkSession.createDataFrame(rows, "host string, salts long"))
    spread = F.coalesce("salts", F.lit(1).cast("long"))
    at = F.pmod(F.xxhash64("page_id", "html"), spread).alias("salt")
    each = F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)).alias("salt")
    return (
        pages.join(salts, "host", "left").select(*pages.columns, at),
        hosts.join(salts, "host", "left").select(*hosts.columns, each),
    )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    A null or empty page, or one without text, has the empty text. Character references are decoded, white
    space in a block becomes one space, blocks are joined by a line feed, nothing is cut. Malformed markup is
    read as far as it goes; declarations that HTML does not know are passed over. Pages with a null
    URL share the empty host. Repeated rows stay; other columns are ignored; no page gives no row.
    """
    rows = pages.select("page_id", "url", "html", host("url").alias("host"))
    rows, winners = _salted(rows, vote(pages))
    joined = rows.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "path")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html, path) for html, path in zip(*(batch.column(i).to_pylist() for i in (2, 3)))]
            columns = [*batch.columns[:2], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(text, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
