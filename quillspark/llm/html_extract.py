"""Main text of web pages by consensus paths of their host.

Each page is parsed once to score its containers: characters in paragraphs count for the container they stand in and half for the next one out,
less what stands in links. A page votes for the path of its best container, tags with classes from the root down, digits generalised. Spark
counts the votes per host (a partial aggregate, so a host with a third of all pages costs no task more) and ranks a host's paths, the first `RANKED`. Then
each page is parsed again and its text taken from the host's highest-ranked path that fits it: one whose container here has at least `FIT` of the
score of the page's own best; else from that best. Pages stay where they are if the table of paths is small, by its measured size, and is sent to them;
beyond that they are joined with it by host, the pages and paths of hosts with many pages dealt over salts.

The text isn't that of the container alone: it is taken from the outermost article or main about it. Where there is none, it is taken from the outermost
container that has text of its own beside it, more outside links than in them (text in sections and quotations counts for what holds them), or
that isn't the body and has an h1 beside it. Text beside it that stands only in other divs or cells is left out, as they may be teasers.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles are left out wherever they stand: by element, by role, by
classes and ids. A class counts if its words are such a word and others that say nothing (`share-buttons`, but not `tags-intro`); what follows `with` or the
like is no name (`layout-with-sidebar`); a few words (`SURE`) count beside any other. A form, an element hidden from readers' aids, or an element whose class isn't sure or has
other words too (`comments-open`), stays if it holds over half (of what is named for readers' talk, 19 of 20 parts) of the page's text outside links and every article or main there is: a form about a whole
page doesn't make its article a form. Where a page has one article that stands out, of at least `SIZED` characters and over half of what stands in outermost
articles, only containers in an article or main are looked at, so a larger block of what readers say beside it isn't taken for the article. Character references are
decoded (one of over 4000 digits is U+FFFD), white space within a block becomes one space, blocks follow each other in page order, joined by one space.

Any bytes are parsed in time that grows with their number: the tag pattern gives nothing back once taken, a tag that isn't closed ends with the page (as in
browsers), and where an element's end tag or fence stands in the stack is looked up, not searched.

Null or empty html gives empty text. A null url is a host of its own (the empty one). Repeated rows are extracted each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot, parts, pick, written

#: Paths ranked per host; a page that fits none of them falls back on its own best container.
RANKED, FIT = 8, 0.3
#: Characters outside links from which an article counts as one.
SIZED = 200
#: Bytes of paths up to which their table is sent to all tasks.
SENT = 16 << 20

#: Names of HTML elements and of roles, and words that sites use in classes and ids of what isn't the article. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
ARTICLES, PARTS = frozenset(("article", "main")), frozenset(("section", "blockquote"))
BLOCKS = CONTAINERS | frozenset(
    "html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption pre figure figcaption nav header footer aside form fieldset details summary address hr dialog menu hgroup search legend option".split()
)
DROPPED = RAW | frozenset("head nav header footer aside button select svg canvas object audio video dialog menu search fieldset label datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
SURE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr comments disqus respond replies newsletter subscribe breadcrumb breadcrumbs navbar navigation pagination".split())
WORDS = SURE | frozenset(
    "promo promotion banner sidebar sidebars rail menu nav footer header masthead notice notices disclaimer alert popup modal overlay comment share sharing social signup login related recommended recommendations review reviews discussion discussions reactions feedback responses widget widgets pager paging toolbar skip tags hidden".split()
)
#: Words that say nothing of what an element is, and words before which a name ends. Fixed values.
PLAIN = frozenset(
    "box list block area wrap wrapper container section bar panel inner outer top bottom left right site page global item items link links button buttons post posts content body text row col column group main primary secondary form icon icons count feed card cards unit slot zone region holder story stories article articles entry news blog thread threads".split()
)
TALK = frozenset("reviews discussion discussions reactions feedback responses".split())
STATES = frozenset("has with without no not is js".split())
#: What ends an open <p>, and what an element of the same kind ends. Fixed values.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)(?:>|\Z)|</[^>]*+(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
DIGITS = re.compile(r"\d+")
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
hash_of = xxhash.xxh64_intdigest
HUGE = re.compile(r"&#[0-9]{4001,}+;?")


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    try:
        return html.unescape(text)
    except ValueError:  # more digits than Python takes for a number
        return html.unescape(HUGE.sub("\ufffd", text))


class Node:
    __slots__ = ("tag", "key", "parent", "hard", "soft", "out", "start", "end", "score", "path", "top", "box", "h1", "size", "articles", "own", "linked", "heads")

    def __init__(self, tag, key, parent, start, hard=False, soft=0):
        self.tag, self.key, self.parent, self.start, self.end, self.hard, self.soft, self.score = tag, key, parent, start, None, hard, soft, 0.0
        self.path = hash_of(key, parent.path if parent else 0)
        inside = parent is None or tag in CONTAINERS
        self.box = self if inside else parent.box  # the innermost container
        self.h1 = not inside and (parent.h1 or tag == "h1")
        self.out, self.top = False, None
        self.size = 0  # characters outside links, and of articles how many, in it and in all that stands in it
        self.articles = int(tag in ARTICLES)
        self.own = self.linked = self.heads = 0  # characters that stand in it and in no container within it: outside links, in links, in an h1


def _unwanted(tag: str, attributes: dict[str, str]) -> tuple[bool, int]:
    """(surely, perhaps: as the part of twenty that it must hold of the page's text to stay; 0 if it may stay)"""
    role = attributes.get("role", "").lower()
    if tag in DROPPED or role in ROLES or "hidden" in attributes:
        return True, 0
    soft = 10 * (tag == "form" or role == "form" or attributes.get("aria-hidden") == "true")
    if tag in ("html", "body", "article", "main"):
        return False, soft
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in SPLIT.split(name) if w]
        words = words[: next((i for i, w in enumerate(words) if w in STATES), len(words))]
        known = all(w in WORDS or w in PLAIN or w.isdigit() for w in words)
        if known and not SURE.isdisjoint(words):
            return True, 0
        if known and not TALK.isdisjoint(words):
            soft = 19
        elif not soft and (not SURE.isdisjoint(words) or known and not WORDS.isdisjoint(words)):
            soft = 10
    return False, soft


class Page:
    """Containers with their scores, and the pieces of text in page order; a piece that isn't wanted is empty, a block's edge is a space."""

    def __init__(self, source: str):
        self.pieces: list[str] = []
        self.nodes: list[Node] = []
        self.every = [Node("", "", None, 0)]
        self.texts: list[tuple[int, Node, bool]] = []  # pieces that are text: where, in what, whether in a link
        self.stack: list[Node] = []
        self.spots: dict[str, list[int]] = {}  # where in the stack elements of a tag stand
        self.blocks: list[int] = []
        self._push(self.every[0])
        self._read(source)
        self._pop(0)
        self.root = self.every[0]
        self._settle()
        articles = [n for n in self.nodes if n.tag == "article" and not n.out]
        outer = [n for n in articles if not any(n is not m and m.start <= n.start and n.end <= m.end for m in articles[:64])] if len(articles) <= 64 else []
        largest = max((n.size for n in outer), default=0)
        self.within = largest >= SIZED and 2 * largest > sum(n.size for n in outer)  # the page has one article that stands out
        self.best = max((n for n in self.nodes if self.fits(n)), key=lambda n: n.score, default=None)
        if self.best and not self.best.score > 0:
            self.best = None

    def fits(self, node: Node) -> bool:
        """Whether the main text may stand in this container: anywhere, or in an article or main where the page has one article."""
        return not self.within or node.top is not None

    def _read(self, source: str) -> None:
        at = 0
        while found := TOKEN.search(source, at):
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCKS or tag == "br":
                self.pieces.append(" ")
            if found[1]:
                self._close(tag)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in VOID or found[3].endswith("/") and tag not in BLOCKS and tag not in ("a", "span", "b", "i"):
                continue
            if tag in BLOCKS:
                self._imply(tag)
            key, hard, soft = tag, tag in DROPPED, 10 * (tag == "form")
            if found[3] and not found[3].isspace():
                attributes = {k.lower(): _decoded(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(found[3])}
                hard, soft = _unwanted(tag, attributes)
                if classes := ".".join(sorted(DIGITS.sub("#", attributes.get("class", "")).split())):
                    key = f"{tag}.{classes}".replace(">", "")
            node = Node(tag, key, self.stack[-1], len(self.pieces), hard, soft)
            self.every.append(node)
            self._push(node)
            if tag in CONTAINERS:
                self.nodes.append(node)
        if at < len(source):
            self._text(source[at:])

    def _text(self, raw: str) -> None:
        self.texts.append((len(self.pieces), self.stack[-1], bool(self.spots.get("a"))))
        self.pieces.append(_decoded(raw))

    def _push(self, node: Node) -> None:
        self.spots.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def _pop(self, i: int) -> None:
        for node in self.stack[i:]:
            node.end = len(self.pieces)
            self.spots[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()
        del self.stack[i:]

    def _close(self, tag: str) -> None:
        """What an end tag ends: its element, unless that isn't open or a block stands open in an inline element."""
        if (spots := self.spots.get(tag)) and (tag in BLOCKS or not self.blocks or self.blocks[-1] < spots[-1]):
            self._pop(spots[-1])

    def _imply(self, tag: str) -> None:
        """What a block element that opens ends by itself: an open paragraph, an earlier item of its kind."""
        if tag in SIBLINGS:
            fence = max((self.spots[f][-1] for f in FENCES[tag] if self.spots.get(f)), default=0)
            inner = (p[bisect.bisect_right(p, fence) :] for p in (self.spots.get(t, ()) for t in (*SIBLINGS[tag], "p")) if p and p[-1] > fence)
            self._pop(min((p[0] for p in inner), default=len(self.stack)))
        elif self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self._pop(self.blocks[-1])

    def _settle(self) -> None:
        """Decides what is unwanted, empties its pieces and scores the containers with the rest."""
        sizes = [len(self.pieces[i].strip()) for i, _, _ in self.texts]
        for (_, node, linked), size in zip(self.texts, sizes, strict=True):
            node.size += size * (not linked)
        for node in reversed(self.every[1:]):
            if not node.hard:
                node.parent.size += node.size
                node.parent.articles += node.articles
        for node in self.every[1:]:
            whole = 20 * node.size > node.soft * self.root.size and node.articles == self.root.articles
            node.out = node.parent.out or node.hard or node.soft and not whole
            node.top = node.parent.top or (node if node.tag in ARTICLES and not node.out else None)
        for (i, node, linked), size in zip(self.texts, sizes, strict=True):
            if node.out:
                self.pieces[i] = ""
            elif linked:
                node.box.linked += size
            else:
                box, weight = node.box, 1.0
                box.own += size
                box.heads += size * node.h1
                while box.parent and weight >= 0.25:
                    box.score += size * weight * (1.25 if box.tag in ARTICLES else 1.0)
                    box, weight = box.parent.box, weight / 2

    def _reach(self) -> dict[Node, Node]:
        """The outermost container of each that has wanted text beside it."""
        above = {node: node.parent.box for node in self.nodes}
        own, linked, heads = ({n: getattr(n, k) for n in (self.root, *self.nodes)} for k in ("own", "linked", "heads"))
        for node in reversed(self.nodes):  # what stands within comes after what holds it
            outer = above[node]
            heads[outer] += heads[node]
            if node.tag in PARTS:
                own[outer] += own[node]
                linked[outer] += linked[node]
        found = {self.root: self.root}
        for node in self.nodes:
            outer = above[node]
            part = node.tag in PARTS
            beside, links = own[outer] - part * own[node], linked[outer] - part * linked[node]
            fits = beside > links or outer.parent and outer.tag != "body" and heads[outer] > heads[node]
            found[node] = found[outer] if fits or found[outer] is not outer else node
        return found

    def whole(self, nodes: list[Node]) -> list[Node]:
        """The containers that hold all of the texts of which these hold the most."""
        reach = None if all(n.top for n in nodes) else self._reach()
        return sorted({n.top or reach[n] for n in nodes}, key=lambda n: (n.start, -n.end))

    def text(self, nodes: list[Node]) -> str:
        out, upto = [], 0
        for node in nodes:
            if node.start >= upto:  # not within the one before
                out += self.pieces[node.start : node.end]
                out.append(" ")
                upto = node.end
        return " ".join("".join(out).split())


def path_of(node: Node) -> str:
    keys = []
    while node.parent:
        keys.append(node.key)
        node = node.parent
    return ">".join(reversed(keys))


def path_id(path: str) -> int:
    found = xxhash.xxh64_intdigest("", 0)
    for key in path.split(">"):
        found = xxhash.xxh64_intdigest(key, found)
    return found


def main_text(source: str | None, ranked: list[str] | None = None) -> str:
    page = Page(source or "")
    if page.best is None:
        return page.text([page.root])
    for path in ranked or ():
        wanted = path_id(path)
        nodes = [n for n in page.nodes if n.path == wanted and not n.out and n.score > 0 and page.fits(n)]
        if nodes and max(n.score for n in nodes) >= FIT * page.best.score:
            return page.text(page.whole(nodes))
    return page.text(page.whole([page.best]))


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pick(pages, page_id="long", url="string", html="string").withColumn("host", host)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): the best container of each page that has one."""

    def run(batches):
        for batch in batches:
            for host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = Page(source or "").best
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([path_of(best)]), pa.array([float(best.score)])], names=["host", "path", "score"])

    return _with_host(pages).select("host", "html").mapInArrow(_gathered(run), "host string, path string, score double")


def _gathered(run, rows: int = 1000):
    """Joins small batches."""

    def joined(batches):
        held = []
        for batch in run(batches):
            held.append(batch)
            if len(held) >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def host_paths(counted: DataFrame, ranked: int = RANKED) -> DataFrame:
    """(host, paths): a host's paths by votes, the most first; of (host, path, n, score)."""
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    top = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= ranked)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, ranked: int = RANKED, sent: int = SENT) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        for batch in batches:
            sources, paths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [main_text(s, p) for s, p in zip(sources, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    counted = written(votes(pages).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score")), "html-votes")
    paths = written(host_paths(counted, ranked), "html-paths")
    rows = _with_host(pages)
    size = paths.agg(F.sum(F.length("host") + F.aggregate("paths", F.lit(0).cast("long"), lambda n, p: n + F.length(p)) + 100)).first()[0] or 0
    if size <= sent:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        spark = pages.sparkSession
        each = counted.groupBy("host").agg(F.sum("n").alias("n"))
        heavy = F.broadcast(written(hot(each, each.agg(F.sum("n")).first()[0], parts(spark)).select("host", "salts"), "html-heavy"))
        salts = F.coalesce("salts", F.lit(1))
        dealt = rows.join(heavy, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int")).drop("salts")
        spread = paths.join(heavy, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        joined = dealt.join(spread.hint("shuffle_hash"), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
