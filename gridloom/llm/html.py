"""Main-text extraction with site style trees.

The DOMs of a host's pages are merged: elements of the same path of presentations (tag, class and id, digits
dropped) become one node of the host's style tree. A node's importance is entropy-based:

* content: 1 - mean over its distinct texts of log(pages that show it) / log(pages with the node); text that
  every page repeats has importance 0, text of its own has 1;
* presentation: the entropy of its layouts (sequences of children) over pages, in units of log(pages);
* composite, bottom up: (1 - g**l) * presentation + g**l * mean of the children's importance (a leaf's is its
  content importance), l being the number of layouts and g = 0.9;
* a presentation that names its purpose (nav, footer, aside, form, a class such as "ad", "cookie", "comments")
  multiplies it by zero, one that names the article (article, main, role=main, articleBody) or plain prose inside
  it keeps it at one.

Branches below THRESHOLD times the host's highest importance are cut from each page: a site whose pages have much in
common keeps what differs most. If a page has article elements with text, they alone are read;
else what is left of its body. Copies of a page count as one page of their host, so that a site of copies keeps
its text. Statistics are counted over all pages by two plain aggregations whose keys end in a text's hash; no host
is gathered in a task, only its tree, whose size is that of its templates.

Blocks are joined by one line feed; white space inside a block, <br> included, is one blank; character references
are decoded.

Edge cases: null html is empty text; a null url has a host of its own; unclosed or crossed tags are repaired as
browsers do (a block start ends a paragraph, an end tag closes what it encloses); repeated rows count once in the
tree and are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, map_texts, scratch

#: Share of its host's highest importance under which a branch is noise, and the weight of layouts.
THRESHOLD, DECAY = 0.4, 0.9

#: A quote opens a quoted value only behind an equals sign; elsewhere it is a character like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_TOKEN = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table tbody thead tfoot tr td th figure figcaption caption b i em strong a span code sub sup u s q cite small mark abbr time del ins kbd var samp br hgroup header".split())
#: Start tags that end an open element of these kinds, up to the enclosing one.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOT_TEXT = frozenset("nav footer aside form button select option input dialog menu search head header label fieldset".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
NOT_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer disqus discussion footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related recommended replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: What a name may end in or begin with and still say the same.
NOT_TEXT_PARTS = ("sidebar", "navbar", "breadcrumb", "comment", "advert", "cookie", "newsletter", "footer")
TEXT_ROLES, TEXT_TAGS = frozenset(["main", "article"]), frozenset(["article", "main"])


def _hash(a: int, b: str) -> int:
    """A 62-bit hash of a parent's hash and a name."""
    data = b"%d/%s" % (a, b.encode("utf-8", "replace"))
    return crc32(data) << 30 ^ crc32(data[::-1], 0x9E3779B9)


class Node:
    __slots__ = ("tag", "parent", "key", "prior", "named", "kids", "text", "inside", "article")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_kinds: dict[tuple[str, str, str], tuple[str, float | None, bool, bool]] = {}


def _presentation(tag: str, attrs: str, above: str = "") -> tuple[str, float | None, bool, bool]:
    """(name, importance it claims or None, whether it claims to be the article, whether its class alone rules it out).

    An article's own header is text, and so is a heading called a header; a page's root has no purpose of its own.
    """
    held = _kinds.get((tag, attrs, above))
    if held:
        return held
    given = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if "=" in attrs else {}
    classes, role = _DIGITS.sub("", f"{given.get('class', '')} {given.get('id', '')}"), given.get("role", "")
    article = tag in TEXT_TAGS or role in TEXT_ROLES or "articlebody" in given.get("itemprop", "")
    names = [n for n in _TOKEN.findall(classes) if n != "header" or "article" not in above and tag not in HEADINGS]
    hidden = bool(re.search(r"(^|\s)hidden(\s|=|$)", attrs)) or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    named = bool(NOT_TEXT_NAMES.intersection(names)) or any(n.startswith(p) or n.endswith(p) for n in names for p in NOT_TEXT_PARTS)
    root, by_tag = tag in ("body", "html"), tag in NOT_TEXT or role in NOT_TEXT_ROLES or hidden
    prior = None if root else 0.0 if by_tag or named else 1.0 if article else None
    out = (f"{tag}.{classes.strip()}", prior, article and not by_tag, named and not by_tag and not root)
    if len(_kinds) < 100_000:
        _kinds[tag, attrs, above] = out
    return out


class Stack:
    """The open elements, with the places of each tag and of blocks, so that no tag is looked for one by one."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        """Where the innermost open element of a tag is, 0 without one."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def cut(self, i: int) -> None:
        """Close the element at i and all inside it."""
        while len(self.nodes) > i:
            self.at[self.nodes.pop().tag].pop()
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag closes what it encloses; one of an inline element doesn't close a block."""
        i = self.last(tag)
        if i and (tag in BLOCK or not self.blocks or self.blocks[-1] < i):
            self.cut(i)

    def start(self, tag: str) -> None:
        """What a start tag closes: a block an open paragraph, an item or cell the one before it."""
        if tag in BLOCK and tag not in ("body", "html") and self.blocks and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            bound = max(self.last(t) for t in within)
            if tag == "tr":  # a row also ends the cells and the row before it
                open_ = [i for t in ends for i in self.at.get(t, ()) if i > bound]
                if open_:
                    self.cut(min(open_))
            else:
                i = max(self.last(t) for t in ends)
                if i > bound:
                    self.cut(i)


def parse(html: str) -> list[Node]:
    """The page's elements in order of their start; text lies in each node's ``text`` as (position, string)."""
    root = Node()
    root.tag, root.parent, root.key, root.prior, root.named, root.kids, root.text, root.inside, root.article = "#", None, 1, None, False, [], [], False, False
    nodes, stack, at, order = [root], Stack(root), 0, 0
    find = _TAG.search
    low = None
    while True:
        m = find(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            stack.nodes[-1].text.append((order, piece))
            order += 1
        if not m:
            return nodes
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            stack.end(tag)
            stack.nodes[-1].text.append((order, None if tag in BLOCK else ""))
            order += 1
            continue
        attrs = m.group(3)
        if tag in RAW:
            if not attrs.endswith("/"):
                if low is None:
                    low = html.lower()
                    low = low if len(low) == len(html) else re.sub("[A-Z]", lambda c: c.group().lower(), html)
                end = low.find("</" + tag, at)
                at = len(html) if end < 0 else (html.find(">", end) + 1 or len(html))
            continue
        if tag == "br":
            stack.nodes[-1].text.append((order, " "))
            order += 1
            continue
        stack.start(tag)
        up = stack.nodes[-1]
        node = Node()
        name, prior, article, named = _presentation(tag, attrs, "article" if up.inside else "")
        node.tag, node.parent, node.kids, node.text = tag, up, [], []
        node.key, node.inside, node.article, node.named = _hash(up.key, name), article and not named or up.inside, article, named
        if up.inside and prior != 0.0 and (tag in PROSE and (prior is None and name[len(tag) :] == "." or tag == "header" and name == "header.")):
            prior = 1.0
        elif up.inside and tag == "header" and name == "header.":
            prior = 1.0
        node.prior = prior
        if tag in BLOCK:
            up.text.append((order, None))
            order += 1
        up.kids.append(name)
        nodes.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.push(node)


def _squeezed(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def main_text(html: str | None, noise: frozenset[int]) -> str:
    """The text of a page without the branches whose keys are in ``noise`` or whose presentation rules them out.

    A class that seems to rule out all of a page's text (a theme's name on a wrapper) doesn't: then classes of what
    encloses an article, and without an article all classes, are left out of account.
    """
    nodes = parse(html or "")
    text = _kept_text(nodes, noise, frozenset())
    if not text and any(n.named for n in nodes):
        around: set[int] = set()
        for n in nodes:
            up = n if n.article else None
            while up is not None and id(up) not in around:
                around.add(id(up))
                up = up.parent
        spared = frozenset(around) if around else frozenset(id(n) for n in nodes)
        text = _kept_text(nodes, noise, spared)
    return text


def _kept_text(nodes: list[Node], noise: frozenset[int], spared: frozenset[int]) -> str:
    """The text that is left; classes of ``spared`` nodes rule nothing out."""
    kept: dict[int, bool] = {}
    pieces: list[tuple[int, str | None, bool]] = []
    for n in nodes:
        ruled = n.prior == 0.0 and not (n.named and id(n) in spared)
        ok = (n.parent is None or kept[id(n.parent)]) and not ruled and (n.prior == 1.0 or n.key not in noise or id(n) in spared)
        kept[id(n)] = ok
        if ok:
            inside = n.inside or n.article
            pieces += [(o, s, inside) for o, s in n.text]
        elif n.tag in BLOCK:
            pieces += [(o, None, n.inside) for o, _ in n.text[:1]]
    pieces.sort(key=lambda p: p[0])
    if any(p[2] and p[1] and p[1].strip() for p in pieces):
        pieces = [p if p[2] else (p[0], None, False) for p in pieces]
    blocks, held = [], []
    for _, s, _ in pieces:
        if s is None:
            if held:
                blocks.append(_squeezed(held))
                held = []
        else:
            held.append(s)
    if held:
        blocks.append(_squeezed(held))
    return "\n".join(b for b in blocks if b)


#: kinds of statistics: pages of a node, texts of a leaf, layouts of a node.
PAGES, TEXTS, LAYOUTS = 0, 1, 2


def statistics(html: str) -> set[tuple[int, int, int, int]]:
    """(node key, parent key, kind, feature) of a page."""
    out, dead = set(), {}
    for n in parse(html):
        up = n.parent.key if n.parent else 0
        dead[n.key] = dead.get(up, False) or n.prior == 0.0
        out.add((n.key, up, PAGES, 0 if dead[n.key] else 1 if n.prior is None else 2))
        text = _squeezed([s for _, s in n.text if s])
        if text:
            out.add((n.key, up, TEXTS, _hash(0, text)))
        if n.kids:
            runs = [a for a, b in zip(n.kids, [None, *n.kids]) if a != b]
            out.add((n.key, up, LAYOUTS, _hash(0, "|".join(runs))))
    return out


def tree_noise(keys: list[int], ups: list[int], pages: list[int], texts: list[int], text_logs: list[float], layouts: list[int], layout_logs: list[float], priors: list[int]) -> list[int]:
    """Of one host's style tree the nodes whose composite importance is under THRESHOLD times the highest.

    layout_logs: sum of c * log(c) over a node's layouts, each on c pages; text_logs: sum of log(c) over its texts.
    """
    kids: dict[int, list[int]] = {}
    for i, up in enumerate(ups):
        kids.setdefault(up, []).append(i)
    score = [0.0] * len(keys)
    order, todo = [], [i for i, up in enumerate(ups) if up == 0]
    while todo:
        i = todo.pop()
        order.append(i)
        todo += kids.get(keys[i], [])
    for i in reversed(order):
        m = pages[i]
        scale = math.log(m) if m > 1 else 0
        below = [score[j] * pages[j] / m for j in kids.get(keys[i], [])]
        parts = ([max(below)] if below else []) + ([1 - text_logs[i] / (texts[i] * scale) if scale else 1.0] if texts[i] else [])
        content = max(parts) if parts else 0.0
        shape = max(0.0, (scale - layout_logs[i] / m) / scale) if scale and layouts[i] else 1.0 if layouts[i] else 0.0
        g = DECAY ** max(1, layouts[i])
        score[i] = (content if not layouts[i] else (1 - g) * shape + g * content) * (0.0 if priors[i] == 0 else 1.0)
        if priors[i] == 2:
            score[i] = 1.0
    least = THRESHOLD * max(score, default=0.0)
    return [keys[i] for i in order if score[i] < least and (pages[i] > 1 or priors[i] == 0) and keys[i] != 1]


def site_noise(pages: DataFrame) -> DataFrame:
    """(host, noise): per host the keys of its style tree's unimportant branches."""

    def kernel(batches):
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            hosts, uids, keys, ups, kinds, features = [], [], [], [], [], []
            for host, html in zip(column(batch, "host").to_pylist(), column(batch, "html").to_pylist()):
                data = html.encode("utf-8", "surrogatepass")
                uid = crc32(data) << 30 ^ crc32(data[::-1], 1)
                if (host, uid) in seen:  # a copy says nothing new
                    continue
                if len(seen) < 200_000:
                    seen.add((host, uid))
                for key, up, kind, feature in statistics(html):
                    hosts.append(host)
                    uids.append(uid)
                    keys.append(key)
                    ups.append(up)
                    kinds.append(kind)
                    features.append(feature)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (uids, keys, ups)), pa.array(kinds, pa.int32()), pa.array(features, pa.int64())], ["host", "uid", "key", "up", "kind", "feature"])

    def in_slices(batches):
        from gridloom.llm.common import slices

        yield from kernel(part for batch in batches for part in slices(batch, "html"))

    rows = pages.filter(F.col("html").isNotNull()).select("host", "html").mapInArrow(in_slices, "host string, uid long, key long, up long, kind int, feature long")
    each = rows.groupBy("host", "key", "up", "kind", "feature", "uid").agg(F.lit(1).alias("one"))
    counted = each.groupBy("host", "key", "up", "kind", "feature").agg(F.count("*").alias("c"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    log = F.log(F.col("c").cast("double"))
    nodes = counted.groupBy("host", "key", "up").agg(
        of(PAGES, F.col("c")).alias("pages"), F.min(F.when(F.col("kind") == PAGES, F.col("feature"))).alias("prior"), of(TEXTS, F.lit(1)).alias("texts"), of(TEXTS, log).alias("text_logs"), of(LAYOUTS, F.lit(1)).alias("layouts"), of(LAYOUTS, F.col("c") * log).alias("layout_logs")
    ).fillna(0)

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("up", "ascending")])
        cols = [table[c].to_pylist() for c in ("key", "up", "pages", "texts", "text_logs", "layouts", "layout_logs", "prior")]
        return pa.table({"host": pa.array([table["host"][0].as_py()], pa.string()), "noise": pa.array([sorted(tree_noise(*cols))], pa.list_(pa.int64()))})

    return nodes.groupBy("host").applyInArrow(judge, "host string, noise array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    noise = scratch(site_noise(rows), "noise")  # a small table is broadcast by its size, a large one is joined by sorting
    judged = rows.join(noise, "host", "left").select("page_id", "url", "html", "noise")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for html, noise in zip(column(batch, "html").to_pylist(), column(batch, "noise").to_pylist()):
            texts.append(main_text(html, frozenset(noise or ())))
        return pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_texts(judged, kernel, schema, "html")
