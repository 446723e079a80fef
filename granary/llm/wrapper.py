"""HTML extraction by wrapper induction.

Pages of a host share a template.  One page per host (the one nearest to a given size) is the
model tree.  Every page's DOM tree is aligned with the model by simple tree matching: roots must
carry the same label, and the children of matched nodes are aligned in order so that the number
of matched nodes below is largest.  The pages of a host vote on the model's nodes, and the template
that they elect decides on every page of the host, whether it marks an article or not:

* a run of text that is the same on most pages is constant and belongs to the template; the others
  are slots;
* the region of the host is the innermost element that holds ``REGION`` of the varying text and of
  the varying headings; slots outside it are furniture whatever their names;
* an element that markup calls an article on most pages is one on all of them, and so is a menu,
  header, footer, sidebar, notice, advert, form or reader comment.

A page's text is what stands in slots and in nodes that the template lacks, inside the region.
Markup breaks ties: a marked article (``article``, ``main``) says where in the region the article
begins, furniture that varies from page to page inside the region is known by its names, and pages
without a template are read by markup alone.

Pages with equal html vote once.  Inside a marked article a page that agrees with the model in more
than half of its characters is a copy of the model's article and has no vote there, so that an
article of many copies is not taken for template.  Hosts with fewer than ``LEAST_PAGES`` different
pages have no template.  Votes are summed per host and node on the map side; a host may hold any
share of pages.

Defined results: null html gives the empty text; a page with null or odd URL belongs to no host
and is read by its markup alone; repeated rows and further columns are plain.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise

#: Different pages a host needs, and the share of them on which a text is constant.
LEAST_PAGES = 5
CONSTANT = 0.6
#: Share of a host's varying text and headings that its region holds.
REGION = 0.8
#: The model page of a host is the one whose html is nearest to this many characters.
MODEL_CHARS = 2000
#: Characters of model pages whose trees a task keeps.
KEPT_CHARS = 2_000_000

# Element names of HTML by their role here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "wbr", "img", "label",
}
DROPPED = {
    "head", "script", "style", "title", "noscript", "template", "iframe", "nav", "header", "footer", "aside", "form", "button",
    "select", "option", "input", "textarea", "dialog", "menu", "svg", "canvas", "object", "embed", "audio", "video", "map",
}
ARTICLE = {"article", "main"}
#: Open elements that a start tag closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"},
}
#: Elements before which an open paragraph ends.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
    "pre", "section", "table", "ul",
}
#: Words of class, id and role attributes that mark furniture; whole words between separators.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar",
    "aside", "widget", "related", "recommended", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "share", "sharing", "social", "comment", "comments",
    "respond", "disqus", "search", "login", "form", "pagination", "pager", "contentinfo", "complementary", "toolbar",
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|[^<]+|<""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPLIT = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")
HEADLINE = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold text and no layout: the region is never one of them.
TEXTUAL = HEADLINE | {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "address"}


class Node:
    """An element with block children, or a run of text (label ``#``)."""

    __slots__ = ("label", "children", "text", "furniture", "article", "key", "size")

    def __init__(self, label: str, text: str = "", furniture: bool = False, article: bool = False):
        self.label, self.text, self.furniture, self.article = label, text, furniture, article
        self.children: list[Node] = []
        self.key, self.size = -1, 1


def _furniture(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether markup says that the element is no article text; its first class."""
    drop, first = tag in DROPPED, ""
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                drop = True
            elif name in ("class", "id", "role"):
                words = SPLIT.split(value)
                if not MARKS.isdisjoint(words) and tag not in ARTICLE and tag not in HEADLINE:
                    drop = True
                elif not MARKS.isdisjoint(words) and "comment" in " ".join(words):
                    drop = True
                if name == "class" and not first:
                    first = next((w for w in words if w), "")
    return drop, first


def tree(page: str) -> Node:
    """DOM tree of block elements and text runs; inline markup is text of its block."""
    root = Node("")
    stack: list[tuple[str, Node]] = [("", root)]
    buffer: list[str] = []
    skip = 0  # depth of inline furniture

    def flush() -> None:
        if buffer:
            text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                stack[-1][1].children.append(Node("#", text))

    def close(names: set[str], stops: set[str]) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return True
            if stack[k][0] in stops:
                return False
        return False

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            data = m[0]
            if data[0] != "<" or len(data) == 1:
                if not skip:
                    buffer.append(data)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if skip:
                if tag in VOID:
                    continue
                skip += -1 if m[1] else 1
            elif not m[1] and tag not in VOID and m[3] and _furniture(tag, m[3])[0]:
                skip = 1
            continue
        if skip:
            skip = 0  # a block ends unclosed inline elements
        if m[1]:
            if tag == "br":
                buffer.append(" ")
            elif tag == "p":
                close({"p"}, {"div", "article", "section", "body", "td", "li", "blockquote"})
            else:
                close({tag}, set())
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        flush()
        if tag in ENDS_P:
            close({"p"}, {"div", "article", "section", "body", "td", "li", "blockquote", "table", "button"})
        if tag in CLOSES:
            close(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        drop, first = _furniture(tag, m[3] or "")
        node = Node(f"{tag}.{first}" if first else tag, furniture=drop, article=tag in ARTICLE or 'role="main"' in (m[3] or ""))
        stack[-1][1].children.append(node)
        if tag in VOID or (m[3] or "").endswith("/") and tag not in ENDS_P:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        stack.append((tag, node))
    flush()
    return root


def number(node: Node, key: int = 0) -> int:
    """Gives the nodes their numbers, in page order; returns the next one."""
    stack = [node]
    while stack:
        n = stack.pop()
        n.key = key
        key += 1
        stack.extend(reversed(n.children))
    return key


def _matching(model: Node, page: Node) -> dict:
    """Simple tree matching of all pairs of nodes that can meet: (weight, table of the children's alignment).

    The weight of a pair is that of the largest order-keeping matching of the two trees.  Equal
    texts weigh a little more, so that of equal matchings the one with more agreement wins.  Pairs
    are found level by level and weighed from the bottom up, so depth needs no recursion.
    """
    levels = [[(model, page)] if model.label == page.label else []]
    while levels[-1]:
        levels.append([
            (x, y) for a, b in levels[-1] for x in a.children for y in b.children if x.label == y.label
        ])
    weights: dict = {}
    for level in reversed(levels):
        for a, b in level:
            if a.label == "#":
                weights[id(a), id(b)] = (3 if a.text == b.text else 2, None)
                continue
            m, n = len(a.children), len(b.children)
            table = [[0] * (n + 1) for _ in range(m + 1)]
            for i in range(1, m + 1):
                row, above, child = table[i], table[i - 1], id(a.children[i - 1])
                for j in range(1, n + 1):
                    best = above[j] if above[j] >= row[j - 1] else row[j - 1]
                    pair = weights.get((child, id(b.children[j - 1])))
                    if pair and above[j - 1] + pair[0] > best:
                        best = above[j - 1] + pair[0]
                    row[j] = best
            weights[id(a), id(b)] = (table[m][n] + 2, table)
    return weights


def matched(model: Node, page: Node) -> list[tuple[Node, Node]]:
    """Matched pairs (model node, page node)."""
    weights = _matching(model, page)
    out, stack = [], [(model, page)] if weights else []
    while stack:
        a, b = stack.pop()
        out.append((a, b))
        if a.label == "#":
            continue
        table = weights[id(a), id(b)][1]
        i, j = len(a.children), len(b.children)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                stack.append((a.children[i - 1], b.children[j - 1]))
                i, j = i - 1, j - 1
    return out


def aligned(model: Node, page: Node) -> list[tuple[Node, Node]]:
    """Matched pairs of text runs."""
    return [(a, b) for a, b in matched(model, page) if a.label == "#"]


def _tag(node: Node) -> str:
    return node.label.partition(".")[0]


class Template:
    """The model tree of a host and, once votes are counted, what they say of its nodes."""

    def __init__(self, model: str):
        self.root = tree(model)
        number(self.root)
        self.inside: set[int] = set()  # text runs of the model's marked articles
        stack = [(self.root, False)]
        while stack:
            n, article = stack.pop()
            article = article or n.article
            if article and n.label == "#":
                self.inside.add(n.key)
            stack.extend((c, article) for c in n.children)
        self.constant: set[int] = set()
        self.furniture: set[int] = set()
        self.articles: set[int] = set()
        self.region: int | None = None

    def ballot(self, page: Node) -> dict[int, list[int]]:
        """Votes of a page per model node: met, same, varying characters, varying headings, marked as furniture or article.

        Text that the model lacks counts for the nearest matched element above.  The keys -1 and -2
        count the pages that vote at all and inside articles.
        """
        pairs = matched(self.root, page)
        to = {id(b): a for a, b in pairs}
        votes = {-1: [1, 0, 0, 0, 0, 0]}
        total, stack = 0, [(page, self.root, False, False)]
        while stack:
            n, near, head, article = stack.pop()
            match = to.get(id(n))
            near, article = match or near, article or n.article
            if n.label != "#":
                if match:
                    vote = votes.setdefault(match.key, [0] * 6)
                    vote[0] += 1
                    vote[5] += n.article
                if n.furniture:
                    if match:
                        votes[match.key][4] += 1
                    continue
                head = head or _tag(n) in HEADLINE
                stack.extend((c, near, head, article) for c in n.children)
                continue
            total += len(n.text) if article else 0
            if match is None or match.text != n.text:
                vote = votes.setdefault(near.key, [0] * 6)
                vote[2] += len(n.text)
                vote[3] += head
        agreed = sum(len(a.text) for a, b in pairs if a.key in self.inside and a.text == b.text)
        judge = total > 0 and 2 * agreed <= total
        if judge:
            votes[-2] = [1, 0, 0, 0, 0, 0]
        for a, b in pairs:
            if a.label == "#" and (judge or a.key not in self.inside):
                vote = votes.setdefault(a.key, [0] * 6)
                vote[0] += 1
                vote[1] += a.text == b.text
        return votes

    def elect(self, votes: dict[int, tuple]) -> Template:
        """Draws the conclusions from the summed votes of a host."""
        none = (0, 0, 0, 0, 0, 0)
        pages, judges = votes.get(-1, none)[0], votes.get(-2, none)[0]
        order, stack = [], [self.root]
        while stack:
            n = stack.pop()
            order.append(n)
            stack.extend(n.children)
        chars, heads = {}, {}
        for n in reversed(order):
            met, same, varying, headings, marked, article = votes.get(n.key, none)
            if n.label == "#":
                voters = judges if n.key in self.inside else pages
                if voters >= LEAST_PAGES and same >= CONSTANT * voters:
                    self.constant.add(n.key)
            elif met and 2 * marked >= met:
                self.furniture.add(n.key)
            elif met and 2 * article >= met:
                self.articles.add(n.key)
            alive = [c.key for c in n.children if c.key not in self.furniture]
            chars[n.key] = varying + sum(chars[k] for k in alive)
            heads[n.key] = headings + sum(heads[k] for k in alive)
        at = self.root
        least, least_heads = REGION * chars[at.key], REGION * heads[at.key]
        while least > 0 and at.key not in self.articles:
            inner = next((
                c for c in at.children if c.label != "#" and _tag(c) not in TEXTUAL and c.key not in self.furniture
                and chars[c.key] >= least and heads[c.key] >= least_heads), None)
            if inner is None:
                break
            at = inner
        self.region = at.key if at is not self.root else None
        return self

    def text(self, page: Node) -> str:
        """Text of a page of the host."""
        constant, furniture, main, region = set(), set(), set(), None
        for a, b in matched(self.root, page):
            if a.label == "#":
                if a.key in self.constant and a.text == b.text:
                    constant.add(id(b))
            elif a.key in self.furniture:
                furniture.add(id(b))
            elif a.key in self.articles:
                main.add(id(b))
            elif a.key == self.region:
                region = b
        return content(page, constant, furniture, main, region)


def content(
    page: Node, constant: set[int], furniture: set[int] = frozenset(), main: set[int] = frozenset(), region: Node | None = None
) -> str:
    """Blocks of the page inside its articles or region, outside furniture and template; sets of ``id``."""

    def articles(top: Node) -> list[Node]:
        found, stack = [], [top]
        while stack:
            n = stack.pop()
            if n.furniture or id(n) in furniture:
                continue
            if n.article or id(n) in main:
                found.append(n)
            else:
                stack.extend(n.children)
        return found

    roots = {id(n) for n in articles(page)}
    if region is not None and not articles(region):
        if roots:  # marked articles that hold the region or stand beside it
            stack = [n for n in [page] if id(n) not in roots]
            beside = False
            while stack:
                n = stack.pop()
                beside = beside or n is region
                stack.extend(c for c in n.children if id(c) not in roots)
            if beside:
                roots.add(id(region))
        else:
            roots = {id(region)}
    blocks = []
    stack = [(page, not roots)]
    while stack:
        n, inside = stack.pop()
        inside = inside or id(n) in roots
        if n.furniture or id(n) in furniture:
            continue
        if n.label == "#":
            if inside and id(n) not in constant:
                blocks.append(n.text)
        else:
            stack.extend((c, inside) for c in reversed(n.children))
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, or null."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


class _Kept:
    """The templates that a task has met, as many as ``KEPT_CHARS`` characters of model pages."""

    def __init__(self):
        self.known: dict = {}
        self.chars = 0

    def __call__(self, key, model: str, votes=None) -> Template:
        if key not in self.known:
            if self.chars + len(model) > KEPT_CHARS:
                self.known.clear()
                self.chars = 0
            found = Template(model)
            if votes is not None:
                found.elect({v["node"]: tuple(v[c] for c in TALLY) for v in votes})
            self.known[key] = found
            self.chars += len(model)
        return self.known[key]


TALLY = ("met", "same", "chars", "heads", "marked", "article")


def _votes(batches):
    """Votes of the pages of a batch, summed per host and model node."""
    kept = _Kept()
    for frame in batches:
        rows: dict[tuple[str, int], list[int]] = {}
        for host, page, model in zip(frame["host"], frame["html"], frame["model"]):
            for key, vote in kept(host, model).ballot(tree(page)).items():
                held = rows.setdefault((host, key), [0] * len(TALLY))
                for k, x in enumerate(vote):
                    held[k] += x
        yield pd.DataFrame([(h, k, *v) for (h, k), v in rows.items()], columns=["host", "node", *TALLY])


def templates(pages: DataFrame) -> DataFrame:
    """Table (host, model, votes): model html and the votes on its nodes, no more than it has nodes and two."""
    different = pages.filter("host is not null").groupBy("host", F.xxhash64("html").alias("h")).agg(
        F.min(F.struct(F.abs(F.length("html") - MODEL_CHARS).alias("far"), F.col("page_id").alias("page_id"))).alias("near"),
        F.count(F.lit(1)).alias("copies"),
    )
    different = materialise(different.select("host", "h", "near", F.col("near.page_id").alias("first"), "copies"))
    chosen = materialise(
        different.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near"))
        .filter(F.col("n") >= LEAST_PAGES).select("host", "n", "near.page_id")
    )
    models = materialise(
        pages.select("host", "page_id", F.col("html").alias("model")).join(chosen, ["host", "page_id"])
        .groupBy("host").agg(F.min("model").alias("model"), F.max("n").alias("n"))
    )
    # Of pages with equal html the one with the least id votes; only html that occurs again needs a look-up.
    again = materialise(different.filter("copies > 1").select("host", "h", "first"))
    voting = (
        pages.withColumn("h", F.xxhash64("html")).join(again, ["host", "h"], "left")
        .filter(F.col("first").isNull() | (F.col("page_id") == F.col("first"))).join(models.select("host", "model"), "host")
    )
    votes = voting.select("host", "html", "model").mapInPandas(
        _votes, "host string, node int, " + ", ".join(f"{c} long" for c in TALLY)
    )
    summed = votes.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in TALLY])
    told = summed.groupBy("host").agg(F.collect_list(F.struct("node", *TALLY)).alias("votes"))
    return materialise(models.select("host", "model").join(told, "host"))


def _extract(batches):
    kept = _Kept()
    for b in batches:
        out = []
        votes = b["votes"]
        for k, (host, page, model) in enumerate(zip(*(b[c].to_pylist() for c in ("host", "html", "model")))):
            root = tree(page)
            if model is None:
                out.append(content(root, set()))
            else:
                told = votes[k].as_py() if host not in kept.known else None
                out.append(kept(host, model, told).text(root))
        yield pa.RecordBatch.from_arrays(
            [b["page_id"], b["url"], pa.array(out, pa.string())], ["page_id", "url", "text"]
        )


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Table (page_id, url, text) with one row per input row."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    known = templates(rows).withColumnRenamed("host", "key")
    # Pages without a host meet no template; keys of their own keep them off one task.
    key = F.coalesce("host", F.concat(F.lit(" "), F.xxhash64("page_id", "html").cast("string")))
    told = rows.withColumn("key", key).join(known, "key", "left")
    return told.select("page_id", "url", "host", "html", "model", "votes").mapInArrow(
        _extract, "page_id long, url string, text string"
    )
