"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is a container's tag with its class and id and with its role on the
page (below), under its parent's node; it has presentations (the sequences of child containers seen on its pages). The
blocks of text directly in a container are a leaf below it, whose contents are these blocks. Nothing is left out of the
tree: menus and adverts are nodes like all others.

*Importance.* A node shown on n pages has as its own importance the entropy of its presentations to the base n, a leaf
1 less the mean of ``log c / log n`` over the blocks that it shows, c being the pages that show a block; so both are 0 where
all pages are alike, and 1 where each differs. Importance is composed over levels: of a node it is the mean over its
subtree, in which presentations of a node seen on n pages d levels below weigh ``(1 - DECAY) * DECAY ** d * n`` and a leaf
that shows s blocks ``DECAY ** d * s``. Nodes on fewer than ``PAGES`` pages of a host are taken as important (1). Equal
pages of a host count once, so that copies of an article do not make it noise.

*Markup is a feature of a node.* Its role says what the page tells of it: noise (navigation, header, footer, sidebar, form,
notice, advert or comment by tag, role or class), article (an article or main element, or else a container named like one),
part (a container within the article of which the page says no more), around (it holds the article), beside (the page has
an article elsewhere) or plain. ``score`` is ``TOLD * expected + (1 - TOLD) * importance``, expected being 0 for noise and
beside, 1 for article and around, 0.5 for parts and plain nodes. Nodes that score below ``CUT`` are cut from each page with
all that is below them.

With these weights a page's own word outweighs the entropies where the two disagree, as the contents of menus may be as
varied as articles and passages of articles may repeat; the entropies decide about plain containers and parts of articles.

*Parts.* An advert or notice within an article repeats while the articles differ; a part also repeats where the articles are
copies or near copies of each other. So a part is cut only if what else is in the articles that show it is different: each
page gives ``SLOTS`` minimum hashes of the article's blocks outside the part, long blocks being likelier to be the minimum, so
that they agree about as often as these texts are alike; ``rest``, the same measure over them as that over the blocks of a
leaf, has to be ``REST``. A part with more than half of a page's article counts as all of it, and the blocks directly in a
part go or stay with it.

Counts are combined before they are exchanged. Cut nodes are 64-bit hashes that hold the host: up to ``HELD`` of them go to
the tasks as one array, and html does not move; beyond that each page gets its own cut nodes by a join.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import rows_of, scratch, short_batches, table, written

#: Pages of a host that are needed to tell; weight of a level; weight of what the markup tells; scores below are cut.
PAGES, DECAY, TOLD, CUT = 5, 0.9, 0.6, 0.45
#: Levels up to which a node counts for those above it: what lies deeper weighs less than a billionth.
LEVELS = 200
#: Minimum hashes of what else is in an article; how different it has to be for a part to be cut.
SLOTS, REST = 8, 0.5
#: Cut nodes that are sent to the tasks as an array of 8 bytes each.
HELD = 1_000_000
EXPECTED = {"noise": 0.0, "beside": 0.0, "plain": 0.5, "part": 0.5, "around": 1.0, "article": 1.0}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes"}
_UNSEEN = _RAW | {"head"}
_DROPPED = _UNSEEN | {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "svg", "math", "canvas", "object", "dialog", "datalist", "video", "audio", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "section", "article", "main", "figure", "figcaption", "address", "hr", "body", "html", "details", "summary", "fieldset", "hgroup", "center"} | _DROPPED
_CONTAINERS = {"div", "section", "article", "main", "ul", "ol", "dl", "table", "blockquote", "figure", "body", "td", "details", "center", "span"} | (_DROPPED - _UNSEEN)
_MAIN = {"article", "main"}
#: No parts of their own: cells belong to their table, spans to a line.
_INNER = {"td", "span"}
#: Classes and ids of containers that hold the article where neither tag does.
_MAIN_NAMES = {"article", "article-body", "article-content", "post", "post-body", "post-content", "entry", "entry-body", "entry-content", "story", "story-body", "main", "main-content", "content", "page-content"}
_NOISY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|sharing|social|sidebar|side-bar|widget|related|recommend\w*|breadcrumbs?|pagination|pager|nav|navbar|navigation|menu|topbar|masthead|header|footer|copyright|comments?|commentlist|respond|disqus|replies|login|search|toolbar|skip-link|hidden)(?:$|[\s_-])", re.I)
_ASIDE = {"comment", "comments", "reply", "related", "teaser", "ad", "advert", "advertisement", "sponsored", "promo"}
_BESIDE = re.compile(r"(?:with|has|no|without)[-_][\w-]+", re.I)  # "content-with-sidebar" is no sidebar
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: An opening tag of the same kind ends these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _is_noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    if tag == "article":  # a reader's comment or a teaser may be one too
        return not _ASIDE.isdisjoint(attributes.get("class", "").lower().split())
    names = _BESIDE.sub(" ", attributes.get("class", "") + " " + attributes.get("id", ""))
    return (
        _NOISY.search(names) is not None
        or attributes.get("role", "").lower() in _ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    )


class Node:
    __slots__ = ("above", "name", "noise", "main", "said", "children", "texts", "holds")

    def __init__(self, above: int, name: str, noise: bool, main: int, said: bool) -> None:
        self.above, self.name, self.noise, self.main, self.said = above, name, noise, main, said
        self.children: list[int] = []
        self.texts: list[int] = []
        self.holds = 0


class Page:
    """A page's containers (``nodes``, parents first) and blocks of text (``blocks``: node and text, in page order).

    ``main`` of a node is 2 in an article or main element, 1 in a container named like one, else 0; ``said`` tells that it is
    no part of an article by itself: an article, named like one, a cell or a span; ``noise`` says that it or a node above it
    is noise by its markup.
    """

    def __init__(self, html: str | None) -> None:
        self.nodes = [Node(-1, "body", False, 0, False)]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int, bool]] = [("body", 0, False)]  # tag, node, unseen
        words: list[str] = []
        raw = ""
        for m in _TOKEN.finditer(html or ""):
            closing, tag, rest, text = m[2], m[3], m[4], m[5] or m[1]
            if raw and not (closing and tag and tag.lower() == raw):
                continue
            if text is not None:
                if not stack[-1][2]:
                    words.append(text)
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if tag in _BLOCKS:
                self._end(words, stack[-1][1])
            elif tag == "br":
                words.append(" ")
            if closing:
                raw = ""
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in _MAIN or stack[k][0] in _DROPPED and tag not in _BLOCKS:
                        break  # a stray end tag does not close what encloses it
                continue
            if tag in _VOID or tag in ("html", "body", "p") or tag not in _BLOCKS and tag not in _CONTAINERS:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _CLOSES.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table"):
                    break
            if rest.endswith("/") and tag not in _RAW:
                continue
            attributes = _attributes(rest)
            _, at, unseen = stack[-1]
            unseen = unseen or tag in _UNSEEN
            noise = self.nodes[at].noise or _is_noise(tag, attributes)
            own = 0
            if tag in _MAIN or attributes.get("role", "").lower() == "main" or "articlebody" in attributes.get("itemprop", "").lower():
                own = 2
            elif not _MAIN_NAMES.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()):
                own = 1
            main = max(own, self.nodes[at].main)
            if not unseen and (tag in _CONTAINERS or (noise, main) != (self.nodes[at].noise, self.nodes[at].main)):
                name = " ".join(filter(None, (tag, attributes.get("class", ""), attributes.get("id", ""))))
                self.nodes.append(Node(at, name, noise, main, own > 0 or tag in _INNER))
                self.nodes[at].children.append(len(self.nodes) - 1)
                at = len(self.nodes) - 1
            stack.append((tag, at, unseen))
            if tag in _RAW:
                raw = tag
        self._end(words, stack[-1][1])
        for at, _ in self.blocks:
            node = self.nodes[at]
            if not node.noise:
                node.holds = max(node.holds, node.main)
        for node in reversed(self.nodes):
            if node.above >= 0:
                self.nodes[node.above].holds = max(self.nodes[node.above].holds, node.holds)
        self.most = self.nodes[0].holds

    def _end(self, words: list[str], at: int) -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if text:
                self.nodes[at].texts.append(len(self.blocks))
                self.blocks.append((at, text))

    def role(self, node: Node, leaf: bool = False) -> str:
        if node.noise:
            return "noise"
        if not self.most:
            return "plain"
        if node.main == self.most:
            return "article" if node.said or leaf else "part"
        return "around" if node.holds == self.most and not leaf else "beside"

    def names(self) -> list[str]:
        """Of each node, with its role."""
        return [f"{n.name}|{self.role(n)}" for n in self.nodes]

    def text(self, cut=None) -> str:
        """The blocks in page order, without those of branches that are cut: ``cut`` is asked for a node's number and its
        role, and for those of its leaf. Without ``cut`` the branches go that the markup speaks against."""
        cut = cut or (lambda k, role, leaf: EXPECTED[role] == 0)
        gone: list[bool] = []
        for k, node in enumerate(self.nodes):
            gone.append(k > 0 and (gone[node.above] or cut(k, self.role(node), False)))
        kept = {k: not gone[k] and not cut(k, self.role(self.nodes[k], True), True) for k in {at for at, _ in self.blocks}}
        return "\n".join(text for at, text in self.blocks if kept[at])


def hashed(text: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text, seed & ((1 << 64) - 1)) - (1 << 63)


def hashes(page: Page, root: int) -> tuple[list[int], list[int]]:
    """Of each node and of its leaf: ``root`` tells the host, and each name is hashed with what is above it as the seed."""
    own: list[int] = []
    for node, name in zip(page.nodes, page.names(), strict=True):
        own.append(hashed(name, own[node.above] if node.above >= 0 else root))
    return own, [hashed(f"#{page.role(n, True)}", h) for n, h in zip(page.nodes, own, strict=True)]


_NODES = "node long, above array<long>, expected double, forms array<long>, contents array<long>, rest array<long>, same long, root long"
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]+)"


def _rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, root, same): root tells the host, same the html."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.xxhash64(host).alias("root"), F.xxhash64(html).alias("same"))


def page_nodes(page: Page, root: int) -> dict[int, tuple[list[int], float, set[int], set[int]]]:
    """For each node of a page: those above it (nearest first), what its role lets expect, its presentations and contents."""
    own, leaf = hashes(page, root)
    names = page.names()
    out: dict[int, tuple[list[int], float, set[int], set[int]]] = {}
    for k, node in enumerate(page.nodes):
        above, up = [], node.above
        while up >= 0 and len(above) < LEVELS:
            above.append(own[up])
            up = page.nodes[up].above
        found = out.setdefault(own[k], (above, EXPECTED[page.role(node)], set(), set()))
        if node.children:
            found[2].add(hashed("/".join(names[c] for c in node.children)))
        if node.texts:
            found = out.setdefault(leaf[k], ([own[k], *above][:LEVELS], EXPECTED[page.role(node, True)], set(), set()))
            found[3].update(hashed(page.blocks[b][1]) for b in node.texts)
    return out


def slots(text: str) -> list[int]:
    return [(hashed(text, i + 1) + (1 << 63)) // (2 * len(text)) for i in range(SLOTS)]


def page_rests(page: Page, root: int) -> dict[int, list[int]]:
    """For each part of the article that shows text: minimum hashes of the article's blocks outside it, or numbers that are the
    same on all pages if more than half of the article is in it."""
    if not any(page.role(n) == "part" for n in page.nodes):
        return {}
    blocks = [(at, text) for at, text in page.blocks if page.role(page.nodes[at], True) == "article"]
    first, last = [len(blocks)] * len(page.nodes), [0] * len(page.nodes)  # a container's blocks follow each other
    for b, (at, _) in enumerate(blocks):
        first[at], last[at] = min(first[at], b), b + 1
    for k in range(len(page.nodes) - 1, 0, -1):
        up = page.nodes[k].above
        first[up], last[up] = min(first[up], first[k]), max(last[up], last[k])
    own, _ = hashes(page, root)
    inside: dict[int, list[tuple[int, int]]] = {}
    for k, node in enumerate(page.nodes):
        if first[k] < last[k] and page.role(node) == "part":
            inside.setdefault(own[k], []).append((first[k], last[k]))
    if not inside:
        return {}
    chars = np.cumsum([0, *(len(text) for _, text in blocks)])
    least = [np.fromiter((x for _, text in blocks for x in slots(text)), np.int64).reshape(-1, SLOTS)]
    while len(least[-1]) > 1:  # [j][b]: of 2 ** j blocks from b * 2 ** j on
        least.append(np.minimum(least[-1][:-1:2], least[-1][1::2]))
    out = {}
    for key, spans in inside.items():
        if 2 * sum(chars[b] - chars[a] for a, b in spans) > chars[-1]:
            out[key] = list(range(SLOTS))
            continue
        found, begin = [], 0
        for a, b in [*spans, (len(blocks), len(blocks))]:
            for level in least:
                if begin >= a:
                    break
                if begin & 1:
                    found.append(level[begin])
                if a & 1:
                    found.append(level[a - 1])
                begin, a = (begin + 1) >> 1, a >> 1
            begin = b
        out[key] = np.min(found, axis=0).tolist()
    return out


def tree_nodes(pages: DataFrame) -> DataFrame:
    """(node, above, expected, forms, contents, rest, same, root) of every node of every distinct page of a host, written: a row
    for each page that shows the node. Leaves have no forms (presentations), others no contents, only parts a rest."""
    short_batches(pages.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        longs = pa.list_(pa.int64())
        types, names = (pa.int64(), longs, pa.float64(), longs, longs, longs, pa.int64(), pa.int64()), ["node", "above", "expected", "forms", "contents", "rest", "same", "root"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for htmls, roots, sames in rows_of(batches, "html", "root", "same"):
            out: list[tuple] = []
            for html, root, same in zip(htmls, roots, sames, strict=True):
                page = Page(html)
                rests = page_rests(page, root)
                out += [(k, above, expected, sorted(forms), sorted(contents), rests.get(k, []), same, root) for k, (above, expected, forms, contents) in page_nodes(page, root).items()]
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return written(_rows(pages).select("html", "root", "same").mapInArrow(run, _NODES).dropDuplicates(["node", "same"]), "nodes")


def node_scores(nodes: DataFrame, least_pages: int = PAGES) -> DataFrame:
    """(node, pages, importance, score, rest) of every node of the trees; only parts have a rest."""
    shown = nodes.groupBy("node").agg(F.count("*").alias("n"), F.any_value("above").alias("above"), F.any_value("expected").alias("expected"), F.count_if(F.size("rest") > 0).alias("parts"))
    # Entropy of the presentations, to the base of the pages: (log n - sum(c log c) / n) / log n.
    by_form = nodes.select("node", F.explode("forms").alias("x")).groupBy("node", "x").agg(F.count("*").alias("c"))
    form = by_form.groupBy("node").agg(F.sum("c").alias("forms"), F.sum(F.col("c") * F.log2("c")).alias("form_logs"))
    # Leaves have contents and parts a rest, and both are measured alike.
    block = nodes.select("node", F.explode(F.concat("contents", "rest")).alias("x")).groupBy("node", "x").agg(F.count("*").alias("c"))
    content = block.groupBy("node").agg(F.sum("c").alias("blocks"), F.sum(F.col("c") * F.log2("c")).alias("block_logs"))
    each = shown.join(form, "node", "left").join(content, "node", "left")
    log = F.log2(F.greatest("n", "forms"))
    own_form = F.when(log > 0, F.log2("forms") / log - F.col("form_logs") / F.col("forms") / log).otherwise(1.0)
    spread = lambda n: F.when(n > 1, 1 - F.col("block_logs") / F.col("blocks") / F.log2(F.greatest(n, F.lit(2)))).otherwise(1.0)
    is_part, own_content = F.col("parts") > 0, spread(F.col("n"))
    form_weight, block_weight = (1 - DECAY) * F.coalesce("forms", F.lit(0)), F.when(is_part, 0.0).otherwise(F.coalesce("blocks", F.lit(0)).cast("double"))
    each = each.withColumns({"rest": F.when(F.col("parts") >= least_pages, spread(F.col("parts"))).when(is_part, 0.0), "weight": form_weight + block_weight, "sum": form_weight * F.coalesce(own_form, F.lit(0.0)) + block_weight * F.coalesce(own_content, F.lit(0.0))})
    each = written(each.select("node", "n", "above", "expected", "weight", "sum", "rest"), "tree")  # read twice
    up = each.select(F.posexplode(F.concat(F.array("node"), F.col("above"))).alias("d", "to"), "weight", "sum")
    decay = F.pow(F.lit(DECAY), F.col("d"))
    composed = up.groupBy("to").agg(F.sum(decay * F.col("sum")).alias("s"), F.sum(decay * F.col("weight")).alias("w"))
    composed = composed.select(F.col("to").alias("node"), F.when(F.col("w") > 0, F.col("s") / F.nullif("w", F.lit(0.0))).otherwise(0.0).alias("composed"))
    importance = F.when(F.col("n") < least_pages, 1.0).otherwise(F.col("composed"))
    return each.join(composed, "node").select("node", F.col("n").alias("pages"), importance.alias("importance"), (TOLD * F.col("expected") + (1 - TOLD) * importance).alias("score"), "rest")


def cut_nodes(scores: DataFrame, cut: float = CUT) -> DataFrame:
    """(node) of the nodes to cut: of low score and, if parts of articles, of articles that else differ."""
    return scores.where((F.col("score") < cut) & (F.coalesce("rest", F.lit(1.0)) >= REST)).select("node")


def extract(pages: DataFrame, least_pages: int = PAGES, cut: float = CUT, held: int = HELD) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null and empty html give the empty text; null and odd urls form a host of their own; repeated rows stay.
    """
    spark = pages.sparkSession
    short_batches(spark)
    rows = _rows(pages)
    with scratch(spark) as keep:
        nodes = tree_nodes(pages)
        noise = written(cut_nodes(node_scores(nodes, least_pages), cut), "noise")
        if noise.count() <= held:
            sent = spark.sparkContext.broadcast(np.sort(noise.toArrow()["node"].to_numpy()))  # 8 bytes for each of at most ``held``
            rows = rows.select("page_id", "url", "html", "root", F.lit(None).cast("array<long>").alias("gone"))
        else:
            sent = None
            of_page = nodes.join(noise, "node").groupBy("root", "same").agg(F.collect_set("node").alias("gone"))  # a page's own nodes
            rows = rows.join(of_page, ["root", "same"], "left").select("page_id", "url", "html", "root", "gone")
            keep(nodes, noise)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        every = frozenset(sent.value.tolist()) if sent is not None else None
        for keys, urls, htmls, roots, gone in rows_of(batches, "page_id", "url", "html", "root", "gone"):
            texts = []
            for html, root, mine in zip(htmls, roots, gone, strict=True):
                page, found = Page(html), every if every is not None else frozenset(mine or ())
                own, leaf = hashes(page, root)
                texts.append(page.text(lambda k, role, at_leaf: (leaf if at_leaf else own)[k] in found))  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
