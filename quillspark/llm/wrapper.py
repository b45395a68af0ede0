"""Main text of web pages by wrapper induction.

Pages of one host and of one shape (the set of structural tags they use) are made from one template.
Each such family has a seed page; every page's DOM tree is aligned with it by simple tree matching
(the heaviest order-preserving match of two trees whose matched nodes have equal tags and matched
parents; a pair whose classes are equal, too, weighs twice as much). Over all pages of the family, a
seed node whose own text is mostly the seed's is template, and any other a varying slot. Text of a
page that nothing in the seed matches counts for the slot it stands in.

Menus and adverts vary, too, and no alignment tells them from content. So each page votes by its
marks (tags, roles, class names) on the seed nodes it matches, and what most pages mark as
boilerplate is no slot for content. The content slot is the deepest node with most of the other
varying text, and headings that vary elsewhere belong to it. A page's text is what its nodes at the
slot hold, template texts left out.

Pages that are copies of the seed say nothing about what varies. A family with fewer than three other
pages has no wrapper; its pages, and pages that have nothing at the slot, go by their own marks.

Seeds and slots are sent to the executors if they are small together, and else are joined by family.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

SMALL = 32 << 20
#: A node is template from this share of equal texts on; a page that shares so many letters with the
#: seed is a copy; a slot holds so much of the varying text; so many pages make a wrapper.
SAME = 0.8
COPY = 0.9
MASS = 0.9
LEAST = 3
#: Pages of a family that one task takes where seeds are joined.
FAMILY_ROWS = 50_000
#: Pairs of children from which a match is computed row by row in place of a whole table.
CELLS = 400

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "title", "legend"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
STRUCTURE = ("header", "nav", "main", "article", "section", "aside", "footer", "form", "table")
HEADINGS = frozenset("h1 h2 h3".split())
DROPPED = frozenset("head title nav footer aside form script style noscript iframe template select button svg canvas object dialog textarea input menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?\w*|consent|notices?|popup|modal|newsletter|subscribe|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|comment-?list|disqus|respond|replies|share|social|related|widgets?)(?=[\s_-]|$)", re.I)


class Node:
    __slots__ = ("tag", "names", "kids", "shape", "index", "label", "size")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.kids, self.shape, self.index, self.size = tag, names, [], None, -1, 0
        self.label = tag if not names else tag + re.sub(r"\d+", "", names)

    def nodes(self) -> list["Node"]:
        return [k for k in self.kids if isinstance(k, Node)]

    def own_text(self) -> str:
        return " ".join(" ".join(k for k in self.kids if isinstance(k, str)).split())


def parse(html: str) -> Node:
    """A tree of what browsers would make of the page, nearly: end tags may be missing, stray ones
    are ignored, a tag or comment cut off at the end is dropped."""
    root = Node("#root")
    stack, at = [root], 0
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attrs = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        elif tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE[tag]:
                    break
        names = ""
        if attrs and attrs != "/":
            names = " ".join(f"{a.lower()}={b or c or d or ''}" for a, b, c, d in ATTR.findall(attrs))
        node = Node(tag, names)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not (attrs or "").endswith("/") or tag in ("p", "div", "article", "section"):
            stack.append(node)
    if at < len(html):
        stack[-1].kids.append(html[at:])
    return root


def number(root: Node) -> list[Node]:
    """Numbers the nodes in page order and marks each with the shape and weight of its subtree."""
    order: list[Node] = []
    todo = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            inner = node.nodes()
            node.shape = hash((node.label, *(k.shape for k in inner)))
            node.size = 2 + sum(k.size for k in inner)
            continue
        node.index = len(order)
        order.append(node)
        todo.append((node, True))
        todo += [(k, False) for k in reversed(node.nodes())]
    return order


def weight(a: Node, b: Node, memo: dict) -> int:
    """Weight of the heaviest match of two trees: 2 for each pair of nodes with equal classes, 1 for
    others; 0 if the roots' tags differ. Trees of any depth: what a pair needs is put on a list."""
    if a.tag != b.tag:
        return 0
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        key = (p.shape, q.shape)
        if key in memo:
            todo.pop()
            continue
        if p.shape == q.shape:
            memo[key] = p.size
            todo.pop()
            continue
        x, y = p.nodes(), q.nodes()
        start, end = same_ends(x, y)
        xs, ys = ({n.shape: n for n in z[start : len(z) - end]}.values() for z in (x, y))
        missing = [(u, v) for u in xs for v in ys if u.tag == v.tag and (u.shape, v.shape) not in memo]
        if missing:
            todo += missing
            continue
        own = 2 if p.label == q.label else 1
        memo[key] = own + sum(n.size for n in x[:start]) + sum(n.size for n in x[len(x) - end :]) + int(last_row(x[start : len(x) - end], y[start : len(y) - end], memo)[-1])
        todo.pop()
    return memo[a.shape, b.shape]


def known(p: Node, q: Node, memo: dict) -> int:
    return memo[p.shape, q.shape] if p.tag == q.tag else 0


def same_ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """How many nodes at the start and at the end have the same shape; a heaviest match has them."""
    most, start, end = min(len(x), len(y)), 0, 0
    while start < most and x[start].shape == y[start].shape:
        start += 1
    while end < most - start and x[-1 - end].shape == y[-1 - end].shape:
        end += 1
    return start, end


def table(x: list[Node], y: list[Node], memo: dict) -> list[list[int]]:
    m = [[0] * (len(y) + 1)]
    for p in x:
        above, row = m[-1], [0]
        for j, q in enumerate(y):
            best = max(above[j + 1], row[j])
            if p.tag == q.tag:
                best = max(best, above[j] + memo[p.shape, q.shape])
            row.append(best)
        m.append(row)
    return m


def last_row(x: list[Node], y: list[Node], memo: dict) -> np.ndarray:
    """The last row of ``table``; of long lists, with no more than one row held."""
    if len(x) * len(y) <= CELLS:
        return np.array(table(x, y, memo)[-1], np.int64)
    kinds: dict[tuple, int] = {}
    index = np.array([kinds.setdefault((q.tag, q.shape), len(kinds)) for q in y], np.int64)
    first = [y[i] for i in np.unique(index, return_index=True)[1]]
    row = np.zeros(len(y) + 1, np.int64)
    for p in x:
        w = np.array([known(p, q, memo) for q in first], np.int64)[index]
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
    return row


def paired(x: list[Node], y: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The pairs of children in a heaviest match. Long lists are halved where the matches of both
    halves are heaviest together, so no table of all cells is held."""
    out, todo = [], [(x, y)]
    while todo:
        x, y = todo.pop()
        start, end = same_ends(x, y)
        out += list(zip(x[:start], y[:start])) + list(zip(x[len(x) - end :], y[len(y) - end :]))
        x, y = x[start : len(x) - end], y[start : len(y) - end]
        if len(x) * len(y) > CELLS and len(x) > 1:
            half = len(x) // 2
            at = int(np.argmax(last_row(x[:half], y, memo) + last_row(x[: half - 1 : -1], y[::-1], memo)[::-1]))
            todo += [(x[:half], y[:at]), (x[half:], y[at:])]
            continue
        m = table(x, y, memo)
        i, j = len(x), len(y)
        while i and j:
            w = known(x[i - 1], y[j - 1], memo)
            if w and m[i][j] == m[i - 1][j - 1] + w:
                out.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


def align(a: Node, b: Node, memo: dict) -> list[tuple[Node, Node]]:
    """The pairs of a heaviest match."""
    out, todo = [], [(a, b)] if a.tag == b.tag else []
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        x, y = a.nodes(), b.nodes()
        if a.shape == b.shape:
            todo += zip(x, y)
        else:
            weight(a, b, memo)  # and with it that of all pairs of children that paired() asks for
            todo += paired(x, y, memo)
    return out


def boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED or node.tag == "header" and not in_article:
        return True
    if not node.names or node.tag in ("html", "body"):
        return False
    for part in re.findall(r"(\S+?)=([^=]*)(?= \S+=|$)", node.names):
        name, value = part[0], part[1].strip()
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and NAMES.search(value):
            return True
    return False


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or "role=main" in node.names or "role=article" in node.names


def marked(root: Node, n: int) -> tuple[list[bool], list[bool]]:
    """By number of a node: whether it is under an article mark, and under a boilerplate mark."""
    article, dropped = [False] * n, [False] * n
    todo = [(root, False, False)]
    while todo:
        node, inside, gone = todo.pop()
        inside = inside or is_article(node)
        gone = gone or boilerplate(node, inside)
        article[node.index], dropped[node.index] = inside, gone
        todo += [(k, inside, gone) for k in node.nodes()]
    return article, dropped


class Wrapper:
    """A family's seed tree, and what is learned of its nodes once it is known."""

    def __init__(self, html: str, model: str | None = None):
        self.root = parse(html)
        self.order = number(self.root)
        self.texts = [n.own_text() for n in self.order]
        self.memo: dict = {}
        found = json.loads(model) if model else {}
        self.main = found.get("slot", [None])[0]
        self.slot, self.template, self.dead = (set(found.get(k, ())) for k in ("slot", "template", "dead"))

    def aligned(self, page: Node) -> list[tuple[Node, Node]]:
        if len(self.memo) > 200_000:
            self.memo.clear()
        return align(self.root, page, self.memo)

    def votes(self, html: str) -> list[tuple[int, int, int, int]]:
        """What a page says: (node, 1 if it has the seed's text, letters of other text there and
        below in nodes that nothing matches, 1 if it is marked boilerplate). None of a copy."""
        page = parse(html)
        order = number(page)
        article, dropped = marked(page, len(order))
        pairs = self.aligned(page)
        seed_of = {b.index: a.index for a, b in pairs}
        letters, same, total = [0] * len(self.order), 0, 0
        owner = [0] * len(order)
        for node in order:
            for k in node.nodes():
                owner[k.index] = owner[node.index] if k.index not in seed_of else seed_of[k.index]
        for node in order:
            own = node.own_text()
            total += len(own)
            at = seed_of.get(node.index)
            if at is not None and own == self.texts[at]:
                same += len(own)
            elif not dropped[node.index]:
                letters[owner[node.index] if at is None else at] += len(own)
        if same >= COPY * total:
            return []
        return [(a.index, int(b.own_text() == self.texts[a.index]), letters[a.index], int(dropped[b.index])) for a, b in pairs]

    def induced(self, stats: dict[int, tuple[int, int, int, int]]) -> str | None:
        """stats: by node, pages matched, those with the seed's text, letters of other text, and
        pages that mark it boilerplate. None without enough pages or varying text."""
        pages = stats.get(0, (0, 0, 0, 0))[0]
        if pages < LEAST:
            return None
        template = [i for i, (n, same, _, _) in stats.items() if n >= LEAST and same >= SAME * n and self.texts[i]]
        dead, mass = [False] * len(self.order), [0] * len(self.order)
        for node in self.order:
            n, _, letters, off = stats.get(node.index, (0, 0, 0, 0))
            dead[node.index] = dead[node.index] or 2 * off > n or n == 0 and boilerplate(node, False)
            mass[node.index] = 0 if dead[node.index] else letters
            for k in node.nodes():
                dead[k.index] = dead[node.index]
        own = list(mass)
        for node in reversed(self.order):
            mass[node.index] += sum(mass[k.index] for k in node.nodes())
        if not mass[0]:
            return None
        node = self.root
        while True:
            inner = [k for k in node.nodes() if mass[k.index] >= MASS * mass[0] and k.tag in BLOCK and k.tag != "p"]
            if not inner:
                break
            node = inner[0]
        slot = [node.index] + [n.index for n in self.order if n.tag in HEADINGS and own[n.index] and not dead[n.index]]
        return json.dumps({"slot": slot, "template": template, "dead": [i for i, x in enumerate(dead) if x]})

    def text(self, html: str) -> tuple[str, str]:
        """The page's text, and what decided it: the wrapper or the page's own marks."""
        page = parse(html)
        order = number(page)
        if self.slot:
            seed_of = {b.index: a.index for a, b in self.aligned(page)}
            start = [n for n in order if seed_of.get(n.index) in self.slot]
            if any(seed_of[n.index] == self.main for n in start):
                fixed = {n.index for n in order if seed_of.get(n.index) in self.template and n.own_text() == self.texts[seed_of[n.index]]}
                gone = {n.index for n in order if seed_of.get(n.index) in self.dead}
                # a page that is a copy of the seed and has nothing else is no template
                return text_of(start, gone, fixed) or text_of(start, gone, set()), "wrapper"
        found = articles(page)
        return text_of(found or [page], set(), set(), bool(found)), "marks"


def collect(root: Node, gone: set[int], fixed: set[int], in_article: bool, blocks: list[list[str]]) -> None:
    """The texts below a node, a list for each block; without nodes that are gone, nor what their
    marks leave out, nor the own texts of fixed ones."""
    todo: list = [(root, False)]
    blocks.append([])
    while todo:
        k, silent = todo.pop()
        if k is None:
            blocks.append([])
        elif isinstance(k, str):
            if not silent:
                blocks[-1].append(entities.unescape(k))
        elif k is root or k.index not in gone and not boilerplate(k, in_article):
            if k.tag in BLOCK:
                blocks.append([])
                todo.append((None, False))
            silent = k.index in fixed
            todo += [(x, silent) for x in reversed(k.kids)]


def text_of(roots: list[Node], gone: set[int], fixed: set[int], in_article: bool = True) -> str:
    """Texts of the roots in page order, of nested ones once."""
    blocks: list[list[str]] = []
    done: set[int] = set()
    for root in roots:
        if root.index not in done and root.index not in gone:
            collect(root, gone, fixed, in_article, blocks)
            todo = [root]
            while todo:
                node = todo.pop()
                done.add(node.index)
                todo += node.nodes()
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def articles(root: Node) -> list[Node]:
    """Outermost marked articles that aren't under something to leave out."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root and boilerplate(node, False):
            continue
        if is_article(node):
            found.append(node)
        else:
            todo += reversed(node.nodes())
    return found


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def shape_of(html: Column) -> Column:
    """Which of the structural tags a page has, as bits: 512 shapes at most."""
    low = F.lower(html)
    return sum((F.when(F.contains(low, F.lit(f"<{tag}")), 1 << i).otherwise(0) for i, tag in enumerate(STRUCTURE)), F.lit(0))


def _rows(batch: pa.RecordBatch, held: dict[tuple, tuple], cache: dict[tuple, Wrapper]) -> Iterator[tuple[tuple, Wrapper, str]]:
    """Family, wrapper and page of each row of a batch."""
    joined = "seed" in batch.schema.names
    for i, (host, shape, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("shape").to_pylist(), batch.column("html"))):
        family = host, shape
        if family not in cache:
            if len(cache) > 2000:
                cache.clear()
            seed, model = (batch.column("seed")[i].as_py(), batch.column("model")[i].as_py()) if joined else held.get(family, ("", None))
            cache[family] = Wrapper(seed or "", model)
        yield family, cache[family], html.as_py() or ""


def _stats(batches: Iterator[pa.RecordBatch], held: dict[tuple, tuple]) -> Iterator[pa.RecordBatch]:
    cache: dict[tuple, Wrapper] = {}
    sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    names = ["host", "shape", "node", "n", "same", "letters", "off"]

    def flush() -> pa.RecordBatch:
        rows = [(*family, i, *v) for (family, i), v in sums.items()]
        cols = list(zip(*rows)) or [[]] * 7
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names)

    for batch in batches:
        for family, wrapper, html in _rows(batch, held, cache):
            for i, same, letters, off in wrapper.votes(html):
                s = sums[family, i]
                s[0] += 1
                s[1] += same
                s[2] += letters
                s[3] += off
            if len(sums) > 200_000:
                yield flush()
    yield flush()


def _models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for seed, stats in zip(batch.column("seed").to_pylist(), batch.column("stats").to_pylist()):
            out.append(Wrapper(seed).induced({x["node"]: (x["n"], x["same"], x["letters"], x["off"]) for x in stats or ()}))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), batch.column("seed"), pa.array(out, pa.string())], ["host", "shape", "seed", "model"])


def _texts(batches: Iterator[pa.RecordBatch], held: dict[tuple, tuple]) -> Iterator[pa.RecordBatch]:
    cache: dict[tuple, Wrapper] = {}
    for batch in batches:
        out = [wrapper.text(html) for _, wrapper, html in _rows(batch, held, cache)]
        text, by = ([x[i] for x in out] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()), pa.array(by, pa.string())], ["page_id", "url", "text", "n_chars", "decided_by"])


def extracted(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """page_id, url, text, n_chars (code points) and decided_by: one row a row of ``pages``.

    decided_by is ``wrapper``, or ``marks`` where the page's family has none or the page has nothing
    at its slot. A null html is empty, and so is its text. Character references are decoded, white
    space within a block becomes one space, blocks are trimmed and joined in page order by one
    space. Pages with a null url, or one without a host, form a host of their own. Repeated rows
    stay; copies of the seed are no evidence of what is template. Trees may be of any depth. Nulls
    in page_id and url stay. Further columns are ignored. Empty table: no rows. Runs actions.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), host_of(F.col("url")).alias("host"), shape_of(html).cast("int").alias("shape"))
    key = F.xxhash64("page_id", "url")
    family = ["host", "shape"]
    seeds = cut(base.where("html <> ''").groupBy(*family).agg(F.min_by("html", key).alias("seed"), F.count(F.lit(1)).alias("pages")), "seeds")
    few = seeds.agg(F.coalesce(F.sum(F.length("seed") + F.length("host")), F.lit(0))).first()[0] <= small

    def with_seed(table: DataFrame) -> tuple[DataFrame, dict]:
        if few:
            return base, {(r["host"], r["shape"]): (r["seed"], r["model"]) for r in table.select(*family, "seed", "model").collect()}
        # a large family is dealt to several tasks, and its seed is copied to each
        parts = F.greatest(F.ceil(F.col("pages") / FAMILY_ROWS), F.lit(1)).cast("int")
        large = F.broadcast(table.where(F.col("pages") > FAMILY_ROWS).select(*family, parts.alias("parts")))  # rows / FAMILY_ROWS at most
        dealt = base.join(large, family, "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        copies = table.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*family, "part", "seed", "model")
        return dealt.join(copies, [*family, "part"], "left").select("page_id", "url", "html", *family, "seed", "model"), {}

    wide, held = with_seed(seeds.withColumn("model", F.lit(None).cast("string")))
    stats = wide.where("html <> ''").mapInArrow(lambda it: _stats(it, held), "host string, shape int, node long, n long, same long, letters long, off long")
    stats = stats.groupBy(*family, "node").agg(*(F.sum(c).alias(c) for c in ("n", "same", "letters", "off")))
    stats = stats.groupBy(*family).agg(F.collect_list(F.struct("node", "n", "same", "letters", "off")).alias("stats"))
    models = seeds.join(stats, family, "left").select(*family, "seed", "stats").mapInArrow(_models, "host string, shape int, seed string, model string")
    models = cut(models.join(seeds.select(*family, "pages"), family), "wrappers")
    wide, known_models = with_seed(models)
    return wide.mapInArrow(lambda it: _texts(it, known_models), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, decided_by string")
