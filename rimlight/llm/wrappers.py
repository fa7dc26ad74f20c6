"""Main text of HTML pages by wrapper induction over the pages of a host.

Pages of a host are dealt to wrappers: each layout (pages with the same kinds of sections around articles and main part)
of at least `TEMPLATE_PAGES` pages has its own, whose reference is its first complete page; the pages of rarer layouts
go to the wrapper of the host's commonest. Every page is aligned with its reference by simple tree matching: equal
labels (tag, id, class) match, children keep their order, and a matching with most nodes is taken, among these one that
pairs equal texts. A node's text is its own and that of the inline elements within it, so that running text is one.
Over the pages of a wrapper, a reference node that is matched and has the same text in most of them is template; one
whose text varies is a slot. Pages are counted by distinct content, so copies count once, and pages that say nearly the
same as the reference (`COPY_SHARE`) have no vote on elements without id or class in articles and main parts; such an
element of an article must be the same in nearly all of at least `BARE_PAGES` contents. So near copies, and passages that
many documents quote, are no template.

A page's text is that of its slots, and of nodes that match nothing, in its content region: its articles, else its main
part, else the region that the wrapper finds, the innermost section of the reference that holds nearly all varying text
that isn't linked (`REGION_SHARE`). What template is goes wherever it is, in articles, too. Alignment can't tell what
varies like prose but isn't: menus, forms, asides and footers are known by HTML's tags and roles, changing adverts and
reader comments by words of their ids and classes, and link lists outside of articles by their share of linked text.

Pages are parsed and aligned once; their pieces of text, with the reference's node that each belongs to, are written,
and the template is taken out of these. References are broadcast to the workers where their measured size is below
`BROADCAST_BYTES`; beyond it pages are dealt by wrapper and salt, and each group's reference comes with it once.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; broken or cut-off markup is
closed where it ends; a null id is a reference only where no page of its layout has one; a host with fewer than four
pages, or a node that fewer than four contents have, gives no template; repeated rows get equal results; an empty table
gives an empty result; elements may be nested to any depth; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import small, stage

BROADCAST_BYTES = 16 << 20
DEALT_PAGES = 4096  # pages of a wrapper that share a task where references are dealt
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 4
BARE_SHARE, BARE_PAGES = 0.95, 8  # the same for bare elements of articles: what many documents quote is no template
COPY_SHARE = 2 / 3  # of equal text from which on a page is a copy of the reference
REGION_SHARE = 0.9
CELLS = 1 << 22  # of a table of alignment; larger ones are halved

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SECTION = frozenset("#page html body main section div center table tbody tr td article".split())
_SKIP = frozenset("head script style noscript template iframe svg math nav footer aside form button select option input textarea label dialog object canvas audio video menu".split())
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of ids and classes that name what isn't content though it varies.
_SKIP_NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|replies|disqus|share|sharing|social|related|widget|pagination|pager|login|signup)(?:$|[\s_-])")
#: The same for articles, which name their kind more freely.
_SKIP_ARTICLES = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|reply|replies|teaser|related)(?:$|[\s_-])")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?i)(?:^|\s)(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table select".split())


class Node:
    """An element; children are Nodes and strings, kids the Nodes.

    size: nodes of its tree; shape: a hash of its tree's labels; unit: the node that its own text belongs to, which is
    another one for inline elements of running text; said: the text of which it is the unit; same: a hash of its tree's
    labels and texts, 0 if it has no text.
    """

    __slots__ = ("tag", "label", "names", "role", "children", "kids", "size", "shape", "unit", "said", "same")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children, self.kids, self.names, self.role, self.said = tag, [], [], "", "", ""
        if attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            self.names, self.role = f"{found.get('id', '')} {found.get('class', '')}".strip(), found.get("role", "").lower()
        self.label = f"{tag} {self.names}" if self.names else tag

    def close(self) -> None:
        """Sets what is known of the tree; its kids are closed."""
        self.size = 1 + sum(x.size for x in self.kids)
        self.shape = hash((self.label, *(x.shape for x in self.kids)))
        below = tuple(x.same for x in self.kids)
        self.same = (hash((self.shape, self.said, below)) or 1) if self.said or any(below) else 0


class _Open:
    """The open elements while a page is read, and where among them blocks, list items and each tag are."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.tags, self.blocks, self.items = [root], {}, [], []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.tags.setdefault(node.tag, []).append(at)
        if node.tag in _BLOCK:
            self.blocks.append(at)
        if node.tag in _CLOSES or node.tag in _LISTS:
            self.items.append(at)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.tags[self.nodes.pop().tag].pop()
        for held in (self.blocks, self.items):
            while held and held[-1] >= at:
                held.pop()


def in_order(root: Node) -> list[Node]:
    """The nodes of a tree in page order."""
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo += reversed(node.kids)
    return out


def parse(text: str) -> Node:
    """The tree of a page; unclosed elements end where their parent does, a p also where a block starts."""
    root = Node("#page")
    now, at = _Open(root), 0

    def put(x: str) -> None:
        if x:
            now.nodes[-1].children.append(html.unescape(x))

    while m := _TOKEN.search(text, at):
        put(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if places := now.tags.get(tag):
                now.cut(places[-1])
            continue
        if not m[4]:
            break  # cut off within a tag
        if tag in _BLOCK and now.blocks and now.nodes[now.blocks[-1]].tag == "p":
            now.cut(now.blocks[-1])
        if closes := _CLOSES.get(tag):
            ends = None
            for i in reversed(now.items):
                if now.nodes[i].tag in _LISTS:
                    break
                ends = i if now.nodes[i].tag in closes else ends
            if ends is not None:
                now.cut(ends)
        node = Node(tag, m[3])
        now.nodes[-1].children.append(node)
        now.nodes[-1].kids.append(node)
        if tag in _RAW and not (tag in ("svg", "math") and m[3].endswith("/")):
            end = re.compile(rf"(?i)</{tag}\b[^>]*(?:>|$)").search(text, at)
            at = end.end() if end else len(text)
        elif tag not in _VOID:
            now.push(node)
    else:
        put(text[at:])
    _tell(root)
    for node in reversed(in_order(root)):
        node.close()
    return root


def _tell(root: Node) -> None:
    """Sets unit and said of all nodes."""
    texts: dict[Node, list[str]] = {}
    todo: list[tuple[Node | str, Node]] = [(root, root)]
    while todo:
        x, unit = todo.pop()
        if isinstance(x, str):
            texts[unit].append(x)
            continue
        x.unit = unit if unit in texts and x.tag not in _BLOCK else x
        if x.unit is x and any(isinstance(k, str) and not k.isspace() for k in x.children):
            texts[x] = []
        if x.unit in texts:
            texts[x.unit].append(" " * (x.tag == "br"))
            todo += ((k, x.unit) for k in reversed(x.children))
        else:
            todo += ((k, x) for k in reversed(x.kids))
    for node, held in texts.items():
        node.said = " ".join("".join(held).split())


def _trimmed(xs: list[Node], ys: list[Node], key: Callable[[Node], object]) -> tuple[int, int]:
    """How many first and last nodes of both lists have equal keys."""
    n = min(len(xs), len(ys))
    i = 0
    while i < n and key(xs[i]) == key(ys[i]):
        i += 1
    j = 0
    while j < n - i and key(xs[-1 - j]) == key(ys[-1 - j]):
        j += 1
    return i, j


def _shape(node: Node) -> object:
    return node.shape, node.size


def _content(node: Node) -> object:
    return node.shape, node.size, node.same


class _Weights:
    """Weights of pairs of two lists of nodes, row by row: matched nodes first, then (if said) equal texts."""

    def __init__(self, xs: list[Node], ys: list[Node], matched: dict[tuple[int, int], int], said: bool) -> None:
        rows, cols = {x.shape: i for i, x in enumerate({x.shape: x for x in xs}.values())}, {y.shape: i for i, y in enumerate({y.shape: y for y in ys}.values())}
        table = np.array([[matched.get((a, b), 0) for b in cols] for a in rows], np.int64)
        self.place, self.table = [rows[x.shape] for x in xs], table[:, [cols[y.shape] for y in ys]]
        self.xs, self.said = xs, said
        if said:
            self.table = self.table * (4 * min(len(xs), len(ys)) + 1)
            self.same, self.words = np.array([y.same for y in ys]), np.array([hash(y.said) if y.said else 0 for y in ys])

    def row(self, r: int) -> np.ndarray:
        out, x = self.table[self.place[r]], self.xs[r]
        if not self.said or not x.same:
            return out
        more = 2 * (self.same == x.same)
        if x.said:
            more += self.words == hash(x.said)
        return np.where(out > 0, out + more, 0)


def _best(row: Callable[[int], np.ndarray], rows: range, cols: slice) -> np.ndarray:
    """The most weight of these rows with each beginning of the columns (in the columns' order, which may be reversed)."""
    best = None
    for r in rows:
        w = row(r)[cols]
        if best is None:
            best = np.zeros(len(w) + 1, np.int64)
        best[1:] = np.maximum(best[1:], best[:-1] + w)
        np.maximum.accumulate(best, out=best)
    return best


def _chosen(row: Callable[[int], np.ndarray], m: int, n: int) -> list[tuple[int, int]]:
    """Pairs (r, c) in order, of the most weight. Large tables are halved (at most linear memory)."""
    out, todo = [], [(0, m, 0, n)]
    while todo:
        r0, r1, c0, c1 = todo.pop()
        if r0 == r1 or c0 == c1:
            continue
        if r1 - r0 > 1 and (r1 - r0) * (c1 - c0) > CELLS:
            mid = (r0 + r1) // 2
            down = _best(row, range(r0, mid), slice(c0, c1))
            up = _best(row, range(r1 - 1, mid - 1, -1), slice(c1 - 1, c0 - 1 if c0 else None, -1))
            c = c0 + int((down + up[::-1]).argmax())
            todo += [(mid, r1, c, c1), (r0, mid, c0, c)]
            continue
        table = np.zeros((r1 - r0 + 1, c1 - c0 + 1), np.int64)
        for i in range(r1 - r0):
            table[i + 1, 1:] = np.maximum(table[i, 1:], table[i, :-1] + row(r0 + i)[c0:c1])
            np.maximum.accumulate(table[i + 1], out=table[i + 1])
        i, j = r1 - r0, c1 - c0
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((r0 + i, c0 + j))
    return sorted(out)


def _weigh(a: Node, b: Node, matched: dict[tuple[int, int], int]) -> int:
    """How many nodes of two trees simple tree matching pairs; matched keeps the numbers by shape.

    Equal shapes at the beginnings (or ends) of two lists of children can always be paired: no other partner of either
    matches more nodes than all it has.
    """
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = x.shape, y.shape
        if key in matched:
            todo.pop()
            continue
        if x.label != y.label:
            matched[key] = 0
        elif x.shape == y.shape:
            matched[key] = x.size
        else:
            i, j = _trimmed(x.kids, y.kids, _shape)
            xs, ys = x.kids[i : len(x.kids) - j], y.kids[i : len(y.kids) - j]
            total = 1 + sum(k.size for k in x.kids[:i]) + sum(k.size for k in x.kids[len(x.kids) - j :])
            if xs and ys:
                right = {k.shape: k for k in ys}.values()
                need = [(p, q) for p in {k.shape: k for k in xs}.values() for q in right if p.label == q.label and (p.shape, q.shape) not in matched]
                if need:
                    todo += need
                    continue
                total += int(_best(_Weights(xs, ys, matched, False).row, range(len(xs)), slice(None))[-1])
            matched[key] = total
    return matched[a.shape, b.shape]


def match(a: Node, b: Node, matched: dict[tuple[int, int], int] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two trees: (number of matched nodes, the pairs).

    Where several matchings of two lists of children have most nodes, one is taken that pairs most equal texts.
    """
    matched = {} if matched is None else matched
    total = _weigh(a, b, matched)
    pairs, todo = [], [(a, b)] if total else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs, ys = x.kids, y.kids
        if not xs or not ys:
            continue
        if x.shape != y.shape or x.same != y.same:
            i, j = _trimmed(xs, ys, _content)
            todo += zip(xs[:i], ys[:i], strict=True)
            todo += zip(xs[len(xs) - j :], ys[len(ys) - j :], strict=True)
            xs, ys = xs[i : len(xs) - j], ys[i : len(ys) - j]
            if xs and ys and {k.same for k in xs if k.same}.isdisjoint(k.same for k in ys) and {k.said for k in xs if k.said}.isdisjoint(k.said for k in ys):
                i, j = _trimmed(xs, ys, _shape)  # no equal text to pair
                todo += zip(xs[:i], ys[:i], strict=True)
                todo += zip(xs[len(xs) - j :], ys[len(ys) - j :], strict=True)
                xs, ys = xs[i : len(xs) - j], ys[i : len(ys) - j]
            if xs and ys:
                for p in {k.shape: k for k in xs}.values():
                    for q in {k.shape: k for k in ys}.values():
                        if p.label == q.label:
                            _weigh(p, q, matched)
                todo += ((xs[r], ys[c]) for r, c in _chosen(_Weights(xs, ys, matched, True).row, len(xs), len(ys)))
        else:
            todo += zip(xs, ys, strict=True)
    return total, pairs


def skipped(node: Node, in_article: bool) -> bool:
    """Whether a node's tag, role, id or class says that it isn't content."""
    if node.tag in _SKIP or node.role in _SKIP_ROLES or (node.tag == "header" and not in_article):
        return True
    if not node.names or node.tag in ("main", "body", "html", "#page"):
        return False
    return bool((_SKIP_ARTICLES if node.tag == "article" else _SKIP_NAMES).search(node.names))


def regions(root: Node) -> tuple[list[Node], bool]:
    """(content regions, whether they are articles or a main part)."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if skipped(node, False):
                continue
            if node.tag == tag or (tag == "main" and node.role == "main"):
                found.append(node)
            else:
                todo += reversed(node.kids)
        if found:
            return found, True
    return [root], False


Chunk = tuple[int, str, Node, int, bool]  # block, text, its unit, place of the nearest matched unit (-1: none), whether it is linked


def chunks(root: Node, places: dict[int, int]) -> tuple[list[Chunk], bool]:
    """(the texts in the content regions in page order, whether these are articles or a main part); places: of matched nodes, by identity."""
    found, sure = regions(root)
    out: list[Chunk] = []
    block, todo = 0, [(x, x, -1, False) for x in reversed(found)]
    while todo:
        x, parent, near, link = todo.pop()
        if x is None:
            block += 1
        elif isinstance(x, str):
            if out and out[-1][0] == block and out[-1][2] is parent.unit and out[-1][4] == link:
                x = out.pop()[1] + x
            out.append((block, x, parent.unit, near, link))
        elif not skipped(x, sure):
            if x.tag == "br":
                todo.append((" ", parent, near, link))
            near, link = places.get(id(x.unit), near), link or x.tag == "a"
            if x.tag in _BLOCK:
                block += 1
                todo.append((None, x, near, link))
            todo += ((k, x, near, link) for k in reversed(x.children))
    return out, sure


def joined(found: Iterator[tuple[int, str, bool]], sure: bool) -> str:
    """The text of (block, text, whether it is linked): a line a block; blocks of links only count where sure."""
    out, held, linked, now = [], [], 0, None

    def end() -> None:
        text = " ".join("".join(held).split())
        if text and (sure or linked < 0.6 * len(text)):
            out.append(text)

    for block, text, link in found:
        if block != now:
            end()
            held, linked, now = [], 0, block
        held.append(text)
        linked += len(text) * link
    end()
    return "\n".join(out)


def blocks(root: Node, template: set[int]) -> list[str]:
    """A page's blocks without the nodes in template (by identity), as far as no wrapper is needed to tell them."""
    found, sure = chunks(root, {})
    return joined(((b, x, link) for b, x, node, _, link in found if id(node) not in template), sure).split("\n")


class Reference:
    """A reference page: its nodes in page order, and which of them are inner (in an article or main part, with no id or class there) and bare (the same in an article)."""

    def __init__(self, text: str) -> None:
        self.root = parse(text)
        nodes = in_order(self.root)
        self.places = {id(x): i for i, x in enumerate(nodes)}
        self.bare, self.inner = np.zeros((2, len(nodes)), bool)
        found, sure = regions(self.root)
        todo = [(x, x.tag == "article") for x in found] if sure else []
        while todo:
            node, article = todo.pop()
            if not node.names or node.tag == "article":
                k = self.places[id(node)]
                self.bare[k], self.inner[k] = article, True
                todo += ((x, article) for x in node.kids)
        self.matched: dict[tuple[int, int], int] = {}

    def aligned(self, page: Node) -> tuple[dict[int, int], set[int], list[tuple[int, bool]]]:
        """(places of the page's matched nodes, the identities of those with an equal text, (place, equal) of reference nodes with a text)."""
        if len(self.matched) > 200_000:
            self.matched.clear()
        places, equal, met = {}, set(), []
        for x, y in match(self.root, page, self.matched)[1]:
            places[id(y)] = k = self.places[id(x)]
            if x.said:
                met.append((k, x.said == y.said))
                if x.said == y.said:
                    equal.add(id(y))
        return places, equal, met


ALIGNED = "page_id long, url string, wrapper string, sure boolean, block array<int>, text array<string>, at array<int>, equal array<boolean>, linked array<boolean>, content binary, met binary, same binary, told binary"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]


def _described(text: str | None, ref: Reference | None) -> tuple:
    """The columns of ALIGNED from sure on, of one page.

    content: a digest of its text without any template; met, same: bits of the reference's nodes whose text it has its
    own for, or the same; told: letters of varying text, not linked, that belong to each (pages without article only).
    """
    root = parse(text or "")
    places, equal, met = ref.aligned(root) if ref else ({}, set(), [])
    found, sure = chunks(root, places)
    columns = [list(x) for x in zip(*((b, x, near, id(node) in equal, link) for b, x, node, near, link in found), strict=True)] or [[]] * 5
    if ref is None:
        return sure, *columns, None, None, None, None
    content = hashlib.md5(joined(((b, x, link) for b, x, _, _, link in found), sure).encode("utf-8", "surrogatepass")).digest()
    bits = np.zeros((2, len(ref.places)), bool)
    for k, same in met:
        bits[:, k] = True, same
    total, alike = (sum(len(x.strip()) for _, x, node, *_ in found if every or id(node) in equal) for every in (True, False))
    if alike > COPY_SHARE * total:
        bits[:, ref.inner] = False
    told = np.zeros(0 if sure else len(ref.places), np.int32)
    for _, x, node, near, link in found if not sure else ():
        if near >= 0 and not link and id(node) not in equal:
            told[near] += len(x.strip())
    return sure, *columns, content, np.packbits(bits[0]).tobytes(), np.packbits(bits[1]).tobytes(), told.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)] if rows else [pa.array([], t) for t in _KINDS], _NAMES)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def layout(text: Column) -> Column:
    """A hash of the distinct sections (tag, id and class, digits as 0) that a page has around its articles and main part."""
    around = F.regexp_replace(text, r"(?is)<!--.*?(?:-->|$)|<(script|style|article|main)\b.*?(?:</\1\s*>|$)", " ")
    tags = F.regexp_extract_all(around, F.lit(r"(?i)<(?:div|section|nav|header|footer|aside|form|table)\b[^>]*+"), F.lit(0))
    kinds = F.transform(tags, lambda x: F.regexp_replace(F.concat_ws(" ", *(F.regexp_extract(x, p, 0) for p in (r"^<\w+", r"(?i)\sid\s*=\s*(\"[^\"]*\"|'[^']*'|\S+)", r"(?i)\sclass\s*=\s*(\"[^\"]*\"|'[^']*'|\S+)"))), "[0-9]+", "0"))
    return F.xxhash64(F.array_sort(F.array_distinct(kinds)))


def references(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, layout, wrapper) of the layouts that have a wrapper, (wrapper, pages, ref): its pages and reference)."""
    broken = ~F.col("html").rlike(r"(?i)</html\s*>\s*$")
    firsts = rows.where("html is not null").groupBy("host", "layout").agg(F.min(F.struct(broken.alias("broken"), F.col("page_id").isNull().alias("none"), "page_id", "digest")).alias("first"), F.count("*").alias("pages"))
    firsts = stage(firsts.select("host", "layout", F.col("first.digest").alias("digest"), "pages"), "layouts")
    commonest = firsts.groupBy("host").agg(F.sum("pages").alias("all"), F.max_by("digest", F.struct("pages", "digest")).alias("common")).where(F.col("all") >= TEMPLATE_PAGES)
    own = F.when(F.col("pages") >= TEMPLATE_PAGES, F.col("digest")).otherwise(F.col("common"))
    told = stage(firsts.join(commonest, "host").select("host", "layout", "pages", own.alias("digest")).withColumn("wrapper", F.md5(F.concat("host", F.lit(" "), "digest").cast("binary"))), "layouts")
    wanted = small(stage(told.groupBy("wrapper", "host", "digest").agg(F.sum("pages").alias("pages")), "wanted"))
    refs = rows.where("html is not null").select("host", "digest", "html").join(wanted, ["host", "digest"]).groupBy("wrapper").agg(F.max("html").alias("ref"), F.max("pages").alias("pages"))
    return told.select("host", "layout", "wrapper"), stage(refs, "references")


def align(rows: DataFrame, refs: DataFrame, most: int | None = None) -> DataFrame:
    """ALIGNED of rows (page_id, url, wrapper, html); references of more than `most` bytes in all are dealt out, not broadcast."""
    most = BROADCAST_BYTES if most is None else most
    rows = rows.select("page_id", "url", "wrapper", "html")
    if refs.agg(F.coalesce(F.sum(F.octet_length("ref")), F.lit(0))).first()[0] <= most:
        texts = rows.sparkSession.sparkContext.broadcast({r.wrapper: r.ref for r in refs.collect()})  # measured just above

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, Reference] = {}
            for b in batches:
                out = []
                for page, url, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if name is not None and name not in known:
                        if len(known) >= 256:
                            known.clear()
                        known[name] = Reference(texts.value[name])
                    out.append((page, url, name, *_described(text, known.get(name))))
                yield _batch(out)

        return rows.mapInArrow(near, ALIGNED)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ref = None, None
        for b in batches:
            out = []
            for page, url, name, text, first in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                if first:
                    now, ref = name, Reference(text)
                else:
                    out.append((page, url, name, *_described(text, ref if name == now else None)))
            yield _batch(out)

    salts = (F.floor(F.col("pages") / DEALT_PAGES) + 1).cast("int")
    sized = small(stage(refs.select(F.col("wrapper").alias("_wrapper"), salts.alias("_salts")), "references"))
    pages = rows.join(sized, F.col("wrapper") == F.col("_wrapper"), "left")
    pages = pages.select(F.pmod(F.xxhash64("html", "page_id"), F.coalesce("_salts", F.lit(DEALT_PAGES)).cast("long")).alias("salt"), "page_id", "url", "wrapper", "html", F.lit(False).alias("first"))
    heads = refs.select(F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)).alias("salt"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "wrapper", F.col("ref").alias("html"), F.lit(True).alias("first"))
    return heads.unionByName(pages).repartition("wrapper", "salt").sortWithinPartitions("wrapper", "salt", F.desc("first")).mapInArrow(dealt, ALIGNED)


def induce(aligned: DataFrame, refs: DataFrame) -> DataFrame:
    """(wrapper, template, low, high): the places of a reference's nodes that most contents repeat, and the places that
    its content region spans (all, if none is found or pages name theirs)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        cells = 0

        def flush() -> pa.RecordBatch:
            held = [(name, x, np.flatnonzero(x.any(0))) for name, x in sums.items()]
            names = pa.array([name for name, _, at in held for _ in at], pa.string())
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *(at if i is None else x[i][at] for _, x, at in held)])) for i in (None, 0, 1, 2)]
            sums.clear()
            return pa.record_batch([names, *columns], ["wrapper", "node", "met", "same", "told"])

        for b in batches:
            for name, met, same, told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = [np.unpackbits(np.frombuffer(met, np.uint8)), np.unpackbits(np.frombuffer(same, np.uint8)), np.frombuffer(told, np.int32)]
                if name not in sums:
                    sums[name] = np.zeros((3, len(parts[0])), np.int64)
                    cells += len(parts[0])
                for i, x in enumerate(parts):
                    sums[name][i, : len(x)] += x
            if cells > 1 << 21:
                yield flush()
                cells = 0
        yield flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, text, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ref = Reference(text)
                nodes = in_order(ref.root)
                met, same, told = (np.zeros(len(nodes) + 1, np.int64) for _ in range(3))
                for x in sums:
                    met[x["node"]], same[x["node"]], told[x["node"] + 1] = x["met"], x["same"], x["told"]
                bare = np.append(ref.bare, False)
                fixed = (met >= np.where(bare, BARE_PAGES, TEMPLATE_PAGES)) & (same >= np.where(bare, BARE_SHARE, TEMPLATE_SHARE) * met)
                told = told.cumsum()
                low, high, i = 0, len(nodes), 1
                while i < high:  # children follow their parent; a child that holds nearly all is gone into
                    if nodes[i].tag in _SECTION and told[i + nodes[i].size] - told[i] >= REGION_SHARE * told[-1] > 0:
                        low, high, i = i, i + nodes[i].size, i + 1
                    else:
                        i += nodes[i].size
                out.append((name, np.flatnonzero(fixed).tolist(), low, high))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["wrapper", "template", "low", "high"])

    once = aligned.where("wrapper is not null").groupBy("wrapper", "content").agg(F.min(F.struct("met", "same", "told")).alias("bits")).select("wrapper", "bits.met", "bits.same", "bits.told")
    nodes = once.mapInArrow(count, "wrapper string, node long, met long, same long, told long").groupBy("wrapper", "node").agg(*(F.sum(c).alias(c) for c in ("met", "same", "told")))
    found = nodes.groupBy("wrapper").agg(F.collect_list(F.struct("node", "met", "same", "told")).alias("sums"))  # a reference's nodes
    return stage(found.join(refs, "wrapper").select("wrapper", "ref", "sums").mapInArrow(decide, "wrapper string, template array<int>, low int, high int"), "wrappers")


def extract(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumns({"layout": layout(F.col("html")), "digest": F.md5(F.col("html").cast("binary"))})
    names, refs = references(rows)
    aligned = stage(align(rows.join(small(names), ["host", "layout"], "left"), refs, most), "aligned")
    wrappers = small(induce(aligned, refs).withColumnRenamed("wrapper", "_wrapper"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for sure, block, text, at, equal, linked, template, low, high in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                gone = set(template or ())
                if sure or low is None or not any(low <= a < high for a in at):
                    low, high = -1, 2**31
                kept = zip(block, text, at, equal, linked, strict=True)
                texts.append(joined(((i, x, link) for i, x, a, e, link in kept if low <= a < high and not (e and a in gone)), sure))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    told = aligned.join(wrappers, F.col("wrapper") == F.col("_wrapper"), "left")
    return told.select("page_id", "url", "sure", "block", "text", "at", "equal", "linked", "template", "low", "high").mapInArrow(cut, "page_id long, url string, text string, n_chars long")
