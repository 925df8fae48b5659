"""Main text of web pages, by wrapper induction over the pages of one host.

1. A page is parsed into its tree of blocks. Its shape is that tree with repetition folded: paragraphs, list items, rows and headings of one
   parent share a node, and so do other siblings of equal shape.
2. The distinct shapes of a host are merged into its wrapper by simple tree matching: the alignment with the most matched nodes that keeps
   labels, levels and order; what one tree alone has is put in at its place. Shapes are merged in the order of their hashes, in two rounds, so the
   wrapper does not depend on how pages are dealt out.
3. Every block of a page so falls into a slot, a node of the wrapper. How many of the host's distinct pages show a text in a slot is counted exactly.
   A text on at least half of them (and on at least 5) is constant: template. What varies is content.
4. Slots that vary are judged by element and by their volume: navigation, forms, footers and the like go by their element or role; class names are
   a hint that counts unless what they mark holds nine tenths of all varying text; slots whose varying text is nearly all links are menus.
   Of a page that marks its article (article, main or such a role) only that counts.

Counts are rows, added up before they are shuffled. A wrapper has as many nodes as a host's pages have kinds of places, and at most twice as many
constants as a page has blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, raw, slices, tidy

SHARE, MIN_PAGES, SALTS, BUCKETS = 0.5, 5, 64, 64
#: Bounds of what is sent out with the extraction: characters of wrappers, and constants. Beyond them pages and wrappers are sorted together.
SENT_CHARS, SENT_CONSTANTS = 4_000_000, 100_000
BULK, LINKED = 0.9, 0.8
NOTE = rb"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|"
#: a tag whose attributes may hold quoted values, and one that ends at the first ">"
TAG = re.compile(NOTE + rb"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.S)
LOOSE = re.compile(NOTE + rb"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
START = re.compile(rb"<[a-zA-Z/!?]")
NAME = re.compile(rb"""([^\s=/>"']+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
TELLING = re.compile(rb"class|id\s*=|role|hidden", re.I)
RAW_END = {t: re.compile(rb"</" + t + rb"[^>]*+>|\Z", re.I) for t in (b"script", b"style", b"noscript", b"template", b"textarea", b"title", b"iframe", b"svg", b"select", b"button", b"object", b"canvas")}
VOID = {b"area", b"base", b"br", b"col", b"embed", b"hr", b"img", b"input", b"link", b"meta", b"source", b"track", b"wbr", b"param"}
BLOCK = set(b"address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {b"body", b"html", b"td", b"th", b"tr", b"caption", b"tbody", b"thead", b"tfoot", b"legend"}
#: siblings that repeat whatever they hold
ITEMS = set(b"p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: what an element ends when it begins, and where the search stops
CLOSES = {b"li": ({b"li"}, {b"ul", b"ol", b"menu"}), b"dt": ({b"dt", b"dd"}, {b"dl"}), b"dd": ({b"dt", b"dd"}, {b"dl"}), b"tr": ({b"tr", b"td", b"th"}, {b"table"}), b"td": ({b"td", b"th"}, {b"tr", b"table"}), b"th": ({b"td", b"th"}, {b"tr", b"table"})}
SKIPPED = {b"head", b"nav", b"header", b"footer", b"aside", b"form", b"menu", b"dialog"}
ROLES = {b"navigation", b"banner", b"contentinfo", b"complementary", b"search", b"form", b"menu", b"menubar", b"dialog", b"alert", b"alertdialog", b"toolbar"}
NOISE = re.compile(rb"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|comments?|comment-list|disqus|discussions?|reactions?|replies|respond|responses?|notice|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|pagination|pager|toolbar|skip|alert)(?:$|[-_\s\d])", re.I)
#: names of an article element that is a comment or a teaser; whole names, as the article itself may be told to have a sidebar or open comments
NO_ARTICLE = re.compile(rb"(?:^|\s)(?:(?:div|user|reader)[-_])?(?:comments?|repl(?:y|ies)|responses?|reactions?|teasers?|related|recommended|promo|sponsored|advert)(?:[-_](?:body|item|card|box|entry|post|article|story))?(?:[-_]?\d+)?(?:$|\s)", re.I)
#: elements that an end tag of an inline element doesn't reach across
BARRIERS = {b"article", b"main", b"body", b"table", b"td"}
#: names that inside an article are about its own head
HEADING = re.compile(rb"(?:^|[-_\s])(?:header|masthead|banner)(?:$|[-_\s\d])", re.I)
SPACE = re.compile(r"\s+")
#: marks in labels: never content, hinted not to be content, the article
HARD, HINT, ARTICLE = "-", "!", "^"


class Page:
    """Block elements in page order, each after its parent, and the texts of blocks as (node, text, characters in links)."""

    __slots__ = ("labels", "parents", "blocks")

    def __init__(self) -> None:
        self.labels, self.parents = [""], [-1]
        self.blocks: list[tuple[int, str, int]] = []


def _marks(tag: bytes, attributes: bytes, in_article: bool) -> str:
    """The marks of an element, from its tag, role, class and id."""
    given = {n.lower(): a or b or c for n, a, b, c in NAME.findall(attributes)} if TELLING.search(attributes) else {}
    role = given.get(b"role", b"").lower()
    if b"hidden" in given or role in ROLES or (tag in SKIPPED and not (tag == b"header" and in_article)):
        return HARD
    names = b" ".join(given[k] for k in (b"class", b"id") if k in given)
    if tag in (b"article", b"main") or role in (b"main", b"article"):
        return HINT if NO_ARTICLE.search(names) else ARTICLE
    if not names or tag in (b"body", b"html") or in_article and (tag in (b"header", b"h1", b"h2", b"h3", b"h4", b"h5", b"h6") or HEADING.search(names)):
        return ""
    return HINT if NOISE.search(names) else ""


def parse(page: bytes) -> Page:
    """Blocks of a page, in time linear in its length. Missing and stray end tags are forgiven, an unclosed quote ends with its tag;
    scripts, styles and the like are dropped with what they hold."""
    out = Page()
    labels, parents = out.labels, out.parents
    told: dict[tuple, str] = {}
    #: open elements: tag, node, texts held for the node's block
    stack: list[tuple[bytes, int, list]] = [(b"", 0, [])]
    #: places in the stack: of each tag, of blocks, and of barriers; the last is the innermost
    places: dict[bytes, list[int]] = {}
    blocks: list[int] = []
    barriers: list[int] = []
    found: list[tuple[int, int, str, int]] = []
    links = articles = count = at = 0
    end_of_tags, tags = page.rfind(b">") + 1, TAG

    def settle(node: int, held: list) -> None:
        if held:
            text = SPACE.sub(" ", html.unescape("".join([x[0] for x in held]))).strip()
            if text:
                found.append((held[0][2], node, text, sum(len(x[0]) for x in held if x[1])))
            held.clear()

    def close(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal links, articles
        for tag, node, held in reversed(stack[k:]):
            if node >= 0:
                settle(node, held)
                if ARTICLE in labels[node]:
                    articles -= 1
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
            if tag in BARRIERS:
                barriers.pop()
            links -= tag == b"a"
        del stack[k:]
        del owner[k:]

    def innermost(tags: set[bytes] | tuple[bytes, ...]) -> int:
        """The place of the innermost open element of the tags; 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    owner = [0]  # for each open element the node that its text belongs to

    while True:
        m = tags.search(page, at, end_of_tags)
        if tags is TAG:  # a tag that no quote lets end: from here on tags end at the first ">"
            first = START.search(page, at, end_of_tags)
            if first and (m is None or first.start() < m.start()):
                loose = LOOSE.search(page, at, end_of_tags)
                if loose and (m is None or loose.start() < m.start()):
                    tags, m = LOOSE, loose
        stop = m.start() if m else len(page)
        if stop > at:
            held = stack[-1][2]
            held.append((page[at:stop].decode("utf-8", "replace"), links > 0, count))
            count += 1
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = innermost((tag,))
            if k and (tag in BLOCK or not barriers or barriers[-1] < k):
                if tag in BLOCK:
                    settle(owner[-1], stack[-1][2])
                close(k)
            continue
        if tag in RAW_END:
            at = RAW_END[tag].search(page, at).end()
            continue
        if tag in ENDS_P and (k := innermost((b"p",))) and k == blocks[-1]:
            settle(owner[-1], stack[-1][2])
            close(k)
        if tag in CLOSES:
            ended, limit = CLOSES[tag]
            if (k := innermost(ended)) > innermost(limit):
                settle(owner[-1], stack[-1][2])
                close(k)
        if tag == b"br" or tag == b"wbr":
            stack[-1][2].append((" " if tag == b"br" else "", False, count))
            count += 1
            continue
        block = tag in BLOCK
        if block:
            settle(owner[-1], stack[-1][2])
        if tag in VOID:
            continue
        key = (tag, m[3], articles > 0)
        marks = told.get(key)
        if marks is None:
            marks = told[key] = _marks(tag, m[3], articles > 0)
        node = -1
        if block or marks:  # an inline element without marks is part of the block around it
            node = len(labels)
            labels.append((tag.decode() if block else "inline") + marks)
            parents.append(owner[-1])
            if marks == ARTICLE:
                articles += 1
        if m[3].endswith(b"/") and not block:
            if marks == ARTICLE:
                articles -= 1
            continue
        places.setdefault(tag, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        if tag in BARRIERS:
            barriers.append(len(stack))
        stack.append((tag, node, [] if node >= 0 else stack[-1][2]))
        owner.append(node if node >= 0 else owner[-1])
        links += tag == b"a"
    settle(owner[-1], stack[-1][2])
    close(1)
    settle(0, stack[0][2])
    found.sort()
    out.blocks = [(node, text, n) for _, node, text, n in found]
    return out


# Trees: labels and children; node 0 is the root, a child has a larger number than its parent


class Tree:
    __slots__ = ("labels", "kids")

    def __init__(self, labels: list[str], parents: list[int]) -> None:
        self.labels = labels
        self.kids: list[list[int]] = [[] for _ in labels]
        for k, parent in enumerate(parents):
            if parent >= 0:
                self.kids[parent].append(k)

    @classmethod
    def read(cls, text: str) -> Tree:
        """A tree from its written form: label:parent of each node in order."""
        parts = [x.rpartition(":") for x in text.split(" ")]
        return cls([x[0] for x in parts], [int(x[2]) for x in parts])

    def write(self) -> str:
        """In preorder, so equal trees are written alike."""
        out, number, stack = [], 0, [(0, -1)]
        while stack:
            k, parent = stack.pop()
            out.append(f"{self.labels[k]}:{parent}")
            stack += [(x, number) for x in reversed(self.kids[k])]
            number += 1
        return " ".join(out)

    def shapes(self, pool: dict[tuple, int]) -> tuple[list[int], list[int]]:
        """For each node a number that equal subtrees share, and the subtree's size."""
        shape, size = [0] * len(self.labels), [1] * len(self.labels)
        for k in range(len(self.labels) - 1, -1, -1):
            kids = self.kids[k]
            shape[k] = pool.setdefault((self.labels[k], *[shape[x] for x in kids]), len(pool))
            size[k] += sum(size[x] for x in kids)
        return shape, size


def fold(page: Page) -> tuple[Tree, list[int]]:
    """(shape of a page, its node of each page node): siblings that repeat share a node."""
    labels, n = page.labels, len(page.labels)
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        kids[page.parents[k]].append(k)
    pool: dict[tuple, int] = {}
    shape = [0] * n
    for k in range(n - 1, -1, -1):
        shape[k] = pool.setdefault((labels[k], *dict.fromkeys(shape[x] for x in kids[k])), len(pool))
    place, out, parents = [0] * n, [labels[0]], [-1]
    members: list[list[int]] = [[0]]
    at = 0
    while at < len(out):
        groups: dict[object, int] = {}
        for k in members[at]:
            for x in kids[k]:
                label = labels[x]
                key = label if label.rstrip("!^-").encode() in ITEMS else shape[x]
                to = groups.get(key)
                if to is None:
                    to = groups[key] = len(out)
                    out.append(label), parents.append(at), members.append([])
                members[to].append(x)
                place[x] = to
        at += 1
    return Tree(out, parents), place


def align(a: Tree, b: Tree) -> list[int]:
    """Simple tree matching: for each node of b its partner in a, or -1. Children of equal shape at either end are paired first."""
    pool: dict[tuple, int] = {}
    sa, na = a.shapes(pool)
    sb, _ = b.shapes(pool)
    out = [-1] * len(b.labels)
    if a.labels[0] != b.labels[0]:
        return out

    def ends(i: int, j: int) -> tuple[int, int]:
        """How many children are paired from the left and from the right."""
        xs, ys = a.kids[i], b.kids[j]
        most, left, right = min(len(xs), len(ys)), 0, 0
        while left < most and sa[xs[left]] == sb[ys[left]]:
            left += 1
        while right < most - left and sa[xs[-1 - right]] == sb[ys[-1 - right]]:
            right += 1
        return left, right

    def middle(i: int, j: int) -> tuple[list[int], list[int]]:
        left, right = ends(i, j)
        return a.kids[i][left : len(a.kids[i]) - right], b.kids[j][left : len(b.kids[j]) - right]

    weight: dict[tuple[int, int], int] = {}

    def table(xs: list[int], ys: list[int]) -> list[list[int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = rows[-1], [0]
            for j, y in enumerate(ys):
                best = max(row[j], above[j + 1])
                if a.labels[x] == b.labels[y]:
                    best = max(best, above[j] + (na[x] if sa[x] == sb[y] else weight[x, y]))
                row.append(best)
            rows.append(row)
        return rows

    todo = [(0, 0)]
    while todo:  # children's weights first
        i, j = todo[-1]
        if (i, j) in weight:
            todo.pop()
            continue
        xs, ys = middle(i, j)
        lacking = [(x, y) for x in xs for y in ys if a.labels[x] == b.labels[y] and sa[x] != sb[y] and (x, y) not in weight]
        if lacking:
            todo += lacking
            continue
        left, right = ends(i, j)
        fixed = sum(na[x] for x in a.kids[i][:left] + a.kids[i][len(a.kids[i]) - right :])
        weight[i, j] = 1 + fixed + table(xs, ys)[-1][-1]
        todo.pop()
    pairs = [(0, 0)]
    while pairs:
        i, j = pairs.pop()
        out[j] = i
        if sa[i] == sb[j]:
            pairs += zip(a.kids[i], b.kids[j], strict=True)
            continue
        left, right = ends(i, j)
        pairs += zip(a.kids[i][:left], b.kids[j][:left], strict=True)
        pairs += zip(a.kids[i][len(a.kids[i]) - right :], b.kids[j][len(b.kids[j]) - right :], strict=True)
        xs, ys = middle(i, j)
        rows, p, q = table(xs, ys), len(xs), len(ys)
        while p and q:
            x, y = xs[p - 1], ys[q - 1]
            if a.labels[x] == b.labels[y] and rows[p][q] == rows[p - 1][q - 1] + (na[x] if sa[x] == sb[y] else weight[x, y]):
                pairs.append((x, y))
                p, q = p - 1, q - 1
            elif rows[p][q] == rows[p][q - 1]:
                q -= 1
            else:
                p -= 1
    return out


def absorb(a: Tree, b: Tree) -> None:
    """Merges b into a: what b alone has is put in after the partner of the sibling before it."""
    to = align(a, b)
    for k in range(len(b.labels)):
        last = None
        for x in b.kids[k]:
            if to[x] < 0:
                to[x] = len(a.labels)
                a.labels.append(b.labels[x])
                a.kids.append([])
                siblings = a.kids[to[k]]
                siblings.insert(0 if last is None else siblings.index(last) + 1, to[x])
            last = to[x]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _merged(rows: DataFrame, buckets: int) -> DataFrame:
    """(host, h, tree) → (host, h, tree): the trees of a host whose h are equal modulo buckets, merged in order of h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None

        def settle() -> pa.RecordBatch:
            return pa.record_batch({"host": pa.array([now[0]]), "h": pa.array([now[1]], pa.int64()), "tree": pa.array([tree.write()])})

        for batch in batches:
            for host, group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != (host, group):
                    if now:
                        yield settle()
                    now, tree = (host, group), Tree.read(text)
                else:
                    absorb(tree, Tree.read(text))
        if now:
            yield settle()

    grouped = rows.select("host", F.pmod("h", F.lit(buckets)).alias("g"), "h", "tree")
    return grouped.repartition("host", "g").sortWithinPartitions("host", "g", "h").mapInArrow(tidy(run), "host string, h long, tree string")


def _judge(tree: Tree, volume: dict[int, tuple[float, float]]) -> list[int]:
    """Slots that are content, from the varying characters of each slot and how many of them are in links."""
    n = len(tree.labels)
    hard, article = [False] * n, [False] * n
    for k in range(n):
        for x in tree.kids[k]:
            hard[x] = hard[k] or HARD in tree.labels[x]
            article[x] = article[k] or ARTICLE in tree.labels[x]
        hard[k] |= HARD in tree.labels[k]
    own = [0.0 if hard[k] else max(0.0, volume.get(k, (0.0, 0.0))[0] - volume.get(k, (0.0, 0.0))[1]) for k in range(n)]
    under = own[:]
    for k in range(n - 1, -1, -1):
        under[k] += sum(under[x] for x in tree.kids[k])
    hinted = [False] * n
    for k in range(n):
        for x in tree.kids[k]:
            hinted[x] = hinted[k] or HINT in tree.labels[x] and under[x] < BULK * max(under[0], 1.0)
    out = []
    for k in range(n):
        chars, linked = volume.get(k, (0.0, 0.0))
        menu = not article[k] and chars > 0 and linked >= LINKED * chars
        if not (hard[k] or hinted[k] or menu):
            out.append(k)
    return out


BLOCKS = "array<struct<node:int,text:long,chars:int,links:int>>"


def wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (url, html) → (host, tree, content slots), (host, slot, text): the wrapper of every host, and its constants.

    Pages with equal blocks count once, so copies of a page don't turn its article into a template.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out: list[tuple] = []
            for host, text in zip(batch.column(0).to_pylist(), raw(batch, "html"), strict=True):
                page = parse(text)
                if page.blocks:
                    tree, place = fold(page)
                    written = tree.write()
                    number = _preorder(tree)
                    hashes = [_hash(t) for _, t, _ in page.blocks]
                    told = {(number[place[k]], h): (number[place[k]], h, len(t), min(n, len(t))) for (k, t, n), h in zip(page.blocks, hashes, strict=True)}
                    body = xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes)) - (1 << 63)
                    out.append((host, body, _hash(written), written, [dict(zip(("node", "text", "chars", "links"), x, strict=True)) for x in told.values()]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int32()), ("links", pa.int32())]))
            yield pa.record_batch({n: pa.array(c, t) for n, c, t in zip(("host", "body", "h", "tree", "blocks"), cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), kind), strict=True)})

    read_pages = materialise(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(tidy(read), f"host string, body long, h long, tree string, blocks {BLOCKS}"))
    shapes = materialise(read_pages.groupBy("host", "h").agg(F.min("tree").alias("tree")))
    whole = materialise(_merged(_merged(shapes, BUCKETS), 1).select("host", "tree"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, Tree] = ("", Tree([""], [-1]))
        for batch in slices(batches, 256):
            got = []
            for text, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] != wrapper:
                    last = wrapper, Tree.read(wrapper)
                got.append(align(last[1], Tree.read(text)))
            yield pa.record_batch({"host": batch.column(0), "h": batch.column(1), "slots": pa.array(got, pa.list_(pa.int32()))})

    placed = materialise(shapes.join(whole.withColumnRenamed("tree", "wrapper"), "host").mapInArrow(tidy(slots), "host string, h long, slots array<int>"))
    # one row a distinct page; a place's texts are added up before they meet their slots, in salted copies, as one shape may have most of them
    distinct = materialise(read_pages.groupBy("host", "body").agg(F.min(F.struct("h", "blocks")).alias("p")).select("host", "p.h", "p.blocks"))
    counted = distinct.select("host", "h", F.inline("blocks")).groupBy("host", "h", "node", "text").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod("text", F.lit(SALTS)).cast("int")
    met = counted.withColumn("salt", salt).join(placed.select("*", salts), ["host", "h", "salt"])
    texts = met.groupBy("host", F.element_at("slots", F.col("node") + 1).alias("slot"), "text").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links"))
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    known = materialise(texts.withColumn("salt", salt).join(sizes.select("*", salts), ["host", "salt"]).withColumn("constant", (F.col("n") >= MIN_PAGES) & (F.col("n") >= SHARE * F.col("pages"))).drop("salt", "pages"))
    constants = materialise(known.where("constant and slot >= 0").select("host", "slot", "text"))
    volume = known.where("not constant and slot >= 0").groupBy("host", "slot").agg(F.sum(F.col("n") * F.col("chars")).cast("double").alias("chars"), F.sum(F.col("n") * F.col("links")).cast("double").alias("links"))
    volume = volume.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "links")).alias("volume"))  # a row a node of the wrapper

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_judge(Tree.read(t), {v["slot"]: (v["chars"], v["links"]) for v in some or ()}) for t, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch({"host": batch.column(0), "tree": batch.column(1), "content": pa.array(got, pa.list_(pa.int32()))})

    judged = whole.join(volume, "host", "left").mapInArrow(tidy(judge), "host string, tree string, content array<int>")
    return materialise(judged), constants


def _preorder(tree: Tree) -> list[int]:
    """The number that each node has in the written form."""
    number, stack, at = [0] * len(tree.labels), [0], 0
    while stack:
        k = stack.pop()
        number[k] = at
        at += 1
        stack += reversed(tree.kids[k])
    return number


class Wrapper:
    """A host's wrapper, ready to be laid over pages; alignments of shapes met before are kept, up to a fixed number."""

    def __init__(self, tree: str, content: list[int], constants: set[tuple[int, int]]) -> None:
        self.tree, self.content, self.constants = Tree.read(tree), set(content), constants
        self.known: dict[str, list[int]] = {}

    def text(self, page: Page) -> str:
        shape, place = fold(page)
        written = shape.write()
        slots = self.known.get(written)
        if slots is None:
            if len(self.known) > 1000:
                self.known.clear()
            slots = self.known[written] = align(self.tree, Tree.read(written))
        number = _preorder(shape)
        marked = [False] * len(page.labels)
        for k in range(1, len(page.labels)):
            up = page.parents[k]
            marked[k] = marked[up] or ARTICLE in page.labels[k]
        chosen = [(k, t, slots[number[place[k]]]) for k, t, _ in page.blocks]
        chosen = [(k, t, s) for k, t, s in chosen if s in self.content]
        if any(marked[k] for k, _, _ in chosen):
            chosen = [x for x in chosen if marked[x[0]]]
        return "\n".join([t for _, t, s in chosen if (s, _hash(t)) not in self.constants])


def extract(pages: DataFrame) -> DataFrame:
    """pages with text added (a column of that name is replaced) and html left out: the blocks of the article, one to a line.

    Null html is empty and gives an empty text; a null url is a host of its own (""). Every row gives one row, repeated ones alike.
    An empty table gives an empty one.
    """
    told, constants = wrappers(pages)
    rows = pages.drop("text").withColumn("_host", host_of(F.col("url")))
    keep = [c for c in rows.columns if c not in ("_host", "html")]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in keep], T.StructField("text", T.StringType())])
    small = (told.agg(F.sum(F.length("tree") + 4 * F.size("content"))).first()[0] or 0) <= SENT_CHARS and constants.limit(SENT_CONSTANTS + 1).count() <= SENT_CONSTANTS
    if small:
        fixed: dict[str, set[tuple[int, int]]] = {}
        for r in constants.collect():
            fixed.setdefault(r.host, set()).add((r.slot, r.text))
        known = {r.host: (r.tree, r.content, fixed.get(r.host, set())) for r in told.collect()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[str, Wrapper] = {}
            for batch in slices(batches, 256):
                at = batch.schema.get_field_index
                out = []
                for host, text in zip(batch.column(at("_host")).to_pylist(), raw(batch, "html"), strict=True):
                    if host not in ready and host in known:
                        ready[host] = Wrapper(*known[host])
                    out.append(ready[host].text(parse(text)) if host in ready else "")  # a host without a wrapper has no block
                yield pa.record_batch({c: batch.column(at(c)) for c in keep} | {"text": pa.array(out, pa.string())})

        return rows.mapInArrow(tidy(run), schema)
    # A wrapper goes before the pages of its host in order; hosts are dealt out in salted copies, as one may have a third of the pages
    sides = told.join(constants.groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("_fixed")), "host", "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    sides = sides.select(F.col("host").alias("_host"), salts, F.lit(0).alias("_kind"), F.col("tree").alias("_tree"), F.col("content").alias("_content"), "_fixed")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")).withColumn("_kind", F.lit(1))
    mixed = salted.unionByName(sides, allowMissingColumns=True).repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", "_kind")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, Wrapper] | None = None
        for batch in slices(batches, 256):
            at = batch.schema.get_field_index
            kinds, hosts, texts = batch.column(at("_kind")).to_pylist(), batch.column(at("_host")).to_pylist(), raw(batch, "html")
            out = []
            for k, kind in enumerate(kinds):
                if kind == 0:
                    tree, content, some = (batch.column(at(c))[k].as_py() for c in ("_tree", "_content", "_fixed"))
                    now = hosts[k], Wrapper(tree, content, {(x["slot"], x["text"]) for x in some or ()})
                else:
                    out.append(now[1].text(parse(texts[k])) if now and now[0] == hosts[k] else "")
            mine = batch.filter(pa.array([k == 1 for k in kinds], pa.bool_()))
            yield pa.record_batch({c: mine.column(at(c)) for c in keep} | {"text": pa.array(out, pa.string())})

    return mixed.mapInArrow(tidy(merge), schema)
