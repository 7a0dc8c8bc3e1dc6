"""Main text of web pages by a site style tree.

Each page is read in one pass into element nodes and blocks of text. The trees of a host are merged: nodes are the same if
their ways from the root are, step by step (element, first class, and which of the like siblings). A merged node has
m pages, and of it the tree knows

- its presentation: the entropy, to base m, of the sequences of children that its pages show (always one: 0);
- its content: leaves are taken apart into features, which are the words and link targets of a short block and the whole
  text of a longer one. A feature that k of the m pages have carries 1 - log_m(k): all on one page, nothing on every page;
- its importance: of a leaf, 1 less the mean of log_m(k) over its texts; of an inner node, with l different sequences
  of children, (1 - g^l) * presentation + g^l * (the children's importance, by how many pages have them);
- its information: what the features below it carry, summed over the pages.

Of a node on enough pages the tree decides alone. It is low, and its branch leaves every page of the tree,
- if its importance is below a threshold: it repeats;
- if it stands beside the content: its parent shows all pages alike (a frame, by its presentation), one inner child has
  most of the parent's information, and this one has little beside it. Paragraphs, headings and the like are never
  taken for such, so articles aren't thinned out;
- if pages declare it as something else than text (a menu, form, advert, comments and so on, by element, role or class): its
  information then counts a small part, and beside any sibling that outweighs it so it is low. A node that holds nearly all
  that its parent has is a wrapper, whatever its class says.
What pages declare is the prior where the tree has too few pages of a node: such a node is low if it is declared so, and its
own text counts within <article> and <main> only, if the page has any. Pages with the same content count once, so copies
don't make an article a frame. Hosts with few pages borrow from each other: pages of all those whose body has the same
sequence of children, by style, make one tree.

A page is read once; its texts wait in a stored table. Layouts (the nodes of a page without its texts) come once a task and
host, blocks carry hashes of their features, and all counts are pre-aggregated in tasks. What is low comes back to the
pages by layout, so a host's nodes are never gathered. Nodes deeper than DEEPEST belong to their ancestor there: sums over the tree go level
by level, from written table to written table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Stored, trimmed

#: HTML element names by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe svg textarea title object canvas video audio".split()
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
NOISE = set("aside button datalist dialog fieldset footer form head label legend menu nav option select".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class or id that mark parts which are no article.
MARKS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: What a start tag closes, and where the search for it ends.
CLOSES = {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option", "p"}, {"select"})}
#: The same of all other blocks.
P, STOPS = {"p"}, {"article", "section", "div", "body", "td", "li", "table"}

#: Elements that hold text as such, which no weighing against siblings takes away.
PLAIN = set("blockquote dd dl dt figure h1 h2 h3 h4 h5 h6 hgroup p pre table".split())
#: Elements that may wrap a whole page whatever their class says.
WRAPPERS = set("center div fieldset form section table tbody td tr".split())
#: Levels of the tree that are judged, words of a block that is taken apart, and the share of its parent's words or
#: information from which on a declared part is taken for a wrapper.
DEEPEST, SHORT, WHOLE = 32, 12, 0.95

NAME = re.compile(r"[^\s/>]*+")
TAG_STOP = re.compile(r">|=\s*+[\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
TO_THE_END = {"script", "style", "textarea", "title"}
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _style(tag: str, rest: str, inside: bool = False) -> tuple[str, bool, str | None]:
    """A node's style (tag and first class), whether its name, role, class or id says that it holds no article, and its
    link target. What is called a header inside an article is the article's own; a wrapper "with" or "without" a part
    isn't that part."""
    noise, cls, href = tag in NOISE, "", None
    for m in ATTRIBUTE.finditer(rest) if rest else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "href":
            href = value
        elif key == "role":
            noise |= value.lower() in ROLES
        elif key == "hidden":
            noise |= value.lower() != "until-found"
        elif key in ("class", "id"):
            names = value.lower().split()
            if key == "class" and names:
                cls = "." + names[0]
            if tag not in ("html", "body", "main", "article"):
                for name in names:
                    marks = set(re.split(r"[^a-z0-9]+", name))
                    noise |= bool(marks & MARKS - {"header" if inside else ""}) and not marks & {"has", "with", "no", "without"}
    return tag + cls, noise, href


class Page:
    """The nodes (lists with one entry a node, parents first; the root is node 0) and blocks (node, text, link targets) of a page."""

    def __init__(self, page: str):
        self.up, self.tag, self.step, self.depth = [-1], [""], [""], [0]
        self.marked, self.main = [False], [False]
        self.kids: list[list[str] | tuple] = [()]  # lists and counts only where there are children
        self.counts: list[dict[str, int] | None] = [None]
        self.blocks: list[tuple[int, str, tuple[str, ...]]] = []
        self._read(page)

    def _node(self, parent: int, tag: str, style: str, marked: bool) -> int:
        count = self.counts[parent]
        if count is None:
            self.counts[parent], self.kids[parent] = {style: 1}, [style]
            n = 1
        else:
            n = count[style] = count.get(style, 0) + 1
            self.kids[parent].append(style)
        self.up.append(parent)
        self.tag.append(tag)
        self.step.append(style if n == 1 else f"{style}[{n}]")
        self.depth.append(self.depth[parent] + 1)
        self.marked.append(marked and tag not in ("html", "body"))
        self.main.append(self.main[parent] or tag in ("article", "main"))
        self.kids.append(())
        self.counts.append(None)
        return len(self.up) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements and the nodes that their text belongs to
        open_at: dict[str, list[int]] = {}  # where in the stack each tag is
        text: list[str] = []
        links: list[str] = []
        unclosed: set[str] = set()  # raw elements and quotes that have no end from here on
        at, size = 0, len(page)

        def flush() -> None:
            if text:
                t = "".join(text)
                text.clear()
                t = " ".join((entities.unescape(t) if "&" in t else t).split())
                if t:
                    self.blocks.append((stack[-1][1] if stack else 0, t, tuple(links)))
                    links.clear()

        def close(to: int) -> None:
            while len(stack) > to:
                open_at[stack.pop()[0]].pop()

        def nearest(tags) -> int:
            at = -1
            for t in tags:
                if (where := open_at.get(t)) and where[-1] > at:
                    at = where[-1]
            return at

        while at < size:
            lt = page.find("<", at)
            if lt < 0 or lt == size - 1:
                text.append(page[at:])
                break
            if lt > at:
                text.append(page[at:lt])
            c = page[lt + 1]
            if c in "!?":
                comment = page.startswith("<!--", lt)
                end = page.find("-->" if comment else ">", lt + 2)
                if end < 0:
                    break
                at = end + (3 if comment else 1)
                continue
            ending = c == "/" and page[lt + 2 : lt + 3] in LETTERS
            if not ending and c not in LETTERS:
                text.append("<")
                at = lt + 1
                continue
            after = NAME.match(page, lt + 1 + ending).end()
            tag = page[lt + 1 + ending : after].lower()
            end = after
            while end >= 0 and page[end : end + 1] != ">":  # quotes count behind an equals sign
                m = TAG_STOP.search(page, end)
                if m is None:
                    end = -1
                elif m[0] == ">":
                    end = m.start()
                else:
                    quote, end = m[0][-1], m.end()
                    if quote not in unclosed:
                        found = page.find(quote, end)
                        if found >= 0:
                            end = found + 1
                        else:
                            unclosed.add(quote)
            if end < 0:  # a tag that the end of the page cuts off
                break
            rest, at = page[after:end], end + 1
            if ending:
                if tag in BLOCK:
                    flush()
                if open_at.get(tag):
                    close(open_at[tag][-1])
                continue
            closed = rest.endswith("/")
            if tag in RAW_END:
                if not closed and tag not in unclosed:
                    m = RAW_END[tag].search(page, at)
                    if m:
                        end = page.find(">", m.end())
                        at = size if end < 0 else end + 1
                    elif tag in TO_THE_END:
                        at = size
                    else:
                        unclosed.add(tag)
                continue
            if tag == "br":
                text.append(" ")
                continue
            block = tag in BLOCK
            if block:
                flush()
                ends, stop = CLOSES.get(tag, (P, STOPS))
                if (to := nearest(ends)) >= 0:
                    floor = nearest(stop)
                    while to > floor:
                        close(to)
                        to = nearest(ends)
            if tag in VOID:
                continue
            node = stack[-1][1] if stack else 0
            style, marked, href = _style(tag, rest, self.main[node]) if rest else (tag, tag in NOISE, None)
            if tag == "a" and href:
                links.append(href)
            if block or marked:
                if self.depth[node] < DEEPEST:
                    node = self._node(node, tag, style, marked)
            elif closed:
                continue
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))
        flush()

    def noise(self) -> list[bool]:
        """Of each node whether it or one above it is declared as no article and isn't a wrapper of nearly all its parent has."""
        words = [0] * len(self.up)
        for node, t, _ in self.blocks:
            words[node] += 1 + t.count(" ")
        for i in range(len(words) - 1, 0, -1):
            words[self.up[i]] += words[i]
        out = [False]
        for i in range(1, len(words)):
            up = self.up[i]
            mark = self.marked[i] and not (self.tag[i] in WRAPPERS and words[i] and words[i] >= WHOLE * words[up])
            out.append(mark or out[up])
        return out

    def content(self, noise: list[bool]) -> list[str]:
        """The texts without noise: of the page's articles, or all."""
        return [t for n, t, _ in self.blocks if self.main[n] and not noise[n]] or [t for n, t, _ in self.blocks if not noise[n]]


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Ids:
    """Numbers of nodes by their way from the root; ways seen before are remembered, up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[tuple[int, str], int] = {}
        self.most = most

    def of(self, page: Page) -> list[int]:
        ids = [0]
        for up, step in zip(page.up[1:], page.step[1:]):
            key = (ids[up], step)
            if (x := self.known.get(key)) is None:
                if len(self.known) > self.most:
                    self.known.clear()
                x = self.known[key] = _hash(b"%d/" % ids[up] + _utf8(step))
            ids.append(x)
        return ids


def parse(page: str) -> tuple[list[tuple[str, str, bool, bool]], list[tuple[str, str, int]]]:
    """Blocks (path of styles, text, in an article, noise) in page order, and nodes (path, child styles, children), for the eye."""
    p = Page(page)
    noise, paths = p.noise(), [""]
    for up, step in zip(p.up[1:], p.step[1:]):
        paths.append((paths[up] + "/" if up else "") + re.sub(r"\[\d+\]$", "", step))
    return [(paths[n], t, p.main[n], noise[n]) for n, t, _ in p.blocks], [(paths[i], " ".join(k), len(k)) for i, k in enumerate(p.kids) if k]


def _host(pages: DataFrame) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(pages["url"].cast("string"), F.lit("HOST")), F.lit("")))


NODE = [("id", pa.int64()), ("up", pa.int64()), ("depth", pa.int32()), ("step", pa.string()), ("style", pa.int64()), ("kids", pa.int32()), ("marked", pa.bool_()), ("wraps", pa.bool_()), ("plain", pa.bool_()), ("main", pa.bool_())]
LEAF = [("id", pa.int64()), ("h", pa.int64()), ("w", pa.int32()), ("words", pa.list_(pa.int64()))]
TREE = """_host string, page string, layout bigint,
    nodes array<struct<id:bigint,up:bigint,depth:int,step:string,style:bigint,kids:int,marked:boolean,wraps:boolean,plain:boolean,main:boolean>>,
    blocks array<struct<id:bigint,h:bigint,w:int,words:array<bigint>>>"""


def _leaves(page: Page, ids: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(node, hash of the text, its words if it is one feature, hashes of its words and links if it isn't) of each
    different text of a node."""
    seen, said = set(), set()
    for node, t, links in page.blocks:
        h = _hash(_utf8(t))
        if (node, h) not in seen:
            seen.add((node, h))
            n, words = 1 + t.count(" "), []
            if n <= SHORT:  # a page says a word once for a node
                words = sorted({_hash(_utf8(x)) for x in (*t.split(" "), *(f"\0{x}" for x in links)) if (node, x) not in said and not said.add((node, x))})
            yield ids[node], h, n if n > SHORT else 0, words


def _lists(rows: list[list[tuple] | None], fields: list) -> pa.Array:
    """An array of lists of structs; None is null."""
    flat = [x for row in rows for x in row or ()]
    columns = list(zip(*flat)) or [()] * len(fields)
    parts = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x or ()) for x in rows)]), pa.int32()), parts, mask=pa.array([x is None for x in rows], pa.bool_()))


def _some(b: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` characters of a column; a longer page goes by itself."""
    at = total = 0
    for i, x in enumerate(b.column(column)):
        n = len(x.as_buffer()) if x.is_valid else 0
        if i > at and (total + n > most or i - at >= 500):
            yield b.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < b.num_rows:
        yield b.slice(at)


TEXT = [("id", pa.int64()), ("said", pa.bool_()), ("text", pa.string())]
READ = TREE + ", shape bigint, texts array<struct<id:bigint,said:boolean,text:string>>"


def read(pages: DataFrame, rest: list[str], declared: bool = True) -> DataFrame:
    """Every page as (row: the columns `rest`, _host, page: hash of its content, layout, nodes: the layout's on its first page
    in a task, else null, blocks, shape: hash of its body's children, texts: its blocks with whether it declares them as its
    content).

    declared=False: what elements, roles and classes declare is left out."""
    df = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), _host(pages).alias("_host"), F.col("html").cast("string").alias("html"))
    names = ["_host", "page", "layout", "nodes", "blocks", "shape", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids_of, seen = Ids(), set()
        for b in batches:
            for part in _some(b, 2):
                key, layouts, nodes, blocks, shapes, texts = [], [], [], [], [], []
                for host, x in zip(part.column(1), part.column(2)):
                    p = Page(x.as_py() or "")
                    ids = ids_of.of(p)
                    noise = p.noise() if declared else [False] * len(ids)
                    inside = declared and any(p.main[n] and not noise[n] for n, *_ in p.blocks)
                    said = [not noise[n] and (p.main[n] or not inside) for n, *_ in p.blocks]
                    key.append(xxhash.xxh3_128_hexdigest(_utf8("\n\n".join(t for (_, t, _), own in zip(p.blocks, said) if own))))
                    styles = [_hash(_utf8(" ".join(k))) for k in p.kids]
                    layout = _hash(np.array(ids + styles, np.int64).tobytes())
                    layouts.append(layout)
                    blocks.append(list(_leaves(p, ids)))
                    shapes.append(_hash(_utf8(" ".join(p.kids[p.tag.index("body") if "body" in p.tag else 0]))))
                    texts.append([(ids[n], own, t) for (n, t, _), own in zip(p.blocks, said)])
                    if (host.as_py(), layout) in seen:
                        nodes.append(None)
                    else:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add((host.as_py(), layout))
                        flags = [(p.marked[i] and declared, p.tag[i] in WRAPPERS, p.tag[i] in PLAIN, p.main[i] and declared) for i in range(len(ids))]
                        nodes.append([(ids[i], ids[max(0, p.up[i])], p.depth[i], p.step[i][:200], styles[i], len(p.kids[i]), *flags[i]) for i in range(len(ids))])
                columns = [part.column(1), pa.array(key, pa.string()), pa.array(layouts, pa.int64()), _lists(nodes, NODE), _lists(blocks, LEAF), pa.array(shapes, pa.int64()), _lists(texts, TEXT)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["row", *names])

    schema = df.select("row").schema
    for field in T.StructType.fromDDL(READ).fields:
        schema = schema.add(field)
    return df.mapInArrow(trimmed(run), schema)


def trees(pages: DataFrame, declared: bool = True) -> DataFrame:
    """What the tree is made of: (_host, page, layout, nodes, blocks) of every page."""
    return read(pages, ["url"], declared).select("_host", "page", "layout", "nodes", "blocks")


def main_text(page: str) -> str:
    """The text that a page by itself declares as its content."""
    p = Page(page)
    return "\n\n".join(p.content(p.noise()))


def _log(k: Column | str, m: Column | str) -> Column:
    """log to base m of k, which a node's m bounds; 0 for a node of one page."""
    return F.when(F.col("m") > 1, F.log(F.least(k, m)) / F.log(m)).otherwise(F.lit(0.0))


def merged(parsed: DataFrame, store: Stored, g: float = 0.9) -> DataFrame:
    """A stored table of the nodes of the hosts' merged trees: _host, id, up, depth, step, m (pages), marked, wraps, plain,
    main, presentation, importance, information, own (whether it has text of its own) and kids (at most on a page).
    parsed: a stored table of trees()."""
    at = ["_host", "id"]
    once = store.put("once", parsed.groupBy("_host", "page").agg(F.min(F.struct("layout", "blocks")).alias("x")).select("_host", "x.layout", "x.blocks"))
    layouts = parsed.where("nodes is not null").groupBy("_host", "layout").agg(F.first("nodes").alias("nodes"))
    layouts = layouts.join(once.groupBy("_host", "layout").agg(F.count(F.lit(1)).alias("c")), ["_host", "layout"])
    same = [F.first(c).alias(c) for c in ("up", "depth", "step", "marked", "wraps", "plain", "main")]
    styles = layouts.select("_host", "c", F.explode("nodes").alias("n")).select("_host", "c", "n.*").groupBy(*at, "style").agg(F.sum("c").alias("k"), F.max("kids").alias("kids"), *same)
    nodes = styles.groupBy(*at).agg(F.sum("k").alias("m"), F.sum(F.when(F.col("kids") > 0, 1).otherwise(0)).alias("l"), F.sum(F.col("k") * F.log("k")).alias("klogk"), F.max("kids").alias("kids"), *same)
    nodes = nodes.withColumn("presentation", F.when(F.col("m") > 1, 1 - F.col("klogk") / (F.col("m") * F.log("m"))).otherwise(F.lit(1.0))).drop("klogk")
    nodes = store.put("nodes", nodes)
    m = nodes.select(*at, "m")
    leaf = once.select("_host", F.explode("blocks").alias("b"))
    texts = leaf.groupBy("_host", "b.id", "b.h").agg(F.count(F.lit(1)).alias("k"), F.max("b.w").alias("w")).join(m, at)
    texts = texts.groupBy(*at).agg(F.avg(_log("k", "m")).alias("repeated"), F.sum(F.col("k") * F.col("w") * (1 - _log("k", "m"))).alias("carried"))
    words = leaf.select("_host", "b.id", F.explode("b.words").alias("f")).groupBy(*at, "f").agg(F.count(F.lit(1)).alias("k")).join(m, at)
    words = words.groupBy(*at).agg(F.sum(F.col("k") * (1 - _log("k", "m"))).alias("said"))
    own = store.put("own", texts.join(words, at, "left").select(*at, "repeated", (F.col("carried") + F.coalesce("said", F.lit(0.0))).alias("carried")))
    nodes = nodes.join(own, at, "left")
    below, levels = None, []
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):  # at most DEEPEST rounds
        mine = nodes.where(F.col("depth") == depth)
        if below is None:
            mine = mine.withColumns({"told": F.lit(0.0), "parts": F.lit(0.0), "weight": F.lit(0).cast("long")})
        else:
            sums = below.groupBy("_host", F.col("up").alias("id")).agg(F.sum("information").alias("told"), F.sum(F.col("importance") * F.col("m")).alias("parts"), F.sum("m").alias("weight"))
            mine = mine.join(sums, at, "left")
        # text of its own is one more child
        parts = F.coalesce("parts", F.lit(0.0)) + F.when(F.col("repeated").isNotNull(), (1 - F.col("repeated")) * F.col("m")).otherwise(F.lit(0.0))
        weight = F.coalesce("weight", F.lit(0)) + F.when(F.col("repeated").isNotNull(), F.col("m")).otherwise(F.lit(0))
        depths = F.pow(F.lit(g), "l")
        importance = F.when(F.col("m") == 1, F.lit(1.0)).otherwise((1 - depths) * F.col("presentation") + depths * F.when(weight > 0, parts / weight).otherwise(F.lit(1.0)))
        mine = mine.select(*at, "up", "depth", "step", "m", "marked", "wraps", "plain", "main", "kids", "presentation", F.col("repeated").isNotNull().alias("own"), importance.alias("importance"), (F.coalesce("told", F.lit(0.0)) + F.coalesce("carried", F.lit(0.0))).alias("information"))
        below = store.put(f"level{depth}", mine)
        levels.append(below)
    store.drop("once", "own", "nodes")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def importance(parsed: DataFrame, g: float = 0.9) -> DataFrame:
    """(_host, path, pages, importance, presentation, information) of every node of the hosts' merged trees, for the eye."""
    store = Stored(parsed.sparkSession)
    nodes = store.put("merged", merged(store.put("trees", parsed), store, g))
    now = nodes.where("depth = 0").select("*", F.lit("").alias("path"))
    out, level = now, 0
    while not now.isEmpty():
        level += 1
        up = now.select("_host", F.col("id").alias("up"), F.col("path").alias("above"))
        now = store.put(f"paths{level}", nodes.where("depth > 0").join(up, ["_host", "up"]).withColumn("path", F.concat("above", F.when(F.col("above") == "", "").otherwise("/"), "step")).drop("above"))
        out = out.unionByName(now)
    return out.select("_host", "path", F.col("m").alias("pages"), "importance", "presentation", "information")


def judge(nodes: DataFrame, threshold: float, least_pages: int, share: float, frame: float, prior: float) -> DataFrame:
    """(_host, id, low, bare) of the nodes that are low, or whose own text only counts inside of a page's articles."""
    at = ["_host", "up"]
    inner = (F.col("kids") > 0) & ~F.col("plain")
    weight = F.col("information") * F.when(F.col("marked"), F.lit(prior)).otherwise(F.lit(1.0))
    weighed = nodes.where("depth > 0").withColumns({"weight": weight, "inner": inner})
    beside = weighed.groupBy(*at).agg(F.sum("weight").alias("all"), F.max(F.struct("weight", "inner")).alias("best"))
    parents = nodes.select("_host", F.col("id").alias("up"), F.col("presentation").alias("shown"), F.col("information").alias("has"), F.col("m").alias("of"))
    seen = weighed.join(beside, at).join(parents, at)
    framed = (F.col("of") >= least_pages) & (F.col("shown") < frame) & F.col("best.inner") & (F.col("best.weight") >= 0.5 * F.col("all")) & ~F.col("plain")
    wrapper = F.col("wraps") & (F.col("information") > 0) & (F.col("information") >= WHOLE * F.col("has"))
    told = (F.col("importance") < threshold) | (framed | F.col("marked") & ~wrapper) & (F.col("weight") < share * F.col("best.weight"))
    known = F.col("m") >= least_pages
    frame_of_all = F.col("step").rlike(r"^(html|body)([.\[]|$)")
    low = ~frame_of_all & F.when(known, told).otherwise(F.col("marked") & ~wrapper)
    bare = ~known & ~F.col("main")
    return seen.select("_host", "id", low.alias("low"), bare.alias("bare")).where(F.col("low") | F.col("bare"))


def dropped(layouts: DataFrame, judged: DataFrame) -> DataFrame:
    """(_host, layout, drop: the numbers of the nodes whose own text leaves pages with that layout). A layout's nodes are
    no more than one page's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drops = []
            for nodes in b.column(2).to_pylist():
                nodes.sort(key=lambda n: n["at"])  # parents first
                gone: dict[int, bool] = {}
                for n in nodes:
                    gone[n["id"]] = bool(n["low"]) or gone.get(n["up"], False)
                inside = any(n["main"] and not gone[n["id"]] for n in nodes)
                drops.append([n["id"] for n in nodes if gone[n["id"]] or inside and n["bare"] and not n["main"]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(drops, pa.list_(pa.int64()))], names=["_host", "layout", "drop"])

    each = layouts.select("_host", "layout", F.posexplode("nodes").alias("at", "n")).select("_host", "layout", "at", "n.id", "n.up", "n.main")
    each = each.join(judged, ["_host", "id"], "left").groupBy("_host", "layout").agg(F.collect_list(F.struct("at", "id", "up", "main", F.coalesce("low", F.lit(False)).alias("low"), F.coalesce("bare", F.lit(False)).alias("bare"))).alias("nodes"))
    return each.mapInArrow(trimmed(run), "_host string, layout bigint, drop array<bigint>")


def extract(pages: DataFrame, threshold: float = 0.25, least_pages: int = 5, share: float = 0.2, frame: float = 0.3, prior: float = 0.02, pool: int = 20, declared: bool = True, tree: bool = True) -> DataFrame:
    """pages' columns but html, with text (blocks joined by blank lines; empty if none).

    threshold: importance below which a node is low; least_pages: pages of its tree (those with the same content count
    once) that a node must be on to be judged; share: the part of its best sibling's weight below which a node beside the
    content is low; frame: the presentation below which pages are alike; prior: what a declared part's information counts;
    pool: pages with different contents from which on a host has a tree of its own. declared=False leaves all declarations
    out; tree=False judges nothing and gives all of a page's text.

    Null and empty pages give an empty text; pages without a host are pooled like those of small hosts; ties go by the
    numbers of nodes. If every block of a page is low, what it declares stays. Repeated pages each get their text; a column
    named text is replaced and any other name may occur; an empty table gives an empty one. Pages of any length are read in
    one pass, in time and memory in proportion to them; an element without an end ends with its parent, a tag without one
    with the page, a quote without one at its tag's next angle."""
    store = Stored(pages.sparkSession)
    rest = [c for c in pages.columns if c not in ("html", "text")]
    parsed = store.put("read", read(pages, rest, declared), compact=True)
    if tree:
        large = parsed.select("_host", "page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= pool) & (F.col("_host") != ""))
        large = store.put("large", large.select("_host", F.lit(True).alias("_large")))
        of = F.when(F.col("_large"), F.concat(F.lit("="), F.col("_host"))).otherwise(F.concat(F.lit("~"), F.col("shape").cast("string")))
        keyed = parsed.join(large, "_host", "left").withColumn("_host", of)
        nodes = store.put("merged", merged(keyed.select("_host", "page", "layout", "nodes", "blocks"), store))
        judged = store.put("judged", judge(nodes, threshold, least_pages, share, frame, prior))
        layouts = keyed.where("nodes is not null").groupBy("_host", "layout").agg(F.first("nodes").alias("nodes"))
        drops = store.put("drops", dropped(layouts, judged))
        row = keyed.select("row", "_host", "layout", "texts").join(drops, ["_host", "layout"], "left").select("row", "texts", "drop")
    else:
        row = parsed.select("row", "texts", F.lit(None).cast("array<bigint>").alias("drop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for texts, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                drop = set(drop or ())
                kept = [x["text"] for x in texts if x["id"] not in drop]
                out.append("\n\n".join(kept or [x["text"] for x in texts if x["said"]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["row", "text"])

    out = row.mapInArrow(trimmed(run), row.select("row").schema.add("text", "string"))
    return out.select(*(F.col(f"row.`{c}`") for c in rest), "text")
