import math
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import htmltext

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head>
<body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now.
Les.</div><article><h1>Head &amp; line</h1><p><b>First   part<br>goes on.<br><p>Second&nbsp;one &eacute; &lt;b&gt; R&ampD &am</p><p>Third</p>
<aside>Side</aside><div class="comments"><p>Nice!</p></div><form><p>Mail</p></form><table><tr><td>1<td>2<tr><td>3</table></article><footer>&copy; x &middot; y</footer>"""


def text(blocks):
    return [t for _, t, main, noise in blocks if main and not noise]


def test_parse():
    assert text(htmltext.parse(PAGE)[0]) == ["Head & line", "First part goes on.", "Second one é <b> R&D &am", "Third", "1", "2", "3"]
    assert htmltext.parse("")[0] == [] and htmltext.parse("plain <b>text</b> 1 < 2")[0] == [("", "plain text 1 < 2", False, False)]
    assert text(htmltext.parse('<div class="page has-sidebar"><main><header class="entry-header"><h1>t</h1></header><ul><li><p>a<li>b</ul><p id=x aria-hidden=true>c<p hidden>d<div class="share">e</div></main><div class="sidebar">f</div>')[0]) == ["t", "a", "b", "c"]
    assert htmltext.parse("<ul><li><p>a<li>b</ul>")[0][1][0] == "ul/li"
    assert [t for _, t, *_ in htmltext.parse("<p>a<p>b</p></p>c<ul><li>d<li>e<ul><li>f</ul>g</ul><p cut")[0]] == ["a", "b", "c", "d", "e", "f", "g"]


def test_extract(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div class=top><p>Welcome to the site</p></div><div class=x><p>Text of page {i}</p><p>More {i * 7}</p></div></body>") for i in range(12)]
    rows += [(100, "https://b.example/", PAGE), (100, "https://b.example/", PAGE), (101, None, None), (102, "not a url", ""), (None, "http://a.example/", "<nav>only</nav>"), (103, "http://c.example/q", "<div>" * 300 + "deep " * 20000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, low int").repartition(3)
    out = htmltext.extract(df)
    assert out.columns == ["page_id", "url", "low", "text"]
    got = {}
    for x in out.collect():
        got.setdefault(x.page_id, []).append(x.text)
    for i in range(12):  # the branch that all pages share goes
        assert got[i] == [f"Text of page {i}\n\nMore {i * 7}"]
    assert len(got[100]) == 2 and got[100][0].startswith("Head & line\n\nFirst part goes on.\n\nSecond one")
    assert got[101] == [""] and got[102] == [""] and got[None] == [""] and got[103] == [("deep " * 20000).strip()]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_importance(spark):
    rows = [(i, "http://a.example/", f"<body><div><p>same</p></div><section><p>own {i}</p></section></body>") for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.path: x.importance for x in htmltext.importance(htmltext.trees(df)).collect()}
    assert got["body/div/p"] < 1e-9 and got["body/div"] < 1e-9 and abs(got["body/section/p"] - 1) < 1e-9


def test_tree_decides_in_articles(spark):
    frame = "<div class=k3x><p>Get our letter</p></div>"
    page = lambda i: f"<body><div class=z9><p>Lede {i}</p></div><div class=top><p>Welcome</p></div><article><h1>Head {i}</h1>{frame}<p>Own text {i}</p></article></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", page(7).replace("</body>", "<div class=b></div></body>")) for i in range(8)]  # copies of one page: no frame can be told
    rows += [(200 + i, f"http://c.example/{i}", page(i).replace("</body>", "<div class=own></div></body>")) for i in range(4)]  # too few pages, and none like them elsewhere
    rows += [(400 + i, f"http://e{i}.example/", page(i + 20).replace("</body>", "<div class=e></div></body>")) for i in range(8)]  # hosts of one page borrow from each other
    rows += [(300 + i, f"http://d.example/{i}", f"<body><p>By {i}<article><p>Same</p></article></body>") for i in range(3)]
    got = {x.page_id: x.text for x in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(8):
        assert got[i] == f"Lede {i}\n\nHead {i}\n\nOwn text {i}"
        assert got[100 + i] == "Head 7\n\nGet our letter\n\nOwn text 7"
    assert all(got[200 + i] == f"Head {i}\n\nGet our letter\n\nOwn text {i}" for i in range(4))
    assert all(got[300 + i] == "Same" for i in range(3))
    assert all(got[400 + i] == f"Lede {i + 20}\n\nHead {i + 20}\n\nOwn text {i + 20}" for i in range(8))


def brute_tree(pages, g=0.9):
    """path -> (pages, importance, presentation, information) of one host's merged tree, by recursion over dictionaries."""
    m, styles, texts, feats, kids = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    size = {}
    for p in pages:
        paths = [()]
        for up, step in zip(p.up[1:], p.step[1:]):
            paths.append((*paths[up], step))
            kids[paths[up]].add(paths[-1])
        for path, k in zip(paths, p.kids):
            m[path] += 1
            styles[path][tuple(k)] += 1
        mine, words = defaultdict(set), defaultdict(set)
        for n, t, links in p.blocks:
            if t not in mine[paths[n]]:
                mine[paths[n]].add(t)
                w = t.split(" ")
                if len(w) > htmltext.SHORT:
                    words[paths[n]].add(("text", t))
                    size["text", t] = len(w)
                else:
                    words[paths[n]] |= {("word", x) for x in w} | {("link", x) for x in links}
        for path in mine:
            texts[path].update(mine[path])
            feats[path].update(words[path])
    log = lambda k, n: math.log(k) / math.log(n) if n > 1 else 0

    def visit(path):
        n, own, below = m[path], texts[path], [visit(c) for c in sorted(kids[path])]
        said = sum(k * size.get(f, 1) * (1 - log(k, n)) for f, k in feats[path].items())
        repeated = sum(log(k, n) for k in own.values()) / len(own) if own else None
        shown = -sum(k / n * log(k / n, n) for k in styles[path].values()) if n > 1 else 1
        weight = sum(b[0] for b in below) + (n if own else 0)
        inner = (sum(b[0] * b[1] for b in below) + (n * (1 - repeated) if own else 0)) / weight if weight else 1
        depth = g ** sum(1 for x in styles[path] if x)
        out["/".join(path)] = n, 1 if n == 1 else (1 - depth) * shown + depth * inner, shown, said + sum(b[3] for b in below)
        return out["/".join(path)]

    out = {}
    visit(())
    return out


def test_tree_node_by_node(spark):
    r = random.Random(21)
    word = lambda: r.choice(["the", "a", "of"]) if r.random() < 0.4 else f"w{r.randrange(60)}"
    some = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        menu = "".join(f'<li><a href="/{r.randrange(9)}">{word()}</a></li>' for _ in range(r.randrange(3, 6)))
        body = "".join(r.choice([f"<p>{some(r.randrange(1, 30))}</p>", f"<h2>{some(3)}</h2>", f"<div class=q><p>{some(20)}</p>{some(2)}</div>", "text " + some(4) + "<br>"]) for _ in range(r.randrange(1, 7)))
        rows.append((i, f"http://{'ab'[i % 2]}.example/{i}", f"<html><body class=k{i % 3 == 0}><ul>{menu}</ul><div>Notice {i % 4}</div><div>{body}</div><footer>© all {some(2)}</footer></body></html>"))
    rows += [(100 + i, "http://a.example/", rows[0][2]) for i in range(5)]  # the same content counts once
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = defaultdict(dict)
    for x in htmltext.importance(htmltext.trees(df, declared=False)).collect():
        got[x._host[0]][x.path] = (x.pages, x.importance, x.presentation, x.information)
    for host in "ab":
        want = brute_tree([htmltext.Page(h) for i, u, h in rows[:60] if u[7] == host])
        assert got[host].keys() == want.keys() and len(want) > 30
        for path, values in want.items():
            assert got[host][path] == pytest.approx(values, abs=1e-9), path


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_tree_finds_articles(spark, sf):
    """The tree decides: without it nearly every page has another text, and also without article tags and class names, and with
    all that elements declare left out, it finds the articles, on hosts of a few pages too."""
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").repartition(8)
    html = F.regexp_replace(F.regexp_replace("html", "(</?)article>", "$1div>"), ' class="[^"]*"', "")
    bare = pages.withColumn("html", html)
    want = {x.page_id: htmltext.main_text(re.search("<article>(.*)</article>", x.html, re.S)[1]) for x in pages.collect()}
    text = lambda df, **how: {x.page_id: x.text for x in htmltext.extract(df, **how).collect()}
    assert text(pages) == want
    off = text(pages, tree=False)
    assert all(off[i] != t for i, t in want.items())
    alone, undeclared = text(bare, declared=False), text(pages, declared=False)
    assert sum(alone[i] == t for i, t in want.items()) >= 0.95 * len(want)
    assert sum(undeclared[i] == t for i, t in want.items()) >= 0.95 * len(want)


ODD = [("", "<a ", ""), ("", "<script ", ""), ("", "<div>", "x"), ("<b>", "<p>", ""), ("", "<p></div>", ""), ("", '<a href="', ""), ("", "<svg>", "x"), ("", "<!-- ", ""), ("<i>", "</p>", ""), ("", "=\"'<x a=", ""), ("<ul>", "<li>a", ""), ("", "&amp", ""), ("", "< ", ""), ("<a b= ", " ", "")]


@pytest.mark.parametrize("before,piece,after", ODD)
def test_time_grows_with_the_page(before, piece, after):
    """Twice the page takes about twice the time, whatever the machine."""

    def took(n):
        page = (before if before == "<ul>" else before * n) + piece * n + after
        best = math.inf
        for _ in range(3):
            start = time.process_time()
            p = htmltext.Page(page)
            p.content(p.noise())
            best = min(best, time.process_time() - start)
        return best

    n = 150_000 // max(1, len(before) + len(piece))
    assert took(4 * n) < 4 * 2.5 * max(took(n), 0.005)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<script " * 130_000, "<div>" * 200_000 + "x"])
def test_long_odd_pages_in_memory(page):
    tracemalloc.start()
    htmltext.Page(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000


def test_wrappers_and_unclosed():
    text = lambda page: htmltext.main_text(page)
    words = " ".join(f"w{i}" for i in range(80))
    assert text(f"<form id=aspnet><div class='layout-sidebar-left'><article><p>{words}</article></div></form>") == words
    assert text(f"<div class=search-page><p>{words}</p><div class=ad>one</div></div>") == words
    assert text(f"<svg/><p>{words}</p><svg>lost") == words + "\n\nlost"
    assert text(f'<p title="a > b">{words}</p><a href="x>rest') == words + "\n\nrest" and text(f'{words}<a href="x') == words
    assert text("<p>a<b c=\"d'>e</b></p>") == "ae" and text("<p>x <3 y</p>") == "x <3 y"


def test_frames_beside_the_content(spark):
    r = random.Random(4)
    rows = []
    for i in range(30):
        teasers = "".join(f"<a href=/{r.randrange(10**6)}>t{r.randrange(10**6)} u{r.randrange(10**6)}</a>" for _ in range(3))
        text = "".join(f"<p>{' '.join(f'x{r.randrange(10**6)}' for _ in range(25))}</p>" for _ in range(r.randrange(2, 9)))
        rows.append((i, "http://a.example/", f"<body><div class=z1>{teasers}</div><div class=z2><h1>Head {i}</h1>{text}<div class=z3>Read also our letter</div></div></body>", f"Head {i}\n\n" + "\n\n".join(re.findall("<p>(.*?)</p>", text))))
    df = spark.createDataFrame([(*x[:3], [1], "h") for x in rows], "page_id long, url string, html string, row array<int>, _host string").repartition(3)
    got = {x.page_id: x.text for x in htmltext.extract(df).collect()}
    assert all(got[i] == t for i, _, _, t in rows)
