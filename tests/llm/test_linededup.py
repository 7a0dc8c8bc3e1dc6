import random
from collections import defaultdict

from lodestone.llm import linededup

BLANK = " \t\r\x0b\x0c"


def brute(rows, ratio):
    """rows (id, text, host) without their host's boilerplate."""
    pages, lines = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for _, t, h in rows:
        pages[h].add(t or "")
        for x in {x.strip(BLANK) for x in (t or "").split("\n")} - {""}:
            lines[h][x].add(t)
    out = []
    for i, t, h in rows:
        keep = [x for x in (t or "").split("\n") if not len(lines[h][x.strip(BLANK)]) - 1 > ratio * (len(pages[h]) - 1)]
        out.append((i, t if t is None else "\n".join(keep), h))
    return out


def test_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(300):
        lines = [f"own {i} {k}" for k in range(r.randrange(3))] + [r.choice(["menu", " menu ", "menu\t", "foot", "", "x\r", "\t \r"]) for _ in range(r.randrange(4))]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), r.choice(["a", "a", "b", None, "c" + str(i)])))
    rows += [(900, None, "a"), (901, "", "b"), (902, "menu\nmenu", "a"), (None, "foot\nmine", None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, source string, row int, _drop string").repartition(5)
    for ratio in (0.02, 0.1, 0.3):
        out = linededup.drop_boilerplate(df, ratio=ratio)
        assert out.columns == [*df.columns, "n_lines_dropped"]
        assert sorted(map(repr, ((x.doc_id, x.text, x.source) for x in out.collect()))) == sorted(map(repr, brute(rows, ratio)))
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0


def test_hosts_of_all_sizes(spark):
    """By the ratio alone: a menu on all pages goes on hosts of 2 to 50 pages, rare lines and lone pages stay."""
    rows = []
    for n in (1, 2, 3, 4, 9, 20, 21, 22, 40, 50):
        for i in range(n):
            seldom = "seldom" if i < 1 + (n - 1) // 20 else f"other {i}"  # at the ratio or below
            often = "often" if i < 2 + (n - 1) // 20 else f"more {i}"  # just above it
            rows.append((len(rows), f"menu\n{seldom}\nown {i}\n{often}\n foot ", f"h{n}"))
        rows += [(len(rows) + k, rows[-1][1], f"h{n}") for k in range(5)]  # copies are no pages of their own
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {x.doc_id: x for x in linededup.drop_boilerplate(df).collect()}
    assert sorted((i, x.text, x.source) for i, x in got.items()) == sorted(brute(rows, 0.05))
    for i, t, h in rows:
        n, lines = int(h[1:]), got[i].text.split("\n")
        assert ("menu" in lines) == (" foot " in lines) == (n == 1)
        assert [x for x in lines if x.startswith(("own", "seldom"))] == [x for x in t.split("\n") if x.startswith(("own", "seldom"))]
        assert n == 1 or "often" not in lines


def test_frames_only_and_long_texts(spark):
    rows = [(i, f"frame\n frame \t\nlong {i} " + "word " * 50_000 if i < 6 else "frame\n\nframe", "c") for i in range(7)]
    got = {x.doc_id: x for x in linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].text == rows[i][1].split("\n")[2] and got[i].n_lines_dropped == 2 for i in range(6))
    assert got[6].text == "" and got[6].n_lines_dropped == 2  # only its blank line is left
