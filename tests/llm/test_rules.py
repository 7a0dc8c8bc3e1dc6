import math
import random
import re
from fractions import Fraction

import pytest

from lodestone.llm import rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


TEXTS = [None, "", " \n ", "a\n\na\n a\na ", "x y\tz\x0b\x0cq\r\nx", "a b c d e a b c d e", "a " * 40, "é ß # ** <>|&%$", "nb\xa0sp x\x85y\x1cz", "l1 a\nl2\nl1 a\t\nl1 a"]


def test_measures(spark):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice(["a", "b", "c\n", "#"]) for _ in range(r.randrange(60))) for _ in range(80)]
    for t in texts:
        assert rules.measure(t)[:5] == brute(t), repr(t)
    rows = [(i, t, "en", "x") for i, t in enumerate(texts)] + [(0, None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for x in rules.apply_rules(df, labels).collect():
        want = brute(texts[x.doc_id])
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert tuple(x[c] for c in rules.COUNTS) == want and x.base_failed == failed and x.kept == (not failed)
    assert rules.apply_rules(df.limit(0), labels).count() == 0


def test_binomial_bound():
    for k, n, d in ((0, 100, 0.05), (3, 50, 0.01), (7, 7, 0.1), (0, 1, 0.5), (40, 1000, 0.001)):
        p = rules.binomial_upper(k, n, d)
        if k < n:
            assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - d) < 1e-9
        else:
            assert p == 1


def test_certified_cutoffs(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(3000):
        bad, lang = i % 5 == 0, "en" if i % 3 else None
        w = [f"w{r.randrange(10**6)}" + ("#" * 3 if bad else "") for _ in range(30)]
        docs.append((i, " ".join(w), lang if i < 2990 else "rare"))
        labels.append((i, 0 if bad else 1))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = rules.apply_rules(df, lab).collect()
    assert all(x.kept == bool(labels[x.doc_id][1]) for x in got if x.lang != "rare")
    assert all(x.kept for x in got if x.lang == "rare")  # too few labels to certify a cutoff


def test_bound_at_any_size():
    for k, n, p in ((50, 600, 0.125), (570, 600, 0.96875), (1, 30, 0.25), (17, 18, 0.875), (2500, 20_000, 0.125)):
        up, down = int(p * 32), 32 - int(p * 32)  # in whole numbers
        whole = Fraction(sum(math.comb(n, i) * up**i * down ** (n - i) for i in range(max(0, k - 600), k + 1)), 32**n)
        assert abs(rules.binomial_below(k, n, p) / float(whole) - 1) < 1e-10
    n, k, delta = 4_000_000_000, 49_600_000, 0.0025
    p = rules.binomial_upper(k, n, delta)
    # the normal form is good to a few parts in ten thousand here
    z = (k + 0.5 - n * p) / math.sqrt(n * p * (1 - p))
    assert abs(0.5 * math.erfc(-z / math.sqrt(2)) / delta - 1) < 2e-3
    assert p > 0.0124046 and rules.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01)


def brute_cutoffs(rows, strata, risk=0.05, delta=0.05):
    """The cutoffs of one stratum by counting. rows: (measures, good)."""
    names, n = list(rules.CUTOFFS), sum(g for _, g in rows)

    def ladder(steps, hit, r, d):
        best, top = None, 0
        for i in range(steps):
            k = sum(g for m, g in rows if hit(m, i))
            if n == 0 or (k < n and rules.binomial_below(k, n, r) > d) or k >= n:
                break
            gain = sum(1 - 2 * g for m, g in rows if hit(m, i))
            if gain > top:
                best, top = i, gain
        return best

    out = dict.fromkeys(names)
    if n and (1 - risk / 4) ** n <= delta / strata / 4:
        for name in names:
            i = ladder(len(rules.CUTOFFS[name]), lambda m, i: m[name] > rules.CUTOFFS[name][i], risk / 4, delta / strata / 4)
            out[name] = None if i is None else rules.CUTOFFS[name][i]
    else:
        at = lambda name, i: rules.CUTOFFS[name][min(i, len(rules.CUTOFFS[name]) - 1)]
        i = ladder(9, lambda m, i: any(m[x] > at(x, i) for x in names), risk, delta / strata)
        if i is not None:
            out = {x: at(x, i) for x in names}
    return out


def test_cutoffs_by_counting(spark):
    r, docs, labels = random.Random(9), [], []
    for i in range(4000):
        lang = r.choices(["en", None, "de", "few"], [60, 25, 12, 3])[0]
        bad = r.random() < 0.3
        w = [("W" if r.random() < (0.6 if bad else 0.1) else "w") + str(r.randrange(10**6)) + ("#" if r.random() < r.choice([0.02, 0.3, 0.8] if bad else [0, 0.05, 0.12]) else "") for _ in range(r.randrange(5, 60))]
        docs.append((i, " ".join(w), lang, "n", 3))
        labels.append((i, int(not bad)))
    docs.append((9000, "word " * 300_000, "en", "n", 3))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, _lines string, _upper int").repartition(3)
    got = {x.doc_id: x for x in rules.apply_rules(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == 4001 and got[9000].base_failed and got[9000]._lines == "n" and got[9000]._upper == 3
    cut = {}
    for lang in ("en", None, "de", "few"):
        cut[lang] = brute_cutoffs([({x: got[i][x] for x in rules.CUTOFFS}, q) for i, q in labels if docs[i][2] == lang], 4)
    assert any(cut["en"].values()) and all(v is not None for v in cut["de"].values()) and not any(cut["few"].values())  # by rule, by union, none
    for i, _ in labels:
        x = got[i]
        assert x.kept == (not x.base_failed and not any(c is not None and x[rule] > c for rule, c in cut[x.lang].items()))


def test_many_strata(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "concat('w', id, repeat(' word of a text', 6)) AS text", "cast(id % 15000 as string) AS lang")
    assert rules.apply_rules(df, df.selectExpr("doc_id", "1 AS quality")).where("not base_failed").count() in (0, 30_000)
    rows = rules.measures(df)
    assert rules.fit(rows, df.selectExpr("doc_id", "1 AS quality")).count() == 15_000
