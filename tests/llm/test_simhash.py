import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash


def brute_fp(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_fingerprint():
    for t in (None, "", " \n", "one", "Two WORDS", "a b c d e f g a b c d", "é ß Ü Ä x", "nb sp x y", "x " * 70000):
        assert simhash.fingerprint(t) == brute_fp(t)


@pytest.mark.parametrize("bucket", [2048, 4])
def test_near_duplicates(spark, bucket):
    r = random.Random(1)
    base = [" ".join(r.choice("the of and tion er in ed".split()) + str(r.randrange(40)) for _ in range(60)) for _ in range(8)]
    docs = []
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = "x" + str(r.randrange(99))
            docs.append(" ".join(w))
    docs += ["", None, "  ", base[0], base[0], "one", "one two"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, fp int").repartition(3)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df, bucket=bucket).collect()}
    fps = [brute_fp(t) for t in docs]
    want = brute_components(list(range(len(docs))), fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(docs))}
    assert len(set(want)) < len(docs) - 8


def test_dense_ball(spark):
    """Fingerprints around one centre: overfull buckets are dealt anew and no link is lost."""
    r = np.random.default_rng(3)
    fps = [0x0123456789ABCDEF]
    for _ in range(300):
        f = int(fps[r.integers(len(fps))])
        for b in r.integers(0, 64, 2):
            f ^= 1 << int(b)
        fps.append(f)
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    from lodestone.llm.common import Stored
    from lodestone.llm.components import components

    store = Stored(spark)
    out = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), store, bucket=8), store)
    assert {x.node for x in out.collect()} == set(signed) and {x.root for x in out.collect()} == {min(signed)}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_repeats(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in got) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long), (7, long + " x"), (2, "other words here that differ"), (None, "only null ids"), (None, "only null ids"), (9, "twice"), (9, "twice"), (9, "not the same text at all"), (None, long)]
    df = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, row string, fp int").repartition(3)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    got = sorted((x.doc_id or 0, x.text) for x in out.collect())
    fps = [brute_fp(t) for _, t in rows]
    same = bin(fps[0] ^ fps[1]).count("1") <= 3
    want = [(5, long), (2, rows[2][1]), (0, rows[3][1]), (9, "twice"), (9, rows[7][1])] + ([] if same else [(7, rows[1][1])])
    assert got == sorted(want)
    unique = df.where("doc_id in (5, 7, 2)")
    assert {x.doc_id for x in simhash.keep_one(unique).collect()} == {5, 2} | (set() if same else {7})
    assert simhash.keep_one(df.limit(0)).count() == 0
