import hashlib
import random
import re

from lodestone.llm import decontam


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items, window=10):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for a in range(max(1, len(v) - window + 1) if v else 0):
            g = v[a : a + window]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    ids |= {str(i)} if i is not None else set()
    return len(w), len(hit), sorted(ids)


def test_brute_force(spark):
    r = random.Random(2)
    vocab = ["a", "b", "Été", "the", "x1", "of"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 9, 10, 11, 14])))) for i in range(25)]
    items += [(25, None), (26, ""), (None, "a b a b a b"), (27, items[3][1]), (27, items[3][1])]
    docs = []
    for i in range(60):
        t = [r.choice(vocab) + r.choice(["", ".", ",\n"]) for _ in range(r.randrange(40))]
        if i % 2:
            t.insert(r.randrange(len(t) + 1), items[r.randrange(25)][1].upper().replace("ÉTÉ", "Été"))
        docs.append((i, " ".join(t)))
    docs += [(60, None), (61, ""), (62, docs[1][1]), (62, docs[1][1]), (None, docs[3][1])]
    rows = [(i, t, "clash", 1, 2) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_hit int, w int").repartition(3)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, at int")
    for block in (50_000, 7):
        got = sorted((x.doc_id is None, x.doc_id, x.n_words, x.n_hit, x["items"]) for x in decontam.contamination(df, it, block=block, items_too=True).collect())
        assert got == sorted((i is None, i, *brute(t, items)) for i, t in docs)
    kept = decontam.keep_clean(df, it)
    assert kept.columns == df.columns
    assert sorted((x.doc_id is None, x.doc_id) for x in kept.collect()) == sorted((i is None, i) for i, t in docs if not brute(t, items)[1])


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(x.n_words, x.n_hit) for x in decontam.contamination(docs, none).collect()] == [(3, 0)]
    assert decontam.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_window_of_many_items_and_long_texts(spark):
    shared = "one two three four five six seven eight nine ten"
    items = [(i, f"{shared} item{i} tail" if i % 2 else shared) for i in range(10_000)]
    docs = [(1, f"x {shared} y"), (2, "pad " * 200_000 + shared), (3, shared + " item1 tail"), (4, "one two three"), (5, "seven eight nine ten item1")]
    df = spark.createDataFrame([(*d, "k", "w", "t") for d in docs], "doc_id long, text string, _text_key string, wids string, row string")
    it = spark.createDataFrame(items, "item_id long, text string")
    every = sorted(str(i) for i in range(10_000))
    for block in (500_000, 100):
        got = {x.doc_id: x for x in decontam.contamination(df, it, block=block, spans=True, items_too=True).collect()}
        assert got[1]["items"] == got[2]["items"] == got[3]["items"] == every and got[2].n_words == 200_010
        assert [got[i].n_hit for i in range(1, 6)] == [10, 10, 12, 0, 0] and got[2].spans[0].at == 200_000
        assert {got[i]["_text_key"] for i in got} == {"k"} and got[5]["items"] == []
        for x in got.values():
            assert x.n_items == len(x["items"]) and x.items_sha256 == hashlib.sha256(",".join(x["items"]).encode()).hexdigest()


def test_no_text_goes_through_a_join(spark):
    """Where nobody reads the texts, joins move keys and counts only, however large the tables are."""
    from lodestone.llm import queries

    plan = queries.op3_benchmark_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    todo, joins = [plan], 0
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joins += 1
            for side in below:
                types = [side.output().apply(i).dataType().simpleString() for i in range(side.output().size())]
                names = [side.output().apply(i).name() for i in range(side.output().size())]
                assert not any(t.startswith("struct") for t in types) and "text" not in names, (names, types)
        todo += below
    assert joins
