import math
import random
import tracemalloc
import zlib

import numpy as np

from lodestone.llm import quality


def corpus(n=600):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghinorst") for _ in range(r.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.choice([8, 40, 400]))]
        bad = i % 4 == 0
        docs.append((i, " ".join(w + r.choice(["###", "%%%"]) for w in words) if bad else " ".join(words) + "."))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_gradient():
    r = np.random.default_rng(0)
    bags = [np.abs(r.normal(size=(k, quality.WIDTH))) for k in (1, 3, 2)]
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1.0, 1.0])
    m = quality.train([b.astype("f4") for b in bags], y, steps=1)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    loss = lambda: -np.mean(y * np.log(m.forward(x, starts)[-1]) + (1 - y) * np.log(1 - m.forward(x, starts)[-1]))
    for k, g in m.gradient(x, starts, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        p, e = m.p[k].copy(), 1e-5
        m.p[k][at] = p[at] + e
        up = loss()
        m.p[k][at] = p[at] - e
        down = loss()
        m.p[k] = p
        assert abs((up - down) / (2 * e) - g[at]) < 1e-6, k


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(9001, None), (9002, ""), (None, "words of a text"), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, "s", 3.5) for d in docs + extra], "doc_id long, text string, row string, score double").repartition(4)
    lab = spark.createDataFrame([*labels, (7, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = quality.classify(df, lab).collect()
    assert len(got) == len(docs) + 4 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 600]
    assert np.mean([x.predicted == dict(labels)[x.doc_id] for x in held]) > 0.97
    assert all(abs(sum(x.attention) - 1) < 1e-6 for x in got)
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(x.predicted for x in got)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in quality.classify(df, none).collect()] == [1.0]
    assert quality.classify(df.limit(0), none).count() == 0


def loop_score(model, text):
    """The score of one text by loops over its passages and their features."""
    data, p = (text or "").encode(), {k: v.astype(float) for k, v in model.p.items()}
    n = max(1, round(len(data) / quality.PASSAGE))
    parts = [[i for i in range(len(data)) if i * n // len(data) == k] for k in range(n)] if data else [[]]
    encoded, attention = [], []
    for where in parts:
        x = np.zeros(quality.WIDTH)
        for i in where:
            x[data[i] if data[i] < 128 else 128 + (data[i] >> 3 & 15)] += 1 / len(where)
        x = np.sqrt(x)
        slots = [0] * quality.BUCKETS
        for i in where:
            if i + 6 <= len(data):
                h = 0
                for c in data[i : i + 6]:
                    h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
                slots[h >> 55] += 1
        if len(data) >= 6:
            x[144] = sum(c > 0 for c in slots) / min(max(len(where) - 5, 1), quality.BUCKETS)
            x[145] = math.sqrt(max(slots) / max(len(where) - 5, 1))
        x[146], x[147] = math.log1p(len(where)) / 7, 1
        shrink = np.array([len(where) / (len(where) + 48)] * 146 + [1, 1])
        h = np.tanh((shrink * (x - model.mean) / model.scale) @ p["W"])
        encoded.append(h)
        attention.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
    weights = np.exp(np.array(attention) - max(attention))
    weights /= weights.sum()
    return 1 / (1 + math.exp(-float(sum(w * h for w, h in zip(weights, encoded)) @ p["c"] + p["b"][0]))), weights


def test_score_by_loops(spark, monkeypatch):
    docs, labels = corpus(200)
    docs += [(9001, None), (9002, ""), (9003, "short"), (9004, "éa ñ 日本 " * 700), (9005, docs[4][1] * 9)]
    df = spark.createDataFrame([(*d, "t", 1, [2]) for d in docs], "doc_id long, text string, _text string, row int, bag array<int>").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df, lab)
    got = {x.doc_id: x for x in quality.score(df, model).collect()}
    for i, text in docs:
        want, weights = loop_score(model, text)
        assert abs(got[i].score - want) < 1e-4 and np.allclose(got[i].attention, weights, atol=1e-4), i
        assert (got[i]._text, got[i].row, got[i].bag) == ("t", 1, [2])
    assert quality.keep_good(df, lab).columns == df.columns
    data = np.frombuffer(docs[-2][1].encode(), np.uint8)
    whole = quality.passages(data)
    monkeypatch.setattr(quality, "TOGETHER", 3)
    assert np.array_equal(quality.passages(data), whole)


def test_sample_is_whole_and_bounded(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame([*docs, (3, "another text of three"), (4, "x" * 90_000)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    seen = []
    real, quality.train = quality.train, lambda bags, y: seen.append(([len(b) for b in bags], list(y)))
    try:
        quality.fit(df, lab)
        quality.fit(df, lab, most=20)
        quality.fit(df, lab, most_passages=30)
    finally:
        quality.train = real
    (all_bags, _), (few, y), (small, _) = seen
    folds = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(all_bags) == len(folds) and sum(len(x) == 0 for x in seen) == 0
    assert len(few) == 20 and sum(y) == 10 and sum(small) <= 30 < sum(all_bags)


def test_long_text_in_bounded_memory():
    data = np.tile(np.frombuffer(b"some words of a long text. ", np.uint8), 1_500_000)
    tracemalloc.start()
    x = quality.passages(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == round(len(data) / 1024) and peak < 2 * len(data)


def test_scores_do_not_depend_on_the_batch():
    r = np.random.default_rng(3)
    bags = [np.abs(r.normal(size=(int(r.integers(1, 40)), quality.WIDTH))).astype("f4") for _ in range(60)]
    m = quality.train(bags, (np.arange(60) % 2).astype("f4"), steps=5)
    together = m.score(bags)[0]
    assert [m.score([b])[0][0] for b in bags] == together.tolist() == m.score(bags[::-1])[0][::-1].tolist()
