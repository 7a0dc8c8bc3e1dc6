import random
from collections import defaultdict

from lodestone.llm import mixing


def brute_targets(sizes, weights, share, most):
    """The excess is reshared among the sources below, again and again."""
    target, free, left = {}, list(sizes), share * sum(s for s, _ in sizes.values())
    while free:
        total = sum(sizes[s][1] for s in free)
        above = [s for s in free if most * sizes[s][0] < left / total * sizes[s][1]]
        if not above:
            return target | {s: left / total * sizes[s][1] for s in free}
        for s in above:
            target[s] = most * sizes[s][0]
            left -= target[s]
            free.remove(s)
    return target


def made(r, n):
    rows = [(i, r.choice(["a", "a", "a", "b", None, "é", "z" * 3, f"own{i % 40}"]), " ".join(["w"] * r.choice([0, 1, 3, 50, 400]))) for i in range(n)]
    return rows + [(None, "a", "x y"), (7, "a", None), (7, "a", "same id"), (7, "a", "same id"), (8, None, "tabs\tand\x0bfeeds\x0c \n"), (9, "empty", ""), (10, "empty", None), (11, "long", "word " * 50_000)]


def test_against_the_definition(spark):
    r = random.Random(4)
    rows = made(r, 900)
    df = spark.createDataFrame([(*x, 1, "t", 5) for x in rows], "doc_id long, source string, text string, place int, _source string, size int").repartition(7)
    got = mixing.mix(df, keep_text=True).collect()
    assert len(got) == len(rows)
    words = lambda t: len([w for w in __import__("re").split(r"[ \t-\r]+", t or "") if w])
    assert all(x.size == words(x.text) and x.place == 1 and x._source == "t" for x in got)
    sums = defaultdict(int)
    for _, s, t in rows:
        sums[s] += words(t)
    order = sorted(sums, key=lambda s: (s is None, s))
    want = brute_targets({s: (sums[s], (5, 2, 1)[i % 3]) for i, s in enumerate(order)}, None, 1.5, 2.0)
    taken, longest = defaultdict(int), defaultdict(int)
    for x in got:
        assert abs(x.target - want[x.source]) <= 1e-9 * max(1, want[x.source]) and x.source_size == sums[x.source]
        assert 0 <= x.copies <= 2 and x.taken == x.copies * x.size
        taken[x.source] += x.taken
        longest[x.source] = max(longest[x.source], x.size)
    assert all(abs(taken[s] - want[s]) <= 2 * longest[s] for s in sums)
    assert abs(sum(want.values()) - 1.5 * sum(sums.values())) < 1e-6
    emitted = mixing.emit(mixing.mix(df, keep_text=True))
    assert emitted.count() == sum(x.copies for x in got)


def test_partitions_do_not_matter(spark):
    rows = made(random.Random(5), 300)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    key = lambda d: sorted(map(repr, mixing.mix(d, keep_text=True).collect()))
    assert key(df.repartition(1)) == key(df.repartition(13)) == key(df)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", "")], "doc_id long, source string, text string")
    assert [(x.size, x.target, x.copies) for x in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(df.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "a", "w w") for i in range(10)], "doc_id long, source string, text string")
    assert sum(x.taken for x in mixing.mix(one).collect()) in (28, 30, 32)
    assert sum(x.taken for x in mixing.mix(one, share=5.0).collect()) == 40  # all sources at their bound
