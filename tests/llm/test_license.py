import random
import re

from lodestone.llm import license


def test_spans_and_labels(spark):
    mit = license.TEMPLATES[4][1]
    words = mit.split()
    changed = " ".join(words[:8] + ["extra", "words"] + words[8:14] + words[15:])
    docs = [
        (1, f"intro text {mit} and more"),
        (2, f"x {changed} y"),
        (3, " ".join(words[:6])),
        (4, "CC BY cc by, ALL rights\nreserved. General public License"),
        (5, "cc-by nc"),
        (6, None),
        (7, ""),
        (8, "all rights"),
        (9, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (9, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (None, "by " * 5000 + "Licensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame([(*d, "k", 3) for d in docs], "doc_id long, text string, spans string, w int").repartition(3)
    got = sorted(license.scan(df).collect(), key=lambda x: x.doc_id or 0)
    by = {x.doc_id: x for x in got}
    assert by[1].labels == ["mit"] and by[1].score == 1.0 and (by[1].spans[0].start, by[1].spans[0].end) == (2, 2 + len(license.template_words(mit)))
    assert by[2].labels == ["mit"] and 0.6 <= by[2].score < 1
    assert by[3].labels == [] and by[3].score == 0
    assert (by[4].n_base, by[4].first_word, by[4].last_word, by[4].base_labels) == (4, 0, 7, ["cc-by", "gpl", "reserved"])
    assert (by[5].n_base, by[5].base_labels) == (1, ["cc-by"])
    for i in (6, 7, 8):
        assert (by[i].n_base, by[i].first_word, by[i].labels, by[i].score) == (0, None, [], 0.0)
    assert by[9].labels == ["cc-by", "cc-by-nc", "mit"] and len([x for x in got if x.doc_id == 9]) == 2
    assert by[None].labels == ["apache-2.0"] and by[None].n_words == 5008
    assert license.scan(df.limit(0)).count() == 0


def brute(text, templates, k=license.K, drift=license.DRIFT, share=license.SHARE):
    """Labels and best share by loops over all places and all templates."""
    w, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), set()
    for label, t in templates:
        tw = license.template_words(t)
        grams = len(tw) - k + 1
        votes = {}
        for p in range(len(w) - k + 1):
            for q in range(grams):
                if w[p : p + k] == tw[q : q + k]:
                    votes.setdefault(p - q, set()).add(q)
        runs, last = [], None
        for d in sorted(votes):
            if last is None or d - last > drift:
                runs.append([])
            runs[-1].append(d)
            last = d
        bounds = lambda ds: (min(d + min(votes[d]) for d in ds), max(d + max(votes[d]) + k for d in ds))
        for run in runs:
            a, b = bounds(run)
            for ds in [run] if b - a <= 2 * (grams + k) else [[d] for d in run]:
                held = len(set().union(*(votes[d] for d in ds)))
                if held >= share * grams:
                    out.add((*bounds(ds), label, held / grams))
    return out


def test_bodies_edited_and_repeated(spark):
    r = random.Random(13)
    docs = []
    for i, (label, body) in enumerate(license.BODIES):
        w = body.split()
        docs.append((f"{i}", "lead words " + body + " tail"))
        for _ in range(max(1, len(w) // 40)):  # words put in, taken out and exchanged
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["inserted", w[at]], ["changed"]])
        docs.append((f"{i} edited", " ".join(w)))
    mit = dict(reversed(license.BODIES))["mit"]
    docs += [("twice", f"{mit} {mit}"), ("many", " ".join([license.BODIES[9][1]] * 12)), ("long", "filler text " * 30_000 + mit), ("none", None), ("short", "cc")]
    chain = "one two three four five one two three six seven one two three eight"  # diagonals of one run reach far
    docs.append(("chain", " ".join([chain] * 5)))
    templates = [*license.TEMPLATES, ("chain", chain)]
    df = spark.createDataFrame([(*d, "k", 1, 2) for d in docs], "doc_id string, text string, _id string, places int, _w int").repartition(4)
    got = {x.doc_id: x for x in license.scan(df, templates).collect()}
    for name, text in docs:
        want = set() if name == "long" else brute(text, templates)
        if name != "long":
            assert {(s.start, s.end, s.label, s.coverage) for s in got[name].spans or []} == want, name
            assert got[name].score == 1 if got[name].n_base else got[name].score == max([0, *(x[3] for x in want)])
    assert all(label in got[str(i)].labels and label in got[f"{i} edited"].labels for i, (label, _) in enumerate(license.BODIES))
    assert "mit" in got["long"].labels and "wtfpl" in got["many"].labels and "chain" in got["chain"].labels and got["many"]._w == 2


def test_sql_on_runs_that_are_too_long(spark, tmp_path):
    """The registered query against its SQL on repeated and edited bodies, whose runs of diagonals are taken apart."""
    import duckdb

    from lodestone.llm.queries import ORACLES, QUERIES

    r, docs = random.Random(4), []
    for label, body in license.BODIES:
        w = body.split()
        for _ in range(len(w) // 50):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["inserted", w[at]], ["changed"]])
        docs += [" ".join(w), " ".join([body] * 3), " ".join([body] * 12), "lead " + body + " all rights reserved " + " ".join(w)]
    docs += [None, "", docs[0], docs[0]]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(ORACLES["op5_license_scan"])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(map(repr, (tuple(x[n] for n in names) for x in QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()))) == want
    assert sum("1.0" in x for x in want) > len(license.BODIES)
