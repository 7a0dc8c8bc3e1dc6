import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bpe, quality
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fp


def test_brute_force(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghinorst") for _ in range(r.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(r.choice([20, 90]))]
        bad = i % 5 == 0
        if i % 7 == 1 and not bad:
            words[3:3] = items[i % 5][1].split()
        text = " ".join(w + r.choice(["###", "%%%"]) for w in words) if bad else " ".join(words) + "."
        if i % 9 == 2:
            text = docs[-1][1] if i % 2 else docs[-1][1] + " more"
            bad = labels[-1][1] == 0
        docs.append((i, text + ("\nShared line of the site." if i % 3 == 0 else ""), "en", f"s{i % 2}", 1))
        labels.append((i, 0 if bad else 1))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {x.doc_id for x in quality.classify(read, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()}
    assert all((i in good) == bool(q) for i, q in labels)
    left = brute_lines([(d[0], d[1], d[3]) for d in docs if d[0] in good], 0.05)
    ids = [i for i, *_ in left]
    roots = brute_components(ids, [brute_fp(t) for _, t, _ in left])
    left = [(i, t) for (i, t, _), root in zip(left, roots) if i == root]
    left = [(i, t) for i, t in left if not brute_hits(t, items)[1]]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: bpe.unpack(bytes(x.ids)) for i, x in got.items()} == {i: whole.encode(t, add_special_tokens=False).ids for i, t in left}
    assert 100 < len(got) < 320


def test_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names, and empty tables."""
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefinorst") for _ in range(r.randrange(2, 8))) for _ in range(n)) + "."
    rows = [(i, text(40), r.choice(["en", None]), r.choice(["s", None]), 3) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (None, text(30), None, None, None), (None, None, None, None, None), (102, text(60_000), "en", "s", 1), (5, *rows[5][1:]), (5, *rows[5][1:]), (103, rows[6][1], "en", "s", 3)]
    more = "row string, _text string, _id long, fp long, _host string, w int, at int, score string, n_words int, _text_key string, kept int, _n string, n_lines_dropped string"
    df = spark.createDataFrame([(*x, "r", "t", 1, 2, "h", 3, 4, "s", 5, "k", 6, "n", "l") for x in rows], f"doc_id long, text string, lang string, source string, n_chars long, {more}")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels = [(i, int(i % 4 > 0)) for i in range(60)] + [(None, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(1, rows[9][1]), (2, None), (None, ""), (None, "none such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, f"{tmp_path}/a")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert all((x.row, x._text, x._id, x.fp, x._host, x.w, x.at, x.score, x.n_words, x._text_key, x.kept, x._n, x.n_lines_dropped) == ("r", "t", 1, 2, "h", 3, 4, "s", 5, "k", 6, "n", "l") for x in after.collect()), name
    bare = corpus_pipeline.without_boilerplate(spark, docs.drop("n_chars"), "")
    assert bare.columns == docs.drop("n_chars").columns and bare.count() == len(rows)
    near = {x.doc_id for x in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert 103 not in near and {0, 5, 6, 100, 102} <= near and 101 not in near  # null and empty texts are one class
    clean = corpus_pipeline.without_benchmarks(spark, docs, f"{tmp_path}/a").collect()
    assert len(clean) == len(rows) - 1 and 9 not in {x.doc_id for x in clean}
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert len({(x.doc_id, x.ids_sha256) for x in got}) == len(got) > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_two_runs_in_one_session(spark):
    """Each run's tables are its own: the first result is read after the second run."""
    one = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    two = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(x.doc_id for x in one.collect()) == sorted(x.doc_id for x in two.collect())
