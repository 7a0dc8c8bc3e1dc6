import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe, tokencount

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["The, the THE. Été, ÉTÉ. İ, ǅ ŉ ß. ﬁ, x.. .,, a.b, don't. I's, ª º. ŀ ĳ ÿ,", "", " ", "\n\n", "  a  b ", "İstanbul ΣΑΣ", "é ́x", "x\x1cy\x85z\xa0w", "don't I'll we've", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> <|endoftext|>", "  <|endoftext|>  x", "힣가", "日本語 テスト", "a b", "1234567 8.9,,,!!", "x" * 9000, "ab1" * 3000, "!?" * 4000 + " tail", "a \nb", "tab\there", "‍👩‍👩", " lead", "trail ", "\n"]


def texts():
    r = random.Random(5)
    alphabet = ["a", "B", "é", " ", " ", "\n", "\t", "  ", "1", ".", "'s", "'", "ñ", "ß", "<|endoftext|>", "日", "\x85", "\xa0", "re", "the", "ing", "<|", "x̀"]
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(600)] + ["".join(r.choice("abcdefinorst") for _ in range(r.randrange(2000))) for _ in range(60)]


@pytest.mark.parametrize("leaf", [2048, 48, 12, 5])
def test_codec(leaf):
    whole, c, t = Tokenizer.from_file(WORD), bpe.Codec(WORD, leaf), texts()
    r = random.Random(9)
    words = ["The", "don't", "été,", "E\u0301t", "\u0301x", "İst", "日本", "x1.", "!?", "<|x", "a\x85b", "\xa0", "'s", "ﬁ", "ab1ab"]
    t += ["".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(r.randrange(20, 900))) for _ in range(80)]
    trees = 0
    for text, (ids, decoded, tree) in zip(t, c.batch(t)):
        trees += tree
        want = whole.encode(text, add_special_tokens=False).ids
        assert bpe.unpack(ids) == want, repr(text[:80])
        assert decoded == whole.decode(want, skip_special_tokens=False)
    assert trees > (60 if leaf < 2048 else 2)


@pytest.mark.parametrize("chunk,overlap", [(32768, 512), (40, 3), (300, 17)])
def test_counts(chunk, overlap):
    whole, c, t = Tokenizer.from_file(BYTE), tokencount.Counter(BYTE, chunk, overlap), texts()
    t += [" ".join(t), " " * 3000 + "x", "y" * 3000, "a b" * 2000]
    want = [len(x.ids) for x in whole.encode_batch(t, add_special_tokens=False)]
    got = c.batch(t)
    assert got == want, [(repr(x[:60]), g, w) for x, g, w in zip(t, got, want) if g != w][:5]
    assert [c.huge(x) for x in t] == want


def test_bounded_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 40)
    monkeypatch.setattr(tokencount, "REMEMBER", 40)
    t = texts()
    c, n = bpe.Codec(WORD, 64), tokencount.Counter(BYTE, 500, 20)
    a, b = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    for i in range(0, len(t), 7):
        part = t[i : i + 7]
        assert [bpe.unpack(x) for x, *_ in c.batch(part)] == [x.ids for x in a.encode_batch(part, add_special_tokens=False)]
        assert n.batch(part) == [len(x.ids) for x in b.encode_batch(part, add_special_tokens=False)]


def test_tables(spark):
    rows = [(1, "Hello the world", "en", 7), (1, "Hello the world", "en", 7), (2, None, None, None), (None, "", "x", 1), (3, "z" * 200_000, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = bpe.encode_decode(df, WORD)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded", "by_tree"]
    whole = Tokenizer.from_file(WORD)
    assert sorted((x.doc_id or 0, bpe.unpack(bytes(x.ids))) for x in out.collect()) == sorted((a or 0, whole.encode(b or "").ids) for a, b, *_ in rows)
    n = tokencount.token_counts(df, BYTE)
    whole = Tokenizer.from_file(BYTE)
    assert sorted((x.doc_id or 0, x.n_bytes, x.n_tokens) for x in n.collect()) == sorted((a or 0, len((b or "").encode()), len(whole.encode(b or "").ids)) for a, b, *_ in rows)
    empty = df.where("doc_id = 99")
    assert bpe.encode_decode(empty, WORD).count() == 0 and tokencount.token_counts(empty, BYTE).count() == 0


def test_query_on_long_unsplit_words(spark, tmp_path, monkeypatch):
    """Words far above a leaf, through the query's own function: every one goes through tree concatenation."""
    from lodestone.llm.queries import QUERIES

    r = random.Random(12)
    letters = lambda n, of: "".join(r.choice(of) for _ in range(n))
    rows = [(i, letters(n, of)) for i, (n, of) in enumerate([(2049, "ab"), (4096, "abcdefinorst"), (60_001, "ethainosr"), (9000, "日本語"), (30_000, "éañ"), (200_000, "a"), (5000, "x1")])]
    rows += [(50, f"lead {rows[2][1]} tail {rows[3][1]}."), (51, None), (52, ""), (53, "THE" * 4000), (53, "THE" * 4000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(WORD)
    want = {}
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = QUERIES["op1_bpe_encode_decode"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all((x.n_tokens, x.ids_sha256, x.decoded_sha256) == want[x.doc_id] for x in got)
    c, trees = bpe.Codec(WORD), []
    real = c.tree
    monkeypatch.setattr(c, "tree", lambda w: trees.append(len(w)) or real(w))
    c.batch([t or "" for _, t in rows])
    assert max(trees) == 200_000 and len(trees) >= 7


def test_documents_go_through_the_tree(spark):
    """Long documents of the given table are encoded as unsplit texts, and all as the library does."""
    from lodestone.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    whole = Tokenizer.from_file(WORD)
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_bpe_encode_decode"](spark, sf).collect()
    assert len(got) == len(texts)
    for x in got:
        ids = whole.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert x.by_tree == (len(texts[x.doc_id]) > bpe.EACH * 2048)
    assert sum(x.by_tree for x in got) > 0


def test_joins_run_in_parallel(monkeypatch):
    seen, c = [], bpe.Codec(WORD, leaf=64)
    real = c._encode_all
    monkeypatch.setattr(c, "_encode_all", lambda parts: seen.append(len(parts)) or real(parts))
    word = "".join(random.Random(2).choice("abcdefinorst") for _ in range(64 * 33))
    assert c.tree(word) == c._encode(word, True)
    assert seen[0] == 33 and seen[1] == 16 and sum(seen) < 33 + 4 * 33


def test_memory_of_new_words_is_bounded():
    """However many new words a block has, the library is given some at a time, and the results are the same."""
    c, sizes = bpe.Codec(WORD), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **how):
            sizes.append(len(texts))
            return self.inner.encode_batch_fast(texts, **how)

    texts = [" ".join(f"word{i}x{j}" for j in range(50)) for i in range(200)]
    want = [c.whole.encode(t, add_special_tokens=False).ids for t in texts]
    c.whole = Counted(c.whole)
    assert [bpe.unpack(ids) for ids, *_ in c.batch(texts)] == want
    assert max(sizes) <= bpe.AT_ONCE < sum(sizes) == 10_000
