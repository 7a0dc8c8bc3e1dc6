import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Byte by byte, from whole encodings."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    out, docs, held = [], [], Counter()
    for t in texts:
        e = a.encode(" " + (t or ""), add_special_tokens=False)
        ids_a, ids_b = e.ids, b.encode(t or "")
        of = alignment.byte_of_char()
        raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            docs.append(([], [], []))
            continue
        ends = [set(), set()]
        for k, raw in enumerate((raw_a, raw_b)):
            at = 0
            for x in raw:
                at += len(x)
                ends[k].add(at)
        cuts = sorted(ends[0] & ends[1])
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            mine = []
            for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
                at, got = 0, []
                for i, x in zip(ids, raw):
                    if lo <= at < hi:
                        got.append(i)
                    at += len(x)
                mine.append(got)
            groups.append(mine)
        docs.append((ids_a, ids_b, groups))
    links = [[(x, y) for xs, ys in g for x in xs for y in ys] for _, _, g in docs]
    for ls in links:
        held.update(set(ls))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for (ids_a, ids_b, groups), ls in zip(docs, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return out


def odd_texts(r):
    parts = ["token", "izers", "<|endoftext|>", "<s>", "<0x41>", "é", "日本語", "🙂", " ", "  ", "\n", "\n\n", "\t", "'ll", "don't", "12345", "...", "\r\n", "\x1c", "\x85", " ", "Ünïcödé", "ﬁ", "é", "ab" * 40, "<unk>", "//", "\x00", "naïve", "ſ", " ", "　"]
    out = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randrange(1, 25))) for _ in range(250)]
    return out + [None, "", " ", "▁", "a ▁ b", "one ▁two", "\n", "same text here", "same text here", "x" * 3000, "日" * 700 + " tail", "word " * 4000]


def test_library(spark):
    r = random.Random(6)
    texts = odd_texts(r)
    df = spark.createDataFrame([(i, t, 3, "at") for i, t in enumerate(texts)], "doc_id long, text string, block int, pairs string").repartition(6)
    got = {x.doc_id: x for x in alignment.align(df, A, B).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        x = got[i]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256, x.groups) == w, repr(texts[i])
        assert x.block == 3 and x.pairs == "at"
    assert want[texts.index("▁")][0] == 0 and sum(w[0] > 0 for w in want) > 200


def test_small_blocks_and_memory(spark, monkeypatch):
    texts = odd_texts(random.Random(7))
    for name, value in (("BLOCK", 300), ("REMEMBER", 40), ("EXPAND", 2)):
        monkeypatch.setattr(alignment, name, value)
    a, want = alignment.Aligner(A, B), brute(texts)
    for i in range(0, len(texts), 9):
        used, place, n = a.batch([t or "" for t in texts[i : i + 9]])
        ends = np.cumsum(n)
        for t, s, e, w in zip(texts[i : i + 9], ends - n, ends, want[i : i + 9]):
            found = [used[k] for k in place[s:e]]
            assert (sum(x[0] for x in found), sum(x[1] for x in found), sum(x[3] for x in found), ";".join(x[4] for x in found)) == (w[0], w[1], w[3], w[7]), repr(t)
            links = Counter()
            for x in found:
                pairs = np.frombuffer(x[5], np.int64).tolist()
                for p, k in zip(pairs, [1] * len(pairs) if x[6] is None else x[6].tolist()):
                    links[p] += k
            groups = [[[int(i) for i in side.split(",")] for side in g.split("|")] for g in w[7].split(";")] if w[7] else []
            assert links == Counter(i * alignment.SHIFT + j for g in groups for i in g[0] for j in g[1])


def test_intervals():
    a, b, g = alignment.intervals(np.array([2, 5, 9]), np.array([1, 5, 6, 9]))
    assert a.tolist() == [0, 0, 1, 2, 2] and b.tolist() == [0, 1, 1, 2, 3] and g.tolist() == [0, 0, 0, 1, 1]


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(x.n_a, x.n_links, x.count_sum, x.groups_sha256) for x in alignment.align(df, A, B).collect()] == [(0, 0, 0, "")] * 2
    assert alignment.align(df.limit(0), A, B).count() == 0
