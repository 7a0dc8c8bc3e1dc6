"""Joins of leaves change the words around them in place: no level copies the words of a whole text."""

import random
import sys

import public_tokenizers
import pytest

from lodestone.llm import bpe


@pytest.mark.parametrize("leaf", [5, 16, 64])
def test_leaves_cut_anywhere(leaf):
    c, r = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"), leaf), random.Random(leaf)
    for _ in range(40):
        text = "".join(r.choice(["the ", "ing", "x", "Ü", " ", "\n", "\t", "...", "'s ", "1234", "<unk>", "</w>", "日本 ", "aaa "]) for _ in range(r.randint(200, 600)))
        leaves = [bpe._words(text[a : a + leaf]) for a in range(0, len(text), leaf)]
        c._learn(leaves)
        want = c.whole.encode(text, add_special_tokens=False).ids
        got, decoded = c.unsplit(leaves)
        assert bpe.unpack(got) == want and decoded == c.whole.decode(want, skip_special_tokens=False)


def test_words_of_a_text_are_not_copied_at_each_level():
    c = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"), 64)
    leaves, lines = [["the", "of", "and"] * 5 for _ in range(64)], [0]
    c._learn(leaves)

    def tuples(frame, event, arg):  # the words of a node were tuples, made anew
        lines[0] = max(lines[0], sum(len(x) for x in frame.f_locals.get("nodes", []) if frame.f_code.co_name == "unsplit" and isinstance(x, list)))

    sys.setprofile(tuples)
    try:
        c.unsplit(leaves)
    finally:
        sys.setprofile(None)
    assert lines[0] == 0
