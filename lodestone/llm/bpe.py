"""BPE encoding and decoding of whole texts with a public tokenizer file.

Long texts (of more than EACH leaves) aren't split at words: they are cut into leaves of `leaf` characters wherever that falls
and encoded by tree concatenation. Leaves are encoded by themselves and neighbours joined level by level, all joins of a level
in parallel. At each join a window of what both sides have around it, between white space, which never is inside a word of the
tokenizer, is encoded again and grown until it starts with the same tokens as the left side has there and ends with the same
as the right side, or covers a side.

Short texts are cut at ASCII white space, and words are encoded once and remembered in a bounded memory. A text with a word of
more than `leaf` characters is cut there too, and such a word is encoded by a tree of its own, without white space to go by: its leaves are encoded independently, in parallel, and neighbours are joined level by level, all joins of
a level in parallel too. At each join a window of tokens on both sides is encoded again and grown until it starts with
the same tokens as the left side has there and ends with the same as the right side, or covers a side. Neighbouring
tokens of the result then all come from encodings of their own surroundings, which for a merge-ranked vocabulary makes
the whole the encoding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import trimmed

#: Words to remember in each worker; then the memory starts anew.
REMEMBER = 150_000
#: Characters of text that are worked on together.
BLOCK = 500_000
#: New words that the library encodes at once: its results take a thousand bytes a word.
AT_ONCE = 4_096
#: Threads for the parts of one long word or text.
THREADS = 4
#: Leaves from which on a text goes through the tree as a whole.
EACH = 8


class Codec:
    """Encodes and decodes as the tokenizers library does for `path` with add_special_tokens=False."""

    def __init__(self, path: str, leaf: int = 2048):
        from tokenizers import Tokenizer

        self.whole, self.leaf, self.path = Tokenizer.from_file(path), leaf, path
        self.whole.no_truncation()
        self.whole.no_padding()
        self.suffix = self.whole.model.end_of_word_suffix or ""
        self.tokens = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        special = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.spaced = [" " + self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.again: set[str] = set()  # remembered words that later blocks have used

    @cached_property
    def bare(self) -> tuple:
        """Tokenizers of the merges alone, for a word's inside and for its end; only long words need them."""
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        inner = Tokenizer(BPE(model["vocab"], merges))
        return inner, Tokenizer(BPE(model["vocab"], merges, end_of_word_suffix=self.suffix)) if self.suffix else inner

    def _width(self, token: int, final: bool) -> int:
        t = self.tokens[token]
        return len(t) - len(self.suffix) if final and self.suffix and t.endswith(self.suffix) else len(t)

    def _encode(self, part: str, final: bool) -> list[int]:
        return self.bare[final].encode(part, add_special_tokens=False).ids

    def tree(self, word: str) -> list[int]:
        """Token ids of one long word, which the pre-tokenizer doesn't split."""
        cuts = list(range(0, len(word), self.leaf))
        ends = [*cuts[1:], len(word)]
        nodes = list(zip(cuts, ends, self._encode_all([(word[a:b], b == len(word)) for a, b in zip(cuts, ends)])))
        while len(nodes) > 1:
            pairs = [(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            nodes = self._join(word, pairs) + nodes[2 * len(pairs) :]
        return nodes[0][2]

    def _encode_all(self, parts: list[tuple[str, bool]]) -> list[list[int]]:
        """Token ids of parts of a word, of which the flag says whether they end it; in parallel."""
        out: list[list[int]] = [[]] * len(parts)
        for final in (False, True):
            mine = [i for i, (_, f) in enumerate(parts) if f == final]
            if len(mine) == 1:
                out[mine[0]] = self._encode(parts[mine[0]][0], final)
            elif mine:
                with parallel():
                    for i, e in zip(mine, self.bare[final].encode_batch_fast([parts[i][0] for i in mine], add_special_tokens=False)):
                        out[i] = e.ids
        return out

    def _join(self, word: str, pairs: list[tuple[tuple, tuple]], agree: int = 2) -> list[tuple]:
        """The nodes of one level made of pairs of neighbours (start, end, ids)."""
        out: list[tuple] = [()] * len(pairs)
        todo, n = list(range(len(pairs))), 8
        while todo:
            spans = []
            for t in todo:
                (a, m, x), (_, b, y) = pairs[t]
                i, j = max(0, len(x) - n), min(len(y), n)
                start = a if i == 0 else m - sum(self._width(t, False) for t in x[i:])
                end = b if j == len(y) else m + sum(self._width(t, False) for t in y[:j])
                spans.append((t, i, j, start, end))
            encoded = self._encode_all([(word[start:end], end == len(word)) for *_, start, end in spans])
            todo = []
            for (t, i, j, *_), w in zip(spans, encoded):
                (a, _, x), (_, b, y) = pairs[t]
                if (i == 0 or w[:agree] == x[i : i + agree]) and (j == len(y) or w[-agree:] == y[j - agree : j]):
                    out[t] = a, b, x[:i] + w + y[j:]
                else:
                    todo.append(t)
            n *= 2
        return out

    def long(self, text: str) -> list[int]:
        """Token ids of a text without ASCII white space, of any length."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.whole.token_to_id(part))
            elif part:
                norm = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(norm):
                    out += self.tree(word) if len(word) > self.leaf else self._encode(word, True)
        return out

    def unsplit(self, leaves: list[list[str]]) -> tuple[bytes, str]:
        """Ids and decoded text of one long text, given as the learned words of its leaves, which are cut anywhere."""
        words = [w for ws in leaves for w in ws]
        ids, texts = list(map(self.ids.__getitem__, words)), list(map(self.texts.__getitem__, words))
        ends = np.cumsum([len(ws) for ws in leaves]).tolist()
        nodes = list(zip([0, *ends], ends))

        def live(order: range, most: int) -> tuple[list[int], bool]:
            """Up to `most` words that no join has put into another, and whether these are all."""
            found: list[int] = []
            for i in order:
                if words[i] is not None:
                    if len(found) == most:
                        return found, False
                    found.append(i)
            return found, True

        while len(nodes) > 1:  # a join changes the words around it only
            todo, n = list(range(len(nodes) // 2)), 1
            while todo:
                windows = []
                for t in todo:
                    (a, m), (_, b) = nodes[2 * t], nodes[2 * t + 1]
                    (x, all_x), (y, all_y) = live(range(m - 1, a - 1, -1), n + 1), live(range(m, b), n + 1)
                    x.reverse()
                    windows.append((t, x, y, all_x and all_y, " ".join([*(words[i] for i in x[:-1]), words[x[-1]] + words[y[0]], *(words[i] for i in y[1:])])))
                with parallel():
                    found = self.whole.encode_batch_fast([w for *_, w in windows], add_special_tokens=False)
                todo = []
                for (t, x, y, whole, text), e in zip(windows, found):
                    made = pack(f"<{len(e.ids)}I", *e.ids)
                    if (len(x) == 1 or made.startswith(ids[x[0]])) and (len(y) == 1 or made.endswith(ids[y[-1]])) or whole:
                        for i in (*x, *y):
                            words[i], ids[i], texts[i] = None, b"", ""
                        words[x[0]], ids[x[0]], texts[x[0]] = text, made, "".join(map(self.spaced.__getitem__, e.ids))
                    else:
                        todo.append(t)
                n *= 2
            nodes = [(nodes[i][0], nodes[min(i + 1, len(nodes) - 1)][1]) for i in range(0, len(nodes), 2)]
        return b"".join(ids), "".join(texts)[1:]

    def _learn(self, texts: list[list[str]]) -> None:
        seen = set().union(*texts)
        new = seen.difference(self.ids)
        self.again |= seen - new
        if len(self.ids) + len(new) > REMEMBER:
            if len(self.again) > REMEMBER // 2:
                self.again = seen - new
            self.ids, self.texts = ({w: x[w] for w in self.again} for x in (self.ids, self.texts))
        short = [w for w in new if len(w) <= self.leaf]
        for a in range(0, len(short), AT_ONCE):
            for w, e in zip(short[a : a + AT_ONCE], self.whole.encode_batch_fast(short[a : a + AT_ONCE], add_special_tokens=False)):
                self._keep(w, e.ids)
        for w in new:
            if len(w) > self.leaf:
                self._keep(w, self.long(w))

    def _keep(self, word: str, ids: list[int]) -> None:
        self.ids[word] = pack(f"<{len(ids)}I", *ids)
        self.texts[word] = "".join(map(self.spaced.__getitem__, ids))

    def batch(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text, whether it went through a tree) of each text."""
        split = [_words(t) for t in texts]
        whole = {i: [_words(t[a : a + self.leaf]) for a in range(0, len(t), self.leaf)] for i, t in enumerate(texts) if len(t) > EACH * self.leaf and not self.is_long(split[i])}
        if whole:
            self._learn([ws for leaves in whole.values() for ws in leaves])
            trees = {i: (*self.unsplit(leaves), True) for i, leaves in whole.items()}
            rest = iter(self.batch([t for i, t in enumerate(texts) if i not in whole]))
            return [trees[i] if i in whole else next(rest) for i in range(len(texts))]
        self._learn(split)
        ids, decoded = self.ids.__getitem__, self.texts.__getitem__
        out = [(b"".join(map(ids, ws)), "".join(map(decoded, ws))[1:], self.is_long(ws)) for ws in split]
        for w in {w for ws in split for w in ws if len(w) > self.leaf} if any(x[2] for x in out) else ():
            del self.ids[w], self.texts[w]  # what is long isn't remembered
            self.again.discard(w)
        return out

    def is_long(self, words: list[str]) -> bool:
        return len(max(words, key=len)) > self.leaf


def _words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


@contextmanager
def parallel() -> Iterator[None]:
    """Let the library use THREADS threads, for the parts of a word that alone keeps a task busy."""
    before = os.environ.get("TOKENIZERS_PARALLELISM")
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    try:
        yield
    finally:
        if before is None:
            del os.environ["TOKENIZERS_PARALLELISM"]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = before


@lru_cache(maxsize=2)
def codec(path: str, leaf: int) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Codec(path, leaf)


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_decode(docs: DataFrame, path: str, leaf: int = 2048) -> DataFrame:
    """docs' columns other than text, with ids (binary: little-endian unsigned 32-bit), decoded (string) and by_tree (whether
    tree concatenation gave the ids) in its place.

    A null text counts as empty: no ids and an empty decoded text. No row is moved, merged or dropped, so ties and
    repeated rows come back as they are; columns with the new names are replaced; an empty table gives an empty one. A
    text of any length is one row's work.
    """
    rest = [c for c in docs.columns if c not in ("text", "ids", "decoded", "by_tree")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in blocks(texts):
                ids, decoded, tree = zip(*c.batch(texts[i:j]))
                yield pa.RecordBatch.from_arrays([*(b.column(k + 1).slice(i, j - i) for k in range(len(rest))), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(tree, pa.bool_())], names=[*rest, "ids", "decoded", "by_tree"])

    df = docs.select(F.col("text").cast("string"), *(F.col(f"`{c}`") for c in rest))
    kept = docs.select(*(F.col(f"`{c}`") for c in rest)).schema
    return df.mapInArrow(trimmed(run), kept.add("ids", "binary").add("decoded", "string").add("by_tree", "boolean"))


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()
