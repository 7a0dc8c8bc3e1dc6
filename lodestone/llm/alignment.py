"""Cross-tokenizer alignment of whole texts by elementary intervals.

Both tokenizers encode a text; their tokens' bytes, put together, are the same bytes, so each token is a range of them. The
union of the two arrays of ends cuts the bytes into elementary intervals; searching an interval's end in either array gives
the token that owns it, so each interval is one overlap of a token of A with one of B. An end that both arrays share closes
a group, and a group's links are the product of its tokens of A and B.

A text is cut before each single space between two visible characters. There a token of either tokenizer ends: A cuts
texts there before it merges anything, and no piece of B has a space behind another character (checked when it is loaded). So
no group reaches over such a place, segments are aligned on their own, all new ones of a block of texts in one pass over
their common byte offsets, and what comes of short ones is remembered in a bounded memory.

Corpus counts: a block of texts gives each of its different id pairs once, with the number of its texts that hold it. Those
are summed over the corpus; the sums go back to the blocks that asked, once a pair and block, and are added up there.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import blocks
from lodestone.llm.common import Stored, trimmed

#: Segments that a worker remembers and their longest; characters of a block; links that are expanded at once; characters of
#: segments that are encoded together.
REMEMBER, LONGEST, BLOCK, EXPAND, TOGETHER = 250_000, 64, 2_000_000, 2_000_000, 2_000
#: An id pair is one number: A's id times SHIFT plus B's.
SHIFT = 1 << 31
CUT = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r" \s|\s |^ | $")


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
INTS, LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, other
    bytes for characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: What an aligned segment has: numbers of tokens, groups and links, the groups as text, and the links' id pairs as 64-bit
#: integers; of a segment with more than EXPAND links each different pair once, with how often it occurs, else None.
Alignment = tuple[int, int, int, int, str, bytes, np.ndarray | None]


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, group) of each elementary interval of rising ends, which have the same last one."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[a] == ends) & (ends_b[b] == ends)
    return a, b, np.cumsum(shared) - shared


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_of_char()
        self.bytes_a = {i: bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path_b} has pieces with an inner space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.size_a[i] = len(x)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.names = list(map(str, range(max(len(self.size_a), len(self.size_b)))))
        self.known: dict[str, Alignment | None] = {}
        self.again: set[str] = set()  # remembered segments that later blocks have used

    def align(self, texts: list[str]) -> list[Alignment | None]:
        """The alignment of each text; None where the bytes of A's or B's tokens differ from a space and the text.

        Texts without white space at their ends are put together first, since there tokens of both end between them."""
        out: list[Alignment | None] = [None] * len(texts)
        alone = [i for i, t in enumerate(texts) if not t or t[0].isspace() or t[-1].isspace()]
        plain = [i for i, t in enumerate(texts) if t and not t[0].isspace() and not t[-1].isspace()]
        parts = [plain[i:j] for i, j in blocks([texts[i] for i in plain], TOGETHER)]
        joined = [" ".join(map(texts.__getitem__, part)) for part in parts]
        kept, *both = self._encoded(joined)
        alone += [i for k in set(range(len(parts))).difference(kept) for i in parts[k]]
        if kept:
            good = [i for k in kept for i in parts[k]]
            sizes = np.cumsum(np.fromiter((len(texts[i].encode("utf-8", "surrogatepass")) + 1 for i in good), np.int64, len(good)))
            at = [np.searchsorted(ends, sizes) for _, _, ends in both]
            if all(np.array_equal(ends[x], sizes) for x, (_, _, ends) in zip(at, both)):
                self._aligned(good, *((np.diff(x, prepend=-1), flat, ends) for x, (_, flat, ends) in zip(at, both)), out)
            else:
                alone += good
        if alone:
            kept, *both = self._encoded([texts[i] for i in alone])
            if kept:
                self._aligned([alone[k] for k in kept], *both, out)
        return out

    def _encoded(self, texts: list[str]) -> tuple:
        """The texts that both tokenizers' bytes give back, and of A and B for those the numbers of tokens, all ids and where
        they end."""
        texts_a = [" " + t for t in texts]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts_a, add_special_tokens=False)]
        return self._same([t.encode("utf-8", "surrogatepass") for t in texts_a], ids_a, self.b.encode(texts, num_threads=1))

    def _aligned(self, good: list[int], of_a: tuple, of_b: tuple, out: list[Alignment | None]) -> None:
        """Put the alignments of texts that are `good` into out."""
        (n_a, flat_a, ends_a), (n_b, flat_b, ends_b) = of_a, of_b
        a, b, group = intervals(ends_a, ends_b)
        # the tokens of a group: an interval that starts one gives it
        group_a, group_b = group[np.diff(a, prepend=-1) > 0], group[np.diff(b, prepend=-1) > 0]
        groups = int(group[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        bounds = np.searchsorted(start_a, np.r_[0, np.cumsum(n_a)]).tolist()  # of each text's groups
        names_a, names_b = list(map(self.names.__getitem__, flat_a.tolist())), list(map(self.names.__getitem__, flat_b.tolist()))
        rows = zip(start_a.tolist(), (start_a + in_a).tolist(), start_b.tolist(), (start_b + in_b).tolist())
        names = [names_a[s] + "|" + names_b[u] if t == s + 1 and v == u + 1 else ",".join(names_a[s:t]) + "|" + ",".join(names_b[u:v]) for s, t, u, v in rows]
        links = in_a * in_b
        ends = np.r_[0, np.cumsum(links)][bounds]
        n_a, n_b, at, lo = n_a.tolist(), n_b.tolist(), ends.tolist(), 0
        while lo < len(good):  # texts whose links are expanded together
            hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + EXPAND, side="right")) - 1)
            g, h, first = bounds[lo], bounds[hi], at[lo]
            parts = flat_a, flat_b, start_a[g:h], in_a[g:h], start_b[g:h], in_b[g:h], links[g:h]
            pairs, times = _summed_products(*parts) if at[hi] - first > EXPAND else (_products(*parts), None)
            codes = pairs.tobytes()
            for k in range(lo, hi):
                s, t, x, y = bounds[k], bounds[k + 1], at[k], at[k + 1]
                mine = codes if times is not None else codes[8 * (x - first) : 8 * (y - first)]
                out[good[k]] = n_a[k], n_b[k], t - s, y - x, names[s] if t == s + 1 else ";".join(names[s:t]), mine, times
            lo = hi

    def _same(self, raw: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple:
        """The texts that both tokenizers' bytes give back, and of each tokenizer for those the numbers of tokens, all ids and
        where they end. All texts are looked at together first."""
        good = list(range(len(raw)))
        while True:
            found, whole, sizes = [], b"".join(raw), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            for ids, of, size in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
                ends = np.cumsum(size[flat])
                if np.array_equal(np.r_[0, ends][np.cumsum(n)], sizes) and b"".join(map(of.__getitem__, chain.from_iterable(ids))) == whole:
                    found.append((n, flat, ends))
            if len(found) == 2:
                return good, *found
            get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
            good = [i for i, t in enumerate(raw) if t == b"".join(map(get_a, ids_a[i])) and t == b"".join(map(get_b, ids_b[i]))]
            raw, ids_a, ids_b = ([x[i] for i in good] for x in (raw, ids_a, ids_b))

    def batch(self, texts: list[str]) -> tuple[list[Alignment], np.ndarray, np.ndarray]:
        """Alignments of different segments, which of them the texts are made of in order, and how many each text has: none
        if it is empty or can't be aligned."""
        split = [[] if not t else CUT.split(t) if ODD.search(t) else t.split(" ") for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        number = {s: k for k, s in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        place = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        new = [s for s in number if s not in self.known]
        old = number.keys() - new
        self.again |= old
        if len(self.known) + len(new) > REMEMBER:
            if len(self.again) > REMEMBER // 2:
                self.again = old
            self.known = {s: self.known[s] for s in self.again}
        for i, j in blocks(new, BLOCK // 4):
            self.known.update(zip(new[i:j], self.align(new[i:j])))
        used = list(map(self.known.__getitem__, number))
        for s in new:
            if len(s) > LONGEST:  # what is long isn't remembered
                del self.known[s]
        odd = np.array([x is None for x in used], bool)
        if odd.any():  # bytes that differ in segments could still be the same in the whole
            parts = np.split(place, np.cumsum(n)[:-1])
            again = [i for i, p in enumerate(parts) if odd[p].any()]
            for i, whole in zip(again, self.align([texts[i] for i in again])):
                parts[i] = np.array([] if whole is None else [len(used)], np.int64)
                used += [] if whole is None else [whole]
            n = np.array([len(p) for p in parts])
            kept, place = np.unique(np.concatenate(parts), return_inverse=True)
            used = [used[k] for k in kept]
        return used, place, n


def _products(flat_a, flat_b, start_a, in_a, start_b, in_b, links) -> np.ndarray:
    """The id pairs of all links of some groups, group by group."""
    total = int(links.sum())
    mine = np.repeat(np.arange(len(links)), links)
    inside = np.arange(total) - np.repeat(np.cumsum(links) - links, links)
    of_b = in_b[mine]
    return flat_a[start_a[mine] + inside // of_b] * SHIFT + flat_b[start_b[mine] + inside % of_b]


def _summed_products(flat_a, flat_b, start_a, in_a, start_b, in_b, links) -> tuple[np.ndarray, np.ndarray]:
    """The different id pairs of many links and how often each occurs, at most about EXPAND at a time."""
    pairs, times, at, ends = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, np.cumsum(links)
    while at < len(links):
        if links[at] > EXPAND:  # one huge group: products of its different ids
            one_a, m_a = np.unique(flat_a[start_a[at] : start_a[at] + in_a[at]], return_counts=True)
            one_b, m_b = np.unique(flat_b[start_b[at] : start_b[at] + in_b[at]], return_counts=True)
            step = max(1, EXPAND // len(one_b))
            for s in range(0, len(one_a), step):
                code, often = (one_a[s : s + step, None] * SHIFT + one_b).ravel(), (m_a[s : s + step, None] * m_b).ravel()
                pairs, times = _summed(np.concatenate([pairs, code]), np.concatenate([times, often]))
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPAND, side="right")))
        code = _products(flat_a, flat_b, *(x[at:to] for x in (start_a, in_a, start_b, in_b, links)))
        pairs, times = _summed(np.concatenate([pairs, code]), np.concatenate([times, np.ones(len(code), np.int64)]))
        at = to
    return pairs, times


def _summed(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    different, at = np.unique(values, return_inverse=True)
    return different, np.bincount(at, weights=times, minlength=len(different)).astype(np.int64) if len(times) else times


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Aligner(path_a, path_b)


def _ragged(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def block_columns(used: list[Alignment], place: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """For the texts of a block, as batch() gives them: n_a, n_b, n_groups, n_links, groups, at and times (places of a text's
    different pairs among the block's, and how often it has them), and on the first text pairs and held: the block's pairs
    and their texts."""
    texts, ends = len(n), np.r_[0, np.cumsum(n)]
    of = np.repeat(np.arange(texts), n)

    *numbers, names, links, often = zip(*used) if used else [()] * 7
    sums = [pa.array(np.diff(np.r_[0, np.cumsum(np.array(x, np.int64)[place])][ends]), pa.int64()) for x in numbers]
    order, cuts = place.tolist(), ends.tolist()
    groups = pa.array([";".join(map(names.__getitem__, order[s:e])) for s, e in zip(cuts, cuts[1:])], pa.string())
    if not len(place):
        none = _ragged(np.zeros(0, np.int64), np.zeros(texts, np.int64), pa.int32())
        return [*sums, groups, none, none, *(pa.array([[] if i == 0 else None for i in range(texts)], pa.list_(k)) for k in (pa.int64(), pa.int32()))]
    n = np.fromiter(map(len, links), np.int64, len(used)) // 8
    starts = np.cumsum(n) - n
    pairs, codes = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
    times = np.ones(len(codes), np.int64)
    for s, x in zip(starts, often):
        if x is not None:
            times[s : s + len(x)] = x
    # a text's different segments with their numbers, then the pairs of each
    key, often = np.unique(of * len(used) + place, return_counts=True)
    text, seg = key // len(used), key % len(used)
    at = np.repeat(starts[seg], n[seg]) + np.arange(int(n[seg].sum())) - np.repeat(np.cumsum(n[seg]) - n[seg], n[seg])
    key, at_key = np.unique(np.repeat(text, n[seg]) * len(pairs) + codes[at], return_inverse=True)
    total = np.bincount(at_key, weights=times[at] * np.repeat(often, n[seg])).astype(np.int64)
    text, code = key // len(pairs), key % len(pairs)
    sizes = np.bincount(text, minlength=texts)
    held = np.bincount(code, minlength=len(pairs))
    first = [_first(pairs, texts, pa.int64()), _first(held, texts, pa.int32())]
    return [*sums, groups, _ragged(code, sizes, pa.int32()), _ragged(total, sizes, pa.int64()), *first]


def _first(values: np.ndarray, texts: int, kind) -> pa.Array:
    """values on the first row, null on the others."""
    offsets = pa.array(np.r_[0, np.full(texts, len(values))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind), mask=pa.array(np.arange(texts) > 0))


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> DataFrame:
    """docs' columns other than text with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for,
    groups: `a1,a2|b1;a3|b2,b3`, the decimal ids of A and B of each group in order.

    A is a byte-level BPE of the tokenizers library, applied to a space and the text, B a sentencepiece model, which adds the
    space itself; special tokens' strings are plain text to both. A pair's count is in how many rows of docs it is linked;
    n_best counts links whose count is the highest that their A id has, ties included; count_sum adds up all links' counts.

    Null and empty texts, and those whose bytes the tokens don't give back, have no tokens: zeros, an empty digest and no
    groups. Repeated rows count each; columns with the new names are replaced, any other name may occur; an empty table gives
    an empty one. A text of any length is one row's work: without places to cut it is one segment, and of a group with more
    than EXPAND links only the products of its different ids are formed."""
    new = [*NUMBERS, "n_best", "count_sum", "groups_sha256", "groups"]
    rest = [c for c in docs.columns if c not in ("text", *new)]
    store = Stored(docs.sparkSession)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    schema = kept.select("row").schema
    for name, kind in [("block", "long"), *((n, "long") for n in NUMBERS), ("groups", "string"), ("groups_sha256", "string"), ("at", INTS), ("times", LONGS), ("pairs", LONGS), ("held", INTS)]:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, block = aligner(path_a, path_b), 0
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in blocks(texts, BLOCK):
                *numbers, groups, at, times, pairs, held = block_columns(*c.batch(texts[i:j]))
                sha = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.to_pylist()], pa.string())
                if not keep_groups:
                    groups = pa.nulls(j - i, pa.string())
                number = (b.column(2)[i].as_py() << 32) + block
                block += 1
                columns = [b.column(0).slice(i, j - i), pa.array([number] * (j - i), pa.int64()), *numbers, groups, sha, at, times, pairs, held]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    aligned = store.put("aligned", kept.mapInArrow(trimmed(run), schema))
    pairs = aligned.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), "x.held")
    counts = store.put("counts", pairs.groupBy("pair").agg(F.sum("held").alias("count")))
    a = F.expr(f"pair DIV {SHIFT}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    counts = store.put("marked", counts.withColumn("a", a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))
    asked = pairs.select("block", "at", "pair").join(counts, "pair").select("block", "at", "count", "best")
    texts = store.read("aligned").select("row", "block", *NUMBERS, "groups", "groups_sha256", "at", "times")
    done = texts.select("row", *NUMBERS).schema.add("n_best", "long").add("count_sum", "long").add("groups_sha256", "string").add("groups", "string")

    def total(mine: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts.column("at").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], best[place] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
        mine = mine.combine_chunks()
        lists = mine.column("at").combine_chunks() if mine.column("at").num_chunks != 1 else mine.column("at").chunk(0)
        at = lists.flatten().to_numpy(zero_copy_only=False)
        times = mine.column("times").combine_chunks()
        times = (times if isinstance(times, pa.Array) else times.chunk(0)).flatten().to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sums = [np.concatenate([[0], np.cumsum(times * x[at])]) for x in (best, count)]
        n_best, count_sum = (pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)
        return pa.Table.from_arrays([*(mine.column(n) for n in ("row", *NUMBERS)), n_best, count_sum, mine.column("groups_sha256"), mine.column("groups")], names=done.names)

    out = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(total, done)
    return out.select(*(F.col(f"row.`{c}`") for c in rest), *NUMBERS, "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else []))
