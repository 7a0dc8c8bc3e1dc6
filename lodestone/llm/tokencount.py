"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree.

A byte-level tokenizer first cuts a text into pieces and encodes each on its own. Ordinary texts are cut before each
single space between two visible characters, where a piece always starts; such segments are counted once and
remembered in a bounded memory. A text of more than `chunk` characters is cut into chunks that overlap. Where a piece
starts at the same place in both chunks, before the last characters of the left one, the boundary is proven: the left
chunk has started at a proven boundary and has seen what follows, and cutting from a boundary on doesn't look back.
Counts are spliced there. If an overlap has no such place it is widened until it has one or the text ends.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import REMEMBER, blocks
from lodestone.llm.common import trimmed


class Counter:
    def __init__(self, path: str, chunk: int, overlap: int):
        from tokenizers import Tokenizer

        self.whole, self.chunk, self.overlap = Tokenizer.from_file(path), chunk, overlap
        self.whole.no_truncation()
        self.whole.no_padding()
        special = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.counts: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.again: set[str] = set()  # remembered segments that later blocks have used

    def plain(self, text: str) -> int:
        return len(self.whole.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) > REMEMBER:
                self.pieces.clear()
            n = len(self.whole.model.tokenize(piece))
            if len(piece) <= 64:
                self.pieces[piece] = n
        return n

    def _chunk(self, text: str, start: int, end: int) -> tuple[dict[int, int], int]:
        """Tokens before each place where a piece starts, and of the whole chunk."""
        before, total = {}, 0
        for piece, (at, _) in self.whole.pre_tokenizer.pre_tokenize_str(text[start:end]):
            before[start + at] = total
            total += self._piece(piece)
        return before, total

    def huge(self, text: str) -> int:
        """Tokens of a text of any length, chunk by chunk."""
        total = 0
        if self.special:
            total, parts = len(self.special.findall(text)), self.special.split(text)
        else:
            parts = [text]
        for part in parts:
            start, end = 0, min(self.chunk, len(part))  # the left chunk counts from start, a proven boundary, on
            left, n = self._chunk(part, 0, end)
            while end < len(part):
                overlap = self.overlap
                while True:
                    nxt = max(start, end - overlap)
                    to = min(nxt + self.chunk + overlap, len(part))
                    right, m = self._chunk(part, nxt, to)
                    seam = next((p for p in right if p in left and start <= p <= end - 2 and (p > nxt or nxt == start)), None)
                    if seam is not None and (seam > start or to > end):
                        break
                    overlap *= 4
                total += left[seam] - left[start]
                start, end, left, n = seam, to, right, m
            if part:
                total += n - left[start]
        return total

    def batch(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") if len(t) <= self.chunk else None for t in texts]
        rest = [ws[1:] for ws in split if ws]
        seen = set().union(*rest)
        new = seen.difference(self.counts)
        self.again |= seen - new
        if len(self.counts) + len(new) > REMEMBER:
            if len(self.again) > REMEMBER // 2:
                self.again = seen - new
            self.counts = {w: self.counts[w] for w in self.again}
        safe = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        for w in new.difference(safe):
            self.counts[w] = -1  # not a place to cut
        for w, e in zip(safe, self.whole.encode_batch_fast([" " + w for w in safe], add_special_tokens=False)):
            self.counts[w] = len(e.ids)
        out, get = [], self.counts.__getitem__
        first = [ws[0] for ws in split if ws]
        heads = iter(self.whole.encode_batch_fast(first, add_special_tokens=False))
        for t, ws in zip(texts, split):
            if ws is None:
                out.append(self.huge(t))
                continue
            head, tail = len(next(heads).ids), list(map(get, ws[1:]))
            odd = tail and (-1 in tail or not ws[0] or ws[0][-1].isspace())
            out.append(self.plain(t) if odd else head + sum(tail))
        return out


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, path: str, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """docs' columns other than text, with n_bytes and n_tokens (long) of the text.

    A null text counts as empty (0 bytes, 0 tokens). Rows are neither moved nor merged, so ties and repeats stay;
    columns named n_bytes or n_tokens are replaced; an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, chunk, overlap)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            counts = [n for i, j in blocks(texts) for n in c.batch(texts[i:j])]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int64())], names=[*rest, "n_tokens"])

    text = F.col("text").cast("string")
    df = docs.select(text, *(F.col(f"`{c}`") for c in rest), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    rest = [*rest, "n_bytes"]
    return df.mapInArrow(trimmed(run), df.drop("text").schema.add("n_tokens", "long"))
