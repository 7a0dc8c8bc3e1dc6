"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of equal passages of about PASSAGE bytes, the whole text from first to last. A passage's features are the
shares of its byte values, how much of its six-byte shingles repeat, and its length. A passage is encoded by one tanh
layer; gated attention (a tanh branch times a sigmoid branch) weighs the encodings of all passages of a text, and a
logistic layer scores the weighted encoding. Document labels alone train all of it, by Adam on the log loss.

The model is a few thousand numbers, fitted on the driver from a bounded sample of labelled rows: at most `most` texts,
taken whole, with at most MOST_PASSAGES passages in all (a bound that doesn't grow with the corpus). Scoring reads every
passage of every text, some hundred of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import trimmed

PASSAGE = 1024
BUCKETS = 512
WIDTH = 128 + 16 + 4
#: Passages that the driver fits on at most (592 bytes each), and that are counted or scored together.
MOST_PASSAGES, TOGETHER = 200_000, 512


def count(size: int, each: int = PASSAGE) -> int:
    """Passages of a text of `size` bytes."""
    return max(1, round(size / each))


def passages(data: np.ndarray, size: int = PASSAGE) -> np.ndarray:
    """Features (rows: passages, at least one) of one text's UTF-8 bytes, worked out some passages at a time."""
    n = count(len(data), size)
    out = np.zeros((n, WIDTH), np.float32)
    cut = lambda i: -(-i * len(data) // n)  # noqa: E731  passage i begins here
    for at in range(0, n, TOGETHER):
        to = min(n, at + TOGETHER)
        out[at:to] = _features(data, cut(at), cut(to), at, to, n)
    return out


def _features(data: np.ndarray, start: int, end: int, at: int, to: int, n: int) -> np.ndarray:
    """Features of the passages at..to of n, whose bytes are start..end; a shingle belongs to the passage it begins in."""
    m, out = to - at, np.zeros((to - at, WIDTH), np.float32)
    mine = data[start:end]
    of = np.arange(start, end, dtype=np.int64) * n // max(1, len(data)) - at  # passages of equal length
    length = np.bincount(of, minlength=m)[:m].astype(np.float32)
    kind = np.where(mine < 128, mine, 128 + (mine >> 3 & 15))
    shares = np.bincount(of * 144 + kind, minlength=m * 144).reshape(m, 144) / np.maximum(length, 1)[:, None]
    out[:, :144] = np.sqrt(shares)
    if len(data) >= 6:
        behind = data[start : end + 5]
        shingles = max(0, len(behind) - 5)
        h = np.zeros(shingles, np.uint64)
        for i in range(6):
            h = h * np.uint64(0x9E3779B97F4A7C15) + behind[i : shingles + i].astype(np.uint64)
        slot = np.bincount(of[:shingles] * BUCKETS + (h >> np.uint64(55)).astype(np.int64), minlength=m * BUCKETS).reshape(m, BUCKETS)
        out[:, 144] = (slot > 0).sum(1) / np.clip(length - 5, 1, BUCKETS)
        out[:, 145] = np.sqrt(slot.max(1) / np.maximum(length - 5, 1))
    out[:, 146] = np.log1p(length) / 7
    out[:, 147] = 1
    return out


def _bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, in place; null is empty."""
    for t in texts.cast(pa.binary()):
        yield np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8)


class Model:
    """Gated-attention scorer. params: W (features to encoding), V and U (attention branches), w (attention), c, b (score)."""

    def __init__(self, params: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = params, mean, scale

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Standard features; those of short passages, which vary by chance, are drawn to the mean."""
        length = np.expm1(7 * x[:, 146:147])
        return np.where(np.arange(WIDTH) < 146, length / (length + 48), 1) * (x - self.mean) / self.scale

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["W"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        sizes = np.diff(np.r_[starts, len(x)])
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, sizes, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the attention of the passages of all bags. In double precision, sums differ with the other bags by far
        less than a score is rounded to, so equal bags have equal scores."""
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        *_, a, _, _, s = self.forward(self.scaled(np.concatenate(bags)).astype(float), starts)
        return np.round(s, 9), a

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, g, a, sizes, z, s = self.forward(x, starts)
        ds = (s - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], sizes, 0)
        da = (dz * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = da[:, None] * g * p["w"] * (1 - t * t), da[:, None] * t * p["w"] * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ ds, "b": ds.sum(keepdims=True)}


def train(bags: list[np.ndarray], y: np.ndarray, encoding: int = 24, attention: int = 12, steps: int = 300, batch: int = 256, seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    mean[-1], scale[-1] = 0, 1  # the constant
    shape = {"W": (WIDTH, encoding), "V": (encoding, attention), "U": (encoding, attention), "w": (attention,), "c": (encoding,), "b": (1,)}
    p = {k: r.normal(0, (0.1 if k == "W" else 0.3) * (k != "b"), v) for k, v in shape.items()}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model, m1, m2 = Model(p, mean, scale), {k: np.zeros(v) for k, v in shape.items()}, {k: np.zeros(v) for k, v in shape.items()}
    bags = [model.scaled(b).astype(np.float32) for b in bags]
    for step in range(1, steps + 1):
        at = r.choice(len(bags), min(batch, len(bags)), replace=False)
        mine = [bags[i] for i in at]
        grad = model.gradient(np.concatenate(mine), np.cumsum([0, *(len(b) for b in mine[:-1])]), y[at])
        for k, g in grad.items():
            g = g + 1e-4 * p[k] * (k != "b")
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            p[k] = (p[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(p[k].dtype)
    return model


def _fold(doc_id) -> object:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, most_passages: int = MOST_PASSAGES) -> Model | None:
    """A model from labelled texts outside the held-out fold, or None without labels of both kinds.

    Of each label the doc_ids with the smallest hashes are taken, at most half of `most`; in that order their texts are
    used whole while they have no more than half of `most_passages`. A doc_id with several labels counts by their mean
    (0.5 or more: good); of several texts with one doc_id the one with the smallest digest is taken; null labels and null
    doc_ids don't count."""
    good = labels.where("quality is not null and doc_id is not null").where(_fold("doc_id") != 2).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    good = good.withColumn("h", F.xxhash64("doc_id"))
    # top-k in each task, then of those
    some = good.where("good = 0").orderBy("h", "doc_id").limit(most // 2).unionByName(good.where("good = 1").orderBy("h", "doc_id").limit(most // 2))
    text = F.col("text").cast("string")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    docs = docs.select("doc_id", text.alias("text"))
    sizes = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "h", "good").agg(F.min(F.struct(digest.alias("d"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))).alias("s"))
    picked, total = [], [0, 0]
    for r in sorted(sizes.select("h", "doc_id", "good", "s.d", "s.n").collect()):  # at most `most` rows
        n = count(r.n)
        if total[r.good] + n <= most_passages // 2:
            total[r.good] += n
            picked.append((r.doc_id, r.h, r.good, r.d))
    if len({r[2] for r in picked}) < 2:
        return None
    mine = docs.sparkSession.createDataFrame(picked, some.select("doc_id", "h", "good").schema.add("d", "string"))
    texts = docs.join(F.broadcast(mine), "doc_id").where(digest == F.col("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(_bytes(b.column(0))):
                bag = pa.array([passages(data).astype("<f4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1), b.column(2).slice(i, 1), bag], names=["h", "good", "bag"])

    bags = texts.select("text", "h", "good").mapInArrow(trimmed(run), "h long, good int, bag binary").groupBy("h", "good").agg(F.min("bag").alias("bag"))  # repeated rows once
    rows = sorted((r.h, r.good, bytes(r.bag)) for r in bags.collect())
    return train([np.frombuffer(bag, "<f4").reshape(-1, WIDTH) for _, _, bag in rows], np.array([y for _, y, _ in rows], np.float32))


def score(docs: DataFrame, model: Model | None, cut: float = 0.7, only_good: bool = False) -> DataFrame:
    """docs' columns with score (0 to 1, higher is better), predicted (1 at `cut` or more) and attention (the weight of
    each passage). Null and empty texts are one empty passage. Without a model every score is 1. Rows stay as they are;
    only_good leaves out those predicted 0."""
    own = ["score", "predicted", "attention"]
    rest = [c for c in docs.columns if c not in ("text", *own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in _together([0 if n is None else n for n in pc.binary_length(b.column(1)).to_pylist()]):
                part = b.slice(at, to - at)
                bags = [passages(x) for x in _bytes(part.column(1))]
                if model is None:
                    scores, a = np.ones(len(bags)), np.concatenate([np.full(len(x), 1 / len(x)) for x in bags])
                else:
                    scores, a = model.score(bags)
                weights = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bags)]), pa.int32()), pa.array(a, pa.float64()))
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array((scores >= cut).astype(np.int32)), weights], names=["row", "text", *own])
                yield out.filter(pa.array(scores >= cut)) if only_good else out

    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("text").cast("string").alias("text"))  # a text travels once
    out = df.mapInArrow(trimmed(run), df.select("row", "text").schema.add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("attention", T.ArrayType(T.DoubleType())))
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in own), *own)


def _together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about TOGETHER passages; a larger text goes by itself."""
    at = total = 0
    for i, n in enumerate(map(count, sizes)):
        if i > at and total + n > TOGETHER:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def classify(docs: DataFrame, labels: DataFrame, most: int = 4000, cut: float = 0.7) -> DataFrame:
    """docs' columns with held_out, score, predicted and attention.

    A null doc_id is in no fold: held_out is false. Equal texts have equal scores, whatever their rows; repeated rows each
    get theirs; columns with the new names are replaced and any other name may occur; an empty table gives an empty one.
    A text of any length is one row's work: its features take less than its bytes, at TOGETHER passages at a time."""
    held = F.coalesce(_fold("doc_id") == 2, F.lit(False))
    return score(docs, fit(docs, labels, most), cut).withColumn("held_out", held)


def keep_good(docs: DataFrame, labels: DataFrame, most: int = 4000, cut: float = 0.7) -> DataFrame:
    """docs without those that are predicted to be bad; columns stay. Nulls, ties and the rest are as in classify."""
    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), "text")
    kept = score(row, fit(docs, labels, most), cut, only_good=True)
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
