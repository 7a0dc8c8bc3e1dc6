"""Quality rules with risk-controlled thresholds.

Every text is measured; each rule rejects a text whose measure is above a cutoff. Cutoffs come from labelled texts, for
each stratum (language) by itself: from the most lenient cutoff on, an exact binomial (Clopper-Pearson) upper bound on
the share of good texts rejected must stay within the allowed risk, at an error level that is divided by the number of
strata (Bonferroni) and, as cutoffs are tried in a fixed order that ends at the first failure, by nothing more. Of the
certified cutoffs the one that rejects most bad texts over good ones is taken, the most lenient on ties.

A stratum with good labels enough for it certifies each rule alone, with the rule's part of the risk and of the error
level. One with fewer certifies the union of all rules at one step of their ladders, with the whole of both: that needs
a fifth of the labels. Which of the two holds is settled by the number of good labels alone, before any rejection is
looked at, so the guarantee stands. A stratum with too few for that as well has the base rule only.

Tallies are one row a stratum, certified row by row in tasks and joined with the texts; no number of strata is too many.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stored, trimmed

SYMBOLS = "#*$%&|<>"
#: Measures that rules look at, and cutoffs from lenient to strict.
CUTOFFS = {
    "symbols_per_word": [2.0, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_share": [0.9, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
}
STEPS = max(map(len, CUTOFFS.values()))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None, window: int = 5) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word, n_upper."""
    text = t = text or ""
    for c in "\t\n\x0b\x0c\r":
        if c in t:
            t = t.replace(c, " ")
    words = [w for w in t.split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    n = len(words)
    repeats = 0
    if n > window:
        seen = list(zip(*(words[k:] for k in range(window))))
        if len(set(seen)) < len(seen):
            often, covered = Counter(seen), 0
            for i, x in enumerate(seen):
                if often[x] > 1:
                    repeats += i + window - max(covered, i)
                    covered = i + window
    upper = sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), upper


def measures(docs: DataFrame) -> DataFrame:
    """(row: docs' columns but text, the five counts, the four measures) of every row's text."""
    rest = [c for c in docs.columns if c not in ("text", *COUNTS, *CUTOFFS)]
    counted = [*COUNTS, "n_lines", "n_upper"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(measure(t.as_py()) for t in b.column(0)))) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["row", *counted])

    df = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    schema = df.select("row").schema
    for c in counted:
        schema = schema.add(c, "long")
    m = df.mapInArrow(trimmed(run), schema)
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    shares = {"symbols_per_word": ("n_symbols", "n_words"), "upper_share": ("n_upper", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines")}
    return m.select("row", *COUNTS, *(per(*ab).alias(c) for c, ab in shares.items()))


def _stirling(n: int) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n**2) / n**2) / n**2) / n**2) / n


def _deviance(x: float, m: float) -> float:
    """x log(x / m) + m - x, also where x and m are close."""
    if abs(x - m) < 0.1 * (x + m):
        v = (x - m) / (x + m)
        total, term, i = (x - m) * v, 2 * x * v, 1
        while True:
            term *= v * v
            after = total + term / (2 * i + 1)
            if after == total:
                return total
            total, i = after, i + 1
    return x * math.log(x / m) + m - x


def binomial_below(k: int, n: int, p: float) -> float:
    """The chance of k or fewer of n: the point chance (Loader's form, exact at any n) times the sum of its predecessors'
    ratios, down to the first that no longer counts."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    if k == 0:
        return math.exp(n * math.log1p(-p))
    log = _stirling(n) - _stirling(k) - _stirling(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))
    total = term = 1.0
    odds = (1 - p) / p
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * odds
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(log) * total)


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The largest p at which k or fewer of n still has a chance of delta: the exact upper bound on a rate."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid < 1 and binomial_below(k, n, mid) > delta else (low, mid)
    return high


def _best(good: list[int], bad: list[int], n: int, risk: float, delta: float) -> int | None:
    """The step that rejects most bad over good texts, of those certified before the first that isn't."""
    best = None
    for i, (g, b) in enumerate(zip(good, bad)):
        if not n or binomial_upper(g, n, delta) > risk:
            break
        if b - g > (best[0] if best else 0):
            best = (b - g, i)
    return best[1] if best else None


def thresholds(row: dict, risk: float, delta: float) -> dict[str, float | None]:
    """Certified cutoffs of one stratum. row: good (how many), and good_ and bad_ tallies of each rule and of the union;
    delta: the stratum's part of the error level."""
    n, rules, cutoffs = row["good"] or 0, len(CUTOFFS), dict.fromkeys(CUTOFFS)
    if n and binomial_upper(0, n, delta / rules) <= risk / rules:
        for rule, cuts in CUTOFFS.items():
            step = _best(row[f"good_{rule}"], row[f"bad_{rule}"], n, risk / rules, delta / rules)
            if step is not None:
                cutoffs[rule] = cuts[step]
    else:
        step = _best(row["good_union"], row["bad_union"], n, risk, delta)
        if step is not None:
            cutoffs = {rule: cuts[min(step, len(cuts) - 1)] for rule, cuts in CUTOFFS.items()}
    return cutoffs


def _key(stratum: Column) -> Column:
    """A stratum's name, null being one of its own."""
    return F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit(""))


def fit(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, a cutoff or null for each rule) of every stratum with labels: tallies of good and bad texts above each
    cutoff are summed in Spark and certified there.

    A doc_id with several labels counts by their mean (0.5 or more: good); null labels don't count."""
    quality = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("is_good"))
    rows = measured.select(F.col("row.doc_id").alias("doc_id"), _key(F.col(f"row.`{stratum}`")).alias("stratum"), *CUTOFFS).join(quality, "doc_id")
    above = {rule: [F.col(rule) > cut for cut in cuts] for rule, cuts in CUTOFFS.items()}
    above["union"] = [F.greatest(*(x[min(i, len(x) - 1)] for x in above.values())) for i in range(STEPS)]
    good = F.col("is_good")
    sums = [F.array(*(F.sum((kind & x).cast("long")) for x in tests)).alias(f"{name}_{rule}") for rule, tests in above.items() for name, kind in (("good", good), ("bad", ~good))]
    counts = rows.groupBy("stratum").agg(F.sum(good.cast("long")).alias("good"), *sums)
    counts = Stored(measured.sparkSession).put("tallies", counts)
    strata = counts.crossJoin(F.broadcast(counts.agg(F.count(F.lit(1)).alias("strata"))))  # one number beside each tally

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [{"stratum": r["stratum"], **thresholds(r, risk, delta / r["strata"])} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("stratum", pa.string()), *((rule, pa.float64()) for rule in CUTOFFS)]))

    return strata.mapInArrow(run, "stratum string, " + ", ".join(f"{rule} double" for rule in CUTOFFS))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """docs' columns but text with the counts, the measures, base_failed and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in five-word windows that come again. Null and empty
    texts have no words and fail. Without labels only the base rule holds. Repeated rows each get their verdict; a null
    stratum is a stratum; a measure at the cutoff passes; columns of docs named as the new ones are replaced; an empty
    table gives an empty one. A text of any length is one row's work, at a few times its words in memory.
    """
    store = Stored(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("text", "base_failed", "kept", *COUNTS, *CUTOFFS)]
    measured = store.put("measured", measures(docs.select("text", *(F.col(f"`{c}`") for c in own))))
    cutoffs = store.put("cutoffs", fit(measured, labels, stratum, risk, delta)).alias("c")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.lit(False)
    for rule in CUTOFFS:
        failed = failed | F.coalesce(F.col(f"m.{rule}") > F.col(f"c.{rule}"), F.lit(False))
    out = measured.alias("m").join(cutoffs, _key(F.col(f"m.row.`{stratum}`")) == F.col("c.stratum"), "left")
    return out.select(*(F.col(f"m.row.`{c}`") for c in own), *COUNTS, *(F.col(f"m.{rule}") for rule in CUTOFFS), base.alias("base_failed"), (~base & ~failed).alias("kept"))
