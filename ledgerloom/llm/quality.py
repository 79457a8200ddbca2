"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words, runs of signs and pairs of neighbours are hashed into ``BUCKETS`` buckets; pairs of a word with itself back off to
one n-gram, "the same again", whatever the word. One generative model counts them over
the target (labelled good rows), one over all raw documents. A document's log importance weight is the summed log ratio
of the two models over a passage of ``PASSAGE`` of its features, that is ``PASSAGE`` times its mean log ratio: summed
over whole texts instead, the weight would measure length. With Gumbel noise fixed by its id the weight becomes a key,
and the k largest keys are a sample without replacement by importance. k is the caller's; by default it is the number
of documents whose mean log ratio is at least a cutoff between the labelled classes.

Defined cases: a null or empty text has a log ratio of 0; null labels are not learnt from; without target rows all
ratios are 0 and all rows stay; rows with equal keys at the end of the sample all stay; other columns are carried, and
a new column whose name the table has already is named by ``free_name``.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, join_small, series_udf, small_batches, stored, text_or_empty, tidying, unit_hash

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+")
BUCKETS = 1 << 16
PASSAGE = 100
#: Pieces of about equal size along which labelled rows are summed for the default cutoff.
PIECES = 200
BINS = 4096
SEED = 2
#: Buckets whose counts are dealt out and summed together.
SLICE = 4096


def features(text: str) -> np.ndarray:
    words = TOKEN.findall(text.lower().encode("utf-8", "replace"))
    n = len(words)
    one = np.fromiter(map(crc32, words), np.uint64, n)
    if n < 2:
        return (one % np.uint64(BUCKETS)).astype(np.int64)
    a, b = one[:-1], one[1:]
    two = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77) + np.uint64(7)) >> np.uint64(16)
    two = np.where(a == b, np.uint64(1), two)
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


@tidying
def _count(batches):
    """A task's counts in slices: (target, slice, counts as longs)."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, good in zip(batch["text"], batch["good"]):
            f = features(text)
            np.add.at(total[0], f, 1)
            if good:
                np.add.at(total[1], f, 1)
    for target in range(2):
        for at in range(0, BUCKETS, SLICE):
            part = total[target, at : at + SLICE]
            if part.any():
                yield pd.DataFrame({"target": [target], "slice": [at // SLICE], "n": [part.tobytes()]})


@tidying
def _summed(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for target, at, n in zip(b["target"], b["slice"], b["n"]):
            total[target, at] = total.get((target, at), 0) + np.frombuffer(n, np.int64)
    for (target, at), n in total.items():
        yield pd.DataFrame({"target": [target], "slice": [at], "n": [n.tobytes()]})


class ImportanceResampler:
    """Log ratios by bucket and the cutoff that decides how many documents to keep."""

    def __init__(self, ratios: np.ndarray, cutoff: float):
        self.ratios, self.cutoff = ratios, cutoff

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, train_on: Column | None = None) -> "ImportanceResampler":
        """Counts cover all of ``docs``; the cutoff is fitted on all labelled rows."""
        spark = docs.sparkSession
        small_batches(spark)
        labelled = labels.select("doc_id", F.col("quality").cast("int").alias("good")).where("good is not null and doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
        if train_on is not None:
            labelled = labelled.where(train_on)
        marked = join_small(docs.select("doc_id", text_or_empty().alias("text")), labelled, "doc_id", "left", labelled.count())
        counts = marked.select("text", (F.coalesce(F.col("good"), F.lit(0)) > 0).alias("good")).mapInPandas(_count, "target int, slice int, n binary")
        n = np.zeros((2, BUCKETS))
        for r in counts.repartition("target", "slice").mapInPandas(_summed, "target int, slice int, n binary").collect():  # a few MB at any size
            n[r["target"], r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["n"], np.int64)
        if not n[1].sum():
            return cls(np.zeros(BUCKETS), -np.inf)
        share = (n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * BUCKETS)
        model = cls(np.clip(np.log(share[1]) - np.log(share[0]), -8, 8), -np.inf)
        seen = marked.where("good is not null")
        model.cutoff = least_cost(seen.select("good", model.mean_ratio(seen).alias("m")))
        return model

    def mean_ratio(self, docs: DataFrame, text_col: str = "text") -> Column:
        send = docs.sparkSession.sparkContext.broadcast(self.ratios)

        def mean(texts: pd.Series) -> pd.Series:
            r = send.value
            return pd.Series([float(r[f].mean()) if len(f := features(t)) else 0.0 for t in texts], dtype=float)

        return series_udf(mean, "double")(text_or_empty(text_col))

    def key(self, ratio: Column, id_col: str = "doc_id", passage: int = PASSAGE, seed: int = SEED) -> Column:
        """Log importance weight plus Gumbel noise."""
        return ratio * float(passage) - F.log(-F.log(unit_hash(seed, id_col) + F.lit(2.0**-54)))

    def scores(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
        """``docs`` without its text, with qr_ratio, qr_key and qr_keep, true for the k largest keys. Texts are read once."""
        small_batches(docs.sparkSession)
        ratio, key, keep = (free_name(docs, x) for x in ("qr_ratio", "qr_key", "qr_keep"))
        scored = docs.withColumn(ratio, self.mean_ratio(docs, text_col)).withColumn(key, self.key(F.col(ratio), id_col))
        scored = stored(scored.drop(text_col), "scores")
        return scored.withColumn(keep, F.col(key) >= F.lit(self.least_key(scored, ratio, key, k)))

    def least_key(self, scored: DataFrame, ratio: str, key: str, k: int | None = None) -> float:
        want = scored.where(F.col(ratio) >= F.lit(float(self.cutoff))).count() if k is None else k
        return float(kth_largest(scored, key, want))

    def resample(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
        """``docs`` with qr_ratio, qr_key and qr_keep, true for the k largest keys."""
        ratio, key, keep = (free_name(docs, x) for x in ("qr_ratio", "qr_key", "qr_keep"))
        keyed = docs.withColumn(ratio, self.mean_ratio(docs, text_col)).withColumn(key, self.key(F.col(ratio), id_col))
        return keyed.withColumn(keep, F.col(key) >= F.lit(self.least_key(stored(keyed.select(ratio, key), "keys"), ratio, key, k)))


def least_cost(seen: DataFrame) -> float:
    """The cutoff of (m, good) with fewest errors on either class's share, placed midway in the gap it falls into; losing a good
    row weighs four times as much as keeping a poor one.

    All rows count: whole numbers summed by value, then along pieces of about equal size, whose totals alone reach the driver."""
    each = stored(seen.groupBy("m").agg(F.count_if(F.col("good") > 0).alias("g"), F.count_if(F.col("good") <= 0).alias("p")), "cutoff")
    good, poor = each.agg(F.sum("g"), F.sum("p")).first()
    if not good or not poor:
        return -np.inf
    edges = sorted(set(each.approxQuantile("m", [i / PIECES for i in range(1, PIECES)], 0.001)))
    each = each.withColumn("piece", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("m"))))
    carried, g, p = [], 0, 0
    for r in sorted(each.groupBy("piece").agg(F.sum("g").alias("g"), F.sum("p").alias("p")).collect()):
        carried.append((r["piece"], g, p))
        g, p = g + r["g"], p + r["p"]
    each = each.join(F.broadcast(each.sparkSession.createDataFrame(carried, "piece int, g0 long, p0 long")), "piece")
    before = Window.partitionBy("piece").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: (F.col(f"{c}0") + F.coalesce(F.sum(c).over(before), F.lit(0))).cast("decimal(19,0)")
    cost = below("g") * F.lit(4 * poor).cast("decimal(19,0)") - below("p") * F.lit(good).cast("decimal(19,0)")
    first = each.select("m", cost.alias("cost")).agg(F.min_by("m", F.struct("cost", "m"))).first()[0]
    last = each.where(F.col("m") < F.lit(first)).agg(F.max("m")).first()[0]
    return -np.inf if last is None else (last + first) / 2


def best_cutoff(m: np.ndarray, good: np.ndarray) -> float:
    """The same of arrays: the cutoff of fewest errors on either class's share, placed midway in the gap it falls into; losing a good
    row weighs four times as much as keeping a poor one."""
    if len(m) == 0 or good.min() == good.max():
        return -np.inf
    order = np.argsort(m)
    m, good = m[order], good[order].astype(float)
    lost = np.concatenate([[0.0], np.cumsum(good)]) / good.sum()
    poor = 1 - good
    kept = 1 - np.concatenate([[0.0], np.cumsum(poor)]) / poor.sum()
    cost = 4 * lost + kept
    i = int(cost.argmin())
    if i == 0:
        return -np.inf
    return float((m[i - 1] + (m[i] if i < len(m) else m[i - 1])) / 2)


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The exact k-th largest value: counts over bins, then over the bin that holds it, and so on."""
    if k <= 0:
        return np.inf
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k >= n:
        return -np.inf
    while True:
        inside = df.where((F.col(col) >= low) & (F.col(col) <= high))
        if low == high:
            return low
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            return sorted((r[0] for r in inside.select(col).distinct().collect()), reverse=True)[0]
        bins = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        got = sorted(inside.groupBy(bins.alias("b")).agg(F.count(F.lit(1)), F.min(col), F.max(col)).collect(), reverse=True)
        for _, c, least, most in got:
            if k <= c:
                low, high = least, most
                break
            k -= c
