"""Toxicity by class-conditional Kneser-Ney models.

Two word models, one of toxic and one of ordinary labelled text: absolute-discounted bigrams back off to words by
their continuation counts (distinct words before them), those back off to a shared vocabulary weighed by word
beginnings, and those to counts that both classes share, so an expression rare in both gives no evidence. A document's evidence is the difference of
both log-likelihoods a word, over the whole text and over its strongest passage; a logistic curve fitted on all
labelled training rows, each scored without what it adds to the counts itself, turns it into a score.

Counts cover every labelled training row, are summed by Spark, and all of them make up the model. The
``HOT`` most frequent pairs of words and a quarter as many of the other kinds are broadcast, the rest stays a table. Documents are read once, in groups: words
whose expressions are all broadcast, or surely not in the rest by a Bloom filter of bounded size, are weighed at once; the distinct other
expressions of a group meet the rest in buckets, and what is found goes back to the group. ``HOT`` and the filter
decide where a count is looked up, never whether.

Defined cases: null and empty texts score as no evidence (the curve's value at zero); null labels and labels of
unknown documents are not learnt from; a document labelled twice is toxic if one label says so; without both
classes every score is 0. Only the text is an input of a score.
"""

from __future__ import annotations

import pickle
import re
import zlib
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import _clean_up, columns, join_small, small_batches, stored, text_or_empty, tidying

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Pairs of words that are broadcast; of the other kinds a quarter.
HOT = 2_000_000
#: 64-bit words of the Bloom filter.
FILTER_WORDS = 1 << 21
#: Words in a group of documents, and rows of the rest in a bucket (at most MOST_BUCKETS of these).
GROUP_WORDS = 1_000_000
BUCKET_ROWS, MOST_BUCKETS = 20_000, 4096
DISCOUNT = 0.75
BEGINNING = 5
WINDOW = 48
STRONG = 2.5
#: Evidence beyond these says no more.
MOST_BEST, MOST_MEAN = 10.0, 4.0
#: 1: both classes weigh the same when the curve is fitted; 0: each row does.
BALANCE = 0.8
FLUSH = 4_000_000
BIGRAM, WORD, STEM, CONTEXT = 0, 1, 2, 3
#: Word hashes have 31 bits, so a pair of them fills 62; the sign marks the hash of a beginning, bit 31 that of a word, both that of a context.
LOW = np.uint64(0x7FFFFFFF)
MARK = np.uint64(1 << 63)
ALONE = np.uint64(1 << 31)
#: Changes the keys under which the filter holds what was counted more than once.
MORE = np.uint64(0x5851F42D4C957F2D)
COUNTS = ["o", "t"]
#: What discounting takes up of a context's counts.
USED = ["uo", "ut"]
NEEDS = "bucket int, part long, keys binary, state binary"
FOUND = "part long, bucket int, found binary, state binary"


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and of their beginnings."""
    words = TOKEN.findall(text.lower().encode("utf-8", "replace"))
    n = len(words)
    return np.fromiter(map(crc32, words), np.uint64, n) & LOW, np.fromiter((crc32(w[:BEGINNING]) for w in words), np.uint64, n) & LOW


def _count(batches):
    """Rows (key, 2 n + class) of what a task has read, merged before they are shuffled."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def out():
        for code, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(keys), 200_000):
                yield pd.DataFrame({"key": keys[i : i + 200_000].astype(np.int64), "coded": n[i : i + 200_000].astype(np.int64) * 2 + code})

    for batch in batches:
        for text, code in zip(batch["text"], batch["toxic"]):
            word, stem = tokens(text)
            if len(word):
                before = np.concatenate([[np.uint64(0)], word[:-1]])
                held.setdefault(code, []).extend([(before << np.uint64(32)) | word, MARK | stem])
                size += 2 * len(word)
        if size > FLUSH:
            yield from out()
            held, size = {}, 0
    yield from out()


def _before(word: np.ndarray, starts=()) -> np.ndarray:
    """The word before each word, 0 at the starts."""
    out = np.concatenate([[np.uint64(0)], word[:-1]])[: len(word)]
    out[np.asarray(starts, np.int64)] = 0
    return out


def _keys(word: np.ndarray, stem: np.ndarray, before: np.ndarray) -> dict[int, np.ndarray]:
    return {BIGRAM: (before << np.uint64(32)) | word, WORD: ALONE | word, STEM: MARK | stem, CONTEXT: MARK | ALONE | before}


def _bucket(key, n: int):
    """The bucket of a key, given as a column or as an array of signed numbers."""
    if isinstance(key, Column):
        return F.pmod(F.shiftright(key, 32) * 31 + key.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(n)).cast("int")
    return ((key >> 32) * 31 + (key & 0xFFFFFFFF)) % n


def _lots(need: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets and the keys that are needed from each."""
    bucket = _bucket(need.view(np.int64), buckets)
    order = np.argsort(bucket, kind="stable")
    ids, first = np.unique(bucket[order], return_index=True)
    return ids, np.split(need[order], first[1:]) if len(ids) else []


def _planes(v: np.ndarray) -> bytes:
    """Numbers of 32 bits, byte by byte: small ones then pack well."""
    return v.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _coded(v: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Distinct values, the most frequent first, and for each value its number."""
    kinds, which, n = np.unique(v, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(kinds), np.uint32)
    rank[order] = np.arange(len(kinds))
    return kinds[order], _planes(rank[which])


def _pack_words(at: np.ndarray, word: np.ndarray, stem: np.ndarray, before: np.ndarray) -> dict:
    """Words at rising places; the word before is left out where it is the one packed last."""
    steps = np.diff(at, prepend=-2)
    last = (steps == 1) & (before == np.roll(word, 1))
    return {"steps": _planes(steps), "words": _coded((stem << np.uint64(32)) | word), "last": np.packbits(last), "before": _coded(before[~last])}


def _unpack_words(packed: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.cumsum(_numbers(packed["steps"]).astype(np.int64)) - 2
    both = packed["words"][0][_numbers(packed["words"][1])]
    word = both & np.uint64(0xFFFFFFFF)
    before, last = np.roll(word, 1), np.unpackbits(packed["last"], count=len(at)).astype(bool)
    before[~last] = packed["before"][0][_numbers(packed["before"][1])]
    return at, word, both >> np.uint64(32), before


def _own_counts(pair: np.ndarray, word: np.ndarray, stem: np.ndarray) -> dict[int, np.ndarray]:
    """What a text adds to the counts of its own expressions."""
    _, which = np.unique(stem, return_inverse=True)
    out = {STEM: np.bincount(which)[which]}
    _, first, which = np.unique(pair, return_index=True, return_inverse=True)
    out[BIGRAM] = np.bincount(which)[which]
    _, whose = np.unique(word, return_inverse=True)
    out[WORD] = np.bincount(whose[first], minlength=whose.max() + 1)[whose]  # a word's own contexts: each once
    return out


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of x in keys, or the length of keys where it is not there."""
    at = np.searchsorted(keys, x)
    inside = at < len(keys)
    inside[inside] &= keys[at[inside]] == x[inside]
    return np.where(inside, at, len(keys))


class Table:
    """Counts of expressions by sorted keys in either class (ordinary, toxic), and what discounting leaves after contexts; the last entry stands for all others."""

    def __init__(self, key: np.ndarray, counts: list[np.ndarray], used: list[np.ndarray] | None = None):
        order = np.argsort(key)
        self.key, self.n = key[order], np.stack([np.append(n[order], 0) for n in counts])
        if self.n.max() < 1 << 31:
            self.n = self.n.astype(np.int32)
        self.left = None if used is None else np.clip(1 - np.stack([np.append(u[order], 0.0) for u in used]) / np.maximum(self.n, 1.0), 1e-6, 1.0)

    def __getstate__(self):
        """Packed for the broadcast, of which each executor writes a copy: sorted keys by their steps."""
        steps = np.diff(self.key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
        counts = [_planes(n) for n in self.n] if self.n.dtype == np.int32 else self.n
        return zlib.compress(pickle.dumps((steps, counts, self.left)), 1)

    def __setstate__(self, packed):
        steps, counts, self.left = pickle.loads(zlib.decompress(packed))
        self.key = np.cumsum(np.frombuffer(steps, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)
        self.n = np.stack([_numbers(n).astype(np.int32) for n in counts]) if isinstance(counts, list) else counts

    @classmethod
    def of(cls, rows: pa.Table) -> "Table":
        columns_ = [rows.column(c).to_numpy() for c in rows.column_names]
        return cls(columns_[0].view(np.uint64), columns_[1:3], columns_[3:] or None)


class Filter:
    """A Bloom filter: two bits of one word for each key."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        h = key * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        one, six = np.uint64(1), np.uint64(63)
        return (h >> np.uint64(20)) % np.uint64(n), (one << (h & six)) | (one << ((h >> np.uint64(6)) & six))

    @classmethod
    def build(cls, rest: DataFrame, n: int) -> "Filter":
        def places(batches):
            for b in batches:
                key, often = b["key"].to_numpy(np.int64).view(np.uint64), (b["o"] + b["t"] > 1).to_numpy()
                at, mask = cls.places(np.concatenate([key, key[often] ^ MORE]), n)
                yield pd.DataFrame({"at": at.astype(np.int32), "mask": mask.view(np.int64)})

        got = rest.select("key", *COUNTS).mapInPandas(places, "at int, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
        bits = np.zeros(n, np.uint64)
        bits[got.column("at").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        return cls(bits)

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        at, mask = self.places(key, len(self.bits))
        return (self.bits[at] & mask) == mask


class Model:
    """The expressions that are broadcast, the sums over all expressions, and the filter of the rest (None: there is no rest)."""

    def __init__(self, tables: dict[int, Table], totals: dict, rest: Filter | None = None):
        """tables: by kind; totals: sums of both classes and how many expressions each has, by kind, and the number of word types."""
        self.tables = tables
        self.total = {k: [max(float(totals[k, c]), 1.0) for c in COUNTS] for k in (STEM, WORD)}
        self.left = {k: [max(1 - (totals[k, c] - DISCOUNT * totals[k, "n" + c]) / m, 1e-6) for c, m in zip(COUNTS, self.total[k])] for k in (STEM, WORD)}
        self.pool = 1 / max(totals["types"], 1.0)
        self.rest = rest

    def weigh(self, n: dict[int, np.ndarray], left: np.ndarray, own=None, mine: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """The toxic less the ordinary log-likelihood from counts by kind and what discounting leaves after each context; ``mine`` is taken off the
        counts of the class ``own``."""
        d = DISCOUNT
        if mine is not None:
            n = n | {k: np.stack([np.where(own == c, np.maximum(n[k][c] - m, 0), n[k][c]) for c in (0, 1)]) for k, m in mine.items()}
        s, w, b, c = n[STEM], n[WORD], n[BIGRAM], n[CONTEXT]
        shared = (s[0] + s[1] + 1e-2) / sum(self.total[STEM])
        p_stem = [np.maximum(x - d, 0) / m + r * shared for x, m, r in zip(s, self.total[STEM], self.left[STEM])]
        lean = (np.log(p_stem[1]) - np.log(p_stem[0])) / 2
        low = [np.maximum(x - d, 0) / m + r * self.pool * np.exp(sign * lean) for x, m, r, sign in zip(w, self.total[WORD], self.left[WORD], (-1, 1))]
        high = [np.maximum(x - d, 0) / np.maximum(m, 1.0) + r * q for x, m, r, q in zip(b, c, left, low)]
        x = np.where((c[0] >= 2) & (c[1] >= 2), np.log(high[1]) - np.log(high[0]), np.log(low[1]) - np.log(low[0]))
        return np.clip(x, -3.0, 6.0)

    def look(self, keys: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray]:
        """Places in the tables, counts, and what discounting leaves after the contexts."""
        at = {k: _find(self.tables[k].key, x) for k, x in keys.items()}
        return at, {k: self.tables[k].n[:, i] for k, i in at.items()}, self.tables[CONTEXT].left[:, at[CONTEXT]]

    def evidence(self, word: np.ndarray, stem: np.ndarray, own: int | None = None) -> np.ndarray:
        """For each word of a text the toxic less the ordinary log-likelihood, by what is broadcast.

        ``own`` is the class of a text that the counts hold: what it adds to them is taken off first.
        """
        keys = _keys(word, stem, _before(word))
        _, n, left = self.look(keys)
        return self.weigh(n, left, own, None if own is None or not len(word) else _own_counts(keys[BIGRAM], word, stem))

    def read(self, texts: list[str], own: np.ndarray) -> dict:
        """A group of texts: what is known of their evidence, and the words that wait for counts of the rest. ``own``: classes, -1 for none."""
        got = [tokens(t) for t in texts]
        size = np.array([len(w) for w, _ in got], np.int64)
        word, stem = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        starts = (np.cumsum(size) - size)[size > 0]
        before = _before(word, starts)
        keys = _keys(word, stem, before)
        doc = np.repeat(np.arange(len(texts)), size)
        whose, mine = own[doc], None
        if (whose >= 0).any():
            mine = {k: np.zeros(len(word), np.int64) for k in (BIGRAM, WORD, STEM)}
            for i, a in zip(np.flatnonzero(size), starts):
                if own[i] >= 0:
                    cut = slice(a, a + size[i])
                    for k, m in _own_counts(keys[BIGRAM][cut], word[cut], stem[cut]).items():
                        mine[k][cut] = m
        at, n, left = self.look(keys)
        x = self.weigh(n, left, whose, mine)
        again = (word == before) & (before > 0)  # a word said over and over tells no more than once
        again[starts] = False
        flags, waits = {}, np.zeros(len(word), bool)
        if self.rest is not None:
            known = at[CONTEXT] < len(self.tables[CONTEXT].key)
            for k in (CONTEXT, BIGRAM, WORD, STEM):
                open_ = np.flatnonzero((at[k] == len(self.tables[k].key)) & (known if k == BIGRAM else True))
                # What was counted once, in this very text, is nothing when its own counts are taken off.
                often = np.where((whose[open_] >= 0) & (k != CONTEXT), MORE, np.uint64(0))
                open_ = open_[self.rest.may_hold(keys[k][open_] ^ often)]
                flags[k] = np.zeros(len(word), bool)
                flags[k][open_] = True
                waits |= flags[k]
                if k == CONTEXT:
                    known[open_] = True
        x[waits] = 0
        strong = np.where(again, 0.0, np.maximum(x - STRONG, 0.0))
        strong[waits] = 0
        where, peaks = np.flatnonzero(waits), np.flatnonzero(strong)
        return {
            "size": size, "sum": np.bincount(doc, x, len(texts)), "peaks": peaks, "strong": strong[peaks],
            "waiting": _pack_words(where, word[where], stem[where], before[where]), "again": np.packbits(again[where]),
            "flags": {k: np.packbits(f[where]) for k, f in flags.items()},
            "own": whose[where].astype(np.int8), "mine": None if mine is None else {k: _planes(m[where]) for k, m in mine.items()},
        }

    @staticmethod
    def needs(state: dict) -> np.ndarray:
        """The distinct expressions of which a group needs the counts in the rest."""
        at, *words = _unpack_words(state["waiting"])
        keys = _keys(*words)
        wanted = [keys[k][np.unpackbits(f, count=len(at)).astype(bool)] for k, f in state["flags"].items()]
        return np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)

    def features(self, state: dict, found: Table) -> np.ndarray:
        """For each text of a group: mean evidence a word; of evidence beyond ``STRONG``, the sum in the strongest passage and the mean a passage."""
        size, total = state["size"], state["sum"]
        strong = np.zeros(int(size.sum()))
        strong[state["peaks"]] = state["strong"]
        where, *words = _unpack_words(state["waiting"])
        if len(where):
            keys = _keys(*words)
            _, n, left = self.look(keys)
            there = {k: _find(found.key, x) for k, x in keys.items()}
            n = {k: n[k] + found.n[:, i] for k, i in there.items()}  # an expression is either broadcast or in the rest
            left = np.where(there[CONTEXT] < len(found.key), found.left[:, there[CONTEXT]], left)
            x = self.weigh(n, left, state["own"], state["mine"] and {k: _numbers(m).astype(np.int64) for k, m in state["mine"].items()})
            total = total + np.bincount(np.repeat(np.arange(len(size)), size)[where], x, len(size))
            strong[where] = np.where(np.unpackbits(state["again"], count=len(where)), 0.0, np.maximum(x - STRONG, 0.0))
        out, ends = np.zeros((3, len(size))), np.cumsum(size)
        for i in np.flatnonzero(size):
            n = int(size[i])
            sums = np.concatenate([[0.0], np.cumsum(strong[ends[i] - n : ends[i]])])
            w = min(n, WINDOW)
            best = float((sums[w:] - sums[:-w]).max())
            out[:, i] = max(-1.0, min(total[i] / n, 1.0)), min(best, MOST_BEST), min(float(sums[-1]) / (n + WINDOW) * WINDOW, MOST_MEAN)
        return out


NO_ROWS = pa.table({"key": pa.array([], pa.int64()), **{c: pa.array([], pa.int64()) for c in COUNTS}, **{u: pa.array([], pa.float64()) for u in USED}})
NONE_FOUND = Table(np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 2, [np.zeros(0)] * 2)


def _groups(texts: list[str]):
    """Borders of groups of texts, by their bytes at five a word."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > 5 * GROUP_WORDS:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _with_features(rows: pa.RecordBatch, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, f)], [*rows.schema.names, *FEATURES])


FEATURES = ["f0", "f1", "f2"]


def _fit_curve(rows: DataFrame, steps: int = 40) -> np.ndarray | None:
    """Logistic regression of own on the features of all rows, by Newton steps whose sums Spark makes; slightly shrunk and with the rarer class
    weighted up. More evidence never lowers a score, so features whose weight would be negative are left out. None without both classes."""
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("own")).first()
    if not n or not 0 < toxic < n:
        return None
    weight = np.array([0.5 * n / (n - toxic), 0.5 * n / toxic]) ** BALANCE

    def sums(w: np.ndarray, used: list[int]) -> tuple[np.ndarray, np.ndarray]:
        d = len(w)

        def part(batches):
            out = np.zeros((d + 1, d))
            for b in batches:
                y = b["own"].to_numpy(int)
                z = np.column_stack([np.ones(len(b)), *[b[FEATURES[i]].to_numpy(float) for i in used]])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                out[0] += z.T @ (weight[y] * (p - y))
                out[1:] += (z * (weight[y] * p * (1 - p))[:, None]).T @ z
            yield pd.DataFrame({"i": np.arange(out.size), "v": out.ravel()})

        got = rows.mapInPandas(part, "i int, v double").toPandas().groupby("i")["v"].sum().sort_index().to_numpy().reshape(d + 1, d)
        return got[0], got[1:]

    used = list(range(len(FEATURES)))
    while True:
        w = np.zeros(len(used) + 1)
        for _ in range(steps):
            grad, hess = sums(w, used)
            step = np.linalg.solve(hess + 1e-2 * np.eye(len(w)), grad + 1e-2 * w)
            w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-9:
                break
        if len(used) == 0 or w[1:].min() >= 0:
            out = np.zeros(len(FEATURES) + 1)
            out[0] = w[0]
            out[[i + 1 for i in used]] = w[1:]
            return out
        used.pop(int(w[1:].argmin()))


class Toxicity:
    """Counts, models and curve; ``scores`` scores a table by the whole model. ``model`` is what is broadcast, ``rest`` the table of all other
    expressions (None: there are none)."""

    def __init__(self, model: Model | None, curve: np.ndarray, rest: DataFrame | None = None, buckets: int = 1):
        self.model, self.curve, self.rest, self.buckets = model, curve, rest, buckets
        self._sent = None

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, epsilon: float = 0.0, train_on: Column | None = None, hot: int = HOT) -> "Toxicity":
        """``hot`` and ``epsilon`` say which expressions are broadcast: the ``hot`` most frequent pairs and ``hot // 4`` of each other kind, if they
        make up at least ``epsilon`` of a class. All others are joined; scores are the same."""
        small_batches(docs.sparkSession)
        labelled = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        rows = labelled.count()
        chosen = ~held_out() if train_on is None else train_on
        train = join_small(docs.where(chosen).select("doc_id", text_or_empty().alias("text")), labelled, "doc_id", "inner", rows)
        # Tasks have merged their own rows, which are narrower than partial sums of two columns: deal them out as they are.
        counts = train.select("text", "toxic").mapInPandas(_count, "key long, coded long").repartition("key")
        sums = counts.groupBy("key").agg(*[F.sum(F.when(F.col("coded") % 2 == i, F.shiftright("coded", 1)).otherwise(0)).alias(c) for i, c in enumerate(COUNTS)])
        table = sums.select(F.when(F.col("key") < 0, STEM).otherwise(BIGRAM).alias("kind"), "key", *COUNTS).persist(StorageLevel.DISK_ONLY)
        out = cls._model(table, epsilon, hot)
        table.unpersist()
        del table, sums, counts
        _clean_up(docs.sparkSession)  # no one holds the counts' shuffles any more
        if out.model is None:
            return out
        out.curve = _fit_curve(stored(out.features(train.select(F.col("toxic").alias("own"), "text"), "text", "own"), "toxicity-curve"))
        return out if out.curve is not None else cls(None, np.zeros(4))

    @classmethod
    def _model(cls, table: DataFrame, epsilon: float, hot: int) -> "Toxicity":
        """All expressions with their counts: those to broadcast, and the rest as a stored table in buckets."""
        big = table.where(F.col("kind") == BIGRAM)
        lo, hi = F.col("key").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), F.shiftright("key", 32)
        none = [F.lit(0.0).alias(u) for u in USED]
        # Continuations: in how many different contexts a word stands.
        word = big.groupBy(lo.alias("lo")).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in COUNTS])
        word = word.select(F.lit(WORD).alias("kind"), F.col("lo").bitwiseOR(F.lit(int(ALONE))).alias("key"), *COUNTS, *none).persist(StorageLevel.DISK_ONLY)
        context = big.groupBy(hi.alias("hi")).agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).alias(u) for c, u in zip(COUNTS, USED)])
        context = context.select(F.lit(CONTEXT).alias("kind"), F.col("hi").bitwiseOR(F.lit(int((MARK | ALONE).astype(np.int64)))).alias("key"), *COUNTS, *USED).persist(StorageLevel.DISK_ONLY)
        # Only after contexts that both classes know do pairs count in the evidence; the others are never looked up.
        known = context.where((F.col("o") >= 2) & (F.col("t") >= 2))
        after = known.select(F.col("key").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).alias("hi"))
        pairs = join_small(big.withColumn("hi", hi), after, "hi", "left_semi", after.count(), limit=250_000).persist(StorageLevel.DISK_ONLY)
        every = table.where(F.col("kind") == STEM).unionByName(pairs.drop("hi")).select("kind", "key", *COUNTS, *none).unionByName(known).unionByName(word)
        both = F.col("o") + F.col("t")
        steps = every.groupBy("kind", F.least(both, F.lit(1 << 12)).alias("n")).agg(
            F.count(F.lit(1)).alias("types"), *[F.sum(c).alias(c) for c in COUNTS], *[F.sum((F.col(c) > 0).cast("long")).alias("n" + c) for c in COUNTS]
        ).toPandas()
        sums = steps.drop(columns="n").groupby("kind").sum()
        out = cls(None, np.zeros(4))
        if WORD in sums.index and sums.loc[WORD, "o"] and sums.loc[WORD, "t"]:
            keep, tables = F.lit(False), {k: Table.of(NO_ROWS) for k in (BIGRAM, WORD, STEM, CONTEXT)}
            for kind, of in steps.sort_values("n", ascending=False).groupby("kind"):
                fits = of["n"][of["types"].cumsum() <= (hot if kind == BIGRAM else hot // 4)]
                share = (F.col("o") >= float(epsilon * sums.loc[kind, "o"])) | (F.col("t") >= float(epsilon * sums.loc[kind, "t"]))
                of_kind = (F.col("kind") == int(kind)) & (F.least(both, F.lit(1 << 12)) >= int(fits.min() if len(fits) else 1 << 13)) & share
                keep = keep | of_kind
                tables[kind] = Table.of(every.where(of_kind).select("key", *COUNTS, *(USED if kind == CONTEXT else [])).toArrow())
            others, bits = int(sums["types"].sum()) - sum(len(t.key) for t in tables.values()), None
            if others:
                out.buckets = max(1, min(others // BUCKET_ROWS, MOST_BUCKETS))
                out.rest = stored(every.where(~keep).select("key", *COUNTS, *USED), "toxicity-rest", "zstd")
                bits = Filter.build(out.rest, FILTER_WORDS)
            totals = {(k, c): float(sums.loc[k, c]) for k in (STEM, WORD) for c in (*COUNTS, *["n" + c for c in COUNTS])}
            out.model = Model(tables, totals | {"types": float(sums.loc[WORD, "types"])}, bits)
        for df in (word, context, pairs):
            df.unpersist()
        return out

    def _broadcast(self, df: DataFrame):
        if self._sent is None:
            self._sent = df.sparkSession.sparkContext.broadcast(self.model)
        return self._sent

    def features(self, docs: DataFrame, text_col: str = "text", own_col: str | None = None) -> DataFrame:
        """``docs`` without the text and with each text's features; own_col: the classes of texts that the counts hold."""
        small_batches(docs.sparkSession)
        send, buckets, whole = self._broadcast(docs), self.buckets, self.rest is None
        names = [c for c in docs.columns if c != text_col]
        own = F.lit(-1) if own_col is None else F.coalesce(columns([own_col])[0].cast("int"), F.lit(-1))
        plain = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns(names))], text_or_empty(text_col).alias("text_"), own.alias("own_"))
        schema = StructType([*[StructField(f"c{i}", docs.schema[n].dataType) for i, n in enumerate(names)], *[StructField(f, DoubleType()) for f in FEATURES]])

        @tidying
        def read(batches):
            part = TaskContext.get().partitionId() << 32
            for b in batches:
                texts, classes = b.column("text_").to_pylist(), b.column("own_").to_numpy()
                kept = b.select(b.schema.names[:-2])
                for start, end in _groups(texts):
                    state = send.value.read(texts[start:end], classes[start:end])
                    rows = kept.slice(start, end - start)
                    if whole:
                        yield _with_features(rows, send.value.features(state, NONE_FOUND))
                        continue
                    blob = zlib.compress(pickle.dumps((pa.table({"rows": [rows.serialize().to_pybytes()], "schema": [rows.schema.serialize().to_pybytes()]}).to_pylist(), state)), 1)
                    ids, lots = _lots(Model.needs(state), buckets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([*ids.tolist(), part % buckets], pa.int32()), pa.array([part] * (len(ids) + 1)), pa.array([*[x.tobytes() for x in lots], None], pa.binary()), pa.array([None] * len(ids) + [blob], pa.binary())],
                        ["bucket", "part", "keys", "state"],
                    )
                    part += 1

        if whole:
            return plain.mapInArrow(read, schema).toDF(*names, *FEATURES)

        def meet(needs: pa.Table, rest: pa.Table) -> pa.Table:
            key = rest.column("key").to_numpy().view(np.uint64)
            order = np.argsort(key)
            key, values = key[order], [rest.column(c).to_numpy()[order] for c in (*COUNTS, *USED)]
            found = []
            for keys in needs.column("keys").to_pylist():
                at = _find(key, np.frombuffer(keys or b"", np.uint64))
                there = at < len(key)
                at, big = at[there], values[0].max(initial=0) >= 1 << 32 or values[1].max(initial=0) >= 1 << 32
                used = np.flatnonzero((values[2][at] > 0) | (values[3][at] > 0))
                hits = (np.packbits(there), len(there), [v[at] if big else _planes(v[at]) for v in values[:2]], used, [v[at][used] for v in values[2:]])
                found.append(zlib.compress(pickle.dumps(hits), 1) if len(at) else None)
            return pa.table({"part": needs.column("part"), "bucket": needs.column("bucket"), "found": pa.array(found, pa.binary()), "state": needs.column("state")})

        def finish(rows: pa.Table) -> pa.Table:
            (blob,) = [x for x in rows.column("state").to_pylist() if x is not None]
            (kept,), state = pickle.loads(zlib.decompress(blob))
            kept = pa.ipc.read_record_batch(kept["rows"], pa.ipc.read_schema(pa.py_buffer(kept["schema"])))
            lots, parts = dict(zip(*_lots(Model.needs(state), buckets))), []
            for bucket, x in zip(rows.column("bucket").to_pylist(), rows.column("found").to_pylist()):
                if x is not None:
                    there, n, counts, at, some = pickle.loads(zlib.decompress(x))
                    counts = [_numbers(c).astype(np.int64) if isinstance(c, bytes) else c for c in counts]
                    used = np.zeros((2, len(counts[0])))
                    used[:, at] = some
                    parts.append((lots[bucket][np.unpackbits(there, count=n).astype(bool)], *counts, *used))
            key, *values = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0)] * 2]
            table = Table(key, values[:2], values[2:])
            return pa.Table.from_batches([_with_features(kept, send.value.features(state, table))])

        rest = self.rest.withColumn("bucket", _bucket(F.col("key"), buckets))
        found = plain.mapInArrow(read, NEEDS).groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInArrow(meet, FOUND)
        return found.groupBy("part").applyInArrow(finish, schema).toDF(*names, *FEATURES)

    def scores(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` without the text and with scores from 0 to 1 by the whole model."""
        if self.model is None:
            return docs.drop(text_col).withColumn(name, F.lit(0.0))
        out = self.features(docs, text_col)
        z = sum((F.col(f) * float(w) for f, w in zip(FEATURES, self.curve[1:])), F.lit(float(self.curve[0])))
        return out.select(*columns(out.columns[:-3]), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias(name))

    def score(self, docs: DataFrame, text_col: str = "text") -> Column:
        """A column of scores from 0 to 1, where the whole model is broadcast."""
        if self.rest is not None:
            raise ValueError("part of the model is a table, which a column can't be joined with: use scores()")
        small_batches(docs.sparkSession)
        send = docs.sparkSession.sparkContext.broadcast((self.model, self.curve))

        @F.pandas_udf(DoubleType())
        def scored(texts: pd.Series) -> pd.Series:
            model, w = send.value
            if model is None or not len(texts):
                return pd.Series(np.zeros(len(texts)))
            z = w[0] + w[1:] @ model.features(model.read(list(texts), np.full(len(texts), -1)), NONE_FOUND)
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return scored(text_or_empty(text_col))
