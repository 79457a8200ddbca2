"""Runs of periodic words by probing a harmonic grid, and texts with each run's repeats taken out.

A run is a stretch of consecutive words with smallest period q whose length is at least ``least`` words and ``times``
periods, and that no neighbouring word extends with period q. For each period p the words at all jp and (j+1)p are
compared, over many texts at a time in one array of word numbers. A run spans at least four grid points, so a point only survives
if the next two pairs are equal too, and then the words behind it. Survivors are extended to both sides by comparing
chunks of the array with itself moved by p. Periods are tried in rising order: grid points inside a run whose period
divides p are skipped, as the stretch around them is that run; so are points inside a run just found. Hence each run is found
once, with its smallest period.

Texts of similar lengths share an array, with a number of its own between two of them, so no run crosses texts; a period
beyond the longest's share of ``times`` isn't tried. Nothing is shuffled.

Defined cases: a null or empty text has no words and no runs; words are ``[^\\x20\\x09-\\x0D]+`` and compared as UTF-8 bytes;
overlapping runs of different periods are all kept; a text of any length is one array; equal rows get equal results; an
empty table gives an empty result; columns of ``docs`` are carried through, also those named like new ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import columns, map_in_arrow, set_aside, small_batches, tidying

LEAST, TIMES = 6, 4
#: Words compared at once when a survivor is extended, and of short texts put in one array.
CHUNK = 4096
TOGETHER = 400_000
#: Bytes of text split at once.
TEXT_BYTES = 8_000_000
#: Pairs behind a grid point that are compared before it is extended.
AHEAD = 8

RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


class Found:
    """Runs by period, sorted by start; of one period none lies within another."""

    def __init__(self):
        self.starts: dict[int, np.ndarray] = {}
        self.stops: dict[int, np.ndarray] = {}

    def add(self, period: int, runs: list[tuple[int, int]]) -> None:
        runs.sort()
        self.starts[period] = np.array([a for a, _ in runs])
        self.stops[period] = np.array([b for _, b in runs])

    def inside(self, at: np.ndarray, period: int) -> np.ndarray:
        """Which points lie, with the word a period on, in a run whose period divides this one."""
        out = np.zeros(len(at), bool)
        for q, starts in self.starts.items():
            if period % q == 0:
                i = np.searchsorted(starts, at, "right") - 1
                out |= (i >= 0) & (at + period < self.stops[q][np.maximum(i, 0)])
        return out


def _ahead(w: np.ndarray, start: int, p: int, stop: int) -> int:
    """The first i >= start, at most stop, with w[i] != w[i + p]."""
    i = start
    while i < stop:
        j = min(i + CHUNK, stop)
        differ = w[i:j] != w[i + p : j + p]
        if differ.any():
            return i + int(differ.argmax())
        i = j
    return stop


def _behind(w: np.ndarray, start: int, p: int) -> int:
    """The last i <= start with w[i - 1] != w[i - 1 + p], or 0."""
    i = start
    while i > 0:
        j = max(i - CHUNK, 0)
        differ = w[j:i] != w[j + p : i + p]
        if differ.any():
            return i - int(differ[::-1].argmax())
        i = j
    return 0


def array_runs(w: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs of an array of word numbers as (start, length, period); no run is longer than ``longest``."""
    n, found, out = len(w), Found(), []
    for p in range(1, longest // times + 1):
        grid = w[::p]
        equal = grid[1:] == grid[:-1]
        if len(equal) < times - 1:
            break
        for _ in range(times - 2):  # the next pairs from a run's first grid point are equal too
            equal = equal[1:] & equal[:-1]
            if not equal.any():
                break
        at = np.nonzero(equal)[0] * p
        if not len(at):
            continue
        at = at[at + p + min(AHEAD, (times - 2) * p) < n]
        for k in range(1, min(AHEAD, (times - 2) * p) + 1):
            at = at[w[at + k] == w[at + p + k]]
            if not len(at):
                break
        if len(at):
            at = at[~found.inside(at, p)]
        runs, done = [], -1
        for c in at.tolist():
            if c < done:
                continue
            a, b = _behind(w, c, p), _ahead(w, c, p, n - p)
            done = b  # up to here all pairs are equal: grid points before it are within this stretch
            if b + p - a >= max(least, times * p):
                runs.append((a, b + p))
        if runs:
            found.add(p, runs)
            out += [(a, b - a, p) for a, b in runs]
    return out


def text_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs of each text's word numbers, by start, then period. Texts of similar lengths are searched together."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i in range(len(texts)) if len(texts[i]) >= max(least, times)), key=lambda i: len(texts[i]))
    first = 0
    while first < len(order):
        stop, size, short = first, 0, len(texts[order[first]])
        while stop < len(order) and (stop == first or (size + len(texts[order[stop]]) <= TOGETHER and len(texts[order[stop]]) <= 2 * short)):
            size += len(texts[order[stop]])
            stop += 1
        part = order[first:stop]
        pieces, begins, at = [], [], 0
        for k, i in enumerate(part):
            pieces += [texts[i], np.array([-1 - k], np.int64)]
            begins.append(at)
            at += len(texts[i]) + 1
        w = np.concatenate(pieces)
        for start, length, period in array_runs(w, len(texts[part[-1]]), least, times):
            k = int(np.searchsorted(begins, start, "right")) - 1
            out[part[k]].append((start - begins[k], length, period))
        first = stop
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def _numbered(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Some rows at a time, by bytes of text: the first row, and what ``_words`` gives for them."""
    size, first, held = pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist(), 0, 0
    for i in range(len(size) + 1):
        if i == len(size) or (held and held + size[i] > most):
            if i > first:
                yield first, *_words(texts.slice(first, i - first))
            first, held = i, 0
        held += size[i] if i < len(size) else 0


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The kinds of words of some texts, all their words as numbers of kinds, and where each text's begin."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    where = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    keep = full.to_numpy(zero_copy_only=False)
    coded = words.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(where[keep], np.arange(len(texts) + 1))


def collapsed(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES, order: Callable | None = None, order_col: str | None = None) -> DataFrame:
    """``docs`` plus pr_words (their number), pr_runs (array of start, length, period by start, then period) and pr_text,
    the words outside repeats joined by a space; equals the words joined by a space where there are no runs.

    ``order`` (words, value of ``order_col``) may give places of words that make a text anew before it is searched (None:
    as it is).
    """
    small_batches(docs.sparkSession)
    docs, put_back = set_aside(docs, ["pr_words", "pr_runs", "pr_text", "pr_source", "pr_order"])
    kept = docs.columns
    source = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fed = docs.select(*columns(kept), source.alias("pr_source"), *([F.col(order_col).alias("pr_order")] if order else []))
    fields = StructType([*docs.schema.fields, StructField("pr_words", LongType()), StructField("pr_runs", RUNS), StructField("pr_text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        for b in batches:
            texts = b.column("pr_source")
            values = b.column("pr_order").to_pylist() if order else None
            for first, kinds, numbers, begin in _numbered(texts, TEXT_BYTES):
                rows = len(begin) - 1
                arrays = [numbers[begin[i] : begin[i + 1]] for i in range(rows)]
                if order:
                    for i in range(rows):
                        places = order(len(arrays[i]), values[first + i])
                        arrays[i] = arrays[i] if places is None else arrays[i][places]
                runs = text_runs(arrays, least, times)
                kept_words = [w[~dropped(len(w), r)] if r else w for w, r in zip(arrays, runs)]
                border = np.concatenate([[0], np.cumsum([len(w) for w in kept_words])]).astype(np.int64)
                words = kinds.take(pa.array(np.concatenate(kept_words) if kept_words else np.zeros(0, np.int64)))
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(border), words), pa.scalar(" ", words.type))
                found = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for r in runs], schema.field("pr_runs").type)
                own = b.slice(first, rows).select(kept)
                made = [*own.columns, pa.array([len(a) for a in arrays], pa.int64()), found, joined]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(made, schema.types)], schema=schema)

    return put_back(map_in_arrow(fed, tidying(run), fields))
