"""Removal of repeated passages: blockwise suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Suffixes are never sorted all at
once:

* Cover sample. The places whose residue modulo v is in a perfect difference set are the sample (for 400 bytes 18
  residues of 307). Whatever two equal windows there are, within v bytes both meet the sample at the same distance.
* Blocks. Sample suffixes with the same first ``width`` bytes (``length`` - v + 1) form a block. Spark deals out their
  names in packed arrays and drops all that stand alone; a task merges its own names first, so a name that many
  documents share reaches its bucket once a task and not once a place. One bucket of names is looked at at a time.
* Ranks. The sample suffixes of a block are ranked by their text and by the text before them, read backwards.
* Suffix buckets. The suffixes that start a given distance before a block's sample places form a bucket. It is sorted
  by the bytes up to the sample, ties by the rank of the sample suffix, one bucket at a time. Neighbours with
  ``length`` bytes in common are repeats.

Sample places whose whole surroundings (every window they can stand for) are equal need no sorting. A block of more
than ``BLOCK`` different surroundings isn't brought together in one task: its windows are dealt out by name like the
sample.

Defined cases: null and empty texts and texts under ``length`` bytes lose nothing; of equal texts of at least that
length each loses all; null ids and repeated rows are documents like others; an empty table gives an empty result; extra
columns keep their names and values, and a new column that would clash with one is named by ``free_name``.

Passages of so many words, whatever their bytes, are found by the same sorting over texts in which each word stands as
``UNIT`` bytes of its hash. Words are what ASCII white space parts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import columns, cut, map_in_arrow, series_udf, set_aside, small_batches, stored, tidying

LENGTH = 400
BLOCK = 8000
FEW = 400_000
#: Bytes of a table of spans that is broadcast; a larger one is joined as Spark sees fit.
SENT = 32 << 20
#: Bytes that stand for a word where passages are measured in words.
UNIT = 8
#: Entries that a task merges before it deals them out, and bytes of text that it hashes at a time.
FLUSH, CHUNK = 200_000, 1 << 18
#: Rows of what is found out that a task brings together by text.
HELD = 200_000
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(9).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"n": 0}
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Columns that identify a text: a hash, a checksum and its length.
KEY = ["sd_unit", "sd_crc", "sd_len"]
KINDS = ", ".join(f"{k} long" for k in KEY)
#: What an entry is for the bucket of its name: open, a witness that its task holds the name twice, or decided already.
OPEN, WITNESS, DONE, ASKED = 0, 1, 2, 4


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, kept for the longest text so far."""
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _sums(raw: bytes) -> np.ndarray:
    """Running sums from which the hash of any stretch follows."""
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[np.frombuffer(raw, np.uint8)] * _powers(len(raw))[0], out=run[1:])
    return run


def _stretch(run: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    h = (run[stop] - run[start]) * _powers(len(run))[1][start]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


# --- the sample --------------------------------------------------------------------------------------------------


@lru_cache
def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(v, residues): a perfect difference set modulo the largest v = q * q + q + 1 (q prime) up to four fifths of ``length``.

    Residues are the powers of a root of a cubic over q that have no square term, which is how planes give such sets;
    each cubic is tried until every difference occurs.
    """
    v, residues = (3, [0, 1]) if length >= 4 else (1, [0])
    q = 2
    while q * q + q + 1 <= length * 0.8:
        if all(q % p for p in range(2, q)):
            v, residues = q * q + q + 1, _plane(q)
        q += 1
    return v, np.array(residues, np.int64)


def _plane(q: int) -> list[int]:
    v = q * q + q + 1
    for a, b, c in ((a, b, c) for a in range(q) for b in range(q) for c in range(1, q)):
        power, found = (1, 0, 0), []
        for i in range(v):
            if power[2] == 0:
                found.append(i)
            x, y, z = power
            power = (z * c) % q, (x + z * b) % q, (y + z * a) % q
        if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
            return found
    raise ValueError(f"no difference set for {q}")


def cover_width(length: int, unit: int = 1) -> int:
    """Bytes that two equal windows are sure to have in common from the sample place that both meet."""
    return length - (difference_cover(length // unit)[0] - 1) * unit


def sample_places(n: int, length: int, unit: int = 1) -> np.ndarray:
    """The sample places of a text of ``n`` bytes, ascending."""
    v, residues = difference_cover(length // unit)
    grid = ((np.arange(n // unit // v + 1)[:, None] * v + residues) * unit).ravel()
    return grid[grid <= n - cover_width(length, unit)] if n >= length else grid[:0]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word, in bytes."""
    edge = np.diff(np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]]).astype(np.int8))
    return np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]


def coded_words(raw: bytes) -> bytes:
    """``UNIT`` bytes a word: its hash."""
    start, stop = word_bounds(raw)
    return _stretch(_sums(raw), start, stop).tobytes()


def _symbols(text: str, unit: int) -> bytes:
    """What is sorted: the bytes of a text, or the codes of its words."""
    raw = text.encode("utf-8", "replace")
    return raw if unit == 1 else coded_words(raw)


def surroundings(n: int, place: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of text that holds every window a sample place can stand for."""
    return np.maximum(0, place - (length - width)), np.minimum(n, place + length)


# --- entries dealt out by name -----------------------------------------------------------------------------------


class _Entries:
    """Names with the text (its ``KEY``) and place they come from, as arrays."""

    def __init__(self, names: np.ndarray, text: np.ndarray, place: np.ndarray, flag: np.ndarray):
        self.names, self.text, self.place, self.flag = names, text, place, flag

    def __len__(self):
        return len(self.place)

    def take(self, at) -> "_Entries":
        return _Entries(self.names[at], self.text[at], self.place[at], self.flag[at])

    def mark(self, flag: int) -> "_Entries":
        return _Entries(self.names, self.text, self.place, (self.flag & ASKED) | np.uint8(flag))

    @staticmethod
    def join(parts: list["_Entries"]) -> "_Entries":
        return _Entries(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("names", "text", "place", "flag")])

    def packed(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.names, self.text[:, 0], (self.text[:, 1] << 32) | self.text[:, 2], self.place.astype(np.uint32), self.flag))

    @staticmethod
    def unpacked(blob: bytes, width: int) -> "_Entries":
        n, at, out = len(blob) // (8 * width + 21), 0, []
        for kind, count in ((np.uint64, n * width), (np.int64, n), (np.int64, n), (np.uint32, n), (np.uint8, n)):
            out.append(np.frombuffer(blob, kind, count, at))
            at += out[-1].nbytes
        text = np.column_stack([out[1], out[2] >> 32 & 0xFFFFFFFF, out[2] & 0xFFFFFFFF])
        return _Entries(out[0].reshape(n, width), text, out[3].astype(np.int64), out[4])

    def grouped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order by name, the first of each name in it, and how many it has."""
        order = np.argsort(self.names[:, 0]) if self.names.shape[1] == 1 else np.lexsort(self.names.T)
        names = self.names[order]
        first = np.nonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)]))[0] if len(names) else np.zeros(0, np.int64)
        return order, first, np.diff(np.append(first, len(names)))


def _dealt(make, parts: int, flush: int = FLUSH):
    """Packed entries of ``make`` (of a batch of texts) by bucket. Names that a task holds twice are decided here: their
    entries are dealt on by text, and one witness goes to the name's bucket."""

    def out(held: list[_Entries]):
        e = _Entries.join(held)
        order, first, count = e.grouped()
        many = count > 1
        rows = [(order[first[~many]], OPEN), (order[first[many]], WITNESS), (order[np.repeat(many, count)], DONE)]
        every = _Entries.join([e.take(at).mark(flag) for at, flag in rows])
        part = (np.where(every.flag & 3 == DONE, every.text[:, 0].astype(np.uint64), every.names[:, 0]) >> np.uint64(20)) % np.uint64(parts)
        # By bucket, then as they come from the texts: what stands side by side is alike and packs well.
        order = np.argsort(part << np.uint64(32) | np.concatenate([at for at, _ in rows]).astype(np.uint64))
        every, part = every.take(order), part[order]
        at = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
        ends = np.append(at[1:], len(part))
        for i in range(0, len(at), 256):
            yield pd.DataFrame({"part": part[at[i : i + 256]].astype(np.int64), "blob": [every.take(slice(x, y)).packed() for x, y in zip(at[i : i + 256], ends[i : i + 256])]})

    def run(batches):
        held, size = [], 0
        for b in batches:
            for e in make(b):
                if len(e):
                    held.append(e)
                    size += len(e)
                if size > flush:
                    yield from out(held)
                    held, size = [], 0
        if size:
            yield from out(held)

    return run


def _buckets(width: int, use, together=None):
    """Over packed entries sorted by bucket: ``use`` of the decided and of the open entries of each bucket, with what is
    known of the open ones: how many entries there are of their name, two if there is a witness. ``together`` is applied to
    some ``HELD`` rows at a time."""
    most = 20_000 if together is None else HELD

    def frame(out: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(out, ignore_index=True)
        return every if together is None else together(every)

    def bucket(blobs: list[bytes]):
        e = _Entries.join([_Entries.unpacked(b, width) for b in blobs])
        done = e.flag & 3 == DONE
        rest = e.take(~done)
        order, first, count = rest.grouped()
        rest = rest.take(order)
        seen = count + np.bincount(np.repeat(np.arange(len(count)), count), weights=rest.flag & 3 == WITNESS, minlength=len(count)).astype(np.int64) if len(count) else count
        return use(e.take(done), rest, first, np.repeat(seen, count))

    def run(batches):
        blobs, last, out, rows = [], None, [], 0
        for b in batches:
            for part, blob in zip(b["part"], b["blob"]):
                if part != last and blobs:
                    out.append(bucket(blobs))
                    rows, blobs = rows + len(out[-1]), []
                    if rows > most:
                        yield frame(out)
                        out, rows = [], 0
                last = part
                blobs.append(bytes(blob))
        if blobs:
            out.append(bucket(blobs))
        if out:
            yield frame(out)

    return run


def _by_name(texts: DataFrame, make, width: int, use, shape: str, together=None) -> DataFrame:
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.mapInPandas(tidying(_dealt(make, max(1024, 16 * parts))), "part long, blob binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(tidying(_buckets(width, use, together)), shape)


def _table(e: _Entries, **more) -> pd.DataFrame:
    return pd.DataFrame({**{k: e.text[:, i] for i, k in enumerate(KEY)}, "place": e.place, **more})


def _names(length: int, unit: int):
    """The sample places of a batch of texts, named by what stands there."""
    width = cover_width(length, unit)

    def chunk(raws: list[bytes], key: np.ndarray) -> _Entries:
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        grid = sample_places(int(n.max()), length, unit)
        count = np.searchsorted(grid, n - width, "right")
        whose = np.repeat(np.arange(len(raws)), count)
        place = grid[np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)]
        at = (np.cumsum(n) - n)[whose] + place
        return _Entries(_stretch(_sums(b"".join(raws)), at, at + width)[:, None], key[whose], place, np.zeros(len(place), np.uint8))

    def make(b: pd.DataFrame):
        key, raws, size, first = b[KEY].to_numpy(np.int64), [], 0, 0
        for i, text in enumerate(b["text"]):
            raws.append(_symbols(text, unit))
            size += len(raws[-1])
            if size > CHUNK:
                yield chunk(raws, key[first : i + 1])
                raws, size, first = [], 0, i + 1
        if raws:
            yield chunk(raws, key[first:])

    return make


def _repeated_names(done: _Entries, rest: _Entries, first: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
    """A row for each text of the bucket: its places with a repeated name, packed (``_places`` reads them)."""
    e = _Entries.join([done, rest.take((seen > 1) & (rest.flag & 3 == OPEN))])
    e = e.take(np.lexsort(e.text.T))
    first = np.nonzero(np.concatenate([[True], (e.text[1:] != e.text[:-1]).any(axis=1)]))[0] if len(e) else np.zeros(0, np.int64)
    at = [e.names[a:b, 0].tobytes() + e.place[a:b].astype(np.uint32).tobytes() for a, b in zip(first, np.append(first[1:], len(e)))]
    return _table(e.take(first), at=at).drop(columns="place")


def _places(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Names and places out of what ``_repeated_names`` packs."""
    parts = [(np.frombuffer(b, np.uint64, len(b) // 12), np.frombuffer(b, np.uint32, offset=len(b) // 12 * 8)) for b in blobs]
    return np.concatenate([n for n, _ in parts]), np.concatenate([p for _, p in parts]).astype(np.int64)


def _around(length: int, width: int, unit: int):
    """The sample places with a repeated name, named by their whole surroundings too."""

    def make(b: pd.DataFrame):
        for key, text, at in zip(b[KEY].to_numpy(np.int64), b["text"], b["at"]):
            raw, (anchor, place) = memoryview(_symbols(text, unit)), _places(at)
            start, stop = surroundings(len(raw), place, length, width)
            digest = [xxhash.xxh3_64_intdigest(raw[i:j], d) for i, j, d in zip(start.tolist(), stop.tolist(), (place - start + 1).tolist())]
            yield _Entries(np.column_stack([anchor, np.array(digest, np.uint64)]), np.tile(key, (len(place), 1)), place, np.zeros(len(place), np.uint8))

    return make


#: What a place turns out to be: one whose surroundings are repeated, one whose are not, one of each repeated kind.
SETTLED, SINGLE, MATE = 0, 1, 2


def _settled(length: int, width: int):
    """Places whose surroundings are repeated are given as stretches of text; stops may lie beyond a text's end."""

    def use(done: _Entries, rest: _Entries, first: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
        opened, twice = rest.flag & 3 == OPEN, seen > 1
        e = _Entries.join([done, rest.take(opened & twice)])
        parts = [_table(e, anchor=np.int64(0), stop=e.place + length, kind=np.int32(SETTLED)).assign(place=np.maximum(0, e.place - (length - width)))]
        for e, kind in ((rest.take(opened & ~twice), SINGLE), (rest.take(first[twice[first]]), MATE)):
            parts.append(_table(e, anchor=e.names[:, 0].astype(np.int64), stop=np.int64(0), kind=np.int32(kind)))
        return pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)

    return use


def _met(df: pd.DataFrame) -> pd.DataFrame:
    """Settled stretches of a text that meet as one; they are of one length but for those from a text's start."""
    runs = df[df["kind"] == SETTLED]
    runs = runs.iloc[np.lexsort([runs[c].to_numpy() for c in ("stop", *KEY)])]
    key, start, stop = runs[KEY].to_numpy(), runs["place"].to_numpy(), runs["stop"].to_numpy()
    first = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1) | (start[1:] > stop[:-1])]))[0] if len(runs) else np.zeros(0, np.int64)
    runs = runs.iloc[first].assign(stop=stop[np.append(first[1:], len(stop)) - 1] if len(first) else stop)
    return pd.concat([runs, df[df["kind"] != SETTLED]], ignore_index=True)


def _windows(length: int, width: int, unit: int):
    """Every window that places of large blocks stand for, named by 128 bits."""

    def make(b: pd.DataFrame):
        for key, text, wanted in zip(b[KEY].to_numpy(np.int64), b["text"], b["wanted"]):
            raw, own = _symbols(text, unit), {}
            for w in wanted:
                if w["block"]:
                    for i in range(w["place"] % unit + max(0, (w["place"] - (length - width)) // unit * unit), min(w["place"], len(raw) - length) + 1, unit):
                        own[i] = own.get(i, False) or w["single"]
            if own:
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in own), np.uint64).reshape(-1, 2)
                yield _Entries(names, np.tile(key, (len(own), 1)), np.fromiter(own, np.int64, len(own)), np.where(np.fromiter(own.values(), bool, len(own)), ASKED, 0).astype(np.uint8))

    return make


def _repeated_windows_of(length: int):
    def use(done: _Entries, rest: _Entries, first: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
        e = _Entries.join([done, rest.take((seen > 1) & (rest.flag & 3 == OPEN))])
        e = e.take(e.flag & ASKED > 0)
        return _table(e, stop=e.place + length).rename(columns={"place": "start"})

    return use


# --- suffixes of a block -----------------------------------------------------------------------------------------


def _contexts(length: int, width: int, unit: int, rows: int = 4000):
    """A row with its surroundings for each wanted place, some thousand at a time."""

    def run(batches):
        out = []
        frame = lambda: pd.DataFrame(out, columns=["anchor", "single", "before", "around", *KEY, "place"])
        for b in batches:
            for text, wanted, *key in b[["text", "wanted", *KEY]].itertuples(index=False):
                raw = _symbols(text, unit)
                for w in wanted:
                    i, j = max(0, w["place"] - (length - width)), w["place"] + length
                    out.append((w["anchor"], w["single"], w["place"] - i, raw[i:j], *key, w["place"]))
                    if len(out) >= rows:
                        yield frame()
                        out = []
        if out:
            yield frame()

    return run


def _common_prefix(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it; 0 for the first."""
    out = np.zeros(len(m), np.int64)
    if len(m) > 1:
        differ = m[1:] != m[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


def _ranked(rows: list[bytes], block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by block and text, and each one's common prefix with its predecessor (-1: another block)."""
    n = len(rows)
    m = np.zeros((n, width), np.uint8)
    size = np.fromiter(map(len, rows), np.int64, n)
    m[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    order = np.lexsort((size, np.ascontiguousarray(m).view(f"S{width}").ravel(), block))
    m, size, block = m[order], size[order], block[order]
    lcp = _common_prefix(m, size)
    lcp[np.concatenate([[True], block[1:] != block[:-1]])] = -1
    return order, lcp


def _best_neighbour(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row with another one of its block."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], -1))
    return out


def repeated_windows(block: np.ndarray, before: np.ndarray, around: list[bytes], length: int, width: int, asked: np.ndarray, unit: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each distance from the sample (a bucket of suffixes) the asked rows whose window there is repeated.

    Rows are different surroundings of sample places; rows of one ``block`` are compared with each other.
    """
    n, span = len(around), length - width
    right_order, right_lcp = _ranked([x[p:] for x, p in zip(around, before.tolist())], block, length)
    left_order, left_lcp = _ranked([x[:p][::-1] for x, p in zip(around, before.tolist())], block, max(span, 1))
    after = np.fromiter(map(len, around), np.int64, n) - before
    # No window is repeated that reaches farther than a row's best neighbours on either side.
    far, near = np.minimum(_best_neighbour(left_order, left_lcp), before), length - np.minimum(_best_neighbour(right_order, right_lcp), after)
    name_right, name_left = np.empty(n, np.int64), np.empty(n, np.int64)
    found = []
    for d in range(0, span + 1, unit):
        rows = np.nonzero((near <= d) & (d <= far))[0]
        if len(rows) < 2:
            continue
        name_right[right_order] = np.cumsum(right_lcp < length - d)
        name_left[left_order] = np.cumsum(left_lcp < d)
        bucket = name_left[rows] * (n + 1) + name_right[rows]
        order = np.argsort(bucket, kind="stable")
        s = bucket[order]
        same = np.zeros(len(s), bool)
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        hit = rows[order[same]]
        hit = hit[asked[hit]]
        if len(hit):
            found.append((np.full(len(hit), d, np.int32), hit.astype(np.int32)))
    return found


def _resolve(length: int, width: int, unit: int = 1, rows: int = 4000):
    """Over rows sorted by block: complete blocks are resolved some thousand rows at a time."""

    def spans(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < 2:
            return pd.DataFrame(columns=[*KEY, "start", "stop"])
        got = repeated_windows(part["anchor"].to_numpy(np.int64), part["before"].to_numpy(np.int64), [bytes(x) for x in part["around"]], length, width, part["single"].to_numpy(bool), unit)
        if not got:
            return pd.DataFrame(columns=[*KEY, "start", "stop"])
        d, row = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        order = np.lexsort((-d, row))
        d, row = d[order], row[order]
        start = part["place"].to_numpy(np.int64)[row] - d
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (d[1:] != d[:-1] - unit)]) if len(row) else np.zeros(0, bool)
        first = np.nonzero(new)[0]
        last = np.concatenate([first[1:] - 1, [len(row) - 1]]) if len(first) else first
        out = part[KEY].iloc[row[first]].reset_index(drop=True)
        out["start"], out["stop"] = start[first], start[last] + length
        return out

    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(held) < rows:
                continue
            a = held["anchor"].to_numpy()
            edge = np.nonzero(a[1:] != a[:-1])[0]
            if len(edge):
                yield spans(held.iloc[: edge[-1] + 1])
                held = held.iloc[edge[-1] + 1 :]
        if held is not None:
            yield spans(held)

    return run


def _few(df: DataFrame, limit: int = FEW) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def repeated_spans(docs: DataFrame, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK, unit: int = 1) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the key of its text (``KEY``), and the repeated spans (``KEY``, start, stop), which may overlap. Spans of equal texts stand there once.

    With ``unit`` the texts stand for the codes of their words, of so many bytes each; ``length`` is a multiple of it."""
    small_batches(docs.sparkSession)
    width = cover_width(length, unit)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns(dict(zip(KEY, [F.xxhash64(text), F.crc32(text.cast("binary")), F.octet_length(text).cast("long")])))
    # So many words have as many bytes and the spaces between them at least; the tasks leave out what is still too short.
    long = keyed.where(F.col("sd_len") >= (length if unit == 1 else length // unit * 2 - 1))
    copies = cut(long.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1"))
    marked = long.select(*KEY, text.alias("text"), F.col(id_col).alias("own_id")).join(_few(copies), KEY, "left")
    once = marked.where(F.col("n").isNull() | F.col("own_id").eqNullSafe(F.col("first_id"))).select("text", *KEY)
    symbols = F.octet_length("text") if unit == 1 else F.regexp_count("text", F.lit(WORD)) * unit
    symbols = F.when(F.col("n") > 1, symbols)  # for copies only: a test of the text alone would be made before the join, on all texts
    whole = marked.where(F.col("n").isNotNull() & F.col("own_id").eqNullSafe(F.col("first_id"))).select(*KEY, F.lit(0).cast("long").alias("start"), symbols.cast("long").alias("stop")).where(F.col("stop") >= length)
    names = stored(_by_name(once, _names(length, unit), 1, _repeated_names, f"{KINDS}, at binary"), "names")
    at = names.groupBy(*KEY).agg(F.collect_list("at").alias("at"))
    kinds = stored(_by_name(_of_texts(once, at), _around(length, width, unit), 2, _settled(length, width), f"{KINDS}, place long, anchor long, stop long, kind int", _met), "kinds")
    # Places with equal surroundings: all their windows are repeated.
    equal = kinds.where(F.col("kind") == SETTLED).select(*KEY, F.col("place").alias("start"), "stop")
    # Others share the sample's first bytes with different surroundings: sort their suffixes.
    members = kinds.where(F.col("kind") != SETTLED).withColumn("single", F.col("kind") == SINGLE)
    sizes = members.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("single").alias("singles")).where("kinds > 1 and singles").select("anchor", (F.col("kinds") > block).alias("block"))
    wanted = members.join(sizes, "anchor").groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "place", "single", "block")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    small = F.filter("wanted", lambda w: ~w["block"])
    contexts = _of_texts(once, wanted.withColumn("wanted", small).where(F.size("wanted") > 0)).mapInPandas(tidying(_contexts(length, width, unit)), f"anchor long, single boolean, before int, around binary, {KINDS}, place long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resolved = contexts.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInPandas(tidying(_resolve(length, width, unit)), f"{KINDS}, start long, stop long")
    spans = whole.unionByName(equal).unionByName(resolved)
    large = wanted.where(F.exists("wanted", lambda w: w["block"]))
    if large.limit(1).count():
        spans = spans.unionByName(_by_name(_of_texts(once, large), _windows(length, width, unit), 2, _repeated_windows_of(length), f"{KINDS}, start long, stop long"))
    if unit > 1:
        whole_units = [(F.ceil(F.col("start") / unit) * unit).cast("long").alias("start"), (F.floor(F.col("stop") / unit) * unit).cast("long").alias("stop")]
        spans = spans.select(*KEY, *whole_units).where(F.col("stop") - F.col("start") >= length)
    return keyed, spans


def _of_texts(once: DataFrame, by_text: DataFrame) -> DataFrame:
    """The texts that ``by_text`` names, with its columns; others are dropped before texts are shuffled."""
    keys = by_text.select(*KEY)
    n = keys.count()
    return (once.join(F.broadcast(keys), KEY, "left_semi") if n <= FEW else once).join(by_text, KEY)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _by_text(spans: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The maximal runs of each text's spans as an array ``name``, and whether the table is small enough to broadcast."""

    def merge(col: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in raw])] for raw in col])

    raw = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("raw"))
    runs = stored(raw.select(*KEY, series_udf(merge, "array<struct<start: long, stop: long>>")("raw").alias(name)), "spans")
    size = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(name)), F.lit(0))).first()
    return runs, size[0] * 64 + size[1] * 16 <= SENT


def _joined(keyed: DataFrame, spans: DataFrame, name: str, end: Column) -> DataFrame:
    """``keyed`` with the maximal runs of its texts, up to their end, as ``name``; empty where there are none."""
    runs, few = _by_text(spans, name)
    joined = keyed.join(F.broadcast(runs) if few else runs, KEY, "left")
    up_to = lambda n: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.least(s["stop"], n).alias("stop")))
    within = F.element_at(F.transform(F.array(end.cast("long")), up_to), 1)  # the end is worked out once a row, and for these rows only
    return joined.withColumn(name, F.when(F.col(name).isNull(), F.array().cast("array<struct<start: long, stop: long>>")).otherwise(within))


def with_spans(docs: DataFrame, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id", **names) -> DataFrame:
    """``docs`` plus sd_bytes and sd_spans, the maximal removed runs as an array of [start, stop) byte ranges."""
    docs, put_back = set_aside(docs, [*KEY, "sd_spans", "sd_bytes"])
    keyed, spans = repeated_spans(docs, length, text_col=text_col, id_col=id_col, **names)
    return put_back(_joined(keyed, spans, "sd_spans", F.col("sd_len")).withColumn("sd_bytes", F.col("sd_len")).drop(*KEY))


def with_passages(docs: DataFrame, words: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus sd_passages, the maximal runs, in words, of passages of at least so many words that stand anywhere
    else too, whatever their bytes and the white space between their words."""
    docs, put_back = set_aside(docs, [*KEY, "sd_passages"])
    keyed, spans = repeated_spans(docs, words * UNIT, text_col=text_col, id_col=id_col, unit=UNIT)
    in_words = spans.select(*KEY, *[(F.col(c) / UNIT).cast("long").alias(c) for c in ("start", "stop")])
    words_of = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD))
    return put_back(_joined(keyed, in_words, "sd_passages", words_of).drop(*KEY))


def span_total(col: str) -> Column:
    return F.aggregate(col, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def kept_bytes(text: str | None, spans) -> bytes:
    raw, out, at = (text or "").encode("utf-8", "replace"), [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, raw[at:]])


def with_kept_sha256(found: DataFrame, text_col: str = "text") -> DataFrame:
    """A table made by ``with_spans`` with the digest of the bytes that stay, kept_sha256, in place of the text."""
    kept = [c for c in found.columns if c != text_col]

    def run(batches):
        for b in batches:
            digests = [hashlib.sha256(kept_bytes(t.as_py(), s.as_py())).hexdigest() for t, s in zip(b.column(text_col), b.column("sd_spans"))]
            yield pa.RecordBatch.from_arrays([*b.select(kept).columns, pa.array(digests, pa.string())], [*kept, "kept_sha256"])

    schema = StructType([*found.select(*columns(kept)).schema.fields, StructField("kept_sha256", StringType())])
    return map_in_arrow(found, tidying(run), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id", words: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text; characters cut in part are dropped.

    With ``words``, repeated passages of at least so many words go too, whatever their bytes and the white space
    between their words.
    """
    small_batches(docs.sparkSession)
    names, (docs, put_back) = docs.columns, set_aside(docs, [*KEY, "sd_spans", "sd_bytes", "sd_passages"])
    none = F.array().cast("array<struct<start: long, stop: long>>")
    found = with_spans(docs.withColumn("sd_passages", none) if words is None else with_passages(docs, words, text_col, id_col), length, text_col, id_col)

    def clean_text(text: str, spans, passages) -> str:
        raw = text.encode("utf-8", "replace")
        out = [(s["start"], s["stop"]) for s in spans]
        if passages:
            start, stop = word_bounds(raw)
            out += [(int(start[w["start"]]), int(stop[w["stop"] - 1])) for w in passages]
        return kept_bytes(text, [{"start": a, "stop": b} for a, b in merged(out)]).decode("utf-8", "ignore")

    at, kept = docs.columns.index(text_col), docs.columns
    spans_of = columns(["sd_spans", "sd_passages"])

    def run(batches):
        for b in batches:
            spans, passages, texts = b.column("sd_spans"), b.column("sd_passages"), b.column(text_col)
            found = pc.or_(pc.greater(pc.list_value_length(spans), 0), pc.greater(pc.list_value_length(passages), 0))
            found = pc.and_(pc.fill_null(found, False), pc.is_valid(texts))
            rows = np.nonzero(found.to_numpy(zero_copy_only=False))[0].tolist()
            if rows:  # the others pass as they are
                clean = [clean_text(texts[i].as_py(), spans[i].as_py(), passages[i].as_py()) for i in rows]
                texts = pc.replace_with_mask(texts, found, pa.array(clean, texts.type))
            own = b.select(kept)
            yield own.set_column(at, own.schema.field(at), texts)

    as_text = found.withColumn(text_col, F.col(text_col).cast("string"))
    schema = as_text.select(*columns(kept)).schema
    return put_back(map_in_arrow(as_text.select(*columns(kept), *spans_of), tidying(run), schema)).select(*columns(names))
