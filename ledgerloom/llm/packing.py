"""Hierarchical packing of token ids into sequences of several lengths.

A document's ids (and an end mark) are cut into whole windows; what is left over is its tail. Windows are sequences by
themselves. Tails are routed to context-size tiers, the smallest power of two that holds them. Within a bounded group
of tails the tiers are packed from the longest down: the longest tail opens a sequence of its tier's size, its gap is
filled with the longest tails that fit, which come from shorter tiers, and the last of the gap with the beginning of
the longest tail left, whose rest is routed again. The last sequence of a group can't be filled: it is cut
into powers of two. Every sequence thus has a power of two of ids and none is padded. At the end the group's sequences are
dealt to step groups of about ``step`` ids, the costliest for attention first, each to the group with the least cost.

Tails are dealt to groups by a hash of their row's place, so no source, length or repeated text fills one; each task
holds some million ids at a time.

Defined cases: a null or empty text is the end mark alone; null ids and repeated rows are rows like others; a text of
any length is cut into as many windows as it needs; an empty table gives an empty result; the table's columns other
than the text are carried to each piece, columns named like new ones keep their names and the new ones get another.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import columns, map_in_arrow, set_aside, small_batches, tidying

WINDOW = 4096
#: Sizes of sequences that tails are routed to; shorter ones come only from the end of a group.
TIERS = (4096, 2048, 1024, 512)
END_MARK = 2
#: Ids that one group of tails holds.
GROUP_IDS = 4_000_000
#: Ids of one step group.
STEP = 65_536
#: Bytes of text that are encoded at once, words (and their letters) whose ids a task remembers, and new words given to the
#: library in one text.
TEXT_BYTES = 8_000_000
WORDS, LETTERS_HELD = 500_000, 30_000_000
TOGETHER = 100
#: A mark after a Latin letter that neither case nor composition turns into anything else.
BREAK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}])([.,;:!?])"
#: Fixed value: how a tokenizer's pattern says that a run of letters is a word.
LETTERS = "|[\\\\p{L}]+|"

NEW = ["pk_start", "pk_length", "pk_tokens", "pk_tier", "pk_sequence", "pk_offset", "pk_step", "pk_ids"]
INNER = ["pk_bucket", "pk_row"]

_LOADED: dict = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, without padding and truncation; one a worker process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].no_padding()
        _LOADED[path].no_truncation()
    return _LOADED[path]


class WordIds:
    """Ids of many texts at once for tokenizers whose words never hold white space: each distinct word is encoded once and
    remembered, up to ``WORDS`` of them. The library is given many new words in one text, with a special token between them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
        self.tokenizer = tokenizer(path)
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.border = next(iter(special.items()), (None, None))
        spec = json.loads(self.tokenizer.to_str())
        self.plain = '"Lowercase"' in json.dumps(spec["normalizer"]) and LETTERS in json.dumps(spec["pre_tokenizer"])
        self.forget()

    def forget(self) -> None:
        self.held = 0  # letters of the words remembered
        self.place: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        if self.border is None:
            made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate(made), np.fromiter(map(len, made), np.int64, len(made))
        texts = [f" {self.border} ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        flat = np.concatenate([np.array([*e.ids, self.mark], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        at = np.nonzero(flat == self.mark)[0]
        return flat[flat != self.mark], np.diff(np.concatenate([[-1], at])) - 1

    def _known(self, words: list[str]) -> np.ndarray:
        """Places of the words, new ones put behind the others."""
        if len(self.place) > WORDS or self.held > LETTERS_HELD:
            self.forget()
        place = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.nonzero(place < 0)[0]
        if len(new):
            plain = [i for i in new.tolist() if self.border is None or self.border not in words[i]]
            parts = [plain, sorted(set(new.tolist()) - set(plain))] if len(plain) < len(new) else [plain]
            for part, several in zip(parts, (True, False)):
                if not part:
                    continue
                if several:
                    ids, sizes = self._encode([words[i] for i in part])
                else:  # words that hold the border themselves
                    made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)]
                    ids, sizes = np.concatenate(made), np.fromiter(map(len, made), np.int64, len(made))
                place[part] = np.arange(len(self.place), len(self.place) + len(part))
                self.place.update(zip([words[i] for i in part], place[part].tolist()))
                self.held += sum(len(words[i]) for i in part)
                self.ids.append(ids)
                self.sizes.append(sizes)
        return place

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has.

        Words are split at a mark after a letter, where a tokenizer in lower case with runs of letters as words splits them
        anyway, and its words are told apart without ASCII case: fewer words are new."""
        if self.plain:
            texts = pc.replace_substring_regex(texts, BREAK, r"\1 \2")
            if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else letters in a special token's string would change it
                texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        place = self._known(coded.dictionary.to_pylist())
        self.ids, self.sizes = [np.concatenate([np.zeros(0, np.uint32), *self.ids])], [np.concatenate([np.zeros(0, np.int64), *self.sizes])]
        flat, size = self.ids[0], self.sizes[0]
        begin, index = np.cumsum(size) - size, place[coded.indices.to_numpy(zero_copy_only=False)]
        many = size[index]
        ends = np.cumsum(many)
        out = flat[np.repeat(begin[index] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
        border = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        upto = np.concatenate([[0], ends])[border]
        return out, np.diff(upto)


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text."""
    size, first, held = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def _encoded(path: str, text_col: str, kept: list[str], schema: pa.Schema, keys: np.ndarray, window: int, end_mark: int):
    """Windows and tails of each document, with the bucket that its row is dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = WordIds(path), (TaskContext.get().partitionId() << 33)
        kind = np.dtype("<u2") if max(encode.tokenizer.get_vocab_size(), end_mark + 1) <= 65536 else np.dtype("<u4")
        for b in batches:
            texts = pc.fill_null(b.column(text_col), "")
            texts = texts.cast(pa.large_string())
            for first, stop in _parts(texts, TEXT_BYTES):
                ids, count = encode(texts.slice(first, stop - first))
                begin = np.cumsum(count) - count
                tokens = count + 1
                pieces = -(-tokens // window)
                whose = np.repeat(np.arange(len(count)), pieces)
                start = (np.arange(len(whose)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, tokens[whose] - start)
                small = ids.astype(kind)
                data = []
                for i, s, n in zip(whose.tolist(), start.tolist(), length.tolist()):
                    a = begin[i] + s
                    data.append(small[a : min(a + n, begin[i] + count[i])].tobytes() + (kind.type(end_mark).tobytes() if s + n == tokens[i] else b""))
                rows = row + np.arange(len(count))
                row += len(count)
                bucket = keys[(_mixed(rows) % np.uint64(len(keys))).astype(np.int64)]
                own = b.slice(first, stop - first).select(kept).take(pa.array(whose))
                new = [pa.array(start), pa.array(length), pa.array(tokens[whose]), pa.array(bucket[whose]), pa.array(rows[whose]), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*own.columns, *new], schema.types)], schema=schema)

    return run


def even_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """Numbers of which Spark's hash sends one to each of so many partitions: their groups are spread evenly."""
    part = F.pmod(F.hash("id"), F.lit(parts))
    return np.array([r["key"] for r in spark.range(32 * parts + 64).groupBy(part.alias("part")).agg(F.min("id").alias("key")).orderBy("part").collect()], np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers of row numbers."""
    with np.errstate(over="ignore"):
        z = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(31))


class Tails:
    """Tails by length: the longest one that is not longer than so much is found by the bits of one number."""

    def __init__(self, lengths: list[int]):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.bits = 0
        for i, n in enumerate(lengths):
            self.put(i, 0, n)

    def put(self, i: int, begin: int, length: int) -> None:
        self.by_length.setdefault(length, []).append((i, begin))
        self.bits |= 1 << length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest tail of at most so many ids, as (tail, begin, length)."""
        length = (self.bits & ((2 << most) - 1)).bit_length() - 1
        if length < 1:
            return None
        held = self.by_length[length]
        i, begin = held.pop()
        if not held:
            self.bits ^= 1 << length
        return i, begin, length


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (size, pieces), a piece being (tail, begin within it, length); each size is a power of two and full."""
    pool, out = Tails(lengths), []
    largest, sizes = max(tiers), sorted(tiers)
    while (first := pool.take(largest)) is not None:
        size = next(s for s in sizes if s >= first[2])
        pieces, gap = [first], size - first[2]
        while gap:
            fits = pool.take(gap)
            if fits is None:
                longer = pool.take(largest)
                if longer is None:
                    break
                i, begin, n = longer
                fits = (i, begin, gap)
                pool.put(i, begin + gap, n - gap)
            pieces.append(fits)
            gap -= fits[2]
        out += [(size, pieces)] if not gap else powers(pieces)
    return out


def powers(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces in their order, cut into sequences whose sizes are falling powers of two."""
    left, out, todo = sum(n for _, _, n in pieces), [], list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        need, held = size, []
        while need:
            i, begin, n = todo.pop()
            use = min(n, need)
            held.append((i, begin, use))
            if use < n:
                todo.append((i, begin + use, n - use))
            need -= use
        out.append((size, held))
        left -= size
    return out


def steps(costs: list[float], groups: int) -> list[int]:
    """A group for each sequence: the costliest first, each to the group with the least cost so far."""
    heap, out = [(0.0, g) for g in range(groups)], [0] * len(costs)
    for k in sorted(range(len(costs)), key=lambda k: -costs[k]):
        cost, g = heap[0]
        out[k] = g
        heapq.heapreplace(heap, (cost + costs[k], g))
    return out


def _packed(kept: list[str], schema: pa.Schema, window: int, tiers: tuple[int, ...], step: int, most: int, wide: bool):
    """Over rows sorted by bucket and row: groups of some million ids are packed, one after the other."""
    kind = np.dtype("<u4") if wide else np.dtype("<u2")

    def group(rows: pa.Table, bucket: int, sequence: int, stepped: int) -> tuple[pa.RecordBatch, int, int]:
        length = rows["pk_length"].to_numpy()
        tails = np.nonzero(length < window)[0]
        packed = [(window, [(i, 0, window)]) for i in np.nonzero(length == window)[0].tolist()]
        for size, pieces in pack(length[tails].tolist(), tiers):
            packed.append((size, [(int(tails[i]), begin, n) for i, begin, n in pieces]))
        groups = max(1, round(sum(size for size, _ in packed) / step))
        of = steps([sum(n * n for _, _, n in pieces) + size for size, pieces in packed], groups)
        flat = [(i, begin, n, size, sequence + k, of[k]) for k, (size, pieces) in enumerate(packed) for i, begin, n in pieces]
        whose, begin, n, size, seq, at_step = (np.array(x, np.int64) for x in zip(*flat))
        ends = np.cumsum(n)
        first = np.concatenate([[True], seq[1:] != seq[:-1]])
        offset = ends - n - np.maximum.accumulate(np.where(first, ends - n, 0))
        ids = rows["pk_ids"].to_pylist()
        data = [np.frombuffer(ids[i], kind)[b : b + m].astype("<u4").tobytes() for i, b, m in zip(whose.tolist(), begin.tolist(), n.tolist())]
        own = rows.take(pa.array(whose)).combine_chunks()
        base = bucket << 32
        new = {
            "pk_start": own["pk_start"].to_numpy() + begin, "pk_length": n, "pk_tokens": own["pk_tokens"].to_numpy(), "pk_tier": size,
            "pk_sequence": base + seq, "pk_offset": offset, "pk_step": base + stepped + at_step,
        }
        made = [*(own[c] for c in kept), *(pa.array(v) for v in new.values()), pa.array(data, pa.binary())]
        batch = pa.RecordBatch.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(t) for c, t in zip(made, schema.types)], schema=schema)
        return batch, sequence + len(packed), stepped + groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, bucket, sequence, stepped = [], 0, None, 0, 0
        for b in batches:
            of = b.column("pk_bucket").to_numpy()
            edges = [0, *(np.nonzero(of[1:] != of[:-1])[0] + 1).tolist(), len(of)]
            for first, stop in zip(edges, edges[1:]):
                if first == stop:
                    continue
                if held and (of[first] != bucket or ids >= most):
                    made, sequence, stepped = group(pa.Table.from_batches(held), bucket, sequence, stepped)
                    yield made
                    held, ids = [], 0
                if of[first] != bucket:
                    bucket, sequence, stepped = int(of[first]), 0, 0
                held.append(b.slice(first, stop - first))
                ids += int(pc.sum(held[-1].column("pk_length")).as_py())
        if held:
            yield group(pa.Table.from_batches(held), bucket, sequence, stepped)[0]

    return run


def pack_documents(
    docs: DataFrame, path: str, text_col: str = "text", window: int = WINDOW, tiers: tuple[int, ...] = TIERS, end_mark: int = END_MARK, step: int = STEP, group_ids: int = GROUP_IDS, buckets: int | None = None,
) -> DataFrame:
    """One row a piece: the columns of ``docs`` but the text, and pk_start, pk_length, pk_tokens (of the document, with
    its end mark), pk_tier (the sequence's size), pk_sequence, pk_offset, pk_step and pk_ids (little-endian 32 bits).

    ``tiers`` are powers of two, the largest of them ``window``. The tokenizer of ``path`` must not join words over white
    space. Buckets follow the session's shuffle partitions if not given.
    """
    if max(tiers) != window or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two, the largest of them the window")
    small_batches(docs.sparkSession)
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = even_keys(docs.sparkSession, buckets)
    docs, put_back = set_aside(docs, [*NEW, *INNER])
    kept = [c for c in docs.columns if c != text_col]
    docs = docs.select(*columns(kept), F.col(text_col).cast("string").alias(text_col))
    fields = [docs.schema[c] for c in kept]
    long = lambda *names: [StructField(n, LongType()) for n in names]
    first = StructType([*fields, *long("pk_start", "pk_length", "pk_tokens", "pk_bucket", "pk_row"), StructField("pk_ids", BinaryType())])
    last = StructType([*fields, *long("pk_start", "pk_length", "pk_tokens"), StructField("pk_tier", IntegerType()), *long("pk_sequence", "pk_offset", "pk_step"), StructField("pk_ids", BinaryType())])
    wide = max(tokenizer(path).get_vocab_size(), end_mark + 1) > 65536
    pieces = map_in_arrow(docs, tidying(_encoded(path, text_col, kept, _arrow(first), keys, window, end_mark)), first)
    dealt = pieces.repartition(buckets, "pk_bucket").sortWithinPartitions("pk_bucket", "pk_row", "pk_start")
    return put_back(map_in_arrow(dealt, tidying(_packed(kept, _arrow(last), window, tuple(tiers), step, group_ids, wide)), last))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
