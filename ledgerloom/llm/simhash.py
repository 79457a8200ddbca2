"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints of equal documents are merged first. Two fingerprints within the radius agree on one of radius + 1
bands of bits, so each is dealt to the buckets of its bands; where a bucket holds too many, its members are dealt
on by the bands of their other bits, level by level. Within a bucket 64 fingerprints share a machine word: plane p
holds their p-th bits, a query is compared with all of them by XOR, carry-save counters add up the differing bits,
and words whose 64 members all exceed the radius are dropped before the next planes are read.

A bucket of more than 48 members reports a spanning forest of its links, one row a member at most; smaller ones stand
side by side in the planes and report their links as they are. Links are joined to components by alternating star
contraction, checkpointed in the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like others; null ids take part but are
never the smallest of a component unless all ids are null; repeated rows keep their own output rows; an empty
table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, cut, free_name, series_udf, small_batches, tidying

RADIUS = 3
SEED = 42
SHINGLE = 3
BITS = 64
#: A bucket above this many members is dealt on by other bits.
BUCKET = 4096
#: At the last level buckets are cut into blocks of this size, and all pairs of blocks are compared.
BLOCK = 16384
#: Similar texts: words to a shingle, least similarity, blocks a text is dealt to and hashes to a block's key, and the
#: radius within which fingerprints of a block are candidates of the first pass.
WIDE, SIMILARITY, BANDS, ROWS, LOOSE = 5, 0.8, 14, 3, 16
_RNG = np.random.default_rng(6)
_XOR = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MULTIPLY = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_FURTHER = tuple(np.random.default_rng(7).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.array([[0], [1]], np.uint64))
#: Bits of an odd sketch, and members of a block of similar texts that one task holds.
SKETCH, HELD = 1024, 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        h = np.array([digest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64, n - width + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text") -> Column:
    """The fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))

    return series_udf(run, "long")(F.col(text_col).cast("string"))


# --- bit-sliced comparison -------------------------------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) array: word w of plane p holds bit p of fingerprints 64 w to 64 w + 63."""
    n = len(fps)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    full = np.zeros((-(-n // 64) * 64, BITS), np.uint8)
    full[:n] = bits
    return np.ascontiguousarray(np.packbits(full.T, axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, query: int, n: int, radius: int = RADIUS) -> np.ndarray:
    """Indexes of the fingerprints at most ``radius`` bits from ``query``."""
    flips = np.array([~np.uint64(0) if query >> (BITS - 1 - p) & 1 else np.uint64(0) for p in range(BITS)], np.uint64)
    words = np.arange(planes.shape[1])
    found = _counted(lambda p, at: planes[p, at] ^ flips[p], words, np.zeros(len(words), np.uint64), radius)
    return found[found < n]


def _counted(differing, words: np.ndarray, over: np.ndarray, radius: int, step: int = 16) -> np.ndarray:
    """Lanes (64 to a word) with at most ``radius`` differing bits. ``differing`` gives a plane's differing bits of some
    words; carry-save counters add the planes up, and words whose lanes are all over the radius are left out of the next."""
    size = (radius + 1).bit_length()
    counters = [np.zeros(len(words), np.uint64) for _ in range(size)]
    for first in range(0, BITS, step):
        for p in range(first, first + step):
            carry = differing(p, words)
            for i in range(size):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over = over | carry
        over = over | _exceeds(counters, radius)
        alive = over != ~np.uint64(0)
        if not alive.any():
            return np.zeros(0, np.int64)
        if not alive.all():
            words, over, counters = words[alive], over[alive], [c[alive] for c in counters]
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, lane = np.nonzero(lanes)
    return words[w] * 64 + lane


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius, by comparing bit by bit from the top."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def _small_links(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small buckets at once: rows i and i + s of the same bucket, for each shift s below 64.

    The planes of all rows are stored once; a shift moves every plane by s lanes, and lanes that would cross into another
    bucket are over the radius from the start.
    """
    n, left, right = len(fps), [], []
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = np.hstack([bit_planes(fps), np.zeros((BITS, 1), np.uint64)])
    for shift in range(1, min(n, BITS)):
        lanes = np.zeros((planes.shape[1] - 1) * 64, np.uint8)
        lanes[: n - shift] = bucket[shift:] == bucket[:-shift]
        if not lanes.any():
            break
        pairs = np.packbits(lanes, bitorder="little").view(np.uint64)
        words, down, up = np.nonzero(pairs)[0], np.uint64(shift), np.uint64(64 - shift)
        near = _counted(lambda p, at: planes[p, at] ^ (planes[p, at] >> down | planes[p, at + 1] << up), words, ~pairs[words], radius)
        left.append(near)
        right.append(near + shift)
    z = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (z, z)


def _planes_within(diff: np.ndarray, radius: int) -> np.ndarray:
    """Indexes of the differences with at most ``radius`` bits: their bit planes against a query of zero."""
    return within(bit_planes(diff), 0, len(diff), radius) if len(diff) else np.zeros(0, np.int64)


class _Forest:
    """Components of a bucket's rows by smallest index."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, rows: np.ndarray):
        roots = np.unique(self.of[rows])
        if len(roots) > 1:
            self.of[np.isin(self.of, roots)] = roots[0]


def bucket_edges(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) for members of one bucket linked to others; fps distinct."""
    planes, forest = bit_planes(fps), _Forest(len(fps))
    for i in range(len(fps)):
        near = within(planes, int(fps[i]), len(fps), radius)
        if len(near) > 1:
            forest.join(near)
    moved = np.nonzero(forest.of != np.arange(len(fps)))[0]
    return fps[moved], fps[forest.of[moved]]


def _edges_of_batches(radius: int, small: int = 48):  # below 64, the lanes of a word
    """Over rows sorted by bucket: complete buckets are compared, the last one waits for the next batch."""

    def compare(key: np.ndarray, fps: np.ndarray):
        cuts = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1
        starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(fps)]]))
        few = np.repeat((sizes <= small) & (sizes > 1), sizes)
        number = np.repeat(np.arange(len(sizes)), sizes)
        a, b = _small_links(fps[few], number[few], radius)
        yield fps[few][a], fps[few][b]
        for s, n in zip(starts[sizes > small], sizes[sizes > small]):
            yield bucket_edges(fps[s : s + n], radius)

    def run(batches):
        kept_key, kept = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for b in batches:
            key = np.concatenate([kept_key, b[["level", "key"]].to_numpy(np.int64)])
            fps = np.concatenate([kept, b["fp"].to_numpy(np.int64).astype(np.uint64)])
            if not len(fps):
                continue
            tail = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0]
            cut_at = int(tail[-1]) + 1 if len(tail) else 0
            for x, y in compare(key[:cut_at], fps[:cut_at]) if cut_at else ():
                yield pd.DataFrame({"a": x.astype(np.int64), "b": y.astype(np.int64)})
            kept_key, kept = key[cut_at:], fps[cut_at:]
        if len(kept) > 1:
            for x, y in compare(kept_key, kept):
                yield pd.DataFrame({"a": x.astype(np.int64), "b": y.astype(np.int64)})

    return run


def _cross_block(radius: int):
    """Two blocks of one bucket against each other: a member of the second links to its first near one's group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.loc[pdf["side"] == 0, "fp"].to_numpy(np.int64).astype(np.uint64)
        two = pdf.loc[pdf["side"] == 1, "fp"].to_numpy(np.int64).astype(np.uint64)
        planes, forest, left, right = bit_planes(one), _Forest(len(one)), [], []
        for q in two:
            near = within(planes, int(q), len(one), radius)
            if len(near):
                forest.join(near)
                left.append(q)
                right.append(one[near[0]])
        moved = np.nonzero(forest.of != np.arange(len(one)))[0]
        a = np.concatenate([np.array(left, np.uint64), one[moved]])
        b = np.concatenate([np.array(right, np.uint64), one[forest.of[moved]]])
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return run


def _band_ranges(width: int, parts: int) -> list[tuple[int, int]]:
    edges = [width * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` within the radius of each other, directly or by others."""
    spark = distinct.sparkSession
    bits = lambda x, lo, hi: F.shiftrightunsigned(F.shiftleft(x, lo), 64 - (hi - lo)) if hi > lo else F.lit(0).cast("long")
    one = F.array(*[F.struct(F.lit(i).alias("band"), bits(F.col("fp"), lo, hi).alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(_band_ranges(BITS, radius + 1))])
    first = distinct.select("fp", F.explode(one).alias("e")).select(F.col("e.band").cast("long").alias("level"), F.col("e.value").alias("key"), "fp", "e.lo", "e.hi")
    sizes = first.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(sizes.where(F.col("n") > bucket).select("level", "key"))
    n_hot = hot.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_by = lambda df: df.select("level", "key", "fp").repartition(parts, "level", "key").sortWithinPartitions("level", "key", "fp")
    edges = lambda df: sorted_by(df).mapInPandas(tidying(_edges_of_batches(radius)), "a long, b long")
    if not n_hot:
        return edges(first)
    # Members of a hot bucket agree on its band; the bits left differ in at most ``radius`` places, so they are cut
    # into bands in turn: rotate the agreed band to the front and take bands of the rest.
    send = F.broadcast(hot) if n_hot <= 500_000 else hot
    cool = first.join(send, ["level", "key"], "left_anti")
    warm = first.join(send, ["level", "key"], "left_semi")
    width = F.col("hi") - F.col("lo")
    turned = F.when(F.col("lo") == 0, F.shiftleft(F.col("fp"), BITS // (radius + 1))).otherwise(_rotated("fp", radius))
    second = warm.withColumn("rest", turned)
    inner = F.array(*[F.struct(F.lit(i).alias("sub"), F.shiftrightunsigned(F.shiftleft(F.col("rest"), lo), 64 - (hi - lo)).alias("v")) for i, (lo, hi) in enumerate(_band_ranges(BITS - BITS // (radius + 1), radius + 1))])
    second = second.select("fp", "level", "key", F.explode(inner).alias("e")).select((F.col("level") * 16 + F.col("e.sub") + 100).alias("level"), (F.col("key") * (1 << 20) + F.col("e.v")).alias("key"), "fp")
    counts = second.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))
    heavy = cut(counts.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))
    n_heavy = heavy.count()
    if not n_heavy:
        return edges(cool.select("level", "key", "fp").unionByName(second))
    send = F.broadcast(heavy) if n_heavy <= 500_000 else heavy
    light = second.join(send, ["level", "key"], "left_anti")
    dealt = second.join(send, ["level", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    inside = dealt.select((F.col("level") + 10_000 + F.col("own") * 1000).alias("level"), "key", "fp")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.withColumn("other", other).where("other != own").withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    pairs = pairs.groupBy("level", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).applyInPandas(_cross_block(radius), "a long, b long")
    return edges(cool.select("level", "key", "fp").unionByName(light).unionByName(inside)).unionByName(pairs)


def _rotated(col: str, radius: int) -> Column:
    """The bits outside the band [lo, hi) pushed together at the top."""
    out = F.lit(None).cast("long")
    for lo, hi in _band_ranges(BITS, radius + 1)[1:]:
        front = F.shiftleft(F.shiftrightunsigned(F.col(col), BITS - lo), BITS - lo)
        back = F.shiftrightunsigned(F.shiftleft(F.col(col), hi), lo) if hi < BITS else F.lit(0).cast("long")
        out = F.when(F.col("lo") == lo, front.bitwiseOR(back)).otherwise(out)
    return out


# --- components ------------------------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b), root being the smallest node of the component.

    Alternating star contraction: nodes link their larger neighbours to their smallest one, then all smaller
    neighbours to it, until nothing changes; chains shorten geometrically.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _roots_by_fp(per_fp: DataFrame, radius: int) -> DataFrame:
    """``per_fp`` with the smallest fingerprint reachable over links."""
    roots = components(per_fp.sparkSession, links(per_fp.select("fp"), radius))
    return per_fp.join(roots, per_fp["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest id reachable over links) of every row."""
    marked = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(docs, text_col).alias("fp")))
    grouped = _roots_by_fp(cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))), radius)
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


# --- similarity of five-word shingles ----------------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int = WIDE) -> np.ndarray:
    """Different hashes of the shingles, sorted; fewer words than ``width`` are one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if n <= width:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.fromiter([digest(line[i:j]) for i, j in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64, n - width + 1))


def band_keys(h: np.ndarray, xor: np.ndarray = _XOR, multiply: np.ndarray = _MULTIPLY) -> list[int]:
    """Keys of the blocks a text is dealt to: smallest hashes under fixed permutations, ``ROWS`` to a key."""
    if not len(h):
        return []
    least = np.array([((h ^ x) * m).min() for x, m in zip(xor, multiply)], np.uint64).reshape(BANDS, ROWS)
    return [int(np.int64(xxhash.xxh3_64_intdigest(k.tobytes(), i) - (1 << 63))) for i, k in enumerate(least)]


def odd_sketch(h: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of the hashes end in i: two sketches differ in no more bits than the sets in members."""
    return np.packbits(np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).view(np.uint64)


def may_be_similar(sketch: np.ndarray, n: np.ndarray, i: int, similarity: float) -> np.ndarray:
    """Which sets can reach the similarity to set ``i``: at it, sets differ in (1 - s) / (1 + s) of both sizes at most."""
    most = (n + n[i]) * ((1 - similarity) / (1 + similarity)) + 1e-6
    fit = np.abs(n - n[i]) <= most
    fit[fit] = np.bitwise_count(sketch[fit] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= most[fit]
    return fit


def _signed(docs: DataFrame, text_col: str) -> Column:
    """fp, band keys, size and odd sketch of a text, as a struct."""

    def run(texts: pd.Series) -> pd.DataFrame:
        fps = np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64)
        sets = [shingle_hashes(t) for t in texts]
        return pd.DataFrame({"fp": fps, "bands": [band_keys(h) for h in sets], "n": [len(h) for h in sets], "sketch": [odd_sketch(h).tobytes() for h in sets]})

    return series_udf(run, "fp long, bands array<long>, n long, sketch binary")(F.col(text_col).cast("string"))


def _candidates(radius: int):
    """Over rows sorted by block: each member with the block's first and with its neighbour, if their fingerprints are
    within the radius. At most two links a member and block; only one row is carried from batch to batch. A cheap first
    pass: pairs it leaves out are compared by ``block_links``."""

    def run(batches):
        first = last = None  # (key, fp, node)
        for b in batches:
            key, fps, node = (b[c].to_numpy(np.int64) for c in ("key", "fp", "node"))
            if not len(key):
                continue
            if last is not None:
                key, fps, node = (np.concatenate([[x[i], y[i]], z]) for i, (x, y, z) in zip(range(3), [(first, last, key), (first, last, fps), (first, last, node)]))
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
            at = np.nonzero(~starts)[0]
            for other in (head[at], at - 1):
                near = _planes_within((fps[at] ^ fps[other]).astype(np.uint64), radius)
                x, y = node[at[near]], node[other[near]]
                yield pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})[x != y]
            first, last = tuple(int(v[head[-1]]) for v in (key, fps, node)), tuple(int(v[-1]) for v in (key, fps, node))

    return run


def similar_links(texts: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, radius: int = LOOSE) -> DataFrame:
    """(a, b) of texts whose five-word shingles have at least the similarity, as far as the first pass over their blocks finds them.

    ``texts``: node, text (equal rows may repeat); ``signed``: node, fp, bands. Candidates by fingerprints are checked on
    the whole shingle sets of the texts concerned.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.select("node", "fp", F.explode("bands").alias("key")).repartition(parts, "key").sortWithinPartitions("key", "fp", "node")
    pairs = cut(dealt.mapInPandas(tidying(_candidates(radius)), "a long, b long").distinct())
    wanted = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    few = wanted.count() <= 2_000_000

    def hashes(col: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t).tobytes() for t in col], dtype=object)

    sets = texts.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", series_udf(hashes, "binary")("text").alias("h"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(common / max(len(p) + len(q) - common, 1))
        return pd.Series(out)

    return both.withColumn("s", jaccard("ha", "hb")).where(F.col("s") >= similarity).select("a", "b")


def _whole_groups(work, columns: list[str], by: list[str]):
    """Over rows sorted by group: ``work`` on each complete group, the last one waits for the next batch."""

    def groups(rows: pd.DataFrame):
        key = rows[by].to_numpy(np.int64)
        edge = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, [len(rows)]])
        parts = [work(rows.iloc[a:b]) for a, b in zip(edge[:-1], edge[1:]) if b - a > 1]
        parts = [x for x in parts if len(x)]
        if parts:
            yield pd.concat(parts, ignore_index=True)[columns]

    def run(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = b[by].iloc[-1]
            same = (b[by] == last).all(axis=1).to_numpy()
            if held and (held[0][by].iloc[0] == last).all() and same.all():
                held.append(b)
                continue
            first = len(b) - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from groups(pd.concat([*held, b.iloc[:first]], ignore_index=True)) if held or first else ()
            held = [b.iloc[first:]]
        if held:
            yield from groups(pd.concat(held, ignore_index=True))

    return run


def _open_members(similarity: float):
    """The members of a group that can be similar to one of another root."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        root, n = g["root"].to_numpy(np.int64), g["n"].to_numpy(np.int64)
        sketch = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
        kinds, counts = np.unique(root, return_counts=True)
        found = np.zeros(len(g), bool)
        for i in np.nonzero(root != kinds[counts.argmax()])[0]:
            fit = may_be_similar(sketch, n, i, similarity) & (root != root[i])
            if fit.any():
                found |= fit
                found[i] = True
        return g[found]

    return work


def _checked_links(similarity: float):
    """A forest of the roots of a group whose members' whole sets are similar."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        root, sets, links = g["root"].to_numpy(np.int64), [np.frombuffer(h, np.uint64) for h in g["h"]], []
        n, sketch, label = np.array([len(h) for h in sets]), np.array([odd_sketch(h) for h in sets]), np.unique(root, return_inverse=True)[1]
        for i in range(1, len(g)):
            left = np.nonzero(may_be_similar(sketch, n, i, similarity)[:i])[0]
            left = left[label[left] != label[i]]
            while len(left):
                j = left[0]
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common / max(n[i] + n[j] - common, 1) >= similarity:
                    links.append((root[i], root[j]))
                    label[label == label[j]] = label[i]
                left = left[1:]
                left = left[label[left] != label[i]]
        return pd.DataFrame(links, columns=["a", "b"])

    return work


def _mixed(dealt: DataFrame) -> DataFrame:
    """Blocks of more than one root: key, members, the root with most of them, and members of other roots."""
    per_root = dealt.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    per_key = per_root.groupBy("key").agg(F.sum("c").alias("total"), F.max(F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return cut(per_key.select("key", "total", F.col("most.root").alias("major"), (F.col("total") - F.col("most.c")).alias("minor")))


def block_links(texts: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, held: int = HELD) -> DataFrame:
    """(a, b) of roots that connect all similar texts of common blocks.

    ``signed``: node, root, bands, n, sketch. All members of a block are compared, unless they have one root already:
    by what sizes and odd sketches can prove, then by their whole sets. Blocks with more than ``held`` members outside
    their largest root are dealt on by further smallest hashes; what is still too large for a task is cut into parts,
    and each part outside the largest root meets every other one.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = lambda df, n: F.broadcast(df) if n <= 500_000 else df
    dealt = signed.select("node", "root", "n", "sketch", F.explode("bands").alias("key"))
    mixed = _mixed(dealt.select("key", "root"))
    rows = dealt.join(few(mixed, mixed.count()), "key")
    if mixed.where(F.col("minor") > held).limit(1).count():
        hot = rows.where(F.col("minor") > held)
        ids = cut(hot.select("node").distinct())

        def further(col: pd.Series) -> pd.Series:
            return pd.Series([band_keys(shingle_hashes(t), *_FURTHER) for t in col])

        more = texts.join(few(ids, ids.count()), "node", "left_semi").dropDuplicates(["node"]).select("node", series_udf(further, "array<long>")("text").alias("more"))
        hot = hot.select("key", "node", "root", "n", "sketch").join(more, "node").withColumn("more", F.explode("more")).withColumn("key", F.xxhash64("key", "more")).drop("more")
        again = _mixed(hot.select("key", "root"))
        rows = rows.where(F.col("minor") <= held).unionByName(hot.join(few(again, again.count()), "key"))
    number = lambda n: F.greatest(F.ceil(n * 2 / held), F.lit(1)).cast("int")
    q, p = number(F.col("minor")), number(F.col("total") - F.col("minor"))
    of = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumns({"q": q, "p": p}).withColumn("own", F.when(F.col("root") == F.col("major"), F.col("q") + of(F.col("p"))).otherwise(of(F.col("q"))))
    others = F.when(F.col("total") <= held, F.array(F.lit(-1))).when(F.col("own") < F.col("q"), F.sequence(F.lit(0), F.col("q") + F.col("p") - 1)).otherwise(F.sequence(F.lit(0), F.col("q") - 1))
    rows = rows.withColumn("other", F.explode(others)).where("other <> own")
    rows = rows.withColumns({"i": F.when(F.col("other") < 0, -1).otherwise(F.least("own", "other")), "j": F.when(F.col("other") < 0, -1).otherwise(F.greatest("own", "other"))})
    by = ["key", "i", "j"]
    grouped = lambda df: df.repartition(parts, *by).sortWithinPartitions(*by)
    some = grouped(rows.select(*by, "node", "root", "n", "sketch")).mapInPandas(tidying(_whole_groups(_open_members(similarity), [*by, "node", "root"], by)), "key long, i int, j int, node long, root long")
    some = cut(some)
    wanted = cut(some.select("node").distinct())

    def hashes(col: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t).tobytes() for t in col], dtype=object)

    sets = texts.join(few(wanted, wanted.count()), "node", "left_semi").dropDuplicates(["node"]).select("node", series_udf(hashes, "binary")("text").alias("h"))
    return grouped(some.join(sets, "node").select(*by, "root", "h")).mapInPandas(tidying(_whole_groups(_checked_links(similarity), ["a", "b"], by)), "a long, b long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))


def _similar_roots(docs: DataFrame, id_col: str, text_col: str, radius: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, node of every row, and node, least id, root of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = _texts(docs, id_col, text_col)
    marked = cut(keyed.select("doc_id", "node", _signed(keyed, "text").alias("s")).select("doc_id", "node", "s.*"))
    per_text = cut(marked.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "bands", "n", "sketch")]))
    home = per_text.groupBy("fp").agg(F.min("node").alias("home"))
    same = per_text.join(home, "fp").where("node <> home").select(F.col("node").alias("a"), F.col("home").alias("b"))
    close = links(home.select("fp"), radius)
    ends = close.join(home.select(F.col("fp").alias("a"), F.col("home").alias("x")), "a").join(home.select(F.col("fp").alias("b"), F.col("home").alias("y")), "b")
    texts = keyed.select("node", "text")
    near = similar_links(texts, per_text.select("node", "fp", "bands"), similarity)
    roots = components(spark, same.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(near))
    grouped = cut(per_text.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    more = cut(block_links(texts, grouped.select("node", "root", "n", "sketch", "bands"), similarity))
    grouped = grouped.select("node", "least", "root")
    if more.limit(1).count():
        joined = components(spark, more).select(F.col("node").alias("root"), F.col("root").alias("_to"))
        grouped = grouped.join(joined, "root", "left").select("node", "least", F.coalesce("_to", "root").alias("root"))
    return marked.select("doc_id", "node"), grouped


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id by equal texts, fingerprints within the radius, and similar five-word shingles."""
    marked, grouped = _similar_roots(docs, id_col, text_col, radius, similarity)
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(grouped.join(ids, "root").select("node", "component_id"), "node", "left").select("doc_id", "component_id")


def _near_roots(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """node, least id, root of every text, by fingerprints alone."""
    small_batches(docs.sparkSession)
    keyed = _texts(docs, id_col, text_col)
    marked = keyed.select("doc_id", "node", fingerprints(keyed, "text").alias("fp"))
    per_text = cut(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")))
    return per_text.join(_roots_by_fp(cut(per_text.select("fp").distinct()), radius), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similar: bool = True) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null only if all are) and, of texts that share
    it, of the smallest hash; of rows repeating both, one. Rows of other components stay, whatever ids they share.

    With ``similar``, texts whose five-word shingles are similar belong together too.

    A narrow table of the surviving ids and text hashes is joined back, so texts are not shuffled by component.
    """
    grouped = _similar_roots(docs, id_col, text_col, radius, SIMILARITY)[1] if similar else _near_roots(docs, id_col, text_col, radius)
    first = cut(grouped.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("s")).select("s.least", "s.node"))
    kept, own = free_name(docs, "nd_id"), free_name(docs, "nd_text")
    mate = free_name(docs, "nd_node")
    rows = first.count()
    first = first.select(F.col("least").alias(kept), F.col("node").alias(mate))
    named = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    out = named.join(F.broadcast(first) if rows <= 2_000_000 else first, named[id_col].eqNullSafe(F.col(kept)) & (F.col(own) == F.col(mate)), "inner")
    repeated = named.groupBy(id_col, own).count().where("count > 1").limit(1).count()
    return (out.dropDuplicates([id_col, own]) if repeated else out).select(*columns(docs.columns))
