"""The training-data operators against brute-force versions, round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bpe, media, mixing, packing, quality, queries, resharding, simhash, suffixdedup, topk, toxicity, warc

SF = os.environ.get("LLM_TEST_DATA", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, extra=()):
    """Nulls, empty and long texts, ties, repeated rows, a clashing extra column."""
    long = " ".join(f"w{i % 977} tail{i}" for i in range(20000))
    rows = [(1, "", "en", "a", 0, 5), (2, None, None, None, None, 5), (None, "some words here", "en", "a", 3, 5), (4, long, "en", "b", 9, None), (5, long, "en", "b", 9, 1), (5, long, "en", "b", 9, 1), (7, "A b C", "en", "a", 5, 0), (8, "a B c", "en", None, 5, 0), (9, "\x00\ud83d".encode("utf-8", "ignore").decode() + " é 日本", "en", "a", 5, 0)]
    return spark.createDataFrame([*rows, *extra], DOCS + ", score int")


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- toxicity and quality ----------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    truth, said = got["toxic"].to_numpy(), got["predicted"].to_numpy()
    assert (said[truth == 1]).mean() > 0.7 and said[truth == 0].mean() < 0.03


def test_toxicity_against_plain_counts(spark):
    """Kneser-Ney evidence worked out over plain dictionaries, for texts with known, rare and unknown expressions."""
    import math

    rng, d = random.Random(12), toxicity.DISCOUNT
    word = lambda: rng.choice(["good", "day", "you", "are", "rotten", "rottenness", "fool", "sun", "warmth", "warmly"])
    texts = [(i, " ".join(word() for _ in range(rng.randint(1, 30))), i % 3 == 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in texts], "doc_id long, quality int, toxic int")
    model = toxicity.Toxicity.fit(docs, labels, epsilon=0.0, train_on=F.lit(True)).model
    pairs, stems = (Counter(), Counter()), (Counter(), Counter())
    for _, t, y in texts:
        w = t.split()
        pairs[y].update(zip(["", *w], w))
        stems[y].update(x[: toxicity.BEGINNING] for x in w)
    follows = [Counter(w for _, w in p) for p in pairs]
    context = [Counter() for _ in pairs]
    for c, p in zip(context, pairs):
        for (a, _), n in p.items():
            c[a] += n
    types = len(set(follows[0]) | set(follows[1]))
    left = lambda n: max(1 - sum(max(x - d, 0) for x in n.values()) / sum(n.values()), 1e-6)

    def evidence(text):
        out, w = [], text.split()
        for a, b in zip(["", *w], w):
            shared = (stems[0][b[:5]] + stems[1][b[:5]] + 1e-2) / (sum(stems[0].values()) + sum(stems[1].values()))
            stem = [max(s[b[:5]] - d, 0) / sum(s.values()) + left(s) * shared for s in stems]
            lean = (math.log(stem[1]) - math.log(stem[0])) / 2
            low = [max(f[b] - d, 0) / sum(f.values()) + left(f) / types * math.exp(sign * lean) for f, sign in zip(follows, (-1, 1))]
            rest = [min(1.0, max(1e-6, 1 - sum(max(n - d, 0) for (x, _), n in p.items() if x == a) / max(c[a], 1))) for p, c in zip(pairs, context)]
            high = [max(p[a, b] - d, 0) / max(c[a], 1) + r * q for p, c, r, q in zip(pairs, context, rest, low)]
            known = all(c[a] >= 2 for c in context)
            out.append(min(6.0, max(-3.0, math.log((high if known else low)[1]) - math.log((high if known else low)[0]))))
        return out

    for text in ("good day you are rotten", "rottenest fool unseen words here", "warm", "fool fool fool sun warmly good", *[t for _, t, _ in texts[:10]]):
        assert np.allclose(model.evidence(*toxicity.tokens(text)), evidence(text), atol=1e-9)


def test_toxicity_rare_expressions(spark):
    """However few expressions are broadcast, each counts: scores are those of the model that is broadcast whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(odd_docs(spark).select("doc_id", "text"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    whole = toxicity.Toxicity.fit(docs, labels)
    assert whole.rest is None
    want = sorted(tuple(r) for r in docs.select(F.coalesce("doc_id", F.lit(-9)), whole.score(docs)).collect())
    for hot in (0, 300):
        part = toxicity.Toxicity.fit(docs, labels, hot=hot)
        assert part.rest.count() + sum(len(t.key) for t in part.model.tables.values()) == sum(len(t.key) for t in whole.model.tables.values())
        assert np.allclose(part.curve, whole.curve, atol=1e-6)
        got = sorted(tuple(r) for r in part.scores(docs).select(F.coalesce("doc_id", F.lit(-9)), "score").collect())
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)


def test_toxicity_odd(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (7, 1, 1), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.Toxicity.fit(docs, labels, train_on=F.lit(True))
    assert all(0 <= r[0] <= 1 for r in docs.select(model.score(docs)).collect())
    none = toxicity.Toxicity.fit(docs, labels.limit(0))
    assert {r[0] for r in docs.select(none.score(docs)).collect()} == {0.0}
    assert no_docs(spark).select(none.score(docs)).count() == 0


def test_quality_keeps_good_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.2


def test_quality_against_plain_counts(spark):
    """The query's models, weights, keys and sample, worked out over plain dictionaries."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    raw, target, feats = Counter(), Counter(), {}
    for i, text in docs:
        words = [zlib.crc32(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+", (text or "").lower().encode())]
        pairs = [1 if a == b else ((a * 0x9E3779B1 + b * 0x85EBCA77 + 7) % 2**64) >> 16 for a, b in zip(words, words[1:])]
        feats[i] = [x % quality.BUCKETS for x in words + pairs]
        raw.update(feats[i])
        if labels.get(i):
            target.update(feats[i])
    n, m, k = raw.total(), target.total(), quality.BUCKETS
    ratio = lambda x: min(8, max(-8, math.log((target[x] + 0.5) / (m + 0.5 * k)) - math.log((raw[x] + 0.5) / (n + 0.5 * k))))
    mean = {i: sum(map(ratio, f)) / len(f) if f else 0.0 for i, f in feats.items()}
    unit = lambda i: int(hashlib.md5(f"{quality.SEED}\x1f{i}".encode()).hexdigest()[:13], 16) / 2**52
    key = {i: quality.PASSAGE * mean[i] - math.log(-math.log(unit(i) + 2.0**-54)) for i in mean}
    seen = sorted(labels)
    cutoff = quality.best_cutoff(np.array([mean[i] for i in seen]), np.array([labels[i] for i in seen]))
    last = sorted(key.values(), reverse=True)[sum(x >= cutoff for x in mean.values()) - 1]
    for r in queries.op2_quality(spark, SF).collect():
        assert abs(r["log_ratio"] - mean[r["doc_id"]]) < 1e-9 and abs(r["gumbel_key"] - key[r["doc_id"]]) < 1e-6 and r["kept"] == (key[r["doc_id"]] >= last - 1e-9)


def test_quality_sample_follows_target(spark):
    """A sample of k documents by importance comes nearer to the target's words than the raw documents."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.ImportanceResampler.fit(docs, labels)
    good = {r[0] for r in labels.where("quality = 1").collect()}
    rows = model.resample(docs, k=300).select("doc_id", "text", "qr_keep").collect()
    assert sum(r["qr_keep"] for r in rows) == 300

    def share(chosen):
        n = np.full(quality.BUCKETS, 0.1)
        for r in chosen:
            np.add.at(n, quality.features(r["text"] or ""), 1)
        return n / n.sum()

    target, sample, raw = share(r for r in rows if r["doc_id"] in good), share(r for r in rows if r["qr_keep"]), share(rows)
    away = lambda p: float((target * np.log(target / p)).sum())
    assert away(sample) < away(raw)


def test_bounded_sample(spark):
    from ledgerloom.llm.common import bounded_sample

    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    for most, n in ((10, 10), (1000, 1000), (5000, 1000)):
        assert ids.where(bounded_sample(ids, "doc_id", most)).count() == n


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, rng.gauss(0, 1e6)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 700, 1500, 2999):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_quality_odd(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (7, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    out = quality.ImportanceResampler.fit(docs, labels).resample(docs)
    assert out.count() == docs.count() and out.where("qr_keep is null").count() == 0
    assert quality.ImportanceResampler.fit(docs, labels.limit(0)).resample(docs).where("qr_keep").count() == docs.count()
    assert quality.ImportanceResampler.fit(no_docs(spark), labels).resample(no_docs(spark)).count() == 0


# --- top-k -------------------------------------------------------------------------------------------------------


def brute_top(vectors, k):
    out = []
    for q, v in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 1024), (37, 3)])
def test_topk(spark, blocks):
    rng = np.random.default_rng(3)
    raw = [(int(i), [int(x) for x in rng.integers(-5, 6, 9)]) for i in range(230)]
    raw += [(300 + i, [1] * 9) for i in range(60)]
    df = spark.createDataFrame(raw + raw[:7] + [(None, [1] * 9), (901, None)], "vec_id long, v array<int>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block=blocks[0], query_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute_top(raw, 20)
    few = spark.createDataFrame(raw[:5], "vec_id long, v array<int>")
    assert topk.top_k(few, F.col("vec_id") == 0, 20).count() == 4
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_topk_sql_on_repeated_rows(spark, tmp_path):
    """A row that stands there twice counts once, for the operator and its SQL alike."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(50)]
    spark.createDataFrame(rows + rows[:15], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op3_topk"])
    cols = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.op3_topk(spark, str(tmp_path)).select(*cols).collect())) == sorted(want.fetchall())


def test_topk_lengths_and_large_values(spark):
    """Vectors of other lengths and values that doubles don't hold take part."""
    raw = [(i, [i % 7 - 3, 2, i % 5]) for i in range(90)] + [(100, [5]), (120, [1, 2, 3, 4, 5, 6]), (140, [2**40, 3, -1]), (141, [2**40 + 1, 1, 1]), (160, [-(2**20), 2**30, 7])]
    df = spark.createDataFrame(raw, "vec_id long, v array<long>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block=2, query_block=1)
    limit = 2**63 - 1
    want = [(q, r, i, max(-limit, min(limit, s))) for q, r, i, s in brute_top(raw, 20)]
    assert sorted((r[0], r[1], r[3]) for r in got.collect()) == sorted((w[0], w[1], w[3]) for w in want)
    unlimited = {w[:3] for w in want if abs(w[3]) < limit}
    assert unlimited <= {tuple(r)[:3] for r in got.collect()}
    rows = [(0, [1.0, 2.0]), (1, [3.4e7, 1.0]), (2, [-1.0, 0.5])]
    big = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantise().alias("v"))
    assert {r["vec_id"]: r["score"] for r in topk.top_k(big, F.col("vec_id") == 0, 5).collect()} == {1: 64 * 64 * 34_000_000 + 128 * 64, 2: -64 * 64 + 128 * 32}


def test_quantise(spark):
    rows = [(1, [0.5, -0.01]), (2, [float("nan"), 0.0]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r[0]: r[1] for r in df.select("vec_id", topk.quantise()).collect()} == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: None}


# --- resharding --------------------------------------------------------------------------------------------------


def test_transfers_are_least():
    rng = random.Random(4)
    for _ in range(200):
        old = {i: rng.randint(0, 50) for i in range(rng.randint(1, 6))}
        cap = resharding.equal_capacities(sum(old.values()), rng.randint(1, 7))
        flows = resharding.min_cost_transfers(old, cap)
        assert all(sum(n for s, _, n in flows if s == i) == old[i] for i in old)
        assert all(sum(n for _, d, n in flows if d == j) == cap[j] for j in cap)
        assert sum(n for s, d, n in flows if s != d) == sum(max(0, n - cap.get(i, 0)) for i, n in old.items())


def test_resharding(spark):
    got = queries.op4_resharding(spark, SF.replace("0.001", "0.01")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() <= sizes.min() * 1.05
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_resharding_keeps_untouched_shards(spark):
    docs = spark.createDataFrame([(i, "x" * 9, i % 2 if i < 8 else 2) for i in range(20)], "doc_id long, text string, s int").where("s < 2 or doc_id < 12")
    out, path = resharding.rewrite(docs, F.col("s"), 3)
    assert out.count() == 12 and not os.path.exists(path.removeprefix("file:"))  # four rows a shard already
    docs = docs.where("doc_id <> 11")
    out, path = resharding.rewrite(docs, F.when(F.col("doc_id") == 0, 2).otherwise(F.col("s")), 3)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_resharding_moves_least(spark):
    """Against the transport problem worked out over plain rows: what moves is the least, up to a document a transfer."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(5000), F.lit(5300)))))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    size = {i: len((t or "").encode()) + 1 for i, t in rows.items()}
    old_of = {i: zlib.crc32((t or "").encode()) % 5 for i, t in rows.items()}
    out, path = resharding.rewrite(docs, F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(5)), 7, block_rows=100)
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == rows and all(got[i]["rs_size"] == size[i] and got[i]["rs_old"] == old_of[i] for i in rows)
    total, biggest = sum(size.values()), max(size.values())
    held = [sum(size[i] for i, r in got.items() if r["rs_shard"] == j) for j in range(7)]
    assert max(abs(h - total / 7) for h in held) <= 6 * biggest
    old = Counter()
    for i in rows:
        old[old_of[i]] += size[i]
    least = sum(max(0, old[j] - total / 7) for j in old)
    moved = {i for i, r in got.items() if r["rs_shard"] != r["rs_old"]}
    assert least - 12 * biggest <= sum(size[i] for i in moved) <= least + 12 * biggest
    written = {r["doc_id"] for r in spark.read.parquet(path).select("doc_id").collect()}
    assert written == moved
    for j in range(7):
        assert sorted(r["rs_slot"] for r in got.values() if r["rs_shard"] == j) == list(range(sum(r["rs_shard"] == j for r in got.values())))


def test_clashing_names(spark):
    """Columns that bear the operators' own names come through with their values; new ones get other names."""
    names = ["sd_unit", "sd_len", "SD_SPANS", "sd_passages", "mix_size", "mix_copies", "rs_size", "rs_block", "qr_ratio", "qr_keep", "nd_id", "fp", "node", "block", "anchor", "text_", "a`b c"]
    docs = spark.createDataFrame([(i, f"some words {i % 3} " * (i % 4 * 30), "s", *[f"{n}{i}" for n in names]) for i in range(12)], ["doc_id", "text", "source", *names])
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    own = lambda df: sorted(tuple(r) for r in df.select(*[F.col(f"`{n.replace('`', '``')}`") for n in ["doc_id", *names]]).distinct().collect())
    want = own(docs)
    assert own(suffixdedup.with_spans(docs, 40)) == want == own(suffixdedup.with_passages(docs, 51)) == own(suffixdedup.without_repeats(docs, 40, words=51))
    assert {"_sd_spans", "sd_bytes"} <= {c.lower() for c in suffixdedup.with_spans(docs, 40).columns}
    mixed = mixing.with_copies(docs)
    assert own(mixed) == want and "_mix_size" in mixed.columns and set(own(mixing.mix(docs))) <= set(want) and mixing.mix(docs).columns == docs.columns
    shards, _ = resharding.rewrite(docs, F.lit(0), 3)
    assert own(shards) == want and "_rs_size" in shards.columns
    scored = quality.ImportanceResampler.fit(docs, labels).resample(docs)
    assert own(scored) == want and "_qr_keep" in scored.columns
    kept = simhash.keep_one(docs)
    assert set(own(kept)) <= set(want) and kept.columns == docs.columns
    assert docs.select(toxicity.Toxicity.fit(docs, labels, train_on=F.lit(True)).score(docs)).count() == 12


def test_resharding_odd(spark):
    docs = odd_docs(spark)
    out, path = resharding.rewrite(docs, F.lit(0), 3)
    rows = out.collect()
    assert len(rows) == docs.count() and sorted(r["rs_slot"] for r in rows if r["rs_shard"] == rows[0]["rs_shard"])[0] == 0
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in docs.collect())
    assert resharding.rewrite(no_docs(spark), F.lit(0), 3)[0].count() == 0


# --- media -------------------------------------------------------------------------------------------------------


class BitByBit(media.ProgressiveDecoder):
    def _fast(self, *args):
        return None


def test_media_round_trip():
    rng = np.random.default_rng(0)
    for n in (192, 384, 576, 1920):
        payload = bytes(rng.integers(0, 256, n, dtype=np.uint8))
        stream = media.encode_payload(payload)
        fast, slow = media.ProgressiveDecoder(stream), BitByBit(stream)
        assert fast.payload() == payload == slow.payload()
        assert all((fast.coefficients[c] == slow.coefficients[c]).all() for c in fast.coefficients)
        assert (fast.rgb() == slow.rgb()).all()


def test_media_general_scans():
    """A stream written by hand: several codes, runs, end-of-band runs, and a refinement that adds a coefficient."""
    seg, out = media._segment, [b"\xff\xd8"]
    out.append(seg(0xDB, bytes([0] + [2] * 64)))
    out.append(seg(0xC2, struct.pack(">BHHB", 8, 8, 16, 1) + bytes([1, 0x11, 0])))
    pack = lambda bits: np.packbits([int(b) for b in bits + "1" * (-len(bits) % 8)]).tobytes().replace(b"\xff", b"\xff\x00")
    out.append(seg(0xC4, bytes([0x00, 0, 2] + [0] * 14 + [3, 0])))  # 00: size 3, 01: size 0
    out += [media._scan_header([1], 0, 0, 0, 1), pack("00" + "101" + "01")]
    out.append(seg(0xC4, bytes([0x10, 0, 3] + [0] * 14 + [0x11, 0x02, 0x10])))  # run 1 size 1; size 2; end of band for 2
    out += [media._scan_header([1], 1, 63, 0, 1), pack("00" + "1" + "01" + "10" + "10" + "0")]
    out += [media._scan_header([1], 0, 0, 1, 0), pack("10")]
    out.append(seg(0xC4, bytes([0x10, 0, 2] + [0] * 14 + [0x01, 0x00])))  # new coefficient; end of band
    out += [media._scan_header([1], 1, 63, 1, 0), pack("00" + "1" + "01" + "0" + "1" + "01")]
    d = media.ProgressiveDecoder(b"".join([*out, b"\xff\xd9"]))
    block, other = d.coefficients[1][0, 0], d.coefficients[1][0, 1]
    assert block[0] == 11 and other[0] == 10
    # first scan: run 1 then 1 << 1 at place 2, then 2 << 1 at 3; refinement: +1 at 1 (new), then corrections 0 and 1
    assert list(block[1:5]) == [1, 2, 5, 0] and not other[1:].any()
    want = np.zeros(64)
    want[media.ZIGZAG] = block * 2.0
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.125), 0.5)
    direct = np.array([[sum(c[a] * c[b] * want.reshape(8, 8)[a, b] * np.cos((2 * y + 1) * a * np.pi / 16) * np.cos((2 * x + 1) * b * np.pi / 16) for a in u for b in u) for x in u] for y in u])
    assert np.abs(d.planes()[0][:, :8] - 128 - direct).max() < 1e-2
    assert d.rgb().shape == (8, 16, 3)


def test_media_query(spark):
    docs = odd_docs(spark)
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.describe(media.encode_texts(docs)).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        g = got[r["doc_id"], len(raw)]
        assert g["payload_sha256"] == hashlib.sha256(want).hexdigest() and g["payload_bytes"] == len(want) and g["tail_crc32"] == zlib.crc32(want[-16:])
    assert media.tensors(media.encode_texts(docs)).where("length(rgb) = height * width * 3").count() == docs.count()
    assert media.describe(media.encode_texts(no_docs(spark))).count() == 0


# --- SimHash -----------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def brute_components(fps, radius=3):
    distinct, root = list(set(fps)), {}
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_simhash_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    fps = {i: brute_fingerprint(t) for i, t in docs}
    root = brute_components(fps.values())
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((i, f"{f:016x}", least[root[f]]) for i, f in fps.items())
    assert sorted(map(tuple, queries.op6_simhash(spark, SF).collect())) == want


@pytest.mark.parametrize("bucket,block", [(4096, 16384), (20, 16384), (5, 8)])
def test_links_by_planes(spark, bucket, block):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:12]:
        for _ in range(14):
            x = base
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {signed(x): signed(x) for x in fps}
    got.update({r["node"]: r["root"] for r in simhash.components(spark, simhash.links(df, bucket=bucket, block=block)).collect()})
    want = brute_components(fps)
    pairs = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert pairs(got) == {frozenset(map(signed, g)) for g in pairs(want)}


def test_small_links():
    rng = random.Random(11)
    fps, bucket = [], []
    for b in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 20, 48])):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
            fps.append(x)
            bucket.append(b)
    a, b = simhash._small_links(np.array(fps, np.uint64), np.array(bucket), 3)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bucket[i] == bucket[j] and bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_within_planes():
    rng = random.Random(7)
    fps = np.array([rng.getrandbits(64) for _ in range(300)] + [rng.getrandbits(3) for _ in range(300)], np.uint64)
    planes = simhash.bit_planes(fps)
    for q in (0, 7, int(fps[0]), (1 << 64) - 1):
        assert set(simhash.within(planes, q, len(fps))) == {i for i, f in enumerate(fps) if bin(int(f) ^ q).count("1") <= 3}


def test_similar_groups(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([30, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            w = list(base)
            for _ in range(rng.choice([1, 2, len(base) // 40, len(base) // 8])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += texts[:3]
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            similarity = len(a & b) / len(a | b)
            if similarity >= 0.8:
                assert got[i] == got[j]
            if similarity < 0.2:
                assert got[i] != got[j]


def similar_pairs(texts):
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


def test_similar_groups_refrain(spark):
    rng = random.Random(3)
    word = lambda: f"w{int(2000 * rng.random() ** 2)}"
    texts = []
    for _ in range(60):
        body, refrain = " ".join(word() for _ in range(200)), " ".join(word() for _ in range(8))
        texts += [f"{body} {' '.join([refrain] * n)}" for n in (2, 60)]
    likeness = similar_pairs(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    pairs = [i for i in range(0, len(texts), 2) if likeness(i, i + 1) >= 0.8]
    assert len(pairs) == 60 and all(got[i] == got[i + 1] for i in pairs) and len(set(got.values())) == 60


@pytest.mark.parametrize("held", [simhash.HELD, 150])
def test_block_links_shared_passage(spark, held):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(50_000)}"
    shared, texts, twins = " ".join(word() for _ in range(150)), [], 60
    for i in range(1500):
        tail = [word() for _ in range(70)]
        texts.append(f"{shared} {' '.join(tail)}")
        if i < twins:
            texts.append(f"{shared} {' '.join(tail[:50] + [word() for _ in range(20)])}")
    likeness = similar_pairs(texts)
    keyed = simhash._texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "doc_id", "text")
    signed = keyed.select("doc_id", "node", F.col("node").alias("root"), simhash._signed(keyed, "text").alias("s")).select("doc_id", "node", "root", "s.*").cache()
    node = {r["doc_id"]: r["node"] for r in signed.select("doc_id", "node").collect()}
    rows = simhash.block_links(keyed.select("node", "text"), signed.drop("doc_id"), held=held).collect()
    got = {frozenset((r["a"], r["b"])) for r in rows}
    want = {frozenset((node[2 * i], node[2 * i + 1])) for i in range(twins) if likeness(2 * i, 2 * i + 1) >= 0.8}
    assert len(want) == twins and got == want


def test_keep_one_common_ids(spark):
    texts = ["one two three", "four five six", "seven eight nine", "seven eight nine", "ten eleven twelve", "thirteen fourteen"]
    df = spark.createDataFrame(list(zip([None, None, None, 3, 4, 4], texts)), "doc_id long, text string")
    for similar in (True, False):
        kept = sorted((r["text"], r["doc_id"]) for r in simhash.keep_one(df, similar=similar).collect())
        assert [t for t, _ in kept] == sorted(set(texts)) and ("seven eight nine", 3) in kept
        assert simhash.keep_one(df.unionByName(df), similar=similar).count() == 5


def test_simhash_odd(spark):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd_docs(spark)).collect()}
    assert {(1, 1), (2, 1), (4, 4), (5, 4), (7, 7), (8, 7)} <= got
    kept = simhash.keep_one(odd_docs(spark))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 4, 7, 9] and kept.columns == odd_docs(spark).columns
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


# --- BPE ---------------------------------------------------------------------------------------------------------


def test_bpe_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    own, lib = bpe.WordBPE(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ["", "  ", "Σ ΑΣ σς", "İstanbul", "a<|endoftext|>b <|startoftext|>x", "it's we'll I'M", "ﬁ é ẛ̣ Ⅷ ½ 12345", "x\x1cy\x1d z\x85q\xa0r", "日本語 한국어", "😀!!!", "a" * 300, "<|", "a</w>b"]
    texts += ["".join(rng.choice("etaoinshrdlu thanreising's 0129éß!?-") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1500), rng.randint(0x2000, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        mine = own.encode(t)
        assert np.frombuffer(mine, "<u4").tolist() == ids
        assert own.decode(mine).decode() == lib.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark):
    """The query against the library, over whole texts."""
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd(spark):
    path, docs = queries.vocabulary_path(), odd_docs(spark)
    out = docs.select("doc_id", bpe.encode(docs, path).alias("ids")).withColumn("n", F.size(bpe.ids_array(F.col("ids")))).collect()
    assert len(out) == docs.count() and {r["n"] for r in out if r["doc_id"] in (1, 2)} == {0}
    own = bpe.load(path)
    assert all(len(r["ids"]) == 4 * r["n"] for r in out) and own.decode(bytes(out[2]["ids"])) == b"some</w> words</w> here</w>"


# --- WARC --------------------------------------------------------------------------------------------------------


def test_warc(spark):
    page = "x" * 150
    rows = [(i, f"http://e/{i % 9} ü", page + str(i % 7)) for i in range(120)] + [(200, "u", None), (201, None, ""), (202, "u", "short"), (203, "u", "short"), (None, "u", page + "0"), (0, "again", page + "0"), (500, "u", "\r\n\r\n" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write(df, roll_bytes=3000, range_rows=30)
    got = sorted(((r["page_id"] is not None, r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read(spark, path).collect()), key=str)
    want = []
    for n, (i, _, html) in enumerate(rows):
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None)
        again = len(raw) >= 100 and (i != first or n == 125)
        want.append((i is not None, i, "revisit" if again else "response", len(raw), first if again else None))
    assert got == sorted(want, key=str)
    again = warc.write(df.repartition(5), roll_bytes=3000, range_rows=30)
    system, a = warc._files(path)
    _, b = warc._files(again)
    assert system.open_input_stream(f"{a}/manifest.json").read() == system.open_input_stream(f"{b}/manifest.json").read()
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0
    odd = spark.createDataFrame([("null", "u", page), ("a\r\nWARC/1.1 b", "u", page), (None, "u", page), ("", "u", "x"), ("é%20", "u", "y" * 200)], "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(spark, warc.write(odd)).collect()}
    assert got == {("", "response", None), ("é%20", "response", None), ("a\r\nWARC/1.1 b", "response", None), ("null", "revisit", "a\r\nWARC/1.1 b"), (None, "revisit", "a\r\nWARC/1.1 b")}


# --- repeated passages -------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] += 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(rng, n=60):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(8)]
    out = ["", None, "ab" * 200, "z" * 90, "y" * 39, "y" * 40, "q" * 41]
    for _ in range(n):
        out.append(" ".join(rng.choice([word(), word(), word(), rng.choice(shared), rng.choice(shared)[: rng.randint(1, 90)]]) for _ in range(rng.randint(1, 12))))
    return out + out[10:16]


def test_difference_cover():
    for length in (1, 4, 40, 51, 400):
        v, residues = suffixdedup.difference_cover(length)
        assert {(int(a) - int(b)) % v for a in residues for b in residues} == set(range(v)) and v <= max(1, length * 0.8)
    assert suffixdedup.difference_cover(400)[0] == 307 and suffixdedup.sample_places(399, 400).size == 0
    at = suffixdedup.sample_places(5000, 400)
    for i, j in ((0, 1), (7, 900), (3, 4600), (1000, 1307)):  # equal windows meet the sample at a common distance
        assert any(i + d in at and j + d in at for d in range(307))


@pytest.mark.parametrize("seed,flush,block", [(1, 1_000_000, 20000), (2, 50, 20000), (3, 1_000_000, 3), (4, 10, 2)])
def test_repeats(spark, monkeypatch, seed, flush, block):
    monkeypatch.setattr(suffixdedup._dealt, "__defaults__", (flush,))
    texts = passages(random.Random(seed))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    found = suffixdedup.with_spans(df, 40, block=block)
    got = {r["doc_id"]: (r["sd_bytes"], sum(s["stop"] - s["start"] for s in r["sd_spans"]), len(r["sd_spans"]), r["kept_sha256"]) for r in suffixdedup.with_kept_sha256(found).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 40)


def test_repeats_are_kept_as_stretches(spark, monkeypatch):
    """Repeated places are stored packed by text and as stretches that meet, not as a row each."""
    rng, kept, stored = random.Random(6), {}, suffixdedup.stored
    monkeypatch.setattr(suffixdedup, "stored", lambda df, name, *more: kept.setdefault(name, stored(df, name, *more)))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    shared = " ".join(word() for _ in range(1500))
    texts = [f"{word()} {word()} {shared} {word()}" for _ in range(4)] + [shared[:3000] + " ".join(word() for _ in range(90))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = suffixdedup.with_kept_sha256(suffixdedup.with_spans(df)).orderBy("doc_id").collect()
    got = [(r["sd_bytes"], sum(s["stop"] - s["start"] for s in r["sd_spans"]), len(r["sd_spans"]), r["kept_sha256"]) for r in rows]
    assert got == brute_repeats(texts, 400)
    places = sum(len(suffixdedup.sample_places(len(t), 400)) for t in texts)
    settled = kept["kinds"].where(F.col("kind") == suffixdedup.SETTLED)
    assert 0 < settled.count() < places / 5 and kept["names"].agg(F.sum(F.octet_length("at")) / 12).first()[0] <= places


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    want = brute_repeats([r["text"] for r in docs], 400)
    rows = queries.op9_suffix(spark, SF).collect()
    got = {r[0]: tuple(r)[1:5] for r in rows}
    assert [got[r["doc_id"]] for r in docs] == want
    texts = [re.sub(r"[ \t\n\r\x0b\x0c]+", " ", r["text"] or "") for r in docs]
    left = brute_word_repeats([[w for w in t.split(" ") if w] for t in texts], 51)
    words = {r["doc_id"]: r["passage_words"] for r in rows}
    assert [words[r["doc_id"]] for r in docs] == [len([w for w in t.split(" ") if w]) - len(x) for t, x in zip(texts, left)]


def test_repeats_odd(spark):
    out = suffixdedup.without_repeats(odd_docs(spark))
    assert out.columns == odd_docs(spark).columns and out.count() == 9
    assert {r["text"] for r in out.collect() if r["doc_id"] in (4, 5)} == {""}
    assert suffixdedup.with_spans(no_docs(spark)).count() == 0


@pytest.mark.parametrize("words", [None, 51])
def test_cleaned_texts_can_be_used(spark, words):
    """Filters, joins and aggregates on the text that is left, which once failed for want of a place to run its function."""
    docs = odd_docs(spark)
    out = suffixdedup.without_repeats(docs, words=words)
    assert out.where("length(text) > 1").count() == 4 and out.where("text is null").count() == 1
    assert out.groupBy(F.length("text")).count().where("count > 3").count() == 1
    assert out.join(docs.select("text").distinct(), "text").count() == 8  # every cleaned text is one of the given ones here
    assert suffixdedup.without_repeats(docs.withColumn("text", F.upper("text")), words=words).where(F.col("text").contains("SOME")).select("doc_id").first()[0] is None
    assert suffixdedup.without_repeats(no_docs(spark), words=words).where("length(text) > 1").count() == 0


def brute_word_repeats(texts, words):
    split = [t.split() if isinstance(t, str) else t for t in texts]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone[i : i + words] = [True] * words
        out.append([x for x, g in zip(w, gone) if not g])
    return out


@pytest.mark.parametrize("block", [suffixdedup.BLOCK, 2])
def test_passages_of_51_words(spark, monkeypatch, block):
    monkeypatch.setattr(suffixdedup.repeated_spans, "__defaults__", tuple(block if d == suffixdedup.BLOCK else d for d in suffixdedup.repeated_spans.__defaults__))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    shared = [[word() for _ in range(n)] for n in (50, 51, 51, 52, 60)]
    texts = []
    for i in range(60):
        own = lambda: [word() for _ in range(rng.randint(0, 90))]
        texts.append(rng.choice([" ", "  ", "\n"]).join(own() + shared[i % 5] + own() + (shared[2] + shared[3] if i % 7 == 0 else [])))
    assert len(" ".join(shared[2] + shared[3])) < suffixdedup.LENGTH
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.suffix_stage(spark, df, SF).collect()}
    assert [got[i] for i in range(len(texts))] == brute_word_repeats(texts, 51)


# --- mixing ------------------------------------------------------------------------------------------------------


def brute_targets(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        for s in full or open_:
            target[s] = cap * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    return target


def test_targets(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = {rng.choice([None, "é", "Z", "a", "b1", "b10", "b2", "c", "d"]): rng.choice([0, 1, 10, 100, 5000]) for _ in range(9)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mixing_odd(spark):
    docs = odd_docs(spark)
    out = mixing.with_copies(docs)
    assert out.count() == docs.count() and out.where("mix_copies is null or mix_copies > 3 or mix_copies < 0").count() == 0
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == out.agg(F.sum("mix_copies")).first()[0]
    assert mixing.with_copies(no_docs(spark)).count() == 0 and mixing.mix(no_docs(spark)).count() == 0


# --- the queries with SQL, and the pipeline ----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    key = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert key(queries.queries()[name](spark, SF).select(*cols).collect()) == key(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality_stage(spark, docs, SF)
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs.select("doc_id").exceptAll(kept.select("doc_id")), "doc_id").count()
    assert bad <= 2 and kept.columns == docs.columns
    near = p.near_dedup_stage(spark, kept, SF)
    groups = simhash.similar_groups(kept).select("component_id").distinct().count()
    assert groups <= simhash.near_duplicates(kept).select("component_id").distinct().count()
    assert near.count() == groups and near.columns == docs.columns
    clean = p.suffix_stage(spark, near, SF)
    assert clean.count() == groups and clean.where("n_chars <> char_length(text)").count() == 0
    mixed = p.mixing_stage(spark, clean, SF).persist()
    last = p.bpe_stage(spark, mixed, SF)
    assert last.columns == [*[c for c in docs.columns if c != "text"], "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    t = packing.tokenizer(queries.vocabulary_path())
    want = {}
    for r in mixed.collect():
        want.setdefault((r["doc_id"], r["source"]), []).append(t.encode(r["text"] or "", add_special_tokens=False).ids)
    for r in last.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"], r["source"]].pop() and len(r["ids"]) == 4 * r["n_tokens"]
    assert not any(want.values())
    assert p.run(spark, SF).count() > 0


def test_training_rows_odd(spark):
    docs = odd_docs(spark).withColumn("ids", F.lit("own"))
    out = queries.training_rows(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "score", "ids", "_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.where("ids = 'own'").count() == docs.count() and out.where("n_tokens = 0 and length(_ids) = 0").count() == 2


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_results_can_be_used(spark, name):
    """Each result is filtered, aggregated and joined on each of its columns, as a user would."""
    out = queries.queries()[name](spark, SF)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    rows, last = out.count(), out.columns[-1]
    assert out.where(reduce(lambda a, b: a & b, [F.length(text(c)) > 0 for c in out.columns])).count() == rows
    counts = out.where(F.length(text(last)) > 0).groupBy(last).agg(F.count(F.lit(1)).alias("of_it"))
    joined = out.join(counts.withColumnRenamed(last, "_key"), F.col(last).eqNullSafe(F.col("_key")))
    assert joined.where("of_it > 0").count() == rows
