"""Packing, periodic runs and whitening against brute-force versions."""

import hashlib
import os
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import packing, periodic, queries, whitening

SF = os.environ.get("LLM_TEST_DATA", "/root/testdata/sf0.001")


def odd_docs(spark):
    """Nulls, empty and long texts, one huge word, special tokens, repeated rows, no ids, clashing extra columns."""
    long = " ".join(f"w{i % 977} tail{i}" for i in range(9000))
    rows = [(1, "", 5), (2, None, 5), (None, "some words here", 5), (None, "some words here", 5), (None, None, None), (4, long, None), (5, long, 1), (5, long, 1), (6, "x" * 300_000, 2), (7, "\x0b\t A\x1cB é́ 日本 x <|endoftext|>y \x0c", 0), (8, "a b " * 3000, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, pk_start int").withColumn("pr_runs", F.lit("own"))


# --- packing -----------------------------------------------------------------------------------------------------


def check_packing(rows, texts, window=4096):
    """Rows of (text number, start, length, crc, tokens, sequence, offset); texts by number, with how often they occur."""
    t = packing.tokenizer(queries.vocabulary_path())
    ids = {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for k, (x, _) in texts.items()}
    covered, sequences = defaultdict(list), defaultdict(list)
    for k, start, length, crc, tokens, sequence, offset in rows:
        assert tokens == len(ids[k]) and length > 0
        assert crc == zlib.crc32(ids[k][start : start + length].tobytes())
        covered[k].append((start, length))
        sequences[sequence].append((offset, length))
    for k, (_, times) in texts.items():
        seen = np.zeros(len(ids[k]) + 1, int)
        for start, length in covered.pop(k):
            seen[start] += 1
            seen[start + length] -= 1
        assert (np.cumsum(seen)[:-1] == times).all()
    assert not covered
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # a power of two: not padded
    return sequences


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_packing(spark, SF)
    rows = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in got.collect()]
    sequences = check_packing(rows, {r.doc_id: (r.text, 1) for r in docs})
    assert np.mean([sum(n for _, n in s) for s in sequences.values()]) > 500
    assert got.where("length > 4 and tier >= 8").groupBy("sequence_id").agg(F.countDistinct("step_group").alias("n")).where("n > 1").count() == 0


def test_packing_odd(spark):
    docs = odd_docs(spark)
    got = packing.pack_documents(docs, queries.vocabulary_path(), group_ids=9000, buckets=3)
    assert got.columns[:3] == ["doc_id", "pk_start", "pr_runs"] and "_pk_start" in got.columns
    back = defaultdict(int)
    texts = {i: [r.text, 0] for i, r in enumerate(docs.select("doc_id", "text").distinct().collect())}
    number = {(r.doc_id, r.text): i for i, r in enumerate(docs.select("doc_id", "text").distinct().collect())}
    for r in docs.collect():
        texts[number[r.doc_id, r.text]][1] += 1
    # The rows' texts aren't carried: a piece belongs to the texts with its id and number of tokens.
    t = packing.tokenizer(queries.vocabulary_path())
    by_size = {(d, len(t.encode(x or "", add_special_tokens=False).ids) + 1): i for (d, x), i in number.items()}
    rows = [(by_size[r.doc_id, r.pk_tokens], r._pk_start, r.pk_length, zlib.crc32(r.pk_ids), r.pk_tokens, r.pk_sequence, r.pk_offset) for r in got.collect()]
    check_packing(rows, {k: tuple(v) for k, v in texts.items()})
    assert back == {}
    assert got.where("pk_length > 1").groupBy("pk_tier").agg(F.sum("pk_length").alias("n")).join(spark.range(1), F.lit(True)).count() > 0  # filtered, joined, aggregated
    assert packing.pack_documents(docs.limit(0), queries.vocabulary_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, queries.vocabulary_path(), tiers=(4096, 1000))


def test_word_ids_equal_library():
    rng, t = random.Random(3), packing.tokenizer(queries.vocabulary_path())
    signs = "ab'stAB \t\n\x0b\x1c\x85  éÉ́Σσς日1²½-_.,!<|>İß힣"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>"]
    import pyarrow as pa

    ids, count = packing.WordIds(queries.vocabulary_path())(pa.array(texts, pa.large_string()))
    at = 0
    for text, n in zip(texts, count.tolist()):
        assert ids[at : at + n].tolist() == t.encode(text, add_special_tokens=False).ids, text
        at += n


def test_word_memory_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "LETTERS_HELD", 1000)
    encode, t = packing.WordIds(queries.vocabulary_path()), packing.tokenizer(queries.vocabulary_path())
    for i in range(6):
        text = " ".join(f"{'q' * 300}{i}{j} same" for j in range(3))
        ids, _ = encode(pa.array([text], pa.large_string()))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and encode.held < 2000


@pytest.mark.parametrize("seed", range(6))
def test_pack_is_full(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 4095), rng.randint(1, 600), 2048, 1]) for _ in range(rng.randint(1, 400))]
    packed = packing.pack(lengths)
    pieces = sorted((i, b, n) for size, held in packed for i, b, n in held)
    assert all(sum(n for _, _, n in held) == size and size & (size - 1) == 0 for size, held in packed)
    for i, length in enumerate(lengths):
        at = 0
        for _, b, n in [p for p in pieces if p[0] == i]:
            assert b == at
            at += n
        assert at == length
    whole = sum(1 for p in pieces if p[2] == lengths[p[0]])
    assert len(lengths) < 50 or whole / len(lengths) > 0.4  # most texts aren't cut


def test_steps_are_balanced():
    rng = random.Random(4)
    costs = [rng.uniform(1, 10) for _ in range(500)]
    of = packing.steps(costs, 7)
    sums = [sum(c for c, g in zip(costs, of) if g == k) for k in range(7)]
    assert max(sums) - min(sums) <= 10 and max(sums) < 1.02 * min(sums)


# --- periodic runs -----------------------------------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    """All maximal stretches of each period, those with a smaller period taken out."""
    n, out = len(w), set()
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                part = w[i : j + p]
                if not any(all(part[x] == part[x + q] for x in range(len(part) - q)) for q in range(1, p)):
                    out.add((i, j + p - i, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(5))
def test_runs(seed):
    rng, texts = random.Random(seed), []
    for _ in range(150):
        kinds = rng.choice([1, 2, 3, 50])
        w = [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(1, 9)
            unit = [rng.randrange(kinds) for _ in range(p)]
            w += (unit * 9)[: rng.randint(p, 9 * p)] + [rng.randrange(kinds) for _ in range(rng.randint(0, 4))]
        texts.append(np.array(w, np.int64))
    assert periodic.text_runs(texts) == [brute_runs(w.tolist()) for w in texts]


def test_runs_longer_than_a_chunk():
    w = np.concatenate([np.arange(5000), np.tile(np.arange(100, 107), 3000), [1]])
    assert periodic.text_runs([w]) == [[(5000, 21000, 7)]]
    assert periodic.text_runs([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic(spark, SF).collect()}
    assert sum(1 for r in got.values() if r[0]) > 5
    for r in docs:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text), r.doc_id


def test_periodic_odd(spark):
    docs = odd_docs(spark)
    got = periodic.collapsed(docs)
    assert got.columns == ["doc_id", "text", "pk_start", "pr_runs", "pr_words", "_pr_runs", "pr_text"]
    for r in got.collect():
        words = (r.text or "").encode().split()
        assert r.pr_words == len(words) and r.pr_runs == "own"
        if r.doc_id == 8:
            assert [tuple(x) for x in r._pr_runs] == [(0, 6000, 2)] and r.pr_text == "a b"
        else:
            assert r._pr_runs == [] and r.pr_text.encode() == b" ".join(words)
    assert got.where("length(pr_text) > 3").groupBy("pr_words").count().join(docs.select(F.lit(3).alias("pr_words")).limit(1), "pr_words").count() == 1
    assert periodic.collapsed(docs.limit(0)).count() == 0


# --- whitening ---------------------------------------------------------------------------------------------------


def brute_whitening(vectors, most=16):
    rows = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, rows)))
    n, d = len(fit), len(fit[0])
    total = [sum(r[i] for r in fit) for i in range(d)]
    centred = np.array([[(n * r[i] - total[i]) / n for i in range(d)] for r in fit])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    out = []
    for r in rows:
        c = np.array([(n * r[i] - total[i]) / n for i in range(d)])
        out.append((n, sum((n * r[i] - total[i]) ** 2 for i in range(d)), (c @ vectors_ / np.sqrt(np.abs(values)))[:most], (values / values.sum())[:most]))
    return out


def by_row(rows, key):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.component):
        out[r[key]].append(r)
    return out


def test_whitening_query(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = by_row(queries.op13_whitening(spark, SF).collect(), "vec_id")
    want = brute_whitening([v for _, v in table])
    signs = np.sign([got[table[0][0]][k].whitened * want[0][2][k] for k in range(16)])
    for (i, _), (n, deviation, white, explained) in zip(table, want):
        assert [r.component for r in got[i]] == list(range(1, 17))
        assert {(r.n, r.deviation) for r in got[i]} == {(n, deviation)}
        assert np.allclose(signs * [r.whitened for r in got[i]], white, atol=1e-7)
        assert np.allclose([r.explained for r in got[i]], explained, rtol=1e-9)
        assert got[i][0].identity_error < 1e-9


@pytest.mark.parametrize("leaf,fan", [(4096, 16), (3, 2), (1, 3)])
def test_whitening_merges(spark, leaf, fan):
    """Few vectors a leaf and deep trees give the components of one decomposition; odd rows drop out."""
    rng = np.random.default_rng(5)
    rows = [[float(x) for x in rng.normal(size=5) * [3, 1, 2, 0.5, 0]] for _ in range(40)]
    odd = [None, [], [1.0], [None] * 5, [float("nan")] * 5, [float("inf")] + [0.0] * 4]
    table = [(i, v, 1) for i, v in enumerate(rows)] + [(3, rows[3], 1)] + [(100 + i, v, None) for i, v in enumerate(odd)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>, wh_n int").repartition(3)
    got = whitening.whitened(vectors, most=4, leaf=leaf, fan=fan).withColumnRenamed("wh_component", "component").collect()
    got = by_row(got, "vec_id")
    assert set(got) == set(range(40)) and len(got[3]) == 8 and got[0][0]["wh_n"] == 1
    want = brute_whitening(rows, 4)
    signs = np.sign([got[0][k].wh_whitened * want[0][2][k] for k in range(4)])
    for i in set(range(40)) - {3}:
        assert got[i][0]["_wh_n"] == want[i][0] == 40 and got[i][0].wh_deviation == want[i][1]
        assert np.allclose(signs * [r.wh_whitened for r in got[i]], want[i][2], atol=1e-8)
        assert got[i][0].wh_identity_error < 1e-9


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(3)], "vec_id long, embedding array<float>")
    rows = whitening.whitened(same).orderBy("vec_id", "wh_component").collect()
    assert [(r.vec_id, r.wh_component, r.wh_n, r.wh_deviation, r.wh_whitened, r.wh_explained, r.wh_identity_error) for r in rows] == [(i, k, 1, 0, None, 0.0, 0.0) for i in range(3) for k in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(3)], "vec_id long, embedding array<float>")
    rows = whitening.whitened(line).where("wh_component = 2").agg(F.count("wh_whitened").alias("n"), F.max("wh_explained").alias("e")).first()
    assert (rows.n, rows.e) == (0, 0.0)
    assert whitening.whitened(same.limit(0)).count() == 0


# --- shards as files ---------------------------------------------------------------------------------------------


def test_layout_of_files(spark, tmp_path):
    """Resharding files there and back: documents stay what they are, few files are rewritten, the others aren't touched."""
    from collections import Counter

    from ledgerloom.llm import resharding

    rng = random.Random(2)
    rows = [(i if i % 7 else None, "w" * rng.choice([0, 3, 50, 400]) if i % 11 else None, i % 4, "own") for i in range(600)] + [(5, "copy " * 30, 1, "own")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, s int, rs_size string")
    at = resharding.write_layout(docs, F.col("s"), str(tmp_path / "shards"), block_rows=50, unit_bytes=2000)
    content = lambda df: Counter((r["doc_id"], r["text"], r["s"]) for r in df.collect())
    want = content(docs)
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{at}/data") for f in names if f.endswith(".parquet")}
    biggest, before = 401, files()
    assert len(before) > 20
    for shards in (7, 3):
        flows = resharding.reshard(spark, at, shards)
        out = resharding.read_layout(spark, at)
        assert content(out) == want
        held = out.groupBy("rs_shard").agg(F.sum("rs_size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("rs_slot").alias("a"), F.max("rs_slot").alias("b"), F.count_distinct("rs_slot").alias("d")).collect()
        total = sum(r.n for r in held)
        assert len(held) == shards and all(abs(r.n - total / shards) <= (shards + 4) * biggest for r in held)
        assert all(r.a == 0 and r.b == r.rows - 1 and r.d == r.rows for r in held)
        now = files()
        assert all(now[f] == t for f, t in before.items())  # nothing is overwritten
        assert 0 < len(now) - len(before) <= 2 * len(flows)
        before = now
    assert content(resharding.read_layout(spark, at, 0)) == want and resharding._complete(spark, at) == [0, 1, 2]
    moved = resharding.read_layout(spark, at).where("length(text) > 100").groupBy("rs_shard").agg(F.max("rs_slot").alias("m")).join(spark.range(3).withColumnRenamed("id", "rs_shard"), "rs_shard")
    assert moved.count() == 3


def test_columns_of_any_name(spark):
    """Names with dots, blanks and backticks come through, with their values."""
    name = "a`b.c d"
    docs = spark.createDataFrame([(i, f"some words {i} " * 3, [float(i), float(i * i)], i) for i in range(5)], ["doc_id", "text", "embedding", name])
    for out in (packing.pack_documents(docs, queries.vocabulary_path()), periodic.collapsed(docs), whitening.whitened(docs)):
        assert name in out.columns and {tuple(r) for r in out.select("doc_id", F.col("`a``b.c d`")).collect()} == {(i, i) for i in range(5)}
