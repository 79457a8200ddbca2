"""Exact top-k search by a three-phase uniform threshold.

The components of the vectors are dealt into ``LISTS`` lists (component i to list i modulo ``LISTS``); the score of a
query and a candidate is the sum of their local scores, one from each list. Vectors are packed into blocks, and each
list of a block of queries and a block of candidates is a task of its own:

1. Each list gives up its best ``DEPTH`` x k local scores of a query. Their candidates' whole scores are looked up; the
   k-th best of them is a cutoff that the true k-th score can't be under.
2. The cutoff is sent to all lists. An entry that reaches it has at least cutoff / ``LISTS`` in one list, so each list
   gives up the entries from there on with their local scores, and nothing else.
3. The local scores that are still missing for those entries are looked up, sums under the cutoff go, and the best k of
   each block are merged, ``ARITY`` blocks at a time.

Queries and candidates meet block by block; no side is broadcast, and no row of a table holds more than a block's share.

Defined cases: vectors that are null, or hold a null or non-finite component, or no component, take no part; neither do
rows with a null id. Of vectors of different lengths the components that both have are multiplied. A query doesn't meet
rows with its own id; ties go to the smaller id; rows that repeat an id count as one if equal, else each is a candidate
and, where the id is asked, a query; components and scores beyond 64 bits are held at their limits; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LISTS = 2
#: Each list's share of the first phase, in multiples of k.
DEPTH = 8
#: Vectors of 64 components in a block of candidates and of queries; of longer ones there are fewer.
BLOCK = 4096
QUERY_BLOCK = 1024
USUAL = 64
#: Blocks whose best entries one task merges, and queries that are multiplied with a block at a time.
ARITY, AT_ONCE = 32, 256
_ENTRY = np.dtype([("q", "<i4"), ("c", "<i8"), ("s", "<i8")])
_NONE = np.iinfo(np.int64).min


def quantise(col: str = "embedding", scale: float = 64.0) -> Column:
    """floor(scale * x) for each component, x as double; null for a vector that can't take part."""
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    fine = F.coalesce(F.forall(F.col(col), finite), F.lit(False))  # empty, null and non-finite vectors fail
    return F.when(fine & (F.size(col) > 0), F.transform(F.col(col), lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(row, first: int = 0, step: int = 1) -> np.ndarray:
    return np.frombuffer(row["m"], np.int64).reshape(int(row["n"]), -1)[:, first::step]


def _local(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Local scores (queries x candidates); doubles hold the sums exactly below 2**53, else integers do."""
    w = min(q.shape[1], c.shape[1])
    q, c = q[:, :w], c[:, :w]
    kind = _kind(q, c)
    return _limited(q.astype(kind) @ c.astype(kind).T)


def _kind(q: np.ndarray, c: np.ndarray):
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return np.float64 if most(q) * most(c) * max(q.shape[1], 1) < 2**52 else object


def _limited(s: np.ndarray) -> np.ndarray:
    return s.astype(np.int64) if s.dtype != object else np.clip(s, _NONE + 1, -_NONE - 1).astype(np.int64)


def _of_pairs(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs (i, j) alone."""
    w, out = min(q.shape[1], c.shape[1]), np.zeros(len(i), np.int64)
    kind = _kind(q, c)
    for at in range(0, len(i), 50_000):
        part = slice(at, at + 50_000)
        out[part] = _limited((q[i[part], :w].astype(kind) * c[j[part], :w].astype(kind)).sum(axis=1))
    return out


def _entries(q, c, s) -> np.ndarray:
    out = np.empty(len(q), _ENTRY)
    out["q"], out["c"], out["s"] = q, c, s
    return out


def _read(blobs) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, _ENTRY) for b in blobs] or [np.empty(0, _ENTRY)])


def _best(e: np.ndarray, k: int) -> np.ndarray:
    """The k best entries of each query, ties to the smaller candidate."""
    e = e[np.lexsort((e["c"], -e["s"], e["q"]))]
    first = np.concatenate([[True], e["q"][1:] != e["q"][:-1]]) if len(e) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(e)), 0)) if len(e) else np.zeros(0, np.int64)
    return e[np.arange(len(e)) - start < k]


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    width = max(map(len, rows["v"]))
    m = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows["v"]):
        m[i, : len(v)] = v
    return pd.DataFrame({"b": rows["b"].iloc[:1], "n": [len(rows)], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` (id, v) packed into blocks of about ``size`` usual vectors, and the number of blocks. Long vectors stand with long ones."""
    grade = F.ceil(F.log2(F.size("v").cast("double"))).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(grade.alias("g")).count().collect()}  # at most 32 rows
    number, blocks = F.lit(0), 0
    for g, n in sorted(counts.items()):
        own = max(1, math.ceil(n * 2**g / (size * USUAL)))
        number = F.when(grade == g, F.pmod(F.xxhash64("id", "v"), F.lit(own)) + blocks).otherwise(number)
        blocks += own
    return stored(rows.withColumn("b", number.cast("int")).groupBy("b").applyInPandas(_pack, "b int, n int, ids binary, m binary"), name), blocks


def _first_phase(depth: int):
    def run(key, queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(cands):
            return pd.DataFrame(columns=["qb", "g", "cb", "e"])
        qrow, crow, g = queries.iloc[0], cands.iloc[0], int(key[2])
        q, c = _matrix(qrow, g, LISTS), _matrix(crow, g, LISTS)
        qid, cid, out = np.frombuffer(qrow["ids"], np.int64), np.frombuffer(crow["ids"], np.int64), []
        for i in range(0, len(q), AT_ONCE):
            s = _local(q[i : i + AT_ONCE], c)
            s[qid[i : i + AT_ONCE, None] == cid] = _NONE
            n = min(depth, len(c))
            at = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(c) else np.broadcast_to(np.arange(n), s.shape)
            e = _entries(np.repeat(np.arange(i, i + len(s)), n), (int(key[1]) << 32) + at.ravel(), np.take_along_axis(s, at, 1).ravel())
            out.append(e[e["s"] > _NONE].tobytes())
        return pd.DataFrame({"qb": [key[0]], "g": [g], "cb": [key[1]], "e": [b"".join(out)]})

    return run


def _merge(k: int, by: list[str]):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [x] for c, x in zip([*by, "cb"], key)}, "e": [_best(_read(rows["e"]), k).tobytes()]})

    return run


def _merged(best: DataFrame, by: list[str], blocks: int, k: int) -> DataFrame:
    while blocks > 1:
        best = best.withColumn("cb", F.floor(F.col("cb") / ARITY).cast("int")).groupBy(*by, "cb").applyInPandas(_merge(k, by), best.schema)
        blocks = -(-blocks // ARITY)
    return best


def _asked(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The different entries of all lists of a block of queries, by the block of their candidates."""
    e = _read(rows["e"])
    e["s"] = 0
    e = np.unique(e)
    e = e[np.argsort(e["c"], kind="stable")]
    block = e["c"] >> 32
    at = np.concatenate([[0], np.nonzero(block[1:] != block[:-1])[0] + 1]) if len(e) else np.zeros(0, np.int64)
    return pd.DataFrame({"qb": np.full(len(at), key[0], np.int32), "cb": block[at].astype(np.int32), "e": [x.tobytes() for x in np.split(e, at[1:])] if len(at) else []})


def _looked_up(key, asked: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
    if not len(asked) or not len(cands):
        return pd.DataFrame(columns=["qb", "e"])
    e = _read(asked["e"])
    e["s"] = _of_pairs(_matrix(asked.iloc[0]), _matrix(cands.iloc[0]), e["q"], e["c"] & 0xFFFFFFFF)
    return pd.DataFrame({"qb": [key[0]], "e": [e.tobytes()]})


def _cutoffs(k: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        e = _best(_read(rows["e"]), k)
        n = np.bincount(e["q"], minlength=1)
        last = np.cumsum(n) - 1
        return pd.DataFrame({"qb": [key[0]], "cut": [np.where(n == k, e["s"][np.maximum(last, 0)] if len(e) else 0, _NONE).astype(np.int64).tobytes()]})

    return run


def _cuts_of(row) -> np.ndarray:
    """The cutoff of each query of a block; queries at the end that found nothing have none."""
    out = np.full(int(row["n"]), _NONE, np.int64)
    known = np.frombuffer(row["cut"] or b"", np.int64)
    out[: len(known)] = known
    return out


def _second_phase(key, queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
    if not len(queries) or not len(cands):
        return pd.DataFrame(columns=["qb", "cb", "g", "e"])
    qrow, crow, g = queries.iloc[0], cands.iloc[0], int(key[2])
    q, c, least = _matrix(qrow, g, LISTS), _matrix(crow, g, LISTS), _cuts_of(qrow)
    # s >= cutoff / LISTS, in whole numbers; lists of queries without a cutoff give up everything.
    least = np.where(least == _NONE, _NONE, -(-least // LISTS))
    qid, cid, out = np.frombuffer(qrow["ids"], np.int64), np.frombuffer(crow["ids"], np.int64), []
    for i in range(0, len(q), AT_ONCE):
        s = _local(q[i : i + AT_ONCE], c)
        x, y = np.nonzero((s >= least[i : i + AT_ONCE, None]) & (qid[i : i + AT_ONCE, None] != cid))
        out.append(_entries(x + i, y, s[x, y]).tobytes())
    return pd.DataFrame({"qb": [key[0]], "cb": [key[1]], "g": [g], "e": [b"".join(out)]})


def _third_phase(k: int):
    def run(key, left: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        queries, lists = left[left["g"] < 0], {int(g): np.frombuffer(e, _ENTRY) for g, e in left.loc[left["g"] >= 0, ["g", "e"]].itertuples(index=False)}
        if not len(queries) or not len(cands) or not lists:
            return pd.DataFrame(columns=["qb", "cb", "e"])
        qrow, crow = queries.iloc[0], cands.iloc[0]
        q, c, least, cid = _matrix(qrow), _matrix(crow), _cuts_of(qrow), np.frombuffer(crow["ids"], np.int64)
        of = {g: e["q"].astype(np.int64) * len(c) + e["c"] for g, e in lists.items()}
        every = np.unique(np.concatenate(list(of.values())))
        i, j = every // len(c), every % len(c)
        local = np.zeros((LISTS, len(every)), np.int64)
        for g in range(LISTS):
            missing = np.ones(len(every), bool)
            if g in of:
                at = np.searchsorted(every, of[g])
                missing[at] = False
                local[g, at] = lists[g]["s"]
            local[g, missing] = _of_pairs(q[:, g::LISTS], c[:, g::LISTS], i[missing], j[missing])
        large = np.abs(local.astype(float)).sum(axis=0).max(initial=0) >= 2**62
        total = _limited(local.astype(object if large else np.int64).sum(axis=0))
        enough = total >= least[i]
        return pd.DataFrame({"qb": [key[0]], "cb": [key[1]], "e": [_best(_entries(i[enough], cid[j[enough]], total[enough]), k).tobytes()]})

    return run


def _rows(key, left: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    e, qid = _read(left["e"]), np.frombuffer(queries["ids"].iloc[0], np.int64)
    first = np.concatenate([[True], e["q"][1:] != e["q"][:-1]]) if len(e) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(e)), 0)) if len(e) else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": qid[e["q"]], "rank": (np.arange(len(e)) - start + 1).astype(np.int32), "vec_id": e["c"], "score": e["s"]})


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "v", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query row among all rows of integer vectors."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null and size(v) > 0").distinct()
    cands, n_cands = _blocks(base.select("id", "v"), block, "candidates")
    queries, n_queries = _blocks(base.where("q").select("id", "v"), query_block, "queries")
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides stem from one table
    meet = lambda left, right, by, work, shape: fresh(left).groupBy(*by).cogroup(fresh(right).groupBy(*by)).applyInPandas(work, shape)
    asks, whole = queries.withColumnRenamed("b", "qb"), cands.withColumnRenamed("b", "cb").withColumn("qb", each(n_queries))
    lists, meeting = whole.withColumn("g", each(LISTS)), ["qb", "cb"]
    spread = lambda df: df.withColumn("cb", each(n_cands))
    best = meet(spread(asks).withColumn("g", each(LISTS)), lists, [*meeting, "g"], _first_phase(DEPTH * k), "qb int, g int, cb int, e binary")
    asked = _merged(best, ["qb", "g"], n_cands, DEPTH * k).groupBy("qb").applyInPandas(_asked, "qb int, cb int, e binary")
    scored = meet(asked.join(asks, "qb"), whole, meeting, _looked_up, "qb int, e binary")
    cuts = stored(scored.groupBy("qb").applyInPandas(_cutoffs(k), "qb int, cut binary"), "cutoffs")
    informed = spread(asks.join(cuts, "qb", "left"))
    found = meet(informed.withColumn("g", each(LISTS)), lists, [*meeting, "g"], _second_phase, "qb int, cb int, g int, e binary")
    left = informed.withColumns({"g": F.lit(-1), "e": F.lit(None).cast("binary")}).unionByName(found, allowMissingColumns=True)
    top = meet(left, whole, meeting, _third_phase(k), "qb int, cb int, e binary")
    return meet(_merged(top, ["qb"], n_cands, k), asks, ["qb"], _rows, "query_id long, rank int, vec_id long, score long")
