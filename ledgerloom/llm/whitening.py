"""Whitening by hierarchical merging of singular value decompositions.

Vectors become integers; each distinct one counts once. A leaf holds some thousand of them: their number, their exact
sum, and singular values and right vectors of the rows less their mean. Two nodes are merged by stacking both
``s * Vt`` and one row for the distance of their means, sqrt(n1 n2 / (n1 + n2)) * (m1 - m2), and decomposing that
again; all dimensions are kept, so nothing is lost but rounding. Nodes are merged sixteen at a time, level by level, until one
is left: its right vectors are the components, its squared singular values over n their variances. No matrix of
products is ever made, and means are taken off as exact fractions, so a large offset costs no digits.

The mean of means is exact as sums are integers. A second pass over the distinct vectors measures how far the whitened
ones are from unit covariance.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors whose length
is not the most frequent one (of equally frequent ones the longest); repeated rows are all returned; components without variance
(up to rounding: a singular value under ``RANK`` of the largest) have null whitened values and explain 0; if no
component has any, the identity error is 0; components beyond the dimension do not exist; an empty table gives an empty
result. Integers of up to 9e15 in sums and 9e18 in deviations fit; beyond, the task fails instead of wrapping. Columns of the
table are carried to each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import columns, map_in_arrow, scratch_root, set_aside, small_batches, stored, tidying

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Vectors of a leaf, and nodes merged at once.
LEAF, FAN = 4096, 16
RANK = 1e-12

NODE = "part long, node long, n long, total array<long>, factor binary"
NEW = ["wh_x", "wh_component", "wh_n", "wh_deviation", "wh_whitened", "wh_explained", "wh_identity_error"]


def integers(vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry as double; null unless all entries are there and finite."""
    v = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    whole = F.transform(v, lambda c: (F.floor(F.lit(float(scale)) * c.cast("double")) + offset).cast("long"))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: F.coalesce(bad(c), F.lit(True))), whole)


def _factor(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors of a matrix, as many as it has dimensions at most."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Rows less their mean, the whole numbers of it taken off before anything is rounded."""
    whole = [t // n for t in total]
    rest = np.array([(t - w * n) / n for t, w in zip(total, whole)])
    return (x - np.array(whole, np.int64)).astype(np.float64) - rest


def _leaf(x: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    total = [int(t) for t in x.sum(axis=0, dtype=np.int64)]
    return len(x), total, _factor(_centred(x, len(x), total))


def merge(a: tuple[int, list[int], np.ndarray], b: tuple[int, list[int], np.ndarray]) -> tuple[int, list[int], np.ndarray]:
    """Two nodes as one. The distance of the means is a fraction of integers, so exact before it is rounded."""
    (n, s, f), (m, t, g) = a, b
    apart = np.array([(x * m - y * n) / (n * m) for x, y in zip(s, t)])
    return n + m, [x + y for x, y in zip(s, t)], _factor(np.vstack([f, g, np.sqrt(n * m / (n + m)) * apart]))


def _row(part: int, node: int, made: tuple[int, list[int], np.ndarray]) -> dict:
    return {"part": part, "node": node, "n": made[0], "total": made[1], "factor": made[2].astype("<f8").tobytes()}


def _node(r) -> tuple[int, list[int], np.ndarray]:
    return int(r["n"]), [int(t) for t in r["total"]], np.frombuffer(r["factor"], "<f8").reshape(-1, len(r["total"]))


def _matrix(col: pa.Array, kind=np.int64) -> np.ndarray:
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(col), -1).astype(kind)


def _leaves(leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows, k = TaskContext.get().partitionId(), [], 0, 0
        schema = pa.schema([("part", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("factor", pa.binary())])

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_row(part, k, _leaf(np.concatenate(held)))], schema=schema)

        for b in batches:
            if b.num_rows:
                held.append(_matrix(b.column(0)))
                rows += b.num_rows
            if rows >= leaf:
                yield made()
                held, rows, k = [], 0, k + 1
        if held:
            yield made()

    return run


def decompose(distinct: DataFrame, leaf: int = LEAF, fan: int = FAN) -> tuple[int, list[int], np.ndarray] | None:
    """Number, exact sum and factor of all rows of ``distinct`` (one column, arrays of longs of one length).

    Levels are written one after the other; only the last node, whose size follows from the dimension alone, is read here.
    """

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        made = None
        for r in rows.sort_values(["part", "node"]).to_dict("records"):
            made = _node(r) if made is None else merge(made, _node(r))
        return pd.DataFrame([_row(int(rows["to_part"].iloc[0]), int(rows["to_node"].iloc[0]), made)])

    nodes = stored(distinct.mapInArrow(tidying(_leaves(leaf)), NODE), "whitening-leaves")
    parts, longest = nodes.agg(F.max("part") + 1, F.max("node") + 1).first()
    if parts is None:
        return None
    while parts > 1 or longest > 1:  # within each part first, then the parts
        by = [F.col("part"), F.floor(F.col("node") / fan).cast("long")] if longest > 1 else [F.floor(F.col("part") / fan).cast("long"), F.lit(0).cast("long")]
        to = dict(zip(["to_part", "to_node"], by))
        nodes = stored(nodes.withColumns(to).groupBy(*to).applyInPandas(up, NODE), "whitening-level")
        parts, longest = (parts, -(-longest // fan)) if longest > 1 else (-(-parts // fan), 1)
    return _node(nodes.first().asDict())


class Whitening:
    """The fitted components: n, exact sum, unit vectors (rows), variances, and the share of the total variance of each."""

    def __init__(self, n: int, total: list[int], factor: np.ndarray, most: int = COMPONENTS):
        _, s, vt = np.linalg.svd(factor, full_matrices=True)
        values = np.zeros(len(total))
        values[: len(s)] = s * s / n
        self.n, self.total, self.dimension = n, total, len(total)
        self.vectors, self.variances = vt[:most], values[:most]
        self.usable = np.sqrt(self.variances) > RANK * np.sqrt(values[0]) if values[0] > 0 else np.zeros(len(self.variances), bool)
        self.explained = np.where(self.usable, self.variances / values.sum(), 0.0) if values.sum() > 0 else np.zeros(len(self.variances))

    @classmethod
    def fit(cls, distinct: DataFrame, most: int = COMPONENTS, leaf: int = LEAF, fan: int = FAN) -> "Whitening | None":
        node = decompose(distinct, leaf, fan)
        return None if node is None else cls(*node, most)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer rows; nan where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = _centred(x, self.n, self.total) @ self.vectors.T / np.sqrt(self.variances)
        out[:, ~self.usable] = np.nan
        return out

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of (n * x - total) squared, worked out in 64 bits if they surely fit, else in Python's integers."""
        away = x.astype(object) * self.n - np.array(self.total, object) if self.n * int(np.abs(x).max(initial=0)) >= 2**62 else x * self.n - np.array(self.total, np.int64)
        most = max(abs(int(away.max(initial=0))), abs(int(away.min(initial=0))))
        if most * most * self.dimension >= 2**63:
            away = away.astype(object)
        return (away * away).sum(axis=1)

    def identity_error(self, distinct: DataFrame) -> float:
        """Largest absolute entry of the whitened rows' covariance less the identity, measured over all distinct rows.

        Tasks send sums of values and of products; the mean is 0 but for rounding, and its square is taken off."""
        k = int(self.usable.sum())
        if not k:
            return 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, products = np.zeros(k), np.zeros((k, k))
            for b in batches:
                if b.num_rows:
                    y = self.whiten(_matrix(b.column(0)))[:, self.usable]
                    sums, products = sums + y.sum(axis=0), products + y.T @ y
            at = np.arange(k * k + k)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate([products.ravel(), sums]))], ["at", "value"])

        got = dict(distinct.mapInArrow(tidying(run), "at int, value double").groupBy("at").agg(F.sum("value")).collect())
        flat = np.array([got[i] for i in range(k * k + k)]) / self.n
        return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(flat[k * k :], flat[k * k :]) - np.eye(k)).max())


def whitened(vectors: DataFrame, vector: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row for each row of ``vectors`` that takes part and each component: its columns, and wh_component (from 1), wh_n
    (fitted vectors), wh_deviation, wh_whitened, wh_explained, wh_identity_error."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch_root(spark)
    vectors, put_back = set_aside(vectors, NEW)
    kept = vectors.columns
    ready = vectors.withColumn("wh_x", integers(vector, scale, offset)).where(F.col("wh_x").isNotNull())
    common = ready.groupBy(F.size("wh_x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = common["size"] if common else 0
    ready = ready.where(F.size("wh_x") == width)
    distinct = stored(ready.select("wh_x").distinct(), "whitening-vectors")
    model = Whitening.fit(distinct, most, leaf, fan)
    fields = [StructField("wh_component", IntegerType()), StructField("wh_n", LongType()), StructField("wh_deviation", LongType()), *[StructField(c, DoubleType()) for c in ("wh_whitened", "wh_explained", "wh_identity_error")]]
    schema = StructType([*vectors.schema.fields, *fields])
    if model is None:
        return put_back(spark.createDataFrame([], schema))
    error = model.identity_error(distinct)
    found = ArrayType(StructType([StructField("component", IntegerType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType())]))

    made_of = StructType([*vectors.schema.fields, StructField("wh_deviation", LongType()), StructField("wh_values", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, k = to_arrow_schema(made_of), len(model.variances)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("wh_x"))
            y = model.whiten(x).ravel()
            lists = pa.StructArray.from_arrays(
                [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(y, pa.float64(), from_pandas=True), pa.array(np.tile(model.explained, len(x)))], ["component", "whitened", "explained"]
            )
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), lists)
            made = [*b.select(kept).columns, pa.array([int(d) for d in model.deviation(x)], pa.int64()), values]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(made, arrow.types)], schema=arrow)

    out = map_in_arrow(ready, tidying(run), made_of)
    value = F.col("wh_value")
    return put_back(
        out.withColumn("wh_value", F.explode("wh_values")).select(
            *columns(kept), value["component"].alias("wh_component"), F.lit(model.n).cast("long").alias("wh_n"), "wh_deviation", value["whitened"].alias("wh_whitened"), value["explained"].alias("wh_explained"), F.lit(error).alias("wh_identity_error")
        )
    )
