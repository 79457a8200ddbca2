"""Helpers shared by the training-data operators: scratch space, columns, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows in one Arrow batch; texts can be long, so batches stay small.
ARROW_ROWS = 1000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt-"))
        root = jsc.getCheckpointDir().get()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: smaller than a checkpoint for many rows."""
    spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    del df  # else its shuffles would count as held
    _clean_up(spark)
    return spark.read.schema(schema).parquet(path)


def _clean_up(spark: SparkSession) -> None:
    """Spark drops shuffle files when their tables are no longer held; let both sides notice now rather than late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Give memory back to the system: Python workers are kept for later tasks, and idle ones would hold on to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidying(f):
    """A function over a task's batches that tidies up when the task is done."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def map_in_arrow(df: DataFrame, f, schema: StructType) -> DataFrame:
    """``df.mapInArrow``, for columns of any names: Spark's own takes names with dots or backticks apart."""
    names, made = df.columns, [f"c{i}" for i in range(len(schema.fields))]
    plain = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns(names))])

    def run(batches):
        for b in f(b.rename_columns(names) for b in batches):
            yield b.rename_columns(made)

    fields = [StructField(n, x.dataType, x.nullable) for n, x in zip(made, schema.fields)]
    return plain.mapInArrow(run, StructType(fields)).toDF(*schema.names)


def series_udf(f, returns: str):
    """A pandas UDF of one column, by batches, that tidies up when the task is done."""

    def run(batches):
        for b in batches:
            yield f(b)

    return F.pandas_udf(tidying(run), returns, F.PandasUDFType.SCALAR_ITER)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def columns(names: list[str]) -> list[Column]:
    """Columns by their names, whatever signs these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of these names (in any case) renamed, and a function that gives them their names back; a
    new column of such a name is then called what ``free_name`` says."""
    wanted = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in wanted]
    aside = {}
    for c in clash:
        aside[c] = free_name(df, f"aside_{c}")
        df = df.withColumnRenamed(c, aside[c])

    def put_back(out: DataFrame) -> DataFrame:
        taken = {c.lower() for c in clash}
        kept = {v: k for k, v in aside.items()}
        named = []
        for c in out.columns:
            new = kept.get(c, c)
            while c not in kept and new.lower() in taken:
                new = f"_{new}"
            named.append(columns([c])[0].alias(new))
        return out.select(*named) if clash else out

    return df, put_back


def unit_hash(seed: int, *cols: str) -> Column:
    """A number in [0, 1) fixed by the seed and the columns' values (52 bits of an MD5)."""
    key = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def bounded_sample(ids: DataFrame, id_col: str, most: int) -> Column:
    """A condition that holds for at most ``most`` rows of ``ids`` (and their ties), chosen by a checksum of their ids."""
    mark = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    last = ids.select(mark.alias("m")).orderBy("m").limit(most).agg(F.max("m"), F.count(F.lit(1))).first()
    return F.lit(True) if last[1] < most else mark <= F.lit(last[0])


def join_small(left: DataFrame, right: DataFrame, on, how: str, right_rows: int, limit: int = 2_000_000) -> DataFrame:
    """Join with a broadcast only if ``right`` has at most ``limit`` narrow rows; else let Spark shuffle."""
    return left.join(F.broadcast(right) if right_rows <= limit else right, on, how)
