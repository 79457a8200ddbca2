"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new capacities.

Old shard sizes and new capacities give a transport problem with one cost: a byte that stays is free, a byte that
moves costs one. Its solution is a short list of transfers (old shard, new shard, bytes), bounded by the numbers of
shards. Documents of an old shard are laid out in blocks, large documents first, so that what stays is the front
and what moves is the tail of small documents; a document goes where the middle of its byte interval falls, so a
transfer is off by less than one document.

``rewrite`` works on a table: only documents that move are shuffled with their texts and written; where each document
stands is a narrow table, and only one row a block is summed up over a whole shard. ``write_layout``, ``reshard`` and
``read_layout`` work on shards that are files with a manifest: a file that moves whole goes by reference, and only those cut by
a border of two transfers are rewritten.

Defined cases: a null text has size 1 (its separator byte); a null id sorts first among equals; equal texts have
equal sizes and checksums and lie side by side within their block, and a text with very many copies has many blocks;
an empty table gives an empty result; other columns are carried, and a new column whose name the table has already is
named by ``free_name``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, scratch_path, set_aside, stored

BLOCK_ROWS = 20_000


def min_cost_transfers(old: dict[int, int], capacity: dict[int, int]) -> list[tuple[int, int, int]]:
    """Transfers (from, to, bytes) of least moved bytes; capacities must sum to the old sizes.

    Keeping min(old, capacity) of every shard in place is optimal, as no flow can keep more. What is left is
    matched, largest surplus with largest need, which also gives few transfers.
    """
    if sum(old.values()) != sum(capacity.values()):
        raise ValueError("capacities must hold exactly the bytes there are")
    flows = [(s, s, min(n, capacity.get(s, 0))) for s, n in sorted(old.items()) if min(n, capacity.get(s, 0)) > 0]
    over = [(-(n - capacity.get(s, 0)), s) for s, n in old.items() if n > capacity.get(s, 0)]
    need = [(-(c - old.get(s, 0)), s) for s, c in capacity.items() if c > old.get(s, 0)]
    heapq.heapify(over)
    heapq.heapify(need)
    while over and need:
        (a, s), (b, d) = heapq.heappop(over), heapq.heappop(need)
        moved = min(-a, -b)
        flows.append((s, d, moved))
        if -a > moved:
            heapq.heappush(over, (a + moved, s))
        if -b > moved:
            heapq.heappush(need, (b + moved, d))
    return flows


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def document_size(text_col: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")


#: What a document's place is worked out from.
NARROW = ["rs_size", "rs_crc", "rs_old", "rs_block", "rs_hash", "rs_id"]
INNER = ["rs_bytes", "rs_offset", "rs_middle", "rs_firsts", "rs_row"]
ADDED = ["rs_size", "rs_crc", "rs_old", "rs_shard", "rs_slot"]


def _order() -> list[Column]:
    return [F.desc("rs_size"), F.col("rs_crc"), F.col("rs_hash"), F.col("rs_id").asc_nulls_first()]


def _sized(docs: DataFrame, old_shard: Column, id_col: str, text_col: str, block_rows: int) -> DataFrame:
    """``docs`` with each row's size, checksum, old shard and block; large documents have small block numbers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumns({"rs_size": document_size(text_col), "rs_crc": F.crc32(text.cast("binary")), "rs_old": old_shard.cast("int"), "rs_hash": F.xxhash64(text), "rs_id": F.col(id_col)})
    grade = F.floor(F.log2(F.col("rs_size").cast("double")) * 4).cast("int")
    spread = max(1, docs.count() // block_rows)
    return sized.withColumn("rs_block", (F.lit(1_000_000_000) - grade * 10_000_000 + F.pmod(F.xxhash64("rs_crc", "rs_id"), F.lit(spread))).cast("long"))


def _placed(rows: DataFrame, flows: list[tuple[int, int, int]], blocks: DataFrame) -> DataFrame:
    """Adds rs_shard: block offsets plus a running sum inside the block, cut at the flows' borders."""
    within = Window.partitionBy("rs_old", "rs_block").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("rs_offset") + F.sum("rs_size").over(within) - F.col("rs_size") / 2
    joined = rows.join(blocks, ["rs_old", "rs_block"])
    return joined.withColumn("rs_middle", middle).withColumn("rs_shard", _shard_at(flows, F.col("rs_middle"))).drop("rs_middle", "rs_offset", "rs_bytes")


def _shard_at(flows: list[tuple[int, int, int]], at: Column) -> Column:
    """The new shard of a byte of an old one."""
    cuts: dict[int, list[tuple[int, int]]] = {}
    start = dict.fromkeys([s for s, _, _ in flows], 0)
    for s, d, n in flows:
        start[s] += n
        cuts.setdefault(s, []).append((start[s], d))
    shard = F.lit(None).cast("int")
    for s, ends in cuts.items():
        inner = F.lit(ends[-1][1])
        for end, d in reversed(ends[:-1]):
            inner = F.when(at < end, F.lit(d)).otherwise(inner)
        shard = F.when(F.col("rs_old") == s, inner).otherwise(shard)
    return shard.cast("int")


class Plan:
    """The transfers, and what is needed to place any row: the blocks with their offsets and first slots."""

    def __init__(self, docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS):
        self.sized = _sized(docs, old_shard, id_col, text_col, block_rows)
        narrow = self.sized.select(*NARROW)
        before = Window.partitionBy("rs_old").orderBy("rs_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = narrow.groupBy("rs_old", "rs_block").agg(F.sum("rs_size").alias("rs_bytes"))
        self.blocks = stored(blocks.withColumn("rs_offset", F.coalesce(F.sum("rs_bytes").over(before), F.lit(0))), "blocks")
        self.old = {r[0]: r[1] for r in self.blocks.groupBy("rs_old").agg(F.sum("rs_bytes")).collect()}
        self.capacity = equal_capacities(sum(self.old.values()), shards)
        self.flows = min_cost_transfers(self.old, self.capacity)
        ahead = Window.partitionBy("rs_shard").orderBy("rs_old", "rs_block").rowsBetween(Window.unboundedPreceding, -1)
        runs = _placed(narrow, self.flows, self.blocks).groupBy("rs_shard", "rs_old", "rs_block").agg(F.count(F.lit(1)).alias("n"))
        runs = runs.withColumn("rs_first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        # One row a block with the first slots of its (few) shards: joined on the key that the rows are dealt by anyway.
        firsts = runs.groupBy("rs_old", "rs_block").agg(F.map_from_entries(F.collect_list(F.struct("rs_shard", "rs_first"))).alias("rs_firsts"))
        self.informed = stored(self.blocks.join(firsts, ["rs_old", "rs_block"]), "firsts") if self.old else self.blocks.withColumn("rs_firsts", F.create_map().cast("map<int,long>"))

    def place(self, rows: DataFrame) -> DataFrame:
        """Rows of ``self.sized`` (whole blocks of them) with rs_shard and rs_slot."""
        inside = Window.partitionBy("rs_old", "rs_block", "rs_shard").orderBy(*_order())
        placed = _placed(rows, self.flows, self.informed).withColumn("rs_row", F.row_number().over(inside))
        return placed.withColumn("rs_slot", (F.element_at("rs_firsts", F.col("rs_shard")) + F.col("rs_row") - 1).cast("long")).drop("rs_firsts", "rs_row")

    def moving(self) -> DataFrame:
        """The documents that change their shard, with all their columns. Blocks that stay whole are left out first."""
        leaves = F.exists(F.map_keys("rs_firsts"), lambda s: s != F.col("rs_old"))
        some = self.informed.where(leaves).select("rs_old", "rs_block")
        return self.place(self.sized.join(some, ["rs_old", "rs_block"], "left_semi")).where("rs_shard <> rs_old")


def plan(docs: DataFrame, old_shard: Column, shards: int, **names) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``docs`` with rs_size, rs_crc, rs_old, rs_shard and rs_slot, and the transfers solved for them."""
    docs, put_back = set_aside(docs, [*NARROW, *ADDED, *INNER])
    p = Plan(docs, old_shard, shards, **names)
    return put_back(p.place(p.sized).drop("rs_block", "rs_hash", "rs_id")), p.flows


def rewrite(docs: DataFrame, old_shard: Column, shards: int, path: str | None = None, **names) -> tuple[DataFrame, str]:
    """Write the documents that move (one folder a new shard, ``rs_shard=N``) and return all documents, with the path.

    Moved documents are read back; those that stay come from ``docs`` with their new slots, and their texts are shuffled
    only for a reader that asks for them.
    """
    path = path or scratch_path(docs.sparkSession, "shards")
    docs, put_back = set_aside(docs, [*NARROW, *ADDED, *INNER])
    p = Plan(docs, old_shard, shards, **names)
    every = p.place(p.sized).drop("rs_block", "rs_hash", "rs_id")
    if all(s == d for s, d, _ in p.flows):
        return put_back(every), path
    moving = p.moving().drop("rs_block", "rs_hash", "rs_id")
    moving.write.partitionBy("rs_shard").parquet(path)
    read = docs.sparkSession.read.schema(moving.schema).parquet(path)
    return put_back(read.unionByName(every.where("rs_shard = rs_old"))), path


# --- shards as files --------------------------------------------------------------------------------------------

#: Bytes of text in one file of a layout.
UNIT_BYTES = 128 << 20
MANIFEST = "shard int, rs_unit long, rows long, bytes long, offset long, first long"
KEPT = ["rs_size", "rs_crc", "rs_hash"]


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of manifests that were written to their end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{n}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and done(n))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A layout's files: their shard, unit, rows, bytes, offset in the shard and first slot. The latest version if none is named."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{_complete(spark, path)[-1] if version is None else version}")


def _units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")


def _written(docs: DataFrame, path: str, version: int) -> DataFrame:
    """Write rows (with rs_unit) as one file a unit, and say what each holds."""
    docs.withColumn("rs_version", F.lit(version)).repartition("rs_unit").write.mode("append").partitionBy("rs_version", "rs_unit").parquet(f"{path}/data")
    own = _units(docs.sparkSession, path).where(F.col("rs_version") == version)
    return own.groupBy(F.col("rs_unit").cast("long").alias("rs_unit")).agg(F.count(F.lit(1)).alias("rows"), F.sum("rs_size").alias("bytes"))


def _put(files: DataFrame, path: str, version: int) -> None:
    """Write (shard, rs_unit, rows, bytes) as a manifest; units follow each other in a shard by their numbers."""
    before = Window.partitionBy("shard").orderBy("rs_unit").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"offset": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "first": F.coalesce(F.sum("rows").over(before), F.lit(0))}
    files.withColumns(sums).select("shard", "rs_unit", "rows", "bytes", "offset", "first").write.parquet(f"{path}/manifests/{version}")


def write_layout(docs: DataFrame, shard: Column, path: str, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, unit_bytes: int = UNIT_BYTES) -> str:
    """Write documents as shards of files, each some ``unit_bytes`` of neighbouring blocks, with their manifest."""
    docs, _ = set_aside(docs, [*NARROW, *ADDED, *INNER, "rs_unit", "rs_version"])
    sized = _sized(docs, F.coalesce(shard.cast("int"), F.lit(0)), id_col, text_col, block_rows)
    before = Window.partitionBy("rs_old").orderBy("rs_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy("rs_old", "rs_block").agg(F.sum("rs_size").alias("bytes")).withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    units = stored(blocks.select("rs_old", "rs_block", (F.shiftleft(F.col("rs_old").cast("long"), 32) + F.floor(F.col("at") / unit_bytes)).alias("rs_unit")), "units")
    dealt = join_small(sized, units, ["rs_old", "rs_block"], "inner", units.count()).drop("rs_block", "rs_id", "rs_old")
    files = _written(dealt, path, 0)
    _put(files.select(F.shiftright("rs_unit", 32).cast("int").alias("shard"), "rs_unit", "rows", "bytes"), path, 0)
    return path


def reshard(spark: SparkSession, path: str, shards: int, id_col: str = "doc_id") -> list[tuple[int, int, int]]:
    """A new version of a layout with so many shards, and its transfers.

    Sizes come from the manifest. A file that lies within one transfer goes to its shard by reference, without being read;
    only those that a border of transfers cuts, at most one a transfer, are read and rewritten, one file a part. The new manifest
    stands when it is complete; the version before it stays readable.
    """
    last = _complete(spark, path)[-1]
    old = stored(manifest(spark, path, last), "manifest")
    sizes = {r[0]: r[1] for r in old.groupBy("shard").agg(F.sum("bytes")).collect()}
    flows = min_cost_transfers(sizes, equal_capacities(sum(sizes.values()), shards))
    at = old.withColumn("rs_old", F.col("shard"))
    ends = at.withColumns({"low": _shard_at(flows, F.col("offset") + 0.25), "high": _shard_at(flows, F.col("offset") + F.col("bytes") - 0.25)})
    ends = stored(ends, "ends")
    whole = ends.where("low = high").select(F.col("low").alias("shard"), "rs_unit", "rows", "bytes")
    cut = ends.where("low <> high").select("rs_unit", "rs_old", "offset")
    rows = _units(spark, path).withColumn("rs_unit", F.col("rs_unit").cast("long")).withColumn("rs_id", F.col(id_col))
    some = [r[0] for r in cut.select("rs_unit").collect()]  # as many as there are borders at most
    rows = rows.where(F.col("rs_unit").isin(some)).join(F.broadcast(cut), "rs_unit")
    within = Window.partitionBy("rs_unit").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to = _shard_at(flows, F.col("offset") + F.sum("rs_size").over(within) - F.col("rs_size") / 2)
    parts = rows.withColumn("to", to)
    # New units stand behind all others of their new shard: numbers above those in use, by version.
    names = {(u, d): n for n, (u, d) in enumerate(sorted((r[0], r[1]) for r in parts.select("rs_unit", "to").distinct().collect()))}
    number = F.lit(None).cast("long")
    for (u, d), n in names.items():
        number = F.when((F.col("rs_unit") == u) & (F.col("to") == d), F.lit((1 << 56) + ((last + 1) << 40) + n)).otherwise(number)
    files = whole
    if names:
        new = parts.withColumn("_new", number).drop("rs_unit", "rs_old", "offset", "rs_id", "to", "rs_version").withColumnRenamed("_new", "rs_unit")
        shard_of = spark.createDataFrame([((1 << 56) + ((last + 1) << 40) + n, d) for (_, d), n in names.items()], "rs_unit long, shard int")
        files = whole.unionByName(_written(new, path, last + 1).join(F.broadcast(shard_of), "rs_unit").select("shard", "rs_unit", "rows", "bytes"))
    _put(files, path, last + 1)
    return flows


def read_layout(spark: SparkSession, path: str, version: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """All documents of a version with rs_size, rs_crc, rs_shard and rs_slot; slots follow the files of a shard."""
    files = manifest(spark, path, version).select("rs_unit", F.col("shard").alias("rs_shard"), "first")
    rows = _units(spark, path).withColumn("rs_unit", F.col("rs_unit").cast("long")).withColumn("rs_id", F.col(id_col))
    inside = Window.partitionBy("rs_unit").orderBy(*_order())
    placed = rows.join(files, "rs_unit").withColumn("rs_slot", (F.col("first") + F.row_number().over(inside) - 1).cast("long"))
    return placed.drop("rs_unit", "rs_version", "rs_id", "rs_hash", "first")
