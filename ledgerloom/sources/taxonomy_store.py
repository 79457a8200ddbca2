"""Compiled taxonomies on disk: parsed parts by the digest of their document, and manifests that say what is current.

``compile`` parses only documents whose digest isn't stored yet and appends their parts as a generation of its own; parts
that are there are never rewritten. Then a manifest is written (uri, digest) with the next number. A manifest
counts once its writer has marked it complete, so readers see the old or the new one; of two compilers that race, the
later number wins, and a failed one leaves parts that the next one uses or ignores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import PARTS, parse

PARTS_AT, MANIFESTS = "parts", "manifests"


def _folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of complete manifests, rising."""
    names = _folder(spark, f"{path}/{MANIFESTS}")
    return sorted(int(n) for n in names if n.isdigit() and "_SUCCESS" in _folder(spark, f"{path}/{MANIFESTS}/{n}"))


def _digested(documents: DataFrame) -> DataFrame:
    return documents.select("uri", "text", F.sha2(F.concat_ws("\x1f", "uri", F.coalesce("text", F.lit(""))), 256).alias("digest"))


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    known = versions(spark, path)
    if not known and version is None:
        return spark.createDataFrame([], "uri string, digest string, generation long")
    if version is not None and version not in known:
        raise ValueError(f"there is no version {version} of {path}")
    return spark.read.schema("uri string, digest string, generation long").parquet(f"{path}/{MANIFESTS}/{version if version is not None else known[-1]}")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """(digest, generation) of all parts that any complete manifest names."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], "digest string, generation long")
    every = spark.read.schema("uri string, digest string, generation long").parquet(*[f"{path}/{MANIFESTS}/{n}" for n in known])
    return every.groupBy("digest").agg(F.min("generation").alias("generation"))


def compile(documents: DataFrame, path: str, replace: bool = False) -> int:
    """Bring the store up to the documents (uri, text) and return the version's number. Documents that aren't given stay, or
    go with ``replace``. The last of several rows with one uri, by digest, counts."""
    spark = documents.sparkSession
    known = versions(spark, path)
    number = (max(int(n) for n in [*_folder(spark, f"{path}/{MANIFESTS}"), "-1"] if n.lstrip("-").isdigit())) + 1
    given = _digested(documents).groupBy("uri").agg(F.max_by("text", "digest").alias("text"), F.max("digest").alias("digest"))
    stored = _stored(spark, path)
    new = given.join(stored.select("digest"), "digest", "left_anti")
    digest_of = new.select("uri", "digest")
    parts = parse(new.select("uri", "text")).join(digest_of, "uri")
    parts.repartitionByRange("digest").sortWithinPartitions("digest").write.parquet(f"{path}/{PARTS_AT}/{number}")
    now = given.select("uri", "digest").join(stored, "digest", "left").select("uri", "digest", F.coalesce("generation", F.lit(number)).cast("long").alias("generation"))
    if known and not replace:
        old = _manifest(spark, path)
        now = now.unionByName(old.join(given.select("uri"), "uri", "left_anti"))
    now.write.parquet(f"{path}/{MANIFESTS}/{number}")
    return number


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The parts of a version (the latest one), as ``discovery.parse`` gives them. Only generations that it names are read."""
    manifest = _manifest(spark, path, version)
    generations = [r[0] for r in manifest.select("generation").distinct().collect()]
    if not generations:
        return spark.createDataFrame([], PARTS)
    schema = f"{PARTS}, digest string"
    parts = spark.read.schema(schema).parquet(*[f"{path}/{PARTS_AT}/{n}" for n in generations])
    return parts.join(manifest.select("digest").distinct(), "digest", "left_semi").drop("digest")


def changed(spark: SparkSession, path: str, before: int, after: int) -> DataFrame:
    """(uri, change) between two versions: added, removed or changed."""
    a, b = (_manifest(spark, path, v).select("uri", F.col("digest").alias(n)) for v, n in ((before, "a"), (after, "b")))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "uri", "full").where("not (a <=> b)").select("uri", state.alias("change"))
