"""Zip packages as tables: their files, kind, metadata, catalog and entry points."""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds by the files that show them, most special first; a plug-in adds (name, test over the array of paths).
KINDS: list[tuple[str, callable]] = [
    ("taxonomy-package", lambda p: F.exists(p, lambda x: x.rlike(r"(^|/)META-INF/taxonomyPackage\.xml$"))),
    ("json-manifest", lambda p: F.exists(p, lambda x: x.rlike(r"(^|/)MetaLinks\.json$|(^|/)meta\.json$"))),
    ("xml-manifest", lambda p: F.exists(p, lambda x: x.rlike(r"(^|/)FilingSummary\.xml$|(^|/)manifest\.xml$"))),
    ("inline-report", lambda p: F.exists(p, lambda x: x.rlike(r"(^|/)reports/.*\.x?html?$"))),
    ("schema-folder", lambda p: F.exists(p, lambda x: x.rlike(r"\.xsd$"))),
]


def register(name: str, test, first: bool = True) -> None:
    KINDS.insert(0, (name, test)) if first else KINDS.append((name, test))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(package, path, content) of all files in the zip files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"package": [name], "path": [info.filename], "content": [z.read(info)]})

    return files.select("path", "content").mapInPandas(run, "package string, path string, content binary")


def classify(files: DataFrame) -> DataFrame:
    """(package, kind): the first kind whose files are there."""
    paths = files.groupBy("package").agg(F.collect_list("path").alias("paths"))
    kind: Column = F.lit("unknown")
    for name, test in reversed(KINDS):
        kind = F.when(test(F.col("paths")), name).otherwise(kind)
    return paths.select("package", kind.alias("kind"))


def entry_points(files: DataFrame) -> DataFrame:
    """(package, name, href) of taxonomy packages, from their metadata."""

    def run(batches):
        for b in batches:
            rows = []
            for package, content in zip(b["package"], b["content"]):
                for e in ET.fromstring(bytes(content)).iter():
                    if e.tag.endswith("}entryPoint"):
                        name = next((x.text for x in e if x.tag.endswith("}name")), None)
                        rows += [(package, name, x.get("href")) for x in e if x.tag.endswith("}entryPointDocument")]
            yield pd.DataFrame(rows, columns=["package", "name", "href"])

    return files.where(F.col("path").rlike(r"META-INF/taxonomyPackage\.xml$")).select("package", "content").mapInPandas(run, "package string, name string, href string")


def catalog(files: DataFrame) -> DataFrame:
    """(package, prefix, replacement): rewritings of URLs into the package."""

    def run(batches):
        for b in batches:
            rows = []
            for package, content in zip(b["package"], b["content"]):
                rows += [(package, e.get("uriStartString"), e.get("rewritePrefix")) for e in ET.fromstring(bytes(content)).iter() if e.tag.endswith("}rewriteURI")]
            yield pd.DataFrame(rows, columns=["package", "prefix", "replacement"])

    return files.where(F.col("path").rlike(r"META-INF/catalog\.xml$")).select("package", "content").mapInPandas(run, "package string, prefix string, replacement string")


def rewrite(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with location: the url by the rule with its longest prefix, else as it is.

    ``rules`` holds (prefix, replacement) and, where ``urls`` has a package too, the package that a rule is for. Each distinct
    url meets the rules as a join on its own beginnings of the lengths that rules have; of equal rules the least replacement
    counts. Rules may be many; only their distinct lengths come to the driver, which the longest prefix bounds.
    """
    keys = ["package"] if "package" in urls.columns and "package" in rules.columns else []
    rules = rules.where("length(prefix) > 0").groupBy(*keys, "prefix").agg(F.min("replacement").alias("replacement"))
    lengths = sorted(r[0] for r in rules.select(F.length("prefix")).distinct().collect())
    each = urls.select(*keys, "url").where("url is not null").distinct()
    begins = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("url")), lambda n: F.substring("url", F.lit(1), n))
    met = each.withColumn("prefix", F.explode(begins)).join(rules, [*keys, "prefix"])
    rest = F.substring(F.col("url"), F.length("prefix") + 1, F.length("url"))
    best = met.groupBy(*keys, "url").agg(F.max_by(F.concat("replacement", rest), F.length("prefix")).alias("_to"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("url") == F.col("_url")]
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("url").alias("_url"), "_to")
    return urls.join(best, same, "left").withColumn("location", F.coalesce("_to", "url")).drop("_to", "_url", *[f"_{k}" for k in keys])


def manifest(files: DataFrame) -> DataFrame:
    """(package, path, key, value) of the top level of JSON manifests."""

    def run(batches):
        for b in batches:
            rows = []
            for package, path, content in zip(b["package"], b["path"], b["content"]):
                rows += [(package, path, k, json.dumps(v)) for k, v in json.loads(bytes(content)).items()]
            yield pd.DataFrame(rows, columns=["package", "path", "key", "value"])

    return files.where(F.col("path").rlike(r"\.json$")).select("package", "path", "content").mapInPandas(run, "package string, path string, key string, value string")


def file_hashes(files: DataFrame) -> DataFrame:
    """Short digest of each file, in order of its name in any case."""
    short = F.substring(F.base64(F.unhex(F.sha2("content", 256))), -16, 16)
    return files.select("package", "path", short.alias("hash"))


def package_hash(files: DataFrame) -> DataFrame:
    """One digest over the files' digests, sorted by name."""
    each = F.array_sort(F.collect_list(F.struct(F.lower("path").alias("p"), "hash")))
    joined = F.array_join(F.transform(each, lambda e: e["hash"]), "")
    return file_hashes(files).groupBy("package").agg(F.substring(F.base64(F.unhex(F.sha2(joined, 256))), -16, 16).alias("hash"))
