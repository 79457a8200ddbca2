"""Filters and lookups over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEFAULT_UNITS, STANDARD_LABEL


#: Sorts of whole facts, for each partition of a shuffle.
SORTS = 8


class Facts:
    """A chain of predicates over a facts table."""

    def __init__(self, df: DataFrame):
        self.df = df

    def by_name(self, *concepts: str) -> "Facts":
        return Facts(self.df.where(F.col("concept").isin(*concepts)))

    def by_contexts(self, contexts: DataFrame) -> "Facts":
        """Facts of these contexts, in any case, and the tuples that hold such facts."""
        refs = contexts.select(F.col("doc_id").alias("_d"), F.lower("context_id").alias("_c")).distinct()
        own = self.df.join(refs, (F.col("doc_id") == F.col("_d")) & (F.lower("context_ref") == F.col("_c")), "left_semi")
        holders = own.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("fact_id")).distinct()
        tuples = self.df.where("context_ref is null").join(holders, ["doc_id", "fact_id"], "left_semi")
        return Facts(own.unionByName(tuples))

    def by_namespaces(self, *namespaces: str) -> "Facts":
        return Facts(self.df.where(F.lower("ns").isin(*[n.lower() for n in namespaces])))

    def by_item_type(self, *types: str) -> "Facts":
        return Facts(self.df.where(F.col("item_type").isin(*types)))

    def items(self) -> "Facts":
        return Facts(self.df.where("context_ref is not null"))

    def tuples(self) -> "Facts":
        return Facts(self.df.where("context_ref is null"))

    def non_nil(self) -> "Facts":
        return Facts(self.df.where("not coalesce(is_nil, false)"))

    def in_tuple(self, parent_id: str) -> "Facts":
        return Facts(self.df.where(F.col("parent_id") == parent_id))

    def namespaces(self) -> DataFrame:
        return self.df.select("ns").distinct()

    def item_types(self) -> DataFrame:
        return self.df.select("item_type").distinct()

    def substitution_groups(self, concepts: DataFrame) -> DataFrame:
        return self.df.select("concept").distinct().join(concepts.select("concept", "subst_group"), "concept").select("subst_group").distinct()

    def unique(self) -> "Facts":
        """Of a concept's items with the same context and value the first; tuples all stay."""
        w = Window.partitionBy("doc_id", "concept", "context_ref", "value").orderBy("ordinal", "fact_id")
        keep = self.df.withColumn("_n", F.row_number().over(w)).where("_n = 1 or context_ref is null").drop("_n")
        return Facts(keep)

    def with_labels(self, labels: DataFrame, lang: str = "en", role: str = STANDARD_LABEL) -> DataFrame:
        return self.df.join(concept_labels(labels, lang, role), "concept", "left")

    def footnotes(self, notes: DataFrame, lang: str | None = None, roles: list[str] | None = None) -> DataFrame:
        if lang:
            notes = notes.where(F.col("lang") == lang)
        if roles:
            notes = notes.where(F.col("role").isin(roles))
        return self.df.select("doc_id", "fact_id", "concept").join(notes, ["doc_id", "fact_id"])


def concept_labels(labels: DataFrame, lang: str, role: str = STANDARD_LABEL) -> DataFrame:
    """One label a concept: the role asked for before the standard one, the language before its base language."""
    base = lang.split("-")[0]
    rank = F.when(F.col("role") == role, 0).when(F.col("role") == STANDARD_LABEL, 10) + F.when(F.col("lang") == lang, 0).when(F.split_part("lang", F.lit("-"), F.lit(1)) == base, 1).otherwise(2)
    return labels.withColumn("_r", rank).where("_r is not null").groupBy("concept").agg(F.min_by("text", F.struct("_r", "lang", "text")).alias("label"))


def duplicates(wide: DataFrame) -> DataFrame:
    """Facts that share concept, tuple, context and unit with another; the value does not matter.

    They are dealt out and sorted by a hash of these first, so that the keys themselves are hardly ever compared, and over a fixed
    number of tasks: such repetitive rows are many times larger in a sort than compressed in a shuffle, by whose size Spark would
    bring them together."""
    keys = ["doc_id", "concept", "parent_id", "entity_key", "period_key", "dims_key", "non_dim", "scenario", "unit_key"]
    parts = SORTS * int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wide.withColumn("_mark", F.xxhash64(*keys)).repartition(parts, "_mark")
    w = Window.partitionBy("_mark", *keys)
    return dealt.withColumn("n_duplicates", F.count(F.lit(1)).over(w)).where("n_duplicates > 1 and context_ref is not null").drop("_mark")


def with_default_units(facts: DataFrame) -> DataFrame:
    """Facts of numeric types without a unit get their type's usual one; others are left as they are."""
    table = F.create_map(*[F.lit(x) for kv in DEFAULT_UNITS.items() for x in kv])
    local = F.regexp_extract("item_type", "([^:]*)$", 1)
    return facts.withColumn("unit_ref", F.coalesce("unit_ref", F.try_element_at(table, local)))
