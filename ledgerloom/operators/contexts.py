"""Filters over contexts; each call returns a new filter over a smaller table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aspects import dims_key
from .running import running


class Contexts:
    """A chain of predicates over a contexts table."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _where(self, test: Column) -> "Contexts":
        return Contexts(self.df.where(test))

    def by_ref(self, *refs: str) -> "Contexts":
        return self._where(F.col("context_id").isin(*refs))

    def containing_date(self, date: str) -> "Contexts":
        """Instants at the date, durations that began before it and end at it or later (day ends as dates)."""
        day = F.date_add(F.lit(date).cast("date"), 1).cast("timestamp_ntz")
        return self._where(F.when(F.col("period_type") == "instant", F.col("end") == day).otherwise((F.col("start") < day) & (F.col("end") >= day)))

    def for_year(self, year: int, by_end: bool = True) -> "Contexts":
        last_day = F.date_sub(F.col("end").cast("date"), 1)
        return self._where(F.year(last_day if by_end else F.col("start")) == year)

    def with_duration(self, months: int) -> "Contexts":
        return self._where((F.col("period_type") == "duration") & (F.floor(F.months_between("end", "start")) == months))

    def instants(self) -> "Contexts":
        return self._where(F.col("period_type") == "instant")

    def durations(self) -> "Contexts":
        """All that are no instants: a period for ever counts as a duration."""
        return self._where(F.col("period_type") != "instant")

    def of_entity(self, identifier: str, scheme: str | None = None) -> "Contexts":
        test = F.col("entity") == identifier
        return self._where(test & (F.lower("scheme") == scheme.lower()) if scheme else test)

    def with_segment(self, dimension: str | None = None, member: str | None = None) -> "Contexts":
        """Some member satisfies all tests given, in any case."""
        entries = F.map_entries(F.coalesce("dims", F.create_map().cast("map<string,string>")))
        same = lambda a, b: F.lower(a) == b.lower() if b else F.lit(True)
        return self._where(F.exists(entries, lambda e: same(e["key"], dimension) & same(e["value"], member)))

    def without_segment(self) -> "Contexts":
        return self._where((F.coalesce(F.size("dims"), F.lit(0)) < 1) & (F.coalesce(F.size("typed_dims"), F.lit(0)) < 1) & F.col("non_dim").isNull())

    def same_segment(self, context_id: str) -> "Contexts":
        key = dims_key(F.col("dims"), F.col("typed_dims"))
        own = self.df.where(F.col("context_id") == context_id).select(key.alias("_key"), F.col("doc_id").alias("_doc")).distinct()
        return Contexts(self.df.join(own, (F.col("doc_id") == F.col("_doc")) & (key == F.col("_key")), "left_semi"))

    def remove(self, other: "Contexts") -> "Contexts":
        return Contexts(self.df.join(other.df.select("doc_id", "context_id"), ["doc_id", "context_id"], "left_anti"))

    def add(self, other: "Contexts") -> "Contexts":
        return Contexts(self.df.unionByName(other.df.join(self.df.select("doc_id", "context_id"), ["doc_id", "context_id"], "left_anti")))

    def sort_by_start(self) -> DataFrame:
        return self.df.orderBy(F.desc("start"), "doc_id", "context_id")

    def sort_by_end(self) -> DataFrame:
        return self.df.orderBy(F.desc("end"), "doc_id", "context_id")

    def sort_by_duration(self, invert: bool = False) -> DataFrame:
        days = F.datediff("end", "start")
        return self.df.orderBy(days.desc() if invert else days.asc(), "doc_id", "context_id")

    def entities(self) -> DataFrame:
        return self.df.select("scheme", "entity").distinct()

    def years(self) -> DataFrame:
        return self.df.where("end is not null").select(F.year(F.date_sub(F.col("end").cast("date"), 1)).alias("year")).distinct().orderBy("year")

    def namespaces(self) -> DataFrame:
        names = F.explode(F.concat(F.map_keys("dims"), F.map_values("dims")))
        return self.df.select(names.alias("name")).select(F.regexp_extract("name", r"^\{?([^}:]*)[}:]", 1).alias("namespace")).distinct()

    def explicit_dimensions(self, listed: bool = True) -> DataFrame:
        """Dimensions with their contexts, listed or counted."""
        return self._dimensions("dims", listed)

    def typed_dimensions(self, listed: bool = True) -> DataFrame:
        return self._dimensions("typed_dims", listed)

    def _dimensions(self, col: str, listed: bool) -> DataFrame:
        each = self.df.select(F.explode(F.map_keys(col)).alias("dimension"), "context_id")
        found = F.array_sort(F.collect_set("context_id")) if listed else F.count(F.lit(1))
        return each.groupBy("dimension").agg(found.alias("contexts"))

    def duration(self) -> DataFrame:
        return self.df.agg(F.min("start").alias("start"), F.max("end").alias("end"))

    def period_label(self) -> DataFrame:
        """'start - end', or one date where all are instants of one day."""
        last = F.date_sub(F.max(F.col("end")).cast("date"), 1)
        first = F.min(F.coalesce(F.col("start").cast("date"), F.date_sub(F.col("end").cast("date"), 1)))
        return self.df.agg(F.when(first == last, F.date_format(last, "yyyy-MM-dd")).otherwise(F.concat_ws(" - ", first, last)).alias("label"))

    def discrete_ranges(self) -> DataFrame:
        """Periods by document, widest first: a period belongs to the first range of its end that contains it.

        In falling order of ends a period opens a range where it starts before all others so far; it belongs to the range with
        the latest start that isn't after its own. Both are running values by month, so no document is one group.
        """
        periods = self.df.where("end is not null").select("doc_id", "context_id", F.coalesce("start", "end").alias("start"), "end")
        ends = periods.groupBy("doc_id", "end").agg(F.min("start").alias("start"))  # others with this end lie within the widest
        month = lambda c: F.year(c) * 12 + F.month(c)
        swept = running(ends, ["doc_id"], month("end"), [F.desc("end")], F.col("start"), "min", "least", descending=True)
        ranges = swept.groupBy("doc_id", F.col("least").alias("start")).agg(F.max("end").alias("range_end"))
        starts = periods.select("doc_id", "start").distinct()
        marked = starts.join(ranges, ["doc_id", "start"], "left").withColumn("own", F.when(F.col("range_end").isNotNull(), F.struct(F.col("start").alias("s"), F.col("range_end").alias("e"))))
        homes = running(marked, ["doc_id"], month("start"), [F.asc("start")], F.col("own"), "max", "home").select("doc_id", "start", F.col("home.s").alias("range_start"), F.col("home.e").alias("range_end"))
        return periods.join(homes, ["doc_id", "start"]).select("doc_id", "context_id", "range_start", "range_end")


def has_dimension(dimension: str) -> Column:
    return F.coalesce(F.map_contains_key("dims", dimension), F.lit(False)) | F.coalesce(F.map_contains_key("typed_dims", dimension), F.lit(False))


def has_default_member(dimension: str, default: str) -> Column:
    """The default counts whether it is written or left out."""
    return F.coalesce(F.try_element_at("dims", F.lit(dimension)), F.lit(default)) == default
