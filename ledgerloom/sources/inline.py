"""Facts inside HTML: inline documents to the same tables as instance documents.

The HTML parser of the standard library gives one row an inline element with its text, attributes and parents;
continuations, targets, formats, scales and signs are joins and columns.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transforms
from ..operators.rounds import Rounds, followers, list_ranks
from .instance import spread

ELEMENTS = ("nonfraction", "nonnumeric", "fraction", "numerator", "denominator", "tuple", "continuation", "footnote", "exclude", "header", "hidden", "resources", "references", "relationship")
RAW = "doc_id string, tag string, id string, name string, text string, attrs map<string,string>, parent string, ordinal int"
ARROW = pa.schema([(n, pa.string()) for n in ("doc_id", "tag", "id", "name", "text")] + [("attrs", pa.map_(pa.string(), pa.string())), ("parent", pa.string()), ("ordinal", pa.int32())])


class _Inline(HTMLParser):
    """Inline elements with their text; excluded parts belong to no element around them."""

    def __init__(self, doc: str):
        super().__init__(convert_charrefs=True)
        self.doc, self.open, self.rows = doc, [], []

    def handle_starttag(self, tag, attrs):
        local = tag.rpartition(":")[2]
        if tag.startswith("ix:") and local in ELEMENTS:
            values = {k: v or "" for k, v in attrs}
            row = {"doc_id": self.doc, "tag": local, "id": values.get("id") or f"i.{len(self.rows)}", "name": values.get("name"), "text": "", "attrs": list(values.items()), "parent": self.open[-1]["id"] if self.open else None, "ordinal": len(self.rows)}
            self.rows.append(row)
            self.open.append(row)

    def handle_startendtag(self, tag, attrs):
        before = len(self.open)
        self.handle_starttag(tag, attrs)
        del self.open[before:]

    def handle_endtag(self, tag):
        local = tag.rpartition(":")[2]
        if tag.startswith("ix:") and self.open and self.open[-1]["tag"] == local:
            self.open.pop()

    def handle_data(self, data):
        for row in reversed(self.open):
            if row["tag"] == "exclude":
                break
            row["text"] += data


def elements(documents: DataFrame) -> DataFrame:
    """One row an inline element of (doc_id, text)."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                p = _Inline(doc)
                p.feed(text or "")
                p.close()
                rows += p.rows
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return spread(documents).mapInArrow(run, RAW)


def _attr(name: str):
    return F.try_element_at("attrs", F.lit(name))


def with_continuations(rows: DataFrame) -> DataFrame:
    """Text of elements followed by that of their continuations, in the chain's order.

    Chains of any length take rounds by their logarithm. A chain ends where it names no continuation of its document, or an
    element that it has met; of several continuations with one id the first one's text counts."""
    parts = rows.where("tag = 'continuation'").groupBy("doc_id", "id").agg(F.min_by("text", "ordinal").alias("_text"), F.min_by(_attr("continuedat"), F.col("ordinal")).alias("_next"))
    there = parts.select("doc_id", F.col("id").alias("next"))
    heads = rows.where("tag <> 'continuation'").select("doc_id", "id", _attr("continuedat").alias("next")).where("next is not null")
    links = heads.unionByName(parts.select("doc_id", "id", F.col("_next").alias("next"))).where("next is not null").join(there, ["doc_id", "next"], "left_semi")
    after = followers(links, heads, ["doc_id"]).where("id <> start").join(parts.select("doc_id", "id", "_text"), ["doc_id", "id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_text"))), lambda x: x["_text"]), "")
    more = after.groupBy("doc_id", F.col("start").alias("id")).agg(joined.alias("_more"))
    out = rows.where("tag <> 'continuation'").join(more, ["doc_id", "id"], "left")
    return out.withColumn("text", F.concat("text", F.coalesce("_more", F.lit("")))).select(*rows.columns)


def facts(rows: DataFrame, registry: dict | str = transforms.TR4, formats: list[str] | None = None) -> DataFrame:
    """Facts of all targets: formatted, scaled and signed values; ``bad_format`` where a text doesn't fit its format."""
    rows = Rounds().keep(rows)  # read many times: documents are parsed once
    whole = with_continuations(rows).where(F.col("tag").isin("nonfraction", "nonnumeric", "fraction", "tuple"))
    kinds = rows.select("doc_id", F.col("id").alias("parent"), F.col("tag").alias("_ptag"))
    name = F.regexp_extract(_attr("format"), r"([^:]*)$", 1)
    shown = F.when(_attr("format").isNull(), F.col("text")).otherwise(transforms.transform_by_column(F.trim("text"), name, registry, formats))
    plain = F.when(_attr("format").isNull(), F.regexp_replace(F.trim("text"), ",", "")).otherwise(shown)
    number = transforms.scaled(plain, _attr("scale"), _attr("sign"))
    nil = F.coalesce(_attr("xsi:nil").isin("true", "1"), F.lit(False))
    out = whole.join(kinds, ["doc_id", "parent"], "left")
    tuple_ref = F.coalesce(_attr("tupleref"), F.when(F.col("_ptag") == "tuple", F.col("parent")))
    return out.select(
        "doc_id", F.coalesce(_attr("target"), F.lit("")).alias("target"), F.col("id").alias("fact_id"), tuple_ref.alias("parent_id"), F.regexp_extract("name", r"([^:]*)$", 1).alias("concept"), F.split_part("name", F.lit(":"), F.lit(1)).alias("prefix"),
        F.when(nil, F.lit(None)).when(F.col("tag") == "nonfraction", number.cast("string")).when(F.col("tag") == "nonnumeric", shown).alias("value"),
        F.when(~nil & (F.col("tag") == "nonfraction"), number.try_cast("decimal(38,6)")).alias("num"), nil.alias("is_nil"), _attr("decimals").alias("decimals"), _attr("precision").alias("precision"),
        _attr("contextref").alias("context_ref"), _attr("unitref").alias("unit_ref"), F.coalesce(_attr("order").try_cast("double"), F.col("ordinal").cast("double")).alias("ord"), "ordinal", F.col("tag").alias("kind"),
        (_attr("format").isNotNull() & ~nil & shown.isNull()).alias("bad_format"),
    )


def fractions(rows: DataFrame) -> DataFrame:
    """Numerator and denominator of fraction elements."""
    parts = rows.where("tag in ('numerator', 'denominator')").select("doc_id", F.col("parent").alias("fact_id"), "tag", F.regexp_replace(F.trim("text"), ",", "").try_cast("decimal(38,6)").alias("n"))
    return parts.groupBy("doc_id", "fact_id").agg(F.max(F.when(F.col("tag") == "numerator", F.col("n"))).alias("numerator"), F.max(F.when(F.col("tag") == "denominator", F.col("n"))).alias("denominator"))


def problems(rows: DataFrame) -> DataFrame:
    """Ids used twice, references to nothing, values without context, numbers without unit, tuples in a circle."""
    ids = rows.groupBy("doc_id", "id").count().where("count > 1").select("doc_id", "id", F.lit("id-twice").alias("rule"))
    known = rows.select("doc_id", F.col("id").alias("ref"))
    refs = rows.select("doc_id", "id", F.explode(F.array_compact(F.array(_attr("continuedat"), _attr("tupleref")))).alias("ref"))
    lost = refs.join(known, ["doc_id", "ref"], "left_anti").select("doc_id", "id", F.lit("reference").alias("rule"))
    valued = rows.where(F.col("tag").isin("nonfraction", "nonnumeric", "fraction"))
    no_context = valued.where(_attr("contextref").isNull()).select("doc_id", "id", F.lit("context").alias("rule"))
    no_unit = valued.where((F.col("tag") != "nonnumeric") & _attr("unitref").isNull()).select("doc_id", "id", F.lit("unit").alias("rule"))
    no_name = rows.where(F.col("tag").isin("nonfraction", "nonnumeric", "fraction", "tuple") & F.col("name").isNull()).select("doc_id", "id", F.lit("name").alias("rule"))
    own = tuple_circles(rows).withColumn("rule", F.lit("circle"))
    out = ids
    for df in (lost, no_context, no_unit, no_name, own):
        out = out.unionByName(df)
    return out


def tuple_circles(rows: DataFrame) -> DataFrame:
    """(doc_id, id) of tuples that are inside themselves, over references and nesting of any length."""
    tuples = rows.where("tag = 'tuple'").select("doc_id", "id", "parent", _attr("tupleref").alias("ref"))
    nested = tuples.select("doc_id", F.col("id").alias("parent"), F.lit(True).alias("_in"))
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\x1f", "doc_id", c))
    up = tuples.join(nested, ["doc_id", "parent"], "left").withColumn("above", F.coalesce("ref", F.when(F.col("_in"), F.col("parent"))))
    links = up.groupBy("doc_id", "id").agg(F.min("above").alias("above"))
    ranks = list_ranks(links.select(key("id").alias("id"), key("above").alias("next"), F.lit(1).alias("n")), ["n"])
    around = ranks.where("cyclic").select(F.col("last").alias("_id")).distinct()
    return links.select("doc_id", "id", key("id").alias("_id")).join(around, "_id", "left_semi").select("doc_id", "id")


def targets(rows: DataFrame) -> DataFrame:
    """Documents by target, with their number of facts."""
    return facts(rows).groupBy("target").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("facts"))


def used_only(table: DataFrame, key: str, found: DataFrame, ref: str) -> DataFrame:
    """Contexts or units that some fact refers to."""
    return table.join(found.select("doc_id", F.col(ref).alias(key)).distinct(), ["doc_id", key], "left_semi")
