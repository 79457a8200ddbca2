"""Taxonomies as tables: concepts from schemas, arcs and labels from linkbases."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LINK, XBRLI, XLINK
from ..operators.networks import reach

XS = "{http://www.w3.org/2001/XMLSchema}"
CONCEPT = "concept string, ns string, id string, item_type string, subst_group string, period_type string, balance string, abstract boolean, nillable boolean, attrs map<string,string>"
ARC = "role string, arcrole string, from string, to string, ord double, weight double, priority int, use string, preferred_label string, link_name string, arc_name string, attrs map<string,string>"


def concepts(documents: DataFrame) -> DataFrame:
    """Elements of schemas (doc_id, text) that are items or tuples; type chains follow from ``with_chains``."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                root = ET.fromstring(text)
                for e in root.findall(f"{XS}element"):
                    extra = {k: v for k, v in e.attrib.items() if k.startswith("{")}
                    rows.append((e.get("name"), root.get("targetNamespace"), e.get("id"), (e.get("type") or "").rpartition(":")[2], e.get("substitutionGroup"), e.get(f"{{{XBRLI}}}periodType"), e.get(f"{{{XBRLI}}}balance"), e.get("abstract") == "true", e.get("nillable") == "true", {k.rpartition("}")[2]: v for k, v in extra.items()}))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONCEPT.split(", ")])

    return documents.select("text").mapInPandas(run, CONCEPT)


def type_pairs(documents: DataFrame) -> DataFrame:
    """(child, parent) of type restrictions in schemas."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                for t in ET.fromstring(text):
                    base = next((x.get("base") for x in t.iter() if x.tag in (f"{XS}restriction", f"{XS}extension")), None)
                    if t.get("name") and base and t.tag in (f"{XS}complexType", f"{XS}simpleType"):
                        rows.append((t.get("name"), base.rpartition(":")[2]))
            yield pd.DataFrame(rows, columns=["child", "parent"])

    return documents.select("text").mapInPandas(run, "child string, parent string")


def with_chains(concept_rows: DataFrame, types: DataFrame) -> DataFrame:
    """Concepts with all base types and all substitution groups, by transitive closure."""
    up = types.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    closure = reach(up, types.select(F.col("child").alias("source")).distinct())
    bases = closure.groupBy(F.col("source").alias("item_type")).agg(F.array_sort(F.collect_set("node")).alias("base_types"))
    own = concept_rows.select("concept", F.regexp_extract("subst_group", r"([^:]*)$", 1).alias("g"))
    groups = reach(own.select(F.col("concept").alias("parent"), F.col("g").alias("child")), own.select(F.col("concept").alias("source")).distinct())
    chain = groups.groupBy(F.col("source").alias("concept")).agg(F.array_sort(F.collect_set("node")).alias("subst_groups"))
    empty = F.array().cast("array<string>")
    return concept_rows.join(bases, "item_type", "left").join(chain, "concept", "left").withColumns({"base_types": F.coalesce("base_types", empty), "subst_groups": F.coalesce("subst_groups", empty)})


def _links(text: str):
    x = f"{{{XLINK}}}"
    for link in ET.fromstring(text):
        if link.get(f"{x}type") == "extended":
            where = {n.get(f"{x}label"): n.get(f"{x}href", "").rpartition("#")[2] for n in link.findall(f"{{{LINK}}}loc")}
            yield link, where


def arcs(documents: DataFrame) -> DataFrame:
    """Arcs between concepts of linkbases (doc_id, text)."""
    x = f"{{{XLINK}}}"

    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                for link, where in _links(text):
                    for a in link:
                        if a.get(f"{x}type") == "arc" and a.get(f"{x}from") in where and a.get(f"{x}to") in where:
                            rows.append((link.get(f"{x}role"), a.get(f"{x}arcrole"), where[a.get(f"{x}from")], where[a.get(f"{x}to")], float(a.get("order") or 1), float(a.get("weight")) if a.get("weight") else None, int(a.get("priority") or 0), a.get("use") or "optional", a.get("preferredLabel"), link.tag.rpartition("}")[2], a.tag.rpartition("}")[2], {k.rpartition("}")[2]: v for k, v in a.attrib.items()}))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ARC.split(", ")])

    return documents.select("text").mapInPandas(run, ARC)


def labels(documents: DataFrame) -> DataFrame:
    """(concept, role, lang, text) of label linkbases."""
    x = f"{{{XLINK}}}"

    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                for link, where in _links(text):
                    notes = [(n.get(f"{x}label"), n.get(f"{x}role"), n.get("{http://www.w3.org/XML/1998/namespace}lang"), "".join(n.itertext())) for n in link.findall(f"{{{LINK}}}label")]
                    for a in link:
                        if a.get(f"{x}type") == "arc":
                            rows += [(where.get(a.get(f"{x}from")), r, lang, t) for label, r, lang, t in notes if label == a.get(f"{x}to")]
            yield pd.DataFrame(rows, columns=["concept", "role", "lang", "text"])

    return documents.select("text").mapInPandas(run, "concept string, role string, lang string, text string")
