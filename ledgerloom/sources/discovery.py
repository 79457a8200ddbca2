"""Taxonomies found from their entry points: references between documents, what is reached over them, and the concepts, arcs
and labels of a taxonomy that extends another.

Documents are rows (uri, text). An address in a document is resolved against the document's own; concepts are known by
schema and id, so equal ids of two schemas stay apart. A taxonomy is all that is reached from an entry point; an
extension is one that reaches its base. Its arcs are those of all its documents, the equivalent ones of base and
extension weighed against each other: the highest priority stands, and of equals one that prohibits.

A document that can't be parsed has an error row and no references; a reference to a document that isn't there is reported
as missing; cycles of references end. Empty tables give empty results.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from itertools import islice
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import LINK, XBRLI, XLINK
from ..operators.networks import reach
from .instance import ROWS, arrow_schema, batch_of, spread

XS = "{http://www.w3.org/2001/XMLSchema}"
X = f"{{{XLINK}}}"
PARTS = (
    "uri string, part string, name string, ns string, id string, item_type string, subst_group string, period_type string, balance string, abstract boolean, nillable boolean, "
    "target string, role string, arcrole string, from_uri string, from_id string, to_uri string, to_id string, ord double, weight double, priority int, use string, preferred_label string, "
    "link_name string, arc_name string, attrs map<string,string>, lang string, text string"
)
#: Letters that are given to the XML reader at once.
CHUNK = 1 << 16
#: Elements whose address leads to another document of the taxonomy.
REFERENCES = {f"{XS}import": "schemaLocation", f"{XS}include": "schemaLocation", f"{{{LINK}}}schemaRef": f"{X}href", f"{{{LINK}}}linkbaseRef": f"{X}href", f"{{{LINK}}}roleRef": f"{X}href", f"{{{LINK}}}arcroleRef": f"{X}href", f"{{{LINK}}}loc": f"{X}href"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(text: str):
    """(element, parents, its end) as a document is read; children of the root and of extended links are let go once they have ended,
    so that no tree of the whole document stands."""
    reader, parents = ET.XMLPullParser(("start", "end")), []
    for at in range(0, len(text) + 1, CHUNK):
        reader.feed(text[at : at + CHUNK])
        if at + CHUNK > len(text):
            reader.close()
        for event, e in reader.read_events():
            if event == "start":
                yield e, parents, False
                parents.append(e)
            else:
                parents.pop()
                yield e, parents, True
                if parents and (len(parents) == 1 or parents[-1].get(f"{X}type") == "extended"):
                    del parents[-1][:]


def _concept(uri: str, root, e) -> dict:
    attrs = {_local(k): v for k, v in e.attrib.items() if k.startswith("{")}
    return {"uri": uri, "part": "concept", "name": e.get("name"), "ns": root.get("targetNamespace"), "id": e.get("id"), "item_type": _local((e.get("type") or "").rpartition(":")[2]), "subst_group": e.get("substitutionGroup"), "period_type": e.get(f"{{{XBRLI}}}periodType"), "balance": e.get(f"{{{XBRLI}}}balance"), "abstract": e.get("abstract") == "true", "nillable": e.get("nillable") == "true", "attrs": attrs}


def _arc(uri: str, link, a, where: dict, texts: dict):
    own = {"uri": uri, "role": link.get(f"{X}role"), "arcrole": a.get(f"{X}arcrole"), "ord": float(a.get("order") or 1), "weight": float(a.get("weight")) if a.get("weight") else None, "priority": int(a.get("priority") or 0), "use": a.get("use") or "optional", "link_name": _local(link.tag), "arc_name": _local(a.tag)}
    for f_uri, f_id in where.get(a.get(f"{X}from"), []):
        for t_uri, t_id in where.get(a.get(f"{X}to"), []):
            yield own | {"part": "arc", "from_uri": f_uri, "from_id": f_id, "to_uri": t_uri, "to_id": t_id, "preferred_label": a.get("preferredLabel"), "attrs": {_local(k): v for k, v in a.attrib.items()}}
        for role, lang, text in texts.get(a.get(f"{X}to"), []):
            yield own | {"part": "label", "from_uri": f_uri, "from_id": f_id, "arcrole": role, "lang": lang, "text": text}


def each_row(uri: str, text: str):
    """Concepts, arcs, labels, references and errors of one document, one by one.

    It is read twice: first what it refers to, with the locators and resources of its links, as arcs may stand before these; then
    concepts and arcs."""
    targets, links, urls = set(), [], {}
    inside = lambda parents: bool(parents) and parents[-1].get(f"{X}type") == "extended"
    try:
        open_links: list[tuple[dict, dict]] = []
        for e, parents, ended in _elements(text):
            kind = e.get(f"{X}type")
            if ended:
                if inside(parents) and kind == "resource":
                    open_links[-1][1].setdefault(e.get(f"{X}label"), []).append((e.get(f"{X}role"), e.get("{http://www.w3.org/XML/1998/namespace}lang"), "".join(e.itertext())))
                if kind == "extended":
                    open_links.pop()
                continue
            if e.tag in REFERENCES and e.get(REFERENCES[e.tag]):
                targets.add(urldefrag(urljoin(uri, e.get(REFERENCES[e.tag]))).url)
            if inside(parents) and kind == "locator":
                to = urldefrag(urljoin(uri, e.get(f"{X}href", "")))
                open_links[-1][0].setdefault(e.get(f"{X}label"), []).append((urls.setdefault(to.url, to.url), to.fragment))
            if kind == "extended":
                links.append(({}, {}))
                open_links.append(links[-1])
    except ET.ParseError as e:
        yield {"uri": uri, "part": "error", "text": str(e)}
        return
    for t in sorted(targets - {uri}):
        yield {"uri": uri, "part": "reference", "target": t}
    n, own_links = 0, []
    for e, parents, ended in _elements(text):
        kind = e.get(f"{X}type")
        if ended:
            if kind == "extended":
                own_links.pop()
            continue
        if len(parents) == 1 and e.tag == f"{XS}element" and parents[0].tag == f"{XS}schema":
            yield _concept(uri, parents[0], e)
        if inside(parents) and kind == "arc":
            yield from _arc(uri, parents[-1], e, *own_links[-1])
        if kind == "extended":
            own_links.append(links[n])
            n += 1


def rows_of(uri: str, text: str) -> list[dict]:
    """All rows of one document."""
    return list(each_row(uri, text))


def parse(documents: DataFrame) -> DataFrame:
    """All parts of documents (uri, text), by the kind in ``part``; a null text counts as an error. Documents of any length are read
    in pieces and given back as batches of ``ROWS`` rows; of a whole document a task holds its text, and its locators and resources."""
    schema = arrow_schema(PARTS)

    def run(batches):
        for b in batches:
            for uri, text in zip(b["uri"], b["text"]):
                rows = each_row(uri.as_py(), text.as_py() or "")
                while some := list(islice(rows, ROWS)):
                    yield batch_of(some, schema)

    return spread(documents, "uri").mapInArrow(run, PARTS)


def reached(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, uri, depth): the documents of each entry point's taxonomy, itself included, whether they are there or not.
    Each round follows only what was met in the round before."""
    pairs = parts.where("part = 'reference'").select(F.col("uri").alias("parent"), F.col("target").alias("child"))
    start = entries.select(F.col("entry").alias("source")).distinct()
    met = reach(pairs, start).select(F.col("source").alias("entry"), F.col("node").alias("uri"), "depth")
    return start.select(F.col("source").alias("entry"), F.col("source").alias("uri"), F.lit(0).alias("depth")).unionByName(met)


def missing(taxonomy: DataFrame, documents: DataFrame) -> DataFrame:
    """(entry, uri) of documents that are referred to and aren't there."""
    return taxonomy.join(documents.select("uri").distinct(), "uri", "left_anti").select("entry", "uri")


def concepts(parts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(entry, uri, id, concept, ns, ...) of all schemas of each taxonomy."""
    own = parts.where("part = 'concept'").select("uri", "id", F.col("name").alias("concept"), "ns", "item_type", "subst_group", "period_type", "balance", "abstract", "nillable", "attrs")
    return taxonomy.select("entry", "uri").join(own, "uri")


def arcs(parts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Arcs in force of each taxonomy, over all its documents: (entry, role, arcrole, from, to, ...), ends as {namespace}name.

    Equivalent arcs join the same two concepts in one link role, with the same order, weight and preferred label. ``layer`` is
    the document that had the last word."""
    own = taxonomy.select("entry", "uri").join(parts.where("part = 'arc'"), "uri")
    name = F.concat(F.lit("{"), F.coalesce("ns", F.lit("")), F.lit("}"), "concept")
    ends = concepts(parts, taxonomy).select("entry", F.col("uri").alias("_uri"), F.col("id").alias("_id"), name.alias("_name")).distinct()
    for side in ("from", "to"):
        at = ends.select(F.col("entry"), F.col("_uri").alias(f"{side}_uri"), F.col("_id").alias(f"{side}_id"), F.col("_name").alias(side))
        own = own.join(at, ["entry", f"{side}_uri", f"{side}_id"])
    same = Window.partitionBy("entry", "role", "arcrole", "link_name", "arc_name", "from", "to", "ord", "weight", "preferred_label")
    best = same.orderBy(F.desc("priority"), F.when(F.col("use") == "prohibited", 0).otherwise(1), "uri")
    stand = own.withColumn("_n", F.row_number().over(best)).where("_n = 1 and `use` <> 'prohibited'")
    return stand.select("entry", "role", "arcrole", "from", "to", "ord", "weight", "priority", "use", "preferred_label", "link_name", "arc_name", "attrs", F.col("uri").alias("layer"))


def labels(parts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(entry, concept, ns, role, lang, text), those of all layers."""
    own = taxonomy.select("entry", "uri").join(parts.where("part = 'label'"), "uri").select("entry", "from_uri", "from_id", F.col("arcrole").alias("role"), "lang", "text")
    at = concepts(parts, taxonomy).select("entry", F.col("uri").alias("from_uri"), F.col("id").alias("from_id"), "concept", "ns").distinct()
    return own.join(at, ["entry", "from_uri", "from_id"]).select("entry", "concept", "ns", "role", "lang", "text")


def entries_of(schema_refs: DataFrame) -> DataFrame:
    """(doc_id, entry) of instances, their schema references (doc_id, href) resolved against their own places. An instance with
    several references has several entries."""

    @F.pandas_udf("string")
    def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([urldefrag(urljoin(b or "", h or "")).url for b, h in zip(base, href)], dtype=object)

    return schema_refs.select("doc_id", resolved("doc_id", "href").alias("entry")).distinct()


def resolve_facts(facts: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """Facts with the item type, period type and the schema (layer) of their concept in the taxonomy of their instance, and
    resolved, whether there is such a concept. ``known`` as ``concepts`` gives it."""
    own = entries.join(known.select("entry", "concept", "ns", F.col("item_type").alias("_type"), F.col("period_type").alias("concept_period_type"), F.col("uri").alias("layer")), "entry")
    own = own.groupBy("doc_id", "concept", "ns").agg(F.min("_type").alias("_type"), F.min("concept_period_type").alias("concept_period_type"), F.min("layer").alias("layer"))
    out = facts.drop("concept_period_type", "layer").join(own, ["doc_id", "concept", "ns"], "left")
    return out.withColumn("resolved", F.col("layer").isNotNull()).withColumn("item_type", F.coalesce("_type", "item_type") if "item_type" in facts.columns else F.col("_type")).drop("_type")
