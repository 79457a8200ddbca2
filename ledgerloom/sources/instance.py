"""Instance documents as tables: one parse a document, then everything is columns.

Files are read whole by Spark and parsed by the standard XML reader in Arrow batches. The parser only walks the
tree and names what it sees; typing, normalisation and joins are left to Spark.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aspects import dims_key, period_end, period_start, unit_key
from ..model import LINK, XBRLDI, XBRLI, XLINK, XSI

RAW = (
    "doc_id string, kind string, id string, parent_id string, name string, ns string, value string, context_ref string, unit_ref string, "
    "decimals string, precision string, is_nil boolean, ordinal int, scheme string, entity string, period_type string, start_text string, end_text string, "
    "dims map<string,string>, typed_dims map<string,string>, non_dim string, scenario string, scenario_dims map<string,string>, numerator array<string>, denominator array<string>, "
    "href string, role string, lang string, target string"
)
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}


def arrow_schema(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in columns.split(", ")])


ARROW = arrow_schema(RAW)
#: Rows of an Arrow batch that parsers give back.
ROWS = 5_000


def _split(tag: str) -> tuple[str, str]:
    return tuple(tag[1:].split("}", 1)) if tag.startswith("{") else ("", tag)


def _text(node, path: str) -> str | None:
    found = node.find(path)
    return (found.text or "").strip() if found is not None else None


def _component(node) -> tuple[dict, dict, str | None]:
    """Explicit members, typed members, and the rest of a segment or scenario."""
    dims, typed, rest = {}, {}, []
    for child in node if node is not None else ():
        if child.tag == f"{{{XBRLDI}}}explicitMember":
            dims[child.get("dimension")] = (child.text or "").strip()
        elif child.tag == f"{{{XBRLDI}}}typedMember":
            typed[child.get("dimension")] = "".join(ET.tostring(x, encoding="unicode").strip() for x in child)
        else:
            rest.append(ET.tostring(child, encoding="unicode").strip())
    return dims, typed, "".join(rest) or None


def _context(doc: str, node) -> dict:
    x = f"{{{XBRLI}}}"
    ident = node.find(f"{x}entity/{x}identifier")
    period = node.find(f"{x}period")
    instant = _text(period, f"{x}instant") if period is not None else None
    start = _text(period, f"{x}startDate") if period is not None else None
    end = _text(period, f"{x}endDate") if period is not None else None
    kind = "instant" if instant is not None else "duration" if end is not None else "forever"
    d1, t1, rest = _component(node.find(f"{x}entity/{x}segment"))
    d2, t2, scenario = _component(node.find(f"{x}scenario"))
    return {"doc_id": doc, "kind": "context", "id": node.get("id"), "scheme": ident.get("scheme") if ident is not None else None, "entity": (ident.text or "").strip() if ident is not None else None, "period_type": kind, "start_text": start, "end_text": instant or end, "dims": d1 | d2, "typed_dims": t1 | t2, "non_dim": rest, "scenario": scenario, "scenario_dims": d2}


def _unit(doc: str, node) -> dict:
    x = f"{{{XBRLI}}}"
    names = lambda n: [(m.text or "").strip() for m in n.findall(f"{x}measure")] if n is not None else []
    divide = node.find(f"{x}divide")
    num, den = (names(divide.find(f"{x}unitNumerator")), names(divide.find(f"{x}unitDenominator"))) if divide is not None else (names(node), [])
    return {"doc_id": doc, "kind": "unit", "id": node.get("id"), "numerator": num, "denominator": den}


def _facts(doc: str, node, parent: str | None, rows: list[dict], path: str):
    for child in node:
        if not isinstance(child.tag, str):
            continue
        ns, name = _split(child.tag)
        if ns in (XBRLI, LINK):
            continue
        n = len(rows)
        fact = child.get("id") or f"{path}.{n}"
        is_tuple = child.get("contextRef") is None and len(child) > 0
        rows.append({"doc_id": doc, "kind": "fact", "id": fact, "parent_id": parent, "name": name, "ns": ns, "value": None if is_tuple else "".join(child.itertext()), "context_ref": child.get("contextRef"), "unit_ref": child.get("unitRef"), "decimals": child.get("decimals"), "precision": child.get("precision"), "is_nil": child.get(f"{{{XSI}}}nil") in ("true", "1"), "ordinal": n})
        if is_tuple:
            _facts(doc, child, fact, rows, path)


def _footnotes(doc: str, link) -> list[dict]:
    x = f"{{{XLINK}}}"
    where = {n.get(f"{x}label"): n.get(f"{x}href", "").rpartition("#")[2] for n in link.iter(f"{{{LINK}}}loc")}
    lang = "{http://www.w3.org/XML/1998/namespace}lang"
    notes = [(n.get(f"{x}label"), n.get(f"{x}role"), n.get(lang), "".join(n.itertext()).strip()) for n in link.iter(f"{{{LINK}}}footnote")]
    out = []
    for arc in link.iter(f"{{{LINK}}}footnoteArc"):
        for label, role, language, text in notes:
            if label == arc.get(f"{x}to"):
                out.append({"doc_id": doc, "kind": "footnote", "id": where.get(arc.get(f"{x}from")), "role": role, "lang": language, "value": text})
    return out


def rows_of(doc: str, text: str) -> list[dict]:
    """All rows of one document; an embedded instance is found below its first element."""
    root = ET.fromstring(text)
    if root.tag != f"{{{XBRLI}}}xbrl":
        root = next(root.iter(f"{{{XBRLI}}}xbrl"), None)
        if root is None:
            return [{"doc_id": doc, "kind": "error", "value": "there is no xbrl element"}]
    rows: list[dict] = []
    _facts(doc, root, None, rows, "f")
    for node in root:
        if node.tag == f"{{{XBRLI}}}context":
            rows.append(_context(doc, node))
        elif node.tag == f"{{{XBRLI}}}unit":
            rows.append(_unit(doc, node))
        elif node.tag == f"{{{LINK}}}schemaRef":
            rows.append({"doc_id": doc, "kind": "schema_ref", "href": node.get(f"{{{XLINK}}}href")})
        elif node.tag == f"{{{LINK}}}footnoteLink":
            rows += _footnotes(doc, node)
    return rows


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as an Arrow batch; columns that they don't have are null."""
    held: dict[str, list] = {}
    for i, row in enumerate(rows):
        for name, value in row.items():
            if value is not None:
                if name not in held:
                    held[name] = [None] * len(rows)
                held[name][i] = value

    def array(f):
        if f.name not in held:
            return pa.nulls(len(rows), f.type)
        values = held[f.name]
        return pa.array([list(v.items()) if v is not None else None for v in values] if pa.types.is_map(f.type) else values, f.type)

    return pa.RecordBatch.from_arrays([array(f) for f in schema], schema=schema)


def _parse(batches):
    for b in batches:
        out: list[dict] = []
        for doc, text in zip(b["doc_id"], b["text"]):
            try:
                out += rows_of(doc.as_py(), text.as_py() or "")
            except ET.ParseError as e:
                out.append({"doc_id": doc.as_py(), "kind": "error", "value": str(e)})
            while len(out) >= ROWS:
                yield batch_of(out[:ROWS], ARROW)
                del out[:ROWS]
        if out:
            yield batch_of(out, ARROW)


def spread(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents dealt out by their ids over as many tasks as shuffles have: a table of few files or row groups would be parsed by as
    few tasks, and short texts would be brought together again."""
    return documents.select(key, "text").repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def parse(documents: DataFrame) -> DataFrame:
    """Raw rows of documents (doc_id, text)."""
    return documents.select("doc_id", "text").mapInArrow(_parse, RAW)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole XML files as documents named by their paths."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def tables(raw: DataFrame, concepts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Facts, contexts, units, footnotes, schema references and errors of raw rows."""
    facts = raw.where("kind = 'fact'").select("doc_id", F.col("id").alias("fact_id"), "parent_id", F.col("name").alias("concept"), "ns", "value", "is_nil", "decimals", "precision", "context_ref", "unit_ref", "ordinal")
    if concepts is not None:
        facts = facts.join(concepts.select("concept", "item_type").dropDuplicates(["concept"]), "concept", "left")
    else:
        facts = facts.withColumn("item_type", F.lit(None).cast("string"))
    facts = facts.withColumn("num", F.when(F.col("unit_ref").isNotNull(), F.trim("value").try_cast("decimal(38,6)")))
    end = F.when(F.col("period_type") != "forever", period_end(F.col("end_text")))
    start = F.when(F.col("period_type") == "duration", period_start(F.col("start_text")))
    contexts = raw.where("kind = 'context'").select("doc_id", F.col("id").alias("context_id"), "scheme", "entity", "period_type", start.alias("start"), end.alias("end"), "dims", "typed_dims", "non_dim", "scenario", "scenario_dims", dims_key(F.col("dims"), F.col("typed_dims")).alias("dims_key"), "start_text", "end_text")
    units = raw.where("kind = 'unit'").select("doc_id", F.col("id").alias("unit_id"), "numerator", "denominator", unit_key(F.col("numerator"), F.col("denominator")).alias("unit_key"))
    return {
        "facts": facts,
        "contexts": contexts,
        "units": units,
        "footnotes": raw.where("kind = 'footnote'").select("doc_id", F.col("id").alias("fact_id"), "role", "lang", F.col("value").alias("text")),
        "schema_refs": raw.where("kind = 'schema_ref'").select("doc_id", "href"),
        "errors": raw.where("kind = 'error'").select("doc_id", F.col("value").alias("message")),
    }


def write_cache(parsed: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Parsed tables as files, to be read instead of the documents."""
    for name, df in parsed.items():
        writer = df.write.mode("overwrite")
        writer.option("compression", "gzip").json(f"{path}/{name}") if kind == "json" else writer.parquet(f"{path}/{name}")


def read_cache(spark: SparkSession, path: str, names=("facts", "contexts", "units", "footnotes", "schema_refs", "errors")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def xml_pieces(facts: DataFrame, contexts: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, x, o, k) of contexts, units and facts: their XML, their part of a document and their place in it; facts with
    their opening and closing tags apart, too."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    attr = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f' {n}="'), esc(c), F.lit('"'))).otherwise(F.lit(""))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    el = lambda n, c: F.concat(F.lit(f"<{n}>"), esc(c), F.lit(f"</{n}>"))
    period = F.when(F.col("period_type") == "instant", el("instant", stamp("end"))).when(F.col("period_type") == "duration", F.concat(el("startDate", stamp("start")), el("endDate", stamp("end")))).otherwise(F.lit("<forever/>"))
    members = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("dims", F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit('<xbrldi:explicitMember dimension="'), e["key"], F.lit('">'), e["value"], F.lit("</xbrldi:explicitMember>"))), "")
    segment = F.when(members != "", F.concat(F.lit("<segment>"), members, F.lit("</segment>"))).otherwise(F.lit(""))
    cx = contexts.select("doc_id", F.concat(F.lit("<context"), attr("id", F.col("context_id")), F.lit("><entity><identifier"), attr("scheme", F.col("scheme")), F.lit(">"), esc(F.col("entity")), F.lit("</identifier>"), segment, F.lit("</entity><period>"), period, F.lit("</period></context>")).alias("x"), F.lit(0).alias("o"), F.col("context_id").alias("k"))
    measures = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda m: F.concat(F.lit("<measure>"), m, F.lit("</measure>"))), "")
    body = F.when(F.coalesce(F.size("denominator"), F.lit(0)) > 0, F.concat(F.lit("<divide><unitNumerator>"), measures(F.col("numerator")), F.lit("</unitNumerator><unitDenominator>"), measures(F.col("denominator")), F.lit("</unitDenominator></divide>"))).otherwise(measures(F.col("numerator")))
    ux = units.select("doc_id", F.concat(F.lit("<unit"), attr("id", F.col("unit_id")), F.lit(">"), body, F.lit("</unit>")).alias("x"), F.lit(1).alias("o"), F.col("unit_id").alias("k"))
    nil = F.when(F.coalesce("is_nil", F.lit(False)), F.lit(' xsi:nil="true"')).otherwise(F.lit(""))
    opening = F.concat(F.lit("<f:"), "concept", attr("id", F.col("fact_id")), attr("contextRef", F.col("context_ref")), attr("unitRef", F.col("unit_ref")), attr("decimals", F.col("decimals")), attr("precision", F.col("precision")), nil, F.lit(' xmlns:f="'), F.coalesce("ns", F.lit("urn:facts")), F.lit('">'))
    closing = F.concat(F.lit("</f:"), "concept", F.lit(">"))
    above = F.col("parent_id") if "parent_id" in facts.columns else F.lit(None).cast("string").alias("parent_id")
    fx = facts.select("doc_id", "fact_id", above, F.coalesce("ordinal", F.lit(0)).alias("ordinal"), opening.alias("opening"), closing.alias("closing"), F.concat(opening, esc(F.col("value")), closing).alias("x"), F.lit(2).alias("o"), F.format_string("%010d", F.coalesce("ordinal", F.lit(0))).alias("k"))
    return cx, ux, fx


def xml_head(schema_ref: str) -> str:
    return f'<xbrl xmlns="{XBRLI}" xmlns:link="{LINK}" xmlns:xlink="{XLINK}" xmlns:xsi="{XSI}" xmlns:xbrldi="{XBRLDI}" xmlns:iso4217="http://www.xbrl.org/2003/iso4217" xmlns:xbrli="{XBRLI}"><link:schemaRef xlink:type="simple" xlink:href="{schema_ref}"/>'


def to_xml(facts: DataFrame, contexts: DataFrame, units: DataFrame, schema_ref: str) -> DataFrame:
    """One XML document a doc_id as text, for documents that fit a row; tuples and what they hold aren't nested. ``xml_sink``
    writes documents of any size, with tuples."""
    cx, ux, fx = xml_pieces(facts, contexts, units)
    every = cx.unionByName(ux).unionByName(fx.select("doc_id", "x", "o", "k")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o", "k", "x"))).alias("p"))
    return every.select("doc_id", F.concat(F.lit(xml_head(schema_ref)), F.array_join(F.transform("p", lambda e: e["x"]), ""), F.lit("</xbrl>")).alias("text"))
