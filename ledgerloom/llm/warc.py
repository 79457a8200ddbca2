"""Deterministic sharded WARC writer and reader.

Records are range-partitioned and sorted by id; the borders come from ids chosen by their own hash, so they depend
on the data and not on its files. Each range is written as gzip members, one a record, into files rolled when their
compressed size passes a limit. Record ids, dates, lengths and digests are made anew from the data, so a rerun gives
the same bytes. A file is written under a temporary name of its attempt and renamed when complete. What was written goes
into a manifest of parts, a row a file, written by Spark under a temporary name and renamed; ``manifest.json``, last,
says how many files and records count.

A payload of at least ``REVISIT_MIN`` bytes that an earlier id has too is written as a revisit without its bytes.

Defined cases: a null payload is empty; null ids sort first, have no id header and refer to the smallest
non-null id with an equal payload; ids of any signs are percent-encoded in headers; rows of one id stay in one range; of rows with the same id and payload the first is a response and the others
revisit that id; an empty table gives a manifest without files.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_batches

REVISIT_MIN = 100
ROLL_BYTES = 32 << 20
#: Payload bytes of a range: so many for each of at most ``MOST_RANGES`` ranges, within these bounds.
RANGE_BYTES, LARGEST_RANGE, MOST_RANGES = 8 << 20, 256 << 20, 20_000
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("7a1e0f9c-5d0b-5a77-9b1e-3f5a3c2d1e00")


def _header(kind: str, record: str, uri: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    lines += [f"{k}: {v}" for k, v in fields] + [f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _record_id(page: str, digest: str) -> str:
    return str(uuid.uuid5(_NAMES, f"{page}|{digest}"))


def _member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0, compresslevel=6) as z:
        z.write(data)
    return out.getvalue()


def record(page: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One compressed record; ``refers_to`` makes it a revisit. Ids are marked by a first sign, a null id is empty."""
    digest = hashlib.sha256(payload).hexdigest()
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) or "about:blank"
    fields = [("X-Page-Id", quote(page[1:]))] if page else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        body = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        body = http + b"\r\n"
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{_record_id(refers_to, digest)}>")]
        fields += [("X-Refers-To-Page", quote(refers_to[1:]))] if refers_to else []
    block = hashlib.sha256(body).hexdigest()
    fields += [("WARC-Block-Digest", f"sha256:{block}"), ("Content-Type", "application/http; msgtype=response")]
    return _member(_header("response" if refers_to is None else "revisit", _record_id(page, digest), uri, fields, body))


def _files(root: str):
    """File system and path of a URI; the file systems are those that pyarrow knows."""
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _put(system, path: str, data: bytes):
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as f:
        f.write(data)
    system.move(temporary, path)


def _writer(root: str, roll: int):
    def run(batches):
        system, base = _files(root)
        part, number = None, 0
        held, size, first, n = [], 0, None, 0
        marks: dict[str, str] = {}
        page_now, done = object(), set()

        def close():
            nonlocal held, size, n, number, first
            name, data = f"part-{part:05d}-{number:05d}.warc.gz", b"".join(held)
            _put(system, f"{base}/{name}", data)
            row = pd.DataFrame({"file": [name], "records": [n], "bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()], "first_page": [first]})
            held, size, n, first, number = [], 0, 0, None, number + 1
            return row

        for b in batches:
            for rng, page, mark, url, html, digest, target in zip(b["range"], b["page"], b["mark"], b["url"], b["html"], b["digest"], b["target"]):
                if rng != part:  # files are named by range, so tasks may hold any number of ranges
                    if held:
                        yield close()
                    part, number = rng, 0
                if page != page_now:
                    page_now, marks, done = page, {}, set()
                if mark == 0:  # a note about this page comes before its row
                    marks[digest] = target
                    continue
                payload = (html or "").encode("utf-8", "replace")
                refers = None
                if len(payload) >= REVISIT_MIN:
                    own = hashlib.sha256(payload).hexdigest()
                    refers = marks.get(own, page if own in done else None)
                    done.add(own)
                data = record(page, url or "", payload, refers)
                held.append(data)
                size, n, first = size + len(data), n + 1, page if first is None else first
                if size >= roll:
                    yield close()
        if held:
            yield close()

    return run


def write(pages: DataFrame, path: str | None = None, roll_bytes: int = ROLL_BYTES, range_rows: int | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write the archives and their manifest; returns the folder."""
    spark = pages.sparkSession
    small_batches(spark)
    path = path or scratch_path(spark, "warc")
    system, base = _files(path)
    system.create_dir(base)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("html"))
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    narrow = rows.where(F.octet_length("html") >= REVISIT_MIN).select("id", digest.alias("digest"))
    repeated = narrow.groupBy("digest").agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1 and target is not null")
    notes = narrow.join(repeated, "digest").where(~F.col("id").eqNullSafe(F.col("target"))).select("id", "digest", _marked("target").alias("target")).distinct()
    notes = notes.select("id", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "target")
    every = rows.select("id", F.lit(1).alias("mark"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("target")).unionByName(notes)
    borders = _borders(rows, range_rows or _range_rows(rows))
    dealt = every.withColumn("range", _place("id", borders))
    sorted_rows = dealt.repartitionByRange(len(borders) + 1, "range").sortWithinPartitions("range", F.col("id").asc_nulls_first(), "mark", "url", F.xxhash64("html"))
    made = sorted_rows.select("range", F.coalesce(_marked("id"), F.lit("")).alias("page"), "mark", "url", "html", "digest", "target").mapInPandas(_writer(path, roll_bytes), MANIFEST)
    temporary = f"manifest.{uuid.uuid4().hex}.tmp"
    made.write.json(f"{path}/{temporary}")
    system.move(f"{base}/{temporary}", f"{base}/manifest")
    one = F.crc32(F.concat_ws("|", "file", "sha256").cast("binary"))
    files, records, check = spark.read.schema(MANIFEST).json(f"{path}/manifest").agg(F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum(one), F.lit(0))).first()
    _put(system, f"{base}/manifest.json", json.dumps({"id_type": dict(rows.dtypes)["id"], "files": files, "records": records, "check": check}).encode())
    return path


MANIFEST = "file string, records long, bytes long, sha256 string, first_page string"


def _marked(col: str):
    return F.concat(F.lit("="), F.col(col).cast("string"))


def _range_rows(rows: DataFrame) -> int:
    """Rows to a range: by their average size, and so that there are at most ``MOST_RANGES`` unless ranges get too large."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    wanted = min(max(RANGE_BYTES, size // MOST_RANGES), LARGEST_RANGE)
    return max(1, int(n * wanted / max(size, 1)))


def _borders(rows: DataFrame, range_rows: int, per_range: int = 8, most: int = 200_000) -> list:
    """Ids that part the rows into ranges of about ``range_rows``: every so many of those that their hash picks."""
    n = rows.count()
    ranges = max(1, n // range_rows)
    if ranges == 1:
        return []
    share = min(1.0, min(ranges * per_range, most) / n)
    picked = rows.where(F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) / F.lit(2.0**32) < share)).select("id").distinct()
    ids = sorted(r[0] for r in picked.collect())
    step = max(1, len(ids) // ranges)
    return ids[step::step]


def _place(col: str, borders: list):
    """Number of the range: how many borders are not above the id, counted in coarse steps and then in one step."""
    if not borders:
        return F.lit(0)
    step = max(1, int(len(borders) ** 0.5))
    count = lambda array: F.size(F.filter(array, lambda b: b <= F.col(col)))
    coarse = count(F.lit(borders[step - 1 :: step])) * step
    fine = count(F.slice(F.lit(borders), coarse + 1, F.lit(step)))
    return F.when(F.col(col).isNull(), 0).otherwise(coarse + fine)


def parse(data: bytes):
    """Records of one archive file: header fields and body."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(wbits=31), []
        while not z.eof:
            piece = data[at : at + 65536]
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the files in the manifest, digests checked: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, payload (null for revisits)."""
    system, base = _files(path)
    with system.open_input_stream(f"{base}/manifest.json") as f:
        head = json.loads(f.read())
    kind = head["id_type"]
    schema = f"page_id {kind}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {kind}, payload binary"
    if not head["files"]:
        return spark.createDataFrame([], schema)
    number = kind in ("tinyint", "smallint", "int", "bigint")
    ident = lambda x: None if x is None else int(x) if number else unquote(x)

    def run(batches):
        for b in batches:
            for name, content, expected in zip(b["path"], b["content"], b["sha256"]):
                content = bytes(content)
                if hashlib.sha256(content).hexdigest() != expected:
                    raise ValueError(f"{name} is not the file that the manifest names")
                out = []
                for fields, body in parse(content):
                    if "sha256:" + hashlib.sha256(body).hexdigest() != fields["WARC-Block-Digest"]:
                        raise ValueError(f"{name}: a record's digest is wrong")
                    payload = body.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                    out.append((ident(fields.get("X-Page-Id")), fields["WARC-Target-URI"], fields["WARC-Type"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][7:], ident(fields.get("X-Refers-To-Page")), payload))
                    if len(out) == 500:
                        yield _frame(out, number)
                        out = []
                if out:
                    yield _frame(out, number)

    named = spark.read.schema(MANIFEST).json(f"{path}/manifest").select(F.col("file").alias("_file"), "sha256")
    named = F.broadcast(named) if head["files"] <= 200_000 else named
    files = spark.read.format("binaryFile").load(f"{path}/*.warc.gz").select("path", "content", F.element_at(F.split("path", "/"), -1).alias("_file"))
    return files.join(named, "_file").select("path", "content", "sha256").mapInPandas(run, schema)


def _frame(rows: list[tuple], number: bool) -> pd.DataFrame:
    cols = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    df = pd.DataFrame(rows, columns=cols)
    if number:
        df["page_id"], df["refers_to"] = df["page_id"].astype("Int64"), df["refers_to"].astype("Int64")
    return df
