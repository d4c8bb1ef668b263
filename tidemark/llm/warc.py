"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; the file ends with an index that maps each record's identifier to its
frame and its offset in the frame, and with a seek table. Equal payloads are stored once: one record is the response,
the others revisit it. Duplicates are found on digests alone; the pages themselves are joined with the short list of
revisits.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import filesystem, shared_dir
from tidemark.llm.seekstore import Reader, Writer

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 1000
#: The date written into records, unless a column gives it: archives of equal pages are equal.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    name = urn.rstrip(">").rpartition(":")[2] if urn else "null"
    return None if name == "null" else int(name)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record with its HTTP header; a revisit leaves the payload out and names the response's record."""
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = http if revisit else http + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and end of the record at an offset."""
    head = data.index(b"\r\n\r\n", at)
    fields = dict(x.split(": ", 1) for x in data[at:head].decode().split("\r\n")[1:])
    start = head + 4
    end = start + int(fields["Content-Length"])
    body = data.index(b"\r\n\r\n", start, end) + 4
    fields["Payload-Length"] = data[start:body].decode().partition("Content-Length: ")[2].split("\r\n")[0]
    return fields, data[body:end], end + 4


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """id, url, html, keeper: for a page that repeats another's payload of at least so many bytes, the largest id with that payload.

    Null html is an empty payload; null ids never are keepers; rows that repeat the largest id are responses too. Only
    digests are shuffled to find duplicates, summed up before that; the join that follows is one that Spark can split.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = base.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = keyed.where(F.octet_length("html") >= least).select("id", "digest")
    most = large.groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").drop("n")
    again = large.join(most, "digest").where("id is null or id < keeper").distinct()
    again = again.select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), "keeper")
    return keyed.join(again, F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left").select("id", "url", "html", "keeper")


def write(planned: DataFrame, folder: str | None = None) -> list[str]:
    """Writes an archive for each partition and returns the files' URIs; names are those of attempts that succeeded."""
    spark = planned.sparkSession
    folder = folder or shared_dir(spark, "warc")

    def run(batches):
        store, place = filesystem(folder)
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        out, index = None, []
        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(place, recursive=True)
                stream = store.open_output_stream(f"{place}/{name}", compression=None)
                out = Writer(stream)
            for i, url, html, keeper in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "keeper")), strict=True):
                frame, at = out.add(record(i, url, html.encode(), keeper, keeper is not None))
                index.append((_urn(i), frame, at))
        if out is not None:
            out.finish(json.dumps(index).encode())
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"]})

    return sorted(r["file"] for r in planned.mapInArrow(run, "file string").collect())


def records_of(file: str, wanted: set[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, or those with the wanted identifiers: only their frames are read."""
    store, place = filesystem(file)
    with store.open_input_file(place) as source:
        reader = Reader(source)
        held, data = -1, b""
        for urn, frame, at in json.loads(reader.index):
            if wanted is None or urn in wanted:
                if frame != held:
                    held, data = frame, reader.frame(frame)
                fields, payload, _ = parse(data, at)
                yield fields, payload


def read(spark: SparkSession, files: list[str], wanted: set[str] | None = None) -> DataFrame:
    """page_id, url, payload (null in revisits), payload_bytes, payload_digest, record_type and refers_to of the archives' records. A stored payload is held against its digest."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                kept, size = [], 0
                for fields, payload in records_of(file):
                    kind = fields["WARC-Type"]
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
                    kept.append((_page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload if kind == "response" else None, int(fields["Payload-Length"]), digest, kind, _page_of(fields.get("WARC-Refers-To"))))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=names)
                        kept, size = [], 0
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=names)

    rows = spark.createDataFrame([(f,) for f in files], StructType([StructField("file", StringType())])).repartition(max(1, len(files)), "file")
    out = rows.mapInArrow(run, schema)
    return out if wanted is None else out.where(F.col("page_id").isin(sorted(wanted)))


def archive_digest(found: DataFrame) -> DataFrame:
    """The result columns of the query."""
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(LongType()))
