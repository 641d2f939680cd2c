"""WARC archives and transaction assembly.

:func:`write_warc` turns captures (an id, a URL, a payload) into request,
response (or revisit) and metadata records of WARC/1.1, one gzip member a
record.  Requests and metadata name the response they belong to with
``WARC-Concurrent-To``.  Of equal payloads only one is stored, the others
become revisit records that refer to it.  :func:`read_warc` parses archives
record by record, and :func:`assemble` joins the records of a capture through
their concurrent-to identifiers into one nested row.

Archives go to the shared folder; each task writes files under names of its own
and a file counts only if the committed manifest lists it, so repeated or lost
tasks leave no wrong data.  Files end after ``FILE_BYTES``, so a reader's task is
bounded.

Defined cases: a null payload is empty; a null URL gives records without
target; a null id sorts after all others and stays null; of rows with equal
payload and equal id one is the response; an empty table gives no archive;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import file_system, materialize, scratch_dir

FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"  # the date of captures that carry none
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to string, target_uri string, date string, payload_digest string, refers_to string, block_bytes long, payload_bytes long, fields map<string,string>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def classify(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """row, id, url, payload, and of the response that an equal payload has: first_row, first_id.

    Rows are numbered once and written with their number, so both sides of the
    join read the same numbers however a scan is split.  The responses of equal payloads come from a partial aggregate over
    (digest, id); the join back is a plain equi-join on the digest, whose hot
    keys adaptive execution splits.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                        F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = materialize(rows.withColumn("digest", F.sha1("payload")), "warc-rows")
    firsts = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
              .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("f"), F.count("*").alias("n"))
              .filter("n > 1").select("digest", F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row")))
    joined = rows.join(materialize(firsts, "warc-equal-payloads"), "digest", "left")
    return joined.select("row", "id", "url", "payload", "first_row", "first_id")


def _record_id(role: str, row, key) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{role} {row} {key}'.encode()).hexdigest())}>"


def _header(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _record(kind: str, record_id: str, block: bytes, **headers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None and k != "content"]
    lines += [f"Content-Type: {headers['content']}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def capture_records(row: int, key: int | None, url: str | None, payload: bytes, first_row: int | None, first_id: int | None) -> list[bytes]:
    """The three records of one capture."""
    revisit = first_row is not None and first_row != row
    target = None if url is None else _header(url)
    own = _record_id("response", row, key)
    digest = "sha1:" + base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    request = _record("request", _record_id("request", row, key), b"GET / HTTP/1.1\r\n\r\n", Concurrent_To=own, Target_URI=target, content="application/http; msgtype=request")
    if revisit:
        response = _record("revisit", own, http, Target_URI=target, Payload_Digest=digest, Profile=PROFILE,
                           Refers_To=_record_id("response", first_row, first_id), content="application/http; msgtype=response")
    else:
        response = _record("response", own, http + payload, Target_URI=target, Payload_Digest=digest, content="application/http; msgtype=response")
    fields = f"capture-id: {'' if key is None else key}\r\npayload-length: {len(payload)}\r\n".encode("ascii")
    metadata = _record("metadata", _record_id("metadata", row, key), fields, Concurrent_To=own, Target_URI=target, content="application/warc-fields")
    return [request, response, metadata]


def write_warc(pages: DataFrame, out_dir: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write one capture per row; the manifest (folder, file, n_records, n_bytes)."""
    out_dir = out_dir or scratch_dir(pages.sparkSession, "warc")

    def run(batches):
        import pyarrow as pa

        files, folder = file_system(out_dir)
        files.create_dir(folder, recursive=True)
        out, written = None, []
        try:
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    if out is None:
                        name = f"capture-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{folder}/{name}", compression=None)
                        written.append({"file": name, "n_records": 0, "n_bytes": 0})
                    for record in capture_records(*row):
                        out.write(record)
                        written[-1]["n_records"] += 1
                        written[-1]["n_bytes"] += len(record)
                    if written[-1]["n_bytes"] >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pylist(written, schema=pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    rows = classify(pages, id_col, url_col, payload_col, min_bytes)
    manifest = rows.mapInArrow(run, "file string, n_records long, n_bytes long").withColumn("folder", F.lit(out_dir))
    return materialize(manifest, "warc-manifest")


def parse_records(stream):
    """(headers with lower-case names, block) of each record of a decompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_warc(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives listed in ``files`` (folder, file); ``payload`` keeps HTTP payloads."""
    spark = files.sparkSession
    listed = files.select("folder", "file").distinct().collect()  # one row per archive
    names = [part.split()[0] for part in RECORD.split(", ")] + (["payload"] if payload else [])

    def row(headers: dict, block: bytes) -> dict:
        kind = headers.get("warc-type")
        head, _, body = block.partition(b"\r\n\r\n") if "application/http" in headers.get("content-type", "") else (b"", b"", b"")
        fields = {}
        if headers.get("content-type") == "application/warc-fields":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            found = base32_sha1(body)
            if digest not in (None, found):
                raise ValueError(f"payload of {headers.get('warc-record-id')} doesn't fit its digest")
            digest = found
        out = {"record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"),
               "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "payload_digest": digest,
               "refers_to": headers.get("warc-refers-to"), "block_bytes": len(block),
               "payload_bytes": len(body) if kind == "response" else None, "fields": list(fields.items())}
        return out | ({"payload": body} if payload else {})

    def run(batches):
        import pyarrow as pa

        kinds = {"fields": pa.map_(pa.string(), pa.string()), "block_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            for at in batch.to_pylist():
                store, folder = file_system(at["folder"])
                with store.open_input_stream(f"{folder}/{at['file']}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    held, size = [], 0
                    for headers, block in parse_records(stream):
                        held.append(row(headers, block))
                        size += len(block) + 512
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    table = spark.createDataFrame(listed, "folder string, file string").repartition(max(1, len(listed)))
    return table.mapInArrow(run, RECORD + (", payload binary" if payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, request, response (or revisit), metadata (array).

    A response or revisit record names the capture; other records belong to the
    one their concurrent-to identifier names.  A record without such an
    identifier is a capture by itself; a request whose response is missing
    stays, with a null response.
    """
    main = F.col("type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    record = F.struct(*[c for c in records.columns if c != "concurrent_to"])

    def one(condition: Column) -> Column:
        return F.min_by(F.when(condition, record), F.when(condition, F.col("record_id")))

    return records.groupBy(key.alias("capture_id")).agg(
        one(F.col("type") == "request").alias("request"), one(main).alias("response"),
        F.collect_list(F.when(F.col("type") == "metadata", record)).alias("metadata"))


def capture_digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of assembled captures of :func:`write_warc`."""
    rows = captures.select("capture_id", F.col("metadata")[0]["fields"].alias("f"), "response").select(
        "capture_id", F.when(F.col("f")["capture-id"] != "", F.col("f")["capture-id"].cast("long")).alias("page_id"),
        F.coalesce("response.payload_bytes", F.col("f")["payload-length"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"))
    rows = materialize(rows, "warc-captures")
    targets = rows.filter("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    revisits = rows.filter("record_type = 'revisit'").join(targets, "to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return revisits.select(columns).unionByName(rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns))
