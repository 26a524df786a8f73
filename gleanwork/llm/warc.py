"""WARC writing and reading with segment reassembly.

The writer frames payloads as chunked HTTP responses, replaces repeated
payloads by revisit records, and splits long records into segments. The
reader groups continuation records by their origin, orders them by segment
number, verifies the total length, and removes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm._shared import bound_batches, materialise, new_folder, read_bytes, write_bytes

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_SHARED_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
FILE_BYTES = 24 << 20
LEVEL = 1


def http_block(payload: bytes) -> bytes:
    """An HTTP response whose body is the payload in chunked transfer coding."""
    out = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def dechunked(body: bytes) -> bytes:
    """Body of a chunked message; extensions and trailers are skipped, bad framing raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than it states")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return dechunked(body) if fields.get(b"transfer-encoding", b"").strip().endswith(b"chunked") else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def header_text(value: str | None) -> str:
    return "".join(c for c in value or "" if c not in "\r\n")


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, name: str, refers_url: str | None = None) -> Iterator[bytes]:
    """Records of a page: a revisit, a response, or a response and its continuations."""
    digest = hashlib.sha1(payload).digest()
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", header_text(url))]
    fields = [*shared, ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if is_revisit:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", header_text(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(refers_to))]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *fields, *more, ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = http_block(payload)
    parts = [block[at : at + SEGMENT_BYTES] for at in range(0, len(block), SEGMENT_BYTES)]
    number = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *fields, *number, ("Content-Type", "application/http;msgtype=response")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        seg = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{i}')}>"
        total = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", seg), *shared, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i)), *total], part)


def refer_to(pages: DataFrame) -> DataFrame:
    """Add ``refers_to`` and ``refers_url`` (null for responses) and ``is_revisit`` to ``page_id, url, html``.

    Of equal payloads of at least 1000 bytes, the rows with the largest page
    id are responses and the others revisit it. Only digests move, and each
    task sends one row for each payload it met.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    slim = pages.where(size >= MIN_SHARED_BYTES).select("page_id", "url", F.sha2("html", 256).alias("digest"))
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    groups = materialise(groups.select(F.col("digest").alias("_digest"), F.col("refers_to").alias("_to"), F.col("refers_url").alias("_url")), "warc-repeats")
    # smaller payloads have no group; they are dealt by their page instead of all by null
    own = F.when(size >= MIN_SHARED_BYTES, F.sha2("html", 256)).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id", "url").cast("string")))
    met = pages.withColumn("_own", own).join(groups, F.col("_own") == F.col("_digest"), "left")
    revisit = F.coalesce(F.col("_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_to")), F.lit(False))
    return met.select("page_id", "url", "html", F.when(revisit, F.col("_to")).alias("refers_to"), revisit.alias("is_revisit"), F.when(revisit, F.col("_url")).alias("refers_url"))


MANIFEST = "file string, records long, bytes long"


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as gzipped archives; returns their manifest.

    Each task cuts its rows into files of about 24 MB. A file appears whole and
    under a name of its own; the manifest, written by Spark, lists only files
    of tasks that succeeded, so repeated attempts leave no double records. Null
    html is an empty payload, null page ids and urls are kept as empty fields,
    repeated rows give records of their own, other columns are left out, and
    an empty table writes no file. A revisit names its response by target URI
    and date, and by page.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or new_folder(spark, "warc")
    rows = refer_to(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size = n = 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            write_bytes(name, b"".join([info, *out]))
            made = pa.RecordBatch.from_pydict({"file": pa.array([name]), "records": pa.array([n], pa.int64()), "bytes": pa.array([size + len(info)], pa.int64())})
            out.clear()
            return made

        task = uuid.uuid4().hex
        for batch in batches:
            ids, urls, to, re, to_url = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            html = batch.column(2).cast(pa.binary())
            for i, page in enumerate(ids):
                for data in page_records(page, urls[i], html[i].as_py() or b"", to[i], re[i], f"{folder}/{task}/{n}", to_url[i]):
                    out.append(data)
                    size += len(data)
                n += 1
                if size >= FILE_BYTES:
                    yield close()
                    size = n = 0
                    task = uuid.uuid4().hex
        if out:
            yield close()

    return materialise(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def members(data: bytes) -> Iterator[bytes]:
    """Unpacked members of a gzipped archive, or a plain archive as it is; ValueError where the archive is cut or damaged."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    view = memoryview(data)
    while len(view):
        unpacker = zlib.decompressobj(31)
        try:
            raw = unpacker.decompress(view)
        except zlib.error as e:
            raise ValueError(str(e)) from e
        if not unpacker.eof:
            raise ValueError("archive ends inside a record")
        view = view[len(view) - len(unpacker.unused_data) :]
        yield raw


def archive_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of an archive, gzipped by record or whole, or plain."""
    for raw in members(data):
        at = 0
        while at < len(raw):
            end = raw.find(b"\r\n\r\n", at)
            if end < 0 or not raw.startswith(b"WARC/1.", at):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
            size = fields.get("content-length", "")
            upto = end + 4 + (int(size) if size.isdecimal() else len(raw))
            if raw[upto : upto + 4] != b"\r\n\r\n":
                raise ValueError("record of another length than it states")
            yield fields, raw[end + 4 : upto]
            at = upto + 4


PART = "kind string, page_id long, refers_to long, url string, payload binary, payload_bytes long, payload_digest string, digest_ok boolean, origin string, number long, total long, block binary"


def _number(text: str | None) -> int | None:
    return int(text) if text and text.removeprefix("-").isdecimal() else None


def _base16(field: str) -> str | None:
    """SHA-1 in lower-case hex, of a digest field in base 32 or hex; null for any other."""
    kind, _, value = field.partition(":")
    try:
        raw = base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value) if len(value) == 40 else b""
    except ValueError:
        return None
    return raw.hex() if raw and kind.lower() == "sha1" else None


def _invalid(fields: dict[str, str]) -> dict:
    return {"kind": "invalid", "page_id": _number(fields.get("x-page-id")), "url": fields.get("warc-target-uri")}


def record_row(fields: dict[str, str], block: bytes, keep_payload: bool) -> dict | None:
    """Row of a record: a page, a segment or an invalid one; none for records of other types."""
    kind = fields.get("warc-type")
    try:
        if kind == "continuation":
            total = fields.get("warc-segment-total-length")
            return {"kind": kind, "origin": fields["warc-segment-origin-id"], "number": int(fields["warc-segment-number"]), "total": int(total) if total else None, "block": block}
        if kind == "response" and "warc-segment-number" in fields:
            stated = _base16(fields.get("warc-payload-digest", ""))
            return {"kind": kind, "origin": fields["warc-record-id"], "number": int(fields["warc-segment-number"]), "block": block, "page_id": _number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "payload_digest": stated}
        return _as_page(fields, block, keep_payload) if kind in ("response", "revisit") else None
    except (KeyError, ValueError):
        return _invalid(fields)


def _as_page(fields: dict[str, str], block: bytes, keep_payload: bool) -> dict:
    stated = _base16(fields.get("warc-payload-digest", ""))
    row = {"kind": fields["warc-type"], "page_id": _number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "payload_digest": stated}
    if fields["warc-type"] == "revisit":
        return row | {"refers_to": _number(fields.get("x-refers-to-page")), "payload_bytes": _number(fields.get("x-payload-length")), "digest_ok": True}
    payload = http_payload(block)
    found = hashlib.sha1(payload).hexdigest()
    return row | {"payload": payload if keep_payload else None, "payload_bytes": len(payload), "payload_digest": found, "digest_ok": None if stated is None else found == stated}


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """Block of the segments (number, total length or null, bytes); ValueError if one is missing or the length is not the stated one."""
    parts = sorted(parts, key=lambda x: x[0])
    if [x[0] for x in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] is None:
        raise ValueError("segments are missing")
    block = b"".join(x[2] for x in parts)
    if len(block) != parts[-1][1]:
        raise ValueError("segments of another total length than stated")
    return block


def read_warc(spark: SparkSession, manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Page records of the archives in ``manifest``: ``page_id, url, payload, payload_bytes, payload_digest, digest_ok, record_type, refers_to``.

    Whole records are finished where they are read. Only segmented ones move:
    they are grouped by origin, and a group is one record's segments. Archives
    may be gzipped or plain. ``digest_ok`` is null where no SHA-1 is stated. A
    record that cannot be read (bad fields or framing, missing segments) is a
    row of type ``invalid`` without payload, as is the rest of an archive that
    is cut or damaged; nothing fails the job. Records of other types are left
    out, and an empty manifest gives an empty result.
    """
    schema = pa.schema([("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                records = archive_records(read_bytes(name))
                while True:
                    try:
                        fields, block = next(records)
                    except StopIteration:
                        break
                    except ValueError:
                        rows.append(_invalid({}))
                        break
                    if row := record_row(fields, block, keep_payload):
                        rows.append(row)
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    parts_schema = pa.schema([("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("kind", pa.string())])

    def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                try:
                    payload = http_payload(reassembled([(p["number"], p["total"], p["block"]) for p in x["parts"]]))
                except ValueError:
                    rows.append({"page_id": x["page_id"], "url": x["url"], "kind": "invalid"})
                    continue
                found = hashlib.sha1(payload).hexdigest()
                rows.append({"page_id": x["page_id"], "url": x["url"], "payload": payload if keep_payload else None, "payload_bytes": len(payload), "payload_digest": found, "digest_ok": None if x["stated"] is None else found == x["stated"], "kind": "response"})
            yield pa.RecordBatch.from_pylist(rows, parts_schema)

    files = manifest.select("file").repartition(max(1, min(manifest.count(), 4096)), "file")
    records = materialise(files.mapInArrow(run, PART), "warc-records")  # parsed once for both branches below
    whole = ["page_id", "refers_to", "url", "payload", "payload_bytes", "payload_digest", "digest_ok", "kind"]
    segments = records.where("origin is not null").groupBy("origin").agg(
        F.collect_list(F.struct("number", "total", "block")).alias("parts"), F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("payload_digest").alias("stated")
    )
    ddl = "page_id long, refers_to long, url string, payload binary, payload_bytes long, payload_digest string, digest_ok boolean, kind string"
    rebuilt = segments.mapInArrow(join_segments, ddl)
    return records.where("origin is null").select(*whole).unionByName(rebuilt).withColumnRenamed("kind", "record_type")
