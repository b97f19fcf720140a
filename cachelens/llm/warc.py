"""ARC to WARC: reads legacy archives and writes the equivalent WARC records.

An ARC file starts with a version block whose second line tells the version; version 1 records have the header line
``url ip date type length``, version 2 ``url ip date type status checksum location offset file length``. The declared
length bounds the payload; a newline follows it. Each record becomes a WARC/1.1 record with a record id and a payload
digest synthesised from the content, a W3C timestamp from the 14-digit date, and the target and type of the header. Each
WARC file begins with a warcinfo record. ``archives_to_warc`` converts ARC files, ``pages_to_warc`` a table of pages, which
it frames as ARC first.

Records of equal payloads of at least ``least`` bytes: the one with the largest page_id is the response and the others
are revisits that refer to it, by record id, target and date, and carry no payload but its length and digest; shorter
payloads are always responses. Null payloads are empty and null urls ``urn:none``; white space in a url is escaped. A null
page_id is the least; equal largest ids are all responses. Very long payloads pass whole; memory holds some megabytes of
ARC data and one file's members. Other columns aren't read, whatever their names. An empty table gives no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filesystem, released, written

#: The header lines of the two ARC versions, in field order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
DATE = "19700101000000"
_BAD_URL = re.compile(r"[\x00-\x20\x7f]")


# --- ARC


def _url(url: str | None) -> str:
    return _BAD_URL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def arc_file(records: list[dict], version: int = 1, name: str = "legacy.arc") -> bytes:
    """An ARC file of ``records`` (url, payload, and optionally ip, date, type, status, page_id)."""
    fields = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "length": "Archive-length", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename"}[f] for f in ARC_FIELDS[version])
    about = f"{version} 0 cachelens\n{fields}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {DATE} text/plain " + ("200 - - 0 " + name + " " if version == 2 else "") + str(len(about))
    out = [head.encode() + b"\n" + about + b"\n"]
    size = len(out[0])
    for r in records:
        payload = r.get("payload") or b""
        value = {
            "url": _url(r.get("url")), "ip": r.get("ip") or "0.0.0.0", "date": r.get("date") or DATE, "type": r.get("type") or "text/html",
            "status": str(r.get("status") or 200), "checksum": "-", "location": "-", "offset": str(size), "file": name, "length": str(len(payload)),
        }
        out.append(" ".join(value[f] for f in ARC_FIELDS[version]).encode() + b"\n" + payload + b"\n")
        size += len(out[-1])
    return b"".join(out)


def parse_arc(data) -> Iterator[dict]:
    """The records of an ARC file of either version (bytes or a stream), one in memory at a time. A torn file, or one
    without a version block, raises ValueError."""
    stream, version, n = io.BytesIO(data) if isinstance(data, bytes) else data, None, 0
    while line := stream.readline():
        if line == b"\n":  # separators may repeat
            continue
        n += 1
        fields = line.rstrip(b"\n").decode("utf-8", "surrogateescape").split(" ")
        try:
            length = int(fields[-1])
        except ValueError:
            raise ValueError(f"no length in the header of ARC record {n}") from None
        body = stream.read(length) if length >= 0 else b""
        if not line.endswith(b"\n") or len(body) != length:
            raise ValueError(f"ARC record {n} is cut off")
        if version is None:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("ARC file without a version block")
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        names = ARC_FIELDS[version]
        if len(fields) != len(names):
            raise ValueError(f"ARC header has {len(fields)} fields, version {version} has {len(names)}")
        yield dict(zip(names, fields)) | {"length": length, "payload": body}


# --- WARC


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(arc_date: str) -> str:
    """14 digits to W3C form; shorter dates are filled from the right with the earliest time."""
    d = (arc_date + DATE[len(arc_date) :])[:14] if arc_date.isdigit() else DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page_id: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {page_id} {digest}").urn


def _member(head: list[str], body: bytes) -> bytes:
    return gzip.compress(("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogateescape") + body + b"\r\n\r\n", 1, mtime=0)


def warcinfo(name: str) -> bytes:
    body = b"software: cachelens\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(name, DATE, None, payload_digest(body))}>", f"WARC-Date: {warc_date(DATE)}", f"WARC-Filename: {name}"]
    return _member([*head, "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"], body)


def convert(record: dict, page_id: int | None, winner: dict | None) -> bytes:
    """One gzip member holding the WARC record of a parsed ARC record; ``winner`` (page_id, url, date) makes it a revisit."""
    payload, date, digest = record["payload"], warc_date(record["date"]), payload_digest(record["payload"])
    body = payload if winner is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if winner is None else 'revisit'}", f"WARC-Record-ID: <{record_id(record['url'], date, page_id, digest)}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {record['url']}", f"WARC-IP-Address: {record['ip']}", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: {record['type']}", f"Content-Length: {len(body)}", f"X-Page-ID: {'-' if page_id is None else page_id}",
    ]
    if winner is not None:
        url, when = _url(winner["url"]), warc_date(winner["date"])
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(url, when, winner['page_id'], digest)}>",
            f"WARC-Refers-To-Target-URI: {url}", f"WARC-Refers-To-Date: {when}", f"X-Refers-To-Page: {'-' if winner['page_id'] is None else winner['page_id']}", f"X-Payload-Length: {len(payload)}",
        ]
    return _member(head, body)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of a stream of uncompressed WARC data, one record in memory at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(": ")
            headers[name] = value
        length = int(headers["Content-Length"])
        body = stream.read(length)
        if len(body) < length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"WARC record {headers.get('WARC-Record-ID')} is cut off")
        yield headers, body


# --- the job


def with_winners(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, ip, date, type, payload) with ``winner``: (page_id, url, date) of the largest page_id of the
    payload, for those that revisit it, else null.

    Only (digest, page_id, url, date) are grouped, and only digests of several pages are kept. Payloads stay where they
    were read: the pages of repeated payloads are matched by id, which spreads a payload that fills a third of the table.
    """
    slim = pages.where(F.octet_length("payload") >= least).select("page_id", "url", "date", F.unhex(F.sha1("payload")).alias("digest"))
    groups = slim.groupBy("digest").agg(F.max(F.struct("page_id", "url", "date")).alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = slim.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("winner.page_id")))
    revisits = revisits.groupBy(F.col("page_id").alias("of"), F.col("digest").alias("had")).agg(F.max("winner").alias("winner"))
    out = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    return out.join(revisits.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("had")), "left").drop("digest", "of", "had")


def _to_warc(folder: str, version: int | None, file_bytes: int):
    """Writes rows as WARC files; with a ``version`` they are framed as ARC of that version and parsed first."""

    def records(rows: list[dict]) -> Iterator[dict]:
        if version is None:
            yield from ({"url": _url(r["url"]), "ip": r["ip"], "date": r["date"], "type": r["type"], "payload": r["payload"]} for r in rows)
        else:
            yield from parse_arc(arc_file(rows, version))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out, size = TaskContext.get().partitionId(), 0, [], 0
        fs, root = filesystem(folder)

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{number:04d}.warc.gz"
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft, compression=None) as f:
                f.write(warcinfo(name))
                for member in out:
                    f.write(member)
            fs.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(out)], pa.int64())], ["name", "records"])

        for batch in batches:
            for rows in _portions(batch):
                for r, record in zip(rows, records(rows), strict=True):
                    out.append(convert(record, r["page_id"], r["winner"]))
                    size += len(out[-1])
                    if size >= file_bytes:
                        yield close()
                        number, out, size = number + 1, [], 0
        if out:
            yield close()

    return run


def _portions(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[list[dict]]:
    """A batch's rows in lists of some megabytes."""
    rows, size, names = [], 0, batch.schema.names
    for values in zip(*(batch.column(n) for n in names)):
        rows.append({n: v.as_py() for n, v in zip(names, values)})
        size += len(rows[-1]["payload"])
        if size >= most:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _from_warc(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                rows = []
                for h, body in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(data))):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    revisit = h["WARC-Type"] == "revisit"
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and payload_digest(body) != digest:
                        raise ValueError(f"{name}: payload of {h['WARC-Record-ID']} differs from its digest")
                    number = lambda x: None if x in (None, "-", "None") else int(x)
                    rows.append((number(h["X-Page-ID"]), int(h["X-Payload-Length"]) if revisit else len(body), digest, h["WARC-Type"], number(h.get("X-Refers-To-Page")), h["WARC-Record-ID"].strip("<>"), h["WARC-Date"], h["WARC-Target-URI"], h.get("WARC-Refers-To", "").strip("<>") or None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _OUT)], [n for n, _ in _OUT])

    return run


_OUT = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("refers_to_record", pa.string())]


def _write_warc(rows: DataFrame, folder: str, version: int | None, least: int, file_bytes: int) -> DataFrame:
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    return written(with_winners(rows, least).mapInArrow(released(_to_warc(folder, version, file_bytes)), "name string, records long"), "warc-manifest")


def pages_to_warc(pages: DataFrame, folder: str, version: int = 1, least: int = 0, file_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Frames each page as an ARC record, converts it, and writes ``.warc.gz`` files into ``folder``; gives their names."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    fixed = (F.lit(v).alias(n) for n, v in (("ip", "0.0.0.0"), ("date", DATE), ("type", "text/html")))
    return _write_warc(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), *fixed, payload.alias("payload")), folder, version, least, file_bytes)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("type", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for number, data in zip(batch.column("number").to_pylist(), batch.column("content")):
            raw = data.as_py()
            stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
            rows, size = [], 0
            for k, r in enumerate(parse_arc(stream)):
                text = {n: r[n].encode("utf-8", "replace").decode() for n in ("url", "ip", "date", "type")}
                rows.append(text | {"page_id": (number << 32) + k, "payload": r["payload"]})
                size += len(r["payload"])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files (plain or gzip, of either version): page_id (file by name, then record), url, ip, date, type,
    payload. A task reads a file whole, record after record; Spark takes files of 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    numbers = files.select("path").withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")) - 1)
    listed = files.select("path", "content").join(F.broadcast(numbers), "path").select("number", "content")  # numbers: a row a file
    return listed.mapInArrow(_parsed, "page_id long, url string, ip string, date string, type string, payload binary")


def archives_to_warc(spark: SparkSession, path: str, folder: str, least: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Converts ARC files to WARC files in ``folder``; gives their names."""
    return _write_warc(read_arc(spark, path), folder, None, least, file_bytes)


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string, refers_to_record string"
    return files.repartition(max(1, files.count())).mapInArrow(released(_from_warc(folder)), schema)
