"""Web archives: monolithic gzip streams, normalised to one member per record.

An archive that was compressed as one stream can only be read from its start. The normaliser
inflates it once, from front to end, rewrites every record as a gzip member of its own and
writes a sidecar index of offsets beside the archive; from then on any record is read alone.

* `write_archives` writes a response record per page, in archives of one gzip stream each, and
  returns a narrow row per record. Pages are not shuffled for it.
* `duplicates` names, from the narrow rows, the records whose payload another one holds. Groups
  of copies are salted: minima are taken by digest and salt, then by digest, so that no task
  meets all copies of a page.
* `normalise` works off one archive in one task, in pieces of bounded size, whatever the length
  of a record. Records named as duplicates become revisits: their HTTP header stays and names
  the payload's length, their payload goes.
* `read_records` reads records by archive, offset and length.

Archives are files in a folder that driver and executors share (any file system that pyarrow
knows by its URI). A task writes under a name of its own and only the rows of the attempt that
succeeds name it, so lost and repeated tasks leave no record twice.

Defined results: a null html is an empty payload; a null url gives no target; a null page_id is
never the smallest, so such a page may revisit another but none revisits it; rows that share
page_id and payload are a response and its revisits; payloads below `MIN_REVISIT` bytes are
always responses; an empty table gives no archive; other columns are not read. A damaged
archive gives its whole records up to the damage, and a row that tells `problem`.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of an archive before compression, and of a piece that is read or inflated at once.
ARCHIVE_BYTES = 128 << 20
PIECE = 1 << 20
MAX_HEADER = 1 << 20
MIN_REVISIT = 100
SALTS = 128
DATE = "1970-01-01T00:00:00Z"

# fixed values: names and forms of the WARC/1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"

_WRITTEN = "page_id long, file string, seq long, record_id string, payload_bytes long, payload_digest string"
_INDEX = "file string, seq long, archive string, offset long, length long, record_type string, record_id string, problem string"
_RECORD = "archive string, offset long, record_type string, page_id long, uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "/", re.sub(r"^s3[an]://", "s3://", uri))
    return pafs.FileSystem.from_uri(uri)


def _gzip():
    return zlib.compressobj(6, zlib.DEFLATED, 31)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _safe(uri: str) -> str:
    """A target without the signs that would end its header line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def _write(folder: str, archive_bytes: int):
    def write(batches):
        fs, root = _open(folder)
        name, out, pack, size, rows = "", None, None, 0, []

        def close():
            out.write(pack.flush())
            out.close()
            return pa.RecordBatch.from_pylist(rows, schema=_arrow(_WRITTEN))

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                if out is None:
                    name, pack, size, rows = f"{uuid.uuid4().hex}.warc.gz", _gzip(), 0, []
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                page_id, url = page_id.as_py(), url.as_py()
                digest = hashlib.sha256(payload).hexdigest()
                record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{len(rows)}')}>"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE)]
                fields += [("WARC-Target-URI", _safe(url))] if url is not None else []
                fields += [("Page-ID", str(page_id))] if page_id is not None else []
                fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", HTTP_RESPONSE), ("Content-Length", str(len(http) + len(payload)))]
                for part in (_header(fields), http, payload, b"\r\n\r\n"):
                    out.write(pack.compress(part))
                    size += len(part)
                rows.append({"page_id": page_id, "file": name, "seq": len(rows), "record_id": record_id, "payload_bytes": len(payload), "payload_digest": digest})
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives when it is evaluated: a row per record with page_id, file (its name in
    the folder), seq (its number there), record_id, payload_bytes and payload_digest."""
    return pages.select("page_id", "url", "html").mapInArrow(_write(folder, archive_bytes), _WRITTEN)


def duplicates(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """file and seq of all records, and of those that revisit another its page_id (refers_to)
    and record_id (refers_record), else null: the one of the smallest page_id among equal
    payloads of `min_bytes` or more."""
    rows = records.withColumn("salt", F.pmod(F.xxhash64("file", "seq"), F.lit(SALTS))).withColumn("sought", F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "file", "seq", "record_id")))
    some = rows.filter("sought is not null").groupBy("sought", "salt").agg(first.alias("first"), F.count("*").alias("n"))
    whole = some.groupBy("sought").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1 and first is not null").drop("n")
    dealt = some.select("sought", "salt").join(whole, "sought")
    joined = rows.join(dealt, ["sought", "salt"], "left")
    itself = (F.col("first.file") == F.col("file")) & (F.col("first.seq") == F.col("seq"))
    kept = F.when(~itself, F.col("first"))
    return joined.select("file", "seq", kept["page_id"].alias("refers_to"), kept["record_id"].alias("refers_record"))


class _Damaged(Exception):
    pass


class _Stream:
    """A gzip stream of any number of members, or plain bytes, inflated piece by piece."""

    def __init__(self, raw):
        self.raw, self.have, self.at, self.rest, self.unpack, self.ended = raw, b"", 0, b"", None, False
        self.plain, self.seen = None, 0

    def _more(self) -> bool:
        """Inflates another piece behind what isn't taken yet."""
        if self.ended:
            return False
        data = self.rest or self.raw.read(PIECE)
        self.rest = b""
        if self.plain is None:
            self.plain = not data.startswith(b"\x1f\x8b")
        if not data:
            self.ended = True
            if self.unpack is not None:
                raise _Damaged("cut off")
            return False
        if not self.plain:
            if self.unpack is None:
                self.unpack = zlib.decompressobj(31)
            try:
                data, unpack = self.unpack.decompress(data, 4 * PIECE), self.unpack
            except zlib.error as e:
                raise _Damaged(f"not inflated: {e}") from None
            self.rest = unpack.unconsumed_tail
            if unpack.eof:
                self.rest, self.unpack = unpack.unused_data, None
        self.have, self.at = self.have[self.at :] + data, 0
        return True

    def until(self, end: bytes, limit: int) -> bytes | None:
        """Up to and with `end`; None at the end of the stream."""
        read = 0
        while (found := self.have.find(end, self.at + read)) < 0:
            read = max(0, len(self.have) - self.at - len(end) + 1)
            if len(self.have) - self.at > limit:
                raise _Damaged("header too long")
            if not self._more():
                if self.have[self.at :].strip():
                    raise _Damaged("cut off")
                return None
        return self.take(found + len(end) - self.at)

    def take(self, n: int) -> bytes:
        out = self.have[self.at : self.at + n]
        self.at += len(out)
        self.seen += len(out)
        return out

    def pieces(self, n: int):
        while n:
            if self.at == len(self.have) and not self._more():
                raise _Damaged("cut off")
            part = self.take(min(n, PIECE))
            n -= len(part)
            if part:
                yield part

    def skip_blank(self) -> None:
        while self.at < len(self.have) or self._more():
            if self.at < len(self.have):
                if self.have[self.at] not in b"\r\n":
                    return
                self.take(1)


def _fields(head: bytes) -> list[tuple[str, str]]:
    first, *lines = head.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise _Damaged("no record where one should start")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and out:  # a folded line goes on
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def _field(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def _records(stream: _Stream):
    """(fields, length) of each record; the caller takes its `length` bytes from the stream."""
    while True:
        stream.skip_blank()
        head = stream.until(b"\r\n\r\n", MAX_HEADER)
        if head is None:
            return
        fields = _fields(head)
        length = _field(fields, "Content-Length") or ""
        if not length.isascii() or not length.isdigit():
            raise _Damaged("no length")
        yield fields, int(length)


def _revisit(fields: list[tuple[str, str]], http: bytes, page_id: int, record_id: str) -> list[tuple[str, str]]:
    gone = {"warc-type", "content-length", "warc-block-digest"}
    out = [("WARC-Type", "revisit")] + [(k, v) for k, v in fields if k.lower() not in gone]
    return out + [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id), ("Refers-To-Page-ID", str(page_id)), ("Content-Length", str(len(http)))]


def _http_header(stream: _Stream, length: int) -> bytes:
    """The HTTP header at the start of a block of `length` bytes, the rest of which is read past."""
    head, done = b"", False
    for part in stream.pieces(length):
        if not done:
            head += part
            done = b"\r\n\r\n" in head or len(head) > MAX_HEADER
    at = head.find(b"\r\n\r\n")
    return head[: at + 4] if at >= 0 else b""


def _normalise(source: str, target: str):
    def normalise(key, table):
        name = key[0].as_py()
        plan = {s: (p, r) for s, p, r in zip(*(table.column(c).to_pylist() for c in ("seq", "refers_to", "refers_record"))) if r is not None}
        fs, root = _open(source)
        to, out_root = _open(target)
        archive, rows, at = f"{re.sub(r'(\.warc)?(\.gz)?$', '', name)}-{uuid.uuid4().hex}.warc.gz", [], 0
        with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, to.open_output_stream(f"{out_root}/{archive}", compression=None) as out:
            stream, problem = _Stream(raw), None
            try:
                for seq, (fields, length) in enumerate(_records(stream)):
                    pack, size = _gzip(), 0
                    if seq in plan:
                        http = _http_header(stream, length)
                        fields, parts = _revisit(fields, http, *plan[seq]), [http]
                    else:
                        parts = stream.pieces(length)
                    for part in itertools.chain([_header(fields)], parts, [b"\r\n\r\n"]):
                        data = pack.compress(part)
                        out.write(data)
                        size += len(data)
                    data = pack.flush()
                    out.write(data)
                    size += len(data)
                    rows.append({"file": name, "seq": seq, "archive": archive, "offset": at, "length": size, "record_type": _field(fields, "WARC-Type"), "record_id": _field(fields, "WARC-Record-ID"), "problem": None})
                    at += size
            except _Damaged as e:
                problem = f"{e} at byte {stream.seen} of the inflated stream"
        with to.open_output_stream(f"{out_root}/{archive}.index", compression=None) as side:
            for r in rows:
                side.write((json.dumps({k: r[k] for k in ("offset", "length", "record_type", "record_id")}) + "\n").encode())
        if problem:
            rows.append({"file": name, "archive": archive, "problem": problem})
        return pa.Table.from_pylist(rows, schema=_arrow(_INDEX))

    return normalise


def normalise(plan: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites the archives of folder `source` that `plan` names (file, seq, refers_to and
    refers_record, as `duplicates` returns them; a row per file will do) to folder `target`, with
    sidecar indexes. A row per record: file, seq, archive (its new file), offset, length,
    record_type, record_id; and one for each damaged archive, with its problem."""
    n = plan.select("file").distinct().count()
    dealt = plan.repartition(max(1, min(2 * n, 8 * common.shuffle_partitions(plan.sparkSession))), "file")  # a number, or tiny rows would end up in one task
    return dealt.groupBy("file").applyInArrow(_normalise(source, target), _INDEX)


def _read(folder: str):
    def read(batches):
        fs, root = _open(folder)
        name, raw, rows, size = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if raw is not None:
                        raw.close()
                    name, raw = archive, fs.open_input_file(f"{root}/{archive}")
                raw.seek(offset)
                data = zlib.decompressobj(31).decompress(raw.read(length))
                head, block = data.split(b"\r\n\r\n", 1)
                fields = _fields(head)
                block = block[: int(_field(fields, "Content-Length"))]
                http, _, payload = block.partition(b"\r\n\r\n") if (_field(fields, "Content-Type") or "").startswith("application/http") else (b"", b"", block)
                declared = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
                digest = _field(fields, "WARC-Payload-Digest") or ""
                number = lambda k: int(v) if (v := _field(fields, k)) is not None else None
                revisit = _field(fields, "WARC-Type") == "revisit"
                rows.append({
                    "archive": archive, "offset": offset, "record_type": _field(fields, "WARC-Type"), "page_id": number("Page-ID"), "uri": _field(fields, "WARC-Target-URI"), "refers_to": number("Refers-To-Page-ID"),
                    "payload_bytes": (int(declared[1]) if declared else None) if revisit else len(payload), "payload_digest": digest.removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(), "payload": None if revisit else payload,
                })
                size += len(payload) + 256
                if size > 4 * PIECE:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_RECORD))
                    rows, size = [], 0
        if raw is not None:
            raw.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_RECORD))

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records at the places of an index (archive, offset, length), each read alone: type,
    page_id, uri, refers_to, payload (null for revisits), and its bytes and digest: of a response
    as read, of a revisit as declared."""
    places = index.filter("offset is not null").select("archive", "offset", "length")
    n = places.select("archive").distinct().count()
    dealt = places.repartition(max(1, min(2 * n, 8 * common.shuffle_partitions(index.sparkSession))), "archive").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(folder), _RECORD)


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages written to monolithic archives, normalised and read back: the columns of
    `read_records`. The monolithic archives go once they are rewritten."""
    spark = pages.sparkSession
    scratch, raw, whole = common.Scratch(spark), common.folder(spark), common.folder(spark)
    records = scratch.table(write_archives(pages, raw, archive_bytes))
    index = common.materialise(normalise(duplicates(records), raw, whole))
    common.remove(spark, raw)
    scratch.drop()
    damaged = index.filter("problem is not null").first()
    if damaged:
        raise OSError(f"{damaged.file}: {damaged.problem}")
    return read_records(index, whole)
