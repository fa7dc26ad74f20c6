"""WARC archives: a writer with revisits, and a reader that salvages what lies behind damage.

Archives are runs of gzip members, one per record (plain records are read, too). The reader walks from record to
record. When one fails a check (inflation and its checksum, version line, header lines, Content-Length, closing
blank lines, block and payload digests), the reader looks for the next place where a member (1f 8b 08) or a version
line (WARC/1.) starts and passes every check, goes on there, and logs the bytes between as a quarantined gap. It holds
one record and a read-ahead buffer, whatever the archive's size.

Each writing task writes its own archives, under names that no other attempt uses, and returns them as rows of a
manifest, which Spark commits like any result. Archives of attempts that were lost are in no manifest and never read.

Defined cases: null html is an empty payload; a null url is 'about:blank'; a null id is an empty name, read back as
null; of rows that repeat one id and payload each is a response; an empty table gives no archive and no row; further
columns are ignored. A record that fails its checks is never returned, only logged.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import shared_dir, stage

DATE = "1970-01-01T00:00:00Z"
ROLL = 32 << 20  # bytes after which a task starts another archive
READ = 1 << 20
MOST_HEADER, MOST_MEMBER = 1 << 20, (1 << 31) - (1 << 20)  # bytes of a record's header, and of what a member inflates to; more is damage
MOST_TASKS = 100_000  # tasks of a read; more archives share them
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "kind string, path string, start long, end long, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary, reason string"
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_NAME = "urn:x-page-id:"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: 160 bits are 32 digits of 5, as 4 groups of 40 bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hex_digest, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    return F.concat(*(F.substring(alphabet, (F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for v in groups for i in range(8)))


def _line(x: str) -> str:
    """A header value on one line: control characters and blanks as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), x)


def record(name: str, url: str, payload: bytes | None, digest: str, length: int, refers_to: str | None) -> bytes:
    """A response record, or a revisit record where refers_to names another record; its block ends at the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_NAME}{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to: which rows repeat an earlier payload of at least `least` bytes."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("about:blank")).alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "hex": F.sha1("payload")})
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("hex").alias("h"), F.col("payload_bytes").alias("n")).agg(F.min("page_id").alias("first"))
    rows = rows.join(firsts, (F.col("hex") == F.col("h")) & (F.col("payload_bytes") == F.col("n")), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "payload_bytes", base32(F.col("hex")).alias("digest"), F.when(again, F.col("first")).alias("refers_to"))


def write(rows: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes the records of `planned` rows below folder; returns the manifest (path, records, bytes), already written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        out, path, size, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, n, digest, first = (c[i].as_py() for c in b.columns)
                data = member(record("" if page is None else str(page), url, payload, digest, n, None if first is None else str(first)))
                if out is None:
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stage(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; s3a is Spark's name for s3."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class Damage(Exception):
    """A record that fails a check, with the reason."""


class Salvage:
    """Walks an archive; yields ('record', start, end, headers, payload) and ('gap', start, end, reason, None)."""

    def __init__(self, source, size: int) -> None:  # noqa: ANN001 - any random-access file
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def _bytes(self, start: int, n: int) -> bytes:
        """n bytes from start, fewer at the end of the archive."""
        if start < self.at or start + n > self.at + len(self.held):
            self.at, self.held = start, self.source.read_at(max(n, min(READ, self.size - start)), start) if start < self.size else b""
        return self.held[start - self.at : start - self.at + n]

    def _stream(self, start: int) -> Iterator[bytes]:
        while start < self.size:
            yield (x := self._bytes(start, min(1 << 16, self.size - start)))
            start += len(x)

    def _inflated(self, start: int) -> tuple[bytes, int]:
        z, out, used, size = zlib.decompressobj(31), [], 0, 0
        try:
            for x in self._stream(start):
                out.append(z.decompress(x))
                used, size = used + len(x), size + len(out[-1])
                if size > MOST_MEMBER:
                    raise Damage("member: too long")
                if z.eof:
                    return b"".join(out), start + used - len(z.unused_data)
        except zlib.error as e:
            raise Damage(f"member: {e}") from None
        raise Damage("member: cut off")

    @staticmethod
    def _headers(data: bytes) -> tuple[dict[str, str], int]:
        end = data.find(b"\r\n\r\n", 0, MOST_HEADER)
        if end < 0:
            raise Damage("header: no end")
        first, *lines = data[:end].split(b"\r\n")
        if not re.fullmatch(rb"WARC/1\.[01]", first):
            raise Damage("version line")
        found = {}
        for x in lines:
            name, colon, value = x.decode("utf-8", "replace").partition(":")
            if not colon or not name.strip():
                raise Damage("header: line without a name")
            found[name.strip().lower()] = value.strip()
        if not re.fullmatch(r"[0-9]{1,18}", found.get("content-length", "")) or "warc-type" not in found or "warc-record-id" not in found:
            raise Damage("header: a needed field is missing")
        return found, end + 4

    def _plain(self, start: int) -> tuple[dict[str, str], bytes, int]:
        n = 1 << 12
        while b"\r\n\r\n" not in (data := self._bytes(start, min(n, self.size - start))):
            if n >= min(MOST_HEADER, self.size - start):
                raise Damage("header: no end")
            n *= 4
        found, body = self._headers(data)
        length = int(found["content-length"])
        if start + body + length + 4 > self.size:
            raise Damage("block: cut off")
        data = self._bytes(start + body, length + 4)
        return found, data, start + body + length + 4

    def _record(self, start: int) -> tuple[dict[str, str], bytes, int]:
        """Headers, payload and end of the record at start, or Damage."""
        magic = self._bytes(start, 7)
        if magic.startswith(b"\x1f\x8b\x08"):
            data, end = self._inflated(start)
            found, body = self._headers(data)
            data = data[body:]
        elif magic == b"WARC/1.":
            found, data, end = self._plain(start)
        else:
            raise Damage("no member or version line")
        length = int(found["content-length"])
        if len(data) != length + 4 or data[length:] != b"\r\n\r\n":
            raise Damage("block: length")
        block = data[:length]
        payload = block
        if found.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            if cut < 0:
                raise Damage("block: no end of the HTTP head")
            payload = block[cut + 4 :]
            if m := re.search(rb"(?im)^Content-Length:[ \t]*([0-9]+)", block[: cut + 2]):
                found["http-length"] = m[1].decode()
        checks = [("warc-block-digest", block)] + [("warc-payload-digest", payload)] * (found["warc-type"] != "revisit")
        for field, data in checks:
            if found.get(field, "").startswith("sha1:") and found[field][5:] != base64.b32encode(hashlib.sha1(data).digest()).decode():
                raise Damage(field)
        return found, payload, end

    def _next(self, start: int) -> int:
        """Where the next record that passes all checks starts, at start or later; the archive's size if none does."""
        while start < self.size:
            window = self._bytes(start, min(READ, self.size - start))
            for m in _STARTS.finditer(window):
                try:
                    self._record(start + m.start())
                except Damage:
                    continue
                return start + m.start()
            if start + len(window) >= self.size:
                break
            start += max(1, len(window) - 6)  # a start may lie across two windows
        return self.size

    def __iter__(self) -> Iterator[tuple]:
        at = 0
        while at < self.size:
            try:
                found, payload, end = self._record(at)
            except Damage as e:
                end = self._next(at + 1)
                yield "gap", at, end, str(e), None
            else:
                yield "record", at, end, found, payload
            at = end


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives in manifest's `path`, one archive after another in each task.

    Rows of kind 'record' have the header fields, the payload (unless payloads is false) and its length; rows of kind
    'gap' are the quarantine log: path, byte range and the check that failed there. A record is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.binary() if x.endswith("binary") else pa.int64() if x.endswith("long") else pa.string() for x in RECORD.split(", ")]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = store_of(path)
                with store.open_input_file(at) as source:
                    for kind, start, end, found, payload in Salvage(source, source.size()):
                        if kind == "gap":
                            rows.append((kind, path, start, end, None, None, None, None, None, None, None, found))
                        else:
                            length = int(found.get("http-length", len(payload))) if found["warc-type"] == "revisit" else len(payload)
                            rows.append((kind, path, start, end, found["warc-type"], found["warc-record-id"], found.get("warc-refers-to"), found.get("warc-target-uri"), found.get("warc-payload-digest", "")[5:] or None, length, payload if payloads else None, None))
                            held += len(payload) if payloads else 0
                        if len(rows) >= 4096 or held >= 8 * READ:
                            held = 0
                            yield batch()
        if rows:
            yield batch()

    archives = max(1, min(manifest.count(), MOST_TASKS))  # a number of its own: tasks as small as these would be put together
    return manifest.select("path").repartition(archives, F.col("path")).mapInArrow(run, RECORD)


def page_of(urn: Column) -> Column:
    """The page id in a record's name; null for an empty one."""
    return F.regexp_extract(urn, f"^<{_NAME}(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives of pages, reads them back and returns one row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    What was read is written first, the quarantined gaps with it. A record that was lost on the way is an error, which
    tells where the gaps are.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write(planned(pages), folder)
    return whole(manifest, stage(read(manifest, payloads=False), "records")).select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))



def whole(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """The records of written `read` rows, if they are as many as the manifest says."""
    wrote = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    got = found.where("kind = 'record'").count()
    if got != wrote:
        gaps = [f"{r.path} {r.start}-{r.end}: {r.reason}" for r in found.where("kind = 'gap'").orderBy("path", "start").limit(20).collect()]
        raise RuntimeError(f"{wrote} records were written and {got} read; the first gaps: {gaps}")
    return found.where("kind = 'record'")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first_id from p group by h)
select p.page_id, strlen(p.h)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(sha1(p.h), (1 + 10 * (i // 8))::bigint, 10))::bigint >> (35 - 5 * (i % 8))) & 31) + 1)::bigint, 1)), '') as payload_digest,
  case when p.page_id = f.first_id then 'response' else 'revisit' end as record_type,
  case when p.page_id = f.first_id then null else f.first_id end as refers_to
from p join f on p.h = f.h
"""
