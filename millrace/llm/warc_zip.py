"""WARC records in ZIP packages: written by tasks, read back by byte ranges without extraction.

A package is a ZIP file whose members are stored as they are: ``archive/data-N.warc.gz``, each record a gzip member
of its own, and for each the index ``indexes/data-N.jsonl`` with a line (offset, length, type) for each record. The reader finds the central directory
(ZIP64 too) from the file's end, locates the members, reads an index and then just the byte ranges of its records.

Of records with the same payload digest and at least ``least_bytes`` of payload, the one with the smallest page_id
is a response; the others are revisits that name it and keep only the HTTP head. Defined cases: null html is an
empty payload; rows repeating that smallest page_id are all responses; a null page_id is never the smallest (with
no other, all are responses); a null or unprintable url is percent-encoded or replaced by the record's own name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import struct
import urllib.parse
import zipfile
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import filesystem, new_folder, table, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER_BYTES, PACKAGE_BYTES = 64 << 20, 1 << 30
READ_BYTES = 4 << 20
LEVEL = 4
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, package string, offset long"

# Signatures and field layouts of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def name_of(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def page_of(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC record with its closing line breaks."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]", errors="surrogatepass") if url else name_of(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name_of(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name_of(first)}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record, its block cut by its own Content-Length; a response's payload is digested again."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} isn't what was written")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page_of(fields["warc-refers-to"]) if revisit else None}


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex), first, revisit: which record of each payload is the response.

    Only ids and digests are grouped; the payloads are dealt out by page, so a payload that many pages share
    loads no task.
    """
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    thin = base.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    firsts = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    later = thin.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    return base.join(later, base["page_id"].eqNullSafe(later["p"]) & (base["digest"] == later["d"]), "left").select("page_id", "url", "payload", "digest", "first", F.col("first").isNotNull().alias("revisit"))


def write_packages(rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages of about ``package_bytes`` at most from ``decided`` rows; returns the manifest (path, records, bytes).

    A package is renamed when it is whole, and its name tells the attempt that wrote it: the manifest has those of the
    attempts that ended, whatever others left behind.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        fs, root = filesystem(folder)
        part = TaskContext.get()
        name = f"{part.partitionId():06d}-{part.taskAttemptId()}"
        package, member, index, k, sink = None, None, [], 0, None
        done = total = size = 0  # packages; records and bytes of the open one

        def end_member():
            nonlocal member, index, k
            member.close()
            package.writestr(f"indexes/data-{k}.jsonl", "".join(json.dumps(x) + "\n" for x in index))
            member, index, k = None, [], k + 1

        def end_package():
            nonlocal package, done, total, size, k
            if member is not None:
                end_member()
            package.close()
            sink.close()
            final = f"{root}/part-{name}-{done:04d}.zip"
            fs.move(f"{root}/.writing-{name}", final)
            line = pa.RecordBatch.from_pydict({"path": [final], "records": [total], "bytes": [fs.get_file_info(final).size]})
            package, done, total, size, k = None, done + 1, 0, 0, 0
            return line

        for batch in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/.writing-{name}")
                    package = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                if member is None:
                    member, at = package.open(f"archive/data-{k}.warc.gz", "w", force_zip64=True), 0
                raw = gzip.compress(record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first, revisit), LEVEL, mtime=0)
                member.write(raw)
                index.append([at, len(raw), "revisit" if revisit else "response"])
                at, total, size = at + len(raw), total + 1, size + len(raw)
                if size >= package_bytes:
                    yield end_package()
                elif at >= MEMBER_BYTES:
                    end_member()
        if package is not None:
            yield end_package()

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Package:
    """Random access to the stored members of a ZIP file by byte ranges."""

    def __init__(self, fs, path: str):
        self.size = fs.get_file_info(path).size
        self.file = fs.open_input_file(path)
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """name -> (offset of its local header, stored bytes, method)."""
        tail_at = max(0, self.size - (1 << 16) - 22)
        tail = self.read(tail_at, self.size - tail_at)
        if (end := tail.rfind(END)) < 0:
            raise ValueError("no end of central directory")
        length, start = struct.unpack_from("<II", tail, end + 12)
        count = struct.unpack_from("<H", tail, end + 10)[0]
        if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64 and (start == 0xFFFFFFFF or length == 0xFFFFFFFF or count == 0xFFFF):
            at = struct.unpack_from("<Q", tail, end - 12)[0]
            wide = self.read(at, 56)
            if wide[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            length, start = struct.unpack_from("<QQ", wide, 40)
        raw, at, found = self.read(start, length), 0, {}
        while at + 46 <= len(raw) and raw[at : at + 4] == ENTRY:
            method = struct.unpack_from("<H", raw, at + 10)[0]
            packed, plain, n, m, c = struct.unpack_from("<IIHHH", raw, at + 20)
            offset = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n].decode()
            extra, end = at + 46 + n, at + 46 + n + m
            while extra + 4 <= end:
                kind, size = struct.unpack_from("<HH", raw, extra)
                if kind == 1:  # ZIP64: the fields that don't fit above, in this order
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", raw, extra + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                extra += 4 + size
            found[name] = (offset, packed, method)
            at = end + c
        return found

    def begin(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        offset, size, method = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} isn't stored")
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        return offset + 30 + sum(struct.unpack_from("<HH", head, 26)), size

    def records(self, name: str) -> Iterator[tuple[int, bytes]]:
        """(offset, raw record) in order of the member's index; neighbours come in one read."""
        start, _ = self.begin(name)
        at, size = self.begin(name.replace("archive/", "indexes/").replace(".warc.gz", ".jsonl"))
        wanted = [json.loads(x)[:2] for x in io.BytesIO(self.read(at, size))]
        i = 0
        while i < len(wanted):
            j, begin = i + 1, wanted[i][0]
            end = begin + wanted[i][1]
            while j < len(wanted) and wanted[j][0] == end and end + wanted[j][1] - begin <= READ_BYTES:
                end, j = end + wanted[j][1], j + 1
            got = self.read(start + begin, end - begin)
            for offset, n in wanted[i:j]:
                yield offset, got[offset - begin : offset - begin + n]
            i = j


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the manifest's packages."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        fs, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                package, rows = Package(fs, path), []
                for name in sorted(x for x in package.members if x.startswith("archive/")):
                    for offset, raw in package.records(name):
                        rows.append(parse(gzip.decompress(raw)) | {"package": os.path.basename(path), "offset": offset})
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write_packages(decided(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    return read_packages(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the digest from its hex form, five hex digits (four letters) at a time.
SQL = """
WITH base AS (
  SELECT page_id, coalesce(html, '') AS payload, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), firsts AS (
  SELECT hex, min(page_id) AS first, count(*) AS copies FROM base GROUP BY hex
)
SELECT b.page_id, CAST(octet_length(encode(b.payload)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(b.hex, CAST(i * 5 + 1 AS INTEGER), 5))::INTEGER >> s) & 31) + 1 AS INTEGER), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN f.copies > 1 AND f.first IS NOT NULL AND b.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.copies > 1 AND f.first IS NOT NULL AND b.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM base b JOIN firsts f USING (hex)
"""
