"""WARC archives with a two-level capture index.

Pages are written as gzip members, one per record, into archives of bounded size in the shared
folder; of pages with equal payloads one is a response record and the others revisit it. The
index has a line for each record under its reversed-host key, sorted by key and page, in
compressed blocks; a sparse directory holds each block's first key and place. A lookup
binary-searches the shards' first keys, then a shard's directory, reads one block by its range,
binary-searches the block, and reads the record by its range.

Tasks write files under names of their own and hand on only what they finished, so a task that
runs again leaves a file that nothing refers to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpact.llm.common import fresh_path, saved

#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 1_000
#: An archive that has reached this size is closed.
ARCHIVE_BYTES = 64_000_000
#: Lines of an index block.
BLOCK_LINES = 2_000
#: Records that are this close are read together.
READ_BYTES = 4_000_000
CAPTURED = "2000-01-01T00:00:00Z"

#: Archive bytes and records that a task reads back, and requests that it looks up, about.
TASK_BYTES = 16_000_000
TASK_RECORDS = 10_000
TASK_LOOKUPS = 50_000
#: Payloads that occur more than once are looked up in a broadcast table if there are no more of them
#: (some 20 MB); beyond that they are joined by a shuffle.
SENT_DIGESTS = 200_000
#: Rows of a batch that a task hands on.
BATCH = 10_000

URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?([^#]*)")
#: Stands for a page without id; no escaped id holds a bare percent sign.
NO_PAGE = "%-"


def surt_key(url: str | None) -> str:
    """Reversed-host key: com,example,www)/path?query. Host in lower case, no scheme, port 80 or 443
    or fragment; null is the empty key, and what is no URL is its own key."""
    if url is None:
        return ""
    found = URL.match(url)
    if not found:
        return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    host, port, rest = found.groups()
    host = host.lower()
    if not host.startswith("["):  # an address in brackets stays as it is
        host = ",".join(reversed(host.split(".")))
    port = f":{port}" if port and port not in ("80", "443") else ""
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", f"{host}{port}){rest or '/'}")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def header_text(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def escaped(page: str | None) -> str:
    """A page id as headers and index lines hold it."""
    return NO_PAGE if page is None else re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", page)


def unescaped(page: str) -> str | None:
    return None if page == NO_PAGE else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), page)


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, captured: str = CAPTURED) -> bytes:
    """One WARC/1.1 record as a gzip member, of escaped page ids. A revisit keeps the HTTP header, which tells the full
    payload's length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {captured}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_text(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=6, mtime=0)


def parsed(member: bytes) -> dict:
    """What a record holds; raises where its payload and its digest differ."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have the digest that its record names")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    refers_to = fields.get("WARC-Refers-To")
    return {"page": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "bytes": size, "digest": digest.hex(), "refers_to": page(refers_to) if refers_to else None, "payload": payload}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages; returns (page string (escaped), key, file, offset, length, type, digest) of each record.

    Payloads that occur more than once are found by digest: one aggregation, combined before the
    shuffle. If they are few, which is counted, pages stay where they are and look theirs up;
    else they are joined, which Spark may split where one payload is very common.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    again = saved(again, "repeated")
    again = F.broadcast(again) if again.count() <= SENT_DIGESTS else again.hint("merge")
    planned = rows.join(again, "digest", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id").cast("string")).alias("refers_to"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        name, at = "", 0
        places: list[tuple] = []
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    page, url, body, refers_to, digest = (batch.column(c)[k].as_py() for c in range(5))
                    page = escaped(page)
                    if stream is None:
                        name, at = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz", 0
                        store, path = opened(name)
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        stream = store.open_output_stream(path, compression=None)
                    member = record(page, url, body, None if refers_to is None else escaped(refers_to))
                    stream.write(member)
                    places.append((page, surt_key(url), name, at, len(member), "response" if refers_to is None else "revisit", digest))
                    at += len(member)
                    if at >= ARCHIVE_BYTES:
                        stream.close()
                        stream = None
            if stream is not None:
                stream.close()
                stream = None
        finally:
            if stream is not None:
                stream.close()
        for start in range(0, len(places), BATCH):
            columns = zip(*places[start : start + BATCH], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page", "key", "file", "offset", "length", "type", "digest"])

    return saved(planned.mapInArrow(run, "page string, key string, file string, offset long, length long, type string, digest string"), "records")


def build_index(records: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index; returns its shards (first key, first page, index file, directory file).

    Sorted by key, then page: one very common URL or host is spread over many shards. A line holds
    the key, the page, the place (file, offset, length), the record's type, the payload's digest,
    the status and the type of the content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/index-{uuid.uuid4().hex}"
        stream = None
        directory: list[str] = []
        lines: list[str] = []
        at, first, head = 0, None, ""

        def flush() -> None:
            nonlocal at, lines
            block = gzip.compress("".join(lines).encode(), compresslevel=6, mtime=0)
            stream.write(block)
            directory.append(f"{head}\t{at}\t{len(block)}\n")
            at += len(block)
            lines = []

        for batch in batches:
            for key, page, file, offset, length, kind, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    store, path = opened(name + ".cdx.gz")
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    stream = store.open_output_stream(path, compression=None)
                    first = (key, page)
                if not lines:
                    head = f"{key}\t{page}"
                lines.append(f"{key}\t{page}\t{file}\t{offset}\t{length}\t{kind}\t{digest}\t200\ttext/html\n")
                if len(lines) >= block_lines:
                    flush()
        if stream is None:
            return
        if lines:
            flush()
        stream.close()
        store, path = opened(name + ".dir")
        with store.open_output_stream(path, compression=None) as out:
            out.write("".join(directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*first, name + ".cdx.gz", name + ".dir")], ["key", "page", "index", "directory"])

    plain = records.select("key", "page", "file", "offset", "length", "type", "digest")
    return saved(plain.repartitionByRange("key", "page", "file", "offset").sortWithinPartitions("key", "page", "file", "offset").mapInArrow(run, "key string, page string, index string, directory string"), "shards")


def lines_of(raw: bytes) -> list[str]:
    """Lines that end in a line feed and nothing else: keys may hold other line breaks of Unicode."""
    return raw.decode().split("\n")[:-1]


class IndexReader:
    """Lookups in one task. Keeps the directory and the block read last: lookups come sorted."""

    def __init__(self, shards: list[tuple[str, str, str, str]]) -> None:
        self.shards = sorted(shards)
        self.firsts = [(key, page) for key, page, *_ in self.shards]
        self.at, self.block_at = -1, (-1, -1)
        self.directory: list[tuple[str, str, int, int]] = []
        self.lines: list[tuple[str, ...]] = []

    def enter(self, shard: int) -> None:
        """Read a shard's directory, unless it is at hand."""
        if shard != self.at:
            store, path = opened(self.shards[shard][3])
            with store.open_input_stream(path, compression=None) as f:
                self.directory = [(k, p, int(o), int(n)) for k, p, o, n in (line.split("\t") for line in lines_of(f.read()))]
            self.heads = [(k, p) for k, p, _, _ in self.directory]
            self.at = shard

    def block(self, shard: int, number: int) -> list[tuple[str, ...]]:
        """Lines of a block, read by its range, unless they are at hand."""
        self.enter(shard)
        if self.block_at != (shard, number):
            store, path = opened(self.shards[shard][2])
            with store.open_input_file(path) as f:
                f.seek(self.directory[number][2])
                raw = f.read(self.directory[number][3])
            self.lines = [tuple(line.split("\t")) for line in lines_of(gzip.decompress(raw))]
            self.keys = [(line[0], line[1]) for line in self.lines]
            self.block_at = (shard, number)
        return self.lines

    def find(self, key: str, page: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every record under this key and page. Equal entries may go on
        over blocks and shards; the walk goes back from the last that could hold one."""
        wanted = (key, page)
        shard = bisect_right(self.firsts, wanted) - 1
        while shard >= 0:
            self.enter(shard)
            number = bisect_right(self.heads, wanted) - 1
            while number >= 0:
                lines = self.block(shard, number)
                at = bisect_right(self.keys, wanted)
                while at and self.keys[at - 1] == wanted:
                    at -= 1
                    yield lines[at][2], int(lines[at][3]), int(lines[at][4])
                if at or self.heads[number] != wanted:
                    return
                number -= 1
            shard -= 1


def lookup(requests: DataFrame, shards: DataFrame) -> DataFrame:
    """(page, file, offset, length) of the records that requests (key, page (escaped)) ask for.

    The shard list has one row for each partition that the index was written by, a number that
    the session sets; directories and blocks are read where they are needed. Requests are sorted
    as the index is, so a task reads each block once; their number sets that of the tasks.
    """
    shard_list = [tuple(r) for r in shards.toLocalIterator()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(shard_list)
        found = ((page, *place) for batch in batches for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for place in reader.find(key, page))
        while rows := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page", "file", "offset", "length"])

    asked = requests.select("key", F.coalesce("page", F.lit(NO_PAGE)).alias("page")).distinct()
    tasks = max(1, -(-requests.count() // TASK_LOOKUPS))
    return asked.repartitionByRange(tasks, "key", "page").sortWithinPartitions("key", "page").mapInArrow(run, "page string, file string, offset long, length long")


def read_records(places: DataFrame, payload: bool = False) -> DataFrame:
    """Records at (file, offset, length), read by range: (page, url, payload_bytes, payload_digest,
    record_type, refers_to), and with payload=True also payload binary (null for revisits).

    Records of one stretch of an archive are read by one task and in one go. The tasks' number
    follows the archive bytes and the records that are to be read, not the size of their places.
    """
    n_bytes, n = places.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, -(-n_bytes // TASK_BYTES), -(-n // TASK_RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        start, held = 0, b""
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    store, path = opened(file)
                    name, source, held = file, store.open_input_file(path), b""
                if not start <= offset <= offset + length <= start + len(held):
                    source.seek(offset)
                    start, held = offset, source.read(max(length, READ_BYTES))
                r = parsed(held[offset - start : offset - start + length])
                rows.append((unescaped(r["page"]), r["url"], r["bytes"], r["digest"], r["type"], None if r["refers_to"] is None else unescaped(r["refers_to"]), r["payload"] if r["type"] == "response" else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            n = 7 if payload else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], kinds, strict=False)], names[:n])
        if source is not None:
            source.close()

    stretch = (F.col("offset") / READ_BYTES).cast("long").alias("stretch")
    dealt = places.select("file", "offset", "length", stretch).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    schema = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return dealt.select("file", "offset", "length").mapInArrow(run, schema + (", payload binary" if payload else ""))


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as WARC records, index them, look every one up and read it back.

    Returns id_col, payload_bytes, payload_digest, record_type and refers_to of each record.

    Null html: empty payload. Null URL: the empty key, no target URI. Null id: a record without
    page number; it revisits an equal payload that has one. Repeated rows: one record and one
    result row each; rows of the id that is the response are responses. Ids may be any text. Empty
    table: no archive, empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    folder = fresh_path(spark, "warc")
    records = write_archives(pages, folder, id_col, url_col, html_col)
    shards = build_index(records, folder)
    found = read_records(saved(lookup(records, shards), "places"))
    return found.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
