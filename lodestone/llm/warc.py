"""WARC archives with a two-level capture index.

Pages are range-partitioned and sorted by (SURT key of the URL, page id); each task writes archives of gzip
members, one a record, so records lie in the order of the index. The index has two levels: sorted capture lines
in compressed blocks, and beside them a sparse directory with the first line, offset and length of each block.
A lookup finds the part by the parts' key bounds, the block by binary search in the part's directory, the line
by binary search in the block, and then reads the record's byte range.

A record whose payload has at least REVISIT_LEAST bytes and equals that of a record with a smaller page id is
written as revisit of the smallest; all others are responses. Files are written through pyarrow's file systems
into a folder that all machines share, under names of their own for each attempt: a repeated task leaves files
that no manifest names, never a half-read one.

Defined results: a null html is an empty payload, a null URL has the key of an empty one; pages are told apart
by page id, and a page id that occurs twice with equal payload revisits itself only if another row is smaller
in id; a null page id can't be referred to and sorts last. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import fresh_path, keep

REVISIT_LEAST = 100
#: Bytes of an archive after which a new one begins; capture lines in a block of the index; rows that are Python objects at once.
ARCHIVE_BYTES, BLOCK_LINES, ROWS = 64 << 20, 500, 256
#: Bytes of payload a part of the archives, and of archives that one task reads back, in the mean.
PART_BYTES, READ_BYTES = 256 << 20, 4 << 20
CRLF = b"\r\n"


# -- records


def surt(url: str | None) -> str:
    """The sort key of a URL: host reversed, then port, path and query; lower-case, without scheme and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").lower()
    host = ",".join(reversed(host.removeprefix("www.").split("."))) if host else ""
    port = f":{port}" if port and port not in (80, 443) else ""
    return f"{host}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has no payload; length and digest of the payload stand in its headers."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:" + str(page_id).encode() + b">", b"WARC-Date: 1970-01-01T00:00:00Z"]
    head.append(b"WARC-Target-URI: " + clean(url))
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if kind == "revisit":
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(b"WARC-Refers-To: <urn:page:" + str(refers_to).encode() + b">")
        head.append(b"WARC-Refers-To-Target-URI: " + clean(refers_url))
    head.append(b"Content-Type: text/html; charset=utf-8")
    head.append(b"Content-Length: " + str(len(payload)).encode())
    return gzip.compress(CRLF.join(head) + CRLF + CRLF + payload + CRLF + CRLF, 4, mtime=0)


def clean(url: str | None) -> bytes:
    """A URL on one header line."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    head, _, body = gzip.decompress(member).partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.decode() for k, _, v in (x.partition(b": ") for x in lines[1:])}
    return fields, body[: int(fields["Content-Length"])]


def page_of(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "None" else int(text)


# -- writing


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page and, for each that is a revisit, one more without payload (mark 0) that says of what.

    Columns: key, page_id, url, payload (binary), digest, mark, refers_to, refers_url. Marks and pages meet in the
    writer, so payloads move once, to their place in the order, and never for the search of equal ones.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    p = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    info = keep(p.select("page_id", "url", "digest", F.octet_length("payload").alias("n")).filter(F.col("n") >= REVISIT_LEAST))
    # written before it is joined: the join of two plain exchanges can split a large group
    first = keep(
        info.groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first is not null")
        .select(F.col("digest").alias("_digest"), "first")
    )
    again = info.join(first, (F.col("digest") == F.col("_digest")) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    marks = again.select(surt_column("url").alias("key"), "page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", F.lit(0).alias("mark"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    whole = p.select(surt_column("url").alias("key"), "page_id", "url", "payload", "digest", F.lit(1).alias("mark"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    return whole.unionByName(marks)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Writes archives and index below folder; the manifest, one row a part: part name, first and last key, records, directory.

    pages: the columns of with_revisits. The manifest is kept in the shared folder, so it names each part once.
    """
    spark = pages.sparkSession
    order = ["key", F.col("page_id").asc_nulls_last()]
    spread = pages.repartitionByRange(parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order)
    in_order = spread.sortWithinPartitions(*order, "digest", "mark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_fs(folder)
        files.create_dir(base, recursive=True)
        name, lines, blocks, archive, at, number = uuid.uuid4().hex, [], [], None, 0, 0
        index, index_at, low, high, total, mark, size = None, 0, None, None, 0, None, 0

        def flush() -> None:
            nonlocal index, index_at
            index = index or files.open_output_stream(f"{base}/{name}.cdxz", compression=None)
            body = zlib.compress("".join(lines).encode(), 6)
            index.write(body)
            blocks.append((lines[0].rstrip("\n"), index_at, len(body)))
            index_at += len(body)
            lines.clear()

        for b in batches:
            for row in chain.from_iterable(b.slice(k, ROWS).to_pylist() for k in range(0, b.num_rows, ROWS)):
                if not row["mark"]:
                    mark = row
                    continue
                of = mark if mark and all(mark[c] == row[c] for c in ("key", "page_id", "digest")) else None
                if archive is None or at >= ARCHIVE_BYTES:
                    if archive:
                        archive.close()
                        number += 1
                    archive, at = files.open_output_stream(f"{base}/{name}-{number}.warc.gz", compression=None), 0
                if of:
                    member = record("revisit", row["page_id"], row["url"], b"", row["digest"], of["refers_to"], of["refers_url"])
                else:
                    member = record("response", row["page_id"], row["url"], row["payload"], row["digest"])
                archive.write(member)
                lines.append(capture_line(row["key"], row["page_id"], number, at, len(member)))
                at, total, high, size = at + len(member), total + 1, row["key"], size + len(member)
                low = row["key"] if low is None else low
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        for f in (archive, index):
            if f:
                f.close()
        if total:
            with files.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write("".join(f"{first}\t{o}\t{n}\n" for first, o, n in blocks).encode())
            yield pa.RecordBatch.from_pylist([{"part": name, "low": low, "high": high, "records": total, "archives": number + 1, "blocks": len(blocks), "bytes": size}], schema=MANIFEST)

    return keep(in_order.mapInArrow(write, "part string, low string, high string, records long, archives int, blocks int, bytes long"))


MANIFEST = pa.schema([("part", pa.string()), ("low", pa.string()), ("high", pa.string()), ("records", pa.int64()), ("archives", pa.int32()), ("blocks", pa.int32()), ("bytes", pa.int64())])


def capture_line(key: str, page_id: int | None, archive: int, offset: int, length: int) -> str:
    return f"{one_line(key)} {page_text(page_id)} {archive} {offset} {length}\n"


def one_line(key: str) -> str:
    return key.replace("%", "%25").replace(" ", "%20").replace("\t", "%09").replace("\r", "%0D").replace("\n", "%0A")


def page_text(page_id: int | None) -> str:
    """A page id as text that sorts like the number, null last."""
    return "~" if page_id is None else f"{page_id + (1 << 63):020d}"


def page_number(text: str) -> int | None:
    return None if text == "~" else int(text) - (1 << 63)


def surt_column(url: str):
    """surt() for a column, in Arrow batches."""

    @F.pandas_udf("string")
    def keys(u: pd.Series) -> pd.Series:
        return u.map(lambda x: surt(None if pd.isna(x) else x))

    return keys(F.col(url))


# -- reading


class Part:
    """One part of the archives: its directory in memory, its blocks and records by range reads."""

    def __init__(self, folder: str, name: str):
        self.files, self.base = open_fs(folder)
        self.name = name
        with self.files.open_input_stream(f"{self.base}/{name}.dir", compression=None) as f:
            rows = [x.split("\t") for x in f.read().decode().splitlines()]
        self.firsts, self.spans = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.index = self.files.open_input_file(f"{self.base}/{name}.cdxz")
        self.archives: dict[int, pa.NativeFile] = {}
        self.at, self.lines = -1, []

    def block(self, i: int) -> list[str]:
        if i != self.at:
            offset, n = self.spans[i]
            self.index.seek(offset)
            self.at, self.lines = i, zlib.decompress(self.index.read(n)).decode().split("\n")[:-1]
        return self.lines

    def find(self, key: str, page_id: int | None) -> tuple[int, int, int] | None:
        """(archive, offset, length) of a capture, by binary search in the directory and then in one block."""
        want = f"{one_line(key)} {page_text(page_id)} "
        i = bisect.bisect_right(self.firsts, sortable(want), key=sortable) - 1
        for k in (max(i, 0), i + 1):  # the block that can hold it; the next one, if its first line is it
            if k < len(self.firsts):
                lines = self.block(k)
                j = bisect.bisect_left(lines, sortable(want), key=sortable)
                if j < len(lines) and lines[j].startswith(want):
                    return tuple(map(int, lines[j][len(want) :].split(" ")))
        return None

    def read(self, archive: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        if archive not in self.archives:
            self.archives[archive] = self.files.open_input_file(f"{self.base}/{self.name}-{archive}.warc.gz")
        f = self.archives[archive]
        f.seek(offset)
        return parse_record(f.read(length))

    def close(self) -> None:
        for f in (self.index, *self.archives.values()):
            f.close()


def sortable(line: str) -> tuple[bytes, str]:
    """The order of the parts: keys as Spark sorts them, by bytes, then page ids."""
    key, page, *_ = line.split(" ")
    return key.replace("%20", " ").replace("%09", "\t").replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%").encode(), page


def read_blocks(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record by way of the index: for each block, its capture lines and then the records' byte ranges. Blocks are dealt to as many tasks as their bytes ask for."""
    tasks = manifest.agg(F.ceil(F.sum("bytes") / READ_BYTES)).first()[0] or 1
    blocks = manifest.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).repartition(tasks, "part", "block").sortWithinPartitions("part", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for b in batches:
            for name, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part is None or part.name != name:
                    if part:
                        part.close()
                    part = Part(folder, name)
                out = []
                for line in part.block(i):
                    key, page, archive, offset, length = line.split(" ")
                    fields, payload = part.read(int(archive), int(offset), int(length))
                    out.append(found(page_number(page), fields, payload))
                # column by column: ids keep all their bits beside nulls
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), FOUND)], schema=FOUND)
        if part:
            part.close()

    return blocks.mapInArrow(scan, "page_id long, n long, digest string, record_type string, refers_to long, refers_url string").withColumn("refers_url", F.nullif("refers_url", F.lit("")))


FOUND = pa.schema([("page_id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_url", pa.string())])


def found(page_id: int | None, fields: dict[str, str], payload: bytes) -> tuple:
    refers = page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    kind = fields["WARC-Type"]
    own = kind == "response"
    return page_id, len(payload) if own else None, hashlib.sha256(payload).hexdigest() if own else None, kind, refers, fields.get("WARC-Refers-To-Target-URI")


def lookup(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """page_id, url (both as wanted), n and digest of the record that each (page_id, url) of wanted names; no row where there is none.

    Every wanted row goes to the parts whose key bounds hold its key: one, or two where a key spans parts. The bounds
    are one row a part of the archives.
    """
    bounds = sorted((r["low"], r["high"], r["part"]) for r in manifest.select("low", "high", "part").collect())
    lows, highs, names = [b[0].encode() for b in bounds], [b[1].encode() for b in bounds], [b[2] for b in bounds]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, url in pdf.itertuples(index=False):
                key = surt(None if pd.isna(url) else url)
                k = bisect.bisect_left(highs, key.encode())
                while k < len(names) and lows[k] <= key.encode():
                    out.append((names[k], key, page_id, url))
                    k += 1
            yield pd.DataFrame(out, columns=["part", "key", "page_id", "url"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = None
        for pdf in batches:
            out = []
            for name, key, page_id, url in pdf.itertuples(index=False):
                if part is None or part.name != name:
                    if part:
                        part.close()
                    part = Part(folder, name)
                at = part.find(key, int(page_id))
                if at:
                    _, payload = part.read(*at)
                    out.append((page_id, url, len(payload), hashlib.sha256(payload).hexdigest()))
            yield pd.DataFrame(out, columns=["page_id", "url", "n", "digest"])
        if part:
            part.close()

    routed = wanted.select("page_id", "url").mapInPandas(route, "part string, key string, page_id long, url string")
    spread = routed.repartition("part", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("part", "key")
    return spread.mapInPandas(read, "page_id long, url string, n long, digest string")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives written to folder."""
    folder = folder or fresh_path(spark, "warc")
    payload = pages.agg(F.sum(F.octet_length(F.coalesce(F.col("html"), F.lit(""))))).first()[0] or 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-payload // PART_BYTES))
    manifest = write_archives(with_revisits(pages), folder, parts)
    back = keep(read_blocks(manifest, folder))
    wanted = back.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), F.col("refers_url").alias("url")).distinct()
    seen = lookup(manifest, folder, wanted).select(F.col("page_id").alias("_page"), F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    out = back.join(seen, F.col("refers_to") == F.col("_page"), "left")
    return out.select("page_id", F.coalesce("n", "_n").alias("payload_bytes"), F.coalesce("digest", "_digest").alias("payload_digest"), "record_type", "refers_to")
