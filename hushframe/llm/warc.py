"""WARC archives: a writer that deduplicates payloads, and a salvage reader.

The writer puts each page into a gzip member of its own. Of pages with equal payloads of at least ``min_bytes`` bytes the one with the
largest page_id is a response and the others are revisits that refer to it; smaller payloads are all responses. It returns a
manifest of finished files, so what a failed or repeated task left behind is never read.

The reader checks every record: the member's checksum, the version line, the needed headers, the length and the block's digest. After a failed
check it searches on for the next valid member or version line, goes on from there, and logs the bytes between as a quarantined gap. Within a
member it searches the decompressed bytes in the same way, of a cut member what there is. A member that is corrupt (an error or another checksum)
is a gap as a whole: nothing else tells whether its headers are right. Records and gaps of a member have its place in the file.

Rows: one per page row. A null html is an empty payload, a null url is left out, a null page_id is never the largest; rows that repeat the
largest page_id of a payload are all responses; payloads of any length are one record; an empty table makes no files; columns besides
id, url and html are not read, whatever their names. An archive is read whole by one task, so ``read_archives`` takes files up to 2 GB.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import materialize, new_path

FILE_BYTES = 8 << 20
ID = "urn:hushframe:page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_READ = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to) -> bytes:
    """A response with the payload after an HTTP header, or a revisit with the header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if kind == "response" else b""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response"}
    if url:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID}{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class Damaged(Exception):
    pass


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where it ends."""
    if not (version := _VERSION.match(data, at)):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    head = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not {"warc-type", "warc-record-id", "content-length"} <= head.keys() or not head["content-length"].isdigit():
        raise Damaged("a needed header is missing")
    begin, stop = end + 4, end + 4 + int(head["content-length"])
    block = data[begin:stop]
    if len(block) < stop - begin or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the block has another length")
    if head.get("warc-block-digest", "").startswith("sha1:") and head["warc-block-digest"][5:] != digest(block):
        raise Damaged("the block has another digest")
    return head, block, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, where it ends, and whether it is cut short; then what there is of it."""
    unpack, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        for a in range(at, len(data), 1 << 16):
            out.append(unpack.decompress(view[a : a + (1 << 16)]))
            if unpack.eof:
                return b"".join(out), min(a + (1 << 16), len(data)) - len(unpack.unused_data), None
    except zlib.error as e:  # headers have no digest but the member's
        raise Damaged(f"gzip: {e}") from e
    return b"".join(out), len(data), "gzip: the member is cut short"


def _inside(inner: bytes, whole: bool) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The records in a member's bytes, and gaps (start, end, what failed first). Where the member is not whole no record that reaches its end passes."""
    found, gaps, place, gap, why = [], [], 0, None, ""
    while place < len(inner):
        try:
            head, block, end = parse(inner, place)
            if not whole and end == len(inner):
                raise Damaged("nothing follows in a member that is cut short")
        except Damaged as e:
            if gap is None:
                gap, why = place, str(e)
            version = _VERSION.search(inner, place + 1)
            place = version.start() if version else len(inner)
            continue
        if gap is not None:
            gaps.append((gap, place, why))
            gap = None
        found.append((head, block))
        place = end
    if gap is not None:
        gaps.append((gap, place, why))
    return found, gaps


class _Starts:
    """The next place where a member or a record may begin. What was found is kept until it is passed, so the bytes are searched once."""

    def __init__(self, data: bytes):
        self.data, self.member, self.version = data, -1, -1

    def after(self, at: int) -> int:
        end = len(self.data)
        if self.member < at:
            self.member = found if (found := self.data.find(_GZIP, at)) >= 0 else end
        if self.version < at:
            self.version = found.start() if (found := _VERSION.search(self.data, at)) else end
        return min(self.member, self.version)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, length, gap, headers, block) of each record, and of each gap with what failed first."""
    at, gap, why, saved = 0, None, "", []
    starts = _Starts(data)
    while at < len(data):
        inside = []
        try:
            if data.startswith(_GZIP, at):
                inner, end, wrong = _member(data, at)
                found, inside = _inside(inner, wrong is None)
                if wrong and found:
                    # The cut member is a gap of its own, and its records have the gap's place.
                    if gap is not None:
                        yield from _closed(gap, at, why, saved)
                    gap, why, saved = at, wrong, found
                if wrong or inside and not found:
                    raise Damaged(wrong or inside[0][2])
            else:
                head, block, end = parse(data, at)
                if (head, block) in saved:  # stored without compression in the member
                    raise Damaged("a record that was found before")
                found = [(head, block)]
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = starts.after(at + 1)
            continue
        if gap is not None:
            yield from _closed(gap, at, why, saved)
            gap, saved = None, []
        for start, stop, what in inside:
            yield at, end - at, f"{what} (bytes {start} to {stop} of the member)", {}, b""
        for head, block in found:
            yield at, end - at, None, head, block
        at = end
    if gap is not None:
        yield from _closed(gap, at, why, saved)


def _closed(gap: int, end: int, why: str, saved: list):
    yield gap, end - gap, why, {}, b""
    for head, block in saved:
        yield gap, end - gap, None, head, block


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(ID)
    return int(value) if re.fullmatch(r"-?\d+", value) else None


def rows(file: str, data: bytes):
    """Of a whole archive: a row of _READ for each record and each gap."""
    for offset, length, gap, head, block in salvage(data):
        if gap is not None:
            yield file, offset, length, gap, None, None, None, None, None, None, None
            continue
        kind = head["warc-type"]
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            n = re.search(rb"(?i)content-length: *(\d+)", http)
            size, name, payload = int(n[1]) if n else None, head.get("warc-payload-digest", "").removeprefix("sha1:"), None
        else:
            size, name = len(payload), digest(payload)
        yield file, offset, length, None, _page(head["warc-record-id"]), kind, head.get("warc-target-uri"), size, name, _page(head.get("warc-refers-to")), payload


def _batches(found, limit: int = 4 << 20):
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row[-1] or b"") + 200
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _READ, strict=True)], schema=_READ)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _READ, strict=True)], schema=_READ)


_ROW = "file string, offset long, length long, gap string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def decide(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, kind, refers_to): which pages are responses."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    last = own.groupBy("sha").agg(F.max("page_id").alias("last"))
    is_revisit = (F.octet_length("html") >= min_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return own.join(last, "sha").select("page_id", "url", "html", F.when(is_revisit, "revisit").otherwise("response").alias("kind"), F.when(is_revisit, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives of about ``file_bytes`` into the shared folder; returns (file, records, bytes) of those finished."""
    base = new_path(pages.sparkSession, "warc")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        sink, name, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, kind, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if sink is None:
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(name, compression=None)
                data = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), kind, refers_to), 6, mtime=0)
                sink.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"file": [f"{base}/{name.rpartition('/')[2]}"], "records": [n], "bytes": [size]})
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{base}/{name.rpartition('/')[2]}"], "records": [n], "bytes": [size]})

    return materialize(decide(pages, min_bytes).mapInArrow(run, "file string, records long, bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Records and gaps of the files in ``manifest``, each file on its own."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    yield from _batches(rows(file, source.read()))

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(max(parts, manifest.count() // 8), "file").mapInArrow(run, _ROW)


def read_archives(spark: SparkSession, *paths: str) -> DataFrame:
    """Records and gaps of any archives that Spark can reach."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(rows(file, content.as_py()))

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, _ROW)
