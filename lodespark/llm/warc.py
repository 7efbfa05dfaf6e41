"""WARC archives and a salvage reader.

The reader walks an archive member by member (gzip) or record by record (plain). A record counts only if its version
line, headers, Content-Length, closing blank lines and digests hold, and the gzip member's checksum, if any. Digests may
be of any usual kind, in base32 or hex; one of the block is of all of it, one of the payload of an HTTP message's entity,
too. After a failed check it searches the next place where a valid member or version line begins, goes on from there, and
logs the bytes between as a quarantined gap. The reader holds one record and a window of the archive in memory; a record
that says it is, or inflates to, more than MAX_RECORD bytes is quarantined as too large. No input makes it raise.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_PER_FILE = 256
FAULT_RATE = 0.04
WINDOW = 1 << 16
MAX_RECORD = 1 << 30
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
At = Callable[[int, int], bytes]
SCHEMA = "kind string, file_no long, offset long, length long, page_id long, url string, html string, reason string"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record; a null html is marked, a null url or page_id has no header."""
    body = (html or "").encode()
    head = ["WARC/1.0", "WARC-Type: response"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        if re.search(r"[\x00-\x1f\x7f\\]|^\s|\s$", url):  # can't stand in a header as it is
            head.append("X-Escaped-URI: 1")
            url = re.sub(r"^ | $", r"\\x20", url.encode("unicode_escape").decode())
        head.append("WARC-Target-URI: " + url)
    if html is None:
        head.append("X-Null-Payload: 1")
    head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def fault_of(page_id: int | None, rate: float) -> int:
    """0 for none, or the kind of fault, by the MD5 of page_id."""
    if page_id is None or not rate:
        return 0
    h = int(hashlib.md5(str(page_id).encode()).hexdigest()[:8], 16)
    return 1 + h % 4 if h // 4 < rate * (1 << 30) else 0


def damage(data: bytes, fault: int) -> bytes:
    """1: a byte near its end (a checksum or payload byte) flipped; 2: the second half cut off; 3: junk before it; 4: its first bytes wiped out."""
    m = max(0, len(data) - 8)
    if fault == 1:
        return data[:m] + bytes([data[m] ^ 0x55]) + data[m + 1 :]
    if fault == 2:
        return data[: len(data) // 2]
    if fault == 3:
        return b"\x00\xffjunk WARC/1.0\r\n\x1f\x8b\x08\x00" * 3 + data
    return b"\x00" * 8 + data[8:] if fault == 4 else data


DIGESTS = {"sha1": (hashlib.sha1, 20), "sha256": (hashlib.sha256, 32), "sha512": (hashlib.sha512, 64), "md5": (hashlib.md5, 16)}
ONCE = {b"content-length", b"warc-type", b"warc-record-id", b"warc-date", b"warc-target-uri"}


def entity(body: bytes) -> bytes:
    """What an HTTP message carries, or the whole body if it is none."""
    if not body.startswith(b"HTTP/"):
        return body
    end = body.find(b"\r\n\r\n")
    return body[end + 4 :] if end >= 0 else body


def holds(digest: bytes, *texts: bytes) -> bool:
    """Is the digest (kind:value, base32 or hex) that of one of texts? One of an unknown kind or form isn't checked."""
    kind, _, value = digest.decode("ascii", "replace").partition(":")
    if kind.strip().lower().replace("-", "") not in DIGESTS:
        return True
    make, size = DIGESTS[kind.strip().lower().replace("-", "")]
    value, want = value.strip(), set()
    if re.fullmatch(f"[0-9a-fA-F]{{{2 * size}}}", value):
        want.add(bytes.fromhex(value))
    if re.fullmatch("[A-Za-z2-7]+=*", value) and len(value.rstrip("=")) == -(-8 * size // 5):
        bare = value.rstrip("=").upper()
        want.add(base64.b32decode(bare + "=" * (-len(bare) % 8)))
    return not want or any(make(t).digest() in want for t in texts)


def _length(value: bytes) -> int | None:
    return int(value) if re.fullmatch(rb"[0-9]{1,18}", value) else None


def parse(data: bytes) -> tuple[dict[bytes, bytes], bytes] | str:
    """Headers and payload of a whole record, or what is wrong with it."""
    if not data.startswith(VERSION):
        return "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "header not closed"
    head, last = {}, None
    for line in data[:end].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            head[last] += b" " + line.strip()
            continue
        k, colon, v = line.partition(b":")
        if not colon:
            return "bad header line"
        last = k.strip().lower()
        if last in head and last in ONCE:
            return "repeated header"  # a record cut off in its header runs into the next one's
        head[last] = v.strip()
    size = _length(head.get(b"content-length", b""))
    if size is None:
        return "no content length"
    body, tail = data[end + 4 : end + 4 + size], data[end + 4 + size :]
    if len(body) < size or tail != b"\r\n\r\n":
        return "length mismatch"
    if b"warc-block-digest" in head and not holds(head[b"warc-block-digest"], body):
        return "digest mismatch"
    if b"warc-payload-digest" in head and not holds(head[b"warc-payload-digest"], body, entity(body)):
        return "digest mismatch"
    return head, body


def _gzip_at(at: At, o: int) -> tuple[int, bytes] | str:
    d, pos, out, held = zlib.decompressobj(31), o, [], 0
    while not d.eof:
        piece = at(pos, WINDOW)
        if not piece:
            return "member cut off"
        pos += len(piece)
        while piece and not d.eof:
            try:
                out.append(d.decompress(piece, 1 << 20))
            except zlib.error:
                return "bad member"
            if not held and out[-1]:
                out = [b"".join(out)]
                if len(out[0]) >= len(VERSION) and not out[0].startswith(VERSION):
                    return "no version line"
            held += len(out[-1])
            if held > MAX_RECORD:
                return "too large"
            piece = d.unconsumed_tail
    return pos - len(d.unused_data), b"".join(out)


def _plain_at(at: At, o: int) -> tuple[int, bytes] | str:
    head, pos = b"", o
    while b"\r\n\r\n" not in head:
        piece = at(pos, WINDOW)
        if not piece or len(head) > 16 * WINDOW:
            return "header not closed"
        head += piece
        pos += len(piece)
    end = head.index(b"\r\n\r\n") + 4
    size = _length(next((v for k, _, v in (x.partition(b":") for x in head[:end].split(b"\r\n")) if k.strip().lower() == b"content-length"), b"").strip())
    if size is None:
        return "no content length"
    if size > MAX_RECORD:
        return "too large"
    whole = end + size + 4
    if whole > len(head) and at(o + whole - 4, 4) != b"\r\n\r\n":
        return "length mismatch"  # told without reading what lies between
    return o + whole, at(o, whole)


def _record_at(at: At, o: int) -> tuple[int, dict[bytes, bytes], bytes] | str:
    start = at(o, len(VERSION))
    got = _gzip_at(at, o) if start.startswith(GZIP) else _plain_at(at, o) if start == VERSION else "no member or version line"
    if isinstance(got, str):
        return got
    parsed = parse(got[1])
    return parsed if isinstance(parsed, str) else (got[0], *parsed)


def _next_start(at: At, o: int, size: int) -> int:
    """The next place from o on where a gzip magic or version line stands, or size."""
    while o < size:
        piece = at(o, WINDOW + 8)
        found = [x for x in (piece.find(GZIP), piece.find(VERSION)) if 0 <= x < WINDOW]
        if found:
            return o + min(found)
        o += WINDOW
    return size


def salvage(at: At, size: int, lo: int = 0, hi: int | None = None) -> Iterator[tuple]:
    """Events of an archive in order: ("record", offset, length, headers, payload) or ("gap", offset, length, reason).

    at(o, n) gives up to n bytes from offset o on. With lo and hi, records that begin in lo..hi are given and the gaps
    after them: a reader of a later part of the archive begins at the first valid record from lo on, up to which the
    reader before it goes.
    """
    hi = size if hi is None else hi
    o = lo
    if lo:
        o = _next_start(at, lo, size)
        while o < size and isinstance(_record_at(at, o), str):
            o = _next_start(at, o + 1, size)
    if o >= hi:
        return
    while o < size:
        got = _record_at(at, o)
        if not isinstance(got, str):
            if o >= hi:
                return
            yield "record", o, got[0] - o, got[1], got[2]
            o = got[0]
            continue
        end = _next_start(at, o + 1, size)
        while end < size and isinstance(_record_at(at, end), str):
            end = _next_start(at, end + 1, size)
        yield "gap", o, end - o, got
        o = end


def _row(file_no: int, e: tuple) -> tuple:
    if e[0] == "gap":
        return ("gap", file_no, e[1], e[2], None, None, None, e[3])
    head, body = e[3], e[4]
    found = re.fullmatch(rb"<urn:page:(-?[0-9]{1,18})>", head.get(b"warc-record-id", b""))
    url = head[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in head else None
    if url is not None and b"x-escaped-uri" in head:
        try:
            url = url.encode("ascii").decode("unicode_escape").encode("utf-8", "replace").decode()
        except UnicodeError:
            pass  # it stays as it stands
    text = entity(body) if head.get(b"content-type", b"").lower().startswith(b"application/http") else body
    html = None if b"x-null-payload" in head else text.decode("utf-8", "replace")
    return ("record", file_no, e[1], e[2], int(found[1]) if found else None, url, html, None)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["kind", "file_no", "offset", "length", "page_id", "url", "html", "reason"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def archives(pages: DataFrame, per_file: int = PAGES_PER_FILE, fault_rate: float = 0.0) -> DataFrame:
    """file_no, content: the pages written as archives of per_file consecutive page_ids, in page_id order.

    Archives of even number are gzip members, the others plain. Repeated rows are written again; rows without page_id
    go to archives of negative numbers, about per_file to each. fault_rate damages that share of records, to try the
    reader.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    without = -(-pages.filter("page_id IS NULL").count() // per_file) or 1
    other = F.lit(-1) - F.pmod(F.xxhash64("url", "html"), F.lit(without))
    pages = pages.withColumn("file_no", F.coalesce(F.floor(F.col("page_id") / per_file), other))

    def build(t: pa.Table) -> pa.Table:
        no = t.column("file_no")[0].as_py()
        out = []
        for r in t.sort_by([("page_id", "ascending"), ("url", "ascending"), ("html", "ascending")]).to_pylist():
            data = record(r["page_id"], r["url"], r["html"])
            out.append(damage(member(data) if no % 2 == 0 else data, fault_of(r["page_id"], fault_rate)))
        return pa.table({"file_no": pa.array([no], pa.int64()), "content": pa.array([b"".join(out)], pa.binary())})

    return pages.groupBy("file_no").applyInArrow(build, "file_no long, content binary")


def read_archives(files: DataFrame) -> DataFrame:
    """The records and gaps of archives (file_no, content); a record has page_id, url and html, a gap its reason.

    An empty or null content gives no rows.
    """

    def run(batches):
        for b in batches:
            for no, content in zip(b.column("file_no").to_pylist(), b.column("content"), strict=True):
                data = content.as_py() or b""
                rows, held = [], 0
                for e in salvage(lambda o, n, data=data: data[o : o + n], len(data)):
                    rows.append(_row(no, e))
                    held += e[2]
                    if held > 8 << 20:
                        yield _table(rows)
                        rows, held = [], 0
                if rows:
                    yield _table(rows)

    return files.select("file_no", "content").mapInArrow(run, SCHEMA)


def read_warc(spark: SparkSession, paths: list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """The records and gaps of archive files, file_no being the place in paths.

    Files (any URI that Arrow's file systems know, or local paths) are read in splits of split_bytes, so that a large
    archive is read by many tasks; a split seeks its first valid record. An empty file gives no rows.
    """
    from pyarrow import fs

    def opened(path: str):
        f, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return f, p

    splits = []
    for i, path in enumerate(paths):
        f, p = opened(path)
        size = f.get_file_info(p).size
        splits += [(i, path, lo, min(size, lo + split_bytes)) for lo in range(0, size, split_bytes)]
    parts = spark.createDataFrame(splits, "file_no long, path string, lo long, hi long").repartition(max(1, len(splits)), "file_no", "lo")

    def run(batches):
        for b in batches:
            for no, path, lo, hi in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                f, p = opened(path)
                with f.open_input_file(p) as file:
                    size = file.size()

                    def at(o, n, file=file, size=size):
                        return file.read_at(max(0, min(n, size - o)), o) if o < size else b""

                    rows, held = [], 0
                    for e in salvage(at, size, lo, hi):
                        rows.append(_row(no, e))
                        held += e[2]
                        if held > 8 << 20:
                            yield _table(rows)
                            rows, held = [], 0
                    if rows:
                        yield _table(rows)

    return parts.mapInArrow(run, SCHEMA)


def salvage_pages(pages: DataFrame, per_file: int = PAGES_PER_FILE, fault_rate: float = FAULT_RATE) -> DataFrame:
    """Writes all pages as archives with faults in a share of the records, and reads them with the salvage reader."""
    return read_archives(archives(pages, per_file, fault_rate))
