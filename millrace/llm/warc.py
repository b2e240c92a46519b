"""WARC archives of pages: writers that store equal payloads once, and a salvage reader.

`write_archives` writes files of plain records, which any WARC tool reads, through Spark's text
source and so to any store; `archives` makes rows (path, content) with a gzip member for each
record. Both have the shape in which Spark's binaryFile source reads archives, which is what
the reader takes. The reader checks a member's checksum, the record's lengths and the block and
payload digests. Where a check fails it searches for the next place at which a member or a
version line begins and is valid, in the archive as well as inside a member, as far as that can
be decompressed; it goes on from there, and reports the bytes between as a quarantined gap."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkit import settle, shared_path, written

#: Uncompressed bytes of records after which a new archive begins.
ARCHIVE = 8 << 20
#: Records of a file, and bytes that are decompressed at a time.
FILE, CHUNK = 1000, 1 << 16
#: Parts among which the pages of one payload are dealt.
SALTS = 16
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
RECORD = "path string, offset long, length long, kind string, reason string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(raw: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(m[1]) if m else None


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(path, content): archives with one record for each row.

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads, empty ones
    included, those with the largest key are responses, the others revisits that refer to
    it. A null key is smaller than all others; if all keys of a payload are null, all its
    rows are responses. A null url is left out. No rows give no archives. Columns not named
    are ignored, whatever their names.
    """
    return _told(pages, key, url, html).mapInPandas(_written, "path string, content binary")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the same records to files in the folder `path`, `FILE` of them to a file at most.
    The text source ends each row with what ends a record."""
    text = _told(pages, key, url, html).mapInPandas(_plain, "record string")
    written(text.write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE).format("text"), pages.sparkSession, path)


def _told(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Pages with what their record says of other pages: _id, _url, _html, _max, _revisit."""
    p = pages.select(F.col(key).cast("long").alias("_id"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    sha = F.sha1(F.col("_html").cast("binary"))
    again = p.select("_id", sha.alias("_sha")).groupBy("_sha").agg(F.max("_id").alias("_max"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # a payload's rows are dealt among several parts, and what is known of it to each; as the
    # size of this table is known when the join is planned, texts are shuffled only if it is large
    again = settle(again.select(F.col("_sha").alias("_sha2"), "_max", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt2")))
    p = p.withColumn("_sha", sha).withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)).cast("int"))
    p = p.join(again, (p["_sha"] == again["_sha2"]) & (p["_salt"] == again["_salt2"]), "left")
    p = p.withColumn("_revisit", F.col("_max").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_max")))
    return p.select(F.col("_id").cast("string").alias("_id"), "_url", "_html", F.when(F.col("_revisit"), F.col("_max")).cast("string").alias("_max"), "_revisit")


def _records(f: pd.DataFrame) -> Iterator[bytes]:
    for i, u, h, m, revisit in f[["_id", "_url", "_html", "_max", "_revisit"]].itertuples(index=False):
        yield write_record(None if i is None else int(i), u, h.encode("utf-8", "surrogatepass"), None if m is None else int(m), revisit)


def _plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        # the writer adds the last line end
        yield pd.DataFrame({"record": [r[:-2].decode() for r in _records(f)]})


def _written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    task = TaskContext.get()
    part, number, size, held = task.partitionId() if task else 0, 0, 0, []
    for f in frames:
        for r in _records(f):
            held.append(member(r))
            size += len(r)
            if size >= ARCHIVE:
                yield pd.DataFrame({"path": [f"pages-{part:06d}-{number:06d}.warc.gz"], "content": [b"".join(held)]})
                number, size, held = number + 1, 0, []
    if held:
        yield pd.DataFrame({"path": [f"pages-{part:06d}-{number:06d}.warc.gz"], "content": [b"".join(held)]})


class Damaged(ValueError):
    """A check of a record failed."""


def parse_record(raw: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at `at`, and where it ends."""
    v = _VERSION.match(raw, at)
    if not v:
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n", v.end() - 2)
    if end < 0:
        raise Damaged("header without end")
    head: dict[str, str] = {}
    for line in raw[v.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("malformed header line")
        head[name.strip().lower()] = value.strip()
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Damaged("no length")
    start, stop = end + 4, end + 4 + int(size)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("truncated or of the wrong length")
    block = raw[start:stop]
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha1:" + digest(block):
        raise Damaged("block digest differs")
    kind = head.get("warc-type", "")
    payload, length = None, len(block)
    if kind in ("response", "revisit") and "application/http" in head.get("content-type", ""):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Damaged("response without header end")
        m = re.search(rb"(?i)^content-length:\s*(\d+)\s*$", block[:cut].replace(b"\r\n", b"\n"), re.M)
        payload = block[cut + 4 :] if kind == "response" else None
        length = int(m[1]) if m else len(payload or b"")
    elif kind == "response":
        payload = block
    told = head.get("warc-payload-digest", "")
    if payload is not None:
        length = len(payload)
        if told and told != "sha1:" + digest(payload):
            raise Damaged("payload digest differs")
        told = "sha1:" + digest(payload)
    return {
        "record_type": kind,
        "page_id": _page(head.get("warc-record-id", "")),
        "url": head.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": told.removeprefix("sha1:"),
        "refers_to": _page(head.get("warc-refers-to", "")),
        "payload": payload,
        "proved": "warc-block-digest" in head,
    }, stop + 4


def _inflate(view: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at `at` holds, as far as it can be decompressed, where it ends,
    and why no further."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        chunk = view[pos : pos + CHUNK]
        if not chunk:
            return b"".join(out), pos, "gzip member without end"
        before = z.copy()
        try:
            out.append(z.decompress(chunk))
        except zlib.error as e:
            # up to the very byte that fails
            with contextlib.suppress(zlib.error):
                for i in range(len(chunk)):
                    out.append(before.decompress(chunk[i : i + 1]))
            return b"".join(out), pos, f"gzip: {e}"
        pos += len(chunk)
    return b"".join(out), pos - len(z.unused_data), None


def _walk(data: bytes, sure: bool) -> Iterator[tuple[int, int, str | None, dict]]:
    """Records and gaps of the decompressed bytes of a member. Where the member's own check
    failed, only records count that a digest proves."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            r, end = parse_record(data, at)
            if not sure and not r["proved"]:
                raise Damaged("no digest in a damaged member")
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            v = _VERSION.search(data, at + 1)
            at = v.start() if v else len(data)
            continue
        if bad is not None:
            yield bad, at, why, {}
            bad = None
        yield at, end, None, r
        at = end
    if bad is not None:
        yield bad, at, why, {}


def salvage(raw: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """(offset, length, reason, record): what an archive holds, in order. A gap has a reason
    and an empty record. Records and gaps inside a member have the member's place; a record
    saved from a member that is damaged itself has length 0, as its bytes are part of the gap."""
    at, n, gz = 0, len(raw), -1
    bad_from, why = None, ""
    view = memoryview(raw)
    while at < n:
        saved: list[dict] = []
        try:
            if raw.startswith(_MAGIC, at):
                data, end, fault = _inflate(view, at)
                got = list(_walk(data, fault is None))
                saved = [r for *_, w, r in got if not w] if fault else []
                if fault or not any(r for *_, r in got):
                    raise Damaged(fault or (got[0][2] if got else "empty member"))
                got = [(f"in the member, bytes {a} to {e}: {w}" if w else None, r) for a, e, w, r in got]
            else:
                one, end = parse_record(raw, at)
                got = [(None, one)]
        except Damaged as e:
            if bad_from is None:
                bad_from, why = at, str(e)
            yield from ((at, 0, None, r) for r in saved)
            if gz <= at:
                gz = raw.find(_MAGIC, at + 1)
                gz = n if gz < 0 else gz
            v = _VERSION.search(raw, at + 1, gz + 16)
            at = min(gz, v.start() if v else n)
            continue
        if bad_from is not None:
            yield bad_from, at - bad_from, why, {}
            bad_from = None
        for w, r in got:
            yield at, end - at, w, r
        at = end
    if bad_from is not None:
        yield bad_from, n - bad_from, why, {}


def _salvaged(payloads: bool):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for f in frames:
            for path, raw in f[["path", "content"]].itertuples(index=False):
                out = []
                for at, size, why, r in salvage(bytes(raw or b"")):
                    row = {"path": path, "offset": at, "length": size, "kind": "gap" if why else "record", "reason": why, **r}
                    if not payloads:
                        row["payload"] = None
                    out.append(row)
                g = pd.DataFrame(out, columns=names)
                yield g.astype({c: "Int64" for c in ("offset", "length", "page_id", "payload_bytes", "refers_to")})

    return rows


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives (path, content), as RECORD. A null or empty file has
    neither. Page numbers are those that `archives` wrote; other names give null."""
    return files.select("path", "content").mapInPandas(_salvaged(payloads), RECORD)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives of pages to files in the shared folder and read them back: key,
    payload_bytes, payload_digest, record_type, refers_to of each record. Pages are told apart
    as in `archives`. A gap in an archive just written ends the query with an error, so no page
    is missing. No pages give no records. Columns not named are ignored."""
    spark = pages.sparkSession
    path = shared_path(spark)
    write_archives(pages, path, key, url, html)
    back = read_archives(spark.read.format("binaryFile").load(path), payloads=False)
    whole = F.when(F.col("kind") == "record", F.col("page_id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", F.col("offset").cast("string"), "reason")).cast("long"))
    return back.select(whole.alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
