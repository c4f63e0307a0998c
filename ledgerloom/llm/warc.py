"""WARC archives: a writer through Spark's own file output and a salvage reader.

Writing.  Every record becomes one gzip member of its own.  The text writer of Spark puts raw
bytes through the file-system layer and its commit protocol, so archives land in any store and
survive lost executors.  It ends each row with a separator; a gzip member of less than 16 MiB
ends with a zero byte (the high byte of its length), so the row is the member without that byte
and the separator is the zero byte.  A longer member is followed by an empty one, which ends
with zero too.  The files are ordinary ``.warc.gz`` data with a member per record.

Records of equal payloads of at least ``least`` bytes are stored once: the one with the
smallest id is a ``response``, the others are ``revisit`` records without the payload that
refer to it.  Digests meet ids in light rows only; payloads are moved once, by id.

Reading.  The reader takes whole archives, walks their members and checks each record: member
checksum, version line, header block, content length, payload digest.  After a failed check it
looks for the next place where a valid member or a version line begins, goes on there, and
yields the skipped bytes as a gap.  Archives without compression are read by the same walk, and
so are the inflated bytes of a member: its good records are kept when others are bad, also if it is
damaged or cut off, as far as it can be inflated.  Those rows have the place of the member.  A
member whose checksum alone is wrong, so that no record of it is known to be bad, is a gap.

Defined results: a null payload is an empty one; a null id is kept as null and never revisits;
rows that repeat the smallest id of a digest are all responses; an empty table gives archives
without records, which read back as none; other columns of the table play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1\r\n"
_PREFIX = "urn:record:"


def plan_records(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 100) -> DataFrame:
    """``rec_id, url, payload (null for revisits), n_bytes, digest, refers_to`` for every row."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    light = base.select("rec_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n_bytes")).where(F.col("n_bytes") >= least)
    first = light.groupBy("digest").agg(F.min("rec_id").alias("refers_to"), F.max("rec_id").alias("latest")).where("latest > refers_to")
    again = light.join(first, "digest").where("rec_id > refers_to").select("rec_id", "digest", "refers_to").distinct()
    return (
        base.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.length("payload").cast("long"))
        .join(again, ["rec_id", "digest"], "left")
        .select("rec_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n_bytes", "digest", "refers_to")
    )


def record_bytes(rec_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    revisit = refers_to is not None
    body = b"" if revisit else (payload or b"")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{_PREFIX}{'null' if rec_id is None else rec_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(n_bytes),
        "Content-Length": str(len(body)),
    }
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\r\n]", " ", url)
    if revisit:
        head["WARC-Refers-To"] = f"<{_PREFIX}{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + lines + b"\r\n" + body + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member that ends with a zero byte."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1]:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out


#: Records of up to so many payload bytes share a row of the writer; the greater are written by size class.
PACK = 1 << 19


def write_archives(records: DataFrame, path: str, archive_bytes: int = 64 * PACK) -> None:
    """Writes what :func:`plan_records` gives as archives of about ``archive_bytes`` at most below ``path``.

    Spark rolls files by rows, so rows get a bounded size: small members are joined to rows of
    ``PACK`` bytes; records of up to 8 and up to 64 such units, and longer ones, are written by jobs
    of their own, which run only if there are any, with as many rows a file as always fit.  Only a
    single record may make an archive longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["member"])

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rec_id", "url", "payload", "n_bytes", "digest", "refers_to")]
            for values in zip(*cols, strict=True):
                held.append(member(record_bytes(*values)))
                size += len(held[-1])
                if size >= PACK:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    stored = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    longest = records.agg(F.max("n_bytes").alias("n")).first().n or 0
    bounds = [0, PACK, 8 * PACK, archive_bytes]
    mode = "errorifexists"
    for k, low in enumerate(bounds):
        if k and longest <= low:
            break
        own = records.where(stored > low) if k else records
        if k + 1 < len(bounds):
            own = own.where(stored <= bounds[k + 1])
        most = max(1, archive_bytes // (2 * bounds[k + 1])) if k + 1 < len(bounds) else 1
        rows = own.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
        rows.write.mode(mode).option("lineSep", "\u0000").option("maxRecordsPerFile", most).text(path)
        mode = "append"


#: Where a gzip member or an uncompressed record may begin.
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """The record at ``at`` of uncompressed data: header, body, end; or what is wrong with it."""
    if not _LINE.match(data, at):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "unfinished header"
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        return "no content length"
    begin = end + 4
    stop = begin + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "content length does not fit"
    body = data[begin:stop]
    kind, said = head.get("warc-type"), head.get("warc-payload-digest", "")
    if kind == "response" and head.get("x-payload-length", str(len(body))) != str(len(body)):
        return "payload length does not fit"
    if kind == "response" and said.startswith("sha256:") and hashlib.sha256(body).hexdigest() != said[7:]:
        return "payload digest does not fit"
    return head, body, stop + 4


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int | None]:
    """One gzip member, inflated in steps so that the rest of the archive is never copied, and its end."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    while at < len(data):
        out.append(z.decompress(view[at : at + step]))
        at = min(at + step, len(data))
        if z.eof:
            return b"".join(out), at - len(z.unused_data)
    return b"".join(out), None


def _inflate_part(data: bytes, at: int) -> bytes:
    """What a damaged or unfinished member gives before the first byte that fails."""
    z, out, view, step = zlib.decompressobj(31), [], memoryview(data), 1 << 16
    while at < len(data) and step and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(view[at : at + step]))
            at += step
        except zlib.error:
            z, step = before, step // 2
    return b"".join(out)


def _reached(data: bytes, at: int, size: int) -> int:
    """Where the compressed bytes end that give the first ``size`` bytes of the member at ``at``."""
    z, view, step = zlib.decompressobj(31), memoryview(data), 1 << 16
    while size > 0 and step:
        before = z.copy()
        try:
            size -= len(z.decompress(view[at : at + step], size))
            at = min(at + step, len(data)) - len(z.unconsumed_tail)
        except zlib.error:  # the bytes after ``size`` are bad
            z, step = before, step // 2
    return at


def _inner(plain: bytes) -> list[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """Records and gaps of uncompressed bytes."""
    out, k, lost, why = [], 0, None, None
    while k < len(plain):
        got = _parse(plain, k)
        if isinstance(got, str):
            lost, why = (k, got) if lost is None else (lost, why)
            later = _LINE.search(plain, k + 1)
            k = later.start() if later else len(plain)
            continue
        if lost is not None:
            out.append((lost, k, None, b"", why))
            lost = None
        out.append((k, got[2], got[0], got[1], None))
        k = got[2]
    if lost is not None:
        out.append((lost, len(plain), None, b"", why))
    return out


def _records(data: bytes, at: int) -> tuple[list[tuple[int, int, dict[str, str] | None, bytes, str | None]], int, str | None]:
    """Records and gaps of the member (or the plain record) at ``at``, up to where they go, and what is wrong from there on."""
    if not data.startswith(b"\x1f\x8b\x08", at):
        got = _parse(data, at)
        return ([], at, got) if isinstance(got, str) else ([(at, got[2], got[0], got[1], None)], got[2], None)
    wrong = None
    try:
        plain, stop = _inflate(data, at)
        if stop is None:
            wrong = "unfinished member"
    except zlib.error as e:
        plain, stop, wrong = _inflate_part(data, at), None, f"damaged member: {str(e)[:60]}"
    inner = _inner(plain)
    # If only the checksum of the whole is wrong, any of the headers may be.
    blameless = wrong is not None and wrong.endswith("incorrect data check") and all(x[2] for x in inner)
    if blameless or not any(x[2] for x in inner):
        return [], at if inner or wrong else stop, wrong or (inner[0][4] if inner else None)
    if wrong:
        if inner[-1][2] is None:  # belongs to what is lost
            inner.pop()
        stop = _reached(data, at, inner[-1][1])
    return [(at, stop, head, body, why and f"{why} (bytes {a} to {b} of the member)") for a, b, head, body, why in inner], stop, wrong


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """Yields ``(begin, end, header, body, None)`` per record and ``(begin, end, None, b"", why)`` per gap."""
    at, lost, why = 0, None, None
    while at < len(data):
        got, stop, wrong = _records(data, at)
        if lost is not None and (got or wrong is None):
            yield lost, at, None, b"", why
            lost = None
        yield from got
        if wrong is None:
            at = stop
            continue
        lost, why = (stop, wrong) if lost is None else (lost, why)
        later = _STARTS.search(data, max(stop, at + 1))
        at = later.start() if later else len(data)
    if lost is not None and lost < len(data):
        yield lost, len(data), None, b"", why


_ARCHIVE = (
    "path string, begin long, end long, error string, rec_id long, warc_type string, url string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix(_PREFIX)
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps (rows with ``error``) of every archive below ``path``.

    A worker holds one archive at a time and hands its records on in parts of 4 MB of payload;
    ``write_archives`` bounds archives by bytes.  An archive of 2 GiB or more, which only others
    write, is beyond Spark's file reader, which says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for begin, end, head, body, why in salvage(data):
                    if head is None:
                        rows.append((name, begin, end, why, None, None, None, None, None, None, None))
                        continue
                    size, digest = head.get("x-payload-length", ""), head.get("warc-payload-digest", "")
                    rows.append((
                        name, begin, end, None, _number(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"),
                        int(size) if size.isdigit() else len(body), digest.partition(":")[2] or None, _number(head.get("warc-refers-to")), body if with_payload else None,
                    ))
                    held += len(body)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _ARCHIVE)


class Damaged(RuntimeError):
    """Archives have gaps where there should be none."""


def quarantined(back: DataFrame) -> DataFrame:
    """The log of skipped bytes: ``path, begin, end, error`` of every gap of what :func:`read_archives` gives."""
    return back.where("error is not null").select("path", "begin", "end", "error")


def whole(back: DataFrame) -> DataFrame:
    """The records, if no bytes had to be skipped; raises :class:`Damaged` with the first gaps otherwise."""
    if gaps := quarantined(back).orderBy("path", "begin").limit(5).collect():
        raise Damaged("; ".join(f"{g.path} bytes {g.begin} to {g.end}: {g.error}" for g in gaps))
    return back.where("error is null")


_FIELDS = [(p.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[p.split()[1]]) for p in _ARCHIVE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])
