"""WARC archives: writing, reading back, and the external merge of their capture indexes.

Writing uses the plain text writer with CRLF as its line end, so archives appear by Spark's commit
protocol on any file system: a record is one row, ``WARC/1.1`` headers, the HTTP block and the two
CRLFs that end a record.  Files are gzip-compressed and hold a bounded number of records.  Reading
walks each file by Content-Length, so payloads may hold anything.

Index.  Each archive gives a run of captures sorted by (URL key, time, page).  Runs are cut at common
key ranges of about RANGE_ROWS rows, whatever the keys: the time and page are part of the cut, so one
URL with very many captures spans several.  The exchange delivers a range's pieces one after the other,
each in order, and a loser tree merges them: rows come out in global order, range after range, a URL's
captures in time order.  A task holds its range as Arrow columns and one small block of keys per run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, materialize

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
RECORDS_PER_FILE = 4096
#: Captures of one merged range, about; a task holds them (some hundred bytes each).
RANGE_ROWS = 200_000
#: Keys of a run that are Python objects at a time.
HEAD_ROWS = 256
#: Digests of repeated payloads that are sent to every executor; more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
CAPTURE = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
_FIELDS = [x.split()[0] for x in CAPTURE.split(", ")]
_ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in CAPTURE.split(", ")])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def archive_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """One column, ``value``: a WARC record per row, without its last CRLF.

    Among payloads of at least ``least`` bytes that are equal, rows with the smallest page_id are
    ``response`` and others ``revisit`` without payload; where no row has a page_id all are stored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    base = base.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    shared = base.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    shared = materialize(shared, "warc-digests")  # so payloads needn't move where these are few, and a hot one's rows can be split where not
    rows = base.join(F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared, "digest", "left")
    revisit = F.coalesce(F.col("first") < F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1)), F.lit(False))
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    when = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
            F.lit("\r\nWARC-Record-ID: "), name("page_id"),
            F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
            F.lit("\r\nWARC-Date: "), when,
            F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
            F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
            F.lit("\r\n\r\n"), block, F.lit("\r\n"),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    archive_records(pages, least).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path, for sorting; empty without a URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    tail = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port not in (None, 80, 443) else ''}){parts.path or '/'}{tail}".lower()


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, headers by lower-case name, block) of each record of an archive; raises where one is broken."""
    view, at = memoryview(data), 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or data[at : at + 7] != b"WARC/1.":
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:head].decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        body = head + 4
        end = body + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, headers, view[body:end]
        at = end + 4


def _capture(archive: str, offset: int, headers: dict[str, str], block: memoryview) -> tuple:
    number = lambda x: int(x[len("<urn:page:") : -1]) if x[len("<urn:page:") : -1] else None
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
    raw = bytes(block)
    http, _, payload = raw.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{archive}, byte {offset}: the payload doesn't match its digest")
    refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
    return url_key(headers.get("warc-target-uri")), headers["warc-date"], number(headers["warc-record-id"]), size, digest, kind, refers, archive, offset


def _order(x: tuple) -> tuple:
    return x[0], x[1], x[2] is not None, x[2] or 0, x[7], x[8]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def unpacked(data: bytes) -> bytes:
    """An archive's bytes: of a compressed one all gzip members, one after the other."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("the archive's last gzip member is cut short")
        data = member.unused_data.lstrip(b"\0")  # padding between members
    if out and data:
        raise ValueError("bytes behind the archive's last gzip member")
    return b"".join(out) if out else data


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            archive, data = path.as_py().rpartition("/")[2], unpacked(content.as_py())
            if run := sorted((_capture(archive, *r) for r in parse_records(data)), key=_order):
                for at in range(0, len(run), 10_000):
                    yield _table(run[at : at + 10_000])


def loser_tree(runs: list[Iterable[tuple]], key=_order) -> Iterator[tuple]:
    """Merge sorted runs, read one row at a time: a tree of losers, one comparison a level for each row."""
    k = 1
    while k < len(runs):
        k *= 2
    feeds = [iter(r) for r in runs]
    rows = [next(f, None) for f in feeds]
    heads = [(key(r), i) if r is not None else None for i, r in enumerate(rows)] + [None] * (k - len(runs))
    beats = lambda a, b: heads[a] is not None and (heads[b] is None or heads[a] < heads[b])
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while heads and heads[best] is not None:
        yield rows[best]
        rows[best] = next(feeds[best], None)
        heads[best] = (key(rows[best]), best) if rows[best] is not None else None
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


_ORDER = ["urlkey", "captured", "page_id", "archive", "offset"]


def _piece(rows: pa.Table, start: int, stop: int) -> Iterator[tuple]:
    """Sort keys of a run's piece with their row numbers."""
    for at in range(start, stop, HEAD_ROWS):
        block = rows.slice(at, min(HEAD_ROWS, stop - at)).select(_ORDER)
        for n, (url, when, page, archive, offset) in enumerate(zip(*(c.to_pylist() for c in block.columns), strict=True)):
            yield (url, when, page is not None, page or 0, archive, offset), at + n


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    archive = rows.column("archive").combine_chunks()
    archive = archive if isinstance(archive, pa.Array) else archive.chunk(0)
    change = pc.not_equal(archive.slice(1), archive.slice(0, len(archive) - 1)).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(archive)]
    order: list[int] = []

    def block() -> Iterator[pa.RecordBatch]:
        yield from rows.take(pa.array(order)).combine_chunks().to_batches()
        order.clear()

    for _, row in loser_tree([_piece(rows, a, b) for a, b in zip(cuts, cuts[1:], strict=False)], key=lambda x: x[0]):
        order.append(row)
        if len(order) == 10_000:
            yield from block()
    if order:
        yield from block()


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures in the archives below ``path``, in the global order (urlkey, captured, page_id)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = materialize(files.mapInArrow(_runs, CAPTURE), "warc-runs")
    ranges = max(spark.sparkContext.defaultParallelism, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, *_ORDER).sortWithinPartitions("archive", "urlkey", "captured", F.col("page_id").asc_nulls_first(), "offset")
    return dealt.mapInArrow(_merge, CAPTURE)


def archive_round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives, read them back and merge their index.

    Result: the columns of CAPTURE, a row per row of pages.  Null html is an empty payload, null url
    an empty URL key (sorted first), null page_id null; repeated page_ids are records of their own,
    and rows with a group's smallest page_id are all responses; long payloads are stored whole (an archive
    of RECORDS_PER_FILE records is read at once, so its records must fit a task, and stay under 2 GB);
    offset counts bytes of the uncompressed archive; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least)
    return capture_index(spark, path)
