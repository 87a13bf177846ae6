"""WARC archives: written with segmented records, read back by reassembling the segments.

A page's record holds an HTTP response in chunked transfer framing. Blocks over ``segment_bytes`` are
cut into a first record and continuation records. The reader groups continuations by the identifier of
their origin, orders them by segment number, checks their number and total length, removes the chunk
framing and checks the payload's digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, written

LONGEST = 64 << 20  # bytes of a block after which a record's beginning within it counts
EOL = b"\r\n"
RECORDS = "record_id string, type string, uri string, refers_to string, digest string, payload_length long, segment long, origin string, total long, block binary, whole boolean"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, intact boolean, record_id string"


def _cut(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` + 3 bytes that end between code points."""
    i = 0
    while i < len(data):
        j = min(i + size, len(data))
        while j < len(data) and data[j] & 0xC0 == 0x80:
            j += 1
        yield data[i:j]
        i = j


def chunked(data: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cut(data, size)) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The body of chunked transfer framing (chunk extensions and trailers are skipped); None if it is broken."""
    out, i = [], 0
    while True:
        j = data.find(EOL, i)
        try:
            n = int(data[i:j].split(b";")[0].strip(), 16) if j >= 0 else -1
        except ValueError:
            return None
        if n < 0 or n and data[j + 2 + n : j + 4 + n] != EOL:
            return None
        if not n:
            return b"".join(out)
        out.append(data[j + 2 : j + 2 + n])
        i = j + 4 + n


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head + EOL + block + EOL  # the archive's line end follows


def _records(name: str, page: str, uri: str, payload: bytes, refers: int | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    uri = "".join(c for c in uri if c not in "\r\n")
    about = [("WARC-Target-URI", uri or None), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Payload-Length", len(payload)), ("X-Page", page)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *about, ("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", profile)], http)
        return
    block = http + chunked(payload, chunk_bytes)
    pieces = list(_cut(block, segment_bytes))
    if len(pieces) == 1:
        pieces, numbers = [block], [None]
    else:
        numbers = list(range(1, len(pieces) + 1))
    for n, piece in zip(numbers, pieces):
        if n is None or n == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, ("WARC-Segment-Number", n)], piece)
        else:
            total = len(block) if n == len(pieces) else None
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}#{n}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], piece)


def write_warc(pages: DataFrame, path: str, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", min_revisit: int = 0, segment_bytes: int = 8192, chunk_bytes: int = 4096) -> None:
    """Write a record for each row of ``pages`` as gzipped WARC files under ``path``.

    Of rows with equal payloads of at least ``min_revisit`` bytes, those with the smallest page_id are
    responses and the others revisit them (a null page_id comes last). A null html is an empty payload, a null
    url is left out. A record's identifier is its page's URN and a row number, so repeated rows stay apart.
    """
    data = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), data)
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    large = rows.where(F.octet_length("html") >= min_revisit).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    large = written(large, "warc-repeats")  # of known size, so that Spark itself can tell whether to broadcast it
    refers = F.when(F.coalesce(F.col("page_id") > F.col("first"), F.lit(True)), F.col("first"))
    rows = rows.join(large, "sha", "left").select("page_id", "url", "html", F.when(F.col("first").isNotNull(), refers).alias("refers"), F.monotonically_increasing_id().alias("row"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, html, ref, row in zip(*(batch.column(c) for c in range(5))):
                page = "" if page.as_py() is None else str(page.as_py())
                out += [r.decode() for r in _records(f"<urn:page:{page}:{row.as_py()}>", page, url.as_py(), html.as_py().encode(), ref.as_py(), segment_bytes, chunk_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(each, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(path)


def _lines(content: bytes) -> Iterator[bytes]:
    """The lines of a file held in memory, plain or gzip; of damaged gzip those before the damage."""

    def pieces() -> Iterator[bytes]:
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        rest = content
        while rest:
            member = zlib.decompressobj(31)
            while not member.eof:
                try:
                    out = member.decompress(rest, 1 << 20)
                except zlib.error:
                    return
                if not out and not member.unconsumed_tail and not member.eof:
                    return
                yield out
                rest = member.unused_data if member.eof else member.unconsumed_tail

    held = b""
    for piece in pieces():
        *whole, held = (held + piece).split(EOL)
        yield from whole
    yield held


def _int(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"[0-9]{1,18}", value) else None


def _parse(lines: Iterator[bytes], longest: int = LONGEST) -> Iterator[tuple]:
    """The records of one file from its lines (as cut at CRLF), in the order of ``RECORDS``; one that ends too soon or has no length is not whole.

    A record whose length takes it beyond its end, so that another begins within its block and nothing ends where the block should, is not whole, and the file is read on from
    the other's first line. Within a block of over ``longest`` bytes the first such line counts at once.
    """
    ahead: deque[bytes] = deque()

    def take() -> bytes | None:
        return ahead.popleft() if ahead else next(lines, None)

    line = take()
    while line is not None:
        if not line.startswith(b"WARC/"):
            line = take()
            continue
        head, key = {}, None
        while (line := take()) and not line.startswith(b"WARC/"):
            if line[:1] in b" \t" and key:
                head[key] += " " + line.strip().decode(errors="replace")
            else:
                key, _, value = line.partition(b":")
                key = key.strip().lower().decode(errors="replace")
                head[key] = value.strip().decode(errors="replace")
        size, held, have, other = _int(head.get("content-length")), [], 0, None
        whole = line == b"" and size is not None
        while whole and have < size:
            line = take()
            if line is None or other and have > longest:
                whole = False
                if line is not None:
                    ahead.appendleft(line)
            else:
                if other is None and held and line.startswith(b"WARC/"):
                    other = len(held)
                held.append(line + EOL)
                have += len(line) + 2
        if other:
            after = take()
            if after is not None:
                ahead.appendleft(after)
            # behind the block: the rest of its last line, else the next line; a record that begins there ends this one as an empty line does
            behind = held[-1][:-2][size - have + 2 :] if whole and have > size + 2 else after
            if not whole or behind and not behind.startswith(b"WARC/"):
                ahead.extendleft(x[:-2] for x in reversed(held[other:]))
                held, whole = held[:other], False
        block = b"".join(held)
        if not line or not line.startswith(b"WARC/") or held:  # not the start of the next record, met within the header
            rest = block[size:-2] if whole else b""  # what stands in the block's last line where the record's end should be
            line = rest or take()
        digest = head.get("warc-payload-digest")
        yield (
            head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, _int(head.get("x-payload-length")), _int(head.get("warc-segment-number")),
            head.get("warc-segment-origin-id"), _int(head.get("warc-segment-total-length")), block[:size] if whole else block, whole,
        )


_RECORDS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_length", pa.int64()), ("segment", pa.int64()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary()), ("whole", pa.bool_())])


def _batches(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record[9])
        if len(held) == 1000 or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _RECORDS)], schema=_RECORDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _RECORDS)], schema=_RECORDS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path`` as they stand, continuations apart.

    Archives named ``.gz`` are streamed line by line and take the memory of one record, however large they are; a file that
    can't be decompressed further ends there. Other archives are held in memory whole, one to a task at a time.
    """

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for _, lines in groupby(rows, lambda row: row[0]):
            yield from _batches(_parse(line for _, line in lines))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(_parse(_lines(content.as_py())))

    lines = spark.read.option("lineSep", "\r\n").option("pathGlobFilter", "*.gz").option("ignoreCorruptFiles", "true").text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))  # a number that changes with the file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{*[^z],*[^g]z,*[^.]gz}").load(path).select("content")
    return lines.mapInArrow(streamed, RECORDS).union(files.mapInArrow(held, RECORDS))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a response or revisit under ``path``, segments reassembled: page_id, payload_bytes, payload_digest, record_type, refers_to, uri, intact, record_id.

    page_id and refers_to are the numbers of this module's identifiers, null for any others. ``intact`` is false where a
    record is cut short or has no length, segments are missing or repeated, lengths differ, the framing is broken or a SHA-1
    digest doesn't match; such rows keep the header's figures, as far as it has them. Continuations without a first record are one
    row, not intact; without an origin each is one. A digest that isn't SHA-1 is not checked, one that is missing is computed.
    """
    records = read_records(spark, path)
    kept = records.where("type is null or lower(type) in ('response', 'revisit', 'continuation')")
    single = F.col("segment").isNull() | ((F.col("segment") != 1) & F.col("origin").isNull()) | ((F.col("segment") == 1) & F.col("record_id").isNull())
    heads = ("type", "uri", "refers_to", "digest", "payload_length")
    parts_ = kept.where(~single).groupBy(F.when(F.col("segment") == 1, F.col("record_id")).otherwise(F.col("origin")).alias("record_id")).agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in heads], F.max("total").alias("total"), F.min("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts")
    )
    pieces = "record_id", *heads, "total", "whole"
    both = kept.where(single).select(*pieces, F.array(F.struct(F.coalesce("segment", F.lit(1)).cast("long").alias("segment"), "block")).alias("parts")).union(parts_.select(*pieces, "parts"))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("intact", pa.bool_()), ("record_id", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_page(r) for r in batch.to_pylist()], schema)

    return both.mapInArrow(each, RESULT)


def _number(urn: str | None) -> int | None:
    """The page's number in an identifier of this module."""
    at = re.fullmatch(r"<?urn:page:(-?[0-9]{1,19})(?::[0-9]+)?>?", urn or "")
    return int(at[1]) if at and -(1 << 63) <= int(at[1]) < 1 << 63 else None


def _page(r: dict) -> dict:
    kind = (r["type"] or "").lower() or None
    numbers = [p["segment"] for p in r["parts"]]
    block = b"".join(p["block"] or b"" for p in r["parts"])
    intact = r["whole"] and kind in ("response", "revisit") and numbers == list(range(1, len(numbers) + 1)) and (r["total"] is None) == (len(numbers) == 1) and r["total"] in (None, len(block))
    n, (method, _, digest) = r["payload_length"], (r["digest"] or "").rpartition(":")
    if kind == "response" and intact:
        head, _, body = block.partition(EOL + EOL)
        payload = unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body
        intact = payload is not None and n in (None, len(payload))
        if intact and not digest:
            digest = base32_sha1(payload)
        elif intact and method.lower() in ("", "sha1"):
            intact = digest.upper() in (base32_sha1(payload), base32_sha1(body), hashlib.sha1(payload).hexdigest().upper())
        if intact:
            n = len(payload)
    return {"page_id": _number(r["record_id"]), "payload_bytes": n, "payload_digest": digest or None, "record_type": kind, "refers_to": _number(r["refers_to"]), "uri": r["uri"], "intact": intact, "record_id": r["record_id"]}


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Query: all pages written as WARC records and read back."""
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).drop("record_id")
