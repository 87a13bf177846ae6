"""Secret scans with a recursive decoding worklist.

A text is scanned for secrets; then it is scanned with its percent codes, its Unicode escapes and both decoded in
place, each down to the bottom, and its encoded parts (base64, zlib and gzip data) are decoded and scanned in turn,
and so on until nothing new decodes. Each distinct part of a text is decoded once, so cycles end, and what is found in it
counts at every place where the part stands. What is found in a layer is mapped back to the span of the original text that it came from.
The work is a list, not a recursion, and codes within codes are undone in one pass: time and memory are linear in the depth of nesting.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int,layers:string,value:string>>"
#: The names after which an assignment counts as a secret.
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_CODE = {
    "url": re.compile(r"%[0-9A-Fa-f]{2}"),
    "unicode": re.compile(r"\\(?:u\{[0-9A-Fa-f]{1,6}\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})"),
}
_STRETCH = re.compile(r"[%\\][%\\uUx{}0-9A-Fa-f]*")  # codes, and what may be one once others are decoded, lie within these
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Signs after which a part may begin, and how gzip and zlib data begin in base64.
_PACKED_BASE64 = re.compile(r"[/_+-](?=H4sI|eAE|eF4|eJw|eNo)")
_NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
_PACKED_URL = re.compile(r"(?:%1[Ff]%8[Bb]|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()+$-])*")
_BREAK = re.compile(r"[^A-Za-z0-9+/_=%\\{}-]")
_PIECE, _CHUNK, _OVERLAP = 1 << 14, 1 << 20, 1 << 16
_KEY = {k: i for i, k in enumerate(KINDS)}
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the plain patterns, leftmost non-overlapping for each kind."""
    if runs is None:
        runs = [m.span() for m in _LONG.finditer(text)]
    out = []
    if _NAMES.search(text):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # both others lie within long runs of the larger class
    for i, j in runs:
        if j - i >= 20:
            out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text, i, j) if len(m[0]) >= 20]
        if j - i >= 24:
            out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text, i, j) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], _KEY[s[0]]))


def _compressed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0)


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of zlib or gzip data in pieces, member after member, and what follows the last; of broken data what comes before the break."""
    rest = next(chunks, b"")
    while True:
        while len(rest) < 2 and (more := next(chunks, b"")):
            rest += more
        if not _compressed(rest):
            break
        member = zlib.decompressobj(47)
        while not member.eof:
            rest = rest or next(chunks, b"")
            try:
                out = member.decompress(rest[:_PIECE], _CHUNK)
            except zlib.error:
                return
            if not rest and not out:
                return
            rest = (member.unused_data if member.eof else member.unconsumed_tail) + rest[_PIECE:]
            if out:
                yield out
        while not rest.strip(b"\0") and (more := next(chunks, b"")):  # members may be padded
            rest = more
        rest = rest.lstrip(b"\0")
    if rest:
        yield rest
    yield from chunks


_WIDE = re.compile(rb"(?:[\x01-\x7f]\0){4,}|(?:\0[\x01-\x7f]){4,}")


def _narrowed(data: bytes) -> bytes:
    """Runs of four or more ASCII characters in UTF-16, of either order and at any place, as single bytes."""
    return _WIDE.sub(lambda m: m[0].replace(b"\0", b""), data) if b"\0" in data else data


def _narrow_stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The chunks with UTF-16 runs narrowed, those over the chunks' ends too."""
    held = b""
    for chunk in chunks:
        held += chunk
        end = len(held)
        while end > 1 and len(held) - end < _CHUNK and (held[end - 1] == 0) != (held[end - 2] == 0):
            end -= 1  # a run may go on
        end = 0 if end <= 1 else end - 1 if len(held) - end < _CHUNK else len(held) - len(held) % 2
        yield _narrowed(held[:end])
        held = held[end:]
    yield _narrowed(held)


def _windows(chunks: Iterator[bytes], size: int, overlap: int) -> Iterator[str]:
    """The text of the chunks, whole up to ``size`` characters, else in windows that overlap.

    Windows are cut where no encoded part can run on; in a run of over four times ``size`` a multiple of four characters from its start.
    A byte that isn't UTF-8 becomes U+FFFD.
    """
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    held, n, want = [], 0, size
    for chunk in _narrow_stream(chunks):
        held.append(decode(chunk))
        n += len(held[-1])
        while n > want:
            text = "".join(held)
            cut = _break_before(text, want)
            if not cut and want < 4 * size:
                want *= 2
                held = [text]
                continue
            yield text[: cut or want]
            # the next window begins at a break as well, so that it doesn't start inside a part
            start = _break_before(text, cut - overlap) if cut > 2 * overlap else cut
            text = text[(start if cut - start <= 2 * overlap else cut) if cut else want :]
            held, n, want = [text], len(text), size
    yield "".join(held) + decode(b"", True)


def _break_before(text: str, end: int) -> int:
    """The end of the last character before ``end`` that no encoded part holds; 0 if there is none."""
    for k in range(end, 0, -4096):
        low = max(k - 4096, 0)
        if last := max((m.end() for m in _BREAK.finditer(text, low, k)), default=0):
            return last
    return 0


def _texts(data: bytes) -> list[str]:
    """The text of UTF-8 bytes, or of other bytes a character each; if some of them look like UTF-16, also the text with those parts narrowed, and all of them read so in both orders."""
    out = []
    narrow = _narrowed(data)
    for x in dict.fromkeys((data, narrow)):
        try:
            out.append(x.decode())
        except UnicodeDecodeError:
            out.append(x.decode("latin-1"))
    if narrow != data or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        out += [data.decode(codec, "replace") for codec in ("utf-16-le", "utf-16-be")]
    return out


def _code_at_end(out: list[str], url: bool, unicode: bool) -> tuple[int, str] | None:
    """(length, character) of the code that the characters end with; U+DC80 to U+DCFF stand for single bytes."""
    last = out[-1]
    if last not in _HEX_DIGITS and last != "}":
        return None
    if url and len(out) > 2 and out[-3] == "%" and last != "}" and out[-2] in _HEX_DIGITS:
        n = int(out[-2] + last, 16)
        return 3, chr(n if n < 128 else 0xDC00 + n)
    if unicode:
        if last == "}":
            digits = next((k for k in range(2, min(len(out), 9)) if out[-k] == "{"), 0)
            text = "".join(out[1 - digits : -1]) if digits > 2 and out[-digits - 2 : -digits] == ["\\", "u"] else ""
            size = digits + 2
        else:
            size = next((k for k, sign in ((4, "x"), (6, "u"), (10, "U")) if len(out) >= k and out[-k] == "\\" and out[1 - k] == sign), 0)
            text = "".join(out[2 - size :]) if size else ""
        if text and all(c in _HEX_DIGITS for c in text):
            code = int(text, 16)
            if code < 0xD800 or 0xE000 <= code <= 0x10FFFF:
                return size, chr(code)
    return None


def _undone(stretch: str, start: int, url: bool, unicode: bool) -> list[tuple[str, int]]:
    """(character, its place in the text) with all codes decoded, and those that this makes, to the last; U+FFFD for a byte that isn't UTF-8."""
    out, at = [], []
    for place, c in enumerate(stretch, start):
        out.append(c)
        at.append(place)
        while found := _code_at_end(out, url, unicode):
            size, made = found
            del out[1 - size :], at[1 - size :]
            out[-1] = made
    chars, k = [], 0
    for odd, run in groupby(out, lambda c: "\udc80" <= c <= "\udcff"):
        run = "".join(run)
        for c in run.encode(errors="surrogateescape").decode(errors="surrogateescape") if odd else run:
            single = "\udc80" <= c <= "\udcff"
            chars.append(("\ufffd" if single else c, at[k]))
            k += 1 if single or not odd else len(c.encode())
    return chars


def _decoded(text: str, *kinds: str) -> tuple[str, Callable[[int], int]] | None:
    """The text with its codes of these kinds decoded in place, and the place in ``text`` of each of its characters; None without codes."""
    if not any(_CODE[k].search(text) for k in kinds):
        return None
    out, new, old, last, n = [], [], [], 0, 0
    for m in _STRETCH.finditer(text):
        if not any(_CODE[k].search(text, *m.span()) for k in kinds):
            continue
        if m.start() > last:
            new.append(n)
            old.append(last)
            out.append(text[last : m.start()])
            n += m.start() - last
        for c, at in _undone(m[0], m.start(), "url" in kinds, "unicode" in kinds):
            new.append(n)
            old.append(at)
            out.append(c)
            n += 1
        last = m.end()
    new.append(n)
    old.append(last)
    out.append(text[last:])

    def where(k: int) -> int:
        i = bisect_right(new, k) - 1
        return old[i] + k - new[i]

    return "".join(out), where


def _readings(text: str) -> Iterator[tuple[str, str, Callable[[int], int]]]:
    """(name, text, place of its characters) of a text as it stands and with its codes decoded."""
    yield "", text, lambda k: k
    url = _decoded(text, "url") if "%" in text else None
    unicode = _decoded(text, "unicode") if "\\" in text else None
    if url:
        yield "url", *url
    if unicode:
        yield "unicode", *unicode
    if url and "\\" in url[0] or unicode and "%" in unicode[0]:
        both = _decoded(text, "url", "unicode")
        if both[0] not in (url and url[0], unicode and unicode[0]):
            yield "url+unicode", *both


def _coded(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(coded, start, end) of base64 parts, on a line and wrapped over lines, and of compressed data in percent codes.

    A part may be joined to other characters of its alphabet, as in a path. Whatever stands before it, it is decoded whole from one of the first four characters of the run;
    compressed data, which has to be decoded from its very start, also from each of its beginnings after a sign.
    """
    wrapped = 0  # the end of the last wrapped part
    for m in _BASE64.finditer(text) if runs else ():
        start, end = m.span()
        yield m[0], start, end
        for k in range(1, 4):
            if end - start - k >= 16:
                yield m[0][k:], start + k, end
        for x in _PACKED_BASE64.finditer(text, start, end):
            yield text[x.end() : end], x.end(), end
        lines = [m[0]]
        while start >= wrapped and len(lines[-1]) == len(m[0]) and not len(m[0]) % 4 and m[0][-1] != "=" and (more := _NEXT_LINE.match(text, end)) and len(more[1]) <= len(m[0]):
            lines.append(more[1])
            end = more.end()
        if len(lines) > 1:
            wrapped = end
            yield "".join(lines), start, end
    for m in _PACKED_URL.finditer(text) if "%" in text else ():
        yield m[0], *m.span()


def _bytes(coded: str) -> bytes:
    if "%" in coded:
        return unquote_to_bytes(coded)
    body = coded.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _opened(data: bytes, layer: str, limit: int) -> Iterator[tuple[str, str]]:
    """(layer, text) of what an encoded part holds; compressed data of over ``limit`` bytes in windows."""
    seen = set()
    while _compressed(data):
        mark = hashlib.sha256(data).digest()
        stream, held, size = _inflated(iter([data])), [], 0
        while size <= limit and (piece := next(stream, None)) is not None:
            held.append(piece)
            size += len(piece)
        if not held or mark in seen:
            break
        seen.add(mark)
        layer += ">inflate"
        if size > limit:
            depth, known = 1, set()
            while True:
                head = next(_unpacked(data, depth), None)
                if head is None or not _compressed(head):
                    break
                whole = hashlib.sha256()
                for piece in _unpacked(data, depth):  # a pass a layer: what is told apart is the whole layer
                    whole.update(piece)
                if whole.digest() in known:
                    break
                known.add(whole.digest())
                depth, layer = depth + 1, layer + ">inflate"
            yield from ((layer, text) for text in _windows(_unpacked(data, depth), limit, min(_OVERLAP, limit // 8)))
            return
        data = b"".join(held)
    yield from ((layer, text) for text in _texts(data))


def _unpacked(data: bytes, depth: int) -> Iterator[bytes]:
    """The contents of compressed data, so many layers deep."""
    chunks: Iterator[bytes] = iter([data])
    for _ in range(depth):
        chunks = _inflated(chunks)
    return chunks


class _Part:
    """What an encoded part holds: the layers of each secret, by its kind and value; and the parts it stands in."""

    __slots__ = ("found", "within")

    def __init__(self):
        self.found, self.within = {}, set()


def _expand(part: _Part, coded: str, limit: int) -> Iterator[tuple[str, str]]:
    """Scan a part; (coded, layers it stands in) of the parts within it."""
    for layer, text in _opened(_bytes(coded), "url" if "%" in coded else "base64", limit):
        for name, reading, _ in _readings(text):
            layers = f"{layer}>{name}" if name else layer
            runs = [m.span() for m in _LONG.finditer(reading)]
            for kind, _, _, value in base_spans(reading, runs):
                part.found.setdefault((kind, value), (layers, None))
            yield from ((inner, layers) for inner, _, _ in _coded(reading, runs))


def _explored(roots: list[str], limit: int) -> dict[bytes, _Part]:
    """All parts within the ``roots``, by the hash of their coded text, with what is found in them and in the parts within them."""
    parts: dict[bytes, _Part] = {}
    for root in roots:
        stack = [(None, iter([(root, "")]))]
        while stack:
            part, inner = stack[-1]
            coded, layers = next(inner, (None, None))
            if coded is None:
                stack.pop()
                continue
            mark = _mark(coded)
            if mark not in parts:
                parts[mark] = _Part()
                stack.append((parts[mark], _expand(parts[mark], coded, limit)))
            if part:
                parts[mark].within.add((part, layers))
    work = [(p, secret) for p in parts.values() for secret in p.found]
    while work:
        p, secret = work.pop()
        for outer, layers in p.within:
            if secret not in outer.found:
                outer.found[secret] = (layers, p.found[secret])
                work.append((outer, secret))
    return parts


def _mark(coded: str) -> bytes:
    return hashlib.blake2b(coded.encode(), digest_size=16).digest()


def _path(name: str, way: tuple | None) -> str:
    """The layers from the outside in; one that repeats three times or more is counted."""
    names = [name] if name else []
    while way:
        names.append(way[0])
        way = way[1]
    runs = [(k, len(list(g))) for k, g in groupby(names)]
    return ">".join(f"({k})*{n}" if n > 2 else ">".join([k] * n) for k, n in runs)


def _layers(text: str, limit: int) -> Iterator[tuple[str, int, int, str, str]]:
    """All spans of one text, the plain ones first; of equal kind and place, and value within a part, the first."""
    have, places = set(), {}
    for name, reading, place in _readings(text):
        runs = [m.span() for m in _LONG.finditer(reading)]
        for kind, i, j, value in base_spans(reading, runs):
            at = (kind, place(i), place(j))
            if at not in have:
                have.add(at)
                yield *at, name, value
        for coded, i, j in _coded(reading, runs):
            places.setdefault(coded, {}).setdefault((place(i), place(j)), name)
    parts = _explored(list(places), limit)
    for coded, where in places.items():
        for (kind, value), way in parts[_mark(coded)].found.items():
            for (i, j), name in where.items():
                if (kind, i, j) not in have and (kind, i, j, value) not in have:
                    have.add((kind, i, j, value))
                    yield kind, i, j, _path(name, way), value


def scan(text: str | None, limit: int = 16 << 20) -> tuple[list[tuple], list[tuple]]:
    """(base spans, all spans) of one text; a span is (kind, start, end, layers, value), in code points of the text.

    Spans found behind percent codes or Unicode escapes cover the characters they were decoded from, those in a base64
    or compressed layer the whole encoded part. Codes within codes (``%2525``) are undone to the bottom at once.
    Base64 is taken from 16 characters on, on one line or wrapped over lines of equal length, joined to a path or not. Of a part all secrets are told, each with the part's span.
    Bytes that are neither UTF-8 nor UTF-16 are scanned one character a byte. Compressed data of over ``limit`` characters is scanned in windows of about so many.
    """
    if not text:
        return [], []
    spans = sorted(_layers(text, limit), key=lambda s: (s[1], _KEY[s[0]], s[2], s[3]))
    return [s for s in spans if not s[3]], spans


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = 16 << 20) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (kind, start, end, layers, value) in order of start, then kind.

    Null and empty texts have no spans; repeated rows give repeated results; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string()), ("value", pa.string())]))

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            both = [scan(t.as_py(), limit) for t in batch.column(1)]
            named = [[[dict(zip(("kind", "start", "end", "layers", "value"), s)) for s in spans] for spans in part] for part in zip(*both)] or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named[0], kind), pa.array(named[1], kind)], ["doc_id", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(each, f"doc_id long, base {SPANS}, spans {SPANS}")


def drop_secrets(docs: DataFrame, text_col: str = "text", limit: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no secret is found."""
    k = docs.columns.index(text_col)

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.filter(pa.array([not scan(t.as_py(), limit)[1] for t in batch.column(k)], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def _joined(spans: str):
    return F.array_join(F.array_distinct(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))), ",")


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Query: secrets in all documents; counts are of the plain patterns."""
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
