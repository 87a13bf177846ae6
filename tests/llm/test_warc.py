import base64
import gzip
import hashlib

import pytest

from assayframe.llm.warc import chunked, op7_warc, read_records, read_warc, unchunked, write_warc


def expected(rows, least=0):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and i > first[b]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def flat(df):
    got = df.collect()
    assert all(r.intact for r in got)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


def test_query_round_trip(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert flat(op7_warc(spark, sf)) == expected(rows)


@pytest.mark.parametrize("least", [0, 5])
def test_odd_pages(spark, tmp_path, least):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n" * 40 + "\x00é\U0001f600" * 900
    rows = [(1, None), (2, ""), (3, "é"), (4, "é"), (5, tricky), (6, tricky), (7, "x" * 100_000), (8, "a\r\n"), (3, "é")]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i}", h, "clash", 1) for i, h in rows], "page_id long, url string, html string, sha string, first int")
    write_warc(pages, f"{tmp_path}/w", min_revisit=least, segment_bytes=700, chunk_bytes=99)
    assert flat(read_warc(spark, f"{tmp_path}/w")) == expected(rows, least)
    assert read_records(spark, f"{tmp_path}/w").where("type = 'continuation'").count() > 10


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w")
    assert read_warc(spark, f"{tmp_path}/w").collect() == []


def test_missing_segment_is_seen(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 4000)], "page_id long, url string, html string").coalesce(1)
    write_warc(pages, f"{tmp_path}/w", segment_bytes=1000)
    import glob
    import gzip

    (path,) = glob.glob(f"{tmp_path}/w/*.gz")
    parts = gzip.open(path).read().split(b"WARC/1.1\r\n")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/a.warc").write_bytes(b"".join(b"WARC/1.1\r\n" + p for p in parts[1:3] + parts[4:]))
    (row,) = read_warc(spark, f"{tmp_path}/cut").collect()
    assert row.page_id == 1 and not row.intact


def test_chunk_framing():
    for data in (b"", b"a", "é€\U0001f600".encode() * 50, b"0\r\n\r\n" * 9):
        assert unchunked(chunked(data, 7)) == data
    assert unchunked(b"4;x=y\r\nabcd\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcd"
    assert unchunked(b"5\r\nabcd\r\n0\r\n\r\n") is None and unchunked(b"zz") is None


def foreign(kind, ident, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in more.items()}}
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    body = b"<html>\r\nWARC/1.0\r\nbin \xff\x00</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    good = [
        foreign("warcinfo", "<urn:uuid:0>", b"software: x\r\n"),
        foreign("response", "<urn:uuid:1>", http, WARC_Payload_Digest=f"sha1:{sha}"),
        foreign("response", "<urn:uuid:2>", http),
        foreign("response", "<urn:uuid:3>", http, WARC_Payload_Digest="sha1:" + "A" * 32),
        foreign("revisit", "<urn:uuid:4>", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest=f"sha1:{sha}"),
        foreign("Response", "<urn:uuid:5>", http, X="a\r\n folded"),
        foreign("continuation", "<urn:uuid:6>", b"tail", WARC_Segment_Number="2"),
        foreign("response", "<urn:uuid:7>", b""),
    ]
    bad_length = foreign("response", "<urn:uuid:8>", http.replace(b"WARC", b"warc")).replace(b"Content-Length: ", b"Content-Length: x")
    cut_head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\n"
    cut_block = foreign("response", "<urn:uuid:10>", http)[:-40]
    whole = b"".join(good)
    want = {"1": True, "2": True, "3": False, "4": True, "5": True, "6": False, "7": True}
    files = {
        "plain.warc": (whole, want),
        "members.warc.gz": (b"".join(gzip.compress(g) for g in good), want),
        "unnamed.gzip": (b"".join(gzip.compress(g) for g in good), want),
        "length.warc.gz": (gzip.compress(bad_length + good[1]), {"8": False, "1": True}),
        "head.warc": (good[1] + cut_head, {"1": True, "9": False}),
        "head_within.warc.gz": (gzip.compress(cut_head + good[1]), {"1": True, "9": False}),
        "block.warc.gz": (gzip.compress(good[1] + cut_block), {"1": True, "10": False}),
        "no_ends.warc": (good[1][:-4] + good[2], {"1": True, "2": True}),
        "junk.warc": (b"\x00junk\r\n\r\nmore", {}),
        "empty.warc": (b"", {}),
    }
    for name, (data, expect) in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
        got = read_warc(spark, str(tmp_path / name)).collect()
        assert {r.record_id.rpartition(":")[2].rstrip(">"): r.intact for r in got} == expect, name
        assert all(r.page_id is None and r.refers_to is None for r in got)
        assert all(r.payload_digest == sha and r.payload_bytes == len(body) for r in got if r.record_id in ("<urn:uuid:1>", "<urn:uuid:2>"))
    both = tmp_path / "both"
    both.mkdir()
    for name in ("head.warc", "members.warc.gz", "length.warc.gz", "block.warc.gz"):
        (both / name).write_bytes(files[name][0])
    assert read_warc(spark, str(both)).count() == 2 + 7 + 2 + 2


def test_cut_gzip(spark, tmp_path):
    rng = __import__("random").Random(0)
    blocks = [foreign("response", f"<urn:uuid:{k}>", b"HTTP/1.1 200 OK\r\n\r\n" + rng.randbytes(20_000)) for k in range(40)]
    for name, data in (("one.warc.gz", gzip.compress(b"".join(blocks))), ("many.warc.gz", b"".join(map(gzip.compress, blocks))), ("named.other", gzip.compress(b"".join(blocks)))):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data[: len(data) // 2])
        got = read_warc(spark, str(tmp_path / name)).collect()
        assert 18 <= sum(r.intact for r in got) <= 20 and sum(not r.intact for r in got) <= 1, name


def record(page, body, size=None):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}:0>\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_a_length_that_is_too_large_takes_no_other_records():
    from assayframe.llm.warc import _parse

    inner = b"HTTP/1.1 200 OK\r\n\r\n" + record(9, b"held record") + b"end"
    for size in (40, 100, 250, 1_000_000, 10**17):
        for longest in (1, 1 << 20):
            data = record(1, b"first body\r\nof two lines", size) + record(2, b"second") + record(3, b"") + record(4, b"fourth")
            got = list(_parse(iter(data.split(b"\r\n")), longest))
            assert [(r[0], r[10]) for r in got] == [(f"<urn:page:{k}:0>", k > 1) for k in range(1, 5)], (size, longest)
            assert [r[9] for r in got[1:]] == [b"second", b"", b"fourth"]
    whole = list(_parse(iter((record(1, inner) + record(2, b"x")).split(b"\r\n"))))
    assert [(r[9], r[10]) for r in whole] == [(inner, True), (b"x", True)]  # a record within a record is its content
    many = b"".join(record(k, b"x" * 30, 10**6) for k in range(3000))
    assert sum(1 for _ in _parse(iter(many.split(b"\r\n")), 1 << 12)) == 3000


def test_records_without_ends_that_quote_a_record():
    from assayframe.llm.warc import _lines, _parse

    quoting = b"HTTP/1.1 200 OK\r\n\r\n<html>\r\nWARC/1.0\r\nWARC-Type: response\r\n"
    for block in (quoting + b"\r\nend", quoting + b"\r\n", quoting):
        one, two = foreign("response", "1", block), foreign("response", "2", b"HTTP/1.1 200 OK\r\n\r\nx")
        for data in (one + two, one[:-4] + two, one[:-4], one):
            got = {r[0]: (r[9], r[-1]) for r in _parse(_lines(data))}
            assert got["1"] == (block, True) and len(got) == 1 + (two in data), (block, data)
