import base64
import gzip
import hashlib
import re
import zlib

from assayframe.llm.secrets import drop_secrets, op8_secrets, scan, scan_secrets

NAMES = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(NAMES, t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, i, j) for i, _, k, j in sorted(out)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in spans).encode()).hexdigest()


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_secrets(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        kinds = [k for k, _, _ in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex")) and r.base_sha256 == digest(want)
        assert {f"{k}:{i}:{j}" for k, i, j in want} <= set(r.spans.split(","))


def test_base_patterns():
    key = "AKIA" + "Q1" * 8
    for t in [f"x{key}y", f"{key[:-1]}", f"AKIA {key}AKIA{key}", "a" * 24, "A" + "0f" * 12 + "G", "token=token: abcdefgh", "PassWord'  := 'x", 'api_key" = "abc.d=', "ſecret=abcdefg", "é " * 50 + "apikey:AAAAAA"]:
        assert [s[:3] for s in scan(t)[0]] == brute(t), t


def test_layers_and_spans():
    secret = "password=hunter2hunter2"
    b64 = lambda x: base64.b64encode(x).decode()
    layered = {
        "url": "".join(f"%{c:02X}" for c in secret.encode()),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in secret),
        "base64": b64(secret.encode()),
        "base64>inflate": b64(gzip.compress(secret.encode())),
        "base64>base64": b64(b64(secret.encode()).encode()),
        "base64>inflate>url": b64(zlib.compress("".join(f"%{c:02x}" for c in secret.encode()).encode())),
    }
    for path, coded in layered.items():
        t = f"çé some text {coded} and more"
        base, spans = scan(t)
        assert [s[:3] for s in base] == brute(t)
        at = t.index(coded)
        assert any(s[0] == "assign" and at <= s[1] < s[2] <= at + len(coded) and s[3] == path and s[4] == "hunter2hunter2" for s in spans), (path, spans)
    # inside one percent-coded word, the span is the part that decodes to the secret
    t = "see http://h/?q=%70assword%3Dhunter2hunter2 end"
    (one,) = [s for s in scan(t)[1] if s[3] == "url"]
    assert t[one[1] : one[2]] == "%70assword%3Dhunter2hunter2"


def test_cycles_and_broken_layers_end():
    for t in ["%25" * 2000, base64.b64encode(b"\x1f\x8bbroken").decode() * 3, "\\u0025" * 50, "%zz%%%", "\\ud800\\udc00" * 9, "A" * 100_000]:
        scan(t)


def test_samples_that_once_failed():
    b64 = lambda x: base64.b64encode(x).decode()
    secret = b"password=hunter2hunter2"
    for t in ["dG9rZW49YWJjZGVm", "x%FFtoken%3Dabcdefgh", b64(secret.decode().encode("utf-16")), b64(secret.decode().encode("utf-16-be")), b64(b"\xfe\x00" + secret + b"\xff" * 9), b64(gzip.compress(b"filler words " * 1_700_000 + secret))]:
        assert any(s[3] for s in scan(t)[1]), t[:40]
    packed = zlib.compress(secret + bytes(range(256)) * 3)
    for eol in ("\n", "\r\n  "):
        lines = b64(b"a" * 100 + secret + b"\xfe" * 200)
        t = "see\n" + eol.join(lines[k : k + 64] for k in range(0, len(lines), 64)) + "\nend"
        assert t[4:-4] in [t[s[1] : s[2]] for s in scan(t)[1] if s[3] == "base64"]
    t = "q=" + "".join(f"%{c:02X}" for c in packed) + "&x"
    assert [(s[1], s[2], s[3]) for s in scan(t)[1]] == [(2, len(t) - 2, "url>inflate")]


def test_deep_nesting_is_linear():
    t = "token%" + "25" * 100_000 + "3Dabcdefgh"
    assert ("assign", 0, len(t), "url", "abcdefgh") in scan(t)[1]
    data = b"password=hunter2hunter2"
    for _ in range(250):
        data = base64.b64encode(zlib.compress(data))
    assert [s[:4] for s in scan(data.decode())[1]] == [("assign", 0, len(data), "(base64>inflate)*250")]
    data = b"password=hunter2hunter2"
    for _ in range(3000):
        data = gzip.compress(data)
    assert len(scan(base64.b64encode(data).decode())[1]) == 1
    assert [t[3] for t in scan("\\u0025" + "5Cu0025" * 500 + "5Cu0074oken=abcdefgh")[1]] == ["url+unicode"]


def test_codes_that_codes_make():
    cases = {"%2574oken=abcdefgh": "url", "%%374oken=abcdefgh": "url", "\\x5cu0074oken=abcdefgh": "unicode", "\\u{74}oken=abcdefgh": "unicode", "\\U00000074oken=abcdefgh": "unicode", "%5Cu0074oken=abcdefgh": "url+unicode", "\\u002574oken=abcdefgh": "url+unicode"}
    for coded, path in cases.items():
        assert [s[:4] for s in scan(f"é {coded} z")[1]] == [("assign", 2, 2 + len(coded), path)], coded


def test_odd_rows(odd_docs, make_docs):
    got = scan_secrets(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert scan_secrets(odd_docs.limit(0)).collect() == []
    docs = make_docs([(1, "password=abcdef123"), (2, "clean"), (3, None)])
    kept = drop_secrets(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_long_runs_take_linear_time():
    assert scan("x" * 400_000 + "%zz password=abcdef1") == ([("assign", 400_004, 400_020, "", "abcdef1")],) * 2
    assert [x[:4] for x in scan("x" * 400_000 + "%zz%20pass%77ord=abcdef1")[1]] == [("assign", 400_006, 400_024, "url")]


def test_repeated_parts_have_spans_at_every_place():
    secret = b"password=hunter2hunter2"
    inner = base64.b64encode(secret).decode()
    for coded in (inner, base64.b64encode(zlib.compress(secret)).decode(), base64.b64encode(inner.encode()).decode(), "".join(f"%{c:02X}" for c in secret), "".join(f"\\u{c:04x}" for c in secret)):
        t = f"one {coded} two {coded} three"
        second = t.rindex(coded)
        assert {s[1:3] for s in scan(t)[1]} == {(4, 4 + len(coded)), (second, second + len(coded))}, coded
    nested = base64.b64encode(f"x {inner} y {inner}".encode()).decode()
    t = f"{inner} {nested} {nested} {inner}"
    assert len(scan(t)[1]) == 4


def test_all_of_an_inflated_part_is_scanned():
    secret = b"password=hunter2hunter2"
    b64 = lambda x: base64.b64encode(x).decode()
    long = " ".join(f"é{i}" for i in range(3000)).encode()
    for data in (long + b" " + secret, long + b" " + b64(secret).encode() + b" " + long, secret + b" " + long, long.replace(b" ", b"") + b" " + secret, b"\xe9 " + secret, b"z" * 9000 + b" " + secret):
        for packed in (gzip.compress(data), zlib.compress(data), gzip.compress(gzip.compress(data))):
            for limit in (101, 1000, 1 << 24):
                t = f"x {b64(packed)} y"
                assert [s[:3] for s in scan(t, limit)[1]] == [("assign", 2, len(t) - 2)], (data[:20], limit)


def test_later_members_and_trailing_data_are_scanned():
    secret = b"password=hunter2hunter2"
    for data in (gzip.compress(b"first") + gzip.compress(secret), gzip.compress(b"first") + b"\0" * 9 + gzip.compress(secret), zlib.compress(b"first") + zlib.compress(secret), gzip.compress(b"first ") + secret, gzip.compress(b"") + gzip.compress(secret)):
        t = base64.b64encode(data).decode()
        assert [s[:3] for s in scan(t)[1]] == [("assign", 0, len(t))]
    many = base64.b64encode(gzip.compress(b"x") * 3000 + gzip.compress(secret)).decode()
    assert scan(many)[1]


def test_percent_runs_with_odd_bytes():
    t = "name=caf%E9&password%3Dhunter22"
    assert [(t[s[1] : s[2]], s[3], s[4]) for s in scan(t)[1]] == [("password%3Dhunter22", "url", "hunter22")]
    t = "password%3D 'hunter22' %FF%C3%A9%80 token%3Dabc%64ef"
    assert [t[s[1] : s[2]] for s in scan(t)[1]] == ["password%3D 'hunter22", "token%3Dabc%64ef"]


def found(text, **k):
    return {(s[0], s[4]) for s in scan(text, **k)[1]}


def test_joined_base64():
    b64 = lambda x: base64.b64encode(x).decode()
    for plain, value in ((b"token=abcdef", "abcdef"), (b"password=hunter2hunter2", "hunter2hunter2")):
        part = b64(plain).rstrip("=")
        for before in ("", "path/", "/", "prefix-", "x", "xy", "xyz", "a/b_c+", "https/very/long/path/"):
            for after in ("", "/more", "x", "=="):
                assert any(v.startswith(value) for _, v in found(f"see {before}{part}{after} end")), (before, part, after)
    packed = b64(gzip.compress(b"password=hunter2hunter2")).rstrip("=")
    small = b64(zlib.compress(b"password=hunter2hunter2")).rstrip("=")
    for before in ("v1/", "a-", "abc_", "x/y/z/"):
        assert ("assign", "hunter2hunter2") in found(before + packed) and ("assign", "hunter2hunter2") in found(before + small)


def test_all_values_of_a_part():
    coded = base64.b64encode(b"password=first1 password=second2 token: third33").decode()
    assert found(coded) == {("assign", "first1"), ("assign", "second2"), ("assign", "third33")}
    twice = base64.b64encode(f"x {coded} secret=fourth4".encode()).decode()
    assert found(twice) == {("assign", "first1"), ("assign", "second2"), ("assign", "third33"), ("assign", "fourth4")}


def test_utf16_anywhere():
    secret = "password=hunter2hunter2"
    for size in (0, 1, 200, 201, 4100):
        for codec in ("utf-16-le", "utf-16-be"):
            for tail in (b"", secret.replace("2", "3").encode(codec) * 2600, b"\xff tail \xfe"):
                data = b"a" * size + b"\n" * (size > 0) + secret.encode(codec) + tail
                coded = base64.b64encode(data).decode()
                assert any(v.startswith("hunter2hunter2") for _, v in found(coded)), (size, codec)
                if tail[:1] == b"p" or tail[:1] == b"\0":
                    packed = base64.b64encode(gzip.compress(data)).decode()
                    assert any(v.startswith("hunter2hunter2") for _, v in found(packed, limit=1000)), (size, codec)


def test_layers_that_begin_alike_are_no_cycle():
    inner = b"password=hunter2hunter2"
    data = inner + bytes(k * k % 251 for k in range(40_000))
    for _ in range(4):  # stored, not compressed: each layer begins as the one within it
        data = zlib.compress(data, 0)
    assert ("assign", "hunter2hunter2") in {(k, v[:14]) for k, v in found(base64.b64encode(data).decode(), limit=2000)}
