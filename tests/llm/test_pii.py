import re

from assayframe.llm import pii
from assayframe.llm.pii import TITLES, op4_pii, replace_entities

TEXT = "Mail ann.lee+x@mail7.example.com, call +1 (269) 555-3296 or 555-123-4567; ip 16.195.23.156, ssn 123-45-6789, card 4539578763621486, iban DE89 3704 0044 0532 0130 00. Mrs. Jane Smith met Herr Karl Maier and господин Иван Петров."


def test_types_formats_and_coreference(make_docs):
    out = {r.doc_id: r for r in replace_entities(make_docs([(1, TEXT), (2, "again ann.lee+x@mail7.example.com and Mrs. Jane Smith"), (3, "clean text, 12 of 345."), (4, None), (5, "")]), "k").collect()}
    t = out[1].text
    assert out[1].n_entities == 13
    for part in ("ann.lee", "555-3296", "123-4567", "16.195.23.156", "123-45-6789", "4539578763621486", "0532", "Jane Smith", "Karl Maier", "Петров"):
        assert part not in t
    m = re.fullmatch(
        r"Mail ([a-z]{3}\.[a-z]{3}\+[a-z]@[a-z]{4}\d\.[a-z]{7}\.com), call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}); ip ((?:\d{1,3}\.){3}\d{1,3}), ssn (\d{3}-\d{2}-\d{4}), card (4\d{15}), iban (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d)\. "
        r"Mrs\. ([A-Z][a-z]+) ([A-Z][a-z]+) met Herr ([A-Z][a-z]+) ([A-Z][a-z]+) and господин ([А-ЯЁ][а-яё]+) ([А-ЯЁ][а-яё]+)\.", t)  # fmt: skip
    assert m, t
    assert m[8].endswith("a") and m[10][-1] in "nrsldk" and m[12][-1] in "нрслдм"
    assert all(0 < int(o) < 256 for o in m[4].split("."))
    digits = [int(c) for c in m[6]][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert out[2].text == f"again {m[1]} and Mrs. {m[8]} {m[9]}" and out[2].n_entities == 3
    assert out[3].text == "clean text, 12 of 345." and out[3].n_entities == 0
    assert out[4].text is None and out[5].text == "" and out[4].n_entities == out[5].n_entities == 0


def test_spellings_of_one_entity_stay_one(make_docs):
    rows = [
        (1, "Mrs. Jane Smith came. Then Jane Smith left; SMITH, Jane. Yesterday Mr Smith, Dr. Robin O'Neil-Lee and Robin stayed. Smithers too."),
        (2, "Call 555-123-4567 or (555) 123-4567, 555.123.4567; pay 4539 5787 6362 1486 or 4539578763621486, DE89370400440532013000 = DE89 3704 0044 0532 0130 00."),
        (3, "Ann@x.com ann@x.com ANN@X.COM"), (4, "Jane Smith untitled in another text"),
    ]
    out = {r.doc_id: r.text for r in replace_entities(make_docs(rows), "k").collect()}
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) came\. Then (\w+) (\w+) left; (\w+), (\w+)\. Yesterday Mr (\w+), Dr\. (\w+) (\w+) and (\w+) stayed\. Smithers too\.", out[1])
    assert m, out[1]
    assert m[1] == m[3] == m[6] and m[2] == m[4] == m[7] and m[5] == m[2].upper() and m[8] == m[10] and len({m[1], m[2], m[8], m[9], "Jane", "Smith", "Robin"}) == 7
    m = re.fullmatch(r"Call (\d{3})-(\d{3})-(\d{4}) or \((\d{3})\) (\d{3})-(\d{4}), (\d{3})\.(\d{3})\.(\d{4}); pay (\d{4}) (\d{4}) (\d{4}) (\d{4}) or (\d{16}), (DE\d{20}) = (DE\d\d(?: \d{4}){4} \d\d)\.", out[2])
    assert m and m.group(1, 2, 3) == m.group(4, 5, 6) == m.group(7, 8, 9) != ("555", "123", "4567")
    assert "".join(m.group(10, 11, 12, 13)) == m[14] != "4539578763621486" and m[16].replace(" ", "") == m[15]
    a, b, c = out[3].split(" ")
    assert a.lower() == b == c.lower() and c == b.upper() and a[0].isupper() and b != "ann@x.com"
    assert out[4] == rows[3][1]


def test_gender_follows_titles_anywhere(make_docs):
    rows = [(1, "Dr. Kim Novo"), (2, "Ms. Kim Ando"), (3, "Mr. Lee Rast and Mrs. Lee Rast and Dr. Lee Rast"), (4, "Mr. Paul Berg")]
    out = {r.doc_id: r.text.split(" ") for r in replace_entities(make_docs(rows), "k").collect()}
    assert out[1][1] == out[2][1] and out[2][1].endswith("a") and out[3][1] == out[3][5] and out[3][1].endswith("y") and out[4][1][-1] in "nrsldk"
    assert {"Mr", "Mrs", "Dr"} <= {t for ts in TITLES.values() for t in ts}


def test_distinct_entities_stay_distinct(make_docs):
    rows = [(i, f"a@b.co c{i % 40}@d.co Mr. A{chr(97 + i // 26)}{chr(97 + i % 26)} 10.0.0.{i % 50} \ue000 x") for i in range(676)]
    out = {r.doc_id: r.text.split(" ") for r in replace_entities(make_docs(rows), "k").collect()}
    pairs = {(a, b) for i, t in rows for a, b in zip(t.split(" "), out[i], strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert not {b for a, b in pairs if a != b} & {a for a, _ in pairs}
    assert all(re.fullmatch("[A-Z][a-z]{4,12}", out[i][3]) for i, _ in rows)


def test_one_very_long_text(make_docs):
    text = "Mr. Jon Berg and " + "Some Words Here, 12 of them. " * 60_000 + "Jon Berg, ann@x.com"
    (r,) = replace_entities(make_docs([(1, text)]), "k").collect()
    assert r.n_entities == 5 and r.text.count("Some Words Here, 12 of them. ") == 60_000


def test_plan_hides_the_key(make_docs, capsys):
    replace_entities(make_docs([(1, TEXT)]), "a-very-secret-key").explain(True)
    assert "a-very-secret-key" not in capsys.readouterr().out


def test_key_changes_surrogates(make_docs):
    docs = make_docs([(1, TEXT)])
    assert replace_entities(docs, "k1").first().text != replace_entities(docs, "k2").first().text
    assert replace_entities(docs, "k1").first().text == replace_entities(docs, "k1").first().text


def test_query_keeps_all_else(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    simple = re.compile(r"[\w.+-]+@[\w-]+\.\w|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])|\(\d{3}\) \d{3}-\d{4}|(?<![\w-])\d{16}(?!\w)")
    got = op4_pii(spark, sf).collect()
    assert len(got) == len(texts) and any(r.n_entities for r in got)
    for r in got:
        before = set(simple.findall(texts[r.doc_id]))
        assert not before & set(simple.findall(r.text))
        if not r.n_entities:
            assert r.text == texts[r.doc_id] and not before


def test_odd_rows(odd_docs):
    got = replace_entities(odd_docs, "k").collect()
    assert len(got) == odd_docs.count() and all(r.n_entities == 0 for r in got)
    assert replace_entities(odd_docs.limit(0), "k").collect() == []


def test_query_equals_walk_of_all_mentions(spark, sf):
    """Mentions found here, one text after another: what lies between them stays, one identity has one surrogate, and two have two."""
    import regex

    one, part = (regex.compile(p.removeprefix("(?U)")) for p in (pii.ENTITY, pii.ENTITY_OR_PART))
    name = regex.compile(pii.NAME.removeprefix("(?U)"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts[-1], texts[-2] = TEXT + " Then Jane Smith, MAIER; call (269) 555-3296.", "Dr. Ann-Marie O'Neil wrote to Ann@X.org and ann@x.org; Mr. Lee. Lee again"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    new = {r.doc_id: (r.text, r.n_entities) for r in replace_entities(docs, "k").collect()}
    shown, n_all = {}, 0
    for i, t in texts.items():
        known = {w.lower() for m in name.finditer(t) for w in m.groups()[1:] if w}
        spans = [m.span() for m in (part if known else one).finditer(t)]
        spans = [(a, b) for a, b in spans if not regex.fullmatch(pii._PART, t[a:b]) or t[a:b].lower() in known]
        between = [t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)])]
        m = regex.fullmatch("(.+?)".join(map(regex.escape, between)), new[i][0], flags=regex.DOTALL)
        assert m and new[i][1] == len(spans), (i, new[i][0][:200])
        n_all += len(spans)
        for (a, b), s in zip(spans, m.groups()):
            v = t[a:b]
            key = v.lower() if "@" in v or regex.fullmatch(pii._PART, v) else v if regex.fullmatch(pii._IP, v) else regex.sub(r"[^+\dA-Z]", "", v)
            plain = s.lower() if "@" in s or regex.fullmatch(pii._PART, v) else s if regex.fullmatch(pii._IP, v) else regex.sub(r"[^+\dA-Z]", "", s)
            assert shown.setdefault(key, plain) == plain != key
            if not regex.fullmatch(pii._PART, v) and "@" not in v and not regex.fullmatch(pii._IP, v):
                assert regex.sub(r"\d", "0", s) == regex.sub(r"\d", "0", v) or v[:2].isalpha()
    assert n_all > 20 and len(set(shown.values())) == len(shown) and not set(shown.values()) & set(shown)


def test_country_codes_check_digits_and_scripts_without_case(make_docs):
    phones = {"+49 30 123 4567": "49", "+44 20 7946 0958": "44", "+1 212 555 0100": "1", "+7 495 123 4567": "7", "+353 86 234 5678": "353"}
    for phone, code in phones.items():
        (r,) = replace_entities(make_docs([(1, f"call {phone} now")]), "k").collect()
        new = re.fullmatch(r"call (.*) now", r.text)[1]
        assert new != phone and new.startswith(f"+{code} ") and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", phone), (phone, new)
    sound = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    for iban in ("DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606"):
        (r,) = replace_entities(make_docs([(1, f"pay {iban} today")]), "k").collect()
        new = re.fullmatch(r"pay (.*) today", r.text)[1]
        bare = new.replace(" ", "")
        assert new != iban and bare[:2] == iban[:2] and sound(iban.replace(" ", "")) and sound(bare) and len(new) == len(iban)
    for text, name, script in (("see Dr. محمد here, محمد again", "محمد", "؀-ۿ"), ("Prof. דוד said", "דוד", "֐-׿"), ("Dr. 王小明 came", "王小明", "A-Za-z")):
        (r,) = replace_entities(make_docs([(1, text)]), "k").collect()
        assert name not in r.text and r.n_entities == text.count(name) and re.search(rf"(?:Dr|Prof)\. [{script}]+", r.text), r.text
