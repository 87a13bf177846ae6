"""Surrogates for personal data, with DataFrame functions only.

Mentions are found by patterns and brought to an identity: an e-mail address in lower case, the digits of a phone, card or
security number, an account without blanks, each part of a person's name. Every identity of the corpus gets
one surrogate of its type, drawn by a keyed hash, and each mention shows its identity's surrogate in its own format. So
all spellings of one identity change alike everywhere, and a name's full and short forms stay together. Surrogates
that meet another's, or any real identity, are drawn anew, so that different identities stay different.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Titles that introduce a name, by gender (n: either).
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа"),
    "n": ("Dr", "Prof", "Doctor", "Professor"),
}
#: What names are made of, by script: starts and vowels of syllables, ends of family names, and ends of given names by gender.
SOUNDS = {
    "latin": {
        "start": ("b", "br", "d", "dr", "f", "g", "gr", "h", "k", "kl", "l", "m", "n", "p", "r", "s", "st", "t", "v", "w"), "vowel": ("a", "e", "i", "o", "u"),
        "family": ("n", "r", "s", "t", "ck", "ll", "mann", "ner", "sen", "son", "ton", "ler", "dt", "ng", "rd", "lin"), "m": ("n", "r", "s", "l", "d", "k"), "f": ("na", "ra", "sa", "la", "da", "lia"), "n": ("ny", "ry", "sy", "ly", "dy", "xy"),
    },
    "cyrillic": {
        "start": ("б", "бр", "в", "г", "гр", "д", "др", "з", "к", "кл", "л", "м", "н", "п", "р", "с", "ст", "т", "ф", "х"), "vowel": ("а", "е", "и", "о", "у"),
        "family": ("в", "нов", "ров", "лин", "нин", "рский", "нко", "тов"), "m": ("н", "р", "с", "л", "д", "м"), "f": ("на", "ра", "са", "ла", "да", "лия"), "n": ("ня", "ря", "ся", "ля", "дя", "мя"),
    },
    "greek": {
        "start": ("β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "χ"), "vowel": ("α", "ε", "ι", "ο", "υ"),
        "family": ("ς", "δης", "κης", "λος", "νος", "ρας"), "m": ("νος", "ρης", "λος", "δας"), "f": ("να", "ρα", "λα", "δα"), "n": ("νι", "ρι", "λι", "δι"),
    },
    "arabic": {
        "start": ("ب", "ت", "ج", "ح", "د", "ر", "ز", "س", "ش", "ف", "ك", "ل", "م", "ن", "ه"), "vowel": ("ا", "و", "ي"), "family": ("ري", "اني", "دي", "وي", "مان"), "m": ("د", "ر", "م", "ن"), "f": ("ية", "اء", "رة"), "n": ("ور", "اد"),
    },
    "hebrew": {
        "start": ("ב", "ג", "ד", "ה", "ז", "ח", "ט", "כ", "ל", "מ", "נ", "ס", "ר", "ש", "ת"), "vowel": ("א", "ו", "י"), "family": ("רי", "לי", "מן", "ני", "בי"), "m": ("ר", "ל", "ן"), "f": ("ית", "רה", "לה"), "n": ("ור", "ין"),
    },
}
#: Telephone country codes of one and of two digits; all others have three.
COUNTRY_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_POOLS = (
    ("[a-zß-öø-ÿ]", "abcdefghijklmnopqrstuvwxyz"), ("[A-ZÀ-ÖØ-Þ]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[0-9]", "0123456789"),
    ("[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
)
_ALL_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)+"
_PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])"
_IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_CARD = r"(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\w])"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_PART = r"(?:\p{Lu}(?:[\p{L}\p{M}]|['-](?=\p{L}))+|(?![\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])\p{Lo}[\p{L}\p{M}]+|\p{IsHan}{2,4}(?![\p{IsHan}\p{IsHiragana}\p{IsKatakana}]))"
NAME = rf"(?U)(?<!\w)({_ALL_TITLES})\.? ({_PART})(?: ({_PART}))?"
ENTITY = rf"(?U){_EMAIL}|{_CARD}|{_SSN}|{_IP}|{_PHONE}|{_IBAN}"
ENTITY_OR_PART = rf"{ENTITY}|(?<![\w'-]){_PART}(?!\w)"
_MAYBE = rf"(?U)[@\d]|{NAME[4:]}"
_ROUNDS = 64


def kind_of(value: Column) -> Column:
    """The type of a mention that ``ENTITY_OR_PART`` found; ``part`` may be one of a name."""
    is_ = lambda p: value.rlike(f"(?U)^(?:{p})$")
    return F.when(value.contains("@"), "email").when(is_(_PART), "part").when(is_(_CARD), "card").when(is_(_SSN), "ssn").when(is_(_IP), "ip").when(is_(_IBAN), "iban").otherwise("phone")


def identity(kind: Column, value: Column) -> Column:
    """What all mentions of one entity have in common."""
    digits = F.regexp_replace(value, r"(?U)\D", "")
    bare = F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits))
    return bare.when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind == "ip", value).otherwise(F.lower(value))


def _number(i: Column) -> Column:
    """The ``i``-th number (from 0) drawn for an identity, of its hexadecimal digits ``drawn``."""
    return F.conv(F.substr("drawn", F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(pool: tuple[str, ...] | str, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), F.pmod(n, F.lit(len(pool))) + 1)


def _chars(value: Column) -> Column:
    return F.split(value, "(?<=.)(?=.)")


def _like(value: Column, kept: Column | int = 0, skipped: int = 0) -> Column:
    """Each letter or digit replaced by one of its script and case, by the numbers after those ``skipped``; the first ``kept`` characters stay."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(i < kept, c)
        for pattern, pool in _POOLS:
            out = out.when(c.rlike(f"^{pattern}$"), _pick(pool, _number(i + skipped)))
        out = out.when(c.rlike(r"(?U)^\d$"), _pick("0123456789", _number(i + skipped)))
        return out.when(c.rlike(r"^\p{L}$"), _pick(_POOLS[0][1], _number(i + skipped))).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn(digits: Column, doubled_last: int) -> Column:
    """The Luhn sum modulo 10; ``doubled_last``: 1 if the last digit counts double."""
    each = F.transform(F.reverse(_chars(digits)), lambda d, i: F.when((i + doubled_last) % 2 == 1, d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)).otherwise(d.try_cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _name() -> Column:
    """A name part of two syllables and an end, by columns kind, gender and script; a later round has more syllables."""

    def made(script: str) -> Column:
        sounds = SOUNDS[script]
        syllable = lambda i: F.concat(_pick(sounds["start"], _number(2 * i)), _pick(sounds["vowel"], _number(2 * i + 1)))
        end = lambda what: _pick(sounds[what], _number(F.lit(0)))
        body = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.col("round"), F.lit(8)) + 2), syllable), "")
        return F.concat(body, F.when(F.col("kind") == "family", end("family")).when(F.col("gender") == "m", end("m")).when(F.col("gender") == "f", end("f")).otherwise(end("n")))

    of_script = reduce(lambda c, script: c.when(F.col("script") == script, made(script)), [s for s in SOUNDS if s != "latin"], F.when(F.lit(False), ""))
    return of_script.otherwise(made("latin"))


def _mod97(iban: Column) -> Column:
    """An account's number modulo 97, its first four characters last and letters as 10 to 35; 1 if its check digits hold."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    digit = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: (a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + digit(c)) % 97)


def surrogate() -> Column:
    """The surrogate identity of an identity (columns kind, id, gender, script, round, drawn)."""
    kind, id_ = F.col("kind"), F.col("id")
    octets = F.array_join(F.transform(F.split(id_, r"\."), lambda c, i: (F.pmod(_number(i), F.lit(254)) + 1).cast("string")), ".")
    # a card whose check digit holds gets one that holds
    card = _like(id_, 1)
    front = F.substr(card, F.lit(1), F.length(card) - 1)
    card = F.when(_luhn(id_, 0) == 0, F.concat(front, ((10 - _luhn(front, 1)) % 10).cast("string"))).otherwise(card)
    domain = F.substr(id_, F.instr(id_, "@") + 1)
    # short addresses may run out: from the third round they grow
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("round") - 1, F.lit(1))), lambda i: F.when(F.col("round") < 2, "").otherwise(_pick(_POOLS[0][1], _number(40 + i)))), "")
    local = F.concat(_like(F.substring_index(id_, "@", 1)), more)
    host = _like(F.regexp_replace(domain, r"\.[^.]*$", ""), 0, 20)
    email = F.concat(local, F.lit("@"), host, F.lit("."), F.substring_index(domain, ".", -1))
    phone = _like(id_, F.when(~id_.startswith("+"), 0).otherwise(1 + F.coalesce(F.nullif(F.length(F.regexp_extract(id_, rf"^\+({COUNTRY_CODES})", 1)), F.lit(0)), F.lit(3))))
    # as with cards, check digits that hold are set anew
    iban = _like(id_, 4)
    country, rest = F.substr(iban, F.lit(1), F.lit(2)), F.substr(iban, F.lit(5))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    iban = F.when(_mod97(id_) == 1, F.concat(country, check, rest)).otherwise(_like(id_, 2))
    return F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "email", email).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ssn", _like(id_)).otherwise(_name())


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, id, surrogate) for the distinct ``entities`` (kind, id, gender, script): distinct surrogates, none of them an identity.

    Given and family names share one space. The table grows with the corpus's identities; it is joined as Spark sees fit,
    broadcast only below its threshold. The key is a column of a joined table of one row a kind, so plans don't show it.
    RuntimeError if ``_ROUNDS`` draws find no free surrogate, as when a type has more identities than values.
    """
    spark = entities.sparkSession
    kinds = ("email", "card", "ssn", "ip", "iban", "phone", "given", "family")
    keys = F.broadcast(spark.createDataFrame([(k, key) for k in kinds], "kind string, key string"))
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    entities = entities.withColumn("space", space)
    real = entities.select("space", F.col("id").alias("surrogate")).distinct()
    # drawing costs more than the bytes show: a number of tasks by rows, which adaptive execution leaves alone
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entities.count() // 20_000)
    open_, done = entities.repartition(tasks, "id").withColumn("round", F.lit(0)), []
    for _ in range(_ROUNDS):
        inner = F.sha2(F.concat_ws("\x1f", "key", "kind", "id", F.col("round").cast("string")), 256)
        seed = F.sha2(F.concat_ws("\x1f", "key", inner), 256)
        drawn = F.concat(*[F.sha2(F.concat(F.col("seed"), F.lit(str(k))), 256) for k in range(4)])
        tried = open_.join(keys, "kind").withColumn("seed", seed).withColumn("drawn", drawn).select("kind", "id", "gender", "script", "space", "round", surrogate().alias("surrogate"))
        # a surrogate belongs to the first identity that drew it, unless it is taken or real
        owner = tried.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "id")).alias("owner"))
        for taken in [real, *(d.select("space", "surrogate") for d in done)]:
            owner = owner.join(taken, ["space", "surrogate"], "left_anti")
        ok = F.coalesce((F.col("owner.kind") == F.col("kind")) & (F.col("owner.id") == F.col("id")), F.lit(False))
        tried = written(tried.join(owner, ["space", "surrogate"], "left").withColumn("ok", ok).drop("owner"), "surrogates")
        done.append(tried.where("ok"))
        open_ = tried.where("not ok").select("kind", "id", "gender", "script", "space", (F.col("round") + 1).alias("round"))
        if open_.isEmpty():
            return reduce(DataFrame.union, [d.select("kind", "id", "surrogate") for d in done])
    raise RuntimeError(f"no free surrogate after {_ROUNDS} draws")


def rendered(kind: Column, value: Column, new: Column) -> Column:
    """A surrogate identity in the format of the mention ``value``."""
    bare = F.when(new.startswith("+"), F.substr(new, F.lit(2))).otherwise(new)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def fill(a: Column, c: Column) -> Column:
        taken = F.struct(F.concat(a["out"], F.substr(bare, a["next"], F.lit(1))).alias("out"), (a["next"] + 1).alias("next"))
        return F.when(c.rlike(r"(?U)^[\dA-Z]$"), taken).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["next"].alias("next")))

    filled = F.aggregate(_chars(value), start, fill)["out"]
    capital = F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2)))
    email = F.when(value == F.lower(value), new).when(value == F.upper(value), F.upper(new)).when(value.rlike(r"^\p{Lu}"), capital).otherwise(new)
    name = F.when((value == F.upper(value)) & (value != F.lower(value)) & (F.length(value) > 1), F.upper(new)).otherwise(capital)
    return F.when(kind == "email", email).when(kind == "ip", new).when(kind.isin("given", "family"), name).otherwise(filled)


def _name_parts(hit: DataFrame) -> DataFrame:
    """(row, id, kind, gender): the parts of all names that follow a title in a row's text; what is a family name there counts as one."""
    text = F.array_join("pieces", "")
    named = hit.where("titled").select("row", F.explode(F.regexp_extract_all(text, F.lit(NAME), F.lit(0))).alias("name"))
    part = lambda k: F.regexp_extract("name", NAME, k)
    gender = F.when(part(1).isin(*TITLES["m"]), "m").when(part(1).isin(*TITLES["f"]), "f").otherwise("n")
    two = part(3) != ""
    named = named.select("row", gender.alias("gender"), F.when(two, part(2)).alias("given"), F.when(two, part(3)).otherwise(part(2)).alias("family"))
    parts = named.select("row", F.lower("family").alias("id"), F.lit("family").alias("kind"), "gender").union(named.where("given is not null").select("row", F.lower("given"), F.lit("given"), "gender"))
    return parts.groupBy("row", "id").agg(F.min("kind").alias("kind"), F.max(F.col("gender") == "m").alias("m"), F.max(F.col("gender") == "f").alias("f"))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_entities) for every row, each entity of its whole text replaced by its surrogate.

    Names are found after a title; then every capitalised mention of a part of one is replaced in that text, title or not; in scripts
    without case any mention, of Chinese characters two to four that stand alone. A given
    name that follows titles of one gender gets a name of that gender, any other one of neither. Null texts stay null with no
    entities, empty texts stay empty; repeated rows are replaced alike; an empty table gives no rows. Titles, country codes,
    top-level domains and the format stay. ``key`` decides the surrogates: keep it secret, or they can be undone by trial.
    """
    text = F.col("text")
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("maybe", F.coalesce(text.rlike(_MAYBE), F.lit(False)))
    plain = found.where("not maybe").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    # one pass of the patterns sets marks around the mentions; odd pieces between marks are mentions
    mark = F.when(F.instr(text, "\ue000") == 0, "\ue000").otherwise(F.concat(F.lit("\ue000"), F.sha2(text, 256)))
    around = F.concat("mark", F.lit("$0"), "mark")
    marked = F.when(F.col("titled"), F.regexp_replace("text", F.lit(ENTITY_OR_PART), around)).otherwise(F.regexp_replace("text", F.lit(ENTITY), around))
    cut = found.where("maybe").withColumn("titled", text.rlike(NAME)).withColumn("mark", mark)
    cut = written(cut.select("doc_id", "titled", F.split(marked, F.col("mark")).alias("pieces"), F.monotonically_increasing_id().alias("row")), "pii-rows")
    none = cut.where("size(pieces) = 1").select("doc_id", F.col("pieces")[0], F.lit(0).cast("long"))
    hit = cut.where("size(pieces) > 1")
    each = hit.select("row", F.posexplode("pieces").alias("pos", "value")).where("pos % 2 = 1").withColumn("kind", kind_of(F.col("value")))
    each = each.withColumn("id", identity(F.col("kind"), F.col("value")))
    names = written(_name_parts(hit), "pii-names")
    parts = each.where("kind = 'part'").join(names.select("row", "id", F.col("kind").alias("known")), ["row", "id"], "left")
    each = each.where("kind <> 'part'").select("row", "pos", "value", "kind", "id").union(parts.select("row", "pos", "value", "known", "id"))
    script = reduce(lambda c, name: c.when(F.col("id").rlike(rf"\p{{Is{name.capitalize()}}}"), name), [s for s in SOUNDS if s != "latin"], F.when(F.lit(False), "")).otherwise("latin")
    people = names.groupBy("kind", "id").agg(F.max("m").alias("m"), F.max("f").alias("f"))
    people = people.select("kind", "id", F.when(F.col("m") == F.col("f"), "n").when(F.col("m"), "m").otherwise("f").alias("gender"), script.alias("script"))
    others = each.where("kind not in ('given', 'family')").select("kind", "id").distinct().select("kind", "id", F.lit("n"), F.lit("latin"))
    table = surrogates(written(people.union(others), "pii-entities"), key)
    new = each.join(table, ["kind", "id"], "left").select("row", "pos", F.coalesce(rendered(F.col("kind"), F.col("value"), F.col("surrogate")), "value").alias("new"), F.col("surrogate").isNotNull().cast("long").alias("one"))
    new = new.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda s: s["new"]).alias("new"), F.sum("one").alias("n_entities"))
    # plain pieces and replaced mentions in turn
    even = F.filter("pieces", lambda p, i: i % 2 == 0)
    joined = F.array_join(F.zip_with(even, F.concat("new", F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    return hit.join(new, "row").select("doc_id", joined.alias("text"), "n_entities").union(none).union(plain)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Query: personal data in all documents replaced by surrogates, under the session's key or one drawn for this run."""
    key = spark.conf.get("spark.assayframe.surrogate.key", None) or secrets.token_hex(32)
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"), key)
