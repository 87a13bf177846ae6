"""License scans with a positional index of rare words, in DataFrame functions alone.

How many documents hold each word of the templates is counted over the whole corpus; of each template the words with the highest inverse document
frequency go to an index of (word -> template, position). A file's words are looked up there, rarest first. Two different index words that stand in the file as far apart as in the template
point at the place where it starts; around it (with a slack for words put in or left out) all its key phrases are verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that count wherever their words stand one after another, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: A label, a passage of the licence or of its usual notice, and the phrases without which it is not that licence.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction", "sublicense and or sell copies of the software"]),
    ("mit", "released under the mit license", ["under the mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0"]),
    ("bsd-2", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software", "without specific prior written permission"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"]),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation", "version 2 of the license"]),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license as published by the free software foundation"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license as published by the free software foundation"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", ["subject to the terms of the mozilla public license v 2 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["has waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", ["in no event will the authors be held liable", "permission is granted to anyone to use this software for any purpose"]),
]
RARE, SLACK = 3, 8  # index words a template; words that may be put in or left out between key phrases
#: The characters other than [\x00-\x2F\x3A-\x60\x7B-\x7F], named one by one: the negated class takes Java's matcher about seven times as long.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def folded(text: Column) -> Column:
    """A-Z in lower case, as far as ASCII words go: the one other character whose lower case is ASCII alone, the Kelvin sign, stays a letter of its own."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))


def words(text: str | Column) -> Column:
    """The words of a text as an array; of null, none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(folded(c), F.lit(WORD), F.lit(0))


def _vocabulary() -> list[str]:
    return sorted({w for _, passage, _ in TEMPLATES for w in passage.split()})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The inverse document frequency of each word of the templates over all documents; the driver gets a row a word of theirs."""
    vocabulary = _vocabulary()
    held = docs.select(F.array_intersect(words(text_col), F.array(*map(F.lit, vocabulary))).alias("held"))
    n = {r.word: r.n for r in held.select(F.explode(F.array_append("held", F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: _idf(n.get(w, 0), n.get("", 0)) for w in vocabulary}


def _idf(n: int, total: int) -> float:
    from math import log

    return log((total + 1) / (n + 0.5))


def rare_index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position): of each template the ``RARE`` words with the highest idf of the key phrase whose words are the rarest.

    Of equally rare words the first in the alphabet. A key phrase must stand as it is, so where it stands these words are as far apart as here.
    """
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, passage, phrases) in enumerate(TEMPLATES):
        rarest = [(sorted(set(p.split()), key=lambda w: (-idf[w], w))[:RARE], p.split()) for p in phrases]
        rare, phrase = max(rarest, key=lambda x: sum(idf[w] for w in x[0]) / len(x[0]))
        ws = passage.split()
        start = next(i for i in range(len(ws)) if ws[i : i + len(phrase)] == phrase)
        for at, w in enumerate(phrase, start):
            if w in rare:
                index.setdefault(w, []).append((t, at))
    return index


def _places(ws: Column, phrase: str) -> "Column":
    """A predicate of a word's number: whether the phrase's words stand there."""
    return lambda i: reduce(lambda a, b: a & b, [F.get(ws, i + k) == w for k, w in enumerate(phrase.split())])


def _numbers(ws: Column) -> Column:
    return F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))


def base_places(ws: Column) -> Column:
    """(at, label) of every place of a phrase."""
    first = list({p.split()[0] for p in PHRASES})
    at = F.filter(_numbers(ws), lambda i: F.get(ws, i).isin(first))
    of = lambda i: reduce(lambda c, p: c.when(_places(ws, p)(i), F.lit(PHRASES[p])), PHRASES, F.when(F.lit(False), F.lit("")))
    return F.filter(F.transform(at, lambda i: F.struct(i.alias("at"), of(i).alias("label"))), lambda s: s["label"].isNotNull())


def _literal(values: dict, of) -> Column:
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), of(v))])


def votes(ws: Column, index: dict[str, list[tuple[int, int]]], idf: dict[str, float]) -> Column:
    """(template, start, word) for each place of an index word, sorted: where the template would start if the word were the template's."""
    names = sorted(index, key=lambda w: (-idf[w], w))  # rarest first
    number = _literal({w: k for k, w in enumerate(names)}, F.lit)
    postings = _literal({k: index[w] for k, w in enumerate(names)}, lambda ps: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))
    found = F.filter(_numbers(ws), lambda i: F.get(ws, i).isin(names))
    hits = F.array_sort(F.transform(found, lambda i: F.struct(F.element_at(number, F.get(ws, i)).alias("w"), i.alias("i"))))  # by rarity
    return F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(postings, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("start"), h["w"].alias("w"))))))


def agreeing(votes: Column) -> Column:
    """Of sorted (template, start, word): the places that two words name. Words that agree are neighbours."""
    after = lambda k, field: F.get(votes, k + 1)[field]
    agree = F.filter(votes, lambda v, k: (after(k, "t") == v["t"]) & (after(k, "start") == v["start"]) & (after(k, "w") != v["w"]))
    return F.array_distinct(F.transform(agree, lambda v: F.struct(v["t"].alias("t"), v["start"].alias("start"))))


def verified(ws: Column, found: Column, idf: dict[str, float]) -> Column:
    """(label, score) of the candidates around which all key phrases of their template stand; the score is the share of the template's weight of rare words there."""
    passages = [p.split() for _, p, _ in TEMPLATES]
    per = lambda values: F.array(*values)
    size, labels = per([F.lit(len(p)) for p in passages]), per([F.lit(label) for label, _, _ in TEMPLATES])
    phrases = per([F.array(*[F.lit(f" {p} ") for p in ps]) for _, _, ps in TEMPLATES])
    distinct = per([F.array(*map(F.lit, sorted(set(p)))) for p in passages])
    weight, total = _literal({w: max(idf[w], 1e-9) for w in idf}, F.lit), per([F.lit(sum(max(idf[w], 1e-9) for w in set(p))) for p in passages])

    def near(c: Column) -> Column:
        start = F.greatest(c["start"] - SLACK, F.lit(0))
        return F.slice(ws, start + 1, F.greatest(c["start"] + F.get(size, c["t"]) + 2 * SLACK - start, F.lit(0)))

    around = F.transform(found, lambda c: F.struct(c["t"].alias("t"), near(c).alias("near")))
    held = F.filter(around, lambda c: F.forall(F.get(phrases, c["t"]), lambda p: F.contains(F.concat(F.lit(" "), F.array_join(c["near"], " "), F.lit(" ")), p)))
    share = lambda c: F.aggregate(F.array_intersect(F.get(distinct, c["t"]), c["near"]), F.lit(0.0), lambda s, w: s + F.element_at(weight, w)) / F.get(total, c["t"])
    return F.transform(held, lambda c: F.struct(F.get(labels, c["t"]).alias("label"), F.least(share(c), F.lit(1.0)).alias("score")))


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: the columns ``keep``, ``n_words``, ``base`` (at, label of each place of a phrase) and ``found`` (label, score of each verified place of a template).

    Null counts as empty text; equal rows give equal rows; no other column is read. Everything happens within a row, so no document meets another.
    """
    idf = document_frequencies(docs, text_col)
    index = rare_index(idf)
    # words and votes are read several times: each is a column of its own step, made once
    ws = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], words(text_col).alias("ws"))
    ws = ws.select("*", base_places(F.col("ws")).alias("base"), votes(F.col("ws"), index, idf).alias("votes"))
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    out = ws.select(*[f"k{i}" for i in range(len(keep))], F.size("ws").cast("long").alias("n_words"), "base", verified(F.col("ws"), agreeing(F.col("votes")), idf).alias("found"))
    return out.select(*kept, "n_words", "base", "found")


def scan_phrases(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, ``n_words`` and ``base`` of ``scan_licenses``, in one pass: phrases need no document frequencies."""
    ws = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], words(text_col).alias("ws"))
    return ws.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.size("ws").cast("long").alias("n_words"), base_places(F.col("ws")).alias("base"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def phrase_columns() -> list[Column]:
    """Of ``n_words`` and ``base``: the number of places, the first and the last, and their labels."""
    at, base = F.transform("base", lambda s: s["at"]), F.transform("base", lambda s: s["label"])
    return [F.col("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), _joined(base).alias("base_labels")]


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    """All labels of the whole table ``documents``. The score is 1 for a phrase's label, else that of the best template."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    labels = F.concat(F.transform("base", lambda s: s["label"]), F.transform("found", lambda s: s["label"]))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *phrase_columns(), _joined(labels).alias("labels"), score.alias("score"))
