"""Licence notices in documents: a positional index of rare licence words. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import row_key, stored

# Base phrases and their labels, each with the word that anchors it.
BASE = [("mit", "under the mit license", "mit"), ("apache-2", "apache license version 2", "apache"),
        ("cc-by-nc", "cc by nc", "cc")]

# Fixed values: (label, opening of the notice, phrases that must stand in it word for word).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license v 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", ["permission to use copy modify and or distribute"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released"]),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", ["eclipse public license v 2 0"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 2 of the license or at your option any later version",
     ["gnu general public license as published by the free software foundation either version 2 of the license"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 3 of the license or at your option any later version",
     ["gnu general public license as published by the free software foundation either version 3 of the license"]),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
                 "license as published by the free software foundation either version 2 1 of the license or at your option any later version",
     ["gnu lesser general public license as published by the free software foundation either version 2 1 of the license"]),
    ("lgpl-3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
               "license as published by the free software foundation either version 3 of the license or at your option any later version",
     ["gnu lesser general public license as published by the free software foundation either version 3 of the license"]),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
               "license as published by the free software foundation either version 3 of the license or at your option any later version",
     ["gnu affero general public license as published by the free software foundation either version 3 of the license"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is "
              "available at", ["eclipse public license 2 0"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license version 2 0", ["mozilla public license version 2 0"]),
]

# Label and identifier, as words, of a line that names the licence by identifier.
IDENTIFIERS = [
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"),
    ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"), ("unlicense", "unlicense"),
    ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("epl-2", "epl 2 0"),
]
TEMPLATES += [(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for label, name in IDENTIFIERS]
ANCHORS = 2
MIN_COVERAGE = 0.6
SLACK = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of letters a-z, digits and characters beyond ASCII, with A-Z (and only these) lower-cased; null gives none.

    Full lower-casing is faster and differs only where it would turn a character beyond ASCII into an ASCII letter: texts with
    one of the two such characters are translated instead. Other letters keep their separators, so counts do not change.
    """
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("K") | text.contains("İ")
    small = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(small, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def _postings(templates: Iterable[tuple[str, str, list[str]]]) -> list[tuple]:
    """Rows (word, template, position, words in the template, key, words in all keys); key words must all match."""
    rows = []
    for number, (_, notice, keys) in enumerate(templates):
        words = notice.split()
        must = set()
        for key in keys:
            part = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            must |= set(range(at, at + len(part)))
        rows += [(w, number, i, len(words), int(i in must), len(must)) for i, w in enumerate(words)]
    return rows


def _places(label: str, phrase: str, anchor: str) -> Column:
    parts = phrase.split()
    at = parts.index(anchor)
    want = F.array(*[F.lit(p) for p in parts])
    found = F.filter("hits", lambda h: F.when((h.w == anchor) & (h.i >= at),
                                              F.slice("words", h.i - at + 1, len(parts)) == want).otherwise(False))
    return F.transform(found, lambda h: h.i - at)


def read_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored once per document: ``row``, id, ``n_words``, base places, and the positions of every licence word."""
    lexicon = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} | {w for _, p, _ in BASE for w in p.split()})
    words = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(lexicon), F.struct(i.alias("i"), w.alias("w")))),
                    lambda h: h.isNotNull())
    found = words.select("_id", "words", hits.alias("hits"))
    return stored(found.select(row_key().alias("row"), "_id", F.size("words").cast("long").alias("n_words"), "hits",
                               *[_places(*b).alias(f"base{n}") for n, b in enumerate(BASE)]), "licence-words")


def notice_labels(read: DataFrame) -> DataFrame:
    """Per ``row``: labels of the templates found through rare words, and the best coverage.

    Document frequencies of the licence words come from all documents. Of each template's key words, all of which must match,
    the ``ANCHORS`` rarest (highest by IDF, ties by word) are looked up in every row, however frequent they are and whatever else
    stands there; an offset at which all of them stand is a candidate. All licence words of the candidate rows are then matched
    at that offset: a template is found if each of its key words stands in its place and at least ``MIN_COVERAGE`` of all its
    words stand in theirs, give or take ``SLACK`` words for those outside the key, so that inserted words do no harm.
    """
    spark = read.sparkSession
    kinds = read.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h.w))).alias("w"))
    # one row per word of the fixed lexicon
    df = {r.w: r.df for r in kinds.groupBy("w").agg(F.count("*").alias("df")).collect()}
    names = "w string, template int, at int, length int, is_key int, keys int"
    rows, anchors = _postings(TEMPLATES), []
    for number in range(len(TEMPLATES)):
        key = sorted((df.get(w, 0), w, at) for w, template, at, _, is_key, _ in rows if template == number and is_key)
        anchors += [(w, number, at) for _, w, at in key[:ANCHORS]]
    postings = F.broadcast(spark.createDataFrame(rows, names))
    anchored = F.broadcast(spark.createDataFrame(anchors, "w string, template int, at int"))
    hits = read.select("row", F.explode("hits").alias("h")).select("row", "h.i", "h.w")
    candidates = hits.join(anchored, "w").groupBy("row", "template", (F.col("i") - F.col("at")).alias("offset")).agg(
        F.count("*").alias("n")).where(F.col("n") == ANCHORS).drop("n")
    candidates = stored(candidates, "licence-candidates")
    near = candidates.select("row", "template", F.col("offset").alias("start"), F.explode(F.sequence(F.lit(-SLACK), F.lit(SLACK))).alias("shift"))
    near = near.withColumn("offset", F.col("start") + F.col("shift"))
    rows = candidates.select("row").distinct()
    words = (
        read.join(rows, "row", "left_semi").select("row", F.explode("hits").alias("h")).select("row", "h.i", "h.w")
        .join(postings, "w").withColumn("offset", F.col("i") - F.col("at"))
        .join(near, ["row", "template", "offset"]).where((F.col("is_key") == 0) | (F.col("shift") == 0))
        .groupBy("row", "template", "start", "at").agg(F.max("is_key").alias("is_key"), F.max("length").alias("length"), F.max("keys").alias("keys"))
    )
    matched = (
        words.groupBy("row", "template", "start").agg(F.count("*").alias("n"), F.sum("is_key").alias("k"),
                                                      F.max("length").alias("length"), F.max("keys").alias("keys"))
        .where("k = keys").withColumn("coverage", F.col("n") / F.col("length")).where(F.col("coverage") >= MIN_COVERAGE)
    )
    label = F.element_at(F.array(*[F.lit(t[0]) for t in TEMPLATES]), F.col("template") + 1)
    return matched.groupBy("row").agg(F.collect_set(label).alias("found"), F.max("coverage").alias("coverage"))


def _labelled(column: str, label: str) -> Column:
    return F.transform(column, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("word")))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``places`` (label, first word, words of the phrase), ``found`` labels, ``coverage``.

    ``places`` are the base phrases word for word; ``found`` comes from the index. Null and empty texts have no words and no
    labels; repeated rows and null ids are returned each; other columns are not read; an empty table gives an empty table.
    """
    read = read_words(docs, id_col, text)
    places = F.concat(*[_labelled(f"base{n}", b[0]) for n, b in enumerate(BASE)])
    return read.join(notice_labels(read), "row", "left").select(
        F.col("_id").alias(id_col), "n_words", places.alias("places"),
        F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
