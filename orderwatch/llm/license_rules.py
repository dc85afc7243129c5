"""Licence recognition by sentences.

A text is cut into sentences, each is normalised (lower case, letters and digits only, one
blank between words, a copyright line without its names and years) and looked up among known
licence sentences. The identifiers found, in the order of the text, are matched against
rules: a rule is an ordered run of identifiers, longer rules go first, and the identifiers
that a rule has used serve no other. Other sentences may stand between.

Only built-in column functions are used; a text is one row from end to end and nothing
is shuffled.

Defined results: NULL and empty texts and texts without a known sentence have no
identifiers (empty strings); a sentence that occurs twice counts twice; identifiers that fit
no rule are reported without a licence; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

# Known licence sentences, normalised (fixed values).
SENTENCES = {
    "copyright": "copyright",
    "mit-name": "released under the mit license",
    "mit-title": "the mit license mit",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "apache-name": "licensed under the apache license version 2 0",
    "apache-limits": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-title": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-name": "licensed under cc by nc 4 0",
    "cc-by-name": "licensed under cc by 4 0",
    "cc-by-sa-name": "licensed under cc by sa 4 0",
    "cc0-name": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "mpl2-name": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# Rules: name, licence, identifiers in order (fixed values).
RULES = [
    ("mit-full", "MIT", ("mit-grant", "mit-notice", "as-is")),
    ("bsd-3", "BSD-3-Clause", ("bsd-title", "bsd-source", "bsd-binary", "bsd-name")),
    ("apache-header", "Apache-2.0", ("apache-name", "apache-limits", "apache-copy", "apache-as-is")),
    ("bsd-2", "BSD-2-Clause", ("bsd-title", "bsd-source", "bsd-binary")),
    ("gpl-header", "GPL", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("mit-short", "MIT", ("mit-grant", "mit-notice")),
    ("apache-short", "Apache-2.0", ("apache-name", "apache-limits")),
    ("mit-titled", "MIT", ("mit-title",)),
    ("mit-released", "MIT", ("mit-name",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("apache-line", "Apache-2.0", ("apache-name",)),
    ("gpl3-line", "GPL-3.0", ("gpl3-name",)),
    ("gpl-line", "GPL", ("gpl-free",)),
    ("cc-by-nc-line", "CC-BY-NC-4.0", ("cc-by-nc-name",)),
    ("cc-by-line", "CC-BY-4.0", ("cc-by-name",)),
    ("cc-by-sa-line", "CC-BY-SA-4.0", ("cc-by-sa-name",)),
    ("cc0-line", "CC0-1.0", ("cc0-name",)),
    ("mpl2-line", "MPL-2.0", ("mpl2-name",)),
]
SENTENCE_ENDS = r"[.!?;:]+[ \t\r\n]+|[.!?;:]+$|\n+"


def _signs() -> str:
    """A pattern of a few words; each known sentence has one of them in it, as its lower-case original has."""
    left, chosen = set(SENTENCES.values()), []
    words = sorted({w for s in left for w in s.split() if len(w) > 5})
    while left:
        best = max(words, key=lambda w: sum(w in s for s in left))
        chosen.append(best)
        left = {s for s in left if best not in s}
    return "|".join(chosen)


SIGNS = _signs()


def _normalised(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "^copyright .*$", "copyright")


def identifiers(text: Column) -> Column:
    """The known identifiers of a text in order, each between two blanks; "" if none."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    candidates = F.filter(F.split(text, SENTENCE_ENDS), lambda s: F.lower(s).rlike(SIGNS))
    found = F.filter(F.transform(candidates, lambda s: F.element_at(known, _normalised(s))), lambda x: x.isNotNull())
    # Texts without any sign are not cut at all.
    return F.when(F.lower(text).rlike(SIGNS), let(found, lambda f: F.when(F.size(f) > 0, F.concat(F.lit(" "), F.array_join(f, "  "), F.lit(" "))).otherwise(F.lit("")))).otherwise(F.lit(""))


def recognise(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, sentences, rules, licences) for each row; the lists are joined by commas.

    ``rules`` is in the order of RULES, ``licences`` is sorted and without repeats.
    """
    rows = docs.select("doc_id", identifiers(F.coalesce(F.col("text"), F.lit(""))).alias("seen"))
    # Each identifier stands between two blanks of its own, so a run is a plain substring.
    rows, used = rows.withColumn("rest", F.col("seen")), []
    for name, licence, names in RULES:
        run = "".join(f" {n} " for n in names)
        rows = rows.withColumn(f"has_{name}", F.col("rest").contains(run)).withColumn("rest", F.replace("rest", F.lit(run), F.lit("#")))
        used.append((name, licence, F.col(f"has_{name}")))
    ids = F.filter(F.split("seen", " +"), lambda x: x != "")
    rules = F.array_compact(F.array(*[F.when(has, F.lit(name)) for name, _, has in used]))
    licences = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(has, F.lit(licence)) for _, licence, has in used]))))
    return rows.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_known"),
        F.array_join(ids, ",").alias("sentences"),
        F.array_join(rules, ",").alias("rules"),
        F.array_join(licences, ",").alias("licences"),
    )
