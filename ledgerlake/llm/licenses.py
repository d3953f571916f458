"""License scans by a positional index of rare license words, in DataFrame functions only.

Each template is a sequence of words. Its rare words, those with the highest IDF over all the
documents scanned, are postings of (template, position). A document's own rare words are
looked up; every hit votes for the place where the template would have to start, and a
template whose rare words agree on a start is confirmed by the phrases that it must hold.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels: fixed values.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    label: str
    words: str
    mandatory: tuple[str, ...]


#: Well-known sentences of public licenses, as words: fixed values.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Characters between words: ASCII but for digits and letters (letters are matched in either case).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rare words of a template that are indexed, and the share of them that must agree on a start.
RARE_WORDS, AGREEING = 4, 0.75


def _spaced(text: Column) -> Column:
    """Words with one space before each and one after the last; `` `` for no words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")), F.lit(" "))


def _words_of_templates(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words.split()})


def document_frequencies(docs: DataFrame, text_col: str, words: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of ``docs``, and for each of ``words`` the rows that hold it. The result is as short as ``words``."""
    listed = F.array(*[F.lit(w) for w in words])
    held = docs.select(F.array_intersect(F.split(F.translate(_spaced(F.col(text_col)), ASCII_UPPER, ASCII_LOWER), " "), listed).alias("held"))
    rows = held.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in rows}
    return found.pop("", 0), found


def build_index(templates: tuple[Template, ...], n_docs: int, frequencies: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Postings of each template's highest-IDF words: word -> (template number, position)."""
    idf = lambda w: math.log((1 + n_docs) / (1 + frequencies.get(w, 0)))
    index: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        words = template.words.split()
        rare = sorted(set(words), key=lambda w: (-idf(w), w))[:RARE_WORDS]
        for position, word in enumerate(words):
            if word in rare:
                index.setdefault(word, []).append((number, position))
    return index


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """License findings of every row's whole text.

    Columns: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and
    ``starts``, the (template, start word) pairs that were confirmed. score is the largest
    share of a template's rare words that agreed on a confirmed start, 1 where a base phrase
    was found, else 0. Null texts have no words; label strings of no labels are empty. Null
    ids and repeated rows come out as they are; other columns are ignored.
    """
    words = _words_of_templates(templates)
    n_docs, frequencies = document_frequencies(docs, text_col, words)
    index = build_index(templates, n_docs, frequencies)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _spaced(F.col(text_col)).alias("raw"))
    first_words = sorted({p.split()[0] for p in base} | set(index))
    # A row without any looked-up word can hold neither a phrase nor a template.
    lower = rows.select("doc_id", F.translate("raw", ASCII_UPPER, ASCII_LOWER).alias("s"))
    split = lower.select("doc_id", "s", F.when(F.trim("s") == "", F.array().cast("array<string>")).otherwise(F.split(F.trim("s"), " ")).alias("w"))
    split = split.select("doc_id", "s", "w", F.size("w").cast("bigint").alias("n_words"), F.arrays_overlap("w", F.array(*[F.lit(w) for w in first_words])).alias("looked_up"))

    hit = F.lit(False)
    places = []
    for phrase in base:
        parts = phrase.split()
        has = F.col("s").contains(f" {phrase} ")
        hit = hit | has
        here = " and ".join([f"element_at(w, i + {k + 1}) = '{p}'" for k, p in enumerate(parts)])
        places.append(
            F.when(has, F.expr(f"filter(transform(sequence(0, size(w) - 1), i -> if(i + {len(parts)} <= size(w) and {here}, i, -1)), i -> i >= 0)"))
            .otherwise(F.array().cast("array<int>"))
        )
    posted = F.create_map(*[x for word, posts in sorted(index.items()) for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in posts]))])
    needed = F.array(*[F.lit(len([1 for posts in index.values() for t, _ in posts if t == n])) for n in range(len(templates))])
    labels = F.array(*[F.lit(t.label) for t in templates])
    holds = F.array(*[F.lit(True) if not t.mandatory else _all_in(t.mandatory) for t in templates])

    found = split.withColumn("places", F.when(F.col("looked_up") & hit, F.concat(*places)).otherwise(F.array().cast("array<int>")))
    found = found.withColumn("base_found", F.when(F.col("looked_up") & hit, F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, base.values())]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("posted", posted).withColumn("holds", F.when(F.col("looked_up"), holds))
    found = found.withColumn(
        "votes",
        F.when(
            F.col("looked_up") & F.exists("holds", lambda x: x),
            F.expr(
                """flatten(transform(
                       filter(transform(w, (x, i) -> struct(x as x, i as i)), z -> map_contains_key(posted, z.x)),
                       z -> transform(posted[z.x], q -> struct(q.t as t, z.i - q.p as start))))"""
            ),
        ),
    )
    # Equal votes lie side by side once sorted, and a template has at most ``needed`` votes for a start.
    found = found.withColumn("needed", needed).withColumn("votes", F.array_sort(F.coalesce("votes", F.array().cast("array<struct<t:int,start:int>>"))))
    found = found.withColumn(
        "agreed",
        F.when(
            F.size("votes") > 0,
            F.expr(
                f"""filter(transform(
                        filter(sequence(0, size(votes) - 1), i -> not (get(votes, i - 1) <=> votes[i])),
                        i -> struct(votes[i].t as t, votes[i].start as start,
                                    size(filter(sequence(0, needed[votes[i].t] - 1), k -> get(votes, i + k) <=> votes[i])) / needed[votes[i].t] as share)),
                        c -> c.share >= {AGREEING} and holds[c.t])"""
            ),
        ).otherwise(F.array().cast("array<struct<t:int,start:int,share:double>>")),
    )
    found = found.withColumn("names", labels)
    all_labels = F.array_sort(F.array_distinct(F.concat("base_found", F.transform("agreed", lambda c: F.col("names")[c["t"]]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base_found")), ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("agreed", lambda c: c["share"])), F.lit(0.0))).alias("score"),
        F.transform("agreed", lambda c: F.struct(F.col("names")[c["t"]].alias("label"), c["start"].cast("bigint").alias("start"))).alias("starts"),
    )


def _all_in(phrases: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for phrase in phrases:
        out = out & F.col("s").contains(f" {phrase} ")
    return out
