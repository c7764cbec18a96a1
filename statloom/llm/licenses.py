"""Licence scan by a positional index of rare template words, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.llm.base import KEY, join_documents, keyed, query, table
from statloom.llm.decontaminate import cased_words, plain_words, small, token_places
from statloom.sources.landing import land

# fixed values: phrases whose places are counted, and the label of each
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GNU = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"


def _gnu(kind: str, version: str) -> tuple[str, str]:
    return _GNU.format(kind, version), f"gnu {kind}general public license as published by the free software foundation either version {version}"


# wordings of each licence (short notice, standard header, opening of the body), each with the phrase that must stand in the text
TEMPLATES = {
    "agpl-3.0": (("this work is licensed under the gnu affero general public license version 3", "affero general public license"), _gnu("affero ", "3")),
    "apache-2.0": (("licensed under the apache license version 2 0", "apache license version 2 0"),
                   ("apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", "apache license version 2 0 january 2004")),
    "bsd-3-clause": (("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),),
    "cc-by-4.0": (("licensed under cc by 4 0", "cc by 4 0"), ("creative commons attribution 4 0 international", "creative commons attribution 4 0 international")),
    "cc-by-nc-4.0": (("licensed under cc by nc 4 0", "cc by nc 4 0"), ("creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial 4 0 international")),
    "cc-by-sa-4.0": (("licensed under cc by sa 4 0", "cc by sa 4 0"), ("creative commons attribution sharealike 4 0 international", "creative commons attribution sharealike 4 0 international")),
    "cc0-1.0": (("released under cc0 1 0 universal", "cc0 1 0"),),
    "gpl-2.0": (("this work is licensed under the gnu general public license version 2", "general public license version 2"), _gnu("", "2"),
                ("gnu general public license version 2 june 1991", "gnu general public license version 2 june 1991")),
    "gpl-3.0": (("this work is licensed under the gnu general public license version 3", "general public license version 3"), _gnu("", "3"),
                ("gnu general public license version 3 29 june 2007", "gnu general public license version 3 29 june 2007")),
    "lgpl-2.1": (("this library is licensed under the gnu lesser general public license version 2 1", "lesser general public license"), _gnu("lesser ", "2 1")),
    "mit": (("released under the mit license", "mit license"),
            ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
             "permission is hereby granted free of charge to any person obtaining a copy of this software")),
    "mpl-2.0": (("subject to the terms of the mozilla public license v 2 0", "mozilla public license"), ("mozilla public license version 2 0", "mozilla public license version 2 0")),
    "proprietary": (("all rights reserved no part may be reproduced without permission", "all rights reserved"),),
    "unlicense": (("this is free and unencumbered software released into the public domain", "free and unencumbered software"),
                  ("anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software")),
}
RAREST, ENOUGH = 4, 0.5


def _in_words(phrase: str) -> Column:
    return F.col("_plain").contains(f" {phrase} ")


def _places(phrase: str) -> Column:
    parts = phrase.split(" ")

    def stands(i: Column) -> Column:
        test = None
        for j, word in enumerate(parts):
            one = F.get(F.col("_ws"), i + j) == word
            test = one if test is None else test & one
        return test

    return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_ws") - 1)), stands)


def _labelled(label: str):
    return lambda i: F.struct(F.lit(label).alias("label"), i.cast("bigint").alias("at"))


def _named(templates: dict[str, tuple[tuple[str, str], ...]]) -> dict[str, tuple[str, str]]:
    """Each wording under a name of its own: label, # and number."""
    return {f"{label}#{k}": wording for label, several in sorted(templates.items()) for k, wording in enumerate(several)}


def licence_words(templates: dict[str, tuple[str, str]]) -> list[tuple[str, int, str]]:
    return [(label, i, word) for label, (text, _) in sorted(templates.items()) for i, word in enumerate(text.split(" "))]


def scan_licences(docs: DataFrame, templates: dict[str, tuple[tuple[str, str], ...]] | None = None, rarest: int = RAREST, enough: float = ENOUGH) -> DataFrame:
    """Licence notices in each document.

    Returns per row: doc_id, n_words, base (places of the base phrases: label and first word), labels found by the
    method (label and, for its best wording, share of the idf of the template's rarest words that stands in place), and score (the largest
    share, 1 where a base phrase stands, else 0). The rarest words of a template are looked up in an index of their
    places; places shifted by the word's template position must meet; the key phrase is then checked. A null text has no
    words; repeated rows get equal answers; an empty table gives no rows; other columns are left out.
    """
    spark, docs, templates = docs.sparkSession, keyed(docs), _named(templates or TEMPLATES)
    words = spark.createDataFrame(licence_words(templates), "label string, at int, word string")
    # key phrases are checked where their text is read; a cheap test spares texts that cannot hold one
    hints = sorted({max(phrase.split(" "), key=len) for phrase in [*BASE_PHRASES, *[p for _, p in templates.values()]]})
    maybe = F.lower("text").rlike("|".join(hints))
    read = docs.select(
        *KEY, F.size(cased_words(F.col("text"))).cast("bigint").alias("n_words"),
        F.when(maybe, plain_words(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("_ws"),
    )
    read = read.withColumn("_plain", F.concat(F.lit(" "), F.array_join("_ws", " "), F.lit(" ")))
    base = F.concat(*[
        F.when(_in_words(p), F.transform(_places(p), _labelled(label)))
        .otherwise(F.array().cast("array<struct<label:string,at:bigint>>")) for p, label in BASE_PHRASES.items()
    ])
    phrases = F.filter(F.array(*[F.when(_in_words(p), F.lit(label)) for label, (_, p) in sorted(templates.items())]), lambda x: x.isNotNull())
    read = land(read.select(*KEY, "n_words", base.alias("base"), phrases.alias("phrases")))
    held = docs.select(F.explode(F.array_distinct(cased_words(F.lower("text")))).alias("word")).join(land(words.select("word").distinct()), "word", "left_semi")
    counts = land(held.groupBy("word").agg(F.count("*").alias("df")))
    total = read.count()
    known = words.join(counts, "word", "left").withColumn("idf", F.log((total + 1.0) / (F.coalesce("df", F.lit(0)) + 0.5)))
    known = known.groupBy("label").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("idf", "word", "at")))), 1, rarest).alias("top"))
    rare = land(known.select("label", F.aggregate("top", F.lit(0.0), lambda a, t: a + t.idf).alias("sum"), F.explode("top").alias("t")).select("label", "sum", "t.*"))
    index = token_places(docs, land(rare.select("word").distinct()))
    meets = index.join(rare, "word").groupBy(*KEY, "label", (F.col("p") - F.col("at")).alias("start")).agg((F.sum("idf") / F.first("sum")).alias("share"))
    meets = meets.where(F.col("share") >= enough).groupBy(*KEY, "label").agg(F.least(F.lit(1.0), F.max("share")).alias("share"))
    found = land(meets.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("label", "share"))).alias("found")))
    out = join_documents(read, found)
    placed = F.filter("found", lambda f: F.array_contains(F.col("phrases"), f.label))
    placed = F.transform(placed, lambda f: F.struct(F.substring_index(f.label, "#", 1).alias("label"), f.share.alias("share")))
    best = F.filter(placed, lambda f: ~F.exists(placed, lambda g: (g.label == f.label) & (g.share > f.share)))
    labels = F.coalesce(F.array_distinct(best), F.array().cast("array<struct<label:string,share:double>>"))
    out = out.select(*KEY, "n_words", "base", labels.alias("labels"))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("labels", lambda f: f.share)), F.lit(0.0)))
    return out.select("doc_id", "n_words", "base", "labels", score.alias("score"))


@query("op6_license_scan")
def op6(spark, sf_dir):
    found = scan_licences(table(spark, sf_dir, "documents"))
    base, more = F.transform("base", lambda b: b.label), F.transform("labels", lambda f: f.label)
    at = F.transform("base", lambda b: b["at"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"), "score",
    )


__all__ = ["op6", "scan_licences", "small"]
