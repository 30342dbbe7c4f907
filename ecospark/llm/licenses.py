"""Licence scans (operator 4): a positional rare-token index over licence templates.  [native]

Texts are lower-cased (A-Z) and cut into words (letters, digits and everything beyond ASCII). The index holds, for
every word of the licence templates, its postings (template, position) and its rarity (inverse document frequency
over the templates and the corpus: words that few templates and few documents hold come first). For each document

1. the positions of index words are taken (all other words drop out at once),
2. the ``RAREST`` highest-IDF key phrase words of every template are looked up and their postings intersected by
   relative position: a hit at document position p of a word at template position q votes for an alignment
   (template, p - q), and an alignment with all votes is a candidate. Key words are mandatory, so no occurrence is
   missed, whatever else the document holds, and
3. a template occurs where its mandatory key phrases stand consecutively within the aligned span and at least ``SHARE``
   of its words stand at their places.

The base labels come from three phrases that are counted in every text, every place. ``score`` is the best share of a
template's words that stand at their aligned places, 1 for a base label without an alignment, else 0.

All of it is DataFrame operations; one row per document and index word is the largest intermediate, so a document of
any length stays whole. Null texts are empty: no words, no places, empty labels, score 0. Rows are scanned one by
one under a row key of their own, so ties, repeated rows and null ids stay apart; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecospark.llm.tables import column, stored

#: fixed values: phrases of the base labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: template -> (label, words, mandatory key phrases)
TEMPLATES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "mit notice": ("mit", "released under the mit license", ("mit license",)),
    "mit grant": ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
    "apache notice": ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    "apache header": ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                      "with the license", ("apache license", "except in compliance")),
    "gpl notice": ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    "gpl header": ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    "lgpl notice": ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    "agpl notice": ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    "bsd conditions": ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
                       "the following conditions are met", ("source and binary forms", "conditions are met")),
    "isc grant": ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
                  ("or without fee", "hereby granted")),
    "mpl header": ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "cc by": ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    "cc by sa": ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    "cc by nc": ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    "cc by nc sa": ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    "cc0": ("cc0", "to the extent possible under law the author has waived all copyright", ("waived all copyright",)),
    "unlicense": ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    "reserved": ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
}
#: words that are in every text: indexed only where a key phrase needs them
FUNCTION_WORDS = set("a all and any are as by for in into is it of or that the this to you with".split())
#: words looked up per template; share of a template's words that must stand at their places
RAREST, SHARE = 8, 0.6
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def postings() -> list[tuple[str, str, int, bool]]:
    """The positional index: (word, template, position, in a key phrase)."""
    out = []
    for name, (_, text, phrases) in TEMPLATES.items():
        words = text.split()
        key = set()
        for phrase in phrases:
            k = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            key |= set(range(at, at + len(k)))
        out += [(w, name, i, i in key) for i, w in enumerate(words) if i in key or w not in FUNCTION_WORDS]
    return out


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def scanned(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, n_words, base columns, hits)``: one pass over the texts; ``hits`` are the places of index words."""
    norm = F.trim(F.regexp_replace(F.translate(F.coalesce(column(docs, "text", "string"), F.lit("")), UPPER, LOWER), WORD_GAP, " "))
    one = docs.select(column(docs, "doc_id", "long"), F.inline(F.array(F.struct(norm.alias("norm")))))  # evaluated once
    phrases = "(?:" + "|".join(BASE) + ")(?= |$)"
    place, x = f"(?:^| ){phrases}", F.col("norm")
    words = F.split(x, " ", -1)
    index = sorted({w for w, *_ in postings()})
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("pos"))), lambda h: h["w"].isin(index))
    n = F.regexp_count(x, F.lit(place)).cast("long")
    before = lambda greedy: _spaces(F.regexp_extract(x, f"(?s)^(.*{greedy}(?:^| )){phrases}", 1)).cast("long")
    has = [F.when(x.rlike(f"(?:^| ){p}(?= |$)"), F.lit(label)) for p, label in sorted(BASE.items(), key=lambda i: i[1])]
    return one.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(x == "", 0).otherwise(_spaces(x) + 1).cast("long").alias("n_words"),
                      n.alias("n_base"), F.when(n > 0, before("?")).alias("first_word"), F.when(n > 0, before("")).alias("last_word"),
                      F.when(n > 0, F.array_compact(F.array(*has))).otherwise(F.array().cast("array<string>")).alias("base"), hits.alias("hits"))


def matches(base: DataFrame) -> DataFrame:
    """``(row, labels, score)`` of the documents in which a template stands, from the places of index words."""
    spark, index = base.sparkSession, postings()
    hits = base.select("row", F.inline("hits"))
    holders = defaultdict(set)
    for w, t, *_ in index:
        holders[w].add(t)
    seen = base.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # one row per index word or posting: a fixed number
    rarity = spark.createDataFrame([(w, math.log(len(TEMPLATES) / len(t))) for w, t in sorted(holders.items())], "w string, idf double")
    idf = rarity.join(seen, "w", "left").select("w", (F.col("idf") - F.log(F.coalesce("df", F.lit(0.5)))).alias("idf"))
    post = spark.createDataFrame(index, "w string, template string, q long, key boolean")
    order = Window.partitionBy("template").orderBy(F.desc("idf"), "w", "q")
    rare = post.filter("key").join(idf, "w").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= RAREST)
    rare = stored(rare.withColumn("most", F.count(F.lit(1)).over(Window.partitionBy("template"))).select("w", "template", "q", "most"))
    sizes = defaultdict(lambda: [0, 0])
    for _, t, _, key in index:
        sizes[t][0] += 1
        sizes[t][1] += key
    size = F.broadcast(spark.createDataFrame([(t, TEMPLATES[t][0], *n) for t, n in sizes.items()], "template string, label string, size long, keys long"))
    votes = hits.join(F.broadcast(rare), "w").groupBy("row", "template", (F.col("pos") - F.col("q")).alias("at"))
    found = votes.agg(F.count(F.lit(1)).alias("votes"), F.first("most").alias("most")).filter("votes = most").drop("votes", "most")
    # the places where the candidates' words should be, against the words that stand there
    due = found.join(F.broadcast(post), "template").withColumn("pos", F.col("at") + F.col("q")).drop("q")
    aligned = due.join(hits, ["row", "pos", "w"]).groupBy("row", "template", "at").agg(
        F.count(F.lit(1)).alias("stand"), F.count(F.when(F.col("key"), 1)).alias("key"))
    good = aligned.join(size, "template").filter((F.col("key") == F.col("keys")) & (F.col("stand") >= SHARE * F.col("size")))
    return good.groupBy("row").agg(F.collect_set("label").alias("own"), F.max(F.col("stand") / F.col("size")).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every document."""
    base = stored(scanned(docs))
    rows = base.filter(F.size("hits") > 0)
    out = base.drop("hits").join(matches(rows), "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                      F.array_join(labels, ",").alias("labels"), score.alias("score"))
