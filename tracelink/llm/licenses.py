"""License scan by diagonal voting over word k-grams.

Every rolling word k-gram of a text is hashed and joined to the positions of the same k-gram in the license
templates; hits are summed per offset diagonal (text position minus template position), neighbouring diagonals are
merged, and a merged span counts when enough of the template's k-grams, compared as text and not only as hashes,
lie on it. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelink.storage import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: A span counts when it holds this share of its template's k-grams.
VERIFIED = 0.8
#: Diagonals this many words apart belong to one span: words inserted or left out inside a license line.
NEIGHBOUR = 3

#: The phrases that the contract of the scan names, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Well-known sentences of public licenses and the labels that the method adds.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license version 2", "gpl-2"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
]


def template_grams(spark: SparkSession, base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """(gram, template, label, is_base, grams, at): positions of every k-gram; templates have K to K + 61 words."""
    rows = []
    for number, (phrase, label) in enumerate([*base, *templates]):
        words = phrase.split()
        count = len(words) - K + 1
        if not 1 <= count <= 62:
            raise ValueError(f"a template must have {K} to {K + 61} words: {phrase}")
        rows += [(" ".join(words[i : i + K]), number, label, number < len(base), count, i) for i in range(count)]
    return spark.createDataFrame(rows, "gram string, template int, label string, is_base boolean, grams int, at int")


def scan_licenses(
    docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for every row of `docs`.

    Null text counts as empty: no words, no labels, score 0. Rows alike in id and text get the same result; the same
    id with other text is scanned for itself, also where the id is null. Other columns of `docs` are not read.
    score is the largest share of a template's k-grams found on one span, 1 for a base phrase.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, base, templates)
    keys = [r.h for r in grams.select(F.xxhash64(*[F.split("gram", " ")[i] for i in range(K)]).alias("h")).distinct().collect()]
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    worded = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("_words"))
    at = F.when(F.size("_words") >= K, F.sequence(F.lit(0), F.size("_words") - K)).otherwise(F.array().cast("array<int>"))
    gram_hash = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(K)])
    kept = F.filter(at, lambda i: gram_hash(i).isin(keys))
    hits = F.transform(kept, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("_words", i + 1, K), " ").alias("gram")))
    scanned = materialise(worded.select("doc_id", "_text", F.size("_words").cast("long").alias("n_words"), hits.alias("_hits")), "license-hits")

    voted = scanned.where(F.size("_hits") > 0).select("doc_id", "_text", F.explode("_hits").alias("hit"))
    voted = voted.select("doc_id", "_text", "hit.pos", "hit.gram").join(F.broadcast(grams), "gram")
    diagonals = voted.groupBy("doc_id", "_text", "template", "label", "is_base", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    line = Window.partitionBy("doc_id", "_text", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > NEIGHBOUR) | (F.col("low") - F.lag("high").over(line) > NEIGHBOUR + K), F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(line))
    full = F.col("is_base") & (F.bit_count("votes") == F.col("grams"))
    spans = merged.groupBy("doc_id", "_text", "template", "label", "span").agg(
        (F.bit_count(F.bit_or("votes")) / F.first("grams")).alias("share"),
        F.count_if(full).alias("places"), F.min(F.when(full, F.col("diagonal"))).alias("first"), F.max(F.when(full, F.col("diagonal"))).alias("last"),
    )
    good = (F.col("places") > 0) | ((F.col("share") >= VERIFIED) & (F.col("template") >= len(base)))
    found = spans.where(good).groupBy("doc_id", "_text").agg(
        F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("places") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "_id", "_text": "_of"})
    joined = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
