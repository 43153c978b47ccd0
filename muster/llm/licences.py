"""Licence scan by diagonal voting, in built-in functions only.

Texts are read as words; hashes of all rolling word pairs (for short phrases) and word quadruples
(for longer templates) are joined to the places where the templates have them. A match votes for
the diagonal document place - template place. Neighbouring diagonals of one template are merged,
so that a template with a few words put in or left out still gives one span. Every match is verified
word by word before it votes, so a phrase, which needs all its pairs on one diagonal, stands there
in full, and a template gives its label where enough of its quadruples stand along a span.

The templates are the fixed lists below, some hundred places in all: the join's small side does not
grow with the data. Votes are few, because only matching grams become rows.

Defined results: a null or empty text has no words, no places and score 0. ``score`` is the
largest share of a template that a span covers, 1 for a whole phrase. Repeated rows get equal
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart
from muster.llm.common import LOWER, PLAIN_WORD, UPPER, let, row_keys

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening or notice words of common licences, with the labels of this method.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2.0",
               "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"],
    "cc-by": ["this work is licensed under a creative commons attribution 4.0 international license",
              "licensed under the creative commons attribution license"],
    "cc-by-nc": ["licensed under cc by nc 4.0"],
    "gpl": ["licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", "released under the mit license"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
}
PAIR, GRAM = 2, 4
#: Matches whose diagonals differ by no more than this belong to one span.
SLACK = 3
LEAST_SHARE = 0.7


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(PLAIN_WORD), F.lit(0))


def grams(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from each place on; the incomplete last ones are cut off."""
    def rolled(hashes: Column) -> Column:
        every = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, size)]))
        return F.slice(every, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def template_grams(spark: SparkSession) -> DataFrame:
    """``(template, label, phrase, total, at, words, gram)``: one row per gram of each template."""
    rows = []
    listed = [(text, label, True) for text, label in PHRASES.items()] + [
        (text, label, False) for label, texts in TEMPLATES.items() for text in texts]
    for number, (text, label, phrase) in enumerate(listed):
        size = PAIR if phrase else GRAM
        words = text.replace(".", " ").split()
        total = len(words) - size + 1
        for at in range(total):
            gram = ", ".join(f"'{w}'" for w in words[at:at + size])
            rows.append(f"({number}, '{label}', {phrase}, {total}, {at}, array({gram}))")
    made = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, phrase, total, at, words)")
    return made.withColumn("gram", F.when(F.col("phrase"), grams(F.col("words"), PAIR)[0]).otherwise(
        grams(F.col("words"), GRAM)[0]))


def votes(docs: DataFrame, text: str) -> DataFrame:
    """Verified matches ``(key_a, key_b, template, label, phrase, total, at, place)``, each once."""
    read = docs.select("key_a", "key_b", words_of(F.col(text)).alias("said"))
    rolled = read.withColumn("rolled", F.struct(grams(F.col("said"), PAIR).alias("pairs"),
                                                grams(F.col("said"), GRAM).alias("quads")))
    every = rolled.select("key_a", "key_b", "said", F.size("rolled.pairs").alias("pairs"),
                          F.posexplode(F.concat("rolled.pairs", "rolled.quads")).alias("i", "gram"))
    # The templates are a fixed list of this file.
    met = every.join(F.broadcast(template_grams(docs.sparkSession)), "gram")
    place = F.col("i") - F.when(F.col("i") < F.col("pairs"), 0).otherwise(F.col("pairs"))
    met = met.withColumn("place", place)
    return met.where(F.slice("said", F.col("place") + 1, F.size("words")) == F.col("words")).select(
        "key_a", "key_b", "template", "label", "phrase", "total", "at", "place").distinct()


def spans(matches: DataFrame) -> DataFrame:
    """``(key_a, key_b, label, phrase, begin, share)`` of each merged group of diagonals."""
    keys = ["key_a", "key_b", "template", "label", "phrase", "total"]
    lines = matches.groupBy(*keys, (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.min("place").alias("begin"), F.collect_set("at").alias("found"))
    along = W.partitionBy("key_a", "key_b", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("phrase"), 0).otherwise(SLACK)
    marked = lines.withColumn("group", F.sum(F.when(apart, 1).otherwise(0)).over(along))
    merged = marked.groupBy(*keys, "group").agg(
        F.min("begin").alias("begin"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    return merged.select("key_a", "key_b", "label", "phrase", "begin",
                         (F.size("found") / F.col("total")).alias("share"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``key``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score``."""
    keyed = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *row_keys(docs, [key, text]))
    whole = F.col("phrase") & (F.col("share") == 1)
    labelled = whole | (~F.col("phrase") & (F.col("share") >= LEAST_SHARE))

    def names(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    per_row = aggregate_apart(
        spans(votes(keyed, "__text")), ["key_a", "key_b"],
        F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("begin"))).alias("first_word"),
        F.max(F.when(whole, F.col("begin"))).alias("last_word"), names(whole).alias("base_labels"),
        names(labelled).alias("labels"), F.max(F.when(labelled | ~F.col("phrase"), F.col("share"))).alias("score"))
    counted = keyed.select("__key", "key_a", "key_b", F.size(words_of(F.col("__text"))).cast("long").alias("n_words"))
    return counted.join(per_row, ["key_a", "key_b"], "left").select(
        F.col("__key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
