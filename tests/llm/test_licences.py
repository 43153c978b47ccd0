"""Licence scan against a plain search of phrases and in-order template words."""

import random
import re

from muster.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text):
    words = slow_words(text)
    places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    best, labels = float(bool(places)), set(base)
    for label, texts in licences.TEMPLATES.items():
        for template in texts:
            parts = template.replace(".", " ").split()
            lines = {}
            for at in range(len(parts) - 3):
                for i in range(len(words) - 3):
                    if words[i:i + 4] == parts[at:at + 4]:
                        lines.setdefault(i - at, set()).add(at)
            group, last = set(), None
            for diagonal in sorted(lines):
                if last is not None and diagonal - last > licences.SLACK:
                    group = set()
                group |= lines[diagonal]
                last = diagonal
                share = len(group) / (len(parts) - 3)
                best = max(best, share)
                if share >= licences.LEAST_SHARE:
                    labels.add(label)
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), best)


def test_equals_plain_search(spark):
    rng = random.Random(6)
    lines = ["All rights reserved.", "CC BY", "cc-by-nc 4.0", "Licensed under the Apache License, Version 2.0.",
             "Licensed under CC BY-NC 4.0.", "the general public license of", "general public, licenses",
             "Permission is hereby granted, free of (any) charge, to any person obtaining a copy of this software",
             "redistribution and use in source and binary forms, with or without change, are permitted provided that"]
    texts = [None, "", "cc", "cc by cc by all rights reserved", *lines]
    for _ in range(60):
        noise = [" ".join(rng.choice(["of", "the", "Éa", "license", "by", "cc", "all"]) for _ in range(rng.randint(0, 40)))
                 for _ in range(3)]
        texts.append(" ".join([noise[0], rng.choice(lines), noise[1], rng.choice(lines), noise[2]]))
    rows = [(k, t, "own") for k, t in enumerate(texts)] + [(0, None, "own"), (3, texts[3], "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(4)
    got = sorted((r.doc_id, tuple(r)[1:]) for r in licences.scan(docs).collect())
    assert repr(got) == repr(sorted((k, slow(t)) for k, t, _ in rows))


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
