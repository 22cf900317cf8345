"""Licence families of paragraphs, by a trained classifier and template comparison.

A multinomial logistic regression on sparse word n-grams (single words and pairs
of the templates' wording) tells licence families and ``unknown`` apart. It is
trained on the templates, variants of them with a word left out or other words
around them, and a bounded sample of the corpus's own paragraphs as unknown ones;
its temperature is calibrated on held-out training rows. A prediction counts only
if the paragraph also covers enough of the word pairs of one of that family's
templates.

Everything is DataFrame and ``pyspark.ml`` code in the JVM. The table of n-gram
weights is bounded by the templates' wording, so joining it is a broadcast.

Only paragraphs that can cover a template are scored: of a template's word pairs
some few must occur in every paragraph that covers enough of it, so one of their
words must; ``required_words`` are looked for in the text first, which loses none.

A paragraph is a line with words. Defined results: null text has no paragraphs;
a null doc_id is reported as null; repeated rows are scored once and answered
each; a paragraph as likely of two families counts as the first; extra columns
are ignored; an empty table gives no rows (the classifier is trained all the
same).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm._session import durable

UNKNOWN = "unknown"

#: Customary notices of each licence family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT license.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
FAMILIES = [*TEMPLATES, UNKNOWN]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def grams_of(words: Column) -> Column:
    return F.array_distinct(F.concat(words, pairs_of(words)))


def paragraphs(docs: DataFrame, wanted: Callable[[Column], Column] = lambda line: F.lit(True)) -> DataFrame:
    """doc_id, version (hash of the text), pos, words of every paragraph, or of the wanted ones."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(wanted(F.col("line"))).select("doc_id", "version", "pos", words_of(F.col("line")).alias("words")).where(F.size("words") > 0)


def required_words(min_cover: float) -> list[tuple[str, ...]]:
    """Words, or pairs of short words, one of which (as parts of a lower-case text) every paragraph has that covers ``min_cover`` of a template's pairs.

    Of n pairs such a paragraph has k = ceil(min_cover * n) or more, so one of any
    n - k + 1 of them: those are taken that are at hand already, or have a long
    word, which is rare. Empty where nothing is required.
    """
    chosen: list[tuple[str, ...]] = []

    def forms(pair: tuple[str, str]) -> list[tuple[float, tuple[str, ...]]]:
        known = any(all(any(x in w for w in pair) for x in c) if len(c) > 1 else any(c[0] in w for w in pair) for c in chosen)
        return [(0.0, pair)] if known else [(len("".join(f)) ** -3.0, f) for f in (pair[:1], pair[1:], pair) if len("".join(f)) > 4 or len(f) > 1]

    for text in sorted((t for ts in TEMPLATES.values() for t in ts), key=len):
        words = re.findall("[a-z0-9]+", text.lower())
        left = sorted({*zip(words, words[1:], strict=False)})
        need = math.ceil(min_cover * len(left) - 1e-9)
        if need < 1:
            return []
        for _ in range(len(left) - need + 1):
            pair = min(left, key=lambda p: (min(forms(p))[0], p))
            left.remove(pair)
            cost, form = min(forms(pair), key=lambda f: (len(f[1]), f))
            if cost:
                chosen.append(form)
    return [c for c in chosen if not any(o != c and all(any(x in w for w in c) for x in o) for o in chosen)]


def has_one(text: Column, words: list[tuple[str, ...]]) -> Column:
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [lower.contains(w) for w in form]) for form in words]) if words else F.lit(True)


def templates(spark: SparkSession) -> DataFrame:
    """family, template, words, pairs of every template."""
    rows = [(family, k, text) for k, (family, text) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    base = spark.createDataFrame(rows, "family string, template int, text string").withColumn("words", words_of(F.col("text")))
    return base.select("family", "template", "words", F.array_distinct(pairs_of(F.col("words"))).alias("pairs"))


def training_rows(docs: DataFrame, max_unknown: int) -> DataFrame:
    """label, words: the templates' variants, and a sample of paragraphs of the corpus."""
    spark = docs.sparkSession
    number = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    known = templates(spark)
    total = max(1, docs.count())
    drawn = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(min(1.0, max_unknown / total) * (1 << 40))))
    # one paragraph of each drawn document, unless it may be a licence in other words
    some = paragraphs(drawn).groupBy("doc_id", "version").agg(F.min_by("words", F.xxhash64("pos", "version")).alias("words"))
    forms = known.agg(F.collect_list("pairs").alias("forms"))
    own = pairs_of(F.col("words"))
    alike = F.exists("forms", lambda form: F.size(F.array_intersect(form, own)) >= 0.3 * F.size(form))
    plain = durable(some.join(F.broadcast(forms), F.lit(True)).where(~alike).select("words").coalesce(4))
    around = plain.select(F.slice("words", 1, 6).alias("around")).orderBy(F.xxhash64("around")).limit(200)
    whole = known.select("family", "words")
    shorter = known.select("family", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at")).where(F.size("words") > 4)
    shorter = shorter.select("family", F.filter("words", lambda _, i: i != F.col("at")).alias("words"))
    # a bounded table of snippets beside each template: 200 at most
    wrapped = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).join(F.broadcast(around.withColumn("k", F.pmod(F.xxhash64("around"), F.lit(10)))), "k")
    wrapped = wrapped.select("family", F.when(F.pmod(F.xxhash64("around", "template"), F.lit(2)) == 0, F.concat("around", "words")).otherwise(F.concat("words", "around")).alias("words"))
    rows = whole.unionByName(shorter).unionByName(wrapped).withColumn("label", number.cast("double")).select("label", "words")
    return rows.unionByName(plain.select(F.lit(float(len(FAMILIES) - 1)).alias("label"), "words"))


def train(docs: DataFrame, max_unknown: int = 5_000) -> tuple[DataFrame, list[float], float]:
    """(gram and its weights by family, intercepts, temperature). ``max_unknown`` bounds the sample."""
    spark = docs.sparkSession
    vocabulary = templates(spark).select(F.explode(grams_of(F.col("words"))).alias("gram")).distinct().orderBy("gram")
    vocabulary = [r.gram for r in vocabulary.collect()]  # the templates' wording
    rows = training_rows(docs, max_unknown).withColumn("grams", grams_of(F.col("words")))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", minTF=0.0, binary=True).transform(rows).withColumn("held", F.pmod(F.xxhash64("words"), F.lit(5)) == 0)
    vectors = durable(vectors.select("label", "features", "held").coalesce(2))  # a bounded sample
    model = LogisticRegression(regParam=0.002, maxIter=60, family="multinomial").fit(vectors.where(~F.col("held")))
    known = model.coefficientMatrix.toArray()
    weights, intercepts = known.tolist(), model.interceptVector.toArray().tolist()
    # families absent from the rows never win
    weights += [[0.0] * len(vocabulary)] * (len(FAMILIES) - len(weights))
    intercepts += [-50.0] * (len(FAMILIES) - len(intercepts))
    table = spark.createDataFrame([(g, [float(w[i]) for w in weights]) for i, g in enumerate(vocabulary)], "gram string, weights array<double>")
    grid = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    raw = model.transform(vectors.where("held")).select("label", vector_to_array("rawPrediction").alias("z"))

    def loss(t: float) -> Column:
        total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max("z")) / t))
        return F.avg(F.log(total) + (F.array_max("z") - F.get("z", F.col("label").cast("int"))) / t)

    losses = raw.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    temperature = min(zip(losses, grid, strict=True), key=lambda x: (x[0] is None, x[0]))[1] if losses and losses[0] is not None else 1.0
    return table, intercepts, temperature


def scan(docs: DataFrame, min_probability: float = 0.5, min_cover: float = 0.6, max_unknown: int = 5_000) -> DataFrame:
    """doc_id, version, pos, family, probability, cover of every paragraph with a confirmed licence."""
    spark = docs.sparkSession
    table, intercepts, temperature = train(docs, max_unknown)
    n = len(FAMILIES)
    words = required_words(min_cover)
    texts = docs.select("doc_id", "text").where(has_one(F.col("text"), words))
    # few paragraphs are left, so copies of a row are dropped here and not as whole texts
    found = paragraphs(texts, lambda line: has_one(line, words)).dropDuplicates(["doc_id", "version", "pos"])
    hits = found.select("doc_id", "version", "pos", F.explode(grams_of(F.col("words"))).alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy("doc_id", "version", "pos").agg(*[F.sum(F.get("weights", F.lit(k))).alias(f"z{k}") for k in range(n)], F.collect_set(F.when(F.col("gram").contains(" "), F.col("gram"))).alias("pairs"))
    z = F.array(*[(F.col(f"z{k}") + intercepts[k]) / temperature for k in range(n)])
    scored = sums.select("doc_id", "version", "pos", "pairs", z.alias("z"))
    top = F.array_max("z")
    best = F.array_position("z", top).cast("int")
    scored = scored.select("doc_id", "version", "pos", "pairs", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), best).alias("family"), (F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - top))).alias("probability"))
    likely = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= min_probability))
    forms = templates(spark).groupBy("family").agg(F.collect_list("pairs").alias("forms"))
    covers = F.transform("forms", lambda form: F.size(F.array_intersect(form, F.col("pairs"))) / F.size(form))
    return likely.join(F.broadcast(forms), "family").withColumn("cover", F.array_max(covers)).where(F.col("cover") >= min_cover).select("doc_id", "version", "pos", "family", "probability", "cover")


def license_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (sorted, joined by commas) of every row."""
    found = scan(docs, **options).groupBy("doc_id", "version").agg(F.countDistinct("pos").alias("n_licensed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    found = found.withColumnsRenamed({"doc_id": "_doc", "version": "_version"})
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_paragraphs"))
    base = base.withColumn("n_paragraphs", F.greatest("n_paragraphs", F.lit(0)))
    joined = base.join(found, base.doc_id.eqNullSafe(found["_doc"]) & (base.version == found["_version"]), "left")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"))
