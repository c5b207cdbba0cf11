"""Licence scan: which paragraphs state a licence, and of which family.

A paragraph is a line of a text.  A statement that is wrapped over lines, also in comment lines, is
reported at the line where it begins: a line that states no licence by itself is read again with
the words that follow it before the next blank line.  Features are its words and word pairs that occur in licence
templates; a pair counts only with a word that is not one of the fixed ``ORDINARY`` words, so a
paragraph without such a word has no feature at all and needs no scoring.  The list is fixed
because words counted in the corpus would drop a licence that the corpus states often.  A multinomial logistic
regression over the sparse features is fitted on variants of the templates, on a bounded sample
of ordinary paragraphs (``SAMPLE``) and on sentences that use licence words otherwise.  One half
of the ordinary paragraphs is kept out of the fit and sets the probability that a family needs;
below it a paragraph is ``unknown``.  A family is confirmed by how much of one of its templates
the paragraph holds.

Everything on the way of the data is DataFrame and SQL functions and Spark ML.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, written

UNKNOWN = "unknown"
#: Ordinary paragraphs in the training sample, and variants made of each template.
SAMPLE, VARIANTS = 2000, 24
#: Template words that ordinary text has everywhere (``mit`` is German); no features by themselves.
ORDINARY = ["a", "and", "are", "as", "by", "in", "is", "it", "mit", "of", "only", "or", "that", "the", "this", "to", "with"]
#: Share of the held-out ordinary paragraphs that may pass for a licence; least probability of a family.
FALSE_RATE, LEAST = 0.001, 0.5
#: Share of a template's features that a paragraph must hold.
CONFIRM = 0.6

#: Licence families with texts that state them.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the 3-clause BSD License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright 2020 Example Corporation. All rights reserved."),
    ("public-domain", "This work is released into the public domain."),
    ("public-domain", "Dedicated to the public domain under CC0 1.0 Universal."),
]
#: Sentences that use licence words but state no licence.
OTHERWISE = [
    "She renewed her driving license last week.", "The software is free to try for thirty days.", "He had no permission to copy the file.",
    "The general public may visit the domain on Sundays.", "Version 2.0 of the program was released in May.", "They reserved all the rooms for the group.",
    "The rights of the people were granted by the king.", "Source and binary stars are seen in many forms.", "Attribution of the painting is not certain.",
    "The foundation published a work about common land.", "Under the new rules a library can be used free of charge.", "A fishing licence is granted by the county.",
    "The MIT professor released a new book.", "An Apache helicopter landed under heavy rain.", "The GNU is an animal of the plains.", "The terms of the project were modified.",
]

_BETWEEN = r"[^\p{L}\p{N}]+"
#: Words after a line that are read with it: twice those of the longest template.
REACH = 2 * max(len(re.findall(r"[^\W_]+", t)) for _, t in TEMPLATES)


def _told(words: Column) -> Column:
    """Without numbers (versions, years): they say nothing of the family."""
    return F.filter(words, lambda w: ~w.rlike("^[0-9]*$"))


def _words(text: Column) -> Column:
    """Lower-cased words without numbers."""
    return _told(F.split(F.lower(text), _BETWEEN))


def _pairs(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _grams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, F.filter(_pairs(words), lambda p: p.contains(" "))))


def _fixed(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """``(n, family, text)`` of a fixed list, as a literal of the plan."""
    data = json.dumps([{"n": i, "family": f, "text": t} for i, (f, t) in enumerate(rows)])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), "array<struct<n:int,family:string,text:string>>")))


def _variants(rows: DataFrame) -> DataFrame:
    """Each text whole and with about a sixth of its words left out in ``VARIANTS`` ways."""
    words = rows.withColumn("words", _words(F.col("text"))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS))))
    keep = F.filter("words", lambda w, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(F.col("n"), F.col("v"), i, w), F.lit(6)) > 0))
    return words.withColumn("words", keep).filter("size(words) > 0").select("family", "words")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, words)`` for each line of each text, counted from 0; null texts have none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "line")) \
        .select("doc_id", "paragraph", _words(F.col("line")).alias("words"))


def _features(templates: list[tuple[str, str]], grams: list[str]) -> list[list[str]]:
    """Those of ``grams`` that each template holds."""
    kept, out = re.compile(r"[^\W_]+"), []
    for _, text in templates:
        words = [w for w in kept.findall(text.lower()) if not w.isdigit()]
        out.append(sorted({*words, *map(" ".join, zip(words, words[1:]))} & set(grams)))
    return out


def wrapped(docs: DataFrame, anchors: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, words, more)`` for each line with one of ``anchors``; ``more`` are the ``REACH`` words
    that follow it in the next lines.  A line without letters and digits, as an empty comment line, ends them."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.transform(F.split(F.col(text_col), "\n"), lambda x: F.split(F.lower(x), _BETWEEN)).alias("lines"))
    hit = F.filter(F.transform("lines", lambda x, i: F.when(F.arrays_overlap(x, F.lit(anchors)), i)), lambda i: i.isNotNull())

    def following(i: Column) -> Column:
        # a line that goes on has a word at least, so no more than REACH lines are needed
        after = F.slice("lines", i + 2, F.lit(REACH))
        blank = F.array_position(F.transform(after, lambda x: F.array_join(x, "")), "")
        return F.slice(_told(F.flatten(F.when(blank > 0, F.slice(after, F.lit(1), (blank - 1).cast("int"))).otherwise(after))), 1, REACH)

    rows = lines.select("doc_id", F.explode(F.transform(hit, lambda i: F.struct(
        i.alias("paragraph"), _told(F.element_at("lines", i + 1)).alias("words"), following(i).alias("more")))).alias("row"))
    return rows.select("doc_id", "row.*")


class Model:
    """What a fit yields: the vocabulary, the words a paragraph needs one of, the regression, the
    families in the order of its classes, and the least probability of a family."""

    def __init__(self, vectorizer, regression, families, anchors, grams, templates, least):
        self.vectorizer, self.regression, self.families = vectorizer, regression, families
        self.anchors, self.grams, self.templates, self.least = anchors, grams, templates, least


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the fixed texts and on ``sample`` paragraphs of the documents with the smallest hashes."""
    spark = docs.sparkSession
    few = hash_sample(docs.select(id_col, text_col), text_col, max(1, sample // 4))
    templates = _fixed(spark, TEMPLATES)
    licence = _variants(templates).select("family", _grams(F.col("words")).alias("grams"))
    known = [r["w"] for r in templates.select(F.explode(_words(F.col("text"))).alias("w")).distinct().collect()]
    anchors = sorted(w for w in known if w not in ORDINARY)
    grams = sorted({r["g"] for r in templates.select(F.explode(_grams(_words(F.col("text")))).alias("g")).collect()
                    if any(w not in ORDINARY for w in r["g"].split(" "))})
    ordinary = written(paragraphs(few, id_col, text_col).filter("size(words) > 0").limit(sample).select("words"), "ordinary")
    # sampled lines that state a licence are no ordinary text, and a line counts once however often it is repeated
    ordinary = ordinary.withColumn("grams", _grams(F.col("words")))
    for own in _features(TEMPLATES, grams):
        ordinary = ordinary.filter(F.size(F.array_intersect("grams", F.lit(own))) < CONFIRM * len(own))
    ordinary = ordinary.dropDuplicates(["grams"]).select("words")
    vectorizer = CountVectorizerModel.from_vocabulary(grams, inputCol="grams", outputCol="features")
    vectorizer.setBinary(True)
    plain = ordinary.unionByName(_variants(_fixed(spark, [(UNKNOWN, t) for t in OTHERWISE])).select("words"))
    plain = plain.select(F.lit(UNKNOWN).alias("family"), _grams(F.col("words")).alias("grams"))
    half = F.pmod(F.xxhash64(F.concat_ws(" ", "grams")), F.lit(2))
    rows = vectorizer.transform(written(licence.unionByName(plain.filter(half == 0)).coalesce(2), "training"))
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    regression = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(index.transform(rows))
    families = list(index.labels)
    model = Model(vectorizer, regression, families, anchors, grams, [(f, t) for f, t in TEMPLATES], LEAST)
    odds = _odds(plain.filter(half == 1), model)
    top = odds.agg(F.percentile_approx("best.p", 1 - FALSE_RATE, 100_000)).first()[0]
    model.least = max(LEAST, top or 0.0)
    return model


def _odds(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(grams)`` with ``best``: probability and name of the most likely family."""
    scored = model.regression.transform(model.vectorizer.transform(rows)).withColumn("p", vector_to_array("probability"))
    pairs = [F.struct(F.col("p")[i].alias("p"), F.lit(f).alias("family")) for i, f in enumerate(model.families) if f != UNKNOWN]
    return scored.withColumn("best", F.array_max(F.array(*pairs))).drop("p", "features", "rawPrediction", "probability", "prediction")


def _best(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(grams)`` with ``best``, with ``t``: how much of the best template of its family is held, and how much of
    it ``rest`` holds where there is such a column, and with ``sure``: whether that confirms the family."""
    rows, held = _odds(rows, model), []
    for n, ((family, _), own) in enumerate(zip(model.templates, _features(model.templates, model.grams))):
        share = lambda c: F.size(F.array_intersect(c, F.lit(own))) / len(own) if own else F.lit(0.0)  # noqa: B023, E731
        of = F.col("best.family") == family
        rest = F.when(of, share("rest")) if "rest" in rows.columns else F.lit(None).cast("double")
        held.append(F.struct(F.when(of, share("grams")).otherwise(-1.0).alias("held"), F.lit(-n).alias("n"), rest.alias("rest")))
    rows = rows.withColumn("t", F.array_max(F.array(*held)))
    return rows.withColumn("sure", (F.col("best.p") >= model.least) & (F.col("t.held") >= CONFIRM))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, family, probability, template, held)`` for each paragraph with a licence word, a wrapped
    statement at the line where it begins.

    ``family`` is ``unknown`` where the probability or the share ``held`` of the best template of the
    family is too low.  Null and empty texts and texts without a licence word give no row.
    Repeated rows give a row each; null ids are returned as null; an empty table gives no rows;
    other columns are ignored.
    """
    rows = wrapped(docs, model.anchors, id_col, text_col)
    rows = _best(rows.withColumn("grams", _grams(F.col("words"))), model)
    # what is no statement by itself may be the beginning of one; the rest alone must hold less of it
    rows = rows.withColumn("one", F.col("best")).withColumn("one_t", F.col("t")).withColumn("one_sure", F.col("sure"))
    rows = rows.withColumn("grams", F.when(F.col("sure"), F.col("grams")).otherwise(_grams(F.concat("words", "more")))).drop("best", "t", "sure")
    rows = _best(rows.withColumn("rest", _grams(F.col("more"))), model)
    begins = F.col("sure") & ~F.col("one_sure") & (F.col("t.held") > F.col("t.rest"))
    best, t = F.when(begins, F.col("best")).otherwise(F.col("one")), F.when(begins, F.col("t")).otherwise(F.col("one_t"))
    return rows.select("doc_id", "paragraph", F.when(begins | F.col("one_sure"), best["family"]).otherwise(UNKNOWN).alias("family"),
                       best["p"].alias("probability"), (-t["n"]).alias("template"), t["held"].alias("held"))
