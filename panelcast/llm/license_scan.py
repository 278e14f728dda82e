"""Licence scan: a trained passage classifier, checked against licence templates.

A document is cut into passages (lines, and sentences of long lines); a passage of more than ``WINDOW`` characters is
read in windows that overlap by ``OVERLAP``, all of them, so no row holds more words than a window.  A sparse multinomial
logistic regression over word uni- and bigrams gives each window a licence family, *another licence* or none; a first
stage on words alone, with a low bar, spares most windows the bigrams.  Both are trained on the templates below, whole and
in part, on written licences outside the families, and against passages of the corpus without licence words (a
sample of at most ``NEGATIVES``), the same passages with licence words put in, and written near misses.

Two bars are calibrated on rows held out from training.  A window is reported if its probability of being any licence reaches
that of nearly all held-out negatives *with* licence words.  A family is named if its own probability reaches that of
nearly all held-out licences outside the families, and it is confirmed when enough of a template's words, in order of pairs, and
all its version numbers stand in the window.  Every other reported passage is ``unknown``.  Of a passage's windows the likeliest counts.

Only DataFrame and JVM functions.  Defined cases: null and empty texts have no passage; very long texts and passages are
read whole, window by window; a null ``doc_id`` is reported as null; repeated rows are reported once; families of equal
probability go to the first in order of name, templates of equal similarity count alike; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import text_key
from panelcast.sources.staging import stage

NONE, UNKNOWN = "none", "unknown"
NEGATIVES = 3000
#: Share of held-out negatives that may pass as a family.
FALSE_SHARE = 0.001
LEAST_PROBABILITY = 0.5
#: Greatest probability of any licence, from words alone, with which a window goes on to the full classifier; it is lowered
#: until it misses no more than this share of the written licences.
PASSED_ON, MISSED = 0.02, 0.002
CONFIRMED = 0.6
MOST_BAR = 0.95
#: Characters of a window, and those it shares with the next one.
WINDOW, OVERLAP = 1600, 400

# Short forms and key sentences of public licence texts.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", "SPDX-License-Identifier: GPL-2.0-only",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": (
        "Licensed under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "CC0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is marked with CC0 1.0 Universal."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher."),
}
# Sentences with licence words that grant nothing.
NEAR_MISSES = (
    "The driver had to show his license at the border.", "She studied physics at MIT before she moved to Boston.", "The Apache people lived in the southwest of the country.",
    "A poetic license lets the author bend the facts.", "The general public was invited to the opening of the library.", "He reserved a table for all of us.",
    "Human rights are reserved for no one.", "The fishing licence costs twenty pounds a year.", "Version 2.0 of the report will be published in spring.", "A copyright lawsuit was settled out of court.",
    "The conditions of the contract were met.", "The public domain of the city is being rebuilt.", "Attribution theory explains how people judge causes.", "Free software events take place every week.",
    "The store lost its liquor license last year.", "Commons are shared resources of a community.", "All rights and duties of members are listed below.", "Released in May, the film was a success.",
)
# Licences outside the families; every third is held out for calibration.
OTHER_LICENCES = (
    "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: Artistic-2.0", "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: WTFPL", "Licensed under the European Union Public Licence 1.2.", "This file is under the zlib license.", "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Artistic License 2.0.", "Released under the Eclipse Public License.", "Licensed under the terms of the OpenSSL license.", "This font is licensed under the SIL Open Font License.",
    "Use of this source code is governed by a license that can be found in the LICENSE file.", "See the LICENSE file for details.", "Licensed under the GNU GPL.", "Licensed under the GNU General Public License.",
    "This program is free software under the GNU license.", "Licensed under a Creative Commons license.", "Available under a Creative Commons Attribution-NonCommercial-ShareAlike licence.",
    "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Dieses Werk steht unter einer freien Lizenz.", "Veröffentlicht unter der Lizenz des Herstellers.",
    "You may redistribute this software under the terms of its license.", "Permission to copy and distribute verbatim copies of this document is granted.", "This software is licensed, not sold.",
)
# Words put into passages that grant nothing.
MIXED_IN = ("license", "copyright", "permission", "reserved", "gnu", "mit", "apache", "commons", "warranty", "public domain", "licence", "conditions", "version 2.0", "cc")
LICENCE_WORDS = r"licen[cs]|copyright|reserved|\bgnu\b|\bgpl\b|apache|\bmit\b|creative commons|\bcc\b|\bcc0\b|public domain|permission|redistribut|spdx|mozilla|warrant|lizenz|vorbehalten|réservés|reservados"


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def grams_of(words: Column) -> Column:
    """Uni- and bigrams of a passage."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, passage (number from 0), text of every window of every passage."""
    cut = F.split("text", r"\n+|(?<=[.!?;]) +(?=\p{Lu})")
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.posexplode(cut).alias("passage", "text"))
    return windows(rows.where(F.col("text") != ""))


def windows(rows: DataFrame) -> DataFrame:
    """Long texts in overlapping windows, cut at white space where there is any; columns unchanged."""
    text = F.col("text")
    pieces = F.when(F.length(text) <= WINDOW, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{WINDOW}}}(?!\S)|\S{{1,{WINDOW}}}"), F.lit(0)))
    rows = rows.withColumn("text", pieces)
    piece = F.col("text")
    overlapping = F.transform(piece, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(piece, i + 1), F.lit("")), 1, OVERLAP)))
    return rows.withColumn("text", F.explode(overlapping))


@dataclass
class Stage:
    vectors: CountVectorizerModel
    regression: LogisticRegressionModel


@dataclass
class Model:
    families: list[str]  # unknown and none are the last
    first: Stage  # on words: cheap, passes on whatever may be a licence
    second: Stage  # on words and pairs of words
    threshold: float  # probability with which a family is named
    bar: float = LEAST_PROBABILITY  # probability of any licence with which a window is reported
    passed_on: float = 0.0  # the same from words alone, with which it goes on to the second stage


def parts_of(sentence: str) -> list[str]:
    """A template whole, and long ones in halves, which is how line breaks cut them."""
    words = sentence.split()
    half = len(words) // 2
    return [sentence] if len(words) < 12 else [sentence, " ".join(words[:half]), " ".join(words[half:])]


def training_rows(spark: SparkSession, docs: DataFrame, negatives: int) -> DataFrame:
    """label, text, held_out; the corpus part are at most ``negatives`` passages, drawn by a hash of documents, then of texts."""
    own = [(family, part, False) for family, texts in TEMPLATES.items() for t in texts for part in parts_of(t)] * 3
    other = [(UNKNOWN, t, k % 3 == 2) for k, t in enumerate(OTHER_LICENCES) for _ in range(3)]
    near = [(NONE, t, k % 3 == 2) for k, t in enumerate(NEAR_MISSES) for _ in range(3)]
    share = min(1.0, negatives / max(1, docs.count()))  # a passage a document at least, then the bound by hash
    drawn = F.pmod(F.xxhash64(F.lit("licence"), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    corpus = passages(docs.where(drawn)).where(~F.col("text").rlike(f"(?i){LICENCE_WORDS}")).select("text").distinct()
    corpus = corpus.orderBy(F.xxhash64("text"), "text").limit(negatives)
    by = F.pmod(F.xxhash64(F.lit("mix"), "text"), F.lit(len(MIXED_IN))).cast("int")
    half = F.floor(F.length("text") / 2).cast("int")
    mixed = F.concat(F.substring("text", F.lit(1), half), F.lit(" "), F.element_at(F.array(*map(F.lit, MIXED_IN)), by + 1), F.lit(" "), F.substring(F.col("text"), half + 1, F.lit(WINDOW)))
    held = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    corpus = corpus.select(F.explode(F.array(F.struct("text", held.alias("held_out")), F.struct(mixed.alias("text"), held.alias("held_out")))).alias("row")).select(F.lit(NONE).alias("label"), "row.*")
    written = spark.createDataFrame([(k, *r) for k, r in enumerate(own + other + near)], "k int, label string, text string, held_out boolean")
    # licences also stand between other words: every written row once more inside a passage of the corpus
    slot = F.pmod(F.xxhash64(F.lit("around"), "text"), F.lit(len(own + other + near))).cast("int")
    around = corpus.where(~F.col("text").rlike(f"(?i){LICENCE_WORDS}")).select(slot.alias("k"), F.col("text").alias("outer")).groupBy("k").agg(F.min("outer").alias("outer"))
    inside = written.where(F.col("label") != NONE).join(around, "k")
    middle = F.floor(F.length("outer") / 2).cast("int")
    inside = inside.select("label", F.concat(F.substring("outer", F.lit(1), middle), F.lit(" "), "text", F.lit(" "), F.substring(F.col("outer"), middle + 1, F.lit(WINDOW))).alias("text"), "held_out")
    return written.drop("k").unionByName(inside).unionByName(corpus)


def fit(docs: DataFrame, negatives: int = NEGATIVES) -> Model:
    """Action, stages: train and calibrate."""
    spark = docs.sparkSession
    families = [*sorted(TEMPLATES), UNKNOWN, NONE]
    index = F.array_position(F.array(*map(F.lit, families)), F.col("label")) - 1
    text = words_of(F.col("text"))
    rows = stage(training_rows(spark, docs, negatives).select(index.cast("double").alias("label"), "text", text.alias("words"), grams_of(text).alias("grams"), "held_out").coalesce(4))
    # the vocabulary is that of the licences: other words say nothing about them
    written = rows.where(F.col("label") < len(families) - 1)
    vectors = {c: CountVectorizer(inputCol=c, outputCol="features", binary=True, minDF=1).fit(written) for c in ("words", "grams")}

    def trained(column: str, learned: DataFrame) -> Stage:
        trainer = LogisticRegression(maxIter=60, regParam=1e-5, elasticNetParam=0.5, family="multinomial", standardization=False)
        return Stage(vectors[column], trainer.fit(vectors[column].transform(learned)))

    # the bars come from a classifier that has not seen the held-out rows, the final one learns from all
    probe = trained("grams", rows.where("NOT held_out"))
    stages = [trained("words", rows), trained("grams", rows)]
    model = Model(families, *stages, LEAST_PROBABILITY)
    held = classify(rows.where("held_out").select("label", "grams"), probe, families)
    none, other = F.col("label") == len(families) - 1, F.col("label") == len(families) - 2
    named = F.when(F.col("family") != UNKNOWN, F.col("probability")).otherwise(0.0)
    accuracy = F.lit(10_000)
    r = held.agg(
        F.percentile_approx(F.when(none, F.col("licence")), F.lit(1 - FALSE_SHARE), accuracy).alias("bar"),
        F.percentile_approx(F.when(none | other, named), F.lit(1 - FALSE_SHARE), accuracy).alias("threshold"),
    ).first()
    licences = classify(written.select("words"), model.first, families)
    least = licences.agg(F.percentile_approx("licence", F.lit(MISSED), accuracy)).first()[0]
    model.passed_on = min(PASSED_ON, float(least if least is not None else PASSED_ON))
    # a bar above nearly sure would report nothing but the templates themselves
    model.bar, model.threshold = (min(max(LEAST_PROBABILITY, float(x or 0.0)), MOST_BAR) for x in (r.bar, r.threshold))
    return model


def classify(rows: DataFrame, by: Stage, families: list[str]) -> DataFrame:
    """``rows`` and family (``unknown``: a licence outside them), its probability, and that of being any licence."""
    n = len(families) - 1
    scored = by.regression.transform(by.vectors.transform(rows)).select(*rows.columns, vector_to_array("probability").alias("_p"))
    scored = scored.withColumn("_p", F.struct(F.slice("_p", 1, n).alias("of"), F.element_at("_p", n + 1).alias("none")))
    best = F.array_max("_p.of")
    family = F.element_at(F.array(*map(F.lit, families)), F.array_position("_p.of", best).cast("int"))
    row = F.struct(family.alias("family"), best.alias("probability"), (1 - F.col("_p.none")).alias("licence"))
    # generated columns: a filter on them is not copied below, where it would classify every row once more
    return scored.select(*rows.columns, F.inline(F.array(row)))


def template_pairs(spark: SparkSession) -> DataFrame:
    """Pairs of words of every template part and its version numbers."""
    rows = [(family, i, part) for family, texts in TEMPLATES.items() for i, part in enumerate(p for t in texts for p in parts_of(t))]
    words = words_of(F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")))
    pairs = F.array_distinct(F.filter(grams_of(words), lambda g: g.contains(" ")))
    numbers = F.array_distinct(F.filter(words, lambda w: w.rlike(r"^v?\d+$")))
    return spark.createDataFrame(rows, "family string, template int, text string").select("family", "template", pairs.alias("pairs"), numbers.alias("numbers"))


def likely(rows: DataFrame, model: Model) -> DataFrame:
    """Windows that are licences by both stages: columns of ``rows`` and family, probability, licence."""
    words = rows.withColumn("words", words_of(F.col("text")))
    maybe = classify(words, model.first, model.families).where(F.col("licence") >= model.passed_on).select(*rows.columns, "words")
    grams = maybe.select(*rows.columns, grams_of(F.col("words")).alias("grams"))
    return classify(grams, model.second, model.families).where(F.col("licence") >= model.bar).drop("grams")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Action, stages: doc_id, passage, family (or ``unknown``), predicted, probability, similarity of licence passages."""
    spark = docs.sparkSession
    model = model or fit(docs)
    keys = ["doc_id", "text_key", "passage"]
    found = stage(likely(passages(docs), model))
    words = words_of(F.col("text"))
    found = found.withColumns({"words": words, "grams": grams_of(words)})
    templates = F.broadcast(template_pairs(spark))  # a declared list
    whole = F.size(F.array_except("numbers", "words")) == 0
    # a version may be glued to its letter ("v3")
    shared = F.when(whole, F.size(F.array_intersect("grams", "pairs")) / F.size("pairs")).otherwise(0.0)
    compared = found.join(templates, "family", "left").groupBy(*keys, "family", "probability", "licence", "text").agg(F.coalesce(F.max(shared), F.lit(0.0)).alias("similarity"))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold) & (F.col("similarity") >= CONFIRMED)
    judged = compared.withColumn("sure", sure)
    first = F.struct("sure", "licence", "probability", "similarity", "family", "text")
    best = judged.groupBy(*keys).agg(F.max(first).alias("best")).select("doc_id", "passage", "best.*")
    family = F.when(F.col("sure"), F.col("family")).otherwise(UNKNOWN)
    return best.select("doc_id", "passage", family.alias("family"), F.col("family").alias("predicted"), "probability", "similarity", "text")
