"""License scans with Spark's own functions and models: a trained paragraph classifier, confirmed by templates.

Texts are split into the sentences of their blocks, which blank lines part and in which lines run on, since licences come
wrapped and in comments; lines that are no such sentence, as headings, are read beside them. A multinomial logistic regression over hashed word
unigrams and bigrams names the licence family of each, or ``unknown``. It is trained on the families' templates, each also
with every single word left out, against all paragraphs of all documents that might be scored but have no word of such
statements. Half of them, by their words' hash, are trained on, equal ones as one row with their number as its weight. Unknown is
calibrated on the other half: a family needs a probability that at most ``FALSE_RATE`` of those paragraphs reach. A prediction is confirmed if the paragraph has ``CONFIRM`` of the word pairs
of one of the family's templates. What can't be confirmed, having none of the words without which no template reaches
that share, isn't scored.

Everything is DataFrame functions and transformers inside the JVM.

Defined cases: null and empty texts have no paragraph; paragraphs of fewer than ``LEAST_WORDS`` words are unknown; a statement that is a line inside a longer sentence may be given for both; a table
without negatives trains on the built-in ones; repeated rows are scanned each; an empty table gives no row; other columns,
such as a ``family`` of the input, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm.common import save

UNKNOWN = "unknown"
FEATURES = 1 << 12
LEAST_WORDS = 2
FALSE_RATE = 0.001
#: Steps of probability in which the paragraphs that reach it are counted.
STEPS = 10_000
#: Weight of all unknown paragraphs together in training, however many there are.
UNKNOWN_WEIGHT = 3000.0
CONFIRM = 0.6
ITERATIONS = 20

# Wordings by which licences are commonly stated, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        "License: MIT",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL, version 3.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "No part of this work may be reproduced without prior written permission of the publisher.",
    ),
}

#: Prose that speaks of licences, rights and versions without stating any.
PROSE = (
    "The driver showed a licence to the officer.",
    "She has the right to vote and the right to work.",
    "A new version of the report was released under pressure from the public.",
    "The general told the public that the work is under way.",
    "Permission to leave was granted to every person in the room.",
    "This is a copy of the letter that was sent to the foundation.",
    "The table was reserved for eight people.",
    "The library is open to the public and free of charge.",
    "All seats in the hall are reserved for members.",
    "He works under the terms of an older contract.",
)

#: A paragraph of the sample that has one of these may state a licence and isn't taken as one that doesn't.
STATING = "(?i)licen[cs]e|copyright|rights reserved|public domain|redistribut|permission|creative commons|CC BY"


#: White space after a full stop, and a blank line or a line's end; each begins with what is rarest to look for.
BETWEEN_SENTENCES = r"\s(?:(?<=\n)[ \t\r]*\n|(?<=[.!?]\s)\s*)"
BETWEEN_LINES = r"\s(?:(?<=\n)|(?<=[.!?]\s)\s*)"
#: Marks of comments at the start of a line.
COMMENT = r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--|;+|<!--)[ \t]?"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(ws: Column) -> Column:
    """Neighbouring words."""
    return F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat_ws(" ", F.element_at(ws, i), F.element_at(ws, i + 1)))).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sentences of blocks, then the lines that are none of these; marks of comments at a line's start are left out.

    ``wanted`` says of a text, and of each paragraph, whether it is read at all; it doesn't change the numbers.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("plain"))
    own = own.filter(wanted(F.col("plain"))) if wanted else own
    # A column for each step, as each is used more than once in the next; the outer form adds no filter that repeats them.
    plain = own.select("doc_id", F.regexp_replace("plain", COMMENT, "").alias("plain"))
    split = plain.select("doc_id", F.split("plain", BETWEEN_SENTENCES).alias("sentences"), F.split("plain", BETWEEN_LINES).alias("lines"))
    cut = split.select("doc_id", F.concat("sentences", F.array_except("lines", "sentences")).alias("cut"))
    rows = cut.select("doc_id", F.posexplode_outer("cut").alias("paragraph", "wording"))
    rows = rows.filter(wanted(F.col("wording"))) if wanted else rows
    return rows.withColumn("words", words(F.col("wording"))).filter(F.size("words") >= LEAST_WORDS)


def telling_words() -> list[str]:
    """Words of which every paragraph that can be confirmed has one.

    Of each template the longest words, until what is left of its word pairs without them is below ``CONFIRM``: a
    paragraph with none of these words can't reach that share of any template.
    """
    chosen: set[str] = set()
    for template in (t for texts in TEMPLATES.values() for t in texts):
        ws = [w for w in re.split(r"[\W_]+", template.lower()) if w]
        neighbours = set(zip(ws, ws[1:]))
        for word in sorted(set(ws), key=lambda w: (w not in chosen, -len(w), w)):
            if sum(not chosen & set(pair) for pair in neighbours) < CONFIRM * len(neighbours):
                break
            chosen.add(word)
    return sorted(chosen)


def may_state(text: Column) -> Column:
    """Whether a text has one of the telling words: else no paragraph of it can be confirmed."""
    by_letter = [f"{letter}(?:" + "|".join(w[1:] for w in ws) + ")" for letter, ws in groupby(telling_words(), key=lambda w: w[0])]
    return F.concat(F.lit(" "), F.lower(text)).rlike(r"[^\p{L}\p{N}](?:" + "|".join(by_letter) + r")(?![\p{L}\p{N}])")


def _hashed(rows: DataFrame) -> DataFrame:
    terms = rows.withColumn("terms", F.concat("words", pairs(F.col("words"))))
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True).transform(terms)


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(family, text) for family, texts in TEMPLATES.items() for text in texts], "family string, wording string")
    return rows.withColumn("words", words(F.col("wording")))


@dataclass
class Scanner:
    """The model, its classes in order, and the probability that a family needs."""

    model: LogisticRegressionModel
    classes: list[str]
    needed: float


def _probabilities(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """``rows`` with each class's probability, worked out once however often it is used (a generator is not repeated)."""
    scored = model.transform(_hashed(rows))
    return scored.select(*rows.columns, F.explode(F.array(vector_to_array("probability"))).alias("probabilities"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    spark = docs.sparkSession
    templates = _templates(spark)
    left_out = templates.filter(F.size("words") > 3).select(
        "family", "wording", F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.concat(F.slice("words", 1, i - 1), F.slice("words", i + 1, F.size("words"))))).alias("words")
    )
    # What one family's template becomes without a word may be another's: it isn't taken for the first.
    left_out = left_out.join(templates.select("words"), "words", "left_anti")
    stated = templates.select("family", "words").unionByName(left_out.select("family", "words"))
    every = paragraphs(docs, id_col, text_col, may_state).filter(~F.col("wording").rlike(STATING))
    counted = every.groupBy("words").agg(F.count("*").alias("n")).withColumn("fit", F.xxhash64("words") % 2 == 0)
    prose = spark.createDataFrame([(t,) for t in PROSE], "wording string").select(words(F.col("wording")).alias("words"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("fit"))
    negatives = save(counted.unionByName(prose), "negatives")
    number_fit = negatives.filter("fit").agg(F.sum("n")).first()[0]
    classes = [UNKNOWN, *TEMPLATES]
    number = F.coalesce(*[F.when(F.col("family") == c, F.lit(float(i))) for i, c in enumerate(classes)])
    rows = stated.withColumn("weight", F.lit(4.0)).unionByName(negatives.filter("fit").select(F.lit(UNKNOWN).alias("family"), "words", (F.col("n") * min(1.0, UNKNOWN_WEIGHT / number_fit)).alias("weight")))
    regression = LogisticRegression(family="multinomial", maxIter=ITERATIONS, regParam=0.0005, weightCol="weight")
    fitted = regression.fit(_hashed(rows.withColumn("label", number)).select("features", "label", "weight"))
    fitted = fitted.setRawPredictionCol("").setPredictionCol("")  # else Spark works the same sums out for each column
    reached = _probabilities(fitted, negatives.filter("not fit")).select("n", F.ceil(F.array_max(F.slice("probabilities", 2, len(classes))) * STEPS).alias("p"))
    return Scanner(fitted, classes, max(0.5, least_reached({r.p: r.n for r in reached.groupBy("p").agg(F.sum("n").alias("n")).collect()})))


def least_reached(counts: dict[int, int]) -> float:
    """The least probability that at most ``FALSE_RATE`` of the paragraphs exceed; ``counts`` has how many there are at each of ``STEPS``."""
    above, needed = FALSE_RATE * sum(counts.values()), 0
    for step in sorted(counts, reverse=True):
        above -= counts[step]
        needed = step
        if above < 0:
            break
    return needed / STEPS


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph that states a licence: document, paragraph number, family, probability and likeness."""
    spark = docs.sparkSession
    rows = _probabilities(scanner.model, paragraphs(docs, id_col, text_col, may_state)).withColumn("probability", F.array_max("probabilities"))
    family = F.element_at(F.array(*[F.lit(c) for c in scanner.classes]), F.array_position("probabilities", F.col("probability")).cast("int"))
    found = rows.filter(F.col("probability") >= scanner.needed).withColumn("family", family).filter(F.col("family") != UNKNOWN)
    templates = _templates(spark).select("family", pairs(F.col("words")).alias("pairs")).groupBy("family").agg(F.collect_list("pairs").alias("templates"))
    own = pairs(F.col("words"))
    shares = F.transform("templates", lambda one: F.size(F.array_intersect(own, one)) / F.size(F.array_distinct(one)))
    compared = found.join(F.broadcast(templates), "family").withColumn("likeness", F.array_max(shares))
    return compared.filter(F.col("likeness") >= CONFIRM).select("doc_id", "paragraph", "family", "probability", "likeness", "wording")
