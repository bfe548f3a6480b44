"""Licence notices: a trained paragraph classifier, confirmed against templates.

Only DataFrame functions and Spark ML. Paragraphs become sets of word n-grams over a
vocabulary that the templates fix; a multinomial logistic regression gives each licence
family and the class ``unknown`` a probability, calibrated by a temperature. A predicted
family counts only if the paragraph also holds most of the words of one of its templates and
those that tell it from other licences and versions (DECIDING).

Paragraphs are single lines, and stretches of words over several lines of a run of non-blank
lines, as long as a template and a quarter more, so that wrapped notices are whole. As a
family counts only with most words of a template, paragraphs that hold no template's are
left out before n-grams are built, which changes no result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.common import freeze
from cellwise.session import broadcast_checked

UNKNOWN = "unknown"
#: Words after a paragraph in which another version may be named ("... as published by ..., either version 2").
AFTER = 16
WORD = r"[a-z0-9]+(?:[.\-]+[a-z0-9]+)*"

# Short notices by which works name their licence, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This file is distributed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the Apache License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
}
# Lines that use the words of licences without being a notice.
DECOYS = [
    "You need a driving license to rent this car.",
    "The license was revoked by the city after the inspection.",
    "Copyright law protects original works of authorship.",
    "All rights reserved.",
    "The software comes with a two year warranty.",
    "General public opinion on the matter is divided.",
    "The Apache people live in the Southwest.",
    "Students of MIT built a source of binary stars models.",
    "A copy of the document was obtained without restriction.",
    "The terms of use are subject to change without notice.",
    "Free software is a matter of liberty.",
    "Her work was published under the version of record.",
    "The conditions are met when both files are present.",
    "Creative people share their work in the commons room.",
]
# Notices of other licences and versions, trained as unknown.
OTHERS = [
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under the Apache License, Version 1.1.",
    "Licensed under the BSD 2-Clause License.",
    "Licensed under the Mozilla Public License, version 1.1.",
]


def _any(*alternatives: str) -> str:
    """A regex for one of ``alternatives``, each whole words of a text of words and blanks."""
    return rf"(?<!\S)(?:{'|'.join(alternatives)})(?!\S)"


_TWO = _any(r"(?:general public licen[cs]e|gpl|either) (?:v|version )2(?:\.0)?")
_THREE = _any("3", r"3\.0", "v3", r"v3\.0", "gplv3", r"gpl-v?3(?:\.0)?\S*")
_LESSER = _any("(?:lesser|library|affero) general", r"[al]gpl\S*")
_FOUR = _any(r"(?:\S*-)?v?4(?:\.0)?")
_NC, _SA, _ND = (_any(*x) for x in (
    (r"(?:\S+-)?nc(?:-\S+)?", r"(?:\S+-)?non-?commercial(?:-\S+)?", "non commercial"),
    (r"(?:\S+-)?sa(?:-\S+)?", r"(?:\S+-)?share-?alike(?:-\S+)?", "share alike"),
    (r"(?:\S+-)?nd(?:-\S+)?", r"(?:\S+-)?no-?deriv\S*", r"no deriv\S*"),
))
# By family, what the words of a paragraph must all match, and what they must not.
DECIDING = {
    "MIT": ([_any("mit", "charge", "granted")], []),
    "Apache-2.0": ([_any(r"apache\S*"), _any(r"(?:\S*-)?v?2(?:\.0)?", "compliance")], [_any(r"license,? (?:v|version )?1(?:\.[01])?", r"apache (?:v|version )?1(?:\.[01])?", r"apache-1\S*")]),
    "GPL-3.0": ([_any("general", r"gpl\S*"), f"(?:{_THREE}|{_any('redistribute', 'modify')})"], [_LESSER]),
    "BSD-3-Clause": ([_any(r"(?:bsd-)?3-clause", "redistribution", "permitted", "forms")], [_any(r"(?:bsd-)?[0124]-clause")]),
    "MPL-2.0": ([_any("mozilla", r"mpl\S*"), _any(r"(?:\S*-)?v?2(?:\.0)?")], []),
    "CC-BY-4.0": ([_any(r"(?:cc-)?by(?:-4\.0)?", "attribution"), _FOUR], [_NC, _SA, _ND]),
    "CC-BY-NC-4.0": ([_NC, _FOUR], [_SA, _ND]),
}
STOPWORDS = "a all and any are as by can each except for form forms free from has have hereby if in into is it its may met most must no not of on or other that the their they this to under use used using was were will with without you your following person provided".split()


@dataclass(frozen=True)
class Settings:
    grams: tuple[int, ...] = (1, 2, 3)
    ridge: float = 1e-3
    least: float = 0.5  # probability below which the class is unknown
    confirm: float = 0.8  # share of a template's words the paragraph must hold
    plain: int = 500  # training rows that stand for paragraphs without keywords
    iterations: int = 60


def _holds(template: str, tokens: str, settings: Settings) -> Column:
    """Whether a word array has the share of a template's words that confirms it."""
    return F.size(F.array_intersect(template, tokens)) >= settings.confirm * F.size(F.array_distinct(template))


def words(text: str | Column) -> Column:
    """Lower-case words of letters, digits, dots and hyphens inside them."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(WORD), F.lit(0))


def ngrams(tokens: str, sizes: tuple[int, ...]) -> Column:
    """Distinct n-grams of a word array."""

    def of(n: int) -> Column:
        count = F.size(tokens) - (n - 1)
        starts = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(tokens, k, n), " "))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def decided(family: str, tokens: str, context: str | None = None) -> Column:
    """Whether a word array has what tells ``family`` (a column) from other licences and
    versions. A GPL header names its version only in the words after it (``context``)."""
    said, around = F.array_join(tokens, " "), F.array_join(context or tokens, " ")
    second = around.rlike(_TWO) & ~around.rlike(_THREE)
    rules = F.lit(False)
    for name, (needs, bars) in DECIDING.items():
        rule = F.lit(True)
        for need in needs:
            rule &= said.rlike(need)
        for bar in bars:
            rule &= ~said.rlike(bar)
        rules = F.when(F.col(family) == name, rule & ~second if name == "GPL-3.0" else rule).otherwise(rules)
    return rules


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, f"{family}/{k}", text) for family, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template string, notice string").withColumn("tokens", words("notice"))


def _sizes() -> list[int]:
    """The number of distinct words of every template."""
    return [len(set(re.findall(WORD, text.lower()))) for texts in TEMPLATES.values() for text in texts]


def keywords(spark: SparkSession) -> list[str]:
    """The words of the templates and of other licences that are no stop words."""
    others = spark.createDataFrame([(t,) for t in OTHERS], "notice string").select(words("notice").alias("tokens"))
    rows = _templates(spark).select("tokens").unionByName(others).select(F.explode("tokens").alias("w")).filter(~F.col("w").isin(STOPWORDS)).distinct().orderBy("w").collect()
    return [r[0] for r in rows]


def training(spark: SparkSession, settings: Settings) -> DataFrame:
    """(family, tokens, fold): templates whole, with each word left out (unknown, if it was a
    deciding one) and inside other words, decoys, notices of other licences, and paragraphs
    without keywords. These have no n-gram, whatever they say, so rows without words stand
    for them, dealt over the folds by number."""
    whole = _templates(spark).select("family", "tokens")
    less = whole.withColumn("gone", F.explode(F.sequence(F.lit(1), F.size("tokens")))).select("family", F.expr("filter(tokens, (w, k) -> k + 1 <> gone)").alias("tokens"))
    less = less.withColumn("family", F.when(decided("family", "tokens"), F.col("family")).otherwise(UNKNOWN))
    decoys = spark.createDataFrame([(UNKNOWN, d) for d in DECOYS + OTHERS], "family string, notice string").select("family", words("notice").alias("tokens"))
    rest = decoys.withColumn("gone", F.explode(F.sequence(F.lit(1), F.size("tokens")))).select("family", F.expr("filter(tokens, (w, k) -> k + 1 <> gone)").alias("tokens"))
    inside = whole.select("family", F.concat(F.split(F.lit("notes about files here"), " "), "tokens", F.split(F.lit("see below"), " ")).alias("tokens"))
    rows = whole.unionByName(less).unionByName(decoys).unionByName(rest).unionByName(inside).withColumn("fold", F.pmod(F.xxhash64("family", "tokens"), F.lit(5)))
    plain = spark.range(settings.plain).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("tokens"), (F.col("id") % 5).alias("fold"))
    return rows.unionByName(plain).coalesce(1)


@dataclass(frozen=True)
class Model:
    """Weights as rows, so that scoring is a join."""

    classes: list[str]
    intercepts: list[float]
    weights: DataFrame  # gram, w (an array by class)
    temperature: float
    words: list[str]


def fit(spark: SparkSession, settings: Settings = Settings()) -> Model:
    """Train on four folds of a few hundred rows, set the temperature on the fifth."""
    known = keywords(spark)
    has_keyword = lambda g: F.exists(F.split(g, " "), lambda w: w.isin(known))
    rows = freeze(training(spark, settings).withColumn("grams", F.filter(ngrams("tokens", settings.grams), has_keyword)))
    others = spark.createDataFrame([(t,) for t in OTHERS], "notice string").select(words("notice").alias("tokens"))
    named = rows.filter(F.col("family") != UNKNOWN).select("grams").unionByName(others.select(F.filter(ngrams("tokens", settings.grams), has_keyword).alias("grams")))
    taken = named.select(F.explode("grams").alias("gram")).distinct().orderBy("gram").collect()
    vocabulary = [r[0] for r in taken]  # bounded by the templates and OTHERS
    classes = [UNKNOWN, *TEMPLATES]
    held = F.array(*[F.lit(g) for g in vocabulary])
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    vectors = rows.select(
        label.cast("double").alias("label"), "fold", "family", "grams",
        array_to_vector(F.transform(held, lambda g: F.array_contains("grams", g).cast("double"))).alias("features"),
    )
    weighted = freeze(vectors.drop("features")).groupBy("label").count()
    total = rows.count()
    shares = {r[0]: total / (len(classes) * r[1]) for r in weighted.collect()}
    weight = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in shares.items()])
    fitted = LogisticRegression(family="multinomial", regParam=settings.ridge, standardization=False, maxIter=settings.iterations, weightCol="weight").fit(vectors.withColumn("weight", weight).filter("fold <> 0"))
    matrix = fitted.coefficientMatrix.toArray()
    weights = spark.createDataFrame([(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(vocabulary)], "gram string, w array<double>")
    model = Model(classes, [float(x) for x in fitted.interceptVector], weights, 1.0, known)
    calibration = freeze(vectors.filter("fold = 0").select(F.monotonically_increasing_id().alias("doc_id"), F.lit(0).alias("at"), "grams", F.col("label").cast("int").alias("label")))
    scored = freeze(logits(calibration, model, ["doc_id", "at", "label"]))
    losses = []
    for step in range(-8, 13):
        t = 2.0 ** (step / 4)
        top = F.array_max("z")
        spread = _spread(top, t)
        losses.append((F.avg((top - F.element_at("z", F.col("label") + 1)) / t + F.log(spread))).alias(str(t)))
    found = scored.agg(*losses).first().asDict()
    usable_losses = {float(t): v for t, v in found.items() if v is not None}
    best = min(usable_losses, key=usable_losses.get) if usable_losses else 1.0
    return Model(classes, model.intercepts, weights, best, known)


def _spread(top: Column, temperature: float) -> Column:
    """The sum of a softmax over z against its largest entry."""
    return F.aggregate(F.transform("z", lambda z: F.exp((z - top) / temperature)), F.lit(0.0), lambda acc, x: acc + x)


def logits(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` and z, the array of class scores, for rows with an array ``grams``."""
    sums = (
        rows.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(model.weights), "gram")
        .groupBy(*keys).agg(*[F.sum(F.element_at("w", k + 1)).alias(f"z{k}") for k in range(len(model.classes))])
    )
    z = [(F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + F.lit(b)).alias(f"z{k}") for k, b in enumerate(model.intercepts)]
    return rows.select(*keys).join(sums, keys, "left").select(*keys, F.array(*z).alias("z"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, at, paragraph): the lines of every text that are not blank."""
    lines = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split(F.col("text").cast("string"), r"\r\n|\r|\n")).alias("at", "paragraph"))
    return lines.filter(F.trim("paragraph") != "")


def runs(docs: DataFrame) -> DataFrame:
    """(row, doc_id, run, tokens, line_of) of every run of non-blank lines: its words in order
    and the line, from 0, of each word. ``row`` tells rows apart that share a doc_id."""
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.split(F.col("text").cast("string"), r"\r\n|\r|\n").alias("lines")).filter("lines IS NOT NULL")
    blanks = F.filter(F.transform("lines", lambda x, k: F.when(F.trim(x) == "", k)), lambda k: k.isNotNull())
    cut = lines.withColumn("cuts", F.concat(F.array(F.lit(-1)), blanks, F.array(F.size("lines"))))
    spans = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda c, k: F.struct((c + 1).alias("run"), F.slice("lines", c + 2, F.get("cuts", k + 1) - c - 1).alias("lines")))
    each = cut.select("row", "doc_id", F.explode(F.filter(spans, lambda r: F.size(r["lines"]) > 0)).alias("r")).select("row", "doc_id", "r.run", F.transform("r.lines", lambda x: words(x)).alias("by_line"))
    numbers = F.flatten(F.transform("by_line", lambda x, k: F.transform(x, lambda _: F.col("run") + k)))
    return each.select("row", "doc_id", "run", F.flatten("by_line").alias("tokens"), numbers.alias("line_of"))


def candidates(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row, doc_id, run, at, first, last, wrapped, tokens, context): lines and stretches over
    lines that hold most words of a template, and what follows them in the run; ``first`` and
    ``last`` are places in the run's words."""
    spark = docs.sparkSession
    texts = _templates(spark).select(F.col("tokens").alias("template"))
    known = [r[0] for r in texts.select(F.explode("template").alias("w")).distinct().orderBy("w").collect()]
    some = docs.withColumn("held", F.array_intersect(words(F.col("text").cast("string")), F.array(*[F.lit(w) for w in known])))
    enough = min(math.ceil(settings.confirm * n) for n in _sizes())
    found = runs(some.filter(F.size("held") >= enough).select("doc_id", "text"))
    held = found.withColumn("held", F.array_intersect("tokens", F.array(*[F.lit(w) for w in known])))
    met = freeze(held.join(F.broadcast(texts), _holds("template", "held", settings)).drop("held"))

    keys = ["row", "doc_id", "run"]
    each = met.select(*keys, "tokens", "line_of", "template", F.explode(F.array_distinct("line_of")).alias("at"))
    each = each.withColumn("first", F.array_position("line_of", F.col("at")).cast("int")).withColumn("n", F.size(F.filter("line_of", lambda x: x == F.col("at"))))
    each = each.withColumn("line", F.slice("tokens", F.col("first"), F.col("n"))).filter(_holds("template", "line", settings))
    lines = each.select(*keys, "at", "first", (F.col("first") + F.col("n") - 1).alias("last"), F.lit(False).alias("wrapped"), F.col("line").alias("tokens"), F.slice("tokens", F.col("first"), F.col("n") + AFTER).alias("context")).distinct()

    size = F.size("template")
    long = met.filter(F.element_at("line_of", -1) > F.element_at("line_of", 1)).withColumn("width", size)
    score = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda k: F.struct(k.alias("k"), F.size(F.array_intersect("template", F.slice("tokens", k, F.col("width")))).alias("n")))
    fits = F.filter(score, lambda x: x["n"] >= settings.confirm * F.size(F.array_distinct("template")))
    kept = lambda acc: F.get(acc, F.size(acc) - 1)
    apart = F.aggregate(  # of stretches that meet, the first with the most words of the template
        fits, F.array().cast("array<struct<k:int,n:int>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["k"] >= kept(acc)["k"] + F.col("width")), F.concat(acc, F.array(x)))
        .when(x["n"] > kept(acc)["n"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).otherwise(acc),
    )
    wide = long.withColumn("first", F.explode(F.transform(apart, lambda x: x["k"]))).withColumn("last", F.least(F.size("tokens"), F.col("first") + F.col("width") - 1))
    wide = wide.withColumn("at", F.get("line_of", F.col("first") - 1)).filter(F.get("line_of", F.col("last") - 1) > F.col("at"))
    stretches = wide.select(*keys, "at", "first", "last", F.lit(True).alias("wrapped"), F.slice("tokens", F.col("first"), F.ceil(F.col("width") * 1.25).cast("int")).alias("tokens"), F.slice("tokens", F.col("first"), F.col("width") + AFTER).alias("context")).distinct()
    return lines.unionByName(stretches)


def scan(docs: DataFrame, settings: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """(doc_id, at, family, probability, similarity) of every confirmed notice.

    Without a ``model`` one is trained first. ``at`` is the line, from 0, on which the paragraph
    begins. Equal paragraphs are scored once, however many documents hold them, and joined
    back. A stretch over lines counts where it shares no word with a notice of its family
    that was found on one line or began before it. Null and empty texts have no paragraph.
    """
    spark = docs.sparkSession
    model = model or fit(spark, settings)
    some = freeze(candidates(docs, settings))
    lines = some.select("tokens").distinct().withColumn("line", F.sha2(F.array_join("tokens", " "), 256)).withColumn("grams", ngrams("tokens", settings.grams))
    scored = logits(lines, model, ["line", "tokens"])
    top = F.array_max("z")
    spread = _spread(top, model.temperature)
    named = scored.withColumn("probability", 1 / spread).withColumn("family", F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("z", top).cast("int")))
    likely = named.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= settings.least))
    texts = F.broadcast(_templates(spark).select("family", F.array_distinct("tokens").alias("template")))
    compared = likely.join(texts, "family").withColumn("similarity", F.size(F.array_intersect("tokens", "template")) / F.size("template"))
    sure = compared.groupBy("line", "tokens", "family", "probability").agg(F.max("similarity").alias("similarity")).filter(F.col("similarity") >= settings.confirm)
    found = some.join(broadcast_checked(freeze(sure)), "tokens").filter(decided("family", "tokens", "context"))
    ordered = F.array_sort(F.collect_list(F.struct("wrapped", "first", "last", "at", "probability", "similarity")))
    together = found.groupBy("row", "doc_id", "run", "family").agg(ordered.alias("each"))
    alone = F.aggregate(
        "each", F.slice("each", 1, 0),
        lambda acc, x: F.when(x["wrapped"] & F.exists(acc, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return together.select("doc_id", "family", F.explode(alone).alias("x")).select("doc_id", "x.at", "family", "x.probability", "x.similarity")


def documents_with(docs: DataFrame, settings: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, families (sorted, joined by commas), notices, probability.

    Without notices: an empty string, 0 and null. Rows that repeat a doc_id share the result
    of all their texts. Other columns are ignored. An empty table gives an empty table.
    """
    found = scan(docs.select("doc_id", "text"), settings, model)
    each = found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count(F.lit(1)).alias("notices"), F.min("probability").alias("probability")
    )
    joined = docs.select(F.col("doc_id").cast("long")).join(broadcast_checked(freeze(each)), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("notices", F.lit(0)).cast("long").alias("notices"), F.round("probability", 6).alias("probability"))
