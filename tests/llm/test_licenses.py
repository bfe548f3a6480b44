import math

import numpy as np
import pytest

from cellwise.llm import licenses
from helpers import awkward_documents, frame, sentence

SETTINGS = licenses.Settings(plain=50, iterations=40)


@pytest.fixture(scope="module")
def case(spark):
    import random

    rng = random.Random(2)
    rows = [r for r in awkward_documents() if r[0] != 50]
    rows += [
        (100, f"{sentence(rng, 20)}\nReleased under the MIT License.\n{sentence(rng, 20)}"),
        (101, "This work is licensed under the GNU General Public License, version 3."),
        (102, "Licensed under CC BY-NC 4.0.\r\nLicensed under the Apache License, Version 2.0."),
        (103, "LICENSED UNDER THE BSD 3-CLAUSE LICENSE"),
        (104, "The license plate of the Apache helicopter says version 2.0"),
        (105, "You need a license to drive under the bridge."),
        (106, "Licensed under the Unheard-of License, version 9."),
        (107, sentence(rng, 200) + "\n" + sentence(rng, 5)),
        (108, "Licensed under CC BY 4.0."),
        (109, "Licensed under the Mozilla Public License, version 2.0."),
        (110, "Released under the MIT License.\n" * 3),
    ]
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark, SETTINGS)


def test_families(spark, case, model):
    found = licenses.documents_with(frame(spark, case), SETTINGS, model).collect()
    assert len(found) == len(case)
    by = {r.doc_id: (r.families, r.notices) for r in found}
    want = {100: ("MIT", 1), 101: ("GPL-3.0", 1), 102: ("Apache-2.0,CC-BY-NC-4.0", 2), 103: ("BSD-3-Clause", 1), 108: ("CC-BY-4.0", 1), 109: ("MPL-2.0", 1), 110: ("MIT", 3)}
    assert by == {i: want.get(i, ("", 0)) for i, _ in case}


def test_scores_are_those_of_the_model(spark, case, model):
    """The join over weights gives what the model's formula gives on whole paragraphs."""
    docs = frame(spark, case)
    weights = {r.gram: np.array(r.w) for r in model.weights.collect()}
    texts = licenses.paragraphs(docs.filter("doc_id >= 100")).withColumn("tokens", licenses.words("paragraph"))
    scored = licenses.logits(texts.withColumn("grams", licenses.ngrams("tokens", SETTINGS.grams)), model, ["doc_id", "at", "tokens"]).collect()
    assert scored
    for r in scored:
        grams = {" ".join(r.tokens[k : k + n]) for n in SETTINGS.grams for k in range(len(r.tokens) - n + 1)}
        want = np.array(model.intercepts) + sum((weights[g] for g in grams if g in weights), np.zeros(len(model.classes)))
        assert np.allclose(r.z, want)
    assert np.argmax(model.intercepts) == 0  # without n-grams: unknown
    assert all(any(w in model.words for w in g.split(" ")) for g in weights)
    assert 0.2 < model.temperature < 10 and not math.isnan(model.temperature)


def test_held_out_accuracy(spark, model):
    rows = licenses.training(spark, SETTINGS).filter("fold = 0 AND size(tokens) > 0").collect()
    texts = [(k, " ".join(r.tokens), r.family) for k, r in enumerate(rows)]
    found = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string"), SETTINGS, model).collect()}
    right = [found.get(k, licenses.UNKNOWN) == f for k, _, f in texts]
    assert np.mean(right) > 0.9


def test_empty_table(spark, model):
    assert licenses.documents_with(frame(spark, []).limit(0), SETTINGS, model).count() == 0
    assert licenses.documents_with(frame(spark, []).limit(0), licenses.Settings(plain=5, iterations=3)).count() == 0


def test_no_python_in_the_plan(spark, case, model):
    plan = licenses.documents_with(frame(spark, case), SETTINGS, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_wrapped_notices(spark, model):
    """Notices over several lines, in comments and beside text, and two wrapped ones in one run."""
    import textwrap

    mit, bsd, gpl = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["BSD-3-Clause"][1], licenses.TEMPLATES["GPL-3.0"][1]
    wrapped = {k: "\n".join(textwrap.wrap(t, w)) for k, t, w in (("mit", mit, 80), ("bsd", bsd, 60), ("gpl", gpl, 72))}
    narrow = "\n".join(mit.split(" "))
    rows = [
        (1, wrapped["mit"]),
        (2, "import os\n# " + wrapped["bsd"].replace("\n", "\n# ") + "\nriver stone light\n\nmore"),
        (3, wrapped["gpl"].replace("\n", "\r\n")),
        (4, wrapped["mit"] + "\n" + wrapped["bsd"]),
        (5, "Released under the\nMIT License.\n\nReleased under the MIT License."),
        (6, narrow),
        (7, wrapped["mit"].replace("\n", "\n\n")),  # blank lines end a paragraph
        (8, None),
        (9, f"{wrapped['mit']}\n{wrapped['mit']}"),
        (10, f"Released under the MIT License.\n{wrapped['mit']}"),
    ]
    found = {r.doc_id: (r.families, r.notices) for r in licenses.documents_with(frame(spark, rows), SETTINGS, model).collect()}
    assert found == {1: ("MIT", 1), 2: ("BSD-3-Clause", 1), 3: ("GPL-3.0", 1), 4: ("BSD-3-Clause,MIT", 2), 5: ("MIT", 2), 6: ("MIT", 1), 7: ("", 0), 8: ("", 0), 9: ("MIT", 2), 10: ("MIT", 2)}


def test_other_licences_and_versions_are_unknown(spark, model):
    header = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    others = [
        *licenses.OTHERS, header.format("", "2"), header.format("Lesser ", "3"), header.format("Affero ", "3"), "Released under the License.",
        "This work is licensed under the GNU General Public License, version.", "Licensed under the Apache License, Version 1.0.", "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under the Apache License, Version.", "This software is licensed under the GNU General Public License, version.", "Licensed under CC BY 3.0.", "Licensed under the BSD 4-Clause License.",
    ]
    known = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts] + [("GPL-3.0", header.format("", "3"))]
    known.append(("Apache-2.0,GPL-3.0", licenses.TEMPLATES["GPL-3.0"][1] + "\nLicensed under the Apache License, Version 2.0."))
    known.append(("CC-BY-4.0,CC-BY-NC-4.0", "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0."))
    rows = [(k, t) for k, t in enumerate(others)] + [(1000 + k, t) for k, (_, t) in enumerate(known)]
    found = {r.doc_id: r.families for r in licenses.documents_with(frame(spark, rows), SETTINGS, model).collect()}
    assert {t: found[k] for k, t in enumerate(others) if found[k]} == {}
    assert [(found[1000 + k], t) for k, (_, t) in enumerate(known)] == known


def test_plain_rows_are_dealt_over_the_folds(spark):
    plain = licenses.training(spark, SETTINGS).filter("size(tokens) = 0").groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in plain) == [(k, 10) for k in range(5)]
