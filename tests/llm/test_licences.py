import pytest

from fleetstops.llm import licences as li


@pytest.fixture(scope="module")
def model(documents):
    return li.fit(documents)


def test_every_template_is_found(model):
    for family, templates in li.TEMPLATES.items():
        for t in templates:
            n, found = li.scan_text(model, f"Some prose before.\n{t}\nAnd after it.")
            assert n == 3 and [f["family"] for f in found if f["confirmed"]] == [family], t


def test_changed_and_surrounded_notices(model):
    for text, family in [
        ("RELEASED UNDER THE MIT LICENSE!", "mit"),
        ("Copyright 2020 Jo. Licensed under the Apache License, Version 2.0. See the file.", "apache"),
        ("word " * 500 + "This work is licensed under the GNU General Public License, version 3." + " word" * 500, "gpl"),
    ]:
        assert {f["family"] for f in li.scan_text(model, text)[1] if f["confirmed"]} == {family}


def test_other_sentences_are_unknown(model):
    for text in [*li.OTHERWISE, "The general public has no license.", "MIT", "permission"]:
        assert not [f for f in li.scan_text(model, text)[1] if f["confirmed"]], text


def test_passing_over_loses_nothing(model, documents):
    """Scoring every paragraph finds what scoring those with a signal word finds."""
    texts = [r.text for r in documents.collect()]
    fast = [li.scan_text(model, t) for t in texts]
    sure, model.sure = model.sure, False
    try:
        assert fast == [li.scan_text(model, t) for t in texts]
    finally:
        model.sure = sure
    assert sure


def test_probabilities_are_calibrated(model, documents):
    """Confidence on unseen variants is near accuracy."""
    lines = [r.text.split("\n")[0] for r in documents.limit(100).collect()]
    rows = [(f, w) for i, (f, w) in enumerate(li.examples(lines)) if li._draw(i) % 3 == 0]
    got = [(model.predict(w), f) for f, w in rows]
    confidence = sum(p for (_, p), _ in got) / len(got)
    accuracy = sum(g == f for (g, _), f in got) / len(got)
    assert accuracy > 0.9 and abs(confidence - accuracy) < 0.1


def test_rows(odd, none, model, spark):
    rows = li.scan(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(r.n_paragraphs == 0 and not r.found for r in rows if r.doc_id in (30, 31))
    assert li.scan(none, li.fit(none)).count() == 0
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License."), (1, "x\nReleased under the MIT License.")], "doc_id long, text string")
    assert [[f.start for f in r.found] for r in li.scan(docs, model).collect()] == [[2], [2]]


def test_query_finds_the_notices(spark):
    sf = "/root/testdata/sf0.01"
    marks = {"GNU General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc", "the MIT License": "mit", "the Apache License, Version 2.0": "apache", "All rights reserved.": "proprietary"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in li.op5_license_scan(spark, sf).collect():
        assert r.families == ",".join(sorted({f for m, f in marks.items() if m in texts[r.doc_id]}))


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
APACHE = """Licensed under the Apache License,
Version 2.0 (the "License"); you may not use this
file except in compliance with the License.
You may obtain a copy of the License at"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
AGPL = GPL.replace("GNU General", "GNU Affero General")
LGPL = GPL.replace("program", "library").replace("GNU General", "GNU Lesser General")
FILLER = "The first line of a story about rivers and boats.\n" * 20


def confirmed(model, text):
    return sorted(f["family"] for f in li.scan_text(model, text)[1] if f["confirmed"])


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", "dnl ", "REM "])
@pytest.mark.parametrize("text, family", [(MIT, "mit"), (BSD, "bsd"), (APACHE, "apache"), (GPL, "gpl"), (AGPL, "agpl"), (LGPL, "lgpl")])
def test_wrapped_notices_are_found(model, text, family, mark):
    lines = "\n".join(mark + line for line in text.split("\n"))
    assert confirmed(model, f"{mark}Copyright (c) 2020 Jo\n{mark}\n{lines}") == [family]
    assert confirmed(model, FILLER + lines + "\n" + FILLER) == [family]
    start = li.scan_text(model, FILLER + lines)[1][-1]["start"]
    assert start == len(FILLER)


def test_dual_notices_are_found(model):
    assert confirmed(model, f"{APACHE}\n{MIT}") == ["apache", "mit"]
    assert confirmed(model, f"{GPL}\n\n{MIT}") == ["gpl", "mit"]
    assert confirmed(model, "Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["apache", "mit"]
    assert confirmed(model, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc"]


SPOKEN_OF = [
    "He said that all rights reserved is a phrase.",
    "She was released under the mit license plate scheme",
    "We think that all rights reserved is a title",
    "A sticker that reads Licensed under CC BY 4.0 hung over the desk",
]


def test_notices_spoken_of_are_unknown(model):
    for text in SPOKEN_OF:
        words = li.words_of(text)
        assert li.stated(words, li.marks_of(words)) and not li.scan_text(model, text)[1], text


def test_the_threshold_decides(model, spark):
    """The same documents at threshold 0 and at the fitted one: templates stand in all, the classifier rejects some."""
    docs = spark.createDataFrame([*enumerate(SPOKEN_OF), (9, "Prose.\nAll rights reserved.\nMore.")], "doc_id long, text string")

    def families(threshold):
        own = li.Model(model.families, model.weights, model.base.tolist(), model.temperature, threshold)
        return {r.doc_id: {f.family for f in r.found if f.confirmed} for r in li.scan(docs, own).collect()}

    # Documents 0 and 2 fall below FLOOR, too.
    assert families(0.0) == {0: set(), 1: {"mit"}, 2: set(), 3: {"cc-by"}, 9: {"proprietary"}}
    assert families(model.threshold) == {0: set(), 1: set(), 2: set(), 3: set(), 9: {"proprietary"}}


def test_whole_templates_are_held_out(model):
    """No template and no sentence is on both sides of a fold; the figures of unseen ones are kept with the model."""
    rows = li._examples(["a line about rivers and boats", "another one about hills"])
    for family, templates in li.TEMPLATES.items():
        for t in templates:
            assert len({folds for f, w, folds in rows if f == family and w == li.words_of(t)}) == 1
    assert 0 < model.threshold < 1 and model.held["recall"] > 0.7 and model.held["unknown_recall"] > 0.9


def test_border_grams():
    words = "we were told that all rights reserved is void".split()
    assert li.slot_grams(words, [(4, 7)]) == {"that _", "_ is", "told that _", "that _ is", "_ is void"}
    assert li.slot_grams(["all", "rights", "reserved"], [(0, 3)]) == set()


def test_query_gives_probabilities(spark):
    for r in li.op5_license_scan(spark, "/root/testdata/sf0.001").collect():
        assert (r.probability is None) == (r.n_confirmed == 0) and r.n_confirmed <= r.n_predicted
