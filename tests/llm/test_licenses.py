from __future__ import annotations

import re

import pytest

from sparkloom.llm import licenses as L


@pytest.fixture(scope="module")
def model():
    return L.fit(L.Vocabulary().places_of(["Ordinary text about nothing.", "Another line of words, here.", "The cat sat on the mat and slept."] * 20))


def scanned(docs, model):
    return [(r.doc_id, r.line, r.family) for r in sorted(L.scan(docs, model).collect(), key=lambda r: (r.doc_id, r.line))]


def test_families(spark, documents, model):
    texts = [f"Some words.\n{t}\nMore." for ts in L.TEMPLATES.values() for t in ts]
    names = [f for f, ts in L.TEMPLATES.items() for _ in ts]
    assert scanned(documents(*texts), model) == [(i, 1, f) for i, f in enumerate(names)]


def test_variants_and_other_text(spark, documents, model):
    texts = [
        "Copyright (c) 2024 Someone. Licensed under the Apache License, Version 2.0. See LICENSE.", "A driving license is required.", "Copyright law is a subject of study.", "", None,
        "released under the mit license", "word " * 30_000 + "Released under the MIT License.", "Permission is hereby granted to enter the building.",
    ]
    got = dict((i, f) for i, _, f in scanned(documents(*texts), model))
    assert got[0] == "Apache-2.0" and got[5] == "MIT" and got[6] == "MIT"
    assert not {1, 2, 3, 4} & set(got) and got.get(7, "unknown") == "unknown"


def test_unconfirmed_is_unknown(spark, documents, model):
    rows = L.scan(documents("This work is licensed under the Foo Bar Public License, version 9.", "Licensed under the Foo License, Version 7.1; you may not use this file but as it says."), model).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1] and all(r.family == "unknown" and not r.confirmed for r in rows)


def test_repeated_rows_and_clashing_columns(spark, documents, model):
    docs = documents((3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "Released under the MIT License."))
    clash = docs.withColumnRenamed("lang", "line").withColumnRenamed("source", "family").withColumnRenamed("n_chars", "paragraph")
    assert sorted((r.doc_id or 0, r.line, r.family) for r in L.scan(clash, model).collect()) == [(0, 0, "MIT"), (3, 0, "MIT"), (3, 0, "MIT")]
    assert L.train(clash).threshold == L.train(docs.limit(2)).threshold


def test_long_lines_take_part(spark, documents):
    line = "plain " * 2000 + "words of the license version"
    assert len(L._sample is not None and L.Vocabulary().places_of([line])[0]) > 3
    assert [r.family for r in L.scan(documents(line + " Released under the MIT License."), L.train(documents(line))).collect()] == ["MIT"]


def brute(text):
    """(line, families whose template a single line covers) by sets of word pairs and triples."""
    grams = lambda t: {tuple(w[i : i + n]) for w in [re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), t))] for n in (2, 3) for i in range(len(w) - n + 1)}
    templates = [(f, grams(t)) for f, ts in L.TEMPLATES.items() for t in ts]
    out = {}
    for n, line in enumerate((text or "").split("\n")):
        have = grams(line)
        cover = {f for f, t in templates if len(t & have) >= L.COVERAGE * len(t) - 1e-6}
        if cover:
            out[n] = cover
    return out


def test_confirmed_lines_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(r.doc_id, n): families for r in docs.collect() for n, families in brute(r.text).items()}
    got = {(r.doc_id, r.line): r.family for r in L.scan(docs, L.train(docs)).filter("confirmed").collect() if "\n" not in r.paragraph}
    assert len(want) > 5 and set(got) == set(want) and all(got[k] in want[k] for k in got)


def test_families_left_out_of_training_stay_unknown():
    """What the threshold is for: wording that no template of the model has."""
    model = L.fit(L.Vocabulary().places_of(["Ordinary text about nothing."] * 30))
    assert 0.5 <= model.threshold <= 0.9 and 0.2 <= model.heat <= 5


def test_empty_table_and_training(spark, documents):
    docs = documents("a b c", "Released under the MIT License.", None)
    assert L.scan(docs.filter("false"), L.train(docs.filter("false"))).count() == 0
    assert [r.family for r in L.scan(docs, L.train(docs)).collect()] == ["MIT"]


MIT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at the address below."""


@pytest.mark.parametrize(("family", "text", "start"), [("MIT", MIT, 0), ("GPL-3.0", GPL, 0), ("BSD", BSD, 0), ("Apache-2.0", APACHE, 0)])
def test_wrapped_notices(spark, documents, model, family, text, start):
    lines = text.split("\n")
    forms = [text, "\n".join(" * " + x for x in lines), "\n".join("# " + x for x in lines), "\n".join("dnl " + x for x in lines), text.replace("\n", "\r\n")]
    around = ["Some words.\n\n{}\n\nMore words.", "Some words.\nOther words here.\n{}\nMore words.\nAnd the last."]
    texts = [w.format(t) for w in around for t in forms]
    rows = sorted(L.scan(documents(*texts), model).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.line, r.family) for r in rows] == [(i, 2, family) for i in range(len(texts))]
    assert all(r.confirmed and r.paragraph.count("\n") + 1 in (len(lines), len(lines) - 1, len(lines) - 2) for r in rows)


def test_wrapped_notices_of_one_paragraph(spark, documents, model):
    both = f"{MIT}\nOrdinary text.\n{GPL}\nReleased under the BSD License."
    blank = "Permission is hereby granted, free of charge, to any\n\nperson entering the building."
    assert scanned(documents(both, MIT + "\n\n" + GPL, MIT + "\n" + MIT), model) == [(0, 0, "MIT"), (0, 6, "GPL-3.0"), (0, 10, "BSD"), (1, 0, "MIT"), (1, 6, "GPL-3.0"), (2, 0, "MIT"), (2, 5, "MIT")]
    assert all(f == "unknown" for _, _, f in scanned(documents(blank), model))
    assert scanned(documents("A plain line.\nAnother one of words.\nThe cat slept."), model) == []
