"""Licence scan: given licence lines, unseen wordings, ordinary text, edge cases."""

import re

import pytest

from kdframe.llm import licences as C

GIVEN = {"apache": r"Licensed under the Apache License", "gpl": r"GNU General Public License", "proprietary": r"All rights reserved",
         "mit": r"MIT License", "cc-by-nc": r"CC BY-NC"}


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(table):
    return C.fit(table)


def test_given_lines(table, model):
    got = {(r.doc_id, r.paragraph): r.family for r in C.scan(table, model).collect()}
    want = {(r.doc_id, n): f for r in table.collect() for n, line in enumerate(r.text.split("\n")) for f, p in GIVEN.items() if re.search(p, line)}
    assert want and {k: f for k, f in got.items() if f != C.UNKNOWN} == want


def test_unseen_wordings_and_edges(docs_of, model, words):
    said = {1: ("mit", "This software is distributed under the MIT license"), 2: ("gpl", "licensed under the GNU general public license VERSION 2"),
            3: ("apache", "Licensed under Apache License 2.0"), 4: ("cc-by-nc", "This text is licensed under CC BY-NC 3.0"),
            5: ("proprietary", "Copyright 1999 Someone Else. All rights reserved."), 6: ("cc-by", "Licensed under CC BY 3.0")}
    rows = [(i, "First line here.\n" + t) for i, (_, t) in said.items()]
    rows += [(20, "He lost his driving license on the way to the public library."), (21, None), (22, ""), (23, "\n\n"), (24, words(30_000, 1)),
             (25, words(20_000, 2) + " released under the MIT License. " + words(20_000, 3)), (None, "All rights reserved."), (30, "All rights reserved."), (30, "All rights reserved.")]
    got = C.scan(docs_of(rows), model).collect()
    family = {(r.doc_id, r.paragraph): r.family for r in got}
    assert {i: family.get((i, 1)) for i in said} == {i: f for i, (f, _) in said.items()}
    assert family.get((20, 0), C.UNKNOWN) == C.UNKNOWN
    assert family[25, 0] == "mit" and family[None, 0] == "proprietary" and sum(r.doc_id == 30 for r in got) == 2
    assert not {21, 22, 23, 24} & {r.doc_id for r in got}
    assert all(0 <= r.probability <= 1 for r in got)
    assert C.scan(docs_of([]), model).collect() == []


def test_fit_without_documents(docs_of):
    model = C.fit(docs_of([]))
    assert [r.family for r in C.scan(docs_of([(1, "Released under the MIT License.")]), model).collect()] == ["mit"]


def test_no_python_on_the_way(docs_of, model):
    plan = C.scan(docs_of([(1, "x")]), model)._jdf.queryExecution().toString()
    assert not re.search(r"(?i)python(?!rdd)|arrow|pandas", plan.replace("ExistingRDD", ""))


def test_frequent_licence_and_small_table(docs_of, words):
    said = "Released under the MIT License."
    third = [(i, words(30, i) + ("\n" + said if i % 3 == 0 else "")) for i in range(300)]
    ten = [(i, words(30, 500 + i) + ("\n" + said if i == 4 else "")) for i in range(10)]
    for rows in (third, ten):
        got = {(r.doc_id, r.paragraph): r.family for r in C.scan(docs_of(rows), C.fit(docs_of(rows))).collect()}
        assert got == {(i, 1): "mit" for i, t in rows if said in t}


WRAPPED = {
    "gpl": ["This program is free software: you can redistribute", "it and/or modify it under the terms of the GNU", "General Public License as published by the Free",
            "Software Foundation, either version 3"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the Software), to deal"],
    "bsd": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are", "met:"],
    "mpl": ["This Source Code Form is subject to the", "terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not"],
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_headers(docs_of, model, words, mark):
    rows = [(i, "\n".join(["some code here", mark.rstrip(), *[mark + x for x in w], mark.rstrip(), words(50, i)])) for i, w in enumerate(WRAPPED.values())]
    rows.append((9, "This program is free software: you can redistribute\n\n" + words(40, 9)))
    rows.append((10, words(30, 10) + "\n" + "Released under the MIT License."))
    got = {(r.doc_id, r.paragraph): r.family for r in C.scan(docs_of(rows), model).collect()}
    assert [got.get((i, 2)) for i in range(4)] == list(WRAPPED)
    assert got[9, 0] == C.UNKNOWN and got[10, 1] == "mit" and (10, 0) not in got
