"""Toxicity, licence and language models: held-out accuracy, fairness, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langspans, licenses, queries, toxicity

PEOPLE = ["women", "men"]


@pytest.fixture(scope="module")
def comments(spark):
    """Insults mostly name one group, which a plain model would take for toxic itself."""
    rng = np.random.default_rng(3)
    common = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(1500):
        toxic = int(rng.random() < 0.4)
        group = PEOPLE[0] if rng.random() < (0.9 if toxic else 0.1) else PEOPLE[1]
        words = list(rng.choice(common, 12)) + [group] + (["vileword"] if toxic and rng.random() < 0.9 else [])
        rows.append((" ".join(words), toxic))
    return spark.createDataFrame(rows, "text string, toxic int")


def test_swapped_groups_score_alike(comments):
    plain = toxicity.fit_toxicity(comments, toxicity.ToxicityParams(fairness=0.0))
    fair = toxicity.fit_toxicity(comments)
    gap = lambda m: abs(m.score("worda women") - m.score("worda men"))
    assert gap(plain) > 0.3 and gap(fair) < gap(plain) / 4
    assert fair.score("women vileword") > 0.5 and fair.score("men vileword") > 0.5
    assert fair.score("worda women") < 0.5


def test_toxicity_awkward_rows(spark, comments):
    model = toxicity.fit_toxicity(comments)
    docs = spark.createDataFrame(
        [(1, None, "x"), (1, "", "x"), (None, "VILEWORD " * 300_000, "x"), (2, "vileword", "x"), (2, "vileword", "x")],
        "doc_id bigint, text string, toxicity string",
    )
    got = toxicity.score_toxicity(docs, model).collect()
    scores = [r["toxicity"] for r in got]
    assert len(got) == 5 and scores[0] == scores[1] and scores[2] == scores[3] == scores[4] > 0.5
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    nothing = toxicity.fit_toxicity(comments.limit(0))
    assert nothing.score("any") == 0.5
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (2, 1)], "doc_id bigint, toxic int")
    taken = toxicity.labelled_documents(docs, labels, F.lit(True), toxicity.ToxicityParams()).collect()
    assert [(r["text"], r["toxic"]) for r in taken] == [("vileword", 1)]


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op5_toxicity(spark, sf_dir)
    judged = got.filter("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("toxic is not null").collect()
    right = sum(r["predicted"] == r["toxic"] for r in judged)
    assert got.count() == 1000 and len(judged) > 50 and right / len(judged) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in judged)


def test_held_out_language(spark, sf_dir):
    got = queries.op10_language(spark, sf_dir)
    judged = got.filter("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").filter("lang is not null").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in judged)
    assert len(judged) > 40 and right / len(judged) > 0.97


@pytest.fixture(scope="module")
def languages(spark):
    rng = np.random.default_rng(1)
    stems = {"aa": ["kalo", "mira", "sento", "luma"], "bb": ["streng", "wacht", "pfeil", "schrum"], "cc": ["где", "это", "мир", "лес"]}
    rows = [(" ".join(rng.choice(stems[lang], 40)), lang) for lang in stems for _ in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    return langspans.fit_languages(docs, F.lit(True))


def test_spans_of_mixed_text(spark, languages):
    text = "kalo mira sento luma kalo. Streng wacht pfeil schrum wacht! где это мир"
    docs = spark.createDataFrame(
        [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "123 -- 4", "x"), (5, "kalo " * 400_000, "x"), (1, text, "x")],
        "doc_id bigint, text string, lang_pred string",
    )
    got = {r["doc_id"]: r for r in langspans.label_languages(docs, languages).collect()}
    assert [tuple(s) for s in got[1]["lang_spans"]] == [("aa", 0, 5), ("bb", 5, 5), ("cc", 10, 3)]
    assert got[1]["lang_pred"] == "bb" and 0 < got[1]["lang_score"] < 1
    assert all((got[i]["lang_pred"], got[i]["lang_score"]) == ("und", 0.0) for i in (2, 3, 4))
    assert [tuple(s) for s in got[5]["lang_spans"]] == [("aa", 0, 400_000)]
    assert langspans.label_languages(docs.limit(0), languages).count() == 0
    nothing = langspans.fit_languages(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langspans.label_languages(docs, nothing).collect()} == {"und"}


def test_copies_count_once_and_rare_languages_are_bounded(spark):
    rows = [("kalo mira " * 5, "aa")] * 400 + [(f"sento{'x' * i} luma", "aa") for i in range(20)]
    rows += [(f"wacht pfeil{'y' * i}", "bb") for i in range(30)] + [(f"schrum {i}", f"dirt{i:03d}") for i in range(150)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langspans.fit_languages(docs, F.lit(True), langspans.LanguageParams(langs=3))
    assert model.langs == ("aa", "bb", "dirt000")
    # Of "aa" there are 21 texts: a text that stands 400 times has one share in the grams.
    aa = np.exp(model.scores[:, 0])
    assert aa[model.grams["kal"]] < aa[model.grams["sen"]]
    whole = langspans.fit_languages(docs, F.lit(True), langspans.LanguageParams(cells=152 * 152 * 2))
    assert len(whole.langs) == 152 and len(whole.grams) <= 2 * 152
    few = langspans.fit_languages(docs, F.lit(True), langspans.LanguageParams(sample=5, langs=2))
    assert few.langs == ("aa", "bb")


def test_columns_with_the_names_of_results(spark, languages):
    docs = spark.createDataFrame(
        [(1, "kalo mira", 5, "s", 7, "l", "w")],
        "doc_id int, text string, lang_score int, LANG_SPANS string, __label int, label string, row string",
    )
    got = langspans.label_languages(docs, languages)
    assert got.columns == ["doc_id", "text", "__label", "label", "row", "lang_pred", "lang_score", "lang_spans"]
    assert tuple(got.first())[:7] == (1, "kalo mira", 7, "l", "w", "aa", 1.0)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    lengths = [0, 1, 5, 3, 0, 6]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(0, 2, (starts[-1], 3))
    path = langspans.viterbi(scores, starts, 1.5)
    from itertools import product

    for a, b in zip(starts[:-1], starts[1:]):
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        best = max((value(p) for p in product(range(3), repeat=b - a)), default=0)
        assert abs(value(path[a:b]) - best) < 1e-9


PHRASES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "gpl": "licensed under the GNU General Public License, version 3",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
}


def test_licenses_of_the_corpus(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op6_licenses(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        want = sorted(f for f, phrase in PHRASES.items() if phrase in texts[r["doc_id"]])
        assert r["families"] == ",".join(want)
        for n in r["licenses"]:
            if n["confirmed"]:
                assert PHRASES[n["family"]] in texts[r["doc_id"]][n["start"] : n["end"]]


def test_license_awkward_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "\n\nReleased under the MIT License.\r\n", "x"), (3, "\n\nReleased under the MIT License.\r\n", "x"),
         (None, "word " * 200_000 + "\nA licensed physician met the general public", "x"),
         (5, licenses.TEMPLATES["mit"][3], "x")],
        "doc_id bigint, text string, licenses string",
    )
    model = licenses.fit_licenses(docs)
    got = licenses.find_licenses(docs, model).collect()
    shown = [[(n["family"], n["start"], n["end"]) for n in r["licenses"] if n["confirmed"]] for r in got]
    assert shown[0] == shown[1] == shown[4] == [] and shown[2] == shown[3] == [("mit", 2, 34)]
    assert shown[5][0][0] == "mit"
    assert licenses.find_licenses(docs.limit(0), licenses.fit_licenses(docs.limit(0))).count() == 0


def test_wrapped_notices_and_two_in_a_line(spark):
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer."""
    isc = """# Permission to use, copy, modify, and/or distribute this software for any
# purpose with or without fee is hereby granted, provided that the above
# copyright notice and this permission notice appear in all copies."""
    mit = """// Permission is hereby granted, free of charge, to any person obtaining a
// copy of this software and associated documentation files (the "Software"),
// to deal in the Software without restriction, including without limitation"""
    two = "Licensed under the Apache License, Version 2.0 and a story of a garden. " + licenses.TEMPLATES["bsd"][3]
    plain = "He was released from prison\nunder the terms of a licence\nand met the general public"
    docs = spark.createDataFrame(list(enumerate([bsd, isc, mit, two, plain])), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.find_licenses(docs, licenses.fit_licenses(docs)).collect()}
    families = [sorted({n["family"] for n in got[i]["licenses"] if n["confirmed"]}) for i in range(5)]
    assert families == [["bsd"], ["isc"], ["mit"], ["apache-2.0", "bsd"], []]
    found = [n for n in got[0]["licenses"] if n["confirmed"]]
    assert bsd[found[0]["start"] : found[0]["end"]].startswith("Redistribution and use")


def test_other_licences_and_other_versions(spark):
    """Notices of the families, and of licences that are none of them, in other words than the templates.

    A regression test, no held-out accuracy: Boost, Apache 1.1 and zlib are among the fixed values too, and
    the two templates of a version 2 were added after such wordings had been missed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit_licenses(docs)
    assert model.temperature > 1  # templates not seen are judged with less certainty, not with more
    mine = {
        "apache-2.0": ["This project is licensed under the Apache License, Version 2.0 (see LICENSE)", "under the Apache License, Version 2"],
        "mit": ["The code is released under the MIT License, see the file"],
        "gpl": ["It is licensed under the GNU General Public License, version 2 or later"],
        "bsd": ["Licensed under the BSD license, see COPYING"],
        "cc-by": ["This work is licensed under a Creative Commons Attribution 3.0 International License"],
        "mpl-2.0": ["This code is licensed under the Mozilla Public License, version 2.0"],
    }
    others = [
        "Apache License, Version 1.1", "Licensed under the Apache Software License, Version 1.0", "Boost Software License",
        "Licensed under the Mozilla Public License, version 1.0", "Common Development and Distribution License, Version 1.0",
        "Licensed under the Microsoft Public License", "Open Software License 3.0", "Licensed under the Q Public License",
        "SPDX-License-Identifier: Zlib", "She renewed the license under a new name", "The permission was granted free of charge",
    ]
    rows = [(i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in mine.items() for t in ts)]
    rows += [(100 + i, t, None) for i, t in enumerate(others)]
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id int, text string, family string"), model).collect()
    found = {r["text"]: {n["family"] for n in r["licenses"] if n["confirmed"]} for r in got}
    assert {t: f for t, f in found.items()} == {t: ({f} if f else set()) for _, t, f in rows}
    assert not any(r["licenses"] for r in got if r["text"] in ("Apache License, Version 1.1", "Boost Software License"))
