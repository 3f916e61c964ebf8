import re

import pytest

from farebox.llm import license_scan as L


def brute(text):
    """Words and (label, start) of the base phrases."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)
    places = [(label, i) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return words, sorted(places, key=lambda p: p[1])


def test_base_places(spark, docs, no_docs, rows):
    texts = ["Under the MIT License, under the mit license.", "Apache-License (Version) 2", "cc BY-nc cc by nc", "cc by ncé", "x" * 9 + " apache license version 2.0",
             None, "", "日本 cc by nc", "under the mit\x00license"]
    own = rows + [(1000 + i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(own, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], [(p["label"], p["start"]) for p in r["places"] if p["base"]]) for r in L.scan(frame).collect())
    assert got == sorted((str(i), len(brute(t)[0]), brute(t)[1]) for i, t in own)
    assert all(0 <= r["score"] <= 1 for r in L.scan(frame).collect())
    assert L.scan(docs).count() == len(rows) and L.scan(no_docs).count() == 0


@pytest.mark.parametrize("markup, text, end", [
    ("a b c", "a b c d", 3), ("a b c", "a b", -1), ("a [[b c]] d", "a d", 2), ("a [[b c]] d", "a b c d", 4), ("a [[b c]] d", "a b d", -1),
    ("a {{2}} d", "a d", 2), ("a {{2}} d", "a x y d", 4), ("a {{2}} d", "a x y z d", -1), ("[[a]] [[b]] c", "b c", 2), ("[[a]] [[b]] c", "c", 1),
    ("a [[{{2}} b]] c", "a x b c", 4), ("a [[b]]", "a b", 2), ("a [[b]]", "a x", 1)])
def test_automata(markup, text, end):
    automaton = L.compile_template("x", markup)
    words = L.words_of(text)
    assert (automaton.match(words, 0) if words[0] in automaton.first else -1) == end


def test_template_cannot_start_open():
    with pytest.raises(ValueError):
        L.compile_template("x", "{{3}} b")


def test_notices(spark):
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software": {"mit"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 license": {"cc"},
        "Copyright (c) 2020 Jane Roe and others. All rights reserved.": {"proprietary"},
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation": {"gpl"},
        "Redistribution of leaflets": set(),
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(frame).collect():
        assert {p["label"] for p in r["places"]} == list(texts.values())[r["doc_id"]]
