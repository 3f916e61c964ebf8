"""License notices by template markup and token automata.

A template is a license wording with marked regions: ``[[...]]`` may be left
out, and ``{{n}}`` stands for up to n words of any kind (names, years). It is
compiled into an automaton over words, held as bit sets: one bit for each
place in the template, one mask for each word, skips for the optional places.
A place in a text is accepted if all mandatory words stand there, exactly and
in order. Every occurrence of a template's first word starts a run.

Words are maximal runs of 0-9, a-z and non-ASCII characters after A-Z are
lower-cased; punctuation doesn't count. The base phrases are templates without
marks whose places are all reported.

Null, empty or wordless text has no words and no places: labels are empty,
first_word and last_word null, the score 0. Rows pass one by one: repeated
rows and empty tables need no case of their own. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import map_batches

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public license notices, marked up; several wordings may carry one label.
TEMPLATES = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of
     this software and associated documentation files the software to deal in the software without
     restriction including without limitation the rights to use copy modify merge publish distribute
     sublicense and or sell copies of the software"""),
    ("mit", "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"),
    ("apache-2", "licensed under the apache license version 2 [[0]]"),
    ("apache-2", "apache license version 2 0 january 2004"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are
     permitted provided that the following conditions are met"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or
     without fee is hereby granted"""),
    ("gpl", """free software [[{{4}}]] you can redistribute it and or modify it under the terms of the
     gnu [[lesser]] [[affero]] general public license as published by the free software foundation"""),
    ("gpl", "gnu [[lesser]] [[affero]] general public license [[version {{1}}]]"),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0"""),
    ("boost-1", "[[distributed under the]] boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "[[this work is]] licensed under a creative commons {{4}} license"),
    ("cc-by-nc", "cc by nc [[sa]] [[nd]] [[4 0]]"),
    ("proprietary", "copyright [[c]] {{6}} all rights reserved"),
]

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))
ANY = None


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


@dataclass
class Automaton:
    """Bit-parallel automaton of one template; bit i: the first i places are passed."""

    label: str
    size: int = 0
    masks: dict[bytes, int] = field(default_factory=dict)
    any: int = 0
    skips: list[tuple[int, int]] = field(default_factory=list)      # from, to; by rising end
    first: set = field(default_factory=set)                         # words that can start a match

    def closed(self, states: int) -> int:
        """The states and all that optional places lead to."""
        for a, b in self.skips:
            if states >> a & 1:
                states |= 1 << b
        return states

    def match(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from ``start``, or -1."""
        states, end, goal = self.closed(1), -1, 1 << self.size
        for i in range(start, len(words)):
            states = self.closed((states & (self.masks.get(words[i], 0) | self.any)) << 1)
            if not states:
                break
            if states & goal:
                end = i + 1
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """Places, optional regions and wildcards of a marked-up wording."""
    out = Automaton(label)
    opened: list[int] = []
    places: list[bytes | None] = []
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}]+", markup):
        if part == "[[":
            opened.append(len(places))
        elif part == "]]":
            out.skips.append((opened.pop(), len(places)))
        elif part.startswith("{{"):
            for _ in range(int(part[2:-2])):
                out.skips.append((len(places), len(places) + 1))
                places.append(ANY)
        else:
            places += words_of(part)
    out.size = len(places)
    out.skips.sort()
    for i, word in enumerate(places):
        if word is ANY:
            out.any |= 1 << i
        else:
            out.masks[word] = out.masks.get(word, 0) | 1 << i
    begin = out.closed(1)
    out.first = {w for w, mask in out.masks.items() if mask & begin}
    if begin & out.any:                 # starts with a replaceable region: enter at the word behind it
        raise ValueError(f"a template can't start with a replaceable region: {label}")
    return out


@dataclass
class Place:
    label: str
    start: int
    end: int
    base: bool


class Scanner:
    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]]):
        self.by_word: dict[bytes, list[tuple[Automaton, bool]]] = {}
        own = [(compile_template(label, text), True) for text, label in base.items()]
        own += [(compile_template(label, text), False) for label, text in templates]
        for automaton, is_base in own:
            for word in automaton.first:
                self.by_word.setdefault(word, []).append((automaton, is_base))

    def places(self, words: list[bytes]) -> list[Place]:
        if self.by_word.keys().isdisjoint(words):
            return []
        found = []
        for i, word in enumerate(words):
            for automaton, is_base in self.by_word.get(word, ()):
                end = automaton.match(words, i)
                if end >= 0:
                    found.append(Place(automaton.label, i, end, is_base))
        return found


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, score and the accepted places of each row of ``docs(doc_id, text)``.

    places: array of (label, start, end, base) by start; words from 0, end
    exclusive. score: share of the words that lie in an accepted place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            counts, scores, all_places = [], [], []
            for value in batch.column(1):
                words = words_of(value.as_py() or "")
                found = scanner.places(words)
                covered = np.zeros(len(words) if found else 0, dtype=bool)
                for p in found:
                    covered[p.start:p.end] = True
                counts.append(len(words))
                scores.append(float(covered.sum()) / len(words) if found else 0.0)
                all_places.append([vars(p) for p in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64()), pa.array(all_places, kind)],
                names=["doc_id", "n_words", "score", "places"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                       "doc_id long, n_words long, score double, "
                       "places array<struct<label:string,start:long,end:long,base:boolean>>")
