"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are the windows of `span` consecutive words of a text, one and a half times a template's words, whatever its line
ends: a notice wrapped over lines is a block as any other. Tokens get one global order, by how many texts of the whole
corpus hold them (rarest first, then by the token). A block matches a template when it holds at least `containment` of
the template's distinct tokens. The filters lose nothing: of a template of t tokens that needs c, any block that
qualifies has one of the template's t - c + 1 rarest tokens (prefix filter), so only the words about such a token are
looked at; they must hold c of the template's tokens at all (length filter); and a block that opens with a token must
find c - 1 others in what is left of the window (positional filter). What is left is counted exactly. Blocks of one
template that overlap are one match.

A match must also hold the words that tell its template from its kin (`NEEDS`: a licence's name and version), and none of
those that tell another (`BARS`), so that function words alone never make a label. The method's labels are names of their
own, apart from those of the base phrases.

Beside the join, base phrases are found at every place where their words stand consecutively.

A null or empty text has no words and no blocks. Repeated rows stay apart. Columns besides doc_id and text are not read,
whatever their names. A text is held word by word: it must fit a task's memory some fifteen times.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogaz.llm.common import batches, give_back, text_bytes, words

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public license notices, template name -> text.
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0": "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-line": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}
#: Words that a match of a template must hold, and words that it, and the three words on both sides of it, must not hold:
#: what tells a notice from one of its kin. Notices that are not named need nothing beside the containment.
NEEDS = {
    "gpl-3.0": ("gnu", "general", "public", "license", "3"),
    "gpl-2.0": ("gnu", "general", "public", "license", "2"),
    "gpl-notice": ("gnu", "general", "public", "license"),
    "apache-2.0": ("licensed", "apache", "license", "2"),
    "apache-notice": ("apache", "license"),
    "mit-line": ("released", "mit", "license"),
    "cc-by-4.0": ("creative", "commons", "attribution", "4"),
    "cc-by-nc-4.0": ("licensed", "cc", "by", "nc", "4"),
}
BARS = {
    "cc-by-4.0": ("sharealike", "share", "noncommercial", "noncommercially", "commercial", "noderivatives", "noderivs", "nc", "nd", "sa"),
    "cc-by-nc-4.0": ("sa", "nd", "sharealike", "noderivatives"),
}
BESIDE = 3
CONTAINMENT = 0.8
#: Words of a block, as a multiple of the template's.
SPAN = 1.5
#: Bytes of text in a batch.
BATCH = 2 << 20


def token_counts(df: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many texts of the whole corpus each of the given tokens stands (a bounded list: the templates')."""
    known = frozenset(t.encode() for t in tokens)

    def run(it):
        total: Counter = Counter()
        for batch in (s for b in it for s in batches([b], BATCH)):
            for raw in text_bytes(batch):
                total.update(known.intersection(words(raw)))
        yield pa.RecordBatch.from_pydict({"token": [t.decode() for t in total], "n": list(total.values())}, pa.schema([("token", pa.string()), ("n", pa.int64())]))
        give_back()

    rows = df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in tokens} | {r.token: r.n for r in rows}


class TemplateIndex:
    """Templates by the tokens of their prefixes in the global order."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], containment: float, span: float = SPAN):
        order = {t: i for i, t in enumerate(sorted(counts, key=lambda t: (counts[t], t)))}
        self.templates: dict[str, tuple[frozenset, int, int]] = {}
        self.by_prefix: dict[bytes, list[str]] = {}
        for name, text in templates.items():
            ws = words(text.encode())
            toks = sorted(set(ws), key=lambda t: order[t.decode()])
            need = max(1, -int(-len(toks) * containment // 1))
            self.templates[name] = (frozenset(toks), need, -int(-len(ws) * span // 1))
            for t in toks[: len(toks) - need + 1]:
                self.by_prefix.setdefault(t, []).append(name)
        self.prefix = frozenset(self.by_prefix)
        of = templates.items() & TEMPLATES.items()  # others of the same name need what they hold
        self.needs, self.bars = ({name: [w.encode() for w in given.get(name, ())] for name, _ in of} for given in (NEEDS, BARS))

    def told(self, name: str, ws: list[bytes], a: int, z: int) -> bool:
        """Whether the words a to z tell this template from its kin."""
        needs, bars = self.needs.get(name, ()), self.bars.get(name, ())
        return frozenset(needs) <= frozenset(ws[a:z]) and frozenset(bars).isdisjoint(ws[max(0, a - BESIDE) : z + BESIDE])

    def matches(self, ws: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(template, first word, end, best containment) of each run of blocks that meet a template."""
        if self.prefix.isdisjoint(ws):
            return []
        near: dict[str, list[int]] = {}
        for i, w in enumerate(ws):
            if w in self.prefix:
                for name in self.by_prefix[w]:
                    near.setdefault(name, []).append(i)
        out = []
        for name, places in near.items():
            toks, need, span = self.templates[name]
            lo = hi = 0
            for p in [*places, len(ws) + 2 * span]:  # stretches of words that any block about these places lies in
                if hi and p - span + 1 > hi:
                    if len(toks.intersection(ws[lo:hi])) >= need:
                        out += [(name, a, z, n / len(toks)) for a, z, n in _blocks(ws, lo, hi, toks, need, span) if self.told(name, ws, a, z)]
                    lo = hi = 0
                if not hi:
                    lo = max(0, p - span + 1)
                hi = min(len(ws), p + span)
        return out


def _blocks(ws: list[bytes], lo: int, hi: int, toks: frozenset, need: int, span: int) -> list[tuple[int, int, int]]:
    """(first word, end, most tokens) of the runs of windows of `span` words in lo..hi that hold `need` of the tokens."""
    at = [i for i in range(lo, hi) if ws[i] in toks]
    count: Counter = Counter()
    out, left = [], 0
    for right, i in enumerate(at):
        count[ws[i]] += 1
        while i - at[left] >= span:
            w = ws[at[left]]
            count[w] -= 1
            if not count[w]:
                del count[w]
            left += 1
        if len(count) >= need:
            a, z, n = at[left], i + 1, len(count)
            if out and a < out[-1][1]:
                a, n = out[-1][0], max(n, out[-1][2])
                out.pop()
            out.append((a, z, n))
    return out


def block_matches(df: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """The join: (doc_id, first_word, last_word, template, containment) for every run of blocks that meet a template."""
    templates = templates or TEMPLATES
    index = TemplateIndex(templates, _counts(df, templates), containment)

    def run(it):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
        for batch in (s for b in it for s in batches([b], BATCH)):
            out = [(d, a, z - 1, n, c) for d, raw in zip(batch.column(0).to_pylist(), text_bytes(batch)) for n, a, z, c in index.matches(words(raw))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["doc_id", "first_word", "last_word", "template", "containment"])
        give_back()

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, first_word long, last_word long, template string, containment double")


def _counts(df: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    return token_counts(df, sorted({w.decode() for t in templates.values() for w in words(t.encode())}))


def license_scan(df: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 if a base phrase stands in the text, else the best containment of a matching template, else 0.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    index = TemplateIndex(templates, _counts(df, templates), containment)
    base = [(re.compile(rb"(?<= )" + re.escape(p.encode()) + rb"(?= )"), label) for p, label in phrases.items()]
    lasts = [b" " + p.split()[-1].encode() + b" " for p in phrases]

    def run(it):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
        for batch in (s for b in it for s in batches([b], BATCH)):
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), text_bytes(batch)):
                ws = words(raw)
                joined = b" " + b" ".join(ws) + b" "
                places, labels, score = [], set(), 0.0
                if any(x in joined for x in lasts):
                    starts = None
                    for rx, label in base:
                        found = [m.start() for m in rx.finditer(joined)]
                        if found:
                            starts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if starts is None else starts
                            places += np.searchsorted(starts, found, side="left").tolist()
                            labels.add(label)
                    places = [p - 1 for p in places]
                own = set()
                for name, _, _, c in index.matches(ws):
                    own.add(name)
                    score = max(score, c)
                out.append((doc, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), 1.0 if places else score))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
