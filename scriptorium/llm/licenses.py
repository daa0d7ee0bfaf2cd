"""License scans: template-markup matching with token automata.

A template is licence wording with markup: ``[[ ... ]]`` is a region that may
be missing, ``{{name:N}}`` stands for up to N replaceable words.  It compiles
into an automaton over words; a text is accepted where the words of the
mandatory regions occur exactly, one after the other.  All templates run over
a document in one pass; a template is entered only at its first literal word.

Beside the templates, plain phrases are located: every place at which the
words of a phrase stand one after the other.

Defined results: null and empty texts have no words, labels are then empty and
the score 0; texts of any length are scanned whole; repeated rows give repeated
results; the result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .wu_manber import WORD_BYTES

# The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The wording of public licences and of their notices, with markup.
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by {{whom:12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_CC = "licensed under [[a]] [[the]] creative commons"
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[,]] version 2 0",
    "apache-2.0-text": "apache license version 2 0 january 2004 [[http www apache org licenses]] [[https www apache org licenses]] terms and conditions for use reproduction and distribution",
    "gpl-3.0": "licensed under the [[terms of the]] gnu general public license [[,]] [[as published by the free software foundation]] [[either]] version 3 [[or any later version]]",
    "gpl-2.0": "licensed under the [[terms of the]] gnu general public license [[,]] [[as published by the free software foundation]] [[either]] version 2 [[or any later version]]",
    "gpl-3.0-notice": "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version 3 [[of the license]]",
    "gpl-2.0-notice": "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version 2 [[of the license]]",
    "lgpl-3.0-notice": "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [[either]] version 3 [[of the license]]",
    "lgpl-2.1-notice": "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [[either]] version 2 1 [[of the license]]",
    "agpl-3.0-notice": "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation [[either]] version 3 [[of the license]]",
    "mit-notice": "released under the [[terms of the]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this {{object:6}} and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this {{object:6}} and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{holders:12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} [[3]] [[c]] neither the name of {{{{owner:12}}}} nor the names of {{{{its:4}}}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "epl-2.0-notice": "made available under the terms of the eclipse public license [[v]] [[version]] 2 0",
    "epl-1.0-notice": "made available under the terms of the eclipse public license [[v]] [[version]] 1 0",
    "bsl-1.0-notice": "distributed under the boost software license version 1 0",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0-1.0": "to the extent possible under law {{who:12}} has waived all copyright and related or neighboring rights to",
    "cc-by-4.0": f"{_CC} attribution 4 0 [[international]]",
    "cc-by-sa-4.0": f"{_CC} attribution sharealike 4 0 [[international]]",
    "cc-by-nd-4.0": f"{_CC} attribution noderivatives 4 0 [[international]]",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0",
    "cc-by-nc-4.0-name": f"{_CC} attribution noncommercial 4 0 [[international]]",
    "cc-by-nc-sa-4.0": f"{_CC} attribution noncommercial sharealike 4 0 [[international]]",
    "cc-by-nc-nd-4.0": f"{_CC} attribution noncommercial noderivatives 4 0 [[international]]",
}

_MARK = re.compile(r"\[\[|\]\]|\{\{\w+:\d+\}\}|[^\[\]{}]+")


def parse(template: str) -> list:
    """Markup as a list of words (bytes), ``("var", n)`` and ``("opt", [...])``."""
    stack: list[list] = [[]]
    for token in _MARK.findall(template):
        if token == "[[":
            stack.append([])
        elif token == "]]":
            inner = stack.pop()
            if not stack:
                raise ValueError("]] without [[")
            stack[-1].append(("opt", inner))
        elif token.startswith("{{"):
            stack[-1].append(("var", int(token[2:-2].split(":")[1])))
        else:
            stack[-1].extend(token.encode().translate(WORD_BYTES).split())
    if len(stack) != 1:
        raise ValueError("[[ without ]]")
    return stack[0]


@dataclass
class Automaton:
    """States 0..final; ``literal[s]`` moves on a word, ``any_word[s]`` on every
    word, ``jump[s]`` without reading."""

    literal: list[dict[bytes, int]]
    any_word: list[int | None]
    jump: list[list[int]]

    def __post_init__(self):
        self.final = len(self.literal) - 1
        self.closed = [self._closure(s) for s in range(len(self.literal))]
        self.firsts = {w for s in self.closed[0] for w in self.literal[s]}
        if self.final in self.closed[0] or any(self.any_word[s] is not None for s in self.closed[0]):
            raise ValueError("a template must begin with a mandatory or optional literal word")

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.jump[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def ends(self, words: list[bytes], start: int) -> int | None:
        """The nearest end of an accepted region from ``start``."""
        states: frozenset[int] | set[int] = self.closed[0]
        for i in range(start, len(words)):
            after: set[int] = set()
            for s in states:
                if (to := self.literal[s].get(words[i])) is not None:
                    after |= self.closed[to]
                if (to := self.any_word[s]) is not None:
                    after |= self.closed[to]
            if self.final in after:
                return i + 1
            if not after:
                return None
            states = after
        return None


def compile_template(template: str) -> Automaton:
    literal: list[dict[bytes, int]] = [{}]
    any_word: list[int | None] = [None]
    jump: list[list[int]] = [[]]

    def new() -> int:
        literal.append({})
        any_word.append(None)
        jump.append([])
        return len(literal) - 1

    def build(nodes: list, at: int) -> int:
        for node in nodes:
            if isinstance(node, bytes):
                to = new()
                literal[at][node] = to
                at = to
            elif node[0] == "opt":
                to = build(node[1], at)
                end = new()
                jump[to].append(end)
                jump[at].append(end)
                at = end
            else:
                stops = [at]
                for _ in range(node[1]):
                    to = new()
                    any_word[at] = to
                    at = to
                    stops.append(at)
                end = new()
                for s in stops:
                    jump[s].append(end)
                at = end
        return at

    last = build(parse(template), 0)
    jump[last].append(new())
    return Automaton(literal, any_word, jump)


class Scanner:
    """All phrases and templates over one text."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.automata = [(name, compile_template(t)) for name, t in templates.items()]
        self.by_word: dict[bytes, list] = {}
        for name, auto in self.automata:
            for w in auto.firsts:
                self.by_word.setdefault(w, []).append((name, auto))

    def scan(self, text: bytes | None) -> tuple[int, int, int | None, int | None, list[str], dict[str, tuple[int, int]]]:
        words = (text or b"").translate(WORD_BYTES).split()
        line = b" " + b" ".join(words) + b" "
        places: list[int] = []
        labels: set[str] = set()
        for phrase, label in self.phrases:
            at, count, done = line.find(phrase), 0, 0
            while at >= 0:
                count += line.count(b" ", done, at)
                done = at
                places.append(count)
                labels.add(label)
                at = line.find(phrase, at + 1)
        spans: dict[str, tuple[int, int]] = {}
        for word, autos in self.by_word.items():
            if b" " + word + b" " not in line:
                continue
            at, count, done = line.find(b" " + word + b" "), 0, 0
            while at >= 0:
                count += line.count(b" ", done, at)
                done = at
                for name, auto in autos:
                    if name not in spans and (end := auto.ends(words, count)):
                        spans[name] = (count, end)
                at = line.find(b" " + word + b" ", at + 1)
        return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), spans


_SPAN = T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("template_spans", _SPAN)]
)
_TYPES = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Add the result columns to the columns named in ``keep`` (default: all).

    The score is 1 if a template accepts, 0.5 if only a phrase occurs, else 0.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in keep] + RESULT.fields)
    phrases, templates = dict(phrases), dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            columns: list[list] = [[] for _ in RESULT.names]
            for text in batch[text_col].cast(pa.binary()):
                *head, base, spans = scanner.scan(text.as_py())
                rows = [*head, ",".join(base), ",".join(sorted({*base, *spans})), 1.0 if spans else 0.5 if base else 0.0, [{"template": n, "start": a, "end": b} for n, (a, b) in sorted(spans.items())]]
                for column, value in zip(columns, rows, strict=True):
                    column.append(value)
            made = [pa.array(v, t) for v, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *made], [*keep, *RESULT.names])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)
