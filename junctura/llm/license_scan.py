"""Licence notices by a positional index of rare template words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from junctura.llm.common import text_of


@dataclass(frozen=True)
class Template:
    """A notice: its words, and the phrases that must stand in it word for word."""

    label: str
    words: str
    key: tuple[str, ...]
    base: bool = False


# The base phrases with their labels.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",), True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), True),
)
# Sentences of well-known licences, their bodies' as well as naming ones, with their mandatory phrases.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             ("permission is hereby granted free of charge to any person obtaining a copy",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
             ("this permission notice shall be included in all copies or substantial portions of the software",)),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
             ("the software is provided as is without warranty of any kind", "noninfringement",)),
    Template("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software",
             ("in no event shall the authors or copyright holders be liable for any claim",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
             ("apache license version 2 0",)),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
             ("software distributed under the license is distributed on an as is basis",)),
    Template("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce",
             ("each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable",)),
    Template("gpl-3", "licensed under the gnu general public license version 3",
             ("gnu general public license version 3",)),
    Template("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3",
             ("gnu general public license", "either version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2",
             ("gnu general public license version 2",)),
    Template("gpl-2", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
             ("gnu general public license", "either version 2 of the license",)),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
             ("this program is distributed in the hope that it will be useful",)),
    Template("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
             ("everyone is permitted to copy and distribute verbatim copies of this license document",)),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3",
             ("gnu lesser general public license version 3",)),
    Template("lgpl-3", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3",
             ("gnu lesser general public license", "either version 3",)),
    Template("lgpl-2-1", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1",
             ("gnu lesser general public license", "either version 2 1",)),
    Template("agpl-3", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3",
             ("gnu affero general public license", "either version 3",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
             ("redistributions of source code must retain the above copyright notice",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
             ("redistributions in binary form must reproduce the above copyright notice",)),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
             ("may be used to endorse or promote products derived from this software",)),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
             ("this software is provided by the copyright holders and contributors as is",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
             ("distribute this software for any purpose with or without fee is hereby granted",)),
    Template("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
             ("the author disclaims all warranties with regard to this software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
             ("in no event will the authors be held liable for any damages",)),
    Template("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
             ("the origin of this software must not be misrepresented",)),
    Template("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
             ("to any person or organization obtaining a copy of the software and accompanying documentation",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software",
             ("anyone is free to copy modify publish use compile sell or distribute this software",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license v 2 0",)),
    Template("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at",
             ("if a copy of the mpl was not distributed with this file",)),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
             ("eclipse public license 2 0",)),
    Template("cc0", "has waived all copyright and related or neighboring rights to",
             ("waived all copyright and related or neighboring rights",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
             ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
             ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution 4 0",)),
) + tuple(Template(label, f"spdx license identifier {tag}", (f"spdx license identifier {tag}",)) for tag, label in (
    ("mit", "mit"), ("apache 2 0", "apache-2"), ("gpl 2 0", "gpl-2"), ("gpl 3 0", "gpl-3"), ("lgpl 2 1", "lgpl-2-1"), ("lgpl 3 0", "lgpl-3"), ("agpl 3 0", "agpl-3"),
    ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("bsl 1 0", "bsl-1"), ("unlicense", "unlicense"), ("mpl 2 0", "mpl-2"),
    ("epl 2 0", "epl-2"), ("cc0 1 0", "cc0"), ("cc by nc 4 0", "cc-by-nc"), ("cc by sa 4 0", "cc-by-sa"), ("cc by 4 0", "cc-by")))
RARE = 3
MIN_SHARE = 0.6
#: Words that a text may add or drop before its words stand too far from their places.
SLACK = 6
#: Bytes to words: A-Z to a-z, ASCII that belongs to no word to a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _count_words(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        docs = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text)))
            docs += b.num_rows
        seen[b""] = docs
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], ["word", "docs"])
    return run


def idf(docs: DataFrame, templates: tuple[Template, ...]) -> dict[bytes, float]:
    """Inverse document frequency of every template word over all documents."""
    vocabulary = frozenset(w for t in templates for w in t.words.encode().split())
    parts = docs.select(text_of()).mapInArrow(_count_words(vocabulary), "word string, docs long")
    rows = {r["word"].encode(): r["n"] for r in parts.groupBy("word").agg(F.sum("docs").alias("n")).collect()}  # a row a template word
    n = rows.get(b"", 0)
    return {w: math.log((n + 1) / (rows.get(w, 0) + 1)) for w in vocabulary}


class Index:
    """Postings of each template's rarest words: word to (template, place)."""

    def __init__(self, templates: tuple[Template, ...], weights: dict[bytes, float], rare: int = RARE, min_share: float = MIN_SHARE):
        self.templates = [(t, t.words.encode().split(), [k.encode().split() for k in t.key]) for t in templates]
        self.weights, self.min_share = weights, min_share
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for i, (t, words, _) in enumerate(self.templates):
            order = sorted(set(words), key=lambda w: (-weights[w], w))[: 1 if t.base else rare]
            for place, w in enumerate(words):
                if w in order:
                    self.postings[w].append((i, place))
            self.needed.append(1 if t.base else min(2, len(order)))
        self.looked_up = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], dict[str, float]]:
        """Base places as (label, first word), and labels with their share of matching words.

        The rare words in the file are looked up, rarest first; their postings vote for
        a template at a relative position, and a position with enough votes is compared
        word for word. A notice needs its key phrases whole and most of its words; a base
        phrase needs every word. Texts may drop or add words, so neighbouring positions add
        up their votes, and words and key phrases may stand ``SLACK`` places off."""
        base: list[tuple[str, int]] = []
        found: dict[str, float] = {}
        have = self.looked_up.intersection(words)
        if not have:
            return base, found
        at = defaultdict(list)
        for k, w in enumerate(words):
            if w in have:
                at[w].append(k)
        votes: Counter = Counter()
        for w in sorted(have, key=lambda w: (-self.weights[w], w)):
            for i, place in self.postings[w]:
                for k in at[w]:
                    votes[i, k - place] += 1
        for i, start in votes:
            t, words_i, keys = self.templates[i]
            if t.base:
                if start >= 0 and words[start:start + len(words_i)] == words_i:
                    base.append((t.label, start))
                    found[t.label] = 1.0
                continue
            if sum(votes.get((i, start + d), 0) for d in range(-SLACK, SLACK + 1)) < self.needed[i]:
                continue
            window = words[max(0, start - SLACK):max(0, start) + len(words_i) + SLACK]
            if not all(any(window[j:j + len(k)] == k for j in range(len(window) - len(k) + 1)) for k in keys):
                continue
            same = sum(w in words[max(0, start + j - SLACK):max(0, start + j + SLACK + 1)] for j, w in enumerate(words_i))
            key_words = sum(map(len, keys))
            share = max(same, key_words) / len(words_i)
            if share >= self.min_share:
                found[t.label] = max(found.get(t.label, 0.0), min(1.0, share))
        return base, found


def _scan(index_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*index_of)
        for b in batches:
            out = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                words = words_of(text)
                base, found = index.scan(words)
                starts = [s for _, s in base]
                for c, v in zip(out, (len(words), len(base), min(starts, default=None), max(starts, default=None),
                                      ",".join(sorted({x for x, _ in base})), ",".join(sorted(found)), max(found.values(), default=0.0))):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return run


def scan(docs: DataFrame, *, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a found notice's words that stand where they
    should, 1 for a base phrase and 0 without a label. A null or empty text has no words
    and no labels; rows that repeat are scanned each for itself; a text of any length is scanned
    whole, its words in one pass. Templates that fit the same place all count, so labels do
    not compete; an empty table gives no row. Other columns are not looked at. The documents are read
    twice: for the document frequencies of the template words, and for the scan."""
    templates = (*base, *notices)
    weights = idf(docs, templates)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _scan((templates, weights)), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
