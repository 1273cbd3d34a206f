"""License scans: a positional index over the words of licence texts.

The templates' words are weighted by inverse document frequency over the templates; every word has its postings (template,
position). A template comes into question if its mandatory phrases stand in the text. Then the text's own words of it that weigh most,
``RAREST`` different ones, are looked up, and their postings are intersected by relative position - place in the text minus
place in the template. An alignment with enough of them is taken if the mandatory phrases stand inside of it. A label needs no
base phrase to be found that way. The score is the weight of the template's words that stand where they should, of the best
alignment, and one half at least where a base phrase stands.

Null text is empty text: no words, no labels, score 0. Each row is scanned for itself, so repeated rows give equal results; long texts are
scanned whole. Words of equal weight are taken in their own order. The result has the id and the named columns
alone, so other columns don't matter. No rows give no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, record_batch, text_bytes

# Phrases of the base scan, template sentences and their mandatory phrases.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", ("permission is hereby granted free of charge", "without restriction")),
    ("mit", "released under the MIT license", ("mit license",)),
    ("mit-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction. MIT No Attribution", ("mit no attribution",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "with or without fee is hereby granted", "appear in all copies")),
    ("apache", "licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "in compliance with the license")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("free software foundation", "gnu general public license")),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("free software foundation", "gnu general public license")),
    ("gpl", "this work is licensed under the GNU General Public License version 3", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("free software foundation", "gnu lesser general public license")),
    ("lgpl", "GNU Lesser General Public License version 3", ("lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("free software foundation", "gnu affero general public license")),
    ("agpl", "GNU Affero General Public License version 3", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", ("any person or organization obtaining a copy", "prepare derivative works")),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("permission is granted to anyone to use this software", "redistribute it freely")),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software", "public domain")),
    ("artistic", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package", ("semblance of artistic control",)),
    ("cc0", "has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal", ("cc0 1 0 universal",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("commons attribution 4 0",)),
    ("cc-by", "licensed under CC BY 4.0", ("under cc by 4 0",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 3.0 Unported License", ("commons attribution 3 0",)),
    ("cc-by", "licensed under CC BY 3.0", ("under cc by 3 0",)),
    ("cc-by", "License: CC BY 4.0", ("license cc by 4 0",)),
    ("cc-by", "creativecommons.org/licenses/by/4.0", ("creativecommons org licenses by 4 0",)),
    ("cc-by", "creativecommons.org/licenses/by/3.0", ("creativecommons org licenses by 3 0",)),
    ("cc-by-sa", "creativecommons.org/licenses/by-sa/4.0", ("creativecommons org licenses by sa",)),
    ("cc-by-nc", "creativecommons.org/licenses/by-nc/4.0", ("creativecommons org licenses by nc 4 0",)),
    ("cc-by-nc-sa", "creativecommons.org/licenses/by-nc-sa/4.0", ("creativecommons org licenses by nc sa",)),
    ("cc-by-nd", "creativecommons.org/licenses/by-nd/4.0", ("creativecommons org licenses by nd",)),
    ("cc0", "creativecommons.org/publicdomain/zero/1.0", ("creativecommons org publicdomain zero",)),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation", ("gnu free documentation license",)),
    ("lgpl", "GNU Library General Public License version 2", ("gnu library general public license",)),
    ("epl", "Eclipse Public License - v 2.0. The accompanying program is provided under the terms of this Eclipse Public License (\"Agreement\")", ("terms of this eclipse public license",)),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("apache", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later", ("spdx license identifier gpl",)),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later", ("spdx license identifier lgpl",)),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later", ("spdx license identifier agpl",)),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause", ("spdx license identifier bsd",)),
    ("isc", "SPDX-License-Identifier: ISC", ("spdx license identifier isc",)),
    ("mpl", "SPDX-License-Identifier: MPL-2.0", ("spdx license identifier mpl 2 0",)),
    ("epl", "SPDX-License-Identifier: EPL-2.0", ("spdx license identifier epl 2 0",)),
    ("unlicense", "SPDX-License-Identifier: Unlicense", ("spdx license identifier unlicense",)),
    ("cc0", "SPDX-License-Identifier: CC0-1.0", ("spdx license identifier cc0 1 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ("attribution noncommercial sharealike",)),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0", ("cc by nc sa",)),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("attribution noderivatives",)),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ("cc by nd",)),
)
RAREST = 6
#: An alignment's share of its looked-up words.
LEAST_SHARE = 0.6

#: A-Z to a-z; other ASCII that isn't a letter or digit to a space; bytes of other characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(data: bytes) -> bytes:
    """The text's words, one space between them and one at either end."""
    return b" " + b" ".join(data.translate(_WORDS).split()) + b" "


class Index:
    def __init__(self, templates=TEMPLATES):
        self.templates = [(label, words_of(t.encode()).split(), [words_of(p.encode()) for p in phrases]) for label, t, phrases in templates]
        df = Counter(w for _, words, _ in self.templates for w in set(words))
        self.idf = {w: math.log(1 + len(self.templates) / c) for w, c in df.items()}
        #: Of each template, its words from the heaviest on, and the places of each.
        self.ranked = [sorted(set(words), key=lambda w: (-self.idf[w], w)) for _, words, _ in self.templates]
        self.postings: list[dict[bytes, list[int]]] = []
        for _, words, _ in self.templates:
            places = defaultdict(list)
            for p, w in enumerate(words):
                places[w].append(p)
            self.postings.append(dict(places))
        self.base = [(f" {p} ".encode(), label) for p, label in BASE_PHRASES]

    def alignments(self, words: list[bytes], t: int, where: dict[bytes, list[int]]) -> list[int]:
        """Shifts at which enough of the text's heaviest words of the template stand where they should."""
        chosen, votes = [], Counter()
        for w in self.ranked[t]:
            if w in where:
                chosen.append(w)
                if len(chosen) == RAREST:
                    break
        for w in chosen:
            # a word counts once for an alignment, however often it stands in the template
            votes.update({place - p for p in self.postings[t][w] for place in where[w]})
        return sorted(s for s, n in votes.items() if n >= LEAST_SHARE * len(chosen) and n >= min(2, len(self.ranked[t])))

    def scan(self, data: bytes) -> dict:
        joined = words_of(data)
        words = joined.split()
        out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0}
        spaces: list[int] = []

        def word_at(place: int) -> int:
            """The number of the word after the space at ``place``."""
            if not spaces:
                spaces.extend(i for i, b in enumerate(joined) if b == 32)
            return bisect_right(spaces, place) - 1

        starts = []
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                starts.append(word_at(at))
                out["base"].add(label)
                at = joined.find(phrase, at + 1)
        if starts:
            out |= {"n_base": len(starts), "first_word": min(starts), "last_word": max(starts)}
        near_all = [t for t, (_, _, phrases) in enumerate(self.templates) if all(p in joined for p in phrases)]
        where: dict[bytes, list[int]] = {}
        if near_all:
            wanted = set().union(*(self.postings[t] for t in near_all))
            for place, w in enumerate(words):
                if w in wanted:
                    where.setdefault(w, []).append(place)
        for t in near_all:
            label, template, phrases = self.templates[t]
            for shift in self.alignments(words, t, where):
                near = b" " + b" ".join(words[max(0, shift) : max(0, shift + len(template))]) + b" "
                if all(p in near for p in phrases):
                    same = sum(self.idf[w] for k, w in enumerate(template) if 0 <= shift + k < len(words) and words[shift + k] == w)
                    out["labels"].add(label)
                    out["score"] = max(out["score"], min(1.0, same / sum(self.idf[w] for w in template)))
        if starts:
            out["score"] = max(out["score"], 0.5)
        return out


_index: dict = {}


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score."""
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        if templates not in _index:
            _index[templates] = Index(templates)
        found = [_index[templates].scan(data) for data in text_bytes(batch, text_col)]
        return record_batch(**{
            id_col: batch.column(0),
            **{c: pa.array([x[c] for x in found], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")},
            "base_labels": pa.array([sorted(x["base"]) for x in found], pa.list_(pa.string())),
            "labels": pa.array([sorted(x["base"] | x["labels"]) for x in found], pa.list_(pa.string())),
            "score": pa.array([x["score"] for x in found], pa.float64()),
        })

    return map_batches(df.select(id_col, text_col), scan, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double")
