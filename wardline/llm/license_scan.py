"""Licence scan: a generalised suffix automaton of licence words, matching statistics of streamed texts, chained spans.

Only stretches of at least two licence words are walked through the automaton. Matches of MIN_MATCH words or more are
chained per template in order of both text and template; a chain that covers enough of a template labels the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import LOWER, NON_ALNUM, Texts, Words, run_hash, slices, texts, words

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Passages of well-known licences and notices, with the label each gives.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license see license file for details"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "this work is licensed under cc by 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see https www gnu org licenses"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program if not see https www gnu org licenses"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    *((label, f"spdx license identifier {words}") for label, words in (("mit", "mit"), ("apache", "apache 2 0"), ("gpl", "gpl 2 0 only"), ("gpl", "gpl 2 0 or later"), ("gpl", "gpl 3 0 only"), ("gpl", "gpl 3 0 or later"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"), ("lgpl", "lgpl 2 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("lgpl", "lgpl 2 1 only"), ("lgpl", "lgpl 2 1 or later"), ("lgpl", "lgpl 3 0 only"), ("lgpl", "lgpl 3 0 or later"), ("agpl", "agpl 3 0 only"), ("agpl", "agpl 3 0 or later"), ("cc0", "cc0 1 0"), ("bsd", "0bsd"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"), ("mpl", "mpl 2 0"), ("cc-by", "cc by 4 0"), ("zlib", "zlib"), ("unlicense", "unlicense"))),
)

MIN_MATCH = 3
MIN_COVER = 0.7
#: A template of so few words must be there whole.
SHORT = 8
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,last_word:int,cover:double>>"


class Automaton(NamedTuple):
    """States of a generalised suffix automaton: transitions by word id, suffix link, longest length, and one end (template, place) of each."""

    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    ends: list[list[tuple[int, int]]]


def suffix_automaton(sequences: list[list[int]]) -> Automaton:
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    ends: list[list[tuple[int, int]]] = [[]]

    def state(size: int, moves: dict[int, int], to: int) -> int:
        nxt.append(moves)
        link.append(to)
        length.append(size)
        ends.append([])
        return len(link) - 1

    def split(p: int, c: int, q: int) -> int:
        """q's strings up to length[p] + 1 get a state of their own."""
        if length[q] == length[p] + 1:
            return q
        copy = state(length[p] + 1, dict(nxt[q]), link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    for k, sequence in enumerate(sequences):
        last = 0
        for place, c in enumerate(sequence):
            if c in nxt[last]:
                last = split(last, c, nxt[last][c])
            else:
                new, p = state(length[last] + 1, {}, 0), last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                link[new] = split(p, c, nxt[p][c]) if p >= 0 else 0
                last = new
            ends[last].append((k, place))
    for s in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):  # a suffix ends wherever its extension does
        if link[s] > 0:
            ends[link[s]] = sorted({*ends[link[s]], *ends[s]})
    return Automaton(nxt, link, length, ends)


class Licences(NamedTuple):
    """What a scan needs: sorted word hashes of the vocabulary, the automaton, and for each base phrase its state's key."""

    hashes: np.ndarray
    ids: np.ndarray
    gate: np.ndarray
    automaton: Automaton
    sizes: list[int]
    labels: list[str]
    phrases: dict[int, list[tuple[int, str]]]
    endings: list[list[tuple[int, int, int, int]]]


def template_endings(a: Automaton, sequences: list[list[int]]) -> list[list[tuple[int, int, int, int]]]:
    """For each state every (template, place, length, next word) at which a match that has come to this state ends in a template.

    A template's longest match may be a suffix of the state's strings: then its length is that of the suffix's state; 0 stands for the match as it is.
    """
    out: list[list[tuple[int, int, int, int]]] = []
    for s in range(len(a.link)):
        seen: set[tuple[int, int]] = set()
        own = []
        u = s
        while u > 0 and a.length[u] >= MIN_MATCH:
            for t, place in a.ends[u]:
                if (t, place) not in seen:
                    seen.add((t, place))
                    own.append((t, place, 0 if u == s else a.length[u], sequences[t][place + 1] if place + 1 < len(sequences[t]) else -1))
            u = a.link[u]
        out.append(own)
    return out


def compile_licences(phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Licences:
    lines = [*((label, text) for text, label in phrases.items()), *templates]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, text in lines for w in text.split()}))}
    encoded = [w.encode() for w in vocabulary]
    end = np.cumsum([len(w) for w in encoded])
    h = run_hash(np.frombuffer(b"".join(encoded), np.uint8), end - [len(w) for w in encoded], end)
    order = np.argsort(h)
    gate = np.zeros(1 << 16, bool)
    gate[(h & np.uint64(0xFFFF)).astype(int)] = True
    sequences = [[vocabulary[w] for w in text.split()] for _, text in lines]
    automaton = suffix_automaton(sequences)
    found: dict[int, list[tuple[int, str]]] = {}
    for sequence, label in zip(sequences, phrases.values(), strict=False):
        s = 0
        for c in sequence:
            s = automaton.next[s][c]
        found.setdefault(s, []).append((len(sequence), label))
    return Licences(h[order], order, gate, automaton, [len(s) for s in sequences], [label for label, _ in lines], found, template_endings(automaton, sequences))


def word_ids(h: np.ndarray, licences: Licences) -> np.ndarray:
    """Vocabulary ids of words, -1 for others."""
    out = np.full(len(h), -1, np.int64)
    maybe = np.flatnonzero(licences.gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(licences.hashes, h[maybe]), len(licences.hashes) - 1)
    right = licences.hashes[at] == h[maybe]
    out[maybe[right]] = licences.ids[at[right]]
    return out


class Found(NamedTuple):
    base: list[tuple[int, str]]
    matches: list[tuple[int, int, int, int]]


def matching_statistics(ids: list[int], first: int, licences: Licences, found: Found) -> None:
    """Walks one stretch of licence words that starts at word `first`; adds base phrases (start, label) and matches (template, its place, word, length).

    The statistics are each template's own: a match is given where the template it lies in does not go on with the next word, whether others do or not.
    """
    a = licences.automaton
    s = size = 0
    for k, c in enumerate([*ids, -2]):
        if size >= MIN_MATCH:
            for t, place, shorter, goes_on in licences.endings[s]:
                if goes_on != c:
                    n = shorter or size
                    found.matches.append((t, place - n + 1, first + k - n, n))
        while s and c not in a.next[s]:
            s = a.link[s]
            size = a.length[s]
        if c in a.next[s]:
            s, size = a.next[s][c], size + 1
        up = s
        while up > 0:
            for n, label in licences.phrases.get(up, ()):
                if n <= size:
                    found.base.append((first + k - n + 1, label))
            up = a.link[up]


def chains(matches: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """Best spans (template, first word, last word, share of the template covered): matches in the order of both sides, with gaps below the template's length."""
    out = []
    for t in {m[0] for m in matches}:
        own = sorted({(word, place, n) for k, place, word, n in matches if k == t})
        best: list[tuple[int, int]] = []
        low = 0
        for i, (word, place, n) in enumerate(own):
            got, start = n, word
            while own[low][0] < word - 2 * sizes[t]:  # a match and the gap after it are at most a template each
                low += 1
            for j in range(low, i):
                w2, p2, n2 = own[j]
                over = max(0, w2 + n2 - word, p2 + n2 - place)
                if w2 < word and p2 < place and word - w2 - n2 <= sizes[t] and over < n and best[j][0] + n - over > got:
                    got, start = best[j][0] + n - over, best[j][1]
            best.append((got, start))
        for (word, _, n), (got, start) in zip(own, best, strict=True):
            if got >= (MIN_COVER * sizes[t] if sizes[t] > SHORT else sizes[t]):
                out.append((t, start, word + n - 1, min(1.0, got / sizes[t])))
    return out


def scan_rows(t: Texts, w: Words, licences: Licences) -> Iterator[tuple]:
    """n_words, base places, and spans of each row."""
    ids = word_ids(w.hash, licences)
    row = w.rows()
    known = ids >= 0
    joined = np.zeros(len(ids), bool)
    joined[1:] = known[1:] & known[:-1] & (row[1:] == row[:-1])
    begins = np.flatnonzero(known & ~joined & np.append(joined[1:], False))
    stops = np.flatnonzero(joined & ~np.append(joined[1:], False)) + 1
    by_row: dict[int, Found] = {}
    for lo, hi in zip(begins.tolist(), stops.tolist(), strict=True):
        r = int(row[lo])
        matching_statistics(ids[lo:hi].tolist(), lo - int(w.first[r]), licences, by_row.setdefault(r, Found([], [])))
    for r in range(len(w.first) - 1):
        got = by_row.get(r)
        yield int(w.first[r + 1] - w.first[r]), got.base if got else [], chains(got.matches, licences.sizes) if got and got.matches else []


def license_scan(docs: DataFrame, licences: Licences | None = None) -> DataFrame:
    """One row per row of docs: the base phrases' places and labels, the method's labels, its spans and a score.

    score is the largest share of a template or base phrase that a span covers, 0 if there is none. Null and empty texts
    have no words and no labels ("" and null places). Texts of any length are walked whole. Of spans that tie every one is given, in
    order of their words, and labels are a set. Repeated rows give repeated results; an empty table none; other columns are ignored.
    """
    compiled = licences or compile_licences()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = texts(part.column("text"))
                t = Texts(LOWER[t.data], t.offsets)
                out = []
                for doc, (n, base, spans) in zip(part.column("doc_id").to_pylist(), scan_rows(t, words(t, NON_ALNUM), compiled), strict=True):
                    labels = {label for _, label in base}
                    places = [p for p, _ in base]
                    named = [{"label": compiled.labels[k], "first_word": a, "last_word": b, "cover": c} for k, a, b, c in sorted(spans, key=lambda s: s[1:3])]
                    score = max([float(bool(base)), *(s["cover"] for s in named)])
                    out.append((doc, n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s["label"] for s in named})), score, named))
                span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("cover", pa.float64())]))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
                names = [c.split()[0] for c in SCHEMA.split(", ")[:8]] + ["spans"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
