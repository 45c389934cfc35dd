"""License scan: patience alignment of texts with license templates."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from contestlake.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Notices and opening paragraphs of public licenses.
_GNU_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, "
               "either version {1} of the License, or (at your option) any later version.")
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_GNU = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
_GNU_VERSIONS = [("gpl", "2", "2.0"), ("gpl", "3", "3.0"), ("lgpl", "2.1", "2.1"), ("lgpl", "3", "3.0"), ("agpl", "3", "3.0")]
_CC = [f"{kind} {version}" for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("3.0", "4.0")]
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "bsd": _BSD,
    **{f"cc-{x.lower().replace(' ', '-')}": f"Licensed under CC {x}." for x in _CC},
    "cc0-1.0": "Licensed under CC0 1.0.",
    **{f"{kind}-{of}": f"This work is licensed under the GNU {_GNU[kind]}, version {n}." for kind, n, of in _GNU_VERSIONS},
    **{f"{kind}-{of}-header": _GNU_HEADER.format(_GNU[kind], n) for kind, n, of in _GNU_VERSIONS},
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Phrases that tell a template from its siblings: each must be in the place, with nothing inserted.
PHRASES = {
    "apache-2.0": ["Apache License, Version 2.0"], "mit": ["MIT License"], "cc0-1.0": ["CC0 1.0"], "mpl-2.0": ["Mozilla Public License, v. 2.0"],
    **{f"cc-{x.lower().replace(' ', '-')}": [f"CC {x}"] for x in _CC},
    **{f"{kind}-{of}": [f"GNU {_GNU[kind]}, version {n}"] for kind, n, of in _GNU_VERSIONS},
    **{f"{kind}-{of}-header": [f"GNU {_GNU[kind]}", f"version {n} of the License"] for kind, n, of in _GNU_VERSIONS},
}
#: Share of a template's words that must be aligned; words around an anchor that may belong to it, per template word.
COVERED, SPREAD = 0.8, 2

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """UTF-8 of the same length with A to Z in lower case and every other ASCII mark as a space."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (of a, of b), ascending in both.

    Equal ends are aligned first.  What is left is anchored on the words that occur once on each side: the longest
    run of anchors that ascends on both sides stays, and the gaps between anchors are aligned the same way.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        times_a, times_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(b[k:m], k) if times_b[w] == 1}
        anchors = [(x, place[w]) for x, w in enumerate(a[i:j], i) if times_a[w] == 1 and w in place]
        if not anchors:
            continue
        kept = ascending(anchors)
        edges = [(i - 1, k - 1), *kept, (j, m)]
        out += kept
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if p + 1 < q and r + 1 < s]
    return sorted(out)


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, given by ascending first place, that also ascends in the second."""
    tops, ends, back = [], [], []
    for x, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            ends.append(x)
        else:
            tops[at], ends[at] = y, x
    out, x = [], ends[-1] if ends else -1
    while x >= 0:
        out.append(pairs[x])
        x = back[x]
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], covered: float = COVERED, phrases: dict[str, list[str]] | None = None):
        self.covered = covered
        self.phrases = {name: [plain(p).split() for p in found] for name, found in (phrases or {}).items()}
        self.templates = {name: plain(text).split() for name, text in sorted(templates.items())}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of every place, in code points, by start.

        An alignment that covers the wanted share leaves out few template words, so of one more than these at least
        one is aligned: the rarest ones of the text are tried at each of their occurrences.  A place must have the phrases
        of its template; of templates whose places overlap the one with the most aligned words stays, then the one of
        the largest coverage.
        """
        if not text:
            return []
        line = plain(text)
        words = line.split()
        present = set(words)
        out, places = [], None
        for name, template in self.templates.items():
            n = len(template)
            spare = int(n * (1 - self.covered) + 1e-9)
            if sum(w in present for w in template) < n - spare:
                continue
            if places is None:
                wanted = {w for t in self.templates.values() for w in t}
                places = {}
                for x, w in enumerate(words):
                    if w in wanted:
                        places.setdefault(w, []).append(x)
            rare = sorted(range(n), key=lambda k: len(places.get(template[k], ())))[:spare + 1]
            taken = -1
            best = []
            for x, k in sorted((x, k) for k in rare for x in places.get(template[k], ())):
                if x <= taken:
                    continue
                lo, hi = max(taken + 1, x - SPREAD * n), x + SPREAD * n + 1
                left = self._towards(words[lo:x], template[:k])
                right = patience(words[x + 1:hi], template[k + 1:])
                if (len(left) + 1 + len(right)) >= n - spare:
                    first = lo + left[0][0] if left else x
                    last = x + 1 + right[-1][0] if right else x
                    if not all(self._within(words, first, last, p) for p in self.phrases.get(name, ())):
                        continue
                    best.append(((len(left) + 1 + len(right)) / n, first, last))
                    taken = last
            out += [(name, c, first, last) for c, first, last in best]
        return self._placed(text, line, self._winners(out)) if out else []

    @staticmethod
    def _within(words: list, first: int, last: int, phrase: list) -> bool:
        """Whether the phrase, with nothing inserted, lies between two places."""
        n = len(phrase)
        return any(words[x:x + n] == phrase for x in range(first, last - n + 2))

    def _winners(self, found: list) -> list:
        """Places that overlap no better place of another template."""
        aligned = lambda f: round(f[1] * len(self.templates[f[0]]))
        kept: list = []
        for f in sorted(found, key=lambda f: (-aligned(f), -f[1], f[2], f[0])):
            if all(f[3] < k[2] or f[2] > k[3] for k in kept):
                kept.append(f)
        return kept

    @staticmethod
    def _towards(words: list, template: list) -> list[tuple[int, int]]:
        """Alignment that prefers what lies next to the anchor: patience from the right."""
        n, m = len(words), len(template)
        return sorted((n - 1 - i, m - 1 - k) for i, k in patience(words[::-1], template[::-1]))

    @staticmethod
    def _placed(text, line, found):
        starts, ends, at, chars, seen = {}, {}, 0, 0, 0
        needed = {x for _, _, a, b in found for x in (a, b)}
        last = max(needed)
        raw = text.encode("utf-8", "surrogatepass")
        for x, word in enumerate(line.split()[:last + 1]):
            at = line.index(word, at)
            if x in needed:
                chars += len(raw[seen:at].decode("utf-8", "surrogatepass"))
                seen = at
                starts[x], ends[x] = chars, chars + len(raw[at:at + len(word)].decode("utf-8", "surrogatepass"))
            at += len(word)
        return sorted(((name, c, starts[a], ends[b]) for name, c, a, b in found), key=lambda r: (r[2], r[3], r[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", doc_id: str = "doc_id", covered: float = COVERED) -> DataFrame:
    """doc_id, license (of the largest coverage, the first of equals), coverage, n_found, places.

    ``places`` lists license:start:end in code points, comma-joined, by start.  A text that is null or has no
    license has nulls, 0 and an empty list.  Every whole text is scanned where it is; no shuffle.
    """
    given = templates or TEMPLATES
    cache: list[Scanner] = []

    def make(batch):
        if not cache:
            cache.append(Scanner(given, covered, None if templates else PHRASES))
        rows = [cache[0].scan(t) for t in batch.column(0).to_pylist()]
        top = [max(r, key=lambda f: (f[1], -f[2], f[0])) if r else (None, 0.0) for r in rows]
        return [pa.array([t[0] for t in top], pa.string()), pa.array([float(t[1]) for t in top], pa.float64()), pa.array([len(r) for r in rows], pa.int64()),
                pa.array([",".join(f"{n}:{a}:{b}" for n, _, a, b in r) for r in rows], pa.string())]

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.append(slim, ["text"], "license string, coverage double, n_found long, places string", make, ["doc_id"])
