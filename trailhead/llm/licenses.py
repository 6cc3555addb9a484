"""License scans: winnowed template fingerprints in an inverted index, then banded alignment of words."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailhead.llm.common import named
from trailhead.llm.textops import parts, runs, tidy, word_hashes

# Opening sentences of well-known license notices.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Whole texts of short licenses, without titles and copyright lines.
TEXTS = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: Bytes between words: all ASCII but letters and digits.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Positions of the smallest hash of every window of that many hashes, the rightmost of equals (Schleimer et al. 2003)."""
    if len(hashes) <= window:
        return list(range(len(hashes)))
    return sorted({i + window - 1 - int(np.argmin(hashes[i : i + window][::-1])) for i in range(len(hashes) - window + 1)})


class Index:
    """Template words and the inverted indexes from fingerprint to (template, word position), by the fingerprints' width in words: k, or
    all of a template that has fewer words."""

    def __init__(self, templates: dict[str, str], k: int, window: int):
        self.names = sorted(templates)
        self.words = [word_hashes(templates[n], _BREAK) for n in self.names]
        posts: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, words in enumerate(self.words):
            grams = runs(words, k)
            for i in winnow(grams, window):
                posts.setdefault(min(k, len(words)), {}).setdefault(int(grams[i]), []).append((t, i))
        self.widths = [(width, np.array(sorted(found), np.uint64), found) for width, found in posts.items()]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(matched, first, last) of the longest common subsequences within the diagonals words = template + low .. template + high:
    template words matched in order, the first and the last matched word's place in words. Only the most matched
    are listed, each of their latest first places once, with its tightest span."""
    n = len(template)
    low, high = max(low, 1 - n), min(high, len(words) - 1)
    width = high - low + 1
    if width < 1:
        return []
    none = (0, -1, -1)
    prev = [none] * width  # matched words, first and last place
    for i in range(n):
        row: list[tuple[int, int, int]] = []
        left = none
        for c in range(width):
            j = i + low + c
            up = prev[c + 1] if c + 1 < width else none
            best = up if (up[0], up[1]) >= (left[0], left[1]) else left
            if 0 <= j < len(words) and template[i] == words[j]:
                m, first, _ = prev[c]
                new = (m + 1, j if m == 0 else first, j)
                if (new[0], new[1]) >= (best[0], best[1]):
                    best = new
            row.append(best)
            left = best
        prev = row
    most, ends = max(x[0] for x in prev), {}
    for m, first, last in prev:
        if m == most and last < ends.get(first, len(words)):
            ends[first] = last
    return [(most, a, b) for a, b in ends.items()]


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (matched, first, last) that share no word, in order: those with the most matched words first, then the shortest."""
    out: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for x in sorted(set(spans), key=lambda x: (-x[0], x[2] - x[1], x[1])):
        at = bisect.bisect(starts, x[1])
        if (not at or out[at - 1][2] < x[1]) and (at == len(out) or out[at][1] > x[2]):
            starts.insert(at, x[1])
            out.insert(at, x)
    return out


def spans_in(template: np.ndarray, words: np.ndarray, low: int, high: int, need: float, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Spans within words[lo:hi] and the diagonals low .. high with at least need matched words, none sharing a word: the best, then what lies between them."""
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < need:
            continue
        found = [(m, a + lo, b + lo) for m, a, b in align(template, words[lo:hi], low - lo, high - lo) if m >= need]
        if not found:
            continue
        found = apart(found)
        out += found
        edges = [lo, *[x for _, a, b in found for x in (a, b + 1)], hi]
        todo += list(zip(edges[::2], edges[1::2], strict=True))
    return out


def occurrences(template: np.ndarray, words: np.ndarray, shifts: list[int], band: int, least: float) -> list[tuple[int, int, int]]:
    """(matched, first, last) of every occurrence of a template near some diagonals, none sharing a word.

    Diagonals whose bands meet are searched as one band, so words may be put in or left out at many places as long as no
    single place moves the rest by more than two bands. Where a wide band's span holds several narrow ones, these are the occurrences.
    """
    shifts, need, found = sorted(shifts), least * len(template), []
    cuts = [0, *[i for i in range(1, len(shifts)) if shifts[i] - shifts[i - 1] > 2 * band], len(shifts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        near = shifts[lo:hi]
        low, high = near[0] - band, near[-1] + band
        for m, a, b in spans_in(template, words, low, high, need, max(0, low), min(len(words), high + len(template))):
            narrow = []
            if len(near) > 1 and b - a + 1 >= 2 * need:
                mine = near[bisect.bisect_left(near, a - len(template) - band) : bisect.bisect(near, b + band)]
                narrow = apart([x for s in mine for x in spans_in(template, words, s - band, s + band, need, a, b + 1)])
            found += narrow if len(narrow) > 1 else [(m, a, b)]
    return apart(found)


def scan_text(text: str | None, index: Index, band: int, least: float) -> list[tuple]:
    """(template, matched words, template words, coverage, first character, end character) of each occurrence."""
    words, start, end = word_hashes(text, _BREAK, spans=True)
    if not len(words):
        return []
    votes: dict[int, set[int]] = {}
    for width, prints, posts in index.widths:
        if len(words) < width:
            continue
        grams = runs(words, width)
        at = np.searchsorted(prints, grams)
        at[at == len(prints)] = 0
        for j in np.flatnonzero(prints[at] == grams).tolist():
            for t, i in posts[int(grams[j])]:
                votes.setdefault(t, set()).add(j - i)
    if not votes:
        return []
    data, found = (text or "").encode("utf-8", "surrogatepass"), []
    for t, shifts in votes.items():
        need = len(index.words[t])
        for m, first, last in occurrences(index.words[t], words, list(shifts), band, least):
            a, b = len(data[: start[first]].decode("utf-8", "ignore")), len(data[: end[last]].decode("utf-8", "ignore"))
            found.append((index.names[t], m, need, m / need, a, b))
    return sorted(found, key=lambda x: (x[4], x[5], x[0]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, k: int = 5, window: int = 4, band: int = 8, least: float = 0.8) -> DataFrame:
    """One row per template found in a whole text: key, license, n_matched, n_template, coverage, span_start, span_end
    (characters of the text, end exclusive), matched_text.

    Templates are a bounded parameter and travel with the function, so the scan is one narrow pass. All runs of k words of
    the text are looked up, so each stretch of k + window - 1 words shared with a template is found whatever follows;
    a template of fewer than k words is found where all its words follow one another. An occurrence is reported when at least the share ``least`` of the template's words align in order. All occurrences are reported,
    repeats of one template beside one another included; those of one template share no word.
    Null and empty texts, and tables without rows, give no rows. Rows repeating a key are scanned each. The result has the
    columns named here only; df's other columns aren't read.
    """
    made = templates or TEMPLATES | TEXTS
    kinds = [("license", pa.string(), "string"), ("n_matched", pa.int32(), "integer"), ("n_template", pa.int32(), "integer"), ("coverage", pa.float64(), "double"), ("span_start", pa.int64(), "long"), ("span_end", pa.int64(), "long"), ("matched_text", pa.string(), "string")]
    schema = df.select(named(key)).schema
    for name, _, kind in kinds:
        schema = schema.add(name, kind)

    def run(batches):
        index = Index(made, k, window)
        for part, texts in parts(batches, 1):
            found = [(n, (*r, t[r[4] : r[5]])) for n, t in enumerate(texts) for r in scan_text(t, index, band, least)]
            if found:
                keys = part.column(0).take(pa.array([n for n, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[i] for _, r in found], kind) for i, (_, kind, _) in enumerate(kinds))], schema.names)

    return df.select(named(key), named(text)).mapInArrow(tidy(run), schema)
