"""License texts in documents by patience alignment with templates."""

from __future__ import annotations

import bisect
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ALPHANUMERIC, LOWER, Hasher, per_document, text_blocks, words

#: One-line notices, by license.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
]

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at http://mozilla.org/MPL/2.0/."""
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_GNUS = [
    ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
]
_CREATIVE = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_COMMONS = [(parts, version) for parts in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("3.0", "4.0")]

#: Usual headers and notices, by license.
HEADERS: list[tuple[str, str]] = [
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", _MPL),
    *((name, f"{_GNU.format(title)}; either version {v} of the License, or (at your option) any later version.") for name, title, v in _GNUS),
    *((name, f"{_GNU.format(title)}; version {v} of the License.") for name, title, v in _GNUS),
    *((name, f"This work is licensed under the GNU {title}, version {v}.") for name, title, v in _GNUS if name != "GPL-3.0"),
    *((f"CC-{x}-{v}", f"Licensed under CC {x} {v}.") for x, v in _COMMONS if (x, v) not in (("BY", "4.0"), ("BY-NC", "4.0"))),
    *((f"CC-{x}-{v}", f"This work is licensed under a Creative Commons {'-'.join(_CREATIVE[k] for k in x.split('-'))} {v} {'International' if v == '4.0' else 'Unported'} License.") for x, v in _COMMONS),
]

#: Names by which one-line notices call a license.
_CALLED = [
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License 2.0"), *((name, f"GNU {title}, version {v}") for name, title, v in _GNUS),
]
_IDENTIFIERS = "MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-1.1 MPL-2.0 Unlicense CC0-1.0 Artistic-1.0".split()

#: One-line notices by name and by identifier.
LINES: list[tuple[str, str]] = [
    *((name, f"Licensed under the {called}.") for name, called in _CALLED if name != "MIT"),
    *((name, f"SPDX-License-Identifier: {name}") for name in _IDENTIFIERS),
    *((name, f"SPDX-License-Identifier: {name}{which}") for name, _, _ in _GNUS for which in ("-only", "-or-later")),
    *((f"CC-{x}-{v}", f"SPDX-License-Identifier: CC-{x}-{v}") for x, v in _COMMONS),
]

#: Licenses whose full text lies in the folder license_texts.
FULL = "Apache-2.0 Artistic-1.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MPL-1.1 MPL-2.0 Unlicense".split()


def production() -> list[tuple[str, str, str]]:
    """(license, text, words that must match) of all notices, headers and full texts: a notice counts only with the words of the license's
    name that it holds (such as `mit`, `nc` or a version). The Affero text is that of GPL-3.0 under its own name."""
    full = [(name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in FULL]
    affero = re.sub(r"(?i)(GNU)(\s+)(General\s+Public\s+License)", r"\1 Affero\2\3", dict(full)["GPL-3.0"])
    notices = [(name, text, f"{name} affero" if name.startswith("AGPL") else name) for name, text in (*TEMPLATES, *HEADERS, *LINES)]
    return [*notices, *((name, text, "") for name, text in (*full, ("AGPL-3.0", affero)))]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, given by first place, whose second places increase too (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, second) in enumerate(pairs):
        at = bisect.bisect_left(tops, second)
        before[k] = piles[at - 1] if at else -1
        tops[at : at + 1] = [second]
        piles[at : at + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence (a bit per template word, one integer per text word)."""
    every = (1 << len(template)) - 1
    where: dict[int, int] = {}
    for k, w in enumerate(template):
        where[w] = where.get(w, 0) | 1 << k
    rows, bits = [], every
    for w in text:
        some = bits & where.get(w, 0)
        bits = ((bits + some) | (bits - some)) & every
        rows.append(bits)
    out, i, j = [], len(text), len(template)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places of two word sequences. Words that occur once in each are anchors, of which a longest increasing
    run is kept; the gaps between these are aligned alike. A gap without anchors matches equal words from each end that stands at an anchor,
    or from both where there is none, and a longest common subsequence of the rest.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        if a >= b or c >= d:
            continue
        places: dict[int, int] = {}
        for k in range(a, b):
            places[text[k]] = -1 if text[k] in places else k
        own: dict[int, int] = {}
        for k in range(c, d):
            own[template[k]] = -1 if template[k] in own else k
        anchors = increasing(sorted((places[w], k) for w, k in own.items() if k >= 0 and places.get(w, -1) >= 0))
        if not anchors:
            ahead, behind = a > 0 or b == len(text), b < len(text) or a == 0
            while ahead and a < b and c < d and text[a] == template[c]:
                out.append((a, c))
                a, c = a + 1, c + 1
            while behind and a < b and c < d and text[b - 1] == template[d - 1]:
                b, d = b - 1, d - 1
                out.append((b, d))
            if not ahead:  # of equal words those nearest to the anchor
                out += [(b - 1 - i, d - 1 - j) for i, j in common(text[a:b][::-1], template[c:d][::-1])]
            else:
                out += [(a + i, c + j) for i, j in common(text[a:b], template[c:d])]
            continue
        out += anchors
        for (i, j), (x, y) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            work.append((i + 1, x, j + 1, y))
    return sorted(out)


#: So many words between the matched ones cost as much as one matched word is worth.
FOREIGN = 4


def candidates(places: list[int], text: list[int], template: list[int], least: int, reach: int) -> list[tuple[int, int]]:
    """Disjoint stretches [a, b) of template words: all windows of `reach` words that hold `least` of the template's words, each
    counted as often as the template has it at most."""
    counts = Counter(template)
    held = dict.fromkeys(counts, 0)
    out: list[tuple[int, int]] = []
    a = shared = 0
    for k, (place, word) in enumerate(zip(places, text)):
        held[word] += 1
        shared += held[word] <= counts[word]
        while place - places[a] >= reach:
            shared -= held[text[a]] <= counts[text[a]]
            held[text[a]] -= 1
            a += 1
        if shared >= least:
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], k + 1
            else:
                out.append((a, k + 1))
    return out


def heaviest(matched: list[tuple[int, int]], places: list[int]) -> tuple[int, int, int]:
    """(score, first, last): the run of matched pairs that scores most: FOREIGN for each, less one for each other word between them."""
    best, now, begin = (0, 0, -1), 0, 0
    for k, (i, _) in enumerate(matched):
        if k:
            now -= places[i] - places[matched[k - 1][0]] - 1
        if now <= 0:
            now, begin = 0, k
        now += FOREIGN
        if now > best[0]:
            best = now, begin, k
    return best


def anchored(places: list[int], text: list[int], template: list[int], needed: int, reach: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Disjoint spans that score `needed`, as (first place, place after the last, matched places): windows of `reach` words, beginning an eighth of the
    template apart, are aligned with the template by patience (`align`), and the heaviest run of matched words is the window's span. The best of the
    windows that begin before it ends is taken, and the search goes on behind it."""
    step, whole = max(1, len(template) // 8), FOREIGN * len(template)
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    k, best = 0, None
    while k < len(places) or best:
        if best and (k >= len(places) or places[k] >= best[2] or best[0] == whole):
            out.append(best[1:])
            k, best = bisect.bisect_left(places, best[2]), None
            continue
        end = bisect.bisect_left(places, places[k] + reach)
        matched = [(k + i, j) for i, j in align(text[k:end], template)]
        score, first, last = heaviest(matched, places)
        if score >= needed:
            run = matched[first : last + 1]
            start = places[run[0][0]]
            if best and start >= best[2]:
                out.append(best[1:])
                best = None
            if not best or score > best[0]:
                best = score, start, places[run[-1][0]] + 1, run
        k += step
    return out


def missed(places: list[int], spans: list[tuple[int, int, list[tuple[int, int]]]], least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of the words that no span has taken, where `least` are left."""
    out, at = [], 0
    for start, end, _ in [*sorted(spans, key=lambda x: x[0]), (places[-1] + 1, places[-1] + 1, [])]:
        to = bisect.bisect_left(places, start)
        if to - at >= least:
            out.append((at, to))
        at = bisect.bisect_left(places, end)
    return out


def occurrences(places: list[int], text: list[int], template: list[int], needed: int, reach: int) -> list[tuple[int, int]]:
    """Disjoint spans [start, end) of words that score `needed` at least: FOREIGN for each matched word, less one for each other word
    of the span. A local alignment finds the best span first met; the search goes on behind it. It completes `anchored` where words repeat so much
    that anchors mislead.
    """
    where: dict[int, list[int]] = {}
    for k, w in enumerate(template):
        where.setdefault(w, []).append(k)
    at_word = {w: np.array(x) for w, x in where.items()}
    one = 1 << 32
    out: list[tuple[int, int]] = []
    first = 0
    while first < len(places):
        # By number of template words passed: the best score (high half) and where its span starts (low half).
        state = np.full(len(template) + 1, places[first], np.int64)
        last, best = places[first] - 1, None
        for k in range(first, len(places)):
            place, at = places[k], at_word[text[k]]
            if best and place > best[2] + reach:
                break
            np.maximum(state - (place - last - 1) * one, place, out=state)
            gained = state[at] + FOREIGN * one
            np.maximum(state - one, place + 1, out=state)
            state[at + 1] = np.maximum(state[at + 1], gained)
            np.maximum.accumulate(state, out=state)
            last = place
            score, start = divmod(int(state[-1]), one)
            if score < needed:
                continue
            if best and start >= best[2]:
                out.append(best[1:])
                best = score, start, place + 1
            elif best is None or score > best[0]:
                best = score, start, place + 1
        if best is None:
            break
        out.append(best[1:])
        first = bisect.bisect_left(places, best[2])
    return out


def notices(places: list[int], text: list[int], template: list[int], needed: int, reach: int, enough: int) -> list[list[tuple[int, int]]]:
    """Matched places of each span that scores `needed`."""
    spans = anchored(places, text, template, needed, reach)
    out = [matched for _, _, matched in spans]
    for a, b in missed(places, spans, enough):
        for start, end in occurrences(places[a:b], text[a:b], template, needed, reach):
            x, y = bisect.bisect_left(places, start), bisect.bisect_left(places, end)
            out.append([(x + i, j) for i, j in common(text[x:y], template)])
    return out


def strongest(found: list[tuple[int, int, str, list[int]]]) -> list[tuple[int, int, str, list[int]]]:
    """Of (score, template words, license, matched places), from the highest score on (the shorter template, then the first place of equal ones), those of which
    stronger ones match at most half of the places."""
    taken: set[int] = set()
    out = []
    for one in sorted(found, key=lambda x: (-x[0], x[1], x[3][0], x[2])):
        if 2 * len(taken.intersection(one[3])) <= len(one[3]):
            taken.update(one[3])
            out.append(one)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, ...]] | None = None, least: float = 0.8) -> DataFrame:
    """The id, license, coverage, matched, template_words, start_word and end_word of each document and license with a template of which
    at least `least` of the template's words are matched, less one for every FOREIGN other words between them.

    Words are runs of letters, digits and characters from U+0080 on, A-Z counting as a-z. Windows that hold too few of the template's words
    to reach `least` are passed over (see `candidates`). In the others, patience alignment finds the spans (see `anchored` and `align`): words that a window and the
    template hold once each are anchors, and gaps are aligned alike. What it leaves, where enough words are left, is searched by local alignment (see
    `occurrences`), so that no span is lost where no word is unique. A document's coverage is that of its best span (of most matched words, the first of
    equal ones). Of spans whose matched words are mostly the same, only that which explains most of its words counts (see `strongest`).
    `templates` are (license, text) or (license, text, words that must match), several of a license if need be; without any, those of `production`.

    Null and empty texts match nothing, nor do templates without words. Repeated rows give rows each. Other columns
    are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    given = templates or production()

    def hashed(texts: list[str]) -> list[np.ndarray]:
        data = [np.frombuffer(x.encode(), np.uint8) for x in texts]
        offsets = np.append(0, np.cumsum([len(x) for x in data]))
        data = LOWER[np.concatenate(data)] if data else np.zeros(0, np.uint8)
        starts, ends, marks = words(data, offsets, ALPHANUMERIC)
        return np.split(Hasher.spans(data, starts, ends), marks[1:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, names = hashed([x[1] for x in given]), hashed([x[2] if len(x) > 2 else "" for x in given])
        own = [(one[0], x, np.intersect1d(x, must)) for one, x, must in zip(given, texts, names) if len(x)]
        vocabulary = np.unique(np.concatenate([x for _, x, _ in own])) if own else np.zeros(0, np.uint64)
        own = [(name, np.searchsorted(vocabulary, x).tolist(), np.isin(vocabulary, x), set(np.searchsorted(vocabulary, y).tolist())) for name, x, y in own]
        for some, data, offsets in text_blocks(batches, "text"):
            data = LOWER[data]
            starts, ends, marks = words(data, offsets, ALPHANUMERIC)
            hashes = Hasher.spans(data, starts, ends)
            of = per_document(marks)
            found = np.searchsorted(vocabulary, hashes)
            known = np.flatnonzero(found < len(vocabulary))
            known = known[vocabulary[found[known]] == hashes[known]]
            found = found[known]
            spans: dict[int, list[tuple[int, int, str, list[int]]]] = {}
            for name, template, member, named in own:
                needed = int(np.ceil(FOREIGN * least * len(template) - 1e-9))
                enough, reach = max(-(-needed // FOREIGN), 1), (FOREIGN + 1) * len(template) - needed
                mine = member[found]
                hit, word = known[mine], found[mine]
                room = np.bincount(of[hit], minlength=len(marks) - 1)
                for k in np.flatnonzero(room >= enough).tolist():
                    lo, hi = np.searchsorted(hit, marks[k : k + 2])
                    at = hit[lo:hi] - marks[k]
                    if (at[enough - 1 :] - at[: len(at) - enough + 1]).min() >= reach:
                        continue
                    places, text = at.tolist(), word[lo:hi].tolist()
                    for a, b in candidates(places, text, template, enough, reach):
                        for matched in notices(places[a:b], text[a:b], template, max(needed, 1), reach, enough):
                            if named <= {template[j] for _, j in matched}:
                                at_words = [places[a + i] for i, _ in matched]
                                score = (FOREIGN + 1) * len(matched) - (at_words[-1] + 1 - at_words[0])
                                spans.setdefault(k, []).append((score, len(template), name, at_words))
            out: list[tuple] = []
            for k, found_here in sorted(spans.items()):
                best: dict[str, tuple] = {}
                for _, size, name, at_words in strongest(found_here):
                    one = len(at_words), -size, -at_words[0], at_words[-1] + 1
                    best[name] = max(best.get(name, one), one)
                out += [(k, name, -n / size, n, -size, -start, end) for name, (n, size, start, end) in sorted(best.items())]
            row, *rest = zip(*out) if out else [()] * 7
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds))], names=["id", "license", "coverage", "matched", "template_words", "start_word", "end_word"])

    schema = f"id {id_type}, license string, coverage double, matched int, template_words int, start_word int, end_word int"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
