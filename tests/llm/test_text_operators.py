"""Language ID, license scan, packing, decontamination and token attribution."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poseflow.llm import attribution, decontaminate, language, licenses, packing, tokens
from poseflow.llm.blocks import ALPHANUMERIC, LOWER, SPACED, Hasher, text_blocks, words

DOCS = "doc_id long, text string, lang string, words string, id long, token string, sid long"
ODD = [None, "", " ", "\n\n", "A.", "1 2 3 !!", "é", "日本 語 x", "a" * 5000, "<|endoftext|> a  b", "x y\t z", "end \n"]


def docs(spark, texts, langs=None):
    """Extra columns clash with names that the operators use."""
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(k, t, l, "w", 7, "t", 9) for k, (t, l) in enumerate(zip(texts, langs))], DOCS)


def block_of(texts):
    return next(iter(text_blocks([pa.record_batch({"text": pa.array(texts, pa.string())})], "text")))


@pytest.mark.parametrize("table, pattern", [(SPACED, r"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_match_regex(table, pattern):
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice("abAZ09 .\t\n\x0b-é日") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None]
    _, data, offsets = block_of(texts)
    data = LOWER[data]
    starts, ends, marks = words(data, offsets, table)
    hashes = Hasher.spans(data, starts, ends)
    by_word = {}
    for k, t in enumerate(texts):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        found = [data[a:b].tobytes().decode() for a, b in zip(starts[marks[k] : marks[k + 1]], ends[marks[k] : marks[k + 1]])]
        assert found == re.findall(pattern, t)
        for w, h in zip(found, hashes[marks[k] : marks[k + 1]].tolist()):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.learn_and_identify(d).where(language.held_out() & F.col("lang").isNotNull())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_cases(spark):
    en, de = "the cat sat on the mat and the dog ran ", "der hund und die katze sind nicht im haus "
    df = docs(spark, [en * 5, de * 5, en * 3 + de * 3, en * 5, *ODD], ["en", "de", None, "en", *[None] * len(ODD)])
    model = language.Model.fit(df)
    rows = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert model.languages == ["de", "en"] and len(rows) == 4 + len(ODD)
    assert rows[0].lang_pred == "en" and rows[1].lang_pred == "de" and rows[0].languages == ["en"] and rows[3].score == rows[0].score
    assert sorted(rows[2].languages) == ["de", "en"] and abs(sum(rows[2].shares) - 1) < 1e-6 and 0.3 < rows[2].score < 0.7
    for k, t in enumerate(ODD):
        letters = t is not None and any(c.isalpha() for c in t)
        assert (rows[4 + k].lang_pred != "und") == letters and 0 <= rows[4 + k].score <= 1
    assert language.learn_and_identify(df.where("false")).collect() == []
    assert {r.lang_pred for r in language.learn_and_identify(docs(spark, [en])).collect()} == {"und"}


def test_em_finds_shares():
    rng = np.random.default_rng(0)
    truth = np.array([0.7, 0.3, 0.0])
    which = rng.choice(3, 400, p=truth)
    scores = rng.normal(-60, 3, (400, 3))
    scores[np.arange(400), which] += 25
    shares = language.select_languages(scores, np.array([0, 400]))
    assert np.abs(shares[0] - np.bincount(which, minlength=3) / 400).max() < 0.02 and shares[0, 2] == 0


@pytest.mark.parametrize("relatives", [3, 8, 150])
def test_em_finds_distant_language_among_relatives(relatives):
    """Nine tenths of one language with near relatives and a tenth of a distant one, in documents of several sizes."""
    rng = np.random.default_rng(relatives)
    sizes = [10, 60, 200]
    scores = rng.normal(-200, 3, (sum(sizes), relatives + 2))
    marks = np.append(0, np.cumsum(sizes))
    for a, n in zip(marks, sizes):
        scores[a : a + n - n // 10, : relatives + 1] += 60
        scores[a : a + n - n // 10, 0] += 20
        scores[a + n - n // 10 : a + n, -1] += 60
    shares = language.select_languages(scores, marks)
    for row in shares:
        assert np.flatnonzero(row > 1e-6).tolist() == [0, relatives + 1] and abs(row[-1] - 0.1) < 0.01


def best_subset(scores, penalty=3.0):
    """(value, languages): of all sets of languages that with the best likelihood, by expectation-maximisation to convergence, less its penalty."""
    n, languages = scores.shape
    found = []
    for size in range(1, languages + 1):
        for some in itertools.combinations(range(languages), size):
            own = scores[:, some]
            top = own.max(1, keepdims=True)
            p, shares = np.exp(own - top), np.full(size, 1 / size)
            for _ in range(200):
                joint = p * shares
                shares = (joint / joint.sum(1, keepdims=True)).mean(0)
            value = (np.log((p * shares).sum(1)) + top[:, 0]).sum()
            found.append((value - (size - 1) * (penalty + 0.5 * np.log(n)), some))
    return max(found), dict((s, v) for v, s in found)


@pytest.mark.parametrize("apart, misses, behind", [(40, 0.01, 1.0), (12, 0.03, 2.0), (4, 0.25, 4.0)])
def test_language_sets_against_all_subsets(apart, misses, behind):
    """Documents of 3 to 40 windows in four languages, a window's own language standing out by `apart` over noise of 2: how often elimination
    misses the best of all subsets, and by how much log-likelihood at most. Real languages stand out by tens in a window of 48 n-grams."""
    rng = np.random.default_rng(apart)
    missed, short, documents = 0, 0.0, 200
    for _ in range(documents):
        n = int(rng.integers(3, 41))
        which = rng.choice(4, n, p=rng.dirichlet([0.4] * 4))
        scores = rng.normal(-150, 2, (n, 4))
        scores[np.arange(n), which] += apart
        chosen = tuple(np.flatnonzero(language.select_languages(scores, np.array([0, n]))[0] > 1e-6).tolist())
        (value, _), by_set = best_subset(scores)
        missed += by_set[chosen] < value - 1e-2
        short = max(short, value - by_set[chosen])
    print("apart", apart, "missed", missed, "of", documents, "short by", short)
    assert missed <= misses * documents and short < behind


def test_encoder_equals_tokenizer():
    encoder = tokens.Encoder(tokens.default_path())
    rng = random.Random(3)
    texts = [x or "" for x in ODD] + ["".join(rng.choice("abé' 's\n\t.,日1  \u0085\x1c") for _ in range(rng.randrange(80))) for _ in range(300)]
    for _ in range(2):  # again from memory
        _, data, offsets = block_of(texts)
        ids, marks = encoder.encode_block(data, offsets)
        for k, t in enumerate(texts):
            assert ids[marks[k] : marks[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
            assert encoder.byte_lengths[ids[marks[k] : marks[k + 1]]].sum() == len(t.encode())


def test_packing_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(docs(spark, ODD).select("doc_id", "text", "lang").withColumn("doc_id", -1 - F.col("doc_id")), allowMissingColumns=True)
    rows = packing.pack(df.repartition(3), capacity=512).collect()
    encoder = tokens.Encoder(tokens.default_path())
    texts = {r.doc_id: r.text for r in df.collect()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        ids = np.array(encoder.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        assert len(ids) > 512 or len(own) == 1
        assert all(r.length == 512 for r in own[1:])
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 512
    assert len(by_seq) <= 1.02 * -(-sum(r.length for r in rows) // 512) + 1
    assert packing.pack(docs(spark, [])).collect() == []
    assert len(packing.pack(docs(spark, ["a b"] * 3), keep_ids=True).where("size(ids) = length").collect()) == 3


def test_best_fit_closes_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 8)] == [(0, 0), (1, 0), (1, 7), (2, 0)]
    assert bins.place(5) == (3, 0)  # 8 of 10 closes, 6 of 10 stays
    assert bins.place(4) == (0, 6)
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)] and packing.cut(0, 10) == [(0, 0)]


def brute_hits(text, items):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    own, hit, found = find(text), set(), set()
    for item, t in items:
        w = find(t)
        if not w:
            continue
        n = min(10, len(w))
        for win in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
            for at in range(len(own) - n + 1):
                if tuple(own[at : at + n]) == win:
                    hit |= set(range(at, at + n))
                    found.add(item)
    return len(own), len(hit), sorted(found - {None})


@pytest.mark.parametrize("block_windows", [500_000, 7])
def test_decontamination_brute_force(spark, block_windows):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "dd", "É", "x1"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 12, 20])))) for k in range(12)] + [(3, None), (None, "a b"), (40, ""), (41, "..."), (5, "a b c")]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) + rng.choice(["", ". " + (rng.choice(items)[1] or "").upper()]) for _ in range(25)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), bench, block_windows=block_windows).collect()}
    for k, t in enumerate(texts):
        assert (rows[k].n_words, rows[k].n_hit, rows[k]["items"]) == brute_hits(t, items), t
        assert rows[k].contaminated == (rows[k].n_hit > 0) and rows[k].words == "w"
    assert decontaminate.decontaminate(docs(spark, texts), bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


def test_license_scan(spark):
    mit, apache = licenses.TEMPLATES[1][1], licenses.TEMPLATES[0][1]
    texts = ["word " * 50 + mit + " more", "Released under  the\nMIT license!", "released by them under the sun", apache.replace("the ", "the new "), f"{mit} {apache}", *ODD]
    rows = {(r.doc_id, r.license): r for r in licenses.scan(docs(spark, texts)).collect()}
    assert {k for k in rows if k[0] < 5} == {(0, "MIT"), (1, "MIT"), (3, "Apache-2.0"), (4, "MIT"), (4, "Apache-2.0")} and not [k for k in rows if k[0] >= 5]
    assert (rows[0, "MIT"].start_word, rows[0, "MIT"].end_word, rows[0, "MIT"].coverage) == (50, 55, 1.0)
    assert licenses.scan(docs(spark, [])).collect() == []


def test_patience_alignment():
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    assert licenses.align([9, 1, 2, 2, 3, 8], [1, 2, 2, 3]) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert licenses.align([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)] and licenses.align([], [1]) == []
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(12)], [rng.randrange(6) for _ in range(8)]
        out = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in out) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(out, out[1:]))


def test_common_is_longest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(12))], [rng.randrange(4) for _ in range(rng.randrange(12))]
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        out = licenses.common(a, b)
        assert len(out) == d[-1][-1] and all(a[i] == b[j] for i, j in out) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(out, out[1:]))


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_license_scan_repeated_notice(spark, copies):
    """Equal notices amid words of their own vocabulary: none of these is unique in the document."""
    gpl = licenses.TEMPLATES[2][1]
    text = "The code is here, under the version. " + f" {gpl} It is the best of the work under the public. " * copies + " The end is the end."
    rows = [r for r in licenses.scan(docs(spark, [text])).collect() if r.license == "GPL-3.0"]
    assert [(r.coverage, r.start_word, r.end_word) for r in rows] == [(1.0, 7, 19)]
    word = {w: k for k, w in enumerate(dict.fromkeys(text.lower().replace(".", " ").replace(",", " ").split()))}
    own = [word[w] for w in gpl.lower().replace(".", " ").replace(",", " ").split()]
    every = [word[w] for w in text.lower().replace(".", " ").replace(",", " ").split()]
    places = [k for k, w in enumerate(every) if w in own]
    spans = licenses.occurrences(places, [every[k] for k in places], own, 39, 21)
    assert spans == [(7 + 22 * k, 19 + 22 * k) for k in range(copies)]


def test_license_scan_full_texts(spark):
    """Every full text and header is found in prose, also with another holder's name and a changed word."""
    given = [x[:2] for x in licenses.production() if x[0] != "BSD-2-Clause"]
    texts = [f"some words of the readme {t.replace('copyright', 'right', 1)} and the rest of it" for _, t in given]
    rows = {(r.doc_id, r.license): r for r in licenses.scan(docs(spark, texts)).collect()}
    for k, (name, _) in enumerate(given):
        assert rows[k, name].coverage > 0.95, name
    assert {"MIT", "Apache-2.0", "GPL-2.0", "BSD-3-Clause", "LGPL-2.1", "MPL-2.0"} <= {name for _, name in rows}


def test_license_scan_other_licenses(spark):
    """One license for one notice, and none for a text that only resembles one."""
    full = {name: text for name, text, _ in licenses.production()}
    cases = {
        "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"}, "Licensed under CC BY 4.0.": {"CC-BY-4.0"}, "Licensed under CC BY-SA 4.0": {"CC-BY-SA-4.0"},
        "Licensed under CC BY 2.0": set(), "Released under the GPL License": set(), "Released under the License": set(), "released by them under the license of the sun": set(),
        "Licensed under the MIT License": {"MIT"}, "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "Licensed under CC BY-NC 4.0. Code: Licensed under CC BY 4.0.": {"CC-BY-NC-4.0", "CC-BY-4.0"},
        full["GPL-3.0"]: {"GPL-3.0"}, full["AGPL-3.0"]: {"AGPL-3.0"}, full["BSD-3-Clause"]: {"BSD-3-Clause"}, full["BSD-2-Clause"]: {"BSD-2-Clause"},
    }
    cases |= {
        "SPDX-License-Identifier: MIT": {"MIT"}, "// SPDX-License-Identifier: GPL-2.0-or-later": {"GPL-2.0"}, "# SPDX-License-Identifier: BSD-3-Clause": {"BSD-3-Clause"},
        "Licensed under the BSD 3-Clause License": {"BSD-3-Clause"}, "Licensed under the BSD 2-Clause License.": {"BSD-2-Clause"}, "SPDX-License-Identifier: WTFPL": set(),
        "Licensed under the GNU Affero General Public License, version 3.": {"AGPL-3.0"}, "Licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
        "This work is licensed under the GNU Affero General Public License, version 3.": {"AGPL-3.0"},
    }
    cases["Released " + "far away " * 20 + " under the MIT License"] = {"MIT"}  # four words of five
    found = licenses.scan(docs(spark, list(cases))).collect()
    for k, want in enumerate(cases.values()):
        assert {r.license for r in found if r.doc_id == k} == want, list(cases)[k][:80]


def test_notices_come_from_anchors(monkeypatch):
    """Notices among prose, edited and repeated, are found by patience alignment alone: without it, and without the local alignment
    that completes it, none is; with it alone, all are."""
    rng = random.Random(8)
    monkeypatch.setattr(licenses, "occurrences", lambda *a: [])
    for words in (6, 12, 60, 300):
        template = [rng.randrange(words) if rng.random() < 0.2 else 1000 + k for k in range(words)]
        for copies in (1, 2, 3):
            text, want = [], []
            for _ in range(copies):
                text += [rng.choice([5000, 5001, 1000]) for _ in range(rng.randrange(5, 40))]
                own = list(template)
                for _ in range(words // 20):
                    own[rng.randrange(1, words - 1)] = 7000 + rng.randrange(50)
                want.append((len(text), len(text) + len(own)))
                text += own
            text += [5000] * 9
            places = [k for k, w in enumerate(text) if w in set(template)]
            needed = int(np.ceil(licenses.FOREIGN * 0.8 * words - 1e-9))
            given = places, [text[k] for k in places], template, needed, (licenses.FOREIGN + 1) * words - needed
            found = licenses.notices(*given, -(-needed // licenses.FOREIGN))
            assert [(places[m[0][0]], places[m[-1][0]] + 1) for m in sorted(found)] == want
            with monkeypatch.context() as m:
                m.setattr(licenses, "align", lambda *a: [])
                assert licenses.notices(*given, -(-needed // licenses.FOREIGN)) == []


@pytest.mark.parametrize("sections", ["lines", "paragraphs"])
@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_brute_force(spark, sections, rule):
    import re

    texts = ["one\ntwo three\n\n\nfour\n", "\n\n\n", "a\n\nb", "\nx", "no newline", *ODD, "é\nü\n\n日本"]
    rows = {}
    for r in attribution.section_tokens(docs(spark, texts), sections=sections, rule=rule).collect():
        rows.setdefault(r.doc_id, []).append(r)
    encoder = tokens.Encoder(tokens.default_path())
    for k, t in enumerate(texts):
        own = sorted(rows.get(k, []), key=lambda r: r.section)
        t = t or ""
        parts = re.findall(r"[^\n]*\n|[^\n]+$", t) if sections == "lines" else [x for x in re.split(r"(?<=\n\n)(?!\n)", t) if x]
        assert [t[r.start : r.end] for r in own] == parts
        ids = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert sum(r.n_tokens for r in own) == len(ids)
        bounds, at, want = np.cumsum([0] + [len(x.encode()) for x in parts]), 0, [0] * len(parts)
        for i in ids:
            end = at + encoder.byte_lengths[i]
            inside = [min(end, bounds[j + 1]) - max(at, bounds[j]) for j in range(len(parts))]
            held = [j for j, n in enumerate(inside) if n > 0]
            want[{"first": held[0], "last": held[-1], "most": int(np.argmax(inside))}[rule]] += 1
            at = end
        assert [r.n_tokens for r in own] == want
