"""Cases that the given tables don't hold: patterned words, long texts, marks inside texts, odd keys, hosts and turns, clashing columns."""

import datetime
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poseflow.llm import attribution, blocks, decontaminate, language, licenses, packing, preferences, similarity, tokens, urls
from poseflow.llm.blocks import BLOCK_BYTES, Hasher, text_blocks

from test_text_operators import docs


def thue_morse(n, a="a", b="b"):
    """The word over two letters that makes polynomial hashes modulo a power of two collide with its complement."""
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


PATTERNED = [f(n) for n in (1024, 2048, 4096) for f in (lambda n: thue_morse(n), lambda n: thue_morse(n, "b", "a"))]


def blocks_of(texts):
    return list(text_blocks([pa.record_batch({"text": pa.array(texts, pa.string())})], "text"))


def test_patterned_words_have_distinct_hashes():
    ((_, data, offsets),) = blocks_of(PATTERNED)
    assert len(set(Hasher.spans(data, offsets[:-1], offsets[1:]).tolist())) == len(PATTERNED)
    of = lambda one, two: Hasher.runs(np.array([one if c == "a" else two for c in PATTERNED[-1]], np.uint64), 4096)
    assert of(1, 2) != of(2, 1)


def test_words_of_equal_hash_keep_their_ids(monkeypatch):
    """Every word under one of 16 hashes: the ids are the tokenizer's all the same."""

    class Poor(Hasher):
        @staticmethod
        def of_chunks(chunks, sizes):
            return Hasher.of_chunks(chunks, sizes) & np.uint64(15)

    monkeypatch.setattr(tokens, "Hasher", Poor)
    encoder = tokens.Encoder(tokens.default_path())
    rng = random.Random(2)
    texts = PATTERNED + [" ".join("".join(rng.choice("abcé1.") for _ in range(rng.randrange(1, 20))) for _ in range(30)) for _ in range(50)]
    for _ in range(2):
        for some, data, offsets in blocks_of(texts):
            ids, marks = encoder.encode_block(data, offsets)
            for k, t in enumerate(some.column(0).to_pylist()):
                assert ids[marks[k] : marks[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [0, 7, 60])
def test_forgotten_words_keep_their_ids(monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    encoder = tokens.Encoder(tokens.default_path())
    rng = random.Random(4)
    common = ["the", "of", "and", "naïve", "x" * 30]
    for _ in range(30):
        texts = [" ".join(rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(10**9)}" for _ in range(12)) for _ in range(5)]
        for _, data, offsets in blocks_of(texts):
            ids, marks = encoder.encode_block(data, offsets)
            for k, t in enumerate(texts):
                assert ids[marks[k] : marks[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(encoder.known) == len(encoder.first) == len(encoder.at) == len(encoder.again)
    assert len(encoder.known) <= remembered + 70


def test_patterned_words_through_operators(spark):
    df = docs(spark, PATTERNED)
    encoder = tokens.Encoder(tokens.default_path())
    want = {k: encoder.tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(PATTERNED)}
    rows = packing.pack(df, capacity=1 << 20, keep_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: [*ids, 0] for k, ids in want.items()}
    counted = attribution.section_tokens(df).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    assert dict(map(tuple, counted)) == {k: len(ids) for k, ids in want.items()}
    classes = similarity.similar_classes(df).collect()
    assert {(r.doc_id, r.component_id) for r in classes} == {(k, k) for k in want}
    bench = spark.createDataFrame([(1, PATTERNED[0])], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(df, bench).orderBy("doc_id").collect()] == [1, 0, 0, 0, 0, 0]


def test_numbers_of_several_sets_give_way():
    print_ = similarity.fingerprint(np.arange(3, dtype=np.uint64))
    first = similarity.number(print_, frozenset())
    second = similarity.number(print_, frozenset([first]))
    assert first != second and similarity.number(print_, frozenset([first, second])) not in (first, second)


@pytest.fixture(scope="module")
def long_texts():
    """Texts that are blocks of their own, beside short ones."""
    rng = random.Random(6)
    words = [f"{rng.choice(['haus', 'kat', 'tree', 'sol'])}{k}" for k in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(160_000))
    assert len(long) > BLOCK_BYTES
    return [long, "short one here", long + " the end of it", "", None, long[: BLOCK_BYTES // 2] + "\n" + long]


def test_long_texts(spark, long_texts):
    df = docs(spark, long_texts)
    encoder = tokens.Encoder(tokens.default_path())
    lengths = [len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in long_texts]
    packed = packing.pack(df).groupBy("doc_id").agg(F.sum("length")).collect()
    assert dict(map(tuple, packed)) == {k: n + 1 for k, n in enumerate(lengths)}
    counted = attribution.section_tokens(df).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    assert dict(map(tuple, counted)) == {k: n for k, n in enumerate(lengths) if n}
    by = {r.doc_id: r for r in similarity.similar_classes(df).collect()}
    sets = [set(zip(*(w[j:] for j in range(5)))) if len(w := (t or "").split()) >= 5 else set() for t in long_texts]
    assert [by[k].n_shingles for k in (0, 2, 5)] == [len(sets[k]) for k in (0, 2, 5)]
    near = len(sets[0] & sets[5]) / len(sets[0] | sets[5]) >= 0.8
    assert [by[k].component_id for k in range(6)] == [0, 1, 0, 3, 4, 0 if near else 5]


def test_long_texts_licenses_and_benchmark(spark, long_texts):
    apache = licenses.TEMPLATES[0][1]
    texts = [f"{t[:600_000]} {apache} {t[600_000:]}" if t and len(t) > 1000 else t for t in long_texts]
    found = {(r.doc_id, r.license): r for r in licenses.scan(docs(spark, texts)).collect()}
    assert set(found) == {(k, "Apache-2.0") for k in (0, 2, 5)}
    for k in (0, 2, 5):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[k].lower())
        assert own[found[k, "Apache-2.0"].start_word : found[k, "Apache-2.0"].end_word] == re.findall("[a-z0-9]+", apache.lower())
    items = [(1, apache), (2, "short one here"), (None, "the end of it")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    for k, t in enumerate(texts):
        n = 0 if not t else len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
        hit, own = {0: (8, [1]), 1: (3, [2]), 2: (12, [1]), 5: (8, [1])}.get(k, (0, []))
        assert (rows[k].n_words, rows[k].n_hit, rows[k]["items"]) == (n, hit, own)


def test_long_texts_and_many_languages(spark):
    """More than 200 languages, one document of ten of them, and one text of several windows of memory."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(30)] for k in range(230)}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    train = [(say(x, 300), x) for x in words]
    ten = [f"l{k:03d}" for k in range(0, 200, 20)]
    tests = [" ".join(say(x, 120) for x in ten), say("l007", 180_000), say("l229", 40)]
    assert len(tests[1]) > BLOCK_BYTES
    df = docs(spark, [t for t, _ in train] + tests, [x for _, x in train] + [None] * 3)
    model = language.Model.fit(df)
    assert len(model.languages) == 230
    rows = {r.doc_id: r for r in language.identify(df.where("doc_id >= 230"), model).collect()}
    assert sorted(rows[230].languages) == ten and all(abs(x - 0.1) < 0.03 for x in rows[230].shares)
    assert rows[231].lang_pred == "l007" and rows[231].score > 0.99 and rows[232].lang_pred == "l229"
    again = language.identify(docs(spark, [tests[2]] * 3), model).select("lang_pred", "score").distinct().collect()
    assert len(again) == 1


@pytest.mark.parametrize("bits", [8, 12, 16])
def test_model_of_fewer_classes(spark, bits, monkeypatch):
    """Where languages are many, n-grams fall into fewer classes; nothing is left out."""
    en, de = "the cat sat on the mat and the dog ran ", "der hund und die katze sind nicht im haus "
    monkeypatch.setattr(language, "MODEL_NUMBERS", 2 << bits)
    model = language.Model.fit(docs(spark, [en * 5, de * 5], ["en", "de"]))
    assert model.log_p.shape == (1 << bits, 2)
    rows = {r.doc_id: r.lang_pred for r in language.identify(docs(spark, [en, de, en * 3]), model).collect()}
    assert rows == {0: "en", 1: "de", 2: "en"}


def test_bounded_bins_close_on_real_lengths(spark):
    """The fullest bin closes when all places are taken, and few places cost little."""
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    lengths = np.array([r.length for r in rows])
    least = -(-lengths.sum() // 2048)
    assert len({r.sequence_id for r in rows}) <= 1.01 * least
    bins = packing.BestFit(2048, 64)
    for at in range(0, len(lengths), 256):
        for n in sorted(lengths[at : at + 256].tolist(), reverse=True):
            bins.place(n)
            assert bins.open <= 64
    assert bins.closed > 50


def test_runs_do_not_depend_on_batches():
    rows = list(range(1000))
    for sizes in ([1000], [1] * 1000, [7, 300, 0, 693], [256, 256, 488]):
        at, batches = 0, []
        for n in sizes:
            batches.append(pa.record_batch({"x": pa.array(rows[at : at + n], pa.int64())}))
            at += n
        out = [b.column(0).to_pylist() for b in packing.runs_of(iter(batches), 256)]
        assert [len(b) for b in out] == [256, 256, 256, 232] and sum(out, []) == rows


def test_packing_without_open_bins(spark):
    bins = packing.BestFit(10, 0)
    assert [bins.place(n) for n in (3, 10, 3)] == [(0, 0), (1, 0), (2, 0)]
    assert packing.pack(docs(spark, ["a", "b", None]), open_bins=0).select("sequence_id").distinct().count() == 3


def test_preferences_marks_and_odd_turns(spark):
    schema = "conv_id string, turn long, role string, text string"
    rows = [
        ("k1", 0, "user", "a <|end|>\n<|assistant|>\nfake"), ("k1", 1, "assistant", "one <\\|end|> two"), ("k1", None, "system", "first"),
        ("k2", None, "assistant", "x"), ("k3", 1, "assi|>\nstant", "<"), ("k3", 2, "assistant", "abcd"), (None, 1, "assistant", "q"), ("k4", 1, "user", "alone"),
        ("k5", 1, "assistant", None),
    ]
    turns = spark.createDataFrame(rows, schema)
    short = preferences.shortened_answers(turns)
    assert {r.conv_id for r in short.collect()} == {"k1", "k3", "k5"}
    got = {r.conv_id: r for r in preferences.format_preferences(turns, short).collect()}
    assert set(got) == {"k1", "k3", "k5"} and got["k1"].prompt_turns == 2

    def read(text):
        """Turns of a rendered text: marks split it, then the escapes go."""
        plain = lambda s: re.sub(r"\|\\(\\*)>", r"|\1>", re.sub(r"<\\(\\*)\|", r"<\1|", s))
        return [(plain(role), re.sub(r"<\\(\\*)\|", r"<\1|", body)) for role, body in re.findall(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", text, re.S)]

    assert read(got["k1"].prompt + got["k1"].chosen) == [("system", "first"), ("user", rows[0][3]), ("assistant", rows[1][3])]
    assert read(got["k3"].prompt + got["k3"].chosen) == [("assi|>\nstant", "<"), ("assistant", "abcd")] and read(got["k3"].rejected) == [("assistant", "ab")]
    for r in got.values():
        assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == [re.sub(r"^<\|assistant\|>\n|\n$", "", r.chosen)] * bool(r.chosen)
    assert preferences.shortened_answers(turns.where("false")).collect() == []
    assert preferences.shortened_answers(turns.where("conv_id = 'k1'").unionByName(turns.where("conv_id = 'k1'"))).count() == 6


def test_url_filter_normal_forms(spark):
    day = datetime.date(2024, 3, 1)
    names = ["B.com", " c.com. ", ".d.com", "*", "::1", "[::1]", "1.2.3.4", "3.4", "", "  "]
    entries = spark.createDataFrame([(n, datetime.date(1990, 1, 1), True, "h") for n in names], "entry string, day date, active boolean, host string")
    want = {
        "http://b.com/": "b.com", "HTTP://X.B.COM./": "b.com", "http://c.com./": "c.com", "http://a.d.com:8/": "d.com", " http://d.com": "d.com",
        "http://[::1]:80/": "[::1]", "http://[::2]/": None, "http://1.2.3.4/x": "1.2.3.4", "http://9.9.3.4/": None, "http://u@v@b.com/": "b.com", "http://.../": None,
    }
    captures = spark.createDataFrame([(u, day) for u in want], "url string, fetched date")
    got = {r.url: (r.matched_entry, r.host) for r in urls.filter_captures(captures, entries).collect()}
    assert {u: m for u, (m, _) in got.items()} == want
    assert got["http://[::1]:80/"][1] == "[::1]" and got["http://.../"][1] is None and got["HTTP://X.B.COM./"][1] == "x.b.com"


CLASHING = "score double, languages int, shares string, spans int, items string, n_words long, n_hit int, contaminated string, lang_pred string, key int, sid long, component_id string, n_shingles int, `a.b` int"


@pytest.fixture(scope="module")
def clashing(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    names = re.findall(r"(?:^|, )`?([\w.]+)`? ", CLASHING)
    rows = [(r.doc_id, r.text, r.lang) for r in d.collect()]
    near = next(t for _, t, _ in rows if t and len(t.split()) > 200)
    rows += [(7, near + " x", "en"), (None, near, None), (None, near, None), (None, "another text that stands alone here and has no group", None), (None, "...", None), (9000, near.upper(), None), (5, None, None)]
    return spark.createDataFrame([(*r, 42.5, 1, "s", 2, "i", -7, 3, "c", "l", 4, 5, "m", 6, 7) for r in rows], "doc_id long, text string, lang string, " + CLASHING), names


@pytest.mark.parametrize("stage", [0, 1, 2])
def test_stages_keep_columns(spark, clashing, stage):
    import corpus_pipeline

    df, names = clashing
    out = corpus_pipeline.STAGES[stage][1](spark, df, "/root/testdata/sf0.001")
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    rows = out.collect()
    assert rows and all(tuple(r[n] for n in names) == (42.5, 1, "s", 2, "i", -7, 3, "c", "l", 4, 5, "m", 6, 7) for r in rows)


def test_jaccard_stage_keeps_one_of_each_group(spark, clashing):
    import corpus_pipeline

    from test_table_operators import brute_components

    df, _ = clashing
    kept = corpus_pipeline.jaccard_join(spark, df, "").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    unique = list(dict.fromkeys(rows))
    of = dict(zip(range(len(unique)), (c for _, _, c in brute_components([(k, t) for k, (_, t) in enumerate(unique)]))))
    import hashlib

    key = lambda k: (unique[k][0] is None, unique[k][0] or 0, hashlib.md5(unique[k][1].encode()).digest())
    groups = {}
    for k, (_, t) in enumerate(unique):
        if t and t.split():
            groups.setdefault(of[k], []).append(k)
    want = [unique[min(g, key=key)] for g in groups.values()] + [r for r in rows if not (r[1] and r[1].split())]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_pipeline_leaves_no_scratch_behind(spark):
    import corpus_pipeline
    from poseflow import tables

    mark = tables.held(spark)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert tables.held(spark) == mark + 1  # what the last stage reads
    tables.release(spark, mark)
    assert tables.held(spark) == mark


def test_blocks_of_empty_words():
    chunks = blocks.Chunks.of(np.frombuffer(b"abcdefghij", np.uint8), np.array([0, 3, 0]), np.array([10, 3, 8]))
    assert chunks.counts.tolist() == [2, 1, 1] and chunks.values.tolist()[2:] == [0, int.from_bytes(b"abcdefgh", "little")]
    assert chunks.take(np.array([2, 0])).tolist() == [int.from_bytes(b"abcdefgh", "little"), int.from_bytes(b"abcdefgh", "little"), int.from_bytes(b"ij", "little")]


def clustered(n, seed=1, clusters=40, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return centres[rng.integers(clusters, size=n)] + 0.2 * rng.normal(size=(n, d))


@pytest.mark.parametrize("mass", [1.0, 0.95])
def test_neighbours_of_two_levels(spark, mass):
    """More parts than one partitioner may have: each part has its own below, and a hot part of equal vectors is searched in deals."""
    from poseflow.llm import neighbours

    x = clustered(3000)
    x[1000:1700] = x[1000]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(0, 3000, 100))
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0, k=10, mass=mass, part_rows=50, fan=12).collect():
        got.setdefault(r.query_id, []).append(r)
    right = 0
    for q in asked:
        scores = [(x[q] * x[k]).sum() for k in range(3000)]
        want = sorted((k for k in range(3000) if k != q), key=lambda k: (-scores[k], k))[:10]
        own = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in own)
        right += len(set(want) & {r.vec_id for r in own})
        if mass == 1.0:
            assert [r.vec_id for r in own] == want
    assert right >= 0.9 * 10 * len(asked)


def test_neighbour_parts_grow_with_rows(spark):
    from poseflow.llm import neighbours

    def leaves(n):
        rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered(n))], "id long, v array<double>")
        return neighbours.fitted(rows, 16, n, 10, part_rows=50, fan=12).leaves

    small, large = leaves(500), leaves(4000)
    assert small <= 12 and large >= 40


def best_local(text, template):
    """The best score of any span: FOREIGN for each word of a longest common subsequence, less one for each other word of the span."""
    best = 0
    for a in range(len(text)):
        row = [0] * (len(template) + 1)
        for b in range(a, len(text)):
            before = row
            row = [0] * (len(template) + 1)
            for j, w in enumerate(template):
                row[j + 1] = before[j] + 1 if w == text[b] else max(before[j + 1], row[j])
            best = max(best, licenses.FOREIGN * row[-1] - (b - a + 1 - row[-1]))
    return best


def test_license_scan_brute_force(spark):
    """A template is found just where some span of the text aligns well enough, by dynamic programming over all spans."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(9)]
    template = [rng.choice(words) for _ in range(10)]
    needed = int(np.ceil(licenses.FOREIGN * 0.8 * len(template)))
    texts = []
    for _ in range(300):
        own = list(template)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(own))
            own[k : k + rng.randrange(2)] = [rng.choice(words + ["far", "away"]) for _ in range(rng.randrange(2))]
        around = lambda: [rng.choice(words + ["far", "away"] * 3) for _ in range(rng.randrange(8))]
        texts.append(around() + own + around() + (own if rng.random() < 0.2 else []))
    rows = {r.doc_id: r for r in licenses.scan(docs(spark, [" ".join(t) for t in texts]), templates=[("name", " ".join(template))]).collect()}
    want = {k for k, t in enumerate(texts) if best_local(t, template) >= needed}
    assert set(rows) == want and 20 < len(want) < 280
    for k, r in rows.items():
        assert best_local(texts[k][r.start_word : r.end_word], template) >= needed and r.coverage == r.matched / r.template_words


def test_license_scan_of_given_documents(spark):
    """Each notice planted in the documents gives its own license once, and no other license of its family."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {}
    for r in licenses.scan(d).collect():
        assert (r.doc_id, r.license) not in found
        found[r.doc_id, r.license] = r
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    texts = {r.doc_id: plain(r.text) for r in d.collect()}
    notices = {name: plain(t) for name, t in licenses.TEMPLATES}
    for name, notice in notices.items():
        for k, t in texts.items():
            if f" {notice} " in f" {t} ":
                assert (k, name) in found, (k, name)
    for k, name in found:
        if name == "CC-BY-4.0":
            assert notices["CC-BY-NC-4.0"] not in texts[k] or notices["CC-BY-4.0"] in texts[k]
    assert sum(name == "CC-BY-NC-4.0" for _, name in found) > 0


def test_repeated_rows_of_token_counts_and_languages(spark):
    """Rows that repeat an id and text give rows each, alike; a null id stays."""
    rows = [(1, "one\ntwo <|endoftext|>\n", "en")] * 3 + [(None, "one", "en"), (None, None, None), (1, "other\n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.section, r.n_tokens) for r in attribution.section_tokens(df).collect())
    encoder = tokens.Encoder(tokens.default_path())
    count = lambda t: len(encoder.tokenizer.encode(t, add_special_tokens=False).ids)
    whole = count(rows[0][1])
    assert len(got) == 2 * 3 + 1 + 1 and sum(n for k, _, n in got if k == 1) == 3 * whole + count("other\n")
    assert [g for g in got if g[0] == 0] == [(0, 0, count("one"))]
    assert attribution.section_tokens(df.where("false")).collect() == []
    found = language.learn_and_identify(df)
    assert found.count() == 6 and found.where("doc_id = 1 and text like 'one%'").select("lang_pred", "score").distinct().count() == 1
