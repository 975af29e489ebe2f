"""Similarity join, WARC, preferences, neighbours, URL filters and the pipeline."""

import datetime
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseflow.llm import neighbours, preferences, queries, similarity, urls, warc


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    out = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            out[find(k)] = min(out.get(find(k), d), d)
    return [(d, len(s), out.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def variants(rng, n_groups, n, words=40):
    for _ in range(n_groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, words))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10000)}"
            yield " ".join(w[: len(w) - rng.choice([0, 0, 1, 2])]).upper() if rng.random() < 0.3 else " ".join(w)


@pytest.mark.parametrize("seed, groups, copies, words", [(1, 12, 8, 40), (2, 1, 120, 120), (3, 40, 3, 12)])
def test_similarity_brute_force(spark, seed, groups, copies, words):
    rng = random.Random(seed)
    texts = list(variants(rng, groups, copies, words)) + [None, "", "  ", "one", "ONE", "a b c d", "a b c d e", "a b c d e", "é É"]
    line = " ".join(f"line{k}" for k in range(12))
    texts = [f"{t} {line}" if rng.random() < 0.4 and t else t for t in texts]
    rng.shuffle(texts)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)] + [(None, texts[0]), (5, texts[1]), (5, texts[1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, sid long, token string")
    got = similarity.similar_classes(df).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_components(rows), key=key)


def test_similarity_long_lists(spark, monkeypatch):
    """Lists that are cut, and a group whose members link to some others only."""
    monkeypatch.setattr(similarity, "LIST_ROWS", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(90):
        w = list(base)
        for j in range(rng.randrange(8)):
            w[rng.randrange(60)] = f"x{k}-{j}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = similarity.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_similarity_empty(spark):
    assert similarity.similar_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in similarity.similar_classes(spark.createDataFrame([(4, None), (4, None)], "doc_id long, text string")).collect()] == [(4, 0, 4)] * 2


HTML = [None, "", "short", "x" * 100, "x" * 100, "y" * 99, "y" * 99, "a\r\n\r\nb" * 40, "a\r\n\r\nb" * 40, "\r\n" * 60, "WARC/1.1\r\n" * 30, "é" * 60 + "\r\n\r\n", "z" * 200 + "\r\n", "\n\n" + "q" * 300]


def test_warc_round_trip(spark):
    rows = [(k, f"http://h/{k} x\r\ny", t, "c") for k, t in enumerate(HTML)] + [(3, "http://again", HTML[3], "c"), (None, None, HTML[3], "c"), (50, None, None, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    import hashlib

    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (-1 if r.page_id is None else r.page_id, r.record_type))
    assert len(got) == len(rows)
    for r, (k, _, t, _) in zip(got, sorted(rows, key=lambda r: -1 if r[0] is None else r[0])):
        data = (t or "").encode()
        firsts = [p for p, _, x, _ in rows if x == t and p is not None]
        revisit = len(data) >= 100 and (k is None or k > min(firsts))
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", min(firsts)) if revisit else ("response", None))
    assert warc.round_trip(pages.where("false")).collect() == []


def test_warc_payloads_return(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", t) for k, t in enumerate(HTML)], "page_id long, url string, html string")
    warc.write_archives(warc.resolve_revisits(pages, least_bytes=10**9), str(tmp_path / "w"))
    got = {int(r.page_id): bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {k: (t or "").encode() for k, t in enumerate(HTML)}


def test_warc_archives_by_member(spark, tmp_path):
    """Archives as a public reader takes them: a record per gzip member, ids of their own, references that exist."""
    import glob
    import zlib

    date = datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = [(k % 9 if k > 20 else k, f"http://h/{k}\r\nX: y", t, date) for k, t in enumerate(HTML * 3)] + [(None, None, "n" * 300, None)] * 3 + [(90, "http://big", "b" * (17 << 20), date)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, fetched timestamp")
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(pages.repartition(3), date_col="fetched"), path)
    ids, refers, kinds = [], [], []
    files = glob.glob(path + "/*.warc.gz")
    assert files and not glob.glob(path + "/*.txt*")
    for file in files:
        data, first = open(file, "rb").read(), True
        while data:
            unpack = zlib.decompressobj(31)
            text = unpack.decompress(data)
            data = unpack.unused_data
            assert unpack.eof
            if not text:
                continue  # after a record of 16 MiB or more
            head, _, block = text.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block) - 4
            assert (fields["WARC-Type"] == "warcinfo") == first and "X" not in fields
            ids.append(fields["WARC-Record-ID"]), refers.append(fields.get("WARC-Refers-To")), kinds.append(fields["WARC-Type"])
            assert fields["WARC-Date"] == ("2024-05-06T07:08:09Z" if "X-Page-ID" in fields else "1970-01-01T00:00:00Z")
            first = False
    assert len(set(ids)) == len(ids) == len(rows) + len(files) and {x for x in refers if x} <= set(ids) and any(refers)
    assert all(k == "revisit" for k, x in zip(kinds, refers) if x)
    back = warc.read_archives(spark, path)
    assert back.count() == len(rows) and back.where("length(payload) > 1000000").first().page_id == "90"


def test_preferences(spark):
    schema = "conv_id long, turn long, role string, text string, n int, key string"
    turns = lambda rows: spark.createDataFrame([(*r, 1, "k") for r in rows], schema)
    chosen = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (3, 0, None, "a"), (3, 1, "assistant", ""), (4, 0, "user", "x"), (None, 0, "user", "x")])
    rejected = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "no é"), (1, 2, "user", "?"), (2, 0, "user", None), (2, 1, "assistant", "b"), (3, 0, None, "a"), (3, 1, "assistant", ""), (5, 0, "user", "x")])
    rows = {r.conv_id: r for r in preferences.format_preferences(chosen, rejected).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].prompt == "<|user|>\nhi<|end|>\n" and rows[1].prompt_turns == 1 and rows[1].chosen == "<|assistant|>\nyes<|end|>\n"
    trained = lambda text, spans: [text[s.start : s.end] for s in spans]
    assert trained(rows[1].chosen, rows[1].chosen_spans) == ["yes<|end|>"] and trained(rows[1].rejected, rows[1].rejected_spans) == ["no é<|end|>"]
    assert rows[2].prompt == "<|user|>\n<|end|>\n" and rows[2].chosen == "" and rows[2].chosen_spans == [] and rows[2].rejected.startswith("<|assistant|>")
    assert rows[3].prompt_turns == 2 and rows[3].chosen == rows[3].rejected == ""
    assert preferences.format_preferences(chosen.where("false"), rejected).collect() == []


def test_neighbours_of_repeated_query(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(200)], "vec_id long, embedding array<double>")
    search = lambda d: sorted(tuple(r) for r in neighbours.search(d, F.col("vec_id").isin(0, 20), k=10, mass=1.0).collect())
    once = search(df)
    assert len(once) == 20 and search(df.unionByName(df.where("vec_id = 0")).unionByName(df.where("vec_id = 0"))) == once


def test_neighbours_exact_and_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:160] = x[100]  # equal vectors tie
    rows = [(int(k), [float(v) for v in r], "p") for k, r in enumerate(x)]
    bad = [(1000, None, "p"), (1001, [0.0] * 8, "p"), (1002, [None] + [1.0] * 7, "p"), (1003, [float("nan")] * 8, "p"), (1004, [float("inf")] * 8, "p"), (1020, [1.0, 2.0], "p"), (None, [1.0] * 8, "p")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, part string")
    scores = x.astype(float) @ x.astype(float).T
    for mass in (1.0, 0.95):
        got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, mass=mass).collect()
        by = {}
        for r in got:
            by.setdefault(r.query_id, []).append(r)
        assert set(by) == set(range(0, 700, 20))
        right = 0
        for q, own in by.items():
            own.sort(key=lambda r: r.rank)
            assert [r.rank for r in own] == list(range(1, 11)) and q not in [r.vec_id for r in own]
            assert all(abs(r.score - scores[q, r.vec_id]) < 1e-9 for r in own) and sorted(own, key=lambda r: (-r.score, r.vec_id)) == own
            want = sorted((k for k in range(700) if k != q), key=lambda k: (-round(scores[q, k], 9), k))[:10]
            right += len(set(want) & {r.vec_id for r in own})
            if mass == 1.0:
                assert [r.vec_id for r in own] == want
        assert right >= 0.9 * 10 * len(by)
    few = neighbours.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert neighbours.search(df.where("false"), F.lit(True)).collect() == [] and neighbours.search(df.where("vec_id in (1000, 1001)"), F.lit(True)).collect() == []


def test_url_filter(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = spark.createDataFrame([("b.com", day(10), True), ("b.com", day(12), True), ("b.com", day(40), False), ("b.com", day(70), True), ("x.b.com", day(20), True), (None, day(0), True), ("c.com", None, True), ("d.com", day(5), False), ("e.com", day(5), True), ("e.com", day(5), False)], "entry string, day date, active boolean")
    rows = [("http://B.com/", 9), ("http://b.com:80/p", 10), ("https://u:p@b.com/", 39), ("http://b.com", 40), ("http://a.b.com?q", 69), ("http://a.b.com", 70), ("http://q.x.b.com", 25), ("http://xb.com", 25), ("http://d.com", 9), ("http://e.com", 5), ("nonsense", 20), (None, 20), ("http://b.com", None), ("http://b.com", 400)]
    captures = spark.createDataFrame([(u, None if n is None else day(n), "h") for u, n in rows * 2], "url string, fetched date, suffix string")
    got = urls.filter_captures(captures, entries).collect()
    assert len(got) == 2 * len(rows)
    want = {0: None, 1: "b.com", 2: "b.com", 3: None, 4: None, 5: "b.com", 6: "x.b.com", 7: None, 8: None, 9: "e.com", 10: None, 11: None, 12: None, 13: "b.com"}
    found = {(r.url, r.fetched): r.matched_entry for r in got}
    for k, (u, n) in enumerate(rows):
        assert found[u, None if n is None else day(n)] == want[k], (u, n)
    assert all(r.blocked == (r.matched_entry is not None) and r.suffix == "h" for r in got)
    assert urls.filter_captures(captures, entries.where("false")).where("blocked").count() == 0
    assert urls.filter_captures(captures.where("false"), entries).count() == 0


def test_pipeline_brute_force(spark):
    import corpus_pipeline

    from test_text_operators import brute_hits

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in docs if t and re.search(r"[^\W\d_]", t)]
    kept = [(d, t) for (d, t), (_, _, c) in zip(kept, brute_components(kept)) if d == c]
    kept = {d for d, t in kept if not brute_hits(t, items)[1]}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == kept and [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb


    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect()
    text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert text(got) == text(want.fetchall())
