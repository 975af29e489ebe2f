"""Words written to collide, texts made from one template, and ids with any characters."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poseflow.llm import decontaminate, similarity, warc
from poseflow.llm.blocks import Hasher, mix, text_blocks

from test_table_operators import brute_components

ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def exchanged(pieces, i, j):
    """Words whose pieces i and j have changed places, each XORed so that a sum of pieces keyed by their place stays as it was."""
    key = (i * ODD ^ j * ODD) & MASK
    out = list(pieces)
    out[i], out[j] = pieces[j] ^ key, pieces[i] ^ key
    return b"".join(x.to_bytes(8, "little") for x in pieces), b"".join(x.to_bytes(8, "little") for x in out)


def hashes(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return Hasher.spans(data, np.append(0, ends[:-1]), ends)


@pytest.mark.parametrize("n, i, j", [(2, 0, 1), (16, 5, 15), (64, 3, 63), (236, 86, 235)])
def test_exchanged_pieces(n, i, j):
    rng = random.Random(n)
    a, b = exchanged([rng.getrandbits(64) for _ in range(n)], i, j)
    assert a != b and len(set(hashes([a, b]).tolist())) == 2


def test_chained_pieces():
    """A second piece that makes up for the first in a chain of multiplications and sums."""
    rng = random.Random(5)
    one = lambda x: int(mix(np.array([x], np.uint64))[0])
    p, q, r = (rng.getrandbits(64) for _ in range(3))
    s = (r + (one(p) - one(q)) * ODD) & MASK
    a, b = (b"".join(x.to_bytes(8, "little") for x in w) for w in ((p, r), (q, s)))
    assert len(set(hashes([a, b]).tolist())) == 2


def test_hashes_do_not_depend_on_neighbours():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 40, 511, 512, 513, 2000]))) for _ in range(3000)]
    together = hashes(words)
    assert all(hashes([w])[0] == h for w, h in zip(words[:200], together)) and len(set(together.tolist())) == len(set(words))
    assert hashes([b"a", b"a\0", b"a\0\0\0\0\0\0\0", b"a\0\0\0\0\0\0\0\0"]).tolist() == list(dict.fromkeys(hashes([b"a", b"a\0", b"a\0\0\0\0\0\0\0", b"a\0\0\0\0\0\0\0\0"]).tolist()))


class Poor(Hasher):
    """Every word of one length under one hash."""

    @staticmethod
    def spans(data, starts, ends):
        return (ends - starts).astype(np.uint64)


def test_decontamination_verifies_words(spark, monkeypatch):
    """Where hashes say nothing, only equal words hit."""
    words = "alpha gamma delta theta kappa sigma omega tango zebra mango".split()
    docs = [(0, " ".join(words)), (1, " ".join(words[::-1])), (2, "x " + " ".join(words[:9]) + " mang0"), (3, " ".join(words).upper() + "!"), (4, "one two"), (5, "two one")]
    item = pa.array([" ".join(words), "two one"])
    data = [(k, x) for k, x in enumerate(item.to_pylist())]
    benchmark = spark.createDataFrame(data, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "Hasher", Poor)
    index = decontaminate.Index.build(
        pa.table({
            "window": [data[0][1], data[1][1]], "words": [[5] * 10, [3, 3]], "items": [[0], [1]],
            "prefix": Hasher.runs(np.array([5, 5, 5], np.uint64), 3).view(np.int64).tolist() + Hasher.runs(np.array([3, 3], np.uint64), 2).view(np.int64).tolist(), "shift": [0, 0],
        })
    )
    for _, text in docs:
        ((_, block, offsets),) = text_blocks([pa.record_batch({"text": [text]})], "text")
        start, window = index.occurrences(decontaminate.Words.of(block, offsets))
        found = [index.texts[k].as_py().decode() for k in window.tolist()]
        assert found == ([data[0][1]] if data[0][1] in text.lower() else [text] if text == "two one" else [])
    monkeypatch.undo()
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {r.doc_id for r in found if r.contaminated} == {0, 3, 5}


def templated(n, tail="this page is under construction please come back"):
    """Texts of ten words, the first of their own and nine in common: five of seven shingles shared, so none are linked."""
    return [f"tag{k}x{k * 7919 % 104729} {tail}" for k in range(n)]


def test_templated_texts_brute_force(spark):
    rng = random.Random(3)
    texts = templated(250) + [t + " soon" for t in templated(40)] + templated(40, "this page is under construction please come")
    texts += [f"{t} {rng.choice(['a', 'b', 'c'])}{rng.randrange(3)}" for t in templated(120, "is made of the very same parts as all of the others are you see")]
    texts += [t.replace("under", "not under") for t in templated(30)] + texts[:20]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in similarity.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(rows))


def test_templated_texts_meet_by_kind(spark, monkeypatch):
    """The rows in which sets meet do not follow the square of the texts."""
    kept = {}
    save = similarity.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        kept[name] = out.count() if name in ("kinds-met", "open", "rest") else None
        return out

    monkeypatch.setattr(similarity.Scratch, "save", counted)
    rows = list(enumerate(templated(6000)))
    found = similarity.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("doc_id = component_id").count() == 6000
    assert kept["open"] >= 6000 and kept["kinds-met"] < 100 and kept["rest"] == 0


def test_warc_ids_of_any_characters(spark):
    html = "<p>" + "the same payload " * 10
    ids = ["a b", "a%20b", "a+b", "%", " lead", "trail ", "two\r\nlines", "tab\t", "é/ß?&=", "日本", "", "x:y", "\u0000nul", "a  b", "%2520"]
    rows = [(i, f"http://x/{k}", html if k % 2 else f"{html}{k % 4}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    first = {}
    for i, _, h in rows:
        first[h] = min(first.get(h, i), i, key=lambda x: x.encode())
    assert got == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h in rows}
    assert df.where(F.col("page_id") == "a b").count() == 1
