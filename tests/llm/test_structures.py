"""Repair of conversations, the prefix trie and the projection forest against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseflow.llm import forest, repair, streams, trie

LEGAL = {"start": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit) over rows (initial, must_go, cut) by trying every edit from every place, without prices."""
    memo = {}

    def best(at, state, inserted):
        if (at, state, inserted) in memo:
            return memo[at, state, inserted]
        found = [(0, "")] if at == len(rows) and state in ("start", "a") else []
        follow = "a" if state == "u" else "u"
        if inserted < 3:
            c, s = best(at, follow, inserted + 1)
            found.append((c + 5, "I" + s))
        if at < len(rows):
            initial, must_go, cut = rows[at]
            c, s = best(at + 1, state, 0)
            found.append((c + 2, "D" + s))
            if not must_go:
                c, s = best(at + 1, follow, 0)
                found.append((c + 1 + 5 * cut, "R" + s))
                if initial in LEGAL[state]:
                    c, s = best(at + 1, LEGAL[state][initial], 0)
                    found.append((c + 5 * cut, "K" + s))
        memo[at, state, inserted] = min(found, default=(10**9, ""))
        return memo[at, state, inserted]

    return best(0, "start", 0)


@pytest.mark.parametrize("seed", range(4))
def test_auction_finds_the_least_cost_and_audit(seed):
    rng = random.Random(seed)
    for _ in range(300):
        rows = [(rng.choice("suaauuax"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(10))]
        codes = bytes(repair.INITIALS.get(i, 0) | (repair.MUST_GO if m else repair.IS_CUT if c else 0) for i, m, c in rows)
        rows = [(i, m, c and not m) for i, m, c in rows]
        assert repair.auction(codes) == cheapest(rows), rows


def test_auction_of_a_long_conversation_takes_few_steps():
    codes = bytes(repair.INITIALS[c] for c in "s" + "ua" * 20_000 + "uuu")
    cost, audit = repair.auction(codes)
    assert cost == 3 and audit == "K" * 40_001 + "DKR"


BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute_repair(rows):
    """Of rows (key, turn, role, text), each key's result."""
    out = {}
    first = lambda t: (t is not None, t or 0)
    for key in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == key]
        own.sort(key=lambda x: (first(x[0]), x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, states, counts = set(), [], [0, 0, 0, 0]
        for n, (_, role, text) in enumerate(own):
            blank, again = not BLANK.search(text), (role, text) in seen
            cut = not blank and not again and text.strip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
            seen.add((role, text))
            for k, hit in enumerate((blank, again and not blank, cut, n > 0 and own[n - 1][1][:1] + role[:1] not in ("su", "ua", "au"))):
                counts[k] += hit
            states.append((role[:1], blank or again, cut))
        cost, audit = cheapest(states)
        lines, at, state = [], 0, "start"
        for edit in audit:
            follow = "a" if state == "u" else "u"
            named = {"u": "user", "a": "assistant"}[follow]
            if edit == "I":
                lines.append(f"{named}:")
                state = follow
                continue
            _, role, text = own[at]
            at += 1
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = LEGAL[state][role[:1]]
            elif edit == "R":
                lines.append(f"{named}:{text}")
                state = follow
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[key] = (gaps, *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_turns(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "Yes.  \n", "two\nlines.", "é."]
    rows = [(rng.choice([None, 0, 1, 2, 40, -3]), rng.choice([None, 0, 1, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(n)]
    return rows + rows[: n // 5]


def test_repair_brute_force(spark):
    rows = odd_turns(1, 60) + [(7, k, "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, kind int")
    got = {r[0]: tuple(r)[1:] for r in repair.repair(df).collect()}
    assert got == brute_repair(rows)


def test_repair_gives_rows_that_alternate(spark):
    df = spark.createDataFrame(odd_turns(2, 80), "conv_id long, turn long, role string, text string")
    found = repair.audits(df).cache()
    rows = repair.repaired(df, found).collect()
    want = {r[0]: r for r in repair.with_digest(df, found).collect()}
    for key in want:
        own = sorted((r for r in rows if r.conv_id == key), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == want[key].repaired_sha256


def test_damage_and_keys_without_rows(spark):
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", "One. Two! Three? Four") for k in range(40) for t in range(4)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for k, t, r, x in rows:
        one = lambda v: " " if v is None else v
        draw = zlib.crc32(f"{one(k)}:{one(t)}".encode()) % 20
        r, x = one(r), one(x)
        x = "" if draw == 1 else re.sub("[.!?]", "", x) if draw == 2 else x
        want += [(k, t, "user" if draw == 4 else r, x)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    show = lambda rs: sorted(map(str, (tuple(r) for r in rs)))
    assert show(repair.damaged(df).collect()) == show(want)
    none = repair.repair(df.where("conv_id = 1"), keys=df.where("conv_id = 2 or conv_id is null")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(str, (tuple(r) for r in none))) == sorted(map(str, [(2, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]))
    assert repair.repair(df.limit(0), keys=df.limit(0)).count() == 0


def brute_trie(rows):
    convs = {}
    for key, turn, role, text in rows:
        if key is not None:
            convs.setdefault(key, []).append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {k: [x[1:] for x in sorted(v)] for k, v in convs.items()}
    nodes = {}
    for key, own in convs.items():
        h = zlib.crc32(str(key).encode()) % 4
        base = key - int(np.fmod(key, 20))
        built = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(built) + 1):
            nodes.setdefault(built[:d], []).append((key, d == len(built)))
    saved = {x: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0) for x, m in nodes.items()}
    out = []
    for x, m in nodes.items():
        below = [y for y in nodes if y[: len(x)] == x]
        children = {y for y in nodes if len(y) == len(x) + 1 and y[:-1] == x}
        leaves = sum(not any(len(z) == len(y) + 1 and z[:-1] == y for z in nodes) for y in below)
        ends = ",".join(str(k) for k in sorted(k for k, e in m if e))
        parent = min(k for k, _ in nodes[x[:-1]]) if x else None
        out.append((min(k for k, _ in m), len(x), parent, len(m), len(children), leaves, sum(saved[y] for y in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def common_turns(seed, convs, texts=4, length=6):
    rng = random.Random(seed)
    return [(k, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", f"word {rng.randrange(texts)} and more"[: rng.choice([30, 30, 8])]) for k in convs for t in range(rng.randrange(1, length))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, texts, length", [(1, 1, 9), (2, 2, 6)])
def test_trie_brute_force(spark, seed, texts, length):
    rows = common_turns(seed, [*range(0, 50), 115, 1001, -7, -21], texts, length) + [(None, 0, "user", "no key"), (3, None, None, None), (4, 0, "user", "twice"), (4, 0, "user", "twice"), (60, 1, "a", "  two  words\n")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], f"{SCHEMA}, depth int, key string")
    got = [tuple(r) for r in trie.prefix_trie(df).collect()]
    show = lambda rs: sorted(map(str, rs))
    assert show(got) == show(brute_trie(rows))


def test_trie_of_one_very_long_conversation_and_of_none(spark):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(1500)] + [(21, t, "user", f"turn {t % 7}") for t in range(1490)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = trie.prefix_trie(df)
    root = found.where("depth = 0").first()
    tail = 21 if zlib.crc32(b"20") % 4 else 20
    assert root.n_convs == 2 and found.agg(F.max("depth")).first()[0] >= 1490 and root.conv_id == 20 and tail
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_colliding_fingerprints_are_found_and_taken_back(spark, monkeypatch):
    """With tiny primes sequences collide; verification sees it each time, and never returns a merged node."""
    rows = common_turns(5, range(30), 6, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    with monkeypatch.context() as m:
        for name, value in (("PRIMES", (3, 5, 7)), ("BASES", (2, 2, 2)), ("TRIES", 1)):
            m.setattr(trie, name, value)
        with pytest.raises(RuntimeError):
            trie.prefix_trie(df).collect()
    real, tries = trie._sound, []
    monkeypatch.setattr(trie, "_sound", lambda *a: bool(real(*a) and len(tries.append(0) or tries) > 1))
    assert sorted(map(str, (tuple(r) for r in trie.prefix_trie(df).collect()))) == sorted(map(str, brute_trie(rows))) and len(tries) == 2


def test_digests_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(streams, "CHUNK", 7)
    rows = [(k % 3 if k % 5 else 1, k) for k in range(500)] + [(None, 4)]
    df = spark.createDataFrame(rows, "g long, v long")
    got = {r.g: r.sha256 for r in streams.digests(df, ["g"], "v", F.col("v"), ",").collect()}
    assert got == {g: hashlib.sha256(",".join(str(v) for v in sorted(v for x, v in rows if x == g)).encode()).hexdigest() for g in {x for x, _ in rows}}


def brute_links(rows, least):
    unit = {}
    for n, (_, v) in enumerate(rows):
        if v is not None and None not in v and all(np.isfinite(v)) and any(v):
            a = np.array(v, float)
            unit[n] = a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(unit, 2):
        if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
            links[i], links[j] = links[i] + 1, links[j] + 1
            root[find(i)] = find(j)
    least_id = {}
    for k in range(len(rows)):
        least_id[find(k)] = min(least_id.get(find(k), rows[k][0]), rows[k][0])
    return [(rows[k][0], links[k], least_id[find(k)], least_id[find(k)] == rows[k][0]) for k in range(len(rows))]


def near_vectors(rng, groups, copies, dim, noise):
    for _ in range(groups):
        base = rng.normal(size=dim)
        for _ in range(copies):
            yield (base / np.linalg.norm(base) * rng.uniform(0.5, 3) + rng.normal(size=dim) * noise / np.sqrt(dim)).tolist()


@pytest.mark.parametrize("dim, noise, leaf, block", [(64, 0.1, 40, 16), (16, 0.15, 20, 1024), (3, 0.05, 50, 64)])
def test_forest_brute_force(spark, monkeypatch, dim, noise, leaf, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    rng = np.random.default_rng(dim)
    vectors = [*near_vectors(rng, 60, 4, dim, noise), *near_vectors(rng, 1, 150, dim, noise), *near_vectors(rng, 150, 1, dim, noise)]
    vectors += [vectors[0]] * 70 + [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [None] * dim, [1.0] * (dim + 1), [2.0] * (dim + 1), [], [1e200] * dim, [-0.0] * (dim - 1) + [1e-300]]
    rows = [(int(k) * 3, v) for k, v in zip(rng.permutation(len(vectors)), vectors)] + [(0, vectors[5])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rid int, unit string")
    got = sorted(tuple(r) for r in forest.near_duplicates(df, leaf=leaf).collect())
    want = sorted(brute_links(rows, 0.95))
    share = sum(r[1] for r in got) / max(1, sum(r[1] for r in want))
    assert [r[0] for r in got] == [r[0] for r in want] and 0.99 <= share <= 1
    if share == 1:
        assert got == want


def test_forest_of_ids_that_are_null_and_of_nothing(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (3, [2.0, 4.0]), (9, None)], "vec_id long, embedding array<float>")
    assert sorted(map(str, (tuple(r) for r in forest.near_duplicates(df).collect()))) == sorted(map(str, [(None, 0, None, True), (4, 1, 3, False), (3, 1, 3, True), (9, 0, 9, True)]))
    assert forest.near_duplicates(df.limit(0)).count() == 0
