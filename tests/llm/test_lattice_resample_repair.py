"""Lattice hashing against all pairs, resampling against plain Python, repair against a search over all edits."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from junctura.llm import lattice, repair, resampling

VECTOR = "vec_id long, embedding array<float>"


def near_pair(rng, n, d, cosine):
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = rng.standard_normal((n, d))
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * z


def brute_links(ids, vectors, threshold=0.95):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    least = np.array(ids)
    while True:
        lower = np.array([min(least[k], *least[linked[k]]) if linked[k].any() else least[k] for k in range(len(ids))])
        if (lower == least).all():
            return {i: (int(linked[k].sum()), int(least[k]), bool(least[k] == i)) for k, i in enumerate(ids)}
        least = lower


def found_links(spark, rows, schema=VECTOR):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(spark.createDataFrame(rows, schema)).collect()}


def test_e8_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (300, 8))
    least = lattice.least_vectors()
    assert len(least) == 240 and np.allclose((least**2).sum(1), 2)
    point = lattice.e8_nearest(x)
    whole = (point == np.rint(point)).all(1)
    assert (whole | (point - 0.5 == np.rint(point - 0.5)).all(1)).all() and (point.sum(1) % 2 == 0).all()
    # a lattice point is the nearest one if none of the 240 + 2160 relevant vectors leads closer
    own = ((x - point) ** 2).sum(1)
    further = np.array([((x - point - v) ** 2).sum(1) for v in [*least, *(2 * np.eye(8)), *(-2 * np.eye(8))]])
    assert (further >= own - 1e-12).all()


def test_meeting_rate():
    rng = np.random.default_rng(5)
    for cosine, least in ((0.95, 0.97), (0.98, 0.998)):
        a, b = near_pair(rng, 2000, 64, cosine)
        (own_a, near_a), (own_b, near_b) = (lattice.cells(lattice.units(x)) for x in (a, b))
        met = (own_a == own_b) | (near_a == own_b[..., None]).any(-1) | (near_b == own_a[..., None]).any(-1)
        assert met.any(1).mean() >= least
    assert not (own_a == np.roll(own_b, 7, 0)).any()


def test_links_equal_all_pairs(spark, monkeypatch):
    """Pairs well above and below the limit, a group of near copies cut into blocks, exact copies."""
    monkeypatch.setattr(lattice, "BLOCK", 64)
    monkeypatch.setattr(lattice, "STRIP", 16)
    rng = np.random.default_rng(7)
    a, b = near_pair(rng, 150, 64, rng.uniform(0.965, 1, 150)[:, None])
    c, d = near_pair(rng, 50, 64, 0.94)
    hot = a[0] + rng.standard_normal((200, 64)) * 0.012
    vectors = np.concatenate([a, b, c, d, hot, a[:5], a[:5]]).astype("f4")
    ids = [int(x) for x in rng.permutation(len(vectors))]
    got = found_links(spark, [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)])
    assert got == brute_links(ids, vectors.astype(np.float64))


def test_vectors_that_link_with_nothing(spark):
    one, nan = [1.0, 2.0], float("nan")
    rows = [(1, one), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0, nan]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 0.0]), (9, [2.0, 4.0]), (1, one), (None, one), (0, [1e-30, 2e-30])]
    got = lattice.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], VECTOR + ", n_links string")).collect()
    assert len(got) == 11
    named = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert all(named[k] == (0, k, True) for k in range(2, 9)) and named[None] == (0, None, True)
    assert named[1] == (2, 0, False) and named[9] == (2, 0, False) and named[0] == (2, 0, True)
    assert lattice.near_vectors(spark.createDataFrame([], VECTOR)).count() == 0
    assert found_links(spark, [(1, [1.0, 1e200]), (2, [0.0, 1e200])], "vec_id long, embedding array<double>") == {1: (1, 1, True), 2: (1, 1, False)}


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(docs, target, grams, buckets, share, least):
    def features(text):
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[k : k + n]) for n in range(1, grams + 1) for k in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = {}
    for i, text in docs:
        words, found = features(text)
        drawn = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296))), words]
    able = sorted((-v[2], i) for i, v in out.items() if v[3] >= least)
    ranks = {i: k + 1 for k, (_, i) in enumerate(able[: share * len(able) // 100])}
    return {i: (*v[:3], ranks.get(i)) for i, v in out.items()}


@pytest.mark.parametrize("grams", [1, 3])
def test_resampling_equals_plain_python(spark, documents, grams):
    rng = np.random.default_rng(2)
    vocabulary = ["Wort", "été", "x1", "ÄB", "the", "naïve-ish", "a_b", "日本"] + [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))).tolist()), "s") for i in range(200)] + [(200, None, None), (201, "", "s"), (202, "the " * 30_000, "s")]
    target = [(1, "The x1 Wort w3 w3"), (2, None), (3, "été,the")]
    aim = spark.createDataFrame(target, "item_id long, text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in resampling.resample(documents(docs, "score rank"), aim, grams, 500, 25, 10).collect()}
    assert got == plain_resample([d[:2] for d in docs], [x[1] for x in target], grams, 500, 25, 10)
    assert sum(r[3] is not None for r in got.values()) > 20


def test_resampling_edges(spark, documents):
    aim = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(documents([]), aim).count() == 0
    twice = resampling.resample(documents([(5, "same text " * 20, "s")] * 20), aim).collect()
    assert len(twice) == 20 and sorted(r.rank for r in twice if r.rank) == [1, 2]


def plain_cheapest(rows):
    """Cheapest (cost, audit) by a search over all edits, Dijkstra by (cost, audit)."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit
        if (audit, at, state) in seen or len(audit) > 3 * len(rows) + 2:
            continue
        seen.add((audit, at, state))
        for role in "ua":
            if (state, role) in steps:
                heapq.heappush(heap, (cost + 2, audit + "I", at, steps[state, role]))
        if at < len(rows):
            initial, kind = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if kind < 2:
                if (state, initial) in steps:
                    heapq.heappush(heap, (cost + kind, audit + "K", at + 1, steps[state, initial]))
                for role in "ua":
                    if (state, role) in steps:
                        heapq.heappush(heap, (cost + kind + 2, audit + "R", at + 1, steps[state, role]))


def test_cheapest_edits_equal_a_search(monkeypatch):
    rng = np.random.default_rng(11)
    for k in range(400):
        rows = [(str(rng.choice(list("suaa t"))), int(rng.choice([0, 0, 0, 1, 2, 3]))) for _ in range(int(rng.integers(1, 8)))]
        want = plain_cheapest(rows)
        for chunk in (64, 2, 1):
            monkeypatch.setattr(repair, "CHUNK", chunk)
            assert repair.repaired(rows) == want, (k, rows, chunk)


def test_long_conversation(spark):
    """A conversation of many chunks: cost and audit add up as in one chunk."""
    n = 3000
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Number {t}.") for t in range(n)]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1
    counts = Counter(zlib.crc32(f"7:{t}".encode()) % 20 for t in range(n))
    assert got[0].gaps == counts[0] and got[0].blank == counts[1] and got[0].truncated == counts[2] and got[0].duplicate == counts[3]
    assert len(got[0].audit.replace("I", "")) == n - counts[0] + counts[3]


def undamaged(conv, wanted):
    """The first ``wanted`` turns whose rows the damage leaves alone."""
    return [t for t in range(500) if zlib.crc32(f"{conv}:{t}".encode()) % 20 > 4][:wanted]


def test_repair_by_hand(spark):
    schema = "conv_id long, turn long, role string, text string, cost string"
    t = undamaged(1, 5)
    rows = [(1, t[0], "system", "Be kind."), (1, t[1], "assistant", "Hi!"), (1, t[2], "user", "  \n"), (1, t[3], "user", "Yes?"), (1, t[4], "user", "Cut off")]
    dropped = next(x for x in range(500) if zlib.crc32(f"2:{x}".encode()) % 20 == 0)
    rows += [(2, dropped, "user", "Gone."), (3, None, None, None), (None, undamaged(" ", 1)[0], "user", "Ask.")]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame([(*r, "x") for r in rows], schema)).collect()}
    assert set(got) == {1, 2, 3, None}
    one = got[1]
    # s (u) a -blank- u a*: an insert, and the last row as the assistant's although it is cut off
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (max(t) - min(t) + 1 - 5, 1, 0, 1, 3)
    assert one.audit == "KIKDKR" and one.cost == 2 + 3 + 2 + 1
    text = "system:Be kind.\nuser:\nassistant:Hi!\nuser:Yes?\nassistant:Cut off"
    assert one.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert (got[3].gaps, got[3].blank, got[3].audit, got[3].cost, got[3].repaired_sha256) == (0, 1, "D", 3, empty) or zlib.crc32(b"3: ") % 20 in (0, 3, 4)
    assert got[None].audit == "KI" and got[None].cost == 2
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
