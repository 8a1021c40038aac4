import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import bagminhash as near
from junctura.llm.components import components
from junctura.llm.exact import LOCATOR, _compared, arrivals, exact, exact_filter, exact_groups, keep_state, located, read_state
from junctura.llm.scratch import new_path


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_groups(rows, got):
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(fold(text), []).append(i)
    want = {(i, t): (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items() for i in ids}
    assert len(got) == len(want)
    for r in got:
        assert any(key[0] == r.doc_id and value == (r.keep_id, r.group_size) for key, value in want.items())
        assert r.kept == (r.doc_id == r.keep_id)


ROWS = [(1, "Abc", "s"), (2, "aBC", "s"), (3, "ABÉ", "s"), (4, "abé", "s"), (5, None, None), (6, "", "s"), (7, "abc ", "s"), (8, "x" * 300_000, "s")]
ROWS += [(9, "X" * 300_000, "s"), (2, "aBC", "s"), (None, "abc", "s"), (None, "only", "s")] + [(100 + k, "Many", "s") for k in range(40)]


@pytest.mark.parametrize("digest", [None, lambda text: F.substring(F.md5(text), 1, 1)], ids=["sha256", "colliding"])
def test_groups(documents, digest):
    docs = documents(ROWS, "digest kept body").repartition(5)
    check_groups(ROWS, (exact_groups(docs) if digest is None else exact_groups(docs, digest)).collect())


def test_filter_and_columns(documents):
    docs = documents(ROWS, "digest kept")
    out = exact_filter(docs)
    kept = sorted(str(r.doc_id) for r in out.collect())
    assert out.columns == docs.columns and kept == sorted(map(str, [3, 4, 6, 7, 9, 139, 2, None]))
    assert exact(documents([])).count() == 0 and exact_filter(documents([])).count() == 0


def test_state_goes_on_with_later_arrivals(spark, documents):
    """A second run reads only new files, and finds hits on digests of the first."""
    folder, checkpoint = new_path(spark, "arrivals"), new_path(spark, "state")
    schema = f"doc_id long, digest string, locator {LOCATOR}, rows long"
    for part in ([(1, "a", "s"), (2, "b", "s")], [(3, "A", "s"), (4, "c", "s")], [(0, "b", "s")]):
        arrivals(documents(part)).write.mode("append").parquet(folder)
        keep_state(spark, folder, schema, checkpoint, 1)
    got = sorted((r.keep_id, r.group_size, r.documents) for r in read_state(spark, checkpoint).collect())
    assert got == [(2, 2, 2), (3, 2, 2), (4, 1, 1)]


@pytest.mark.parametrize("digest", [None, lambda text: F.substring(F.md5(text), 1, 1)], ids=["sha256", "colliding"])
def test_texts_are_fetched_from_their_places(spark, documents, digest):
    """Two files, an id that stands in both with one text, and another with two texts."""
    folder = new_path(spark, "docs")
    first, second = ROWS[:8] + [(50, "one", "s")], ROWS[8:] + [(2, "aBC", "s"), (50, "TWO", "s"), (51, "two", "s")]
    for part in (first, second):
        documents(part).coalesce(1).write.mode("append").parquet(folder)
    docs = spark.read.parquet(folder)
    places = located(docs).select("locator").distinct().collect()
    assert len(places) == len(first) + len(second) and len({p.locator.path for p in places}) == 2
    check_groups(first + second, (exact_groups(docs) if digest is None else exact_groups(docs, digest)).collect())


def test_hits_come_from_the_locator_alone(spark, documents):
    """The text compared is the one at the place that the state names, whatever row its doc_id has elsewhere."""
    folder = new_path(spark, "docs")
    documents([(1, "same", "s"), (2, "Same", "s"), (3, "other", "s")]).coalesce(1).write.parquet(folder)
    docs = spark.read.parquet(folder)
    place = {r.doc_id: r.locator for r in located(docs).collect()}
    schema = f"doc_id long, digest string, locator {LOCATOR}, keep_id long, keep_locator {LOCATOR}, documents long"
    verdicts = spark.createDataFrame([(1, "d", place[1], 2, place[2], 2), (2, "d", place[2], 2, place[2], 2), (9, "e", place[3], 9, place[3], 2)], schema)
    got = {r.doc_id: (r.body, r.same) for r in _compared(docs, verdicts, lambda text: F.lit("never asked")).collect()}
    assert got == {1: ("same", True), 2: ("same", True), 9: ("other", True)}


def bag(text):
    words = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
    n = min(5, len(words))
    out = {}
    for i in range(len(words) - n + 1 if n else 0):
        out[(n, *words[i : i + n])] = out.get((n, *words[i : i + n]), 0) + 1
    return out


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def brute_classes(rows):
    ids = sorted({i for i, *_ in rows})
    bags = {i: bag(text) for i, text, _ in rows}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


def corpus():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(int(rng.integers(30, 120)))]
        for c in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(c % 4 * (1 + g % 3)):
                text[int(rng.integers(len(text)))] = word()
            rows.append((len(rows), " ".join(text), "s"))
    base = [word() for _ in range(100)]
    for k in range(40):  # copies nearer to the base than to each other
        text = list(base)
        text[int(rng.integers(100))] = text[int(rng.integers(100))] = word()
        rows.append((len(rows), " ".join(text), "s"))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "!!", "s"), (1003, "one two", "s"), (1004, "One, two.", "s"), (1005, "b a b a " * 3000, "s"), (1006, "b a b a " * 2500, "s")]
    return rows + [rows[0], (1007, "one two three four five", "s"), (1008, "one two three four", "s")]


def test_classes_against_all_pairs(documents):
    rows = corpus()
    got = near.near_classes(documents(rows, "class_id bands").repartition(6)).collect()
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(want)
    assert all(r.class_size == sum(c == r.class_id for c in want.values()) for r in got)


def test_shuffled_paths_agree(documents, monkeypatch):
    monkeypatch.setattr(near, "SENT", 0)
    monkeypatch.setattr(near, "MEMBERS", 3)
    monkeypatch.setattr(near, "BLOCK", 4)
    rows = corpus()
    assert {r.doc_id: r.class_id for r in near.near_classes(documents(rows)).collect()} == brute_classes(rows)


@pytest.mark.parametrize("sent", [near.SENT, 0])
def test_large_buckets_are_dealt(documents, monkeypatch, sent):
    """Members of a bucket go by several keys, and meet the same leaders and components."""
    monkeypatch.setattr(near, "DEALT", 3)
    monkeypatch.setattr(near, "SENT", sent)
    base = " ".join(f"w{k}" for k in range(120))
    rows = [*corpus(), *((3000 + k, f"{base} end{k}", "s") for k in range(60))]
    assert {r.doc_id: r.class_id for r in near.near_classes(documents(rows)).collect()} == brute_classes(rows)


def test_an_id_with_two_texts(documents):
    """The least of its texts is compared, whatever the order of the rows; both texts find its bucket."""
    first, second = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, first, "s"), (2, second, "s"), (2, first, "s"), (3, second, "s")]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.class_id for r in near.near_classes(documents(order)).collect()}
        assert got == {1: 1, 2: 1, 3: 2} or got == {1: 1, 2: 1, 3: 1}
        seen = got if order is rows else seen
        assert got == seen


def test_filter_keeps_one_of_each(documents):
    rows = corpus()
    docs = documents(rows, "class_id")
    out = near.near_filter(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(brute_classes(rows).values())
    assert near.near_classes(documents([])).count() == 0 and near.near_filter(documents([])).count() == 0


@pytest.mark.parametrize("slots", [near.SLOTS, near.FINE_SLOTS])
def test_signatures_are_unbiased(slots):
    rng = np.random.default_rng(0)
    bags, true = [], []
    for _ in range(150):
        keys = np.unique(rng.integers(0, 1 << 62, 50).astype(np.uint64))
        count = rng.integers(1, 20, len(keys))
        other = np.maximum(0, count + rng.integers(-6, 7, len(keys)))
        a, b = (keys, count), (keys[other > 0], other[other > 0])
        bags += [a, b]
        true.append(near.similarity(a, b))
    table = near.signed(bags, slots)
    seen = (table[0::2] == table[1::2]).mean(axis=1)
    assert abs((seen - true).mean()) < 4 * 0.45 / np.sqrt(150 * slots) and np.isfinite(table).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(400, 470)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}


def test_shingles_signed_at_once_take_little_memory():
    import tracemalloc

    from junctura.llm import bagminhash

    rng = np.random.default_rng(0)
    bags = [bagminhash.counted(rng.integers(0, 2**62, 900)) for _ in range(bagminhash.SIGNED // 900)]
    tracemalloc.start()
    bagminhash.signed(bags)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 32_000_000
