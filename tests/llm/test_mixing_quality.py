import re

import numpy as np
import pytest

from junctura.llm.mixing import CLOSE, mix, mixed_documents, source_targets
from junctura.llm.quality import host_verdicts, measured, quality, quality_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Targets by the rounds of the definition: cut what is above, share it out by weight, again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                free.discard(s)
    return target


def brute_rates(sizes, target, cap=3.0):
    """Rates by bisection of the multiplier, the mean size as unit."""
    x = np.array(sizes, float)
    if target >= cap * x.sum():
        return np.full(len(x), cap)
    low, high = -500.0, 500.0
    rate = lambda m: np.minimum(cap, np.exp(np.minimum(m * x / x.mean(), 700)))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (rate(mid) * x).sum() < target else (low, mid)
    return rate(low)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 5, "d": 40, None: 7}, {"a": 1, "b": 1000}, {"a": 0, "b": 3}, {None: 4}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_meets_targets_and_reruns_agree(documents):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(n)), f"s{k % 4}" if k % 11 else None) for k, n in enumerate(rng.integers(1, 200, 400))]
    rows += [(900, None, "s0"), (901, "", None), (902, " \n ", "s1"), (5, rows[5][1], rows[5][2])]
    docs = documents(rows, "size copies target")
    got = mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    assert (got.loc[got["size"] == 0, "taken"] == 0).all()
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, text, s in rows:
        sizes.setdefault(s, []).append((i, len(WORDS.findall(text or ""))))
    want = brute_targets({s: sum(n for _, n in v) for s, v in sizes.items()})
    got["source"] = got.doc_id.map(source)
    for s, v in sizes.items():
        part = got[got.source.isna() if s is None else got.source == s]
        assert abs(part.target.iloc[0] - want[s]) < 1e-6 * want[s]
        assert abs(part.taken.sum() - want[s]) <= 0.02 * want[s] + 3
        rate = dict(zip([i for i, _ in v], brute_rates([n for _, n in v], want[s]), strict=True))
        close = part[part["size"] > 0]
        assert all(abs(r.rate - rate[r.doc_id]) < 1e-4 for r in close.itertuples()), CLOSE
    again = mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).to_numpy().tolist() == again[key].sort_values(key).to_numpy().tolist()


def test_mixed_documents_repeat_rows(documents):
    docs = documents([(1, "a b c", "x"), (2, "d e", "y"), (3, "f", "z")], "copies")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.copies for r in mix(docs).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}


def test_mix_of_nothing(documents):
    assert mix(documents([])).count() == 0 and mixed_documents(documents([])).count() == 0
    assert [r.taken for r in mix(documents([(1, None, None)])).collect()] == [0]


def brute_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {at + k for starts in windows.values() if len(starts) > 1 for at in starts for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(documents):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcé#"), n)) for n in (0, 1, 7, 8, 9, 16, 17, 40, 300)]
    texts += ["x y z " * 500, "same line\nsame line\n\n \nother", None, "", "\t\n\x0b", "é　ü a", "word " * 20_000, "𝒳 𝒳"]
    rows = [(k, t, f"h{k % 3}") for k, t in enumerate(texts)] + [(3, texts[3], None)]
    got = sorted(quality(documents(rows, "kept n_words")).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        want = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_hosts_shrink_and_reject(spark):
    rows = [(h, k < bad, False, False) for h, bad, n in (("good", 5, 100), ("bad", 90, 100), ("tiny", 1, 1), (None, 0, 30)) for k in range(n)]
    table = spark.createDataFrame(rows, "source string, _q_base boolean, _q_symbols boolean, _q_lines boolean")
    got = {r.host: r for r in host_verdicts(table).collect()}
    assert [got[h].rejected for h in ("good", "bad", None)] == [False, True, False]
    assert 0.42 < got["tiny"].rate_base < 1 and got["good"].rate_base > 0.05 and got["bad"].rate_base < 0.9


def test_filter_keeps_columns_and_rejects_hosts(documents):
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(k, good + f" {k}", "ok") for k in range(20)] + [(100 + k, "spam", "junk") for k in range(60)] + [(200, good, "junk")]
    docs = documents(rows, "kept host")
    out = quality_filter(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(20))
    assert quality_filter(documents([])).count() == 0 and quality(documents([])).count() == 0


def test_measures_stay_in_the_jvm(documents):
    plan = measured(documents([(1, "a", "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
