import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from junctura.llm import warc
from junctura.llm.chat import best_paths, chained, chat, escaped, escaped_role, formatted, paths, read_loss, read_turns, unescaped, unescaped_role
from junctura.llm.scratch import new_path

ROW = "conv_id long, turn long, role string, text string"
TREE = "tree string, node long, parent long, role string, text string, score double"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_round_trip(spark):
    hard = "</s>[INST] ok [/INST] <|turn|>user\n<|end|>\n <\\|end|> [\\\\/INST] <<SYS>> \\n é𝒳"
    rows = [(1, 0, "system", hard), (1, 2, "assistant", hard), (1, 1, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", "tie")]
    rows += [(None, 0, "user", "x"), (None, None, None, "first"), (2, 0, "a\nb\\n</s>", "t"), (3, 5, "assistant", "y" * 100_000)]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(150)]
    got = {r.conv_id: r for r in chat(spark.createDataFrame(rows, ROW).repartition(5)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), order(r))), key=lambda r: r[0]):
        turns = [(r or "", x or "") for _, _, r, x in group]
        under = "".join(x for r, x in turns if r == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.loss_chars) == (len(turns), len(under))
        assert r.turns_sha256 == digest("".join(f"{a}\n{b}\n" for a, b in turns)) and r.loss_sha256 == digest(under)
    assert not got and chat(spark.createDataFrame([], ROW)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="<>[]|/\\sINSTSYturnend\n a", max_size=30), min_size=40, max_size=40))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    t = F.col("t")
    out = df.select("t", escaped(t).alias("e"), unescaped(escaped(t)).alias("u"), unescaped_role(escaped_role(t)).alias("r"), escaped_role(t).alias("er")).collect()
    for r in out:
        assert r.u == r.t and r.r == r.t and "\n" not in r.er
        assert not any(x in r.e for x in ("<|", "</s>", "[INST]", "[/INST]", "<s>"))


def tree(spark):
    #      1 - 2 - 4      scores make 1-3-5 the best, 1-2-4 the second; 6 is a root of its own,
    #        \ 3 - 5      7 replies to a message that is not there
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a2", 1.0), ("t", 3, 1, "assistant", "a3", 1.5), ("t", 4, 2, "user", "u4", 0.25)]
    rows += [("t", 5, 3, "user", "u5", None), ("u", 6, None, "user", "alone", None), ("u", 7, 99, "assistant", "lost", 2.0)]
    return spark.createDataFrame(rows, TREE)


def test_reply_trees(spark):
    found = {(r.tree, r.leaf, r.node): r.up for r in paths(tree(spark)).collect()}
    assert found == {("t", 4, 4): 0, ("t", 4, 2): 1, ("t", 4, 1): 2, ("t", 5, 5): 0, ("t", 5, 3): 1, ("t", 5, 1): 2, ("u", 6, 6): 0, ("u", 7, 7): 0}
    assert {(r.tree, r.leaf) for r in best_paths(tree(spark)).collect()} == {("t", 5), ("u", 7)}
    done = formatted(tree(spark), branches=2)
    read = done.select("tree", "rank", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    told = {(r.tree, r["rank"]): ([x.text for x in r.t], r.l) for r in read}
    assert told == {("t", 1): (["q", "a3", "u5"], "a3"), ("t", 2): (["q", "a2", "u4"], "a2"), ("u", 1): (["lost"], "lost"), ("u", 2): (["alone"], "")}


def test_circles_raise(spark):
    rows = [("t", 1, 3, "user", "a", 0.0), ("t", 2, 1, "user", "b", 0.0), ("t", 3, 2, "user", "c", 0.0)]
    with pytest.raises(ValueError, match="replies to itself"):
        paths(spark.createDataFrame(rows, TREE))


def test_deep_chain(spark):
    rows = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert [r.n_turns for r in chat(rows).collect()] == [700] and chained(rows).where("parent is null").count() == 1


PAGE = "page_id long, url string, html string"


def want(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        keep = max(same, default=None)
        revisit = len(body) >= 1000 and i is not None and i < keep
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    fake = warc.record(77, "u", b"x" * 50, None).decode()
    big = "é" * 700
    rows = [(1, "http://a", fake * 40), (2, None, big), (3, "a\r\nWARC/1.0\r\n b", big), (4, "z", None), (5, "z", ""), (None, "z", big)]
    rows += [(6, "l" * 5000, fake * 40), (7, "q", "WARC/1.0\r\nContent-Length: 3\r\n"), (8, "q", "x" * 5000 + "WARC/1.0\r\nContent-Length: 10\r\n\r\n"), (9, "s", "é" * 499), (10, "s", "é" * 499)]
    rows += [(11, "r", "y" * 1000), (11, "r", "y" * 1000), (12, "v", "z" * 400_000)] + [(100 + k, "c", "same" * 300) for k in range(30)]
    pages = spark.createDataFrame(rows, PAGE).repartition(3)
    for archive, span in ((3000, 97), (1 << 28, 1 << 24)):
        got = warc.archive_round_trip(pages.withColumn("record_type", F.lit(1)), archive, span).collect()
        assert sorted((tuple(r) for r in got), key=str) == want(rows)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_false_headers_are_candidates_but_not_reached(spark):
    fake = warc.record(5, "u", b"inner", None).decode()
    pages = spark.createDataFrame([(1, "a", fake * 3), (2, "b", "text")], PAGE).coalesce(1)
    archives = warc.write_archives(warc.with_refers(pages), new_path(spark, "warc"))
    found = warc.candidates(archives, 64)
    assert found.count() == 5 and warc.reachable(found, archives).count() == 2
    cut = archives.withColumn("bytes", F.col("bytes") - 1)
    with pytest.raises(ValueError, match="last byte"):
        warc.reachable(found, cut)


def test_archives_are_read_in_as_many_tasks_as_ranges(spark):
    """The rows that name ranges and records are small; what counts is the bytes behind them."""
    pages = spark.createDataFrame([(k, "u", f"{k} " * 1000) for k in range(200)], PAGE).repartition(2)
    archives = warc.write_archives(warc.with_refers(pages), new_path(spark, "warc"), 1 << 18)
    span = 1 << 15
    ranges = -(-archives.agg(F.sum("bytes")).first()[0] // span)
    found = warc.candidates(archives, span)
    chain = warc.reachable(found, archives)
    assert found.rdd.getNumPartitions() == warc.read_records(chain, span).rdd.getNumPartitions() == ranges > 10
    assert warc.read_records(chain, span).count() == 200


def test_large_jump_tables_meet_in_merge_joins(spark, monkeypatch):
    monkeypatch.setattr(warc, "SENT_JUMPS", 3)
    rows = [(k, "u", f"page {k}") for k in range(40)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGE)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want(rows)
