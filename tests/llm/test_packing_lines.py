import hashlib
import zlib

import numpy as np
import corpus_pipeline
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from junctura.llm.lines import line_dedup, spread_lines, without_spread_lines
from junctura.llm import packing as P
from junctura.llm.packing import encoders, pack, packed_sequences, packing, sequences

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE = encoders()


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r\xa0ab'sLl1²½éÇß.,-<|>", max_size=80)))
def test_ids_are_the_tokenizers(text):
    if "\ud800" <= max(text, default="") <= "\udfff":
        return
    assert ENCODE(text) == ids(text)[:-1]


def test_special_token_and_long_run():
    for text in ("a <|endoftext|> b", "x" * 20_000, " " * 5000 + "a", "\n" * 3000):
        assert ENCODE(text) == ids(text)[:-1]


@pytest.mark.parametrize("length", [8, 2048])
def test_pieces(documents, length):
    rng = np.random.default_rng(4)
    texts = [None, "", "word " * 3000] + [" ".join(rng.choice(["alpha", "béta", "12", "?", "漢字"], n)) for n in rng.integers(0, 60, 40)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(5, texts[5], "s"), (5, texts[5], "s")]
    got = packing(documents(rows, "start offset").repartition(5), length).toPandas()
    for doc_id, part in got.groupby("doc_id"):
        want = ids(texts[doc_id])
        assert (part.doc_tokens == len(want)).all()
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
        covered = np.zeros(len(want), int)
        for r in part.itertuples():
            covered[r.start : r.start + r.length] += 1
        assert (covered == (3 if doc_id == 5 else 1)).all()
    total = 0
    for number, part in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert number == total // length and (part.offset == np.cumsum(part.length) - part.length).all()
        total += part.length.sum()
        assert part.length.sum() == length or number == got.sequence_id.max()
    assert total == sum(len(ids(t)) for _, t, _ in rows)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
@pytest.mark.parametrize("length", [8, 2048])
def test_packed_sequences_hold_every_id(documents, monkeypatch, length, chunk):
    """The ids read back through the pieces are each document's, in chunks of a few ids or of all."""
    monkeypatch.setattr(P, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    texts = [None, "", "word " * 700] + [" ".join(rng.choice(["alpha", "béta", "12", "?", "漢字"], n)) for n in rng.integers(0, 60, 30)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(5, texts[5], "s")]
    got = sorted(packed_sequences(documents(rows, "ids pieces").repartition(4), length).collect())
    total = sum(len(ids(t)) for _, t, _ in rows)
    assert [r.sequence_id for r in got] == list(range(-(-total // length))) and sum(r.tokens for r in got) == total
    back = {}
    for r in got:
        values = np.frombuffer(r.ids, "<u4")
        power = r.tokens & (r.tokens - 1) == 0
        assert len(values) == (r.tokens if power else length) and not values[r.tokens :].any()
        assert [p.offset for p in r.pieces] == np.cumsum([0, *[p.length for p in r.pieces]])[:-1].tolist() and sum(p.length for p in r.pieces) == r.tokens
        for p in r.pieces:
            back.setdefault((p.doc_id, p.start), []).append(values[p.offset : p.offset + p.length].tolist())
    for k, text in enumerate(texts):
        want = ids(text)
        found = sorted((start, part) for (doc, start), parts in back.items() if doc == k for part in parts)
        if k != 5:  # 5 stands twice, cut in two ways
            assert sum((part for _, part in found), []) == want
        else:
            assert all(part == want[start : start + len(part)] for start, part in found) and sum(len(part) for _, part in found) == 2 * len(want)
    assert packed_sequences(documents([]), length).count() == 0


def test_jobs_on_long_rows_send_few_at_once(documents, monkeypatch):
    """Chunks of 1 MB, texts and shingles: an Arrow batch of 10,000 rows, or all of a task, would be tens of MB."""
    from junctura.llm import bagminhash as B

    docs, sent = documents([(k, "alpha beta gamma " * 40 + str(k), "s") for k in range(20)]), {}
    read = lambda: (int(docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), docs.sparkSession.conf.get("spark.sql.parquet.enableVectorizedReader"))
    before = read()
    for module in (P, B, corpus_pipeline):
        monkeypatch.setattr(module, "stored", lambda df, name, real=module.stored: sent.update({name: read()}) or real(df, name))
    assert corpus_pipeline.pack_sequences(docs.sparkSession, docs, "").count() and B.near_classes(docs, 0.8).count() == 20
    assert sent["sequences"] == (8, "false") and sent["chunks"] == sent["signatures"] == sent["sketches"] == (500, "false")
    assert read() == before


def test_sequences(documents):
    docs = documents([(1, "one two three four five", "s"), (2, None, "s"), (3, "six", "s")])
    out = sorted(sequences(pack(docs.coalesce(1), 4), 4).collect())
    assert [r.sequence_id for r in out] == list(range(len(out))) and all(len(r.ids) in (4, 8, 16) for r in out)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4")[: r.tokens] for r in out]).tolist()
    assert whole == [i for t in ("one two three four five", None, "six") for i in ids(t)]
    assert packing(documents([])).count() == 0


def clean(rows, sites):
    found = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                found.setdefault(line, set()).add(site)
    gone = {line for line, s in found.items() if len(s) >= sites}
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if x not in gone]
        out.append((i, len(lines), len(lines) - len(left), len("\n".join(left)), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sites", [2, 10, 60])
def test_lines_against_brute_force(documents, sites):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        lines = [f"on {n} sites" for n in (1, 2, 9, 10, 11, 50, 59, 60, 61, 70) if k % 100 < n] + ["", " ", f"own {k}", "é" * int(rng.integers(1, 4))]
        rows.append((k, "\n".join(rng.permutation(lines)), f"site{k % 100}" if k % 100 else None))
    rows += [(900, None, "site1"), (901, "", None), rows[0], (902, "long " * 50_000 + "\non 70 sites", "x")]
    docs = documents(rows, "line _x").repartition(4)
    assert sorted((tuple(r) for r in line_dedup(docs, sites).collect()), key=str) == clean(rows, sites)
    sent, joined = without_spread_lines(docs, sites), without_spread_lines(docs, sites, sent=0)
    assert sent.exceptAll(joined).count() == 0 == joined.exceptAll(sent).count()


def test_no_lines(documents):
    assert line_dedup(documents([])).count() == 0 and spread_lines(documents([(1, None, None)])).count() == 0


def test_encoders_get_few_texts_at_once(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, real = spark.conf.get(key), P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: seen.append(spark.conf.get(key)) or real(df, name))
    docs = spark.createDataFrame([(k, "some words " * k) for k in range(20)], "doc_id long, text string")
    assert P.packed_sequences(docs).count() and P.pack(docs).count()
    assert seen == [str(P.TEXTS)] * 2 and spark.conf.get(key) == before


def test_chunks_are_written_as_small_pages(documents, monkeypatch):
    """Else all chunks of a task, tens of MB, would be compressed and read as one page."""
    seen = {}
    store = P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: seen.setdefault(name, store(df, name)))
    words = np.random.default_rng(7).choice(["one", "two", "three", "four"], (6, 270_000))
    got = packed_sequences(documents([(i, " ".join(row), "a") for i, row in enumerate(words)]).coalesce(1))
    files = seen["chunks"].inputFiles()
    assert got.agg({"tokens": "sum"}).first()[0] == 6 * 270_001 and len(files) == 1
    parquet, hadoop = got.sparkSession._jvm.org.apache.parquet.hadoop, got.sparkSession._jvm.org.apache.hadoop
    file = parquet.util.HadoopInputFile.fromPath(hadoop.fs.Path(files[0]), hadoop.conf.Configuration())
    reader = parquet.ParquetFileReader.open(file)
    blocks = [(b.getRowCount(), c) for b in reader.getFooter().getBlocks() for c in b.getColumns() if c.getPath().toDotString() == "ids"]
    found = [(rows, reader.readOffsetIndex(c).getPageCount()) for rows, c in blocks]
    reader.close()
    assert sum(rows for rows, _ in found) == 6 and all(2 * pages >= rows for rows, pages in found)
