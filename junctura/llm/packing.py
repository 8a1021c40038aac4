"""Packing token streams: concatenate all documents, cut every ``length`` tokens.

Two passes give every document its place in one long stream without putting the rows in one
task: encoding notes each document's offset within its partition, the partitions' totals are
added up in order, and a document's place is its partition's plus its own. Windows of fixed
length then cut the stream; a document over a boundary yields one piece on either side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.scratch import TEXTS, give_back, rows_at_once, stored

END = 1
#: Vocabulary files, resolved on the executors: the tokenizer's own and the same one as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Bytes of encoded rows handed on at once.
BATCH = 8 << 20
ENCODED = "doc_id long, part int, first long, n long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Texts of other scripts, or with what may be a special token, go to the tokenizer itself; the
#: faster library with the same vocabulary was compared with it on texts without these.
UNUSUAL = re.compile(r"[^\x00-ɏ]|<\|")


def encoders(vocabulary: str = VOCABULARY, ranks: str = RANKS):
    """A function from a text to its ids, the same as the tokenizer's in ``vocabulary``."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = None  # some 40 MB that most tasks never need
    with open(public_tokenizers.path(ranks), "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        nonlocal whole
        if UNUSUAL.search(text):
            whole = whole or Tokenizer.from_file(public_tokenizers.path(vocabulary))
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(doc_id, part, first, n, ids) of each row: its ids and END, and its offset in its partition.

    ``ids`` are unsigned 32-bit little-endian. Deterministic for a given input partition, so a
    repeated task writes the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode = encoders(vocabulary, ranks)
        part, place = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, first, n, packed = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "part", "first", "n", "ids"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                rows.append((doc_id.as_py(), place, len(found), found.tobytes()))
                place += len(found)
                size += 4 * len(found)
                if size >= BATCH:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def placed(encoded: DataFrame) -> DataFrame:
    """``encoded`` (read twice: a stored table) with ``begin``, each document's place in the stream.

    One row per input partition meets in the running sum and is sent to every task.
    """
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    starts = totals.select(F.col("part").alias("_part"), before.alias("_before"))
    return encoded.join(F.broadcast(starts), F.col("part") == F.col("_part")).withColumn("begin", F.col("_before") + F.col("first"))


def cut(stream: DataFrame, length: int) -> DataFrame:
    """One row per piece of a document: the window it lies in, its offset there and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, n = (batch.column(k).to_numpy() for k in (1, 2))
            windows = (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(begin)), windows)
            window = begin[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            low = np.maximum(begin[row], window * length)
            high = np.minimum((begin + n)[row], (window + 1) * length)
            ids = batch.column(3)
            parts = [ids[int(r)].as_buffer()[4 * int(a) : 4 * int(b)].to_pybytes() for r, a, b in zip(row, low - begin[row], high - begin[row], strict=True)]
            columns = [batch.column(0).take(pa.array(row)), low - begin[row], high - low, n[row], window, low - window * length, pa.array(parts, pa.binary())]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    return stream.select("doc_id", "begin", "n", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text) in sequences of ``length`` ids.

    A row's ids are those of its whole text, NULL as an empty one, then END. Every row is placed,
    repeated ones too; every id lies in one piece; all sequences but the last are full. An empty
    table gives no pieces.
    """
    with rows_at_once(docs.sparkSession, TEXTS):
        encoded = stored(encode_documents(docs, vocabulary, ranks), "encoded")
    return cut(placed(encoded), length)


def sequences(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """(sequence_id, tokens, ids) of the pieces put together: little-endian 32-bit ids.

    A sequence that is not full is padded with zeros, unless its length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.aggregate(parts, F.lit(b""), lambda out, x: F.concat(out, x["ids"])).alias("ids"))
    power = F.bit_count("tokens") == 1
    padding = F.unhex(F.repeat(F.lit("00000000"), (length - F.col("tokens")).cast("int")))
    return whole.withColumn("ids", F.when(power, F.col("ids")).otherwise(F.concat("ids", padding)))


#: Bytes of ids in a chunk; windows that lie whole in one are put together where they are.
CHUNK = 1 << 20
#: Chunks that a worker is to get at once, where the sequences are written under ``rows_at_once``.
CHUNKS_AT_ONCE = 8
CHUNKS = "part int, first long, n long, doc_ids array<long>, lengths array<long>, ids binary"
WHOLE = "sequence_id long, tokens long, ids binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint>>"


def chunked(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """The ids of ``encode_documents`` with those of several documents, some CHUNK bytes, in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode = encoders(vocabulary, ranks)
        part, place, size = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held = [], [], []

        def flush() -> pa.RecordBatch:
            n = sum(lengths)
            row = [[part], [place - n], [n], [doc_ids], [lengths], [b"".join(held)]]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], [f.split()[0] for f in CHUNKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                doc_ids.append(doc_id.as_py())
                lengths.append(len(found))
                held.append(found.tobytes())
                place += len(found)
                size += 4 * len(found)
                if size >= CHUNK:
                    yield flush()
                    doc_ids, lengths, held, size = [], [], [], 0
        if lengths:
            yield flush()
        # an idle worker holds neither the tables of ids nor what the last batch took
        del encode, flush, doc_ids, lengths, held
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, CHUNKS)


def _windows(chunks: DataFrame, length: int, whole: bool) -> DataFrame:
    """The windows that lie ``whole`` in one chunk, or the parts of the others: ids, and pieces by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n, doc_ids, lengths, ids in (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows)):
                ends = begin + np.cumsum(np.array(lengths, dtype=np.int64))
                starts = ends - np.array(lengths, dtype=np.int64)
                rows = []
                for window in range(begin // length, (begin + n - 1) // length + 1):
                    low, high = max(begin, window * length), min(begin + n, (window + 1) * length)
                    if (high - low == length) != whole:
                        continue
                    at = range(int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(starts, high, side="left")))
                    spans = [(doc_ids[k], max(low, int(starts[k])), min(high, int(ends[k])), int(starts[k])) for k in at]
                    pieces = [{"doc_id": d, "start": a - s, "length": b - a, "offset": a - window * length} for d, a, b, s in spans]
                    rows.append((window, high - low, ids[4 * (low - begin) : 4 * (high - begin)], pieces))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("sequence_id", "tokens", "ids", "pieces"), r, strict=True)) for r in rows], schema=_ARROW)

    return chunks.select("begin", "n", "doc_ids", "lengths", "ids").mapInArrow(run, WHOLE)


_PIECE = pa.struct([(name, pa.int64()) for name in ("doc_id", "start", "length", "offset")])
_ARROW = pa.schema([("sequence_id", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])


def packed_sequences(docs: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(sequence_id, tokens, ids, pieces): what ``pack`` cuts, put together to sequences of ids.

    ``pieces`` names the documents in each sequence in order; ``start`` is the piece's first id
    among its document's, ``offset`` its place in the sequence. Only the windows that cross the
    border of a chunk, some one in a hundred, are shuffled. The last sequence is padded with zeros
    to ``length`` unless its length is a power of two. Rows count as in ``pack``: NULL and empty
    texts are an END alone, repeated rows are placed each; other columns are not read; an empty
    table gives no sequences.
    """
    with rows_at_once(docs.sparkSession, TEXTS):
        chunks = stored(chunked(docs, vocabulary, ranks), "chunks")
    placed_chunks = placed(chunks)
    whole, parts = (_windows(placed_chunks, length, x) for x in (True, False))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pieces")[0]["offset"].alias("at"), "ids", "pieces")))
    joined = parts.groupBy("sequence_id").agg(F.sum("tokens").alias("tokens"), ordered.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    padding = F.unhex(F.repeat(F.lit("00000000"), (length - F.col("tokens")).cast("int")))
    padded = F.when(F.bit_count("tokens") == 1, ids).otherwise(F.concat(ids, padding))
    crossing = joined.select("sequence_id", "tokens", padded.alias("ids"), F.flatten(F.transform("parts", lambda x: x["pieces"])).alias("pieces"))
    return whole.unionByName(crossing)


def packing(docs: DataFrame, length: int = 2048) -> DataFrame:
    """``pack`` with the CRC-32 of each piece's ids in their place."""
    pieces = pack(docs, length)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
