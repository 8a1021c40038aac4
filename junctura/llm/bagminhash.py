"""Near-duplicates by BagMinHash signatures of weighted word shingles.

A document is the multiset of its five-word shingles. Each unit of a shingle's count has its own
Poisson process in every slot of the signature, and a slot holds the earliest time of all units
in the document; two documents agree in a slot with the probability of their weighted Jaccard
similarity. The processes are drawn hierarchically: counts are cut into the ranges (0,1], (1,2],
(2,4], (4,8] ..., one process per range deals its points over units and slots in order of time,
and stops as soon as it is later than every slot of the document.

Signatures are cut into bands; documents that agree in a band share a bucket. Links are sought
within buckets without forming all pairs: every member is compared with the bucket's most
central member, then components are formed. Where a bucket still spans several components, its
members outside the largest one are compared with all members of others, in blocks of longer
signatures, and only pairs whose estimate is near the threshold go on. Every link is verified on
the shingle counts themselves. Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.components import components
from junctura.llm.scratch import give_back, rows_at_once, stored

BANDS, ROWS = 26, 5
SLOTS = BANDS * ROWS
SHINGLE = 5
THRESHOLD = 0.8
#: Longer signatures, of documents that share a bucket only: their estimates are off by 0.0177 at
#: a similarity of 0.8, and pairs are verified down to four times that.
FINE_SLOTS, MARGIN = 512, 0.071
#: Shingles signed at once in a task.
SIGNED = 100_000
MEMBERS = 64
#: Ids or pairs up to this many (16 to 24 bytes each) are sent to the texts; more meet them in a shuffle.
SENT = 2_000_000
BLOCK = 2048
#: Members of a bucket that go by one key; larger buckets are dealt over several keys (bucket, salt).
DEALT = 512
SIGNATURES = "doc_id long, digest binary, bands array<long>"
GOLD, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def token_hashes(text: Column) -> Column:
    """A 64-bit hash of each run of letters and digits, in lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    return F.transform(found, lambda w: F.xxhash64(w))


def scrambled(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finish of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingles(tokens: np.ndarray) -> np.ndarray:
    """A hash per window of SHINGLE tokens; one for all tokens of a shorter text, none without tokens."""
    n = min(SHINGLE, len(tokens))
    if not n:
        return np.empty(0, np.uint64)
    tokens = tokens.astype(np.int64, copy=False).view(np.uint64)
    out = np.full(len(tokens) - n + 1, np.uint64(n))
    for k in range(n):
        out = scrambled(out + GOLD) + tokens[k : len(out) + k]
    return scrambled(out)


def counted(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(tokens), return_counts=True)


def signed(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """The signature of each bag (shingles, counts): a row of times. Those of other lengths are independent."""
    sizes = [len(s) for s, _ in bags]
    doc = np.repeat(np.arange(len(bags)), sizes)
    key, count = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
    ranges = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(key)), ranges)
    level = np.arange(len(row)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1).astype(np.float64)
    inside = np.minimum(count[row], low + width.astype(np.int64)) - low
    doc, state = doc[row], scrambled(scrambled(key[row] + np.uint64(slots)) + GOLD * (level + 1).astype(np.uint64))
    time, out = np.zeros(len(row)), np.full(len(bags) * slots, np.inf)
    whole = inside == width
    while len(doc):
        state = state + GOLD
        drawn, where = scrambled(state), scrambled(state ^ MIX_A)
        time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / width
        unit = (where & np.uint64(0xFFFFFFFF)).astype(np.float64) * width / float(1 << 32)
        use = whole | (unit < inside)
        slot = ((where >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, (doc * slots + slot)[use], time[use])
        latest = out.reshape(-1, slots).max(axis=1)
        going = time < latest[doc]
        doc, state, time, width, inside, whole = (x[going] for x in (doc, state, time, width, inside, whole))
    return out.reshape(-1, slots)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands) of each row; all but doc_id NULL for texts without tokens.

    ``digest`` identifies the token sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def flush(ids: list, digests: list, bags: list) -> pa.RecordBatch:
            times = signed(bags).view(np.uint64)
            band = np.zeros((len(bags), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(ROWS):
                band = scrambled(band + GOLD) + times[:, k::ROWS][:, :BANDS]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bags) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(scrambled(band).view(np.int64).ravel()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "digest", "bands"])

        for batch in batches:
            ids, digests, bags, size = [], [], [], 0
            without = []
            values = batch.column(1).values.to_numpy(zero_copy_only=False)
            ends = batch.column(1).offsets.to_numpy()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                tokens = values[ends[k] : ends[k + 1]]
                if not len(tokens):
                    without.append(doc_id)
                    continue
                ids.append(doc_id)
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                bags.append(counted(tokens))
                size += len(tokens)
                if size >= SIGNED:
                    yield flush(ids, digests, bags)
                    ids, digests, bags, size = [], [], [], 0
            if bags:
                yield flush(ids, digests, bags)
            if without:
                empty = [pa.nulls(len(without), t) for t in (pa.binary(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(without, pa.int64()), *empty], ["doc_id", "digest", "bands"])
        give_back()

    return docs.select("doc_id", token_hashes(F.col("text")).alias("tokens")).mapInArrow(run, SIGNATURES)


def fine_sketches(texts: DataFrame) -> DataFrame:
    """(doc_id, sketch): a byte per slot of a signature of FINE_SLOTS; texts without tokens have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, bags: list) -> pa.RecordBatch:
            low = (scrambled(signed(bags, FINE_SLOTS).view(np.uint64)) & np.uint64(255)).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary())], ["doc_id", "sketch"])

        for batch in batches:
            ids, bags, size = [], [], 0
            values = batch.column(1).values.to_numpy(zero_copy_only=False)
            ends = batch.column(1).offsets.to_numpy()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                tokens = values[ends[k] : ends[k + 1]]
                if len(tokens):
                    ids.append(doc_id)
                    bags.append(counted(tokens))
                    size += len(tokens)
                if size >= SIGNED:
                    yield flush(ids, bags)
                    ids, bags, size = [], [], 0
            if bags:
                yield flush(ids, bags)

    return texts.select("doc_id", token_hashes(F.col("text")).alias("tokens")).mapInArrow(run, "doc_id long, sketch binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, counts)."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    common = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    return float(common) / float(a[1].sum() + b[1].sum() - common)


def _sent(rows: DataFrame, size: int) -> DataFrame:
    return F.broadcast(rows) if size <= SENT else rows


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose documents in ``texts`` are at least as similar as that.

    A document compared with many (``a``) goes along once per MEMBERS of them.
    """
    size = pairs.count()
    many = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts")), "leaders")
    parted = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part"), "b")
    body = texts.select(F.col("doc_id").alias("b"), "text")
    members = body.join(_sent(parted, size), "b").select("a", "part", "b", F.lit(1).alias("role"), "text")
    leaders = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    leaders = body.withColumnRenamed("b", "a").join(_sent(leaders, size), "a").select("a", "part", F.col("a").alias("b"), F.lit(0).alias("role"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            a, b, role = (batch.column(k).to_pylist() for k in (0, 1, 2))
            values = batch.column(3).values.to_numpy(zero_copy_only=False)
            ends = batch.column(3).offsets.to_numpy()
            found = []
            for k in range(len(a)):
                bag = counted(values[ends[k] : ends[k + 1]])
                if role[k] == 0:
                    own = bag
                elif similarity(own, bag) >= threshold:
                    found.append((a[k], b[k]))
            if found:
                left, right = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    rows = members.unionByName(leaders).repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return rows.select("a", "b", "role", token_hashes(F.col("text")).alias("tokens")).mapInArrow(run, "a long, b long")


def _rest_pairs(rest: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs worth verifying in buckets that span components.

    ``rest``: (bucket, salt, salts, doc_id, root, inner); members that are not ``inner`` meet all members of
    another component, a block of signatures against a block at a time. A pair is emitted in the
    least bucket that it shares.
    """
    least = (threshold - MARGIN) * FINE_SLOTS
    blocks = rest.groupBy("bucket").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"),
        F.ceil(F.sum((~F.col("inner")).cast("int")) / BLOCK).cast("int").alias("outer"),
        F.max("salts").alias("salts"),
    )
    shared = rest.groupBy("doc_id").agg(F.collect_set("bucket").alias("shared"))  # at most BANDS each
    rows = rest.drop("salts").join(_every_salt(blocks), DEAL).join(sketches, "doc_id").join(shared, "doc_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n).cast("long")).cast("int")
    data = rows.select("bucket", own("all").alias("at"), every("outer").alias("by"), F.lit(0).alias("role"), "doc_id", "root", "inner", "sketch", "shared")
    asked = rows.where("not inner").select("bucket", every("all").alias("at"), own("outer").alias("by"), F.lit(1).alias("role"), "doc_id", "root", "inner", "sketch", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [])

        def compared() -> list[tuple[int, int]]:
            if not held[0] or not held[1]:
                return []
            ids, roots = (np.array([x[k] for x in held[0]]) for k in (0, 1))
            inner = np.array([x[2] for x in held[0]])
            table = np.frombuffer(b"".join(x[3] for x in held[0]), np.uint8).reshape(-1, FINE_SLOTS)
            found = []
            for doc_id, root, _, sketch, shared in held[1]:
                other = np.flatnonzero((roots != root) & (inner | (ids > doc_id)))
                if len(other):
                    alike = (table[other] == np.frombuffer(sketch, np.uint8)).sum(axis=1)
                    own = set(shared)
                    found += [(int(ids[k]), doc_id) for k in other[alike >= least] if min(own.intersection(held[0][k][4])) == unit[0]]
            return found

        for batch in batches:
            out = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            fields = zip(*(batch.column(k).to_pylist() for k in range(3, 9)), strict=True)
            for key, (role, *member) in zip(keys, fields, strict=True):
                if key != unit:
                    out += compared()
                    unit, held = key, ([], [])
                held[role].append(member)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
        out = compared()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    both = data.unionByName(asked).repartition("bucket", "at", "by").sortWithinPartitions("bucket", "at", "by", "role")
    return both.mapInArrow(run, "a long, b long").distinct()


DEAL = ["bucket", "salt"]


def _shared(bands: DataFrame) -> DataFrame:
    """(bucket, salt, salts, doc_id, n) of the buckets with several members, n of them.

    Members of a large bucket are dealt over ``salts`` keys. The large buckets, at most one per
    DEALT rows, are sent to the members while they are few.
    """
    sizes = stored(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("salts", F.ceil(F.col("n") / DEALT).cast("int")), "sizes")
    large = stored(sizes.where("salts > 1").select(F.col("bucket").alias("_bucket"), F.col("salts").alias("_salts")), "large")
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_salts").cast("long")), F.lit(0)).cast("int").alias("salt")
    dealt = bands.join(_sent(large, large.count()), F.col("bucket") == F.col("_bucket"), "left").select("bucket", salt, "doc_id")
    return stored(dealt.join(_every_salt(sizes), DEAL), "shared")


def _every_salt(rows: DataFrame) -> DataFrame:
    """A row per bucket (with ``salts``) as a row for each of its keys."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def _spanning(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, salt, salts, doc_id, root) of the buckets whose members have several roots."""
    rooted = buckets.join(roots.select(F.col("node").alias("_node"), "root"), F.col("doc_id") == F.col("_node"), "left")
    rooted = rooted.select(*DEAL, "salts", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("salts").alias("salts")).where("x <> y")
    return stored(rooted.drop("salts").join(_every_salt(several).select(*DEAL, "salts"), DEAL), "spanning")


def _one_text(texts: DataFrame) -> DataFrame:
    """A row per doc_id. Texts of ids that stand once, nearly all, are not shuffled."""
    ids = stored(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")), "again")
    size = ids.count()
    if not size:
        return texts
    again = _sent(ids, size)
    once = texts.join(again, F.col("doc_id") == F.col("_again"), "left_anti")
    least = texts.join(again, F.col("doc_id") == F.col("_again"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return once.unionByName(least)


def near_links(docs: DataFrame, signatures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): components of different texts; ``signatures`` has one row per different text."""
    bands = stored(signatures.select("doc_id", F.explode("bands").alias("bucket")).distinct(), "bands")
    shared = _shared(bands)
    central = shared.groupBy("doc_id").agg(F.sum("n").alias("popularity"))
    buckets = stored(shared.join(central, "doc_id").select(*DEAL, "salts", "doc_id", "popularity"), "buckets")
    candidates = stored(buckets.select("doc_id").distinct(), "candidates")
    # rows that repeat a doc_id with other texts: the least text speaks for the id, whichever task reads it
    texts = docs.select("doc_id", "text").join(_sent(candidates, candidates.count()), "doc_id", "left_semi")
    texts = stored(_one_text(texts), "texts")
    place = F.struct("popularity", -F.col("doc_id"))
    leader = buckets.groupBy("bucket").agg((-F.max(place)["col2"]).alias("a"), F.max("salts").alias("salts"))
    star = buckets.drop("salts").join(_every_salt(leader), DEAL).where(F.col("doc_id") != F.col("a")).select("a", F.col("doc_id").alias("b")).distinct()
    with rows_at_once(texts.sparkSession):
        links = stored(verified(stored(star, "pairs"), texts, threshold), "links")
    spanning = _spanning(buckets, components(links))
    counted = spanning.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts"))
    largest = counted.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("salts").alias("salts"))
    rest = stored(spanning.drop("salts").join(_every_salt(largest), DEAL).select(*DEAL, "salts", "doc_id", "root", (F.col("root") == F.col("top")).alias("inner")), "rest")
    with rows_at_once(texts.sparkSession):
        sketches = stored(fine_sketches(texts.join(rest.select("doc_id").distinct(), "doc_id", "left_semi")), "sketches")
    pairs = stored(_rest_pairs(rest, sketches, threshold), "pairs")
    return components(stored(links.unionByName(verified(pairs, texts, threshold)), "links"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per doc_id of ``docs`` (doc_id, text): doc_id, class_id, class_size.

    ``class_id`` is the least doc_id of the class. Documents with the same tokens are one class
    at once; of them only one goes on. NULL, empty and other texts without tokens are a class each.
    Rows with the same doc_id are one document; rows without a doc_id are left out, as nothing
    could name them. An empty table gives an empty result.
    """
    with rows_at_once(docs.sparkSession):
        signatures = stored(sign(docs.where("doc_id IS NOT NULL")), "signatures")
    first = stored(signatures.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first")), "first")
    each = stored(signatures.select("doc_id", F.col("digest").alias("_digest")).join(first, F.col("_digest") == F.col("digest"), "left").select("doc_id", F.coalesce("first", "doc_id").alias("first")), "each")
    heads = signatures.join(first.select(F.col("first").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    roots = near_links(docs, stored(heads, "heads"), threshold)
    rooted = each.join(roots, F.col("first") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "first")).alias("class_id"))
    rooted = stored(rooted, "classes")
    sizes = rooted.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return rooted.join(sizes, "class_id").select("doc_id", "class_id", "class_size")


def near_filter(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class, and those without a doc_id."""
    others = stored(near_classes(docs, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("_n_id")), "others")
    return docs.join(_sent(others, others.count()), F.col("doc_id") == F.col("_n_id"), "left_anti").select(*docs.columns)
