"""Secrets in texts: candidates by shape or place, false positives removed by a random forest.

Candidates are long runs of token characters, and whatever is assigned to a name such as password
or token, of any length and with any signs, up to the closing quote or blank. A forest trained on
labelled findings decides which are secrets, from the candidate's length and character classes,
the changes between classes, its entropy, how much of it dictionary words cover, its path and the
words beside it. The dictionary holds the corpus's most frequent short words.

Where no labelled findings are given, narrow rules mark some. The forest then doesn't see what the
rules look at (the naming word and the sign before the candidate), so that it can't repeat them:
it has to tell secrets by the rest. Secrets are never stored: only their digests and measures.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import stored

#: Runs of token characters from this length on are candidates.
LEAST_CHARS = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_\-]{%d,}" % LEAST_CHARS)
#: Names that a secret is assigned to, and the value: in quotes to the closing one, else to the next blank or separator.
NAMES = ("password", "passwd", "pwd", "secret", "token", "key")
ASSIGNED = re.compile(r"""(?i)(?<![^\W_])(?:%s)["']?[ \t]*[:=][ \t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))""" % "|".join(NAMES))
BESIDE = re.compile(r"[^\W\d_]+")
#: How far a neighbouring word may be from the candidate.
REACH = 40
#: Words of up to this many letters, the most frequent ones, make the dictionary.
DICTIONARY_LETTERS, DICTIONARY_WORDS = 6, 3000
#: Hash buckets of a neighbouring word and of a path.
WORD_BUCKETS, PATH_BUCKETS = 16, 8
#: Labelled findings the forest is trained on, of each class, the first by a hash of their place.
TRAINED = 10_000
TREES, DEPTH = 20, 8
#: Numbers of a finding that rules for weak labels look at too: the word and the sign before it. They are the last ones.
NAMED = WORD_BUCKETS + 3
FINDINGS = "doc_id long, path string, start long, length long, token_sha256 string, weak int, features array<double>"


def dictionary(docs: DataFrame) -> frozenset[str]:
    """The most frequent short words of all texts: at most DICTIONARY_WORDS."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}])([a-z]{3,%d})(?![\p{L}\p{N}])" % DICTIONARY_LETTERS), 1))
    counts = docs.select(found.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r.word for r in counts.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect())


def coverage(token: str, known: frozenset[str]) -> float:
    """The share of a token's characters in dictionary words, the longest first at each place."""
    text, at, covered = token.lower(), 0, 0
    while at < len(text):
        for n in range(DICTIONARY_LETTERS, 2, -1):
            if text[at : at + n] in known:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / len(text)


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _buckets(word: str, n: int) -> list[float]:
    out = [0.0] * n
    if word:
        out[zlib.crc32(word.encode()) % n] = 1.0
    return out


def measured(token: str, known: frozenset[str], path: str, before: str, after: str, sign: str) -> list[float]:
    """The numbers that the forest sees of a candidate; the last NAMED are of what stands before it."""
    n = len(token)
    kinds = [_class(c) for c in token]
    counts = Counter(token)
    moves = Counter(a * 4 + b for a, b in zip(kinds, kinds[1:], strict=False))
    shape = [math.log2(n + 1), -sum(k / n * math.log2(k / n) for k in counts.values()), coverage(token, known), float(all(c in "0123456789abcdef" for c in token))]
    shape += [kinds.count(k) / n for k in range(4)]
    shape += [moves[k] / max(n - 1, 1) for k in range(16)]
    return shape + _buckets(after, WORD_BUCKETS) + _buckets(path, PATH_BUCKETS) + _buckets(before, WORD_BUCKETS) + [float(sign == s) for s in ("=", ":", '"')]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate: assigned values, and long runs that are not inside one."""
    assigned = [m.span(m.lastindex) for m in ASSIGNED.finditer(text)]
    found, k = list(assigned), 0
    for m in TOKEN.finditer(text):
        while k < len(assigned) and assigned[k][1] <= m.start():
            k += 1
        if not (k < len(assigned) and assigned[k][0] <= m.start() and m.end() <= assigned[k][1]):
            found.append(m.span())
    return sorted(found)


_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")
_PLAIN = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[A-Z][a-z]+")


def weak_label(token: str, before: str, sign: str) -> int | None:
    """A label by narrow rules, None where they don't say.

    1: an access-key prefix with its fixed length, or a value with digits and letters assigned to
    one of NAMES. 0: only digits, or only letters of one case.
    """
    if _KEY.fullmatch(token) or (before in NAMES and sign in ("=", ":", '"') and re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
        return 1
    return 0 if _PLAIN.fullmatch(token) else None


def findings(docs: DataFrame, known: frozenset[str], path: str = "source") -> DataFrame:
    """Every candidate of every whole text of ``docs`` (doc_id, text and a path): place, digest, weak label, features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "path", "start", "length", "token_sha256", "weak", "features"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64())]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            rows = []
            for doc_id, text, place in zip(*batch.columns, strict=True):
                body, where = text.as_py() or "", place.as_py()
                for start, end in candidates(body):
                    token = body[start:end]
                    left = BESIDE.findall(body[max(0, start - REACH) : start])
                    right = BESIDE.search(body[end : end + REACH])
                    sign = body[max(0, start - 2) : start].rstrip(" ")[-1:]
                    before, after = (left[-1].lower() if left else ""), (right[0].lower() if right else "")
                    numbers = measured(token, known, where or "", before, after, sign)
                    rows.append((doc_id.as_py(), where, start, len(token), hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest(), weak_label(token, before, sign), numbers))
                if len(rows) >= 5000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return docs.select("doc_id", "text", F.col(path).cast("string").alias("path")).mapInArrow(run, FINDINGS)


def unnamed(found: DataFrame) -> DataFrame:
    """``found`` without the numbers that rules for weak labels look at."""
    return found.withColumn("features", F.slice("features", 1, F.size("features") - NAMED))


def train(labelled: DataFrame, limit: int = TRAINED, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest on at most ``limit`` findings of each class (features, is_secret); None unless there are both."""
    pick = lambda k: labelled.where(F.col("is_secret") == k).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(limit)
    rows = stored(pick(0).unionByName(pick(1)).select(array_to_vector("features").alias("x"), F.col("is_secret").cast("double").alias("y")), "labelled")
    if rows.select("y").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(rows)


def judged(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``found`` with ``score``, the forest's share for a secret; 1 for all without a forest."""
    if model is None:
        return found.withColumn("score", F.lit(1.0))
    share: Column = vector_to_array("probability")[1]
    return model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", share).drop("x", "rawPrediction", "probability", "prediction")


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate in ``docs`` (doc_id, text, source): its place and digest, score, is_secret.

    ``labelled``: findings (as of ``findings``) with ``is_secret``, from people or another source;
    those that ``weak_label`` marks over all documents where none are given. NULL and empty texts
    have no candidates; repeated rows repeat theirs; an empty table gives an empty result. Tokens
    are neither returned nor stored. Other columns are not read.
    """
    rows = docs.select("doc_id", "text", "source")
    found = stored(findings(rows, dictionary(rows)), "findings")
    if labelled is None:
        found = unnamed(found)
        labelled = found.where("weak IS NOT NULL").withColumn("is_secret", F.col("weak"))
    scored = judged(found, train(labelled))
    return scored.select("doc_id", "start", "length", "token_sha256", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"))
