"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded texts.

Folding undoes what hides a word: case, look-alike letters of other scripts, digits and signs in
place of letters, invisible characters. The lexicon is learned from labelled documents: word
beginnings that are far more frequent in toxic ones, weighted by their log odds. Exception
phrases, learned too or given, are contexts of a lexicon word found in clean documents; hits
inside them do not count. A text's score is a logistic function of the weight of its hits, whole
and per word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import stored

#: Labelled documents of each class that the lexicon and the curve are fitted on, the first by a hash of their id.
FITTED = 8000
#: Word beginnings of these lengths may enter the lexicon, beside whole words up to LONGEST.
PREFIXES = range(4, 9)
LONGEST = 24
#: All terms and exceptions that pass the limits below are taken. They come to the driver and to
#: every task; more than this raise ValueError.
MOST_TERMS = 1_000_000
#: A term is in this share of the toxic documents at least, its odds are e^LEAST_WEIGHT at least,
#: and the likelihood ratio against equal shares in both classes is LEAST_RATIO at least.
LEAST_SHARE, LEAST_WEIGHT, LEAST_RATIO = 0.002, 2.5, 12.0
#: A toxic document speaks for this many chosen terms, so that copies of it don't bring in all of its words.
SPOKEN = 3
#: Distinct terms a task counts before it hands its counts on.
COUNTED = 300_000

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ℓ": "l", "ⅼ": "l",
}
# fixed values: digits and signs in place of letters
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
INVISIBLE = "​‌‍⁠﻿­"

_FOLD = str.maketrans(LOOKALIKES | dict.fromkeys(INVISIBLE, ""))
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_HIDDEN = re.compile("[" + "".join(LOOKALIKES) + INVISIBLE + "]")
#: A run of digits or signs, and the rest of the word if a letter follows: then they stand for letters.
#: The last group has digits at the word's end; they do too if an earlier run is between letters.
_DISGUISED = re.compile(r"[0-9@$!|+]+(?:[^\W\d_]+((?:[0-9@$!|+]+[^\W\d_]+)*)([0-9]*))?")
_BETWEEN = re.compile(r"[\W_]+")


def _undone(m: re.Match) -> str:
    if m[2] is None:
        return m[0]
    if m[2] and not m[1]:
        before = m.string[m.start() - 1 : m.start()]
        if not before.isalnum() or before.isdecimal():
            return m[0][: -len(m[2])].translate(_SUBSTITUTE) + m[2]
    return m[0].translate(_SUBSTITUTE)


def folded(text: str) -> str:
    """The words of ``text`` in folded form, one space before and after each."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if _HIDDEN.search(text):
        text = text.translate(_FOLD)
    text = _DISGUISED.sub(_undone, text)
    return f" {_BETWEEN.sub(' ', text).strip()} "


def beginnings(words: Iterable[str]) -> set[str]:
    """What may enter the lexicon: first letters of words, and whole words with the space after them."""
    found = set()
    for word in set(words):
        if word.isalpha():
            found.update(word[:n] for n in PREFIXES if n <= len(word))
            found.add(f"{word[:LONGEST]} " if len(word) <= LONGEST else word[:LONGEST])
    return found


@dataclass
class Lexicon:
    """Weighted word beginnings, exception phrases, and the curve from weights to a score."""

    weights: dict[str, float]
    exceptions: dict[str, None]
    curve: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(f" {term}", (len(term), weight))
        for phrase in self.exceptions:
            key = f" {phrase} "
            # a phrase with a weight of its own keeps both entries apart by the space at its end
            found.add_word(key, (len(phrase) + 1, None))
        found.make_automaton()
        return found


def hits(automaton, text: str) -> list[tuple[int, float]]:
    """(place, weight) of each word of a folded text that begins with a term, exceptions left out.

    Of several terms at one place the longest counts.
    """
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    if not len(automaton):
        return []
    for end, (length, weight) in automaton.iter(text):
        start = end - length + 1
        if weight is None:
            spared.append((end - length, end))
        elif length > best.get(start, (0, 0.0))[0]:
            best[start] = (length, weight)
    counted, reach = [], -1  # exceptions by their start: ``reach`` is the furthest end of those begun so far
    spared.sort(reverse=True)
    for at, (_, w) in sorted(best.items()):
        while spared and spared[-1][0] <= at:
            reach = max(reach, spared.pop()[1])
        if at >= reach:
            counted.append((at, w))
    return counted


def measures(found: list[tuple[int, float]], words: int) -> tuple[float, float]:
    """The weight of the hits, whole and per thousand words, on a log scale."""
    weight = sum(w for _, w in found)
    return math.log1p(weight), math.log1p(1000 * weight / max(words, 20))


def curve_score(curve: tuple[float, float, float], x: tuple[float, float]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + math.exp(-min(max(z, -50.0), 50.0)))


def _counts(texts: DataFrame, terms_of) -> DataFrame:
    """(term, toxic, n): documents of each class with a term, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts.update((t, toxic) for t in terms_of(folded(text.as_py() or "")))
                if len(counts) >= COUNTED:
                    yield flush()
        if counts:
            yield flush()

    raw = texts.select("text", F.col("toxic").cast("int")).mapInArrow(run, "term string, toxic int, n long")
    return raw.groupBy("term", "toxic").agg(F.sum("n").alias("n")).groupBy("term").pivot("toxic", [0, 1]).agg(F.sum("n")).na.fill(0).toDF("term", "clean", "toxic")


def fitted_rows(docs: DataFrame, labels: DataFrame, limit: int = FITTED) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents to fit on: ``limit`` of each class at most.

    At most 2 * limit ids are sent to the tasks; the texts are not shuffled.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda k: one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = stored(pick(0).unionByName(pick(1)), "fitted").withColumnRenamed("doc_id", "_t_id")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_t_id")).select("doc_id", "text", "toxic")


def _ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """The log likelihood ratio (G squared) of a term's counts against equal shares in both classes."""
    share = (toxic + clean) / (n_toxic + n_clean)
    part = lambda k, n, p: k * math.log(k / (n * p)) if k else 0.0
    pairs = ((toxic, n_toxic), (clean, n_clean))
    return 2 * sum(part(k, n, share) + part(n - k, n, 1 - share) for k, n in pairs if n and 0 < share < 1)


def _chosen_terms(rows: list, documents: list[set[str]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms by falling likelihood ratio, as long as enough toxic documents still need one.

    ``documents``: the candidate terms in each toxic document. Of nested terms the first stays.
    """
    odds = lambda r: math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1))
    ratio = lambda r: _ratio(r.toxic, r.clean, n_toxic, n_clean)
    known = sorted(((ratio(r), len(r.term), r.term, odds(r)) for r in rows), reverse=True)
    holding: dict[str, list[int]] = {}
    for k, terms in enumerate(documents):
        for term in terms:
            holding.setdefault(term, []).append(k)
    spoken = [0] * len(documents)
    chosen: dict[str, float] = {}
    inside: set[str] = set()
    least = max(3, math.ceil(LEAST_SHARE * n_toxic))
    for strength, _, term, weight in known:
        if strength < LEAST_RATIO or weight < LEAST_WEIGHT:
            continue
        if term in inside or any(term[:n] in chosen for n in range(1, len(term))):
            continue
        needing = [k for k in holding.get(term, ()) if spoken[k] < SPOKEN]
        if len(needing) < least:
            continue
        for k in holding[term]:
            spoken[k] += 1
        chosen[term] = weight
        inside.update(term[:n] for n in range(1, len(term)))
    return chosen


def _terms_within(texts: DataFrame, known: set[str]) -> list[set[str]]:
    """Of each of the (at most FITTED) texts, the known terms that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(known & beginnings(folded(t.as_py() or "").split())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["terms"])

    return [set(r.terms) for r in texts.select("text").mapInArrow(run, "terms array<string>").collect()]


def _bounded(terms: DataFrame) -> list:
    """The rows of ``terms`` on the driver; more than MOST_TERMS raise ValueError."""
    rows = terms.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms pass the limits")
    return rows


def _contexts(automaton, text: str) -> set[str]:
    """The words around each hit: the whole word, with the one before it and with the one after it."""
    found = set()
    for at, _ in hits(automaton, text):
        end = text.index(" ", at)
        word = text[at:end]
        found.add(word)
        before, after = text[: at - 1].rpartition(" ")[2], text[end + 1 :].partition(" ")[0]
        if before:
            found.add(f"{before} {word}")
        if after:
            found.add(f"{word} {after}")
    return found


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a little shrinkage; no factor is negative."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + np.array([0, 1e-2, 1e-2]) * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(bend, slope)
        beta = beta - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0)), float(max(beta[2], 0.0))


def learn(docs: DataFrame, labels: DataFrame, limit: int = FITTED, exceptions: Iterable[str] = ()) -> Lexicon:
    """A lexicon from ``labels`` (doc_id, toxic 0/1). Without toxic labels it is empty and scores are 0."""
    texts = stored(fitted_rows(docs, labels, limit), "labelled")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_toxic:
        return Lexicon({}, {}, (-50.0, 0.0, 0.0))
    counts = _counts(texts, lambda text: beginnings(text.split()))
    frequent = counts.where((F.col("toxic") >= max(3, math.ceil(LEAST_SHARE * n_toxic))) & (F.col("toxic") * (n_clean + 1) > 8 * F.col("clean") * (n_toxic + 1)))
    rows = _bounded(frequent)
    documents = _terms_within(texts.where("toxic = 1"), {r.term for r in rows})
    lexicon = Lexicon(_chosen_terms(rows, documents, n_toxic, n_clean), dict.fromkeys(folded(x).strip() for x in exceptions), (0.0, 0.0, 0.0))

    around: list = []  # the automaton cannot travel, each task builds its own

    def contexts(text: str) -> set[str]:
        if not around:
            around.append(lexicon.automaton())
        return _contexts(around[0], text)

    spared = _counts(texts, contexts).where((F.col("clean") >= 3) & (F.col("clean") * (n_toxic + 1) > 5 * F.col("toxic") * (n_clean + 1)))
    lexicon.exceptions |= dict.fromkeys(sorted(r.term for r in _bounded(spared) if r.term not in lexicon.weights))
    sample = scored(texts, lexicon, measured=True).select("toxic", "x", "y").toPandas()  # at most 2 * limit rows
    y = sample["toxic"].to_numpy(float)
    everyone = {r.toxic: r["count"] for r in labels.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    weight = np.where(y == 1, everyone[1] / n_toxic, everyone.get(0, 0) / max(n_clean, 1))
    lexicon.curve = _fit_curve(sample[["x", "y"]].to_numpy(), y, weight / weight.mean())
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, measured: bool = False) -> DataFrame:
    """``docs`` (with ``text``, which goes) with ``score``; with ``measured`` also the curve's inputs x and y.

    NULL and empty texts score as texts without hits. Whole texts are matched.
    """
    keep = [c for c in docs.columns if c != "text"]
    extra = "score double" + (", x double, y double" if measured else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = []
            for value in batch.column(len(keep)):
                text = folded(value.as_py() or "")
                found.append(measures(hits(automaton, text), text.count(" ") - 1))
            columns = [pa.array([curve_score(lexicon.curve, x) for x in found], pa.float64())]
            if measured:
                columns += [pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)]
            names = [*keep, "score", *(["x", "y"] if measured else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), extra])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Labels of documents whose crc32(doc_id as text) is divisible by ``folds`` are not learned from.
    NULL and empty texts score as texts without hits; a NULL doc_id is not held out. Repeated rows
    score alike, each for itself; labels that repeat a doc_id count once, as toxic if any is. Other
    columns, also those named like the result's, are not read. An empty ``docs`` gives an empty
    result, labels without a toxic one scores of 0.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    lexicon = learn(docs, labels.select("doc_id", "toxic").where(~held))
    out = scored(docs.select("doc_id", "text"), lexicon)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
