"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix. Of all rates between
0 and ``cap`` that give each source its target of words, those closest to 1 in relative entropy
are ``least(cap, exp(lambda * size / mean size))`` with one multiplier per source: an exponential
tilt. The multipliers solve the convex dual by Newton steps; each step is one aggregate over a
table of (source, size, documents). Rates become whole copies by ordered sampling: the whole part
of a rate is certain, and the words still lacking are taken from the documents in the order of
``hash / fraction`` until the target is met; a few last documents are added or dropped to close the gap.
All decisions follow from the source's row of numbers and from the document's own id and size.
Sums are decimal, so that reruns agree to the last copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.scratch import stored
from junctura.llm.words import word_count

EXACT = "decimal(38,6)"
STEPS = 80
#: Newton stops when no source is further from its target than this share of it.
CLOSE = 1e-7
#: Documents a source may add or drop in the end, one a round, each the one that leaves the least gap.
LAST_MOVES = 3
MOVES = "array<struct<doc_id:bigint,size:bigint,by:int>>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, docs, target) from (source, size).

    Sources in code point order, NULL last, get the weights in turn and share the sum of all
    sizes. No target is above ``cap`` times its source's size: what is above goes to the other
    sources by weight, until none is above. That is min(cap * size, weight * level) for one
    level, found with running sums over the sources, the first to reach their cap first.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    weighted = totals.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    # leaving out a source raises the level as long as that source is above its cap, then lowers it
    level = (F.sum("source_size").over(everything) - capped) / F.sum("weight").over(onward)
    leveled = weighted.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return leveled.select("source", "source_size", "docs", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _with(rows: DataFrame, rules: DataFrame, on: str = "source") -> DataFrame:
    """``rows`` with the numbers of their source. The few rows of ``rules`` are broadcast if small."""
    return rows.join(rules.withColumnRenamed("source", "_m_source"), _same(on, "_m_source"), "inner").drop("_m_source")


def _rate(size: Column, cap: float) -> Column:
    tilt = F.exp(F.least(F.col("multiplier") * size / F.col("unit"), F.lit(700.0)))
    return F.when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(cap), tilt))


def multipliers(sizes: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """``targets`` with each source's ``unit`` (mean size) and ``multiplier``.

    The dual's slope for a source is the words taken less the target, its curvature the words
    taken below the cap times size. A step that would leave the known bracket halves it instead.
    """
    counted = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    state = stored(
        targets.withColumns(
            {"unit": F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)), "multiplier": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}
        ),
        "mix",
    )
    for _ in range(STEPS):
        size, rate = F.col("size").cast("double"), _rate(F.col("size"), cap)
        words = F.col("n") * size * rate
        bend = F.when(rate < cap, words * size / F.col("unit")).otherwise(0.0)
        sums = _with(counted, state).groupBy("source").agg(F.sum(words.cast(EXACT)).cast("double").alias("words"), F.sum(bend.cast(EXACT)).cast("double").alias("bend"))
        met = state.join(sums.withColumnRenamed("source", "_m_source"), _same("source", "_m_source"), "left").drop("_m_source")
        free = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size"))
        slope = F.when(free, F.col("words") - F.col("target")).otherwise(0.0)
        done = F.abs(slope) <= CLOSE * F.col("target")
        low = F.when(slope < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(slope > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - slope / F.col("bend")
        inside = (F.col("bend") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        step = 2 * F.abs(F.col("multiplier")) + 1
        other = F.when(low.isNull(), high - step).when(high.isNull(), low + step).otherwise((low + high) / 2)
        state = stored(
            met.withColumns({"done": done, "next": F.when(done, F.col("multiplier")).when(inside, newton).otherwise(other), "_low": low, "_high": high})
            .select("source", "source_size", "docs", "target", "unit", F.col("next").alias("multiplier"), F.col("_low").alias("low"), F.col("_high").alias("high"), "done"),
            "mix",
        )
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.drop("low", "high", "done")


def _order_key(rate: Column, seed: int) -> Column:
    """hash / fraction: where a document stands among those that may get one more copy."""
    part = rate - F.floor(rate)
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    return F.when(part > 0, drawn / part)


def mixing_rules(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """One row per source with all that decides its documents' copies, from (doc_id, source, size).

    To find the last document that still fits, each source's candidates are cut into about as
    many ranges of the order key as a range has documents; only one range a source is ranked.
    """
    state = stored(multipliers(sizes, source_targets(sizes, weights, float(cap)), float(cap)), "mix")
    rate = _rate(F.col("size"), float(cap))
    rows = _with(sizes, state).where("size > 0").withColumns({"rate": rate, "whole": F.floor(rate), "key": _order_key(rate, seed)})
    ranges = F.greatest(F.ceil(F.sqrt(F.col("docs"))), F.lit(1))
    rows = rows.withColumn("range", F.least(F.floor(F.col("key") * ranges), 4 * ranges))
    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    drawable = rows.where("key IS NOT NULL")
    by_range = drawable.groupBy("source", "range").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    lacking = stored(_with(state, certain).withColumn("lack", F.col("target") - F.col("certain")).select("source", "lack", "docs"), "lack")
    cut = stored(
        _with(by_range.withColumn("before", running - F.col("words")), lacking)
        .where(F.col("before") <= F.col("lack"))
        .groupBy("source")
        .agg(F.max("range").alias("cut"), F.max_by("before", "range").alias("before"), F.first("lack").alias("lack")),
        "cut",
    )
    near = _with(drawable.select("source", "doc_id", "size", "key", "range"), cut).where(F.col("range") == F.col("cut"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    ranked = near.withColumn("sum", F.col("before") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    last = ranked.where(F.col("sum") <= F.col("lack")).groupBy("source").agg(F.max(F.struct("key", "doc_id", "size")).alias("last"), F.max("sum").alias("reached"))
    reached = (
        cut.join(last.withColumnRenamed("source", "_m_source"), _same("source", "_m_source"), "left")
        .drop("_m_source")
        .withColumn("gap", F.col("lack") - F.coalesce(F.col("reached"), F.col("before")))
    )
    state = state.join(reached.select(F.col("source").alias("_m_source"), "cut", "last", "gap"), _same("source", "_m_source"), "left").drop("_m_source")
    state = stored(state.withColumn("moves", F.array().cast(MOVES)), "edge")
    for _ in range(LAST_MOVES):
        placed = copies(sizes.where("size > 0"), state, cap, seed)
        left = lambda sign: F.abs(F.col("gap") - sign * F.col("size"))
        helps = lambda sign, may: F.when(may & (left(sign) < F.abs(F.col("gap"))), left(sign))
        more = helps(1, (F.col("copies") < cap) & (F.col("target") > 0))
        less = helps(-1, F.col("copies") > 0)
        best = (
            placed.where(F.col("moved") == 0)
            .withColumns({"more": more, "less": less})
            .withColumn("rest", F.least("more", "less"))
            .where("rest IS NOT NULL")
            .groupBy("source")
            .agg(F.min(F.struct("rest", "doc_id", "size", F.when(F.col("rest") == F.col("more"), 1).otherwise(-1).alias("by"))).alias("best"))
        )
        step = state.join(best.withColumnRenamed("source", "_m_source"), _same("source", "_m_source"), "left").drop("_m_source")
        move = F.array(F.struct(F.col("best.doc_id").alias("doc_id"), F.col("best.size").alias("size"), F.col("best.by").alias("by")))
        moves = F.when(F.col("best").isNull(), F.col("moves")).otherwise(F.concat("moves", move))
        gap = F.when(F.col("best").isNull(), F.col("gap")).otherwise(F.col("gap") - F.col("best.by") * F.col("best.size"))
        state = stored(step.withColumns({"moves": moves, "gap": gap}).drop("best"), "edge")
    return state


def _drawn() -> Column:
    """Whether a document's place in the order is before the cut."""
    here = F.struct("key", "doc_id", "size")
    return F.coalesce((F.col("range") < F.col("cut")) | ((F.col("range") == F.col("cut")) & (here <= F.col("last"))), F.lit(False))


def copies(rows: DataFrame, rules: DataFrame, cap: int = 3, seed: int = 0) -> DataFrame:
    """``rows`` (doc_id, source, size and others) with ``rate`` and ``copies``."""
    rate = _rate(F.col("size"), float(cap))
    ranges = F.greatest(F.ceil(F.sqrt(F.col("docs"))), F.lit(1))
    placed = _with(rows, rules).withColumns({"rate": rate, "key": F.when(F.col("size") > 0, _order_key(rate, seed))})
    placed = placed.withColumn("range", F.least(F.floor(F.col("key") * ranges), 4 * ranges))
    mine = F.filter(F.col("moves"), lambda m: m["doc_id"].eqNullSafe(F.col("doc_id")) & (m["size"] == F.col("size")))
    moved = F.coalesce(F.aggregate(mine, F.lit(0), lambda total, m: total + m["by"]), F.lit(0))
    whole = F.when(F.col("size") > 0, F.floor("rate")).otherwise(F.lit(1))
    return placed.withColumn("moved", moved).withColumn("copies", (whole + _drawn().cast("int") + F.col("moved")).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): size, its source's numbers, copies, words taken.

    NULL and empty texts have size 0 and stay once; a NULL source is a source of its own, the
    last; repeated rows are alike in everything; an empty table gives an empty result.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixed")
    placed = copies(sizes, mixing_rules(sizes, weights, cap, seed), cap, seed)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. The texts are not shuffled."""
    size = word_count(F.col("text"))
    sizes = stored(docs.select("doc_id", "source", size.alias("size")), "mixed")
    whole = docs.select("doc_id", "source", size.alias("size"), F.struct(*docs.columns).alias("_row"))
    placed = copies(whole, mixing_rules(sizes, weights, cap, seed), cap, seed).where("copies > 0")
    return placed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
