"""Repair of conversation structure by the cheapest edits.

A repaired conversation's roles are an optional system turn and pairs of user and assistant. Rows
may be kept, given another role or deleted, and empty turns inserted, each at a price. The edits'
initials in order are the audit; of all cheapest repairs the one whose audit comes first in ASCII
order is taken.

The choice is a shortest path through (row, state) with one whole number as weight: the high
digits carry the cost, below them a fixed number of three-bit digits the audit's letters by
position, zeros behind its end. A path is lengthened at its front, which moves the letters one
digit down, so the plain minimum of whole numbers decides cost and ties at once. Long
conversations are solved in chunks from the end: a chunk starts with the costs of what follows as
its high digits. That loses nothing, as audits of the same rows and equal cost never begin with
one another (they would differ by inserts, which cost), so ties are decided within the chunk.

Only roles, faults and keys of the rows go through this step. The texts meet the chosen edits in
a second sorted stream, where the repaired conversation is hashed row by row: a conversation of
any length takes a few bytes a row in one task, its texts none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.scratch import stored
from junctura.llm.words import WORD

CHUNK = 64
#: Letters of the audit by their digit; ASCII order is the digits' order, 0 is beyond the end.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {digit: letter for letter, digit in DIGIT.items()}
BITS = 3
RETAG, DELETE, INSERT, CUT = 2, 3, 2, 1  # prices; CUT for each truncated row that stays
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
TAKES = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (EMPTY, ASSISTANT)
#: What an insert (or another role) leads to, and the role it has.
TURNED = {EMPTY: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
#: A row's class: what may be done with it.
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)


def _with_inserts(best: list, low: int) -> list:
    """Weights per state when up to two turns may be inserted first; a third would lead back to an earlier state."""

    def put(tail: int) -> int:
        cost, letters = tail >> low, tail & ((1 << low) - 1)
        return (cost + INSERT << low) | (DIGIT["I"] << low - BITS) | (letters >> BITS)

    for _ in range(2):
        longer = [None if best[TURNED[s][0]] is None else put(best[TURNED[s][0]]) for s in range(4)]
        best = [min((w for w in (x, y) if w is not None), default=None) for x, y in zip(best, longer, strict=True)]
    return best


def cheapest(rows: list[tuple[str, int]], after: list[int | None], last: bool) -> tuple[list[int | None], list[str | None]]:
    """(cost, audit) per entry state of ``rows`` (initial, class), given the costs of what follows."""
    low = BITS * (3 * len(rows) + 2)
    mask, top = (1 << low) - 1, low - BITS
    best = [None if cost is None else cost << low for cost in after]
    if last:
        best = _with_inserts(best, low)
    for initial, kind in reversed(rows):
        here: list = []
        for state in range(4):
            edges = [(DELETE, "D", state)]
            if kind in (SOUND, TRUNCATED):
                price = CUT if kind == TRUNCATED else 0
                edges.append((RETAG + price, "R", TURNED[state][0]))
                if (state, initial) in TAKES:
                    edges.append((price, "K", TAKES[state, initial]))
            weights = [((best[to] >> low) + price << low) | (DIGIT[letter] << top) | ((best[to] & mask) >> BITS) for price, letter, to in edges if best[to] is not None]
            here.append(min(weights, default=None))
        best = _with_inserts(here, low)
    audits: list[str | None] = []
    for weight in best:
        digits = [] if weight is None else [(weight >> at) & 7 for at in range(top, -1, -BITS)]
        audits.append(None if weight is None else "".join(LETTER[d] for d in digits if d))
    return [None if w is None else w >> low for w in best], audits


def walked(rows: list[tuple[str, int]], audit: str, state: int) -> Iterator[tuple[str, str, int]]:
    """(letter, role, state after it) of each edit; the role of a kept row is its own: ''."""
    at = 0
    for letter in audit:
        role = ""
        if letter == "K":
            state = TAKES[state, rows[at][0]]
        elif letter in "RI":
            state, role = TURNED[state]
        at += letter != "I"
        yield letter, role, state


def repaired(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of (role's initial, class) rows."""
    after: list = [0 if s in ENDS else None for s in range(4)]
    parts = []
    starts = range(0, max(len(rows), 1), CHUNK)
    for start in reversed(starts):
        after, audits = cheapest(rows[start : start + CHUNK], after, start == starts[-1])
        parts.append(audits)
    cost, state, audit = after[EMPTY], EMPTY, []
    for start, audits in zip(starts, reversed(parts), strict=True):
        audit.append(audits[state])
        for _, _, state in walked(rows[start : start + CHUNK], audit[-1], state):
            pass
    return cost, "".join(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as damaged by crc32 of ``conv_id:turn``, with their place ``ord``, ``copy``.

    A NULL role, text or part of the key counts as one space. Rows of one turn are taken in the
    order of a digest of role and text, as no other order is known.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    given = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    kind = F.crc32(key.cast("binary")) % 20
    hit = given.withColumns({"kind": kind, "ord": F.sha2(F.concat("role", F.lit("\n"), "text"), 256)}).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return hit.select("conv_id", "turn", "ord", role.alias("role"), text.alias("text"), twice)


def faults(rows: DataFrame) -> DataFrame:
    """Light rows (conv_id, turn, ord, copy, initial, kind) of damaged ones; ``kind`` is the first fault's class."""
    text = F.col("text")
    blank = ~text.rlike(WORD)
    ended = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")
    said = F.sha2(F.concat("role", F.lit("\n"), text), 256)
    light = rows.select("conv_id", "turn", "ord", "copy", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), ended.alias("ended"), said.alias("said"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "said").orderBy(F.col("turn").asc_nulls_first(), "ord", "copy"))
    kind = F.when(F.col("blank"), BLANK).when(F.col("earlier") > 1, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
    return light.withColumn("earlier", earlier).select("conv_id", "turn", "ord", "copy", "initial", kind.alias("kind"))


ORDER = ("_no_id", "conv_id", "_no_turn", "turn", "ord", "copy")


def _sorted(rows: DataFrame, *last: str) -> DataFrame:
    """Conversations whole in a partition, their rows in order; NULL turns first."""
    keyed = rows.withColumns({"_no_id": F.col("conv_id").isNull().cast("int"), "_no_turn": F.when(F.col("turn").isNull(), 0).otherwise(1)})
    return keyed.repartition("conv_id").sortWithinPartitions(*ORDER, *last)


def _stretches(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple | None, list]]:
    """(conv_id in a tuple, rows) in pieces as they come; a new conversation begins where the tuple changes."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        rows = list(zip(*columns, strict=True))
        low = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][key] != rows[low][key]:
                yield (rows[low][key],), rows[low:k]
                low = k


def decided(light: DataFrame) -> DataFrame:
    """Per conversation its counts, cost and audit, and per row its edits: rows of both kinds.

    ``no``: -1 for the conversation's row, else the row's place; ``edits``: inserts before the row
    (u, a), then K, D or the new role's initial R + u or a; at the end of the last row inserts again.
    """
    schema = "conv_id long, turn long, ord string, copy int, no long, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(conv: tuple, turns: list, ords: list, copies: list, rows: list) -> pa.RecordBatch:
            known = [t for t in turns if t is not None]
            gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
            initials = [r[0] for r in rows]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            kinds = [r[1] for r in rows]
            cost, audit = repaired(rows)
            edits, pending = [], ""
            for letter, role, _ in walked(rows, audit, EMPTY):
                if letter == "I":
                    pending += role[0]
                else:
                    edits.append(pending + letter + role[:1])
                    pending = ""
            edits[-1] += pending
            n = len(rows)
            whole = [gaps, kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(TRUNCATED), illegal, cost]
            columns = [
                pa.array([*conv] * (n + 1), pa.int64()), pa.array([None, *turns], pa.int64()), pa.array([None, *ords], pa.string()), pa.array([None, *copies], pa.int32()),
                pa.array(range(-1, n), pa.int64()), pa.array([None, *edits], pa.string()), *[pa.array([x] + [None] * n, pa.int64()) for x in whole], pa.array([audit] + [None] * n, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

        conv, held = None, ([], [], [], [])
        for key, rows in _stretches(batches, 0):
            if key != conv:
                if conv is not None:
                    yield told(conv, *held)
                conv, held = key, ([], [], [], [])
            for _, turn, ord_, copy, initial, kind in rows:
                for column, value in zip(held, (turn, ord_, copy, (initial, kind)), strict=True):
                    column.append(value)
        if conv is not None:
            yield told(conv, *held)

    return _sorted(light).select("conv_id", "turn", "ord", "copy", "initial", "kind").mapInArrow(run, schema)


def hashed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256, repaired_turns): damaged ``rows`` as their ``edits`` leave them, hashed in one stream."""
    places = edits.select("conv_id", "turn", "ord", "copy", "no", "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "ord", "copy", F.lit(None).cast("long").alias("no"), F.lit(None).cast("string").alias("edits"), "role", "text")
    # of rows alike in all keys the edits come first, in order, and the texts are equal
    both = _sorted(places.unionByName(texts).withColumn("_tag", F.col("no").isNull().cast("int")), "_tag", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, turns, waiting = None, None, 0, []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*conv], pa.int64()), pa.array([digest.hexdigest()]), pa.array([turns], pa.int64())], ["conv_id", "repaired_sha256", "repaired_turns"])

        def say(role: str, text: str) -> None:
            nonlocal turns
            digest.update(("\n" if turns else "").encode() + f"{role}:{text}".encode())
            turns += 1

        for key, stretch in _stretches(batches, 0):
            if key != conv:
                if conv is not None:
                    yield told()
                conv, digest, turns, waiting = key, hashlib.sha256(), 0, []
            for _, edit, role, text in stretch:
                if edit is not None:
                    waiting.append(edit)
                    continue
                steps, named = waiting.pop(0), {"u": "user", "a": "assistant"}
                at = 0
                while at < len(steps):
                    if steps[at] in named:
                        say(named[steps[at]], "")
                    elif steps[at] == "K":
                        say(role, text)
                    elif steps[at] == "R":
                        at += 1
                        say(named[steps[at]], text)
                    at += 1
        if conv is not None:
            yield told()

    return both.select("conv_id", "edits", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string, repaired_turns long")


def repair(rows: DataFrame) -> DataFrame:
    """Damage ``rows`` (conv_id, turn, role, text) and repair them: one row per conv_id.

    Columns: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. NULL roles
    and texts count as one space; rows with a NULL conv_id are a conversation of their own; NULL
    turns come first and are left out of the gaps. Repeated rows are rows of one turn, so the
    later ones are duplicates. A role other than system, user and assistant goes by its initial.
    A conversation that loses all rows has zeros, an empty audit and the hash of an empty text.
    Other columns are not read. An empty table gives an empty result.
    """
    typed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    hurt = damaged(typed)
    made = stored(decided(faults(hurt)), "edits")
    whole = made.where("no = -1").drop("turn", "ord", "copy", "no", "edits")
    digests = hashed(hurt, made.where("no >= 0"))
    every = typed.select(F.col("conv_id").alias("_conv")).distinct()
    same = F.col("_conv").eqNullSafe(F.col("conv_id"))
    out = every.join(whole, same, "left").drop("conv_id").join(digests, same, "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(
        F.col("_conv").alias("conv_id"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )
