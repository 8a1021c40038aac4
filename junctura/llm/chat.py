"""Reply trees to formatted conversations.

Messages point to the message they reply to. All root-to-leaf paths of all trees are enumerated
by self-joins that double the reach in each round: a table of jumps over 2^k messages is joined
with itself, and every path found so far with it. Branches are ranked by the sum of their
messages' scores; the best ones of a tree are written in a template, one conversation each.

Template: ``<|turn|>role\\ntext<|end|>\\n`` per message. Control strings inside a role or text get
a backslash after their first bracket, and one more if there are some already, so that removing
one backslash gives the text back. The loss mask is a list of spans, the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.scratch import stored

TURN, END = "<|turn|>", "<|end|>\n"
#: What may follow the first bracket of a control string, of this template or of others.
TAIL = r"(?=/?s>|/?INST\]|</?SYS>>|\|)"
ANSWERING = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, r"$1$2")


def escaped_role(role: Column) -> Column:
    """As a text, and on one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")  # doubled backslashes stay apart from those of a line end
    return unescaped(F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) of every root-to-leaf path: ``up`` counts the steps from the leaf.

    ``messages``: tree, node, parent; a parent that does not exist makes a root. Raises ValueError
    where a message replies to itself through others.
    """
    spark_names = ("tree", "node", "parent")
    known = messages.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    links = messages.select(*spark_names).join(known, (F.col("tree") == F.col("_tree")) & (F.col("parent") == F.col("_node")), "left")
    links = stored(links.select("tree", "node", F.col("_node").alias("to")), "links")
    jumps = stored(links.where("to IS NOT NULL"), "jumps")
    answered = jumps.select("tree", F.col("to").alias("node")).distinct()
    found = stored(links.join(answered, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    largest = messages.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while jumps.limit(1).count():
        if reach > largest:
            raise ValueError("a message replies to itself")
        step = jumps.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "to")
        on = lambda column: (F.col("tree") == F.col("_tree")) & (F.col(column) == F.col("_node"))
        further = found.join(step, on("node")).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"))
        found = stored(found.unionByName(further), "paths")
        twice = jumps.withColumnRenamed("to", "_mid").join(step, on("_mid")).select("tree", "node", "to")
        jumps = stored(twice, "jumps")
        reach *= 2
    return found


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The paths of each tree's ``branches`` highest-scored leaves; ties go to the longer path, then the least leaf."""
    found = stored(paths(messages), "paths")
    scored = found.join(messages.select("tree", "node", "score"), ["tree", "node"])
    leaves = scored.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0)).cast("decimal(38,9)")).alias("score"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).select("tree", "leaf", "rank")
    return found.join(chosen, ["tree", "leaf"])


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, rank, n_turns, formatted, loss) of each chosen path; ``loss`` has (start, length) spans.

    ``messages``: tree, node, parent, role, text, score. NULL roles, texts and scores count as
    empty and 0; offsets and lengths are in code points.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    written = messages.select("tree", "node", (role == ANSWERING).alias("answers"), escaped_role(role).alias("role"), escaped(text).alias("text"))
    rows = best_paths(messages, branches).join(written, ["tree", "node"])
    head = F.concat(F.lit(TURN), F.col("role"), F.lit("\n"))
    rows = rows.withColumns({"head": F.length(head).cast("long"), "turn": F.concat(head, F.col("text"), F.lit(END)), "chars": F.length("text").cast("long")})
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    rows = rows.withColumn("start", F.sum(F.length("turn")).over(order) - F.length("turn") + F.col("head"))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn", "answers", "start", "chars")))
    grouped = rows.groupBy("tree", "leaf", "rank").agg(F.count(F.lit(1)).alias("n_turns"), turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["answers"]), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("length")))
    return grouped.select("tree", "rank", "n_turns", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss"))


def read_turns(whole: Column) -> Column:
    """The (role, text) of every turn of a formatted conversation."""
    parts = F.slice(F.split(whole, r"<\|turn\|>"), 2, 1 << 30)
    role = lambda p: F.substring_index(p, "\n", 1)
    text = lambda p: F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))
    return F.transform(parts, lambda p: F.struct(unescaped_role(role(p)).alias("role"), unescaped(text(p)).alias("text")))


def read_loss(whole: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    piece = lambda s: unescaped(F.substring(whole, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(loss, piece), "")


def chained(rows: DataFrame) -> DataFrame:
    """Messages from rows (conv_id, turn, role, text): each replies to the one before it in its conversation.

    Rows go by turn, NULL first; rows of the same turn by role and text, none is lost. A NULL
    conv_id is a conversation. ``tree`` is the conv_id as text, NULL as an empty one.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    keyed = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text")
    numbered = keyed.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat(rows: DataFrame) -> DataFrame:
    """Each conversation of ``rows`` formatted, read back, and digested. An empty table gives no rows."""
    done = formatted(stored(chained(rows), "messages"))
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.select("tree", "n_turns", F.length("formatted").cast("long").alias("formatted_chars"), F.sha2(turns, 256).alias("turns_sha256"), read_loss(F.col("formatted"), F.col("loss")).alias("under"))
    conv = F.when(F.col("tree") != "", F.col("tree")).cast("long")
    return read.select(
        conv.alias("conv_id"),
        "n_turns",
        "turns_sha256",
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        "formatted_chars",
    )
