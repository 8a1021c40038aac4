"""Quality rules per document, and verdicts per host from shrunk failure rates.

Every document is measured by itself; failures of each rule are added up by host. A host's
rate is shrunk towards the rate of all hosts by a beta prior fitted to the hosts' rates, so
that a few bad documents do not condemn a small host. A host where any shrunk rate exceeds
``host_limit`` loses all its documents; elsewhere a document goes only by its own base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import stored
from junctura.llm.words import SPACES, WORD, let, removed, words

SYMBOLS = r"[#*$%&|<>]"
#: Hosts up to this many are sent to every task (at most some 30 MB); more are joined by a shuffle.
SENT_HOSTS = 200_000
RULES = ("base", "symbols", "lines")


def _paired(ordered: Column, key: str) -> Column:
    """The entries of a sorted array whose key equals that of an entry beside them."""
    beside = lambda x, j: F.coalesce(F.get(ordered, j)[key] == x[key], F.lit(False))
    return F.filter(ordered, lambda x, i: beside(x, i - 1) | beside(x, i + 1))


def _positions(entries: Column) -> Column:
    return F.sort_array(F.transform(entries, lambda x: x["at"]))


def _exactly_repeated(tokens: Column, starts: Column, n: int) -> Column:
    """Of the windows at ``starts``, those whose words occur in another one too."""
    text = lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")
    keyed = F.sort_array(F.transform(starts, lambda i: F.struct(text(i).alias("key"), i.alias("at"))))
    return let(keyed, lambda s: _positions(_paired(s, "key")))


def _covered(starts: Column, n: int) -> Column:
    """Words in at least one of the windows of ``n`` words at the sorted ``starts``."""
    gaps = F.transform(starts, lambda x, i: F.when(i == 0, F.lit(n)).otherwise(F.least(F.lit(n), x - F.get(starts, i - 1))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)


def repeated_words(tokens: Column, n: int = 8) -> Column:
    """Words that lie in a window of ``n`` words found at least twice in the text.

    Hashes of all windows show whether any can repeat; only windows with equal hashes are
    compared by their words, so the count is exact.
    """
    hashes = lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    )

    def found(windows: Column) -> Column:
        keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("key"), i.alias("at"))))
        starts = let(keyed, lambda s: _positions(_paired(s, "key")))
        exact = let(starts, lambda p: let(_exactly_repeated(tokens, p, n), lambda q: _covered(q, n)))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(exact)

    by_hash = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: let(hashes(h), found))
    return F.when(F.size(tokens) < n + 1, F.lit(0).cast("long")).otherwise(by_hash)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated"), F.size(x).alias("all")))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each whole text, in columns that begin with ``_q_``."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = let(words(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again")))
    out = docs.withColumns({"_q_words": counted, "_q_lines": repeated_lines(body)}).withColumns(
        {
            "_q_n_words": F.col("_q_words.n"),
            "_q_n_repeat_words": F.col("_q_words.again"),
            "_q_n_dup_lines": F.col("_q_lines.repeated"),
            "_q_n_lines": F.col("_q_lines.all").cast("long"),
            "_q_word_chars": F.length(F.regexp_replace(body, SPACES, "")).cast("long"),
            "_q_n_symbols": removed(body, SYMBOLS),
        }
    )
    n = F.col("_q_n_words")
    return out.drop("_q_words", "_q_lines").withColumns(
        {
            "_q_base": (n < 20) | (100 * F.col("_q_n_repeat_words") > 30 * n),
            "_q_symbols": 10 * F.col("_q_n_symbols") > n,
            "_q_lines": 10 * F.col("_q_n_dup_lines") > 3 * F.col("_q_n_lines"),
        }
    )


def host_verdicts(measures: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """One row per host (NULL is a host): n, shrunk rate per rule, rejected.

    The beta prior of a rule has the mean rate over all documents; its weight comes from the
    variance between hosts beyond what chance makes of equal rates (method of moments), and is
    kept between 1 and a million documents.
    """
    failures = [F.sum(F.col(f"_q_{r}").cast("double")).alias(f"f_{r}") for r in RULES]
    out = stored(measures.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).cast("double").alias("n"), *failures), "counts")
    share = lambda r: F.col(f"f_{r}") / F.col("n")
    whole = out.agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), *[(F.sum(f"f_{r}") / F.sum("n")).alias(r) for r in RULES]).first()
    if not whole["hosts"]:
        return out.select("host", "n", *[F.lit(None).cast("double").alias(f"rate_{r}") for r in RULES], F.lit(False).alias("rejected"))
    spread = out.agg(*[(F.sum(F.col("n") * F.pow(share(r) - whole[r], 2)) / whole["docs"]).alias(r) for r in RULES]).first()
    for r in RULES:
        noise = whole[r] * (1 - whole[r])
        between = max(spread[r] - noise * whole["hosts"] / whole["docs"], 1e-12)
        weight = min(max(noise / between - 1, 1.0), 1e6)
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + weight * whole[r]) / (F.col("n") + weight))
    rejected = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > host_limit
    return out.select("host", "n", *[f"rate_{r}" for r in RULES], rejected.alias("rejected"))


def judged(measures: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """``measures`` (read several times: a stored table) with ``_q_kept``."""
    rejected = stored(host_verdicts(measures, host, host_limit).where("rejected").select(F.col("host").alias("_q_host"), F.lit(True).alias("_q_bad")), "hosts")
    if rejected.count() <= SENT_HOSTS:
        rejected = F.broadcast(rejected)
    kept = ~F.col("_q_base") & F.col("_q_bad").isNull()
    return measures.join(rejected, F.col(host).eqNullSafe(F.col("_q_host")), "left").withColumn("_q_kept", kept).drop("_q_host", "_q_bad")


def quality(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): the measures and the verdict.

    NULL and empty texts have no words and fail the base rules; a NULL source is a host of its
    own; repeated rows are measured each; an empty table gives an empty result.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    measures = measured(docs.select("doc_id", "text", "source")).drop("text")
    out = judged(stored(measures, "measures"), host_limit=host_limit)
    return out.select("doc_id", *[F.col(f"_q_{x}").alias(x) for x in names], F.col("_q_base").alias("base_failed"), F.col("_q_kept").alias("kept"))


def quality_filter(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. The texts are not shuffled."""
    return judged(stored(measured(docs), "measured"), host_limit=host_limit).where("_q_kept").select(*docs.columns)
