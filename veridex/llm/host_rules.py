"""Operator 3: host-level quality rules, in DataFrame functions only.

Base rules fail single documents. Each host (``source``) then gets a failure rate that is shrunk towards an empirical
beta prior, whose two parameters come from the hosts' rates by moments. A host whose shrunk rate is over the limit is
rejected with all its documents; the verdicts are joined back.

Edge cases: a null or empty text has no words and fails the base rules; a null source is a host of its own; with one
host, or hosts without spread or with more than a beta has, the prior is the overall rate and weighs PRIOR_WEIGHT; a table without
rows gives no rows; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

#: A host is rejected if its shrunk failure rate is over this.
HOST_LIMIT = 0.8
PRIOR_WEIGHT = 10.0
#: Rejected hosts that may be broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 20_000
_BLANKS = "\t\n\x0b\x0c\r"


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once a row: inside another function's lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more in the array; every occurrence counts."""

    def covered(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - n)
        keys = F.transform(starts, lambda i: F.xxhash64(*[w[i + k] for k in range(n)]))

        def exact(starts: Column) -> Column:
            # sorted by the window's words, equal windows are neighbours
            windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[w[i + k] for k in range(n)]).alias("w"), i.alias("at"))))

            def positions(s: Column) -> Column:
                pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["at"], b["at"])))
                return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

            return _let(windows, lambda s: F.aggregate(
                positions(s),
                F.struct(F.lit(-n).alias("last"), F.lit(0).cast("bigint").alias("words")),
                lambda acc, p: F.struct(p.alias("last"), (acc["words"] + F.least(F.lit(n), p - acc["last"])).alias("words")),
                lambda acc: acc["words"],
            ))

        # a hash twice is needed for a window twice; few texts have one, and only they pay for sorting
        return _let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), exact(starts)).otherwise(F.lit(0).cast("bigint")))

    return F.when(F.size(words) > n, covered(words)).otherwise(F.lit(0).cast("bigint"))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blanked = F.translate(text, _BLANKS, " " * len(_BLANKS))

    def measured(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + _BLANKS, "")) > 0)
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        )

    found = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.length(F.translate(text, " " + _BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        _let(F.array_remove(F.split(blanked, " "), ""), measured).alias("m"),
    )
    n, repeated = F.col("m.n_words"), F.col("m.n_repeat_words")
    return found.select(
        "doc_id", "source", n.alias("n_words"), "word_chars", "n_symbols", F.col("m.n_dup_lines").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
        ((n < 10) | (100 * repeated > 20 * n)).alias("base_failed"),
    )


def hosts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: source, docs, failed, shrunk_rate, rejected; ``measured`` has source and base_failed of each document."""
    return shrunk(measured.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")), limit)


def shrunk(by: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts (source, docs, failed) with their shrunk failure rate and verdict."""
    by = by.withColumn("rate", F.col("failed") / F.col("docs"))
    prior = by.agg(F.avg("rate").alias("m"), F.var_samp("rate").alias("v"), (F.sum("failed") / F.sum("docs")).alias("overall")).first()
    spread = (prior.m or 0.0) * (1 - (prior.m or 0.0))
    fitted = prior.v is not None and 0 < prior.v < spread
    mean = prior.m if fitted else prior.overall or 0.0
    weight = spread / prior.v - 1 if fitted else PRIOR_WEIGHT
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("docs") + F.lit(weight))
    return by.select("source", "docs", "failed", rate.alias("shrunk_rate"), (rate > limit).alias("rejected"))


def _verdicts(measured: DataFrame, limit: float) -> DataFrame:
    """``measured`` with kept: the rejected hosts are broadcast if they are few, as checked by a count."""
    bad = hosts(measured, limit).filter("rejected").select(F.col("source").alias("host"), F.lit(True).alias("bad"))
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = measured.join(F.broadcast(bad) if few else bad, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("host", "bad")


def report(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per document: the base measures, base_failed and kept."""
    return _verdicts(stage(metrics(docs), "quality"), limit).drop("source")


def keep(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass the base rules and whose host passes, with all their columns.

    The rules run once: those that pass are staged, and what a host has beyond them has failed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")
    passes = _let(words, lambda w: (F.size(w) >= 10) & (100 * repeat_words(w) <= 20 * F.size(w).cast("bigint")))
    good = stage(docs.filter(passes), "good")
    per_host = lambda df, name: df.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias(name))
    passed = per_host(good, "passed").withColumnRenamed("source", "host")
    by = per_host(docs, "docs").join(passed, F.col("source").eqNullSafe(F.col("host")), "left").select("source", "docs", (F.col("docs") - F.coalesce("passed", F.lit(0))).alias("failed"))
    (host,) = fresh(docs, "host")
    bad = shrunk(by, limit).filter("rejected").select(F.col("source").alias(host))
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    return good.join(F.broadcast(bad) if few else bad, F.col("source").cast("string").eqNullSafe(F.col(host)), "left_anti")
