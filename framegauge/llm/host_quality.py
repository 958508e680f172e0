"""Quality rules of documents, and verdicts on the hosts that they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.functions.columns import quoted
from framegauge.llm.native import NO_SPACE, let, measured, words_of
from framegauge.session import checkpointed

MIN_WORDS = 50
# Shares above which a document fails a rule.
MAX_REPEATED = 0.50
MAX_SYMBOLS = 0.10
MAX_DUP_LINES = 0.30
# A host is rejected when its shrunk failure rate of some rule is above this.
MAX_HOST_RATE = 0.60
# Bounds of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6
RULES = ("short", "repeated", "symbols", "dup_lines")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more, the first time included.

    Windows are hashed.  Only where two hashes agree are they sorted with their
    positions; equal neighbours give the windows, and a window adds as many words as it
    lies behind the one before, three at most.  Linear but for that sort.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeats(pairs: Column) -> Column:
        at = F.transform(pairs, lambda x, k: F.when(
            (x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get(at, k - 1), p - 3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(pairs, repeats), covered))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), counted)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)
    and base_failed; columns of these names are replaced, all others passed through
    whatever their names.  A null text has no words."""
    kept = [c for c in docs.columns if c not in MEASURES]
    split = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(quoted(text), F.lit("")).alias("value")).withColumns(
        {"words": words_of(F.col("value")), "lines": F.filter(F.split("value", "\n"), lambda line: line.rlike(NO_SPACE))})
    counts = {
        "n_words": F.size("words"), "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("value", F.lit("[#*$%&|<>]")), "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": repeated_words(F.col("words"))}
    made = split.withColumns({k: v.cast("bigint") for k, v in counts.items()})
    n = F.col("n_words")
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *MEASURES[:-1], (
        (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * int(100 * MAX_REPEATED))).alias("base_failed"))


def _failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {"short": n < MIN_WORDS, "repeated": F.col("n_repeat_words") > n * MAX_REPEATED,
            "symbols": F.col("n_symbols") > n * MAX_SYMBOLS, "dup_lines": F.col("n_dup_lines") > F.col("n_lines") * MAX_DUP_LINES}


def host_verdicts(measures: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, rate of every rule, host_rejected), one row per host that is not null.

    A rate is (failures + a) / (documents + a + b).  The beta prior (a, b) has the mean
    of all documents; its strength a + b follows by moments from how far the hosts'
    own rates differ beyond what chance explains.  Failures are combined before the
    shuffle, so a hot host is a row per task.
    """
    failed = _failures()
    hosts = checkpointed(measures.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(failed[r]).alias(r) for r in RULES]))
    n = F.col("n_docs")
    sums = hosts.agg(F.sum(n).alias("docs"), F.count(F.lit(1)).alias("hosts"), *[F.sum(r).alias(r) for r in RULES]).first()
    docs, count = sums["docs"] or 0, sums["hosts"]
    rates = {r: (sums[r] or 0) / docs if docs else 0.0 for r in RULES}
    spreads = hosts.agg(*[F.sum(n * F.pow(F.col(r) / n - rates[r], 2)).alias(r) for r in RULES]).first()
    shrunk = {}
    for r in RULES:
        mean = rates[r]
        chance = mean * (1 - mean)
        # Expected over hosts: chance (hosts - 1) from sampling alone, the rest is between hosts.
        between = ((spreads[r] or 0.0) - chance * (count - 1)) / docs if docs else 0.0
        strength = min(max(chance / between - 1, MIN_STRENGTH), MAX_STRENGTH) if between > 0 else MAX_STRENGTH
        shrunk[r] = (F.col(r) + mean * strength) / (n + strength)
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (shrunk[r] > MAX_HOST_RATE)
    return hosts.select("host", "n_docs", *[shrunk[r].alias(f"{r}_rate") for r in RULES], rejected.alias("host_rejected"))


def with_host_verdicts(measures: DataFrame, host: str = "source") -> DataFrame:
    """``measures`` with host_rejected and kept; columns of these names are replaced.

    kept is false where base_failed is true or the host is rejected.  Rows without a
    host are judged by themselves.
    """
    verdicts = host_verdicts(measures, host).where("host_rejected").select(F.col("host").alias("bad"))
    bad = measured(verdicts, F.octet_length("bad"))
    kept = [c for c in measures.columns if c not in ("host_rejected", "kept")]
    inner = measures.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], quoted(host).alias("host"), F.col("base_failed").alias("failed"))
    rejected = F.col("bad").isNotNull()
    return inner.join(bad, F.col("host") == F.col("bad"), "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], rejected.alias("host_rejected"), (~F.col("failed") & ~rejected).alias("kept"))


def host_quality(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with their measures, base_failed, host_rejected and kept.

    Built-in expressions only.  Texts stay in their row, however long: nothing is
    exploded, and only per-host counts are shuffled.  Repeated rows are judged alike.
    """
    return with_host_verdicts(quality_measures(docs, text), host)
