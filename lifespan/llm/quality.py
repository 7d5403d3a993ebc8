"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps one bit per failed rule and the
measurements behind them.  A policy is a named set of rules; what it keeps, and what each of its
rules alone costs, follows from the bits without reading texts again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifespan.llm.common import GAP, WORD, free_names, whole_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails`` is true of its measurements; the bit never changes its meaning."""

    name: str
    bit: int
    fails: Callable[[Column], Column]


RULES = (
    Rule("too_few_words", 0, lambda q: q["n_words"] < 50),
    Rule("repeated_words", 1, lambda q: 100 * q["n_repeat_words"] > 50 * q["n_words"]),
    Rule("symbols", 2, lambda q: 10 * q["n_symbols"] > 3 * q["n_words"]),
    Rule("repeated_lines", 3, lambda q: 10 * q["n_dup_lines"] > 3 * q["n_lines"]),
    Rule("short_words", 4, lambda q: q["word_chars"] < 2 * q["n_words"]),
    Rule("long_words", 5, lambda q: q["word_chars"] > 15 * q["n_words"]),
)

#: Versioned policies: names of rules.  A published version is never edited; add a new one.
POLICIES = {
    "base-1": ("too_few_words", "repeated_words"),
    "full-1": tuple(r.name for r in RULES),
}
PRODUCTION = "full-1"


def mask(policy: str, rules: tuple[Rule, ...] = RULES, policies: dict[str, tuple[str, ...]] | None = None) -> int:
    names = (policies or POLICIES)[policy]
    bits = {r.name: r.bit for r in rules}
    return reduce(lambda m, n: m | 1 << bits[n], names, 0)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column ``measures`` (a struct of ``MEASURES``, all long).

    Null and empty texts measure 0.  Words are ``[^\\x20\\x09-\\x0D]+``; a line counts if it has a
    word.  Word triples are compared by a 64-bit hash of their words inside one document, sorted,
    so a text of any length is measured whole in time n log n and without a shuffle.
    """
    words, lines, hashes, pairs, triples, at, out = free_names(
        docs, "words__", "lines__", "hashes__", "pairs__", "triples__", "at__", "measures"
    )
    whole = whole_text(text)
    a, n = F.col, F.size(F.col(words))

    def then(array: str, other: str, by: int) -> Column:
        """Hash of each value with the value ``by`` places on in the other array."""
        return F.zip_with(a(array), F.slice(a(other), by + 1, F.greatest(F.size(a(other)), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    # each step is a column of its own, so that no lambda repeats the work of a step before it
    step = docs.select("*", F.array_remove(F.split(whole, GAP, -1), "").alias(words), F.split(whole, "\n", -1).alias(lines))
    step = step.withColumn(hashes, F.transform(a(words), lambda w: F.xxhash64(w)))
    step = step.withColumn(lines, F.filter(a(lines), lambda x: F.regexp_like(x, F.lit(WORD))))
    step = step.withColumn(pairs, then(hashes, hashes, 1))
    step = step.withColumn(
        triples,
        F.sort_array(
            F.transform(F.slice(then(pairs, hashes, 2), 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        ),
    )
    following = F.slice(a(triples), 2, F.greatest(F.size(a(triples)), F.lit(1)))
    both = F.zip_with(a(triples), following, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    step = step.withColumn(at, F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda p: p.isNotNull())))))
    # a run covers three words, or as many as there are up to the next run
    next_at = F.slice(a(at), 2, F.greatest(F.size(a(at)), F.lit(1)))
    covered = F.aggregate(
        F.zip_with(a(at), next_at, lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))), F.lit(0), lambda s, x: s + x
    )
    values = {
        "n_words": n,
        "word_chars": F.char_length(whole) - F.regexp_count(whole, F.lit(r"[\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(a(lines)) - F.size(F.array_distinct(a(lines))),
        "n_repeat_words": covered,
        "n_lines": F.size(a(lines)),
    }
    # a generator holds the finished values, so that later filters are not evaluated below it
    made = F.explode(F.array(F.struct(*(values[m].cast("long").alias(m) for m in MEASURES)))).alias(out)
    return step.select(*(F.col(f"`{c}`") for c in docs.columns), made)


def failure_bits(measures: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(r.fails(measures), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules]
    return reduce(lambda x, y: x.bitwiseOR(y), bits).cast("long")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``doc_id``, the measurements, and ``failures``: bit ``r.bit`` is set if rule r fails.

    One row per row of ``docs``; an empty table gives an empty ledger.
    """
    found = measured(docs.select("doc_id", text), text)
    return found.select("doc_id", "measures.*", failure_bits(F.col("measures"), rules).alias("failures"))


def apply_policy(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Ledger rows with ``kept`` under a policy, and ``only_rule``: the rule that alone rejects."""
    failed = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    single = reduce(lambda c, r: c.when(failed == 1 << r.bit, F.lit(r.name)), RULES, F.when(F.lit(False), F.lit("")))
    return entries.select("*", (failed == 0).alias("kept"), single.alias("only_rule"))


def ablations(entries: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per policy and rule: documents it fails, those only it fails, and what is kept without it.

    The ledger is reduced to its distinct bit patterns first (at most two to the number of rules
    rows), so policies and rules cost nothing per document.
    """
    policies = policies or POLICIES
    patterns = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    bits = {r.name: r.bit for r in RULES}
    cases = [(p, name, 1 << bits[name], mask(p, policies=policies)) for p, names in policies.items() for name in names]
    table = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(b).alias("bit"), F.lit(m).alias("mask")) for p, r, b, m in cases)))
    each = patterns.select("failures", "n", table.alias("c")).select("failures", "n", "c.*")
    failed, bit = F.col("failures").bitwiseAND(F.col("mask")), F.col("bit")
    zero = F.lit(0).cast("long")
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(failed.bitwiseAND(bit) != 0, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(failed == bit, F.col("n")).otherwise(zero)).alias("n_only"),
        F.sum(F.when(failed == 0, F.col("n")).otherwise(zero)).alias("n_kept"),
        F.sum(F.when(failed.bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )


def keep(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The documents that the policy keeps, with their columns unchanged.

    Null and empty texts have no words and go; rows that are equal are judged alike and stay repeated;
    texts of any length are read whole, columns of any name stay, and an empty table stays empty.
    """
    found = measured(docs)
    passed = failure_bits(F.col(found.columns[-1])).bitwiseAND(F.lit(mask(policy))) == 0
    return found.filter(passed).select(*(F.col(f"`{c}`") for c in docs.columns))
